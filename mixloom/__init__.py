"""Instruction-tuning data mixtures as Spark plans."""

import sys

from pyspark import cloudpickle

from mixloom.config import MixtureConfig

# Functions sent to tasks travel by value: executors need numpy, pandas and pyarrow only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["MixtureConfig"]
