"""Fixed values and the settings of one mixture."""

from __future__ import annotations

from dataclasses import dataclass

# Names of the source datasets, in their declared order.
SUBMIXTURES = ("flan2021", "t0", "niv2", "cot", "dialog")

# Template types, in the order budgets are split.
TEMPLATE_TYPES = ("zs_opt", "zs_noopt", "fs_opt", "fs_noopt")

# Objectives and their weights.
OBJECTIVES = ("fl", "gc", "logdet", "random")
GRAPH_CUT_LAMBDA = 0.4
LOG_DET_LAMBDA = 1.0

# Seeds of the train shuffle and task sample, and of the random ordering.
SHUFFLE_SEED = 23
ORDERING_SEED = 69

# Groups above the threshold are ordered in chunks.
CHUNK_THRESHOLD = 150_000
CHUNK_ROWS = 100_000

# Tuning preparation.
IGNORE_INDEX = -100
UNSET_MAX_LENGTH = 1024
ENCODE_BATCH_ROWS = 128

TASK_KEY = ("submixture", "task_name")
GROUP_KEY = ("submixture", "task_name", "template_type")
ROW_KEY = ("submixture", "row_idx")

# Two gains closer than this are one gain; the lower position then wins.
GAIN_DIGITS = 9
PUBLISHED_DIGITS = 6


@dataclass(frozen=True)
class MixtureConfig:
    """What to pick: `num_tasks` tasks and `num_instances` rows out of them."""

    num_tasks: int = 8
    num_instances: int = 25_000
    task_objective: str = "gc"
    instance_objective: str = "fl"
    submixtures: tuple[str, ...] = SUBMIXTURES
    context_length: int = 4096
    taylor_order: int = 2
    temperature: float = 1.0
    task_seed: int = SHUFFLE_SEED
    ordering_seed: int = ORDERING_SEED
    shuffle_seed: int = SHUFFLE_SEED
    chunk_threshold: int | None = None
    chunk_rows: int = CHUNK_ROWS

    def __post_init__(self) -> None:
        for objective in (self.task_objective, self.instance_objective):
            if objective not in OBJECTIVES:
                raise ValueError(f"unknown objective {objective!r}, expected one of {OBJECTIVES}")
        if self.num_tasks < 1 or self.num_instances < 1:
            raise ValueError("num_tasks and num_instances must be positive")
        if self.taylor_order < 2 or self.taylor_order % 2:
            raise ValueError("taylor_order must be even and positive")

    @property
    def name(self) -> str:
        """Directory name of the written mixture."""
        return (
            f"{self.context_length}-{self.num_tasks}-tasks-{self.task_objective}"
            f"-{self.num_instances}-instances-{self.instance_objective}"
        )
