"""Tables written to the shared folder, for intermediate rows too many or too wide for a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mixloom.cluster import scratch_path


class Table:
    """`df`, written once as Parquet; `rows` reads it. `drop` deletes it once nothing depends on it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
