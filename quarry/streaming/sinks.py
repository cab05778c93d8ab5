"""A table that a stream writes epoch by epoch, so that a repeated epoch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.relational import latest


class EpochTable:
    """Rows of a stream in a shared folder, one part per epoch.

    An epoch that runs again after a failure replaces its own part. Append streams are read whole; update streams have
    keys, and of each key the row of the last epoch is the table's. `compact` folds the parts into a base, which is
    written beside the former one and counts from the moment that it is complete."""

    def __init__(self, path: str, keys: list[str] | None = None):
        self.path, self.keys = path.rstrip("/"), keys

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/part/epoch={epoch}")

    def _bases(self, spark: SparkSession) -> list[int]:
        """Epochs up to which there is a complete base."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/base")
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))

    def _rows(self, spark: SparkSession, schema: str) -> DataFrame:
        """All rows with their epoch: those of the last base, and the parts after it."""
        whole = schema + ", epoch long"
        parts = spark.read.schema(whole).option("basePath", f"{self.path}/part").parquet(f"{self.path}/part")
        bases = self._bases(spark)
        if not bases:
            return parts
        return spark.read.schema(whole).parquet(f"{self.path}/base/upto={bases[-1]}").unionByName(parts.where(F.col("epoch") > bases[-1]))

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        rows = self._rows(spark, schema)
        return (latest(rows, self.keys, "epoch") if self.keys else rows).drop("epoch")

    def compact(self, spark: SparkSession, schema: str, epoch: int) -> None:
        """Folds all epochs up to one that is finished."""
        rows = self._rows(spark, schema).where(F.col("epoch") <= epoch)
        (latest(rows, self.keys, "epoch").select(*rows.columns) if self.keys else rows).write.mode("overwrite").parquet(f"{self.path}/base/upto={epoch}")
