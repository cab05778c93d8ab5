"""Shared helpers: table access, durable intermediates and byte-level text views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the six characters that end a word in the plain word definition.
SPACE_BYTES = b" \t\n\r\x0b\x0c"
#: Rows of a few numbers that a task handles at ease.
ROWS_PER_TASK = 1 << 19
#: With this on, Spark removes a query's shuffle files when the query ends; else they stay until the driver happens to
#: collect its garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset and Spark runs in one process, as in tests, a
    temporary one; executors elsewhere would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def tasks_for(rows: int) -> int:
    """Tasks that write a table of so many short rows: a table of few rows is not dealt over all shuffle partitions."""
    return max(16, rows // ROWS_PER_TASK + 1)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage with replicated, executor-independent files and gives
    the optimizer true sizes for its choice between broadcast and shuffle joins.
    What was exchanged on the way is removed at once: nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREES_SHUFFLES, "false")
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREES_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The largest whole classes of counts that hold at most `most` rows. Classes are a sixteenth of a doubling
    wide, so a few hundred rows tell where to cut, and no task sends its own best rows to the driver."""
    counts = stored(counts, "counts")
    place = F.floor(F.log2(F.col(n).cast("double")) * 16)
    sizes = sorted(((r["place"], r["count"]) for r in counts.groupBy(place.alias("place")).count().collect()), reverse=True)
    total, cut = 0, None
    for at, size in sizes:
        total += size
        if total > most:
            break
        cut = at
    return counts.where(place >= cut) if cut is not None else counts.limit(0)


def partitions_for(spark: SparkSession, floor: int = 0) -> int:
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each value of a string column, without decoding them first."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about `most` bytes of text (one row at least)."""
    for batch in batches:
        arr = batch.column(column)
        if not len(arr):
            continue
        ends = np.frombuffer(arr.buffers()[1], dtype=np.int64 if pa.types.is_large_string(arr.type) else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        at = 0
        while at < len(arr):
            to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
            to = min(len(arr), max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to
