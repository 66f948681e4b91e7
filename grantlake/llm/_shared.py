"""Shared folder, lineage cuts and word patterns of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the query contracts.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SEQ = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in the low 33 bits


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the
    session; where that is unset and all runs on one machine (tests), a temporary
    folder. A cluster has to name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='grantlake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_remove, spark, root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended, and its folder with it
        return


class Scratch:
    """Tables written under the shared folder, so that lost executors cost at
    most the running stage. ``drop`` removes tables that nothing reads any more;
    the rest goes when Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/grantlake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_counting(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """``write`` and, from the same job, the number of rows. A task that ran twice may count
        twice, so only ask whether it is 0."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"] or 0

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            for file in df.inputFiles()[:1]:
                _remove(self.spark, file.rsplit("/", 1)[0])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def with_rank(scratch: Scratch, df: DataFrame, order: list[Column], rank: str, keep_part: bool = False) -> DataFrame:
    """Add the 0-based rank of each row in a total order without one global
    sort task: range-partition, sort, and add the row counts of the partitions
    before. The table of partition counts has one row per partition.
    ``keep_part`` keeps ``__part``, the number of the row's partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.write(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_SEQ))),
        "ranked",
    )
    return placed.join(F.broadcast(offsets(placed.groupBy("__part").agg(F.count("*").alias("__n")), "__n")), "__part").withColumn(rank, F.col("__before") + F.col("__seq")).drop("__seq", "__before", *([] if keep_part else ["__part"]))


def offsets(parts: DataFrame, value: str) -> DataFrame:
    """(__part, __before): the sum of ``value`` over lower parts. One row per
    partition of a range-partitioned table, so a single window task is bounded."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("__part", F.coalesce(F.sum(F.col(value).cast("long")).over(before), F.lit(0)).alias("__before"))


def ship(spark: SparkSession) -> None:
    """Make this subpackage importable in Python workers whatever their path."""
    import os
    import zipfile

    import grantlake

    context = spark.sparkContext
    if getattr(context, "_grantlake_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(grantlake.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="grantlake-code-"), "grantlake_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        z.writestr("grantlake/__init__.py", "")
        for name in sorted(os.listdir(os.path.join(top, "llm"))):
            if name.endswith(".py"):
                z.write(os.path.join(top, "llm", name), f"grantlake/llm/{name}")
    context.addPyFile(target)
    context._grantlake_shipped = True


def trim() -> None:
    """Give free memory back to the system: Python workers live on, idle, between stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def slices(batches, limit: int = 8 << 20):
    """Cut Arrow batches with large texts into ones of about ``limit`` bytes
    (a single longer row stays whole); free memory is given back after the last."""
    for batch in batches:
        size = batch.nbytes
        if size <= limit or batch.num_rows <= 1:
            yield batch
            continue
        rows = max(1, batch.num_rows * limit // size)
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()
