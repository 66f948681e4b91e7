"""Shared folder and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_SEQ = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in the low 33 bits


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which all executors share; where it
    is unset and all runs on one machine (tests), a temporary folder. A cluster has to name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='grantlake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(delete, spark, root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is over and takes its folder along
        return


_scopes = threading.local()


@contextmanager
def scope(spark: SparkSession):
    """Delete the tables that ``cut`` writes inside when the block ends; nothing read from them may outlive it."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        mine, _scopes.paths = _scopes.paths, outer
        for path in mine:
            delete(spark, path)


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. ``by``: columns to lay it out
    by, so that a filter on them reads its folders alone; files of even size, whatever the
    values' shares."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grantlake-cut-{uuid.uuid4().hex}"
    if getattr(_scopes, "paths", None) is None:
        atexit.register(delete, spark, path)
    else:
        _scopes.paths.append(path)
    if by:
        df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def cut_counting(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut`` and, from the same job, the values of aggregates over what was written. A task
    that ran twice may count twice, so only ask whether they are 0."""
    seen = Observation()
    out = cut(df.observe(seen, *(c.alias(name) for name, c in measures.items())))
    return out, {name: seen.get[name] or 0 for name in measures}


def cut_or_empty(df: DataFrame) -> DataFrame | None:
    """``cut``, or None if there are no rows."""
    out, seen = cut_counting(df, n=F.count(F.lit(1)))
    return out if seen["n"] else None


def _parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by range and sorted where they are, with the part (``__part``) and the place in it (``__seq``)."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_SEQ))))


def _before(placed: DataFrame, size: Column) -> DataFrame:
    """(__part, __before): what the parts before each hold, one row a part."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.groupBy("__part").agg(size.alias("n")).select("__part", before.alias("__before"))


def numbered(rows: DataFrame, start: int, order: list[str], name: str) -> DataFrame:
    """Give rows the ids start+1, start+2, ... in a total order: they are dealt by range and
    sorted where they are, and each part adds the row counts of those before (one row a part)."""
    placed = _parts(rows, order)
    return placed.join(F.broadcast(_before(placed, F.count("*"))), "__part").withColumn(name, (F.col("__before") + F.col("__seq") + F.lit(start + 1)).cast("long")).select(*rows.columns, name)


def stacked(rows: DataFrame, start: int, order: list[str], size: str, name: str) -> DataFrame:
    """Give each row as many ids past ``start`` as its ``size`` says, in a total order: ``name`` is the id before its first."""
    placed = _parts(rows, order)
    within = F.coalesce(F.sum(size).over(Window.partitionBy("__part").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("__within", within).join(F.broadcast(_before(placed, F.sum(size))), "__part").withColumn(name, (F.col("__before") + F.col("__within") + F.lit(start)).cast("long")).select(*rows.columns, name)
