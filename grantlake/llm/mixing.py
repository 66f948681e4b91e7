"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target share of the whole by
its weight, and its repetition rate is target / size. A document is emitted
floor(rate) times, plus once more if a hash of its id, read as a number in
[0, 1), lies below the fraction of the rate: an expected count of exactly
``rate`` copies, with reruns that agree.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; rows that repeat are documents of their own and draw alike; an
empty table gives an empty table; a source of size 0 has target 0 and rate 0,
so its documents are emitted no times. Columns of the input that bear a name
this operator adds are replaced in ``plan_mixture`` and kept in ``emit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm._shared import WORD, Scratch, with_rank

#: Above this many sources the rates are joined by a salted shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_unit(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) drawn from the first 32 bits of md5(seed:id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(scratch: Scratch, sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source, source_size, target) of ``sized`` (source, size).

    Weights repeat along the sources in code-point order, null last. Targets are
    min(cap * size, level * weight) with the level at which they add up to
    share * total: each round fixes the sources above their cap and shares the
    excess among the rest, until none is above. Only three sums reach the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_rank(scratch, sums, [F.col("source").asc_nulls_last()], "__rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = scratch.write(ranked.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * cap).alias("most")), "sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, fixed = 0.0, None
    while True:
        above = F.lit(False) if fixed is None else F.col("most") < F.lit(level) * F.col("w")
        used, rest, n = table.agg(
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0)), F.sum(F.when(above, 1).otherwise(0))
        ).first()
        if n == fixed or not rest:
            break
        fixed, level = n, (share * total - used) / rest
    capped = F.lit(not rest) | (F.col("most") < F.lit(level) * F.col("w"))
    return table.select("source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def plan_mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Every document with size, source_size, target and copies."""
    scratch = scratch or Scratch(docs.sparkSession)
    sized = scratch.write(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    rates = source_targets(scratch, sized, weights, share, cap)
    rates = rates.select(F.col("source").alias("__source"), F.struct("source_size", "target").alias("__rate"))
    out = docs.withColumn("size", word_count(F.col(text_col)))
    if rates.count() <= BROADCAST_SOURCES:
        joined = out.join(F.broadcast(rates), out[source_col].eqNullSafe(rates["__source"]))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("__pick", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        joined = out.join(salted, out[source_col].eqNullSafe(salted["__source"]) & (out["__pick"] == salted["__salt"])).drop("__salt", "__pick")
    size, target = F.col("__rate.source_size"), F.col("__rate.target")
    joined = joined.withColumn("__r", F.when(size > 0, target / size).otherwise(F.lit(0.0)))
    whole = F.floor(F.col("__r"))
    copies = (whole + (hash_unit(F.col(id_col), seed) < F.col("__r") - whole).cast("long")).cast("long")
    return joined.withColumn("source_size", size).withColumn("target", target).withColumn("copies", copies).drop("__source", "__rate", "__r")


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the columns of ``docs``, each row ``copies`` times."""
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | {k: options.pop(k) for k in ("id_col", "text_col", "source_col") if k in options}
    wide = kept.select("__doc", *(F.col("__doc")[v].alias(k) for k, v in names.items()))
    plan = plan_mixture(wide, id_col="id_col", text_col="text_col", source_col="source_col", **options)
    return plan.where("copies > 0").select("__doc", F.explode(F.expr("array_repeat(0, int(copies))")).alias("__copy")).select("__doc.*")
