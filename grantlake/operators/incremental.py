"""Which member sets a change can touch, and their evaluation alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.functions.columns import TUPLE
from grantlake.operators import rewrite as R
from grantlake.operators.engine import OBJECT, Engine
from grantlake.plans.compile import Compiled, dependency_rows
from grantlake.plans.schema import STAR, Direct, Inherited, leaves
from grantlake.sources.storage import cut, cut_or_empty

KEY = ("type", "relation", "name")


def touched(compiled: Compiled, tuples: DataFrame) -> DataFrame:
    """(type, relation, name) of the sets that read changed tuples themselves."""
    readers = set()
    for (t, r), e in compiled.schema.relations.items():
        for leaf in leaves(e):
            stored = r if isinstance(leaf, Direct) else leaf.tupleset if isinstance(leaf, Inherited) else None
            readers |= {(t, stored, r)} if stored else set()
    table = tuples.sparkSession.createDataFrame(sorted(readers), "d_type string, d_stored string, d_relation string")
    on = (F.col("object_type") == F.col("d_type")) & (F.col("relation") == F.col("d_stored"))
    return tuples.join(F.broadcast(table), on).select(F.col("d_type").alias("type"), F.col("d_relation").alias("relation"), F.col("object_name").alias("name")).distinct()


def affected(compiled: Compiled, stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Every set that may differ once those in ``changed`` do, themselves included.
    Each round follows only what the round before found."""
    spark: SparkSession = stored.sparkSession
    table = F.broadcast(spark.createDataFrame(dependency_rows(compiled.schema), "kind string, s_type string, s_relation string, via string, pred string, d_type string, d_relation string"))
    found = [cut(changed.select(*KEY).distinct())]
    while True:
        met = found[-1].join(table, (F.col("type") == F.col("s_type")) & (F.col("relation") == F.col("s_relation")))
        same = met.where("kind = 'computed'").select(F.col("d_type").alias("type"), F.col("d_relation").alias("relation"), "name")
        # a wildcard subject stands for each of its instances
        asked = met.where("kind <> 'computed'").withColumn("who", F.explode(F.array("name", F.lit(STAR)))).select("s_type", "who", "via", "pred", "d_type", "d_relation").distinct()
        on = (
            (F.col("subject_type") == F.col("s_type")) & (F.col("subject_name") == F.col("who")) & (stored["relation"] == F.col("via"))
            & (F.col("subject_predicate") == F.col("pred")) & (F.col("object_type") == F.col("d_type"))
        )
        over = asked.join(stored, on).select(F.col("d_type").alias("type"), F.col("d_relation").alias("relation"), F.col("object_name").alias("name"))
        new = cut_or_empty(same.union(over).distinct().join(reduce(DataFrame.union, found), list(KEY), "left_anti"))
        if new is None:
            return reduce(DataFrame.union, found)
        found.append(new)


def changed_keys(compiled: Compiled, before: DataFrame, after: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(type, relation, name) of the sets that read what differs between two states of the
    tuples. ``among``: tuples outside of which nothing has changed. Besides stored tuples these are names that come or go, where a star
    stands for every name of a type."""
    shapes = sorted(compiled.flowing | compiled.object_wildcards)
    olds, news = (before, after) if among is None or compiled.object_wildcards else (x.join(among, list(TUPLE), "left_semi") for x in (before, after))
    if compiled.object_wildcards:
        olds, news = R.spread(before), R.spread(after)
    differ = news.join(olds, list(TUPLE), "left_anti").unionByName(olds.join(news, list(TUPLE), "left_anti"))
    keys = touched(compiled, cut(differ))
    if shapes:
        types = [t for t, _ in shapes]
        old, new = (R.instances(x).where(F.col("type").isin(types)) for x in (before, after))
        named = new.join(old, ["type", "name"], "left_anti").unionByName(old.join(new, ["type", "name"], "left_anti"))
        table = F.broadcast(before.sparkSession.createDataFrame(shapes, "type string, relation string"))  # of the schema
        keys = keys.unionByName(named.join(table, "type").select(*KEY)).distinct()
    return keys


def as_objects(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("relation").alias("o_pred"), F.col("type").alias("o_type"), F.col("name").alias("o_name"))


def refresh(old_model: DataFrame, engine: Engine, keys: DataFrame) -> DataFrame:
    """The model after a change: old rows of sets that ``keys`` does not hold, and the rest evaluated anew, alone."""
    new = engine.update(as_objects(keys), old_model)
    kept = old_model.join(new.demand, list(OBJECT), "left_anti")
    return kept.select(*old_model.columns).unionByName(new.model().select(*old_model.columns))
