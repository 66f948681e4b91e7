"""The algebra of member sets: positive members, stars over shapes, exceptions.

A set is rows (key..., kind, s_pred, s_type, s_name): ``pos`` a member, ``star`` all of
a shape (name ``*``), ``neg`` one of a starred shape that is no member. Canonical:
no ``pos`` under a star of its shape, no ``neg`` without one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.plans.schema import STAR

SUBJECT = ("s_pred", "s_type", "s_name")
SHAPE = ("s_pred", "s_type")


def combine(rows: DataFrame, key: Sequence[str], n: int, truth: Callable[[list[Column]], Column], distinct: bool = False) -> DataFrame:
    """Combine leaf sets by a boolean function of the leaves' truths.

    ``rows``: key, leaf (0..n-1), source, kind, subject. A leaf may have several
    sources, each canonical. A subject is in a leaf if some source names it, or more
    sources star its shape than except it; a shape's star is in a leaf if some source
    has it. The same function of the leaves decides stars and subjects, and a
    subject is kept only where it differs from its shape's star. ``distinct``: no row is there twice."""
    rows = rows.select(*key, "leaf", "source", "kind", *SUBJECT)
    rows = rows if distinct else rows.distinct()
    count = lambda kind, i: F.count(F.when((F.col("kind") == kind) & (F.col("leaf") == i), 1))
    stars = rows.where("kind = 'star'").groupBy(*key, *SHAPE).agg(*(count("star", i).alias(f"star{i}") for i in range(n)))
    named = rows.where("kind <> 'star'").groupBy(*key, *SUBJECT).agg(*(f for i in range(n) for f in (count("pos", i).alias(f"pos{i}"), count("neg", i).alias(f"neg{i}"))))
    shape = [f"star{i}" for i in range(n)]
    right = stars.select(*(F.col(c).alias(f"__{c}") for c in (*key, *SHAPE)), *shape)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*key, *SHAPE)]
    named = named.join(right, on, "left").fillna(0, shape)
    of_star = truth([F.col(c) > 0 for c in shape])
    of_name = truth([(F.col(f"pos{i}") > 0) | (F.col(f"star{i}") > F.col(f"neg{i}")) for i in range(n)])
    starred = stars.where(of_star).select(*key, F.lit("star").alias("kind"), *SHAPE, F.lit(STAR).alias("s_name"))
    differ = named.where(of_name != of_star).select(*key, F.when(of_name, "pos").otherwise("neg").alias("kind"), *SUBJECT)
    return starred.select(*key, "kind", *SUBJECT).unionByName(differ)


def _two(a: DataFrame, b: DataFrame, key: Sequence[str], truth) -> DataFrame:
    tag = lambda df, i: df.withColumn("leaf", F.lit(i)).withColumn("source", F.lit(""))
    return combine(tag(a, 0).unionByName(tag(b, 1)), key, 2, truth)


def union(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return _two(a, b, key, lambda t: t[0] | t[1])


def intersect(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return _two(a, b, key, lambda t: t[0] & t[1])


def subtract(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return _two(a, b, key, lambda t: t[0] & ~t[1])


def normalize(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The canonical form of one set."""
    return combine(rows.withColumn("leaf", F.lit(0)).withColumn("source", F.lit("")), key, 1, lambda t: t[0])


def materialize(rows: DataFrame, population: DataFrame, key: Sequence[str]) -> DataFrame:
    """key and subject of every member: stars spread over ``population`` (s_pred,
    s_type, s_name), exceptions left out."""
    stars = rows.where("kind = 'star'").select(*key, *SHAPE).join(population.select(*SUBJECT).distinct(), list(SHAPE))
    every = stars.select(*key, *SUBJECT).join(rows.where("kind = 'neg'").select(*key, *SUBJECT), [*key, *SUBJECT], "left_anti")
    return every.union(rows.where("kind = 'pos'").select(*key, *SUBJECT)).distinct()


def count_members(rows: DataFrame, population: DataFrame, key: Sequence[str]) -> DataFrame:
    """key and ``n``: how many of ``population`` each set of canonical rows holds, without
    spreading its stars: the shape's population less the exceptions, and the named members.
    Names outside the population count as ``materialize`` counts them."""
    people = population.select(*SUBJECT).distinct()
    sizes = people.groupBy(*SHAPE).agg(F.count("*").alias("size"))
    plus = rows.where("kind = 'star'").join(F.broadcast(sizes), list(SHAPE)).select(*key, F.col("size").alias("d"))
    less = rows.where("kind = 'neg'").join(people, list(SUBJECT), "left_semi").select(*key, F.lit(-1).cast("long").alias("d"))
    named = rows.where("kind = 'pos'").select(*key, F.lit(1).cast("long").alias("d"))
    return plus.unionAll(less).unionAll(named).groupBy(*key).agg(F.sum("d").alias("n")).where("n > 0")
