"""Tuples to edges: admission, routing and the closed rewrite rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.functions.columns import TUPLE, is_identifier, is_name, is_predicate
from grantlake.plans.compile import Compiled
from grantlake.plans.schema import STAR

#: An edge from a subject node to an object node; a node is (predicate, type, name).
EDGE = ("src_pred", "src_type", "src_name", "dst_pred", "dst_type", "dst_name")


#: The node name of a wildcard object, apart from the wildcard subject of the same shape.
ALL = "*all"


def rule_table(spark: SparkSession, compiled: Compiled, needed: frozenset | None = None) -> DataFrame:
    """The rewrite rules: as many rows as the schema has, whatever the data.
    ``needed``: only those into these (type, relation)."""
    rules = [r for r in compiled.rules if needed is None or (r.object_type, r.target) in needed]
    rows = [(r.object_type, r.relation, r.subject_type, r.subject_predicate, r.star, r.predicate, r.target) for r in rules]
    return spark.createDataFrame(rows, "r_otype string, r_rel string, r_stype string, r_spred string, r_star boolean, r_pred string, r_target string")


def admission_table(spark: SparkSession, compiled: Compiled) -> DataFrame:
    return spark.createDataFrame(compiled.admitted, "a_otype string, a_rel string, a_stype string, a_spred string, a_star boolean")


def reject_reasons(tuples: DataFrame, compiled: Compiled) -> DataFrame:
    """``tuples`` with ``reject_reason``: null where the schema admits the row."""
    spark = tuples.sparkSession
    table = F.broadcast(admission_table(spark, compiled))
    star = F.col("subject_name") == STAR
    admitted = (
        (F.col("object_type") == F.col("a_otype"))
        & (F.col("relation") == F.col("a_rel"))
        & (F.col("subject_type") == F.col("a_stype"))
        & (F.col("subject_predicate") == F.col("a_spred"))
        & (star == F.col("a_star"))
    )
    wild = [F.lit(f"{t}#{r}") for t, r in sorted(compiled.object_wildcards)]
    known = F.concat("object_type", F.lit("#"), "relation").isin(*wild) if wild else F.lit(False)
    names = is_name(F.col("subject_name")) & is_name(F.col("object_name")) & is_predicate(F.col("subject_predicate"))
    for c in ("subject_type", "relation", "object_type"):
        names = names & is_identifier(F.col(c))
    joined = tuples.join(table, admitted, "left")
    reason = F.when(~names, "identifier").when((F.col("object_name") == STAR) & ~known, "object_wildcard").when(F.col("a_rel").isNull(), "restriction")
    return joined.withColumn("reject_reason", reason).drop("a_otype", "a_rel", "a_stype", "a_spred", "a_star")


def admit(tuples: DataFrame, compiled: Compiled) -> DataFrame:
    """The distinct admitted tuples."""
    return reject_reasons(tuples.select(*TUPLE), compiled).where("reject_reason is null").select(*TUPLE).distinct()


def derive_edges(tuples: DataFrame, compiled: Compiled, needed: frozenset | None = None) -> DataFrame:
    """All edges of admitted tuples, one row for each tuple and target (so the
    number of equal rows is an edge's multiplicity): one broadcast join."""
    rules = F.broadcast(rule_table(tuples.sparkSession, compiled, needed))
    on = (
        (F.col("object_type") == F.col("r_otype"))
        & (F.col("relation") == F.col("r_rel"))
        & (F.col("subject_type") == F.col("r_stype"))
        & (F.col("subject_predicate") == F.col("r_spred"))
        & ((F.col("subject_name") == STAR) == F.col("r_star"))
    )
    predicate = F.when(F.col("r_pred") == "", F.col("subject_predicate")).otherwise(F.col("r_pred"))
    return tuples.join(rules, on).select(
        predicate.alias("src_pred"), F.col("subject_type").alias("src_type"), F.col("subject_name").alias("src_name"),
        F.col("r_target").alias("dst_pred"), F.col("object_type").alias("dst_type"), F.when(F.col("object_name") == STAR, ALL).otherwise(F.col("object_name")).alias("dst_name"),
    )


def multiplicity(edges: DataFrame) -> DataFrame:
    """Direct edges with the number of tuples and rules that give them."""
    return edges.groupBy(*EDGE).agg(F.count("*").alias("multiplicity"))


def reference_counts(edges: DataFrame) -> DataFrame:
    """For each node, the direct edges at either end."""
    ends = edges.select(F.explode(F.array(*(F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ("pred", "type", "name"))) for side in ("src", "dst")))).alias("n"))
    return ends.select("n.*").groupBy("pred", "type", "name").agg(F.count("*").alias("refcount"))


def instances(tuples: DataFrame) -> DataFrame:
    """(type, name): the concrete names that tuples mention."""
    ends = tuples.select(F.explode(F.array(F.struct(F.col("subject_type").alias("type"), F.col("subject_name").alias("name")), F.struct(F.col("object_type").alias("type"), F.col("object_name").alias("name")))).alias("n"))
    return ends.select("n.*").where(F.col("name") != STAR).distinct()


def population(tuples: DataFrame) -> DataFrame:
    """(type, predicate, name): the concrete nodes of each shape."""
    ends = tuples.select(F.explode(F.array(F.struct(F.col("subject_type").alias("type"), F.col("subject_predicate").alias("predicate"), F.col("subject_name").alias("name")), F.struct(F.col("object_type").alias("type"), F.col("relation").alias("predicate"), F.col("object_name").alias("name")))).alias("n"))
    return ends.select("n.*").where(F.col("name") != STAR).distinct()


def spread(tuples: DataFrame) -> DataFrame:
    """``tuples`` with those on a wildcard object repeated for each instance of its
    type: what a concrete object takes from ``T:*``."""
    wild = tuples.where(F.col("object_name") == STAR)
    each = wild.join(instances(tuples).toDF("__type", "__name"), F.col("object_type") == F.col("__type"))
    return tuples.unionByName(each.withColumn("object_name", F.col("__name")).select(*TUPLE)).distinct()


def bridges(tuples: DataFrame, compiled: Compiled) -> DataFrame:
    """Edges that connect wildcards with the instances of their type: an instance's
    userset into the subject wildcard through which members flow, and an object
    wildcard into each instance."""
    spark = tuples.sparkSession
    live = instances(tuples)
    into = spark.createDataFrame(sorted(compiled.flowing), "b_type string, b_pred string")
    out = spark.createDataFrame(sorted(compiled.object_wildcards), "b_type string, b_pred string")
    into = live.join(F.broadcast(into), F.col("type") == F.col("b_type")).select(
        F.col("b_pred").alias("src_pred"), F.col("type").alias("src_type"), F.col("name").alias("src_name"), F.col("b_pred").alias("dst_pred"), F.col("type").alias("dst_type"), F.lit(STAR).alias("dst_name")
    )
    return into.union(
        live.join(F.broadcast(out), F.col("type") == F.col("b_type")).select(
            F.col("b_pred").alias("src_pred"), F.col("type").alias("src_type"), F.lit(ALL).alias("src_name"), F.col("b_pred").alias("dst_pred"), F.col("type").alias("dst_type"), F.col("name").alias("dst_name")
        )
    )

