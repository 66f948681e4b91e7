"""Reachability over edges (src, dst): closures, path counts, order, and changes.

Loops are semi-naive: a round joins only what the round before found, and each round's
result is written to the shared folder, so lineage stays short and a lost
executor costs one round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.plans.errors import ClosureFanoutExceeded
from grantlake.sources.storage import cut, cut_counting, cut_or_empty

COUNT = "decimal(38,0)"
#: A node with more pairs below it than this is dealt over several keys, so many pairs to each.
DEALT = 100_000


def keyed(edges: DataFrame) -> DataFrame:
    """Edges of three-part nodes as (src, dst) strings ``pred|type|name``; '|' is in no identifier."""
    return edges.select(F.concat_ws("|", "src_pred", "src_type", "src_name").alias("src"), F.concat_ws("|", "dst_pred", "dst_type", "dst_name").alias("dst"))


def unkeyed(pairs: DataFrame) -> DataFrame:
    part = lambda c, i: F.split_part(F.col(c), F.lit("|"), F.lit(i))
    return pairs.select(*(part(c, i).alias(f"{c}_{n}") for c in ("src", "dst") for i, n in ((1, "pred"), (2, "type"), (3, "name"))))


def _node(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name)).distinct()


def _going_on(steps: DataFrame, at: str = "dst") -> DataFrame:
    """``steps`` with ``on``: does an edge leave ``dst`` (or, with ``src``, enter it)? A path that ends elsewhere is never
    extended, and where the last such edges were met no further round is run to see it."""
    other = "src" if at == "dst" else "dst"
    return steps.join(steps.select(F.col(other).alias(at), F.lit(True).alias("on")).distinct(), at, "left").select(*steps.columns, F.coalesce("on", F.lit(False)).alias("on"))


def _heavy(counts: DataFrame) -> DataFrame:
    """(node, parts): nodes with more than DEALT rows below them; one row at most for so many rows."""
    return cut(counts.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > DEALT).select("node", F.ceil(F.col("n") / DEALT).cast("int").alias("parts")))


def _below(counts: DataFrame, heavy: DataFrame) -> DataFrame:
    """(node, b, pb, slot): what is below each node, that of heavy ones dealt over its slots."""
    rows = counts.select(F.col("src").alias("node"), F.col("dst").alias("b"), F.col("paths").alias("pb")).join(heavy, "node", "left")
    return rows.select("node", "b", "pb", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("slot"))


def _in_slots(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` (node, ...) once for each slot of the node."""
    return rows.join(heavy, "node", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def ancestors(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): ``nodes`` and all that reach them. Only nodes are kept, not pairs."""
    found = [cut(_node(nodes, "node"))]
    while True:
        before = steps.join(found[-1].withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        new = cut_or_empty(before.join(reduce(DataFrame.union, found), "node", "left_anti"))
        if new is None:
            return reduce(DataFrame.union, found)
        found.append(new)


def reach(edges: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(src, dst) of all pairs joined by a path of one edge or more. ``sources`` (node)
    keeps the search to paths that start there, ``targets`` to paths that end there; with both,
    it goes forward over the edges that lead to a target. Cycles are safe; a node on one is
    listed with itself."""
    steps = edges.select("src", "dst").distinct()
    forward = targets is None or sources is not None
    if targets is not None and forward:
        steps = cut(steps)
        steps = cut(steps.join(ancestors(steps, targets).withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    steps = cut(_going_on(steps, "dst" if forward else "src"))
    first = steps
    if sources is not None:
        first = steps.join(_node(sources, "src"), "src", "left_semi").select("src", "dst", "on")
    elif targets is not None:
        first = steps.join(_node(targets, "dst"), "dst", "left_semi").select("src", "dst", "on")
    found = [first if first is steps else cut(first)]
    while True:
        last = found[-1].where("on").drop("on")
        if forward:
            new = last.join(steps.toDF("dst", "next", "on"), "dst").select("src", F.col("next").alias("dst"), "on")
        else:
            new = last.join(steps.toDF("before", "src", "on"), "src").select(F.col("before").alias("src"), "dst", "on")
        new, seen = cut_counting(new.distinct().join(reduce(DataFrame.union, found), ["src", "dst"], "left_anti"), n=F.count(F.lit(1)), on=F.count_if("on"))
        if seen["n"]:
            found.append(new)
        if not seen["on"]:
            break
    found = [part.select("src", "dst") for part in found]
    out = reduce(DataFrame.union, found)
    return out.join(_node(targets, "dst"), "dst", "left_semi").select("src", "dst") if targets is not None and forward else out


def levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, level), edges left over): the longest path from a node without
    incoming edges; edges are left over exactly where there is a cycle.

    Each round marks the edges whose tail no edge that is left enters; the tail is on that
    round's level, and a node that nothing leaves is one above the last edge into it. Edges into such nodes let
    nothing go, so they take no part in the rounds and follow their tails."""
    steps = cut(_going_on(edges.select("src", "dst").distinct()))
    left, outer, done, level = steps.where("on").select("src", "dst"), steps.where("not on").select("src", "dst"), [], 0
    while True:
        entered = left.select(F.col("dst").alias("src"), F.lit(True).alias("stays")).distinct()
        marked, seen = cut_counting(left.join(entered, "src", "left").select("src", "dst", F.coalesce("stays", F.lit(False)).alias("stays")), gone=F.count_if(~F.col("stays")), kept=F.count_if("stays"))
        left = marked.where("stays").select("src", "dst")
        if seen["gone"]:
            done.append(marked.where("not stays").select("src", "dst", F.lit(level).alias("level")))
        if not seen["gone"] or not seen["kept"]:
            break
        level += 1
    gone = reduce(DataFrame.union, done) if done else left.limit(0).withColumn("level", F.lit(0))
    left = cut(left)  # mostly nothing, which a join then need not deal
    ends = gone.select(F.col("dst").alias("node"), (F.col("level") + 1).alias("level")).union(gone.select("src", "level"))
    entered = left.select(F.col("dst").alias("src")).distinct()
    rank = ends.groupBy(F.col("node").alias("src")).agg(F.max("level").alias("level"))
    late = outer.join(entered, "src", "left_anti").join(rank, "src", "left").select("src", "dst", F.coalesce("level", F.lit(0)).alias("level"))
    ends = ends.union(late.select("dst", F.col("level") + 1)).union(late.select("src", "level"))
    left = left.union(outer.join(entered, "src", "left_semi").select("src", "dst"))
    # nodes that an edge left over touches are on a cycle, or behind one
    looped = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.groupBy("node").agg(F.max("level").alias("level")).join(looped, "node", "left_anti"), left


def path_counts(edges: DataFrame) -> DataFrame:
    """(src, dst, paths): how many paths join two nodes of an acyclic multigraph
    (src, dst, multiplicity). A cycle shows as a path from a node to itself and is refused."""
    seen = {"on": F.count_if("on"), "loops": F.count_if(F.col("src") == F.col("dst"))}
    step, now = cut_counting(_going_on(edges.select("src", "dst", F.col("multiplicity").cast(COUNT).alias("paths"))), **seen)
    found = [step]
    while not now["loops"]:
        if not now["on"]:
            return reduce(DataFrame.union, found).groupBy("src", "dst").agg(F.sum("paths").cast(COUNT).alias("paths"))
        new = found[-1].where("on").drop("on").join(step.toDF("dst", "next", "m", "on"), "dst").groupBy("src", F.col("next").alias("dst")).agg(F.sum((F.col("paths") * F.col("m")).cast(COUNT)).cast(COUNT).alias("paths"), F.bool_or("on").alias("on"))
        new, now = cut_counting(new, **seen)
        found.append(new)
    raise ValueError("path counts need an acyclic graph")


def has_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (src, dst) with ``direct``: is there such an edge?"""
    there = edges.select("src", "dst").distinct().withColumn("direct", F.lit(True))
    return asked.join(there, ["src", "dst"], "left").withColumn("direct", F.coalesce("direct", F.lit(False)))


def cycles_of(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Those of ``new`` that lie on a cycle of ``edges`` (which holds them): a search from
    their heads alone, as every new cycle passes a new edge."""
    return closes_cycle(reach(edges, sources=new.select(F.col("dst").alias("node"))), new)


def edge_effect(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, paths) that each of ``edges`` (src, dst) carries from what reaches its
    tail to what its head reaches, ends included. Ancestors meet descendants by
    edge, an equi-join, so nothing else is paired. An edge with a ``multiplicity`` stands for as many."""
    many = F.col("multiplicity") if "multiplicity" in edges.columns else F.lit(1)
    e = cut(edges.groupBy("src", "dst").agg(F.max(many).cast(COUNT).alias("m")).withColumn("edge", F.concat_ws(">", "src", "dst")))
    one, heavy = F.lit(1).cast(COUNT), _heavy(counts)
    above = counts.join(cut(e.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").join(e.select(F.col("src").alias("dst"), F.col("dst").alias("node"), "edge", "m"), "dst").select("edge", "node", F.col("src").alias("a"), (F.col("paths") * F.col("m")).cast(COUNT).alias("pa"))
    above = _in_slots(above.union(e.select("edge", F.col("dst").alias("node"), F.col("src").alias("a"), F.col("m").alias("pa"))), heavy).drop("node")
    heads = _in_slots(e.select(F.col("dst").alias("node"), "edge"), heavy)
    below = _below(counts, heavy).join(heads, ["node", "slot"]).select("edge", "slot", "b", "pb")
    below = below.union(e.select("edge", F.lit(0).alias("slot"), F.col("dst").alias("b"), one.alias("pb")))
    return above.join(below, ["edge", "slot"]).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum((F.col("pa") * F.col("pb")).cast(COUNT)).cast(COUNT).alias("paths"))


def fanout(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with ``touched``: the closure rows that each touches at most as a new edge, from what
    reaches its tail to what its head reaches."""
    up = closure.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("up"))
    down = closure.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("down"))
    up_, down_ = F.coalesce("up", F.lit(0)), F.coalesce("down", F.lit(0))
    return edges.join(up, "src", "left").join(down, "dst", "left").select("src", "dst", (up_ * down_ + up_ + down_ + 1).alias("touched"))


def check_fanout(closure: DataFrame, edges: DataFrame, limit: int) -> None:
    """Refuse new edges of which one touches more closure rows than ``limit`` (0: no limit)."""
    worst = fanout(closure, edges).where(F.col("touched") > limit).first() if limit else None
    if worst is not None:
        raise ClosureFanoutExceeded(f"{worst['src']} -> {worst['dst']} touches {worst['touched']} rows, more than {limit}")


def add_edges(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Path counts after independent new edges (none reaches another's tail)."""
    return counts.unionByName(edge_effect(counts, edges)).groupBy("src", "dst").agg(F.sum("paths").cast(COUNT).alias("paths"))


def remove_edges(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Path counts without independent edges; pairs without a path go. In an acyclic
    graph no path to an edge's tail uses that edge, so its effect is that of adding it."""
    effect = edge_effect(counts, edges).withColumn("paths", -F.col("paths"))
    return counts.unionByName(effect).groupBy("src", "dst").agg(F.sum("paths").cast(COUNT).alias("paths")).where("paths > 0")


def _in_order(edges: DataFrame, of: DataFrame, node: str) -> list[DataFrame]:
    """``of`` in groups by the level of its column ``node`` in an acyclic graph, lowest first. A node of a
    level reaches none of the same level, so what stands in one group is independent. A level depends on what is above a node
    alone, and so does a cycle through it: no other edges are ranked."""
    above = ancestors(edges, of.select(F.col(node).alias("node")))
    rank, looped = levels(edges.join(above.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    if not looped.isEmpty():
        raise ValueError("path counts need an acyclic graph")
    # a node that no edge enters has level 0
    placed = cut(of.join(rank.withColumnRenamed("node", "__node"), F.col(node) == F.col("__node"), "left").drop("__node").fillna(0, ["level"]))
    steps = sorted(r["level"] for r in placed.select("level").distinct().collect())  # as many as the graph is deep
    return [placed.where(F.col("level") == k).drop("level") for k in steps]


def _sum(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("src", "dst").agg(F.sum("paths").cast(COUNT).alias("paths"))


def add_batch(counts: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Path counts of ``edges`` after new edges that may depend on each other (all: src, dst, multiplicity). Edges
    are added by the level of their tails: a path is counted once, when the last of its new edges is. What each level
    adds is written, and all are summed in the end."""
    every, parts = edges.select("src", "dst").union(new.select("src", "dst")), [cut(counts.select("src", "dst", "paths"))]
    for part in _in_order(every, new.groupBy("src", "dst").agg(F.sum("multiplicity").alias("multiplicity")), "src"):
        parts.append(cut(edge_effect(reduce(DataFrame.unionByName, parts), part)))
    return _sum(parts)


def remove_batch(counts: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Path counts of ``edges`` without some that may depend on each other: a path goes once, with the first of them."""
    parts = [cut(counts.select("src", "dst", "paths"))]
    for part in _in_order(edges, gone.groupBy("src", "dst").agg(F.sum("multiplicity").alias("multiplicity")), "src"):
        parts.append(cut(edge_effect(reduce(DataFrame.unionByName, parts), part).withColumn("paths", -F.col("paths"))))
    return _sum(parts).where("paths > 0")


def remove_nodes(counts: DataFrame, references: DataFrame, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path counts, (node, refcount)) after ``nodes`` (node) go with all their edges (src, dst, multiplicity). What
    runs through a node is what reaches it times what it reaches; nodes of a level at a time, as no path
    holds two of these. A neighbour loses a reference for each edge, and goes with its last one."""
    parts, gone = [cut(counts.select("src", "dst", "paths"))], []
    for part in map(cut, _in_order(edges, nodes.select("node").distinct(), "node")):
        now = reduce(DataFrame.unionByName, parts)
        heavy = _heavy(now.join(part.withColumnRenamed("node", "src"), "src", "left_semi"))
        into = now.join(part.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("a"), F.col("paths").alias("pa"))
        for before in gone:  # on lower levels; nothing of these is below this one
            into = into.join(before.withColumnRenamed("node", "a"), "a", "left_anti")
        out = _below(now.join(part.withColumnRenamed("node", "src"), "src", "left_semi"), heavy)
        through = _in_slots(into.select("node", "a", "pa"), heavy).join(out, ["node", "slot"]).groupBy(F.col("a").alias("src"), F.col("b").alias("dst"))
        parts.append(cut(through.agg(F.sum((F.col("pa") * F.col("pb")).cast(COUNT)).cast(COUNT).alias("paths")).withColumn("paths", -F.col("paths"))))
        gone.append(part)
    every = cut(nodes.select("node").distinct())
    for end in ("src", "dst"):
        parts = [x.join(every.withColumnRenamed("node", end), end, "left_anti").select("src", "dst", "paths") for x in parts]
    counts = _sum(parts).where("paths > 0")
    ends = [F.struct(F.col(a).alias("node"), F.col(b).alias("other")) for a, b in (("src", "dst"), ("dst", "src"))]
    sides = edges.select(F.explode(F.array(*ends)).alias("e"), "multiplicity").select("e.*", "multiplicity")
    lost = sides.join(nodes.select(F.col("node").alias("other")).distinct(), "other", "left_semi").groupBy("node").agg(F.sum("multiplicity").alias("lost"))
    kept = references.join(nodes, "node", "left_anti").join(lost, "node", "left").select("node", (F.col("refcount") - F.coalesce("lost", F.lit(0))).cast("long").alias("refcount"))
    return counts, kept.where("refcount > 0")


def remove_node(edges: DataFrame, node: str) -> DataFrame:
    """Edges without those at a node."""
    return edges.where((F.col("src") != node) & (F.col("dst") != node))


def closes_cycle(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of ``edges`` that would close a cycle: loops, or a head that reaches the tail."""
    back = closure.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(True).alias("__back"))
    return edges.join(back, ["src", "dst"], "left").where("__back or src = dst").drop("__back")


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(action, src, dst): pairs that became reachable, or no longer are."""
    of = lambda rows, old: rows.select("src", "dst", F.lit(old).alias("old"), F.lit(not old).alias("new"))
    both = of(before, True).union(of(after, False)).groupBy("src", "dst").agg(F.bool_or("old").alias("old"), F.bool_or("new").alias("new"))
    return both.where("old <> new").select(F.when(F.col("new"), "ADDED").otherwise("REMOVED").alias("action"), "src", "dst")
