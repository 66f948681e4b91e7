import itertools
import random

import pytest
from pyspark.sql import functions as F

from grantlake.functions.columns import TUPLE, is_identifier
from grantlake.operators import closure as C
from grantlake.operators import invariants as I
from grantlake.operators import members as M
from grantlake.operators import rewrite as R
from grantlake.plans.compile import compile_schema
from grantlake.plans.errors import ClosureFanoutExceeded, InvariantViolation
from grantlake.plans.schema import parse
from grantlake.sources import tables as T
from tests import schemas

EDGE = "src string, dst string"


def pairs(df):
    return sorted(tuple(r) for r in df.select("src", "dst").collect())


def brute_reach(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return sorted(out)


@pytest.mark.parametrize("seed", [2, 7])
def test_counts_under_dependent_batches(spark, seed):
    """Batches whose edges lead into each other, and nodes above each other: as counted anew."""
    rng = random.Random(seed)
    graph = [(f"{a:02}", f"{b:02}", rng.choice([1, 1, 2])) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.5]
    new = set(rng.sample(graph, 8))
    old = [e for e in graph if e not in new]
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src string, dst string, multiplicity long")
    counted = lambda df: {(r["src"], r["dst"]): int(r["paths"]) for r in df.collect()}
    before = C.path_counts(frame(old))
    after = C.add_batch(before, frame(old), frame(new))
    assert counted(after) == brute_counts(graph)
    assert counted(C.remove_batch(after, frame(graph), frame(new))) == brute_counts(old)
    gone = {"02", "03", "06"}
    left = [e for e in graph if not gone & {e[0], e[1]}]
    sides = lambda rows: {n: sum(m for a, b, m in rows if n in (a, b)) for a, b, _ in rows for n in (a, b)}
    references = spark.createDataFrame(sorted(sides(graph).items()), "node string, refcount long")
    counts, kept = C.remove_nodes(after, references, frame(graph), spark.createDataFrame([(n,) for n in sorted(gone)], "node string"))
    assert counted(counts) == brute_counts(left) and {r["node"]: r["refcount"] for r in kept.collect()} == sides(left)
    with pytest.raises(ValueError):
        C.add_batch(before, frame(old), frame([("08", "00", 1), ("00", "08", 1)]))


@pytest.mark.parametrize("seed", [1])
def test_reach_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(16)}
    df = spark.createDataFrame(sorted(edges), EDGE)
    want = brute_reach(edges)
    assert pairs(C.reach(df)) == want
    start, stop = (spark.createDataFrame([(x,) for x in xs], "node string") for xs in ("03", "157"))
    assert pairs(C.reach(df, start, stop)) == [p for p in want if p[0] in "03" and p[1] in "157"]
    assert pairs(C.reach(df, sources=start)) == [p for p in want if p[0] in "03"]
    assert pairs(C.reach(df, targets=stop)) == [p for p in want if p[1] in "157"]


def brute_counts(edges):
    total, now = {}, {}
    for a, b, m in edges:
        now[a, b] = now.get((a, b), 0) + m
    step = dict(now)
    while now:
        for k, v in now.items():
            total[k] = total.get(k, 0) + v
        new = {}
        for (a, b), v in now.items():
            for (c, d), m in step.items():
                if b == c:
                    new[a, d] = new.get((a, d), 0) + v * m
        now = new
    return total


def as_counts(df):
    return {(r["src"], r["dst"]): int(r["paths"]) for r in df.collect()}


def test_path_counts_and_changes(spark):
    rng = random.Random(5)
    edges = [(str(a), str(b), rng.randrange(1, 3)) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.5]
    frame = lambda e: spark.createDataFrame(e, f"{EDGE}, multiplicity long")
    counts = C.path_counts(frame(edges))
    assert as_counts(counts) == brute_counts(edges)
    new = ("3", "9", 1)
    assert as_counts(C.add_edges(counts, spark.createDataFrame([new[:2]], EDGE))) == brute_counts([*edges, new])
    grown = C.path_counts(frame([*edges, new]))
    assert as_counts(C.remove_edges(grown, spark.createDataFrame([new[:2]], EDGE))) == brute_counts(edges)
    ask = spark.createDataFrame([("6", "0"), ("8", "9")], EDGE)
    up, down = sum(d == "6" for _, d in brute_counts(edges)), sum(s == "0" for s, _ in brute_counts(edges))
    assert {r["src"]: r["touched"] for r in C.fanout(counts, ask).collect()} == {"6": up * down + up + down + 1, "8": 1}
    C.check_fanout(counts, ask, 0)
    with pytest.raises(ClosureFanoutExceeded):
        C.check_fanout(counts, ask, 3)
    I.require(I.wrong_counts(counts, frame(edges)), "counts")
    with pytest.raises(InvariantViolation):
        I.require(I.wrong_counts(counts.where(F.col("src") != edges[0][0]), frame(edges)), "counts")


def test_levels_and_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], EDGE)
    level, left = C.levels(df)
    assert {r["node"]: r["level"] for r in level.collect()} == {"a": 0, "b": 1, "c": 2}
    assert pairs(left) == [("x", "y"), ("y", "x")]
    with pytest.raises(ValueError):
        C.path_counts(df.withColumn("multiplicity", F.lit(1)))
    ask = spark.createDataFrame([("c", "a"), ("a", "a"), ("c", "z")], EDGE)
    assert pairs(C.closes_cycle(C.reach(df), ask)) == [("a", "a"), ("c", "a")]
    assert pairs(C.cycles_of(df.union(ask), ask)) == [("a", "a"), ("c", "a")]
    assert {(r["src"], r["dst"]): r["direct"] for r in C.has_edges(df, ask.union(df.limit(1))).collect()} == {("c", "a"): False, ("a", "a"): False, ("c", "z"): False, ("a", "b"): True}
    behind, left = C.levels(df.union(spark.createDataFrame([("y", "z"), ("w", "x")], EDGE)))
    assert {r["node"]: r["level"] for r in behind.collect()} == {"a": 0, "b": 1, "c": 2, "w": 0} and pairs(left) == [("x", "y"), ("y", "x"), ("y", "z")]


def test_closure_invariants_see_damage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], EDGE)
    good = C.reach(edges)
    assert I.missing_steps(good, edges).isEmpty() and I.unsupported_pairs(good, edges).isEmpty()
    assert pairs(I.missing_steps(good.where("src <> 'a' or dst <> 'c'"), edges)) == [("a", "c")]
    assert pairs(I.unsupported_pairs(good.union(spark.createDataFrame([("c", "a")], EDGE)), edges)) == [("c", "a")]
    after = C.reach(edges.where("src = 'a'"))
    assert sorted(map(tuple, C.flips(good, after).collect())) == [("REMOVED", "a", "c"), ("REMOVED", "b", "c")]


def test_what_changes_is_found_in_one_pass(spark):
    """rows of two multisets with their copies, each side read once; a repeated row is told as often as it is there."""
    before, after = (spark.createDataFrame(rows, "a string, b int") for rows in ([("x", 1), ("x", 1), ("x", 1), (None, 2)], [("x", 1), (None, 2), ("y", None), ("y", None)]))
    found = I.changed(before, after)
    assert sorted(map(tuple, found.collect()), key=str) == [("x", 1), ("x", 1), ("y", None), ("y", None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    edges = spark.createDataFrame([("a", "b")], EDGE)
    twice = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "a")], EDGE)
    assert pairs(I.unsupported_pairs(twice, edges)) == [("b", "a"), ("b", "a")]


ROW = "o string, kind string, s_pred string, s_type string, s_name string"


def random_set(rng, o):
    """A canonical set over two shapes of three members, and its extension."""
    rows, members, stars = [], set(), set()
    for shape in ("user", "bot"):
        star = rng.random() < 0.5
        stars |= {(o, shape)} if star else set()
        rows += [(o, "star", "...", shape, "*")] if star else []
        for n in "abc":
            odd = rng.random() < 0.4
            rows += [(o, "neg" if star else "pos", "...", shape, n)] if odd else []
            members |= {(o, shape, n)} if star != odd else set()
    return rows, members, stars


def test_member_algebra(spark):
    """Twelve pairs of sets at once, each under its own key."""
    rng = random.Random(4)
    people = spark.createDataFrame([("...", t, n) for t in ("user", "bot") for n in "abc"], "s_pred string, s_type string, s_name string")
    a, b = ([sum(x, []) if k == 0 else set().union(*x) for k, x in enumerate(zip(*(random_set(rng, f"o{i}") for i in range(12)), strict=True))] for _ in range(2))
    (a, am, astars), (b, bm, bstars) = a, b
    x, y = spark.createDataFrame(a, ROW), spark.createDataFrame(b, ROW)
    for op, want, stars in ((M.union, am | bm, astars | bstars), (M.intersect, am & bm, astars & bstars), (M.subtract, am - bm, astars - bstars)):
        got = op(x, y, ["o"]).cache()
        assert {(r["o"], r["s_type"], r["s_name"]) for r in M.materialize(got, people, ["o"]).collect()} == want
        assert {r["o"]: r["n"] for r in M.count_members(got, people, ["o"]).collect()} == {o: sum(w[0] == o for w in want) for o in {w[0] for w in want}}
        assert {(r["o"], r["s_type"]) for r in got.where("kind = 'star'").collect()} == stars
        model = got.select(F.lit("r").alias("o_pred"), F.lit("t").alias("o_type"), F.col("o").alias("o_name"), "kind", "s_pred", "s_type", "s_name")
        assert I.uncanonical(model).isEmpty()


def test_sources_count_and_do_not_mask(spark):
    """One source's exception does not cancel another's star."""
    rows = [("o", 0, "p1", "star", "...", "user", "*"), ("o", 0, "p1", "neg", "...", "user", "a"), ("o", 0, "p2", "star", "...", "user", "*")]
    df = spark.createDataFrame(rows, "o string, leaf int, source string, kind string, s_pred string, s_type string, s_name string")
    assert [tuple(r) for r in M.combine(df, ["o"], 1, lambda t: t[0]).collect()] == [("o", "star", "...", "user", "*")]


def test_admission(spark):
    c = compile_schema(parse(schemas.MINE, {("shaft", "enters")}))
    rows = [("...", "person", "a", "assayer", "seam", "d"), ("...", "person", "*", "enters", "shaft", "f"), ("...", "person", "*", "assayer", "seam", "d"), ("...", "person", "a\n", "assayer", "seam", "d"), ("sworn", "guild", "a", "enters", "shaft", "*"), ("...", "person", "a", "assayer", "seam", "*"), ("...", "person", "a", "nothing", "seam", "d"), (None, "person", "a", "assayer", "seam", "d")]
    got = R.reject_reasons(spark.createDataFrame(rows, ", ".join(f"{x} string" for x in TUPLE)), c).collect()
    assert {tuple(r[:6]): r["reject_reason"] for r in got} == dict(zip(rows, [None, None, "restriction", "identifier", None, "object_wildcard", "restriction", "identifier"], strict=True))


def test_identifier_has_no_line_end(spark):
    df = spark.createDataFrame([("alice", True), ("alice\n", False), ("a" * 256, True), ("a" * 257, False), ("", False), ("a b", False)], "x string, ok boolean")
    assert df.where(is_identifier(F.col("x")) != F.col("ok")).isEmpty()


def test_removed_nodes_with_many_below_are_dealt_out(spark, monkeypatch):
    """what is below a node is dealt over several keys, however few the nodes are that go; counts stay right."""
    monkeypatch.setattr(C, "DEALT", 10)
    graph = [("r", f"n{k}", 1) for k in range(2)] + [(f"n{k % 2}", f"c{k}", 1 + k % 2) for k in range(60)] + [("w", "r", 2), ("w", "n1", 1)]
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string, multiplicity long")
    counted = lambda df: {(r["src"], r["dst"]): int(r["paths"]) for r in df.collect()}
    counts = C.path_counts(frame(graph))
    below = C._below(counts, C._heavy(counts)).where("node in ('r', 'n0', 'n1')").groupBy("node").agg(F.countDistinct("slot").alias("slots"), F.count("*").alias("n")).collect()
    assert {r["node"]: r["n"] for r in below} == {"r": 62, "n0": 30, "n1": 30} and all(r["slots"] > 1 for r in below)
    references = spark.createDataFrame([(n, sum(m for s, d, m in graph if n in (s, d))) for n in {x for e in graph for x in e[:2]}], "node string, refcount long")
    left, kept = C.remove_nodes(counts, references, frame(graph), spark.createDataFrame([("n0",), ("r",)], "node string"))
    rest = [e for e in graph if not {"n0", "r"} & set(e[:2])]
    assert counted(left) == brute_counts(rest)
    assert {r["node"] for r in kept.collect()} == {x for e in rest for x in e[:2]}
    new = [("g", "w", 1), ("w", "c0", 3)]
    assert counted(C.add_batch(counts, frame(graph), frame(new))) == brute_counts(graph + new)
    assert counted(C.remove_batch(C.path_counts(frame(graph + new)), frame(graph + new), frame(new))) == brute_counts(graph)


def test_rounds_end_with_the_last_edge_that_goes_on(spark, monkeypatch):
    """F20 F22: no round is run to see that leaves lead nowhere, and ranks for a batch read what is above it alone."""
    graph = [("a", "b"), ("b", "c"), *(("c", f"d{k}") for k in range(9))]
    edges = spark.createDataFrame(graph, "src string, dst string")
    rounds, once = [], C.cut_counting
    monkeypatch.setattr(C, "cut_counting", lambda df, **m: rounds.append(1) or once(df, **m))
    assert C.reach(edges).count() == 2 * (1 + 9) + 1 + 9
    assert len(rounds) == 2
    assert C.path_counts(edges.withColumn("multiplicity", F.lit(1))).count() == 2 * (1 + 9) + 1 + 9
    assert len(rounds) == 2 + 3
    ranked, levels = [], C.levels
    monkeypatch.setattr(C, "levels", lambda df: ranked.append(df.count()) or levels(df))
    assert [[r["node"] for r in part.collect()] for part in C._in_order(edges, spark.createDataFrame([("c",), ("a",)], "node string"), "node")] == [["a"], ["c"]]
    assert ranked == [2]


def test_levels_with_leaves_of_cycles(spark):
    """Edges into nodes that nothing leaves follow their tails: left over behind a cycle, else one level above the highest."""
    graph = [("a", "b"), ("b", "x"), ("a", "x"), ("l", "l"), ("l", "x2"), ("p", "q"), ("q", "p"), ("q", "m"), ("m", "x3"), ("a", "x4"), ("m", "x4")]
    rank, left = C.levels(spark.createDataFrame(graph, "src string, dst string"))
    assert {tuple(r) for r in rank.collect()} == {("a", 0), ("b", 1), ("x", 2)}
    assert {tuple(r) for r in left.collect()} == {("l", "l"), ("l", "x2"), ("p", "q"), ("q", "p"), ("q", "m"), ("m", "x3"), ("m", "x4")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_log_is_folded_without_sorting_it(spark):
    """F23 F24: the log is hashed down to the last id of each kind of operation, however long the history; the later wins."""
    rows = [(k, "main", "ADD" if k % 3 else "REMOVE", "...", "user", f"u{k % 4}", "member", "group", "g", 0.0) for k in range(1, 42)]
    last = T.last_ops(spark.createDataFrame(rows, T.LOG))
    assert {(r["subject_name"], r["op"], r["log_id"]) for r in last.collect()} == {("u1", "ADD", 41), ("u0", "ADD", 40), ("u3", "REMOVE", 39), ("u2", "ADD", 38)}
    assert "HashAggregate(keys=[store_id" in _plan(last)


def test_drift_is_one_hashed_pass(spark):
    """what a reader of the outbox holds is set beside the closure in one aggregate, and nothing is sorted for it."""
    outbox = [(1, "ADDED", "a", "b"), (2, "REMOVED", "a", "b"), (3, "ADDED", "a", "c"), (4, "REMOVED", "x", "y"), (5, "ADDED", "x", "y"), (6, "ADDED", "p", "q")]
    drift = I.outbox_drift(spark.createDataFrame(outbox, "id long, action string, src string, dst string"), spark.createDataFrame([("a", "b"), ("x", "y"), ("m", "n")], "src string, dst string"))
    plan = _plan(drift)
    assert sorted(map(tuple, drift.collect())) == [("ADDED", "a", "b"), ("ADDED", "m", "n"), ("REMOVED", "a", "c"), ("REMOVED", "p", "q")]
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
