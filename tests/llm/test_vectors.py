"""Exact search and hard negatives against exhaustive search, and the divergence of sources against plain counting."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grantlake.llm import divergence, negatives, topk
from grantlake.llm import vectors as V

ROWS = "vec_id long, embedding array<double>, label int, rank string, score string"


def _whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(x * 256) for x in v]


def _dot(a, b):
    return max(-V.LIMIT, min(V.LIMIT, sum(x * y for x, y in zip(a, b))))


def fixture():
    """Clustered vectors, copies in numbers, ties, odd rows, repeated ids, short and huge vectors."""
    rng, rows = random.Random(3), []
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    for i in range(0, 420):
        m = rng.choice(middles)
        rows.append((i, [x + rng.gauss(0, 0.2) for x in m], i % 3))
    rows += [(1000 + i, list(middles[0]), i % 2) for i in range(150)]  # one vector many times
    rows += [(2000, [0.0] * 6, 0), (2100, [], 1), (2200, [1.0, 2.0], 2), (2300, None, 1), (2400, [1.0, None], 1), (2500, [float("nan")] * 6, 0), (2600, [float("inf")] * 6, 0), (2700, middles[1], None), (None, middles[1], 1)]
    rows += [(300, middles[2], 1), (300, middles[2], 1), (7, middles[3], 2)]  # ids that stand in several rows
    return [(*r, "x", "y") for r in rows]


def usable(rows):
    return [(i, w, y) for i, v, y, *_ in rows if i is not None and (w := _whole(v)) is not None]


def brute_top(rows, every, k):
    out = []
    for i, v, _ in usable(rows):
        if i % every == 0:
            best = sorted(((-_dot(v, w), j) for j, w, _ in usable(rows) if j != i))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4 << 20, 400])  # 400 bytes: a few queries a block
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_BYTES", block)
    rows = fixture()
    got = topk.search(spark.createDataFrame(rows, ROWS).repartition(5), F.col("id") % (50 if block > 400 else 300) == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 50 if block > 400 else 300, 5)


def test_topk_of_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0], 0, "", ""), (50, [-1.0], 0, "", ""), (51, None, 0, "", "")], ROWS)
    assert sorted(map(tuple, topk.search(two, F.col("id") % 50 == 0).collect())) == [(0, 1, 50, -65536), (50, 1, 0, -65536)]
    assert topk.search(two.where("vec_id = 51"), F.col("id") % 50 == 0).collect() == []
    assert topk.search(two.limit(0), F.col("id") % 50 == 0).collect() == []


def test_scores_stay_exact(spark):
    """Beyond 2**53, where doubles have gaps, and beyond 64 bits, where scores stop at the limit."""
    rows = [(0, [2.0**22 + 1, 1 / 256], 0, "", ""), (1, [2.0**23, 3 / 256], 0, "", ""), (2, [2.0**23, 2 / 256], 0, "", ""), (3, [1e300, 0.0], 0, "", ""), (4, [-1e300, 0.0], 0, "", ""), (5, [1e305, 1e308], 0, "", "")]
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, ROWS), F.col("id") == 0).collect()))
    whole = (2**30 + 256) * 2**31
    assert got == [(0, 1, 3, V.LIMIT), (0, 2, 5, V.LIMIT), (0, 3, 1, whole + 3), (0, 4, 2, whole + 2), (0, 5, 4, -V.LIMIT)]
    assert V.products(np.array([[2.0**31, 1.0]]), np.array([[2.0**31, 1.0]]))[0, 0] == 2**62 - 1  # cut off


def brute_mine(rows, every, k=5):
    rows, out = usable([r for r in rows if r[2] is not None]), []
    for i, v, y in rows:
        if i % every:
            continue
        scored = [(-_dot(v, w), j, z) for j, w, z in rows if j != i]
        for p, j in sorted((s, j) for s, j, z in scored if z == y)[:k]:
            near = sorted((s, j) for s, j, z in scored if z != y and 80 * -p <= 100 * -s <= 100 * -p)[:k]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("lists,bounds", [(1, 4 << 20), (12, 4 << 20), (40, 400)])
def test_negatives(spark, monkeypatch, lists, bounds):
    """Whatever the number of lists and the size of the blocks, the answers are the exhaustive ones."""
    monkeypatch.setattr(negatives, "BOUNDS", bounds)
    rows = fixture()
    every = 20 if bounds > 400 else 100
    got = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, ROWS).repartition(5), F.col("id") % every == 0, lists=lists).collect()))
    assert got == brute_mine(rows, every) and len(got) > 50


def test_negatives_leave_lists_unvisited(spark, monkeypatch):
    """In well-parted clusters a list whose bounds lie outside the window is not read."""
    rng, rows = random.Random(5), []
    for i in range(300):
        middle = [10.0 if k == i % 6 else 0.0 for k in range(6)]
        rows.append((i, [x + rng.gauss(0, 0.1) for x in middle], i // 6 % 2, "", ""))
    seen, visit = [], negatives._visit
    monkeypatch.setattr(negatives, "_visit", lambda block, width, visits, *a: (seen.append(visits.value[0].mean()), visit(block, width, visits, *a))[1])
    got = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, ROWS), F.col("id") % 50 == 0, lists=6).collect()))
    assert got == brute_mine(rows, 50) and got
    assert len(seen) == 2 and seen[0] <= negatives.FIRST / 6 and seen[1] < 0.2  # one round each: the first, and the windows' own lists


def test_negatives_of_none(spark):
    frame = spark.createDataFrame(fixture(), ROWS)
    for rows in (frame.limit(0), frame.where("embedding is null"), frame.where("vec_id = 0"), frame.withColumn("label", F.lit(None).cast("int"))):
        assert negatives.mine(rows, F.col("id") % 20 == 0).collect() == []


def brute_audit(docs, least, top):
    docs = [(t or "", a or "", s or "") for t, a, s, *_ in docs]
    words = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))), a, s) for t, a, s in docs]
    seen, of_lang, of_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for w, a, s in words:
        seen[a].update(w.keys())
        of_lang[a].update(w)
        of_group[a, s].update(w)
    out = []
    for a, s in of_group:
        kept = sorted(t for t, n in seen[a].items() if n >= least)
        size = lambda c: sum(c[t] for t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (size(c) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        mine, mean = of_group[a, s], of_lang[a]
        pairs = [(-sum(f(share(mine, t), share(of_group[b, o], t)) for t in kept), o) for b, o in of_group if b == a and o != s]
        terms = [(-f(share(mine, t), share(mean, t)), t) for t in kept if mine[t] and share(mine, t) > share(mean, t)]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(a, s, part, item, -v, r) for r, (v, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("terms,groups,held,long", [(512, 32, 400_000, 8 << 20), (4, 2, 5, 40)])
def test_divergence(spark, monkeypatch, terms, groups, held, long):
    """With tiles, buffers and pieces of any size the figures are those of plain counting."""
    for name, value in (("TILE_TERMS", terms), ("TILE_GROUPS", groups), ("HELD", held), ("LONG_TEXT", long)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence, "ship", lambda spark: None)  # workers take this process's values along
    rng = random.Random(9)
    vocabulary = ["tee", "Kaffee", "été", "Ölwerk", "ÖLwerk", "z9z", "naïve", "日本", "a-b"] + [f"w{'x' * (i % 7)}{chr(97 + i)}" for i in range(20)]
    docs = [(" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30]))), lang, f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}", "c") for lang in ("en", "en", "de") for _ in range(25)]
    docs += [(None, "en", "s9", "c"), ("tee " * 50, None, None, "c"), ("", None, "only", "c"), ("tee", "xx", "alone", "c"), ("tee", "xx", "alone", "c")]
    frame = spark.createDataFrame(docs, "text string, lang string, source string, value string").repartition(3)
    count = divergence._count
    code = {"TILE_GROUPS": groups, "HELD": held, "LONG_TEXT": long}

    def here(batches):
        for name, value in code.items():
            setattr(divergence, name, value)
        yield from count(batches)

    monkeypatch.setattr(divergence, "_count", here)
    tile = divergence._tile

    def tile_here(top):
        run = tile(top)

        def inner(key, cells, rows):
            for name, value in code.items():
                setattr(divergence, name, value)
            return run(key, cells, rows)

        return inner

    monkeypatch.setattr(divergence, "_tile", tile_here)
    got = divergence.audit(frame, least_docs=4, top=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, 4, 3)
    assert divergence.audit(frame.limit(0)).collect() == []


def test_shares_of_large_counts():
    count, total = np.array([3, 10**14 + 7, 9 * 10**14]), np.array([7 * 10**14, 10**15 + 9, 9 * 10**14])
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]


def test_parse_of_sliced_and_null_lists():
    column = pa.array([[9.0], [1.0, 2.0], None, [3.0, None], [], [0.5, float("inf")], [-0.001, 4.0]], pa.list_(pa.float32()))
    part, values, sizes = V.parse(column.slice(1))
    assert part.tolist() == [True, False, False, True, False, True] and sizes.tolist() == [2, 0, 2]
    assert V.matrix(values, sizes, 3).tolist() == [[256, 512, 0], [0, 0, 0], [-1, 1024, 0]]
