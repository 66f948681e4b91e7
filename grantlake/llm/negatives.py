"""Hard-negative mining over k-means inverted lists.

The index: centroids from k-means (Spark ML) over at most about ``SAMPLE`` rows, drawn by hash; every row then
goes into the list of its nearest centroid, and each list keeps its radius, the greatest distance of
its rows from the centroid. By Cauchy-Schwarz no row of a list scores more with an anchor than
anchor . centroid + |anchor| * radius, nor less than the same with a minus.

An anchor visits lists by that upper bound, a few first and then four times as many each round.
It leaves out lists whose bounds lie outside the window of scores that it looks for, and stops
when the bound falls strictly below its k-th score; what a round leaves unvisited is not scored, and
lists that no anchor visits are filtered at the scan. So the answers are those of an exhaustive search,
whatever the clusters; only the work depends on them. First come each anchor's positives, the best rows of its own label, then for each
positive the best rows of another label that score from ``window[0]`` to ``window[1]`` per cent of the positive.

Lists may be of any size (one may hold a third of all rows): the index is a table in ranges of (list, id),
so a large list lies in several files and is scored slice by slice. Anchors are taken in blocks of bounded size.

Defined cases: rows with a null label, and what ``vectors`` leaves out, take no part; an
anchor's own row is every row with its id; an id in several rows counts by each of them; a positive of
negative score has no negatives (its window is empty); an anchor without positives or negatives returns no
row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlake.llm import vectors as V
from grantlake.llm._shared import Scratch, ship, slices

#: Rows that the centroids are learned from, at most about; and bytes of them, and of the centroids.
SAMPLE, SAMPLE_BYTES, CENTROID_BYTES = 20_000, 32 << 20, 8 << 20
#: About one list for this many rows, 1024 lists at most, as every anchor looks at each centroid.
ROWS_A_LIST, MOST_LISTS, ROUNDS = 800, 1024, 8
#: Lists that an anchor visits in the first round, and how many times more in each later one.
FIRST, GROWTH = 4, 4
#: Bounds of lists for positives of anchors, kept at once.
BOUNDS = 4 << 20
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_NONE = -V.LIMIT - 1


def centroids(rows: DataFrame, n: int, width: int, lists: int | None = None) -> np.ndarray:
    """(lists, width): k-means over rows (id, vector, ...) whose hash falls in the sample's share."""
    k = lists or int(np.clip(n // ROWS_A_LIST, 1, min(MOST_LISTS, max(1, CENTROID_BYTES // (8 * max(1, width))))))
    share = min(SAMPLE, SAMPLE_BYTES // (8 * max(1, width))) / max(1, n)
    drawn = F.shiftrightunsigned(F.xxhash64("id", "vector"), 11) / F.lit(float(1 << 53))
    numbers = V.whole(rows.where(drawn < F.lit(share)).select("id", "vector"), width).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(list(V.unpack(b.column(1), width)), pa.list_(pa.float64()))], ["v"]) for b in batches), "v array<double>")
    sample = numbers.select(array_to_vector("v").alias("features")).cache()
    try:
        if k < 2 or not width or sample.count() < k:
            return np.zeros((1, width))
        model = KMeans(k=k, maxIter=ROUNDS, seed=1, initMode="random").fit(sample)
    finally:
        sample.unpersist()
    return np.array(model.clusterCenters())


def build(scratch: Scratch, rows: DataFrame, centers: np.ndarray, width: int) -> tuple[DataFrame, np.ndarray]:
    """The index (list, id, label, vector, distance) of all rows, and each list's radius."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        centers = shared.value
        half = (centers * centers).sum(1) / 2
        for batch in batches:
            x = V.unpack(batch.column(1), width)
            near = (x @ centers.T - half).argmax(1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - centers[near]) ** 2).sum(1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0), batch.column(2), batch.column(1), pa.array(away)], ["list", "id", "label", "vector", "away"])

    placed = V.whole(rows, width).mapInArrow(run, "list int, id long, label long, vector binary, away double")
    index = scratch.write(placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id"), "index")
    radius = np.full(len(centers), -1.0)  # of a list without rows
    for r in index.groupBy("list").agg(F.max("away").alias("r")).collect():  # one number a list
        radius[r["list"]] = r["r"]
    return index, radius


def bounds(anchors: np.ndarray, centers: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of each anchor in each list, moved apart by more than the arithmetic errs."""
    middle, reach = anchors @ centers.T, V.norms(anchors)[:, None] * np.maximum(radius, 0)[None, :]
    slack = 1 + 1e-9 * (V.norms(anchors)[:, None] * V.norms(centers)[None, :] + reach)
    empty = radius < 0
    return np.where(empty, np.inf, middle - reach - slack), np.where(empty, -np.inf, middle + reach + slack)


def _visit(block, width: int, visits, low: np.ndarray, high: np.ndarray, k: int, same: bool):
    """The best rows for each unit, an anchor with a window from ``low`` to ``high``, in the lists that it visits."""
    wanted = visits

    def run(batches):
        (ids, labels, anchors, of_unit), (visits, low, high) = block.value, wanted.value
        best = V.Best(k)
        for batch in slices(batches):
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            who, tags = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            x = V.unpack(batch.column(3), width)
            for one in np.unique(lists):
                units = np.flatnonzero(visits[:, one])
                if not len(units):
                    continue
                asked, unit_row = np.unique(of_unit[units], return_inverse=True)
                at = np.flatnonzero(lists == one)
                for part in np.array_split(at, -(-len(at) * max(len(asked), len(units)) // V.CELLS)):
                    scores = V.products(anchors[asked], x[part])
                    fits = ((labels[asked][:, None] == tags[part]) == same) & (ids[asked][:, None] != who[part])
                    mine = scores[unit_row]
                    u, c = np.nonzero((mine >= low[units][:, None]) & (mine <= high[units][:, None]) & fits[unit_row])
                    best.add(units[u], who[part][c], mine[u, c])
        u, who, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(who, pa.int64()), pa.array(score, pa.int64())], ["unit", "vec_id", "score"])

    return run


def _search(scratch: Scratch, index: DataFrame, width: int, anchors, units: np.ndarray, low: np.ndarray, high: np.ndarray, limits, k: int, same: bool) -> DataFrame:
    """(unit, vec_id, score, rank): the ``k`` best of each unit, round by round. ``units``: the anchor of each."""
    context = index.sparkSession.sparkContext
    lower, upper = (x[units] for x in limits)
    block = context.broadcast((*anchors, units))
    order = np.argsort(-upper, axis=1, kind="stable")
    best = Window.partitionBy("unit").orderBy(F.desc("score"), "vec_id")
    found, floor, start, step = None, low.copy(), 0, FIRST
    while start < order.shape[1]:
        visits = np.zeros(upper.shape, bool)
        np.put_along_axis(visits, order[:, start : start + step], True, 1)
        visits &= (upper >= floor[:, None]) & (lower <= high[:, None])  # strictly below the k-th score, or outside the window: left out
        lists = np.flatnonzero(visits.any(0))
        if len(lists):
            wanted = context.broadcast((visits, floor, high))
            new = index.where(F.col("list").isin(lists.tolist())).select("list", "id", "label", "vector").mapInArrow(_visit(block, width, wanted, floor, high, k, same), "unit long, vec_id long, score long")
            every = new if found is None else found.drop("rank").unionByName(new)
            found = scratch.write(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "best")
            kth = found.where(F.col("rank") == k).select("unit", "score").toArrow()  # a number for each unit of the block
            at, score = kth.column("unit").to_numpy(), kth.column("score").to_numpy()
            floor[at] = np.maximum(floor[at], score)
            wanted.unpersist()
        start, step = start + step, step * GROWTH
        if start < order.shape[1] and not ((np.take_along_axis(upper, order[:, start:], 1) >= floor[:, None])).any():
            break
    block.unpersist()
    return found


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row
    for which ``anchors``, a condition on ``id``, holds."""
    spark = rows.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    every = V.long_id(rows, id_col, vector_col, F.col(f"`{label_col}`").cast("long").alias("label")).where("label is not null")
    n, width, _ = V.measure(every)
    centers = centroids(every, n, width, lists)
    index, radius = build(scratch, every, centers, width)
    path, any_block = scratch.path(f"found-{uuid.uuid4().hex}"), False
    for table in V.blocks(scratch, index.where(F.coalesce(anchors, F.lit(False))).select("id", "vector", "label"), width, max(1, BOUNDS // (len(centers) * positives))):
        ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        x = np.concatenate([V.unpack(c, width) for c in table.column("vector").chunks])
        asked, limits = (ids, labels, x), bounds(x, centers, radius)
        one = np.arange(len(ids))
        near = _search(scratch, index, width, asked, one, np.full(len(ids), _NONE, np.int64), np.full(len(ids), V.LIMIT, np.int64), limits, positives, True)
        pairs = near.where(F.col("score") >= 0).select("unit", "score").distinct().orderBy("unit", "score").toArrow()  # at most ``positives`` an anchor
        unit, score = pairs.column("unit").to_numpy().astype(np.int64), pairs.column("score").to_numpy().astype(np.int64)
        if not len(unit):
            continue
        edge = lambda share, up: np.array([(-(-share * int(s) // 100) if up else share * int(s) // 100) for s in score], np.int64)
        far = _search(scratch, index, width, asked, unit, edge(window[0], True), edge(window[1], False), limits, negatives, False)
        if far is None:
            continue
        names = spark.createDataFrame(pa.table({"pair": np.arange(len(unit)), "unit": unit, "score": score, "anchor_id": ids[unit]}))
        pairs = near.select("unit", "score", F.col("vec_id").alias("positive_id")).join(names, ["unit", "score"])
        out = pairs.join(far.select(F.col("unit").alias("pair"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), "pair")
        V.append(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score"), path)
        any_block = True
    return V.appended(scratch, path, RESULT, any_block)
