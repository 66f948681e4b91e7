"""Exact top-k search by distributed selection on score histograms.

Every pass scores all candidates against a block of queries and counts the scores
of each query in bins of equal width. The histograms are summed over the tasks, the bin
that holds a query's k-th best score is located, and the next pass cuts that bin into bins
again, until a bin is one score wide. A last pass keeps what reaches the k-th
score; of equal scores the smaller ids stay. A task reports the bins from the top down to its own
k-th score alone: the k-th score of all rows lies no lower, so at most k bins a query leave a task.

Passes: the scores' range (from the greatest norm, by Cauchy-Schwarz) in bits, over BITS, and one more.
Queries are taken in blocks of at most ``vectors.BLOCK_BYTES``, which is what is broadcast;
candidates are only ever scanned, so one row or a third of all rows alike cost the same.

Defined cases: null, incomplete and odd vectors and rows without id take no part (``vectors``); a query's
own row is every row with its id; an id that stands in several rows is a candidate by each of
them and asks by each of them; with fewer than k candidates all are returned; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlake.llm import vectors as V
from grantlake.llm._shared import Scratch, ship, slices

#: Bins of a pass: 2 ** BITS.
BITS = 9
RESULT = "query_id long, rank int, vec_id long, score long"


def _scored(batches, ids: np.ndarray, queries: np.ndarray):
    """(candidate ids, scores (queries, candidates), which of them are a query's own row) of small slices. ``ids`` rise."""
    width, step = queries.shape[1], max(1, V.CELLS // max(1, len(ids)))
    for batch in slices(batches):
        part, values, sizes = V.parse(batch.column(1))
        who, x = batch.column(0).to_numpy(zero_copy_only=False)[part], V.matrix(values, sizes, width)
        for at in range(0, len(who), step):
            some = who[at : at + step]
            first, last = np.searchsorted(ids, some), np.searchsorted(ids, some, "right")
            own = np.zeros((len(ids), len(some)), bool)
            for column in np.flatnonzero(last > first):
                own[first[column] : last[column], column] = True
            yield some, V.products(queries, x[at : at + step]), own


def _histogram(block, low: np.ndarray, need: np.ndarray, bits: int, shift: int):
    """The 2**bits scores from ``low`` up, in bins 2**shift wide, for every query that still needs ``need`` rows of them."""
    bins = 1 << (bits - shift)

    def run(batches):
        ids, queries = block.value
        total = np.zeros(len(ids) * bins, np.int64)
        for _, scores, own in _scored(batches, ids, queries):
            place = (scores - low[:, None]) >> shift
            seen = (place >= 0) & (place < bins) & ~own & (need > 0)[:, None]
            flat = (place + (np.arange(len(ids)) * bins)[:, None])[seen]
            if 4 * len(flat) > len(total):
                total += np.bincount(flat, minlength=len(total))
            else:
                np.add.at(total, flat, 1)
        total = total.reshape(len(ids), bins)
        above = total[:, ::-1].cumsum(1)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(total[q, b]), pa.array(need[q])], ["q", "bin", "n", "need"])

    return run


def _locate(parts: DataFrame) -> DataFrame:
    """(q, bin, above): the bin in which the count from the top reaches what the query needs."""
    down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = parts.groupBy("q", "bin", "need").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
    return sums.where("upto >= need and upto - n < need").select("q", "bin", (F.col("upto") - F.col("n")).alias("above"))


def _select(block, low: np.ndarray, k: int):
    """Of each query, what scores at least ``low``: at most k rows a task."""

    def run(batches):
        ids, queries = block.value
        best = V.Best(k)
        for who, scores, own in _scored(batches, ids, queries):
            q, c = np.nonzero((scores >= low[:, None]) & ~own)
            best.add(q, who[c], scores[q, c])
        q, who, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[q], pa.int64()), pa.array(who, pa.int64()), pa.array(score)], ["q", "query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of every row for which ``asks`` (of the ids) holds."""
    spark = rows.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    every = V.long_id(rows, id_col, vector_col)
    _, width, norm = V.measure(every)
    bound = V.LIMIT + 1 if norm * norm >= V.LIMIT else 1 << int(norm * norm + 1).bit_length()
    path, any_block = scratch.path(f"found-{uuid.uuid4().hex}"), False
    for table in V.blocks(scratch, V.whole(every.where(F.coalesce(asks, F.lit(False))), width), width):
        table = table.combine_chunks()
        ids, queries = table.column(0).combine_chunks().to_numpy().astype(np.int64), np.concatenate([V.unpack(c, width) for c in table.column(1).chunks])
        block = spark.sparkContext.broadcast((ids, queries))
        low, need = np.full(len(ids), -bound, np.int64), np.full(len(ids), k, np.int64)
        bits = bound.bit_length()  # of the range from -bound to bound
        while bits > 0 and need.any():
            shift = max(0, bits - BITS)
            parts = every.mapInArrow(_histogram(block, low, need, bits, shift), "q long, bin long, n long, need long")
            kth = _locate(parts).toArrow()  # a row for each query of the block
            q, b, above = (kth.column(c).to_numpy() for c in ("q", "bin", "above"))
            fewer = np.setdiff1d(np.flatnonzero(need), q)  # fewer candidates than k: all are kept
            low[q] += b << shift
            need[q] -= above
            need[fewer] = 0
            bits = shift
        picked = every.mapInArrow(_select(block, low, k), "q long, query_id long, vec_id long, score long")
        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        ranked = picked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        V.append(ranked.select("query_id", "rank", "vec_id", "score"), path)
        any_block = True
        block.unpersist()
    return V.appended(scratch, path, RESULT, any_block)
