"""Whole-number vectors, exact inner products and the best few of each key.

A component x becomes floor(256 * x), x as double; a score is the inner product of
two such vectors, exact whatever their size: in double precision where every sum
stays below 2**53, else in whole numbers of any length, cut off at 2**62 - 1 on either side. A vector
that is null, or holds a null or a component that is not finite, takes no part, nor does a row without id;
of two vectors of unequal length the shorter one is read as if filled up with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm._shared import Scratch, slices, with_rank

SCALE = 256
#: Scores beyond are set to it, so that differences of scores stay in 64 bits.
LIMIT = (1 << 62) - 1
#: Scores held at once, and bytes of asked vectors in a block: what a task holds, whatever the input.
CELLS, BLOCK_BYTES = 1 << 20, 4 << 20


def parse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows take part, their components as whole doubles, their lengths)."""
    at = column.offsets.to_numpy().astype(np.int64)
    x = column.values.slice(int(at[0]), int(at[-1] - at[0])).cast(pa.float64())
    x = x.fill_null(np.nan).to_numpy(zero_copy_only=False)
    at = at - at[0]
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    part = column.is_valid().to_numpy(zero_copy_only=False).astype(bool) & (odd[at[1:]] == odd[at[:-1]])
    size = np.diff(at)
    kept = x if part.all() and at[-1] == len(x) else x[np.repeat(part, size)]
    most = np.finfo(float).max
    with np.errstate(over="ignore"):
        return part, np.clip(np.floor(kept * float(SCALE)), -most, most), size[part]


def matrix(values: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) of components that lie one after another."""
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(starts, sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, exact, as 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object)
    return np.clip(whole(a) @ whole(b).T, -LIMIT, LIMIT).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, rounded up by more than the arithmetic errs."""
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(1)) * (1 + 1e-9)


class Best:
    """The ``k`` best of each key among all rows added: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(keys):
            self.parts.append((keys, ids, scores))
            self.held += len(keys)
            if self.held > CELLS:
                self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        keys, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, keys))
        keys = keys[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        place = np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
        order, keys = order[place < self.k], keys[place < self.k]
        self.parts, self.held = [(keys, ids[order], scores[order])], 0
        return self.parts[0]


def measure(rows: DataFrame) -> tuple[int, int, float]:
    """(rows that take part, greatest length of a vector, greatest norm) of (id, vector, ...): one small row a task."""

    def run(batches):
        n, width, norm = 0, 0, 0.0
        for batch in slices(batches):
            part, values, sizes = parse(batch.column(1))
            if len(sizes):
                n, width = n + len(sizes), max(width, int(sizes.max()))
            if len(values):
                with np.errstate(over="ignore"):
                    squares = np.add.reduceat(values * values, (np.cumsum(sizes) - sizes)[sizes > 0])
                norm = max(norm, float(np.sqrt(squares.max())) * (1 + 1e-9))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([width], pa.int64()), pa.array([norm])], ["n", "width", "norm"])

    found = rows.select(*rows.columns[:2]).mapInArrow(run, "n long, width long, norm double").agg(F.sum("n"), F.max("width"), F.max("norm")).first()
    return found[0] or 0, found[1] or 0, found[2] or 0.0


def whole(rows: DataFrame, width: int) -> DataFrame:
    """(id, vector, ...) with each vector that takes part as ``width`` doubles in a binary column."""

    def run(batches):
        for batch in slices(batches):
            part, values, sizes = parse(batch.column(1))
            x, rest = matrix(values, sizes, width), batch.filter(pa.array(part))
            yield pa.RecordBatch.from_arrays([rest.column(0), pa.array([v.tobytes() for v in x], pa.binary()), *rest.columns[2:]], names)

    names = rows.columns
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {'binary' if i == 1 else f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields)))


def unpack(column: pa.Array, width: int) -> np.ndarray:
    """The matrix of a binary column that ``whole`` wrote."""
    if not len(column):
        return np.zeros((0, width))
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if pa.types.is_binary(column.type) else np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not width:
        return np.zeros((len(column), 0))
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float64).reshape(len(column), width)


def blocks(scratch: Scratch, asked: DataFrame, width: int, most: int = 1 << 20):
    """Yield the rows of ``asked`` (id, vector as ``whole`` makes it, ...) in order of ids, in blocks of at most ``most``
    rows and BLOCK_BYTES of vectors: these reach the driver, one block at a time, and are sent to the tasks."""
    rows = scratch.write(with_rank(scratch, asked, [F.col(asked.columns[0]), F.hash(*asked.columns)], "__rank"), "asked")
    total, size = rows.count(), max(1, min(most, BLOCK_BYTES // (8 * max(1, width))))
    for at in range(0, total, size):
        yield rows.where((F.col("__rank") >= at) & (F.col("__rank") < at + size)).orderBy("__rank").drop("__rank").toArrow()


def append(rows: DataFrame, path: str) -> None:
    """Add what a block found to a table of all blocks."""
    rows.write.mode("append").parquet(path)


def appended(scratch: Scratch, path: str, schema: str, any_block: bool) -> DataFrame:
    return scratch.spark.read.schema(schema).parquet(path) if any_block else scratch.spark.createDataFrame([], schema)


def long_id(rows: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(id, vector, ...) of rows with an id and a vector."""
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), *more)
    return out.where("id is not null and vector is not null")
