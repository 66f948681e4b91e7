"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams of lengths 2 to 4
over lower-cased letters. Each language has several centroids, clustered by
spherical k-means, and a text gets the language of the centroid with the
greatest cosine. A text farther from it than nearly all of the
centroid's own training texts is marked as not accepted.

The fit sees about ``SAMPLE`` labelled texts a language, chosen by a hash below SAMPLE / count, each
as its vector of ``DIMENSIONS`` numbers whatever its length; its state is ``DIMENSIONS`` weights
and one vector for each centroid. Every text is classified whole, in one scan without shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
not accepted; rows without a language are never learned from; rows that repeat
are classified alike; texts of any length are read whole; of equally near
centroids the first by language wins; with nothing to learn from every text is ``und``;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm._shared import Scratch, ship, slices
from grantlake.llm._words import string_buffers

DIMENSIONS, SAMPLE, CENTROIDS, ROUNDS = 1 << 13, 1000, 4, 12
UNKNOWN = "und"
#: A centroid accepts texts at least as near as this quantile of its own training texts, less the slack.
RADIUS_QUANTILE, SLACK = 0.01, 0.05

_LETTER = r"\p{L}"
_SPACE = np.arange(256, dtype=np.uint32)  # letters and bytes beyond ASCII stay, anything else is a blank
_SPACE[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)


def counts(column: pa.Array) -> np.ndarray:
    """(texts, DIMENSIONS) matrix of n-gram counts, damped by the logarithm."""
    data, at = string_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    out = np.zeros((len(column), DIMENSIONS), np.float32)
    for i in range(len(column)):
        text = _SPACE[data[at[i] : at[i + 1]]]
        text = np.concatenate([[np.uint32(0x20)], text, [np.uint32(0x20)]]).astype(np.uint32)
        gram = text[:-1] * np.uint32(0x1F35) + text[1:] * np.uint32(0x2F0B3)
        total = np.bincount((gram * np.uint32(0x9E3779B1)) >> _SHIFT, minlength=DIMENSIONS)
        for n in (2, 3):
            if len(text) > n:
                gram = gram[: len(text) - n] + text[n:] * np.uint32((0x3C6EF35, 0x5851F42D)[n - 2])
                total += np.bincount((gram * np.uint32(0x9E3779B1)) >> _SHIFT, minlength=DIMENSIONS)
        out[i] = total
    return np.log1p(out, out=out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _count(batches):
    for batch in slices(batches, 2 << 20):
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([row.tobytes() for row in counts(batch.column(0))], pa.binary())], ["lang", "counts"])


def _document_frequency(batches):
    total, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for row in batch.column(0):
            total += np.frombuffer(row.as_buffer(), np.float32) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "df"])


def _cluster(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit vectors from far-apart starts: (centroids, least cosine accepted)."""
    picks = [int(np.argmax(x @ x.mean(0)))]
    while len(picks) < min(CENTROIDS, len(x)):
        picks.append(int(np.argmin((x @ x[picks].T).max(1))))
    centers = x[picks]
    for _ in range(ROUNDS):
        near = (x @ centers.T).argmax(1)
        sums = np.stack([x[near == k].sum(0) if (near == k).any() else centers[k] for k in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    cos = x @ centers.T
    near = cos.argmax(1)
    least = [float(np.quantile(cos[near == k, k], RADIUS_QUANTILE)) - SLACK if (near == k).any() else 1.0 for k in range(len(centers))]
    return centers.astype(np.float32), np.array(least, np.float32)


class Model:
    """idf, the centroids' languages, vectors and least cosines."""

    def __init__(self, idf: np.ndarray, languages: list[str], centers: np.ndarray, least: np.ndarray):
        self.idf, self.languages, self.centers, self.least = idf, languages, centers, least

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(column, _LETTER), False).to_numpy(zero_copy_only=False), bool)
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        cos = unit(counts(column) * self.idf) @ self.centers.T
        near = cos.argmax(1)
        best = cos[np.arange(len(near)), near]
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(near, letters, strict=True)], np.where(letters, np.clip(best, 0, 1), 0).astype(float), letters & (best >= self.least[near])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", scratch: Scratch | None = None) -> Model:
    """Learn from rows with a language. ``key_col`` only spreads the choice of the
    SAMPLE texts a language; it is no feature."""
    spark = labelled.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{key_col}`")).alias("h")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one number for each language
    if not sizes:
        return Model(np.ones(DIMENSIONS, np.float32), [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.float32))
    # a row's hash as a share of all hashes, below the share that its language can give
    drawn, chosen = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)), F.lit(False)
    for lang, size in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (drawn < F.lit(SAMPLE / size)))
    sample = scratch.write(rows.where(chosen).select("text", "lang").mapInArrow(_count, "lang string, counts binary"), "sample")
    parts = sample.select("counts").coalesce(8).mapInArrow(_document_frequency, "n long, df binary").collect()  # at most 8 rows of DIMENSIONS numbers
    n, df = sum(p["n"] for p in parts), sum(np.frombuffer(p["df"], np.int64) for p in parts)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        centers, least = _cluster(unit(np.stack([np.frombuffer(c, np.float32) for c in pdf["counts"]]) * idf))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "center": [c.tobytes() for c in centers], "least": least.astype(float)})

    found = sorted(sample.groupBy("lang").applyInPandas(learn, "lang string, center binary, least double").collect(), key=lambda r: (r["lang"], r["center"]))
    return Model(idf, [r["lang"] for r in found], np.stack([np.frombuffer(r["center"], np.float32) for r in found]), np.array([r["least"] for r in found], np.float32))


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score and accepted."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = rows.columns[1:]

    def run(batches):
        model = shared.value
        for batch in slices(batches, 2 << 20):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lang, score, accepted = model.predict(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], [*names, "lang_pred", "score", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, accepted boolean")
