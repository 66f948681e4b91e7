"""How far the sources of a language differ in their words.

Per language, the terms of at least ``least_docs`` documents are kept, and every group (language, source) gives each of
them a smoothed share p in parts of 10**9. Two groups differ by the sum of (p - q)**2 / (p + q), in whole
numbers, and a group's own terms are those of which it has more than its language.

Terms are counted in the tasks before anything is shuffled. The kept counts are then cut into tiles: a block of terms
of one language against two chunks of its groups. A tile becomes a dense int64 matrix of groups by terms, all pairs of
its groups are computed by broadcasting, and it returns its part of the pairs' sums and, from the
chunk itself, a heap of each group's first terms; Spark adds the sums and merges the heaps. Terms of which
no group of a tile has any all count the same, and are added by their number.

Languages are cut by terms and groups alike, so one that holds all rows makes more tiles and no larger ones. A text longer
than ``LONG_TEXT`` bytes is counted piece by piece, and its terms meet by a key of its own.

Defined cases: a null text, language or source is ''; a group without terms, and a
language that keeps none, still compare with the others of the language (value 0 with no terms kept); ties go by term or source in
order of UTF-8; rows that repeat are documents of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlake.llm._shared import Scratch, ship, slices

#: Terms and groups of a tile at most, and about how many terms its hash puts there.
TILE_TERMS, TILE_GROUPS = 512, 32
PARTS = 1_000_000_000
#: Counts a task holds before it sends them on; a text beyond so many bytes is counted in pieces of half of that.
HELD, LONG_TEXT = 400_000, 8 << 20
#: Above this many languages or groups their figures are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 50_000
_COUNTS = "lang string, source string, term string, doc long, n long, docs long"
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))  # A-Z lower-cased, anything else in ASCII a blank


def _pieces(text: bytes):
    """A text, its terms parted by blanks, in pieces that end between terms (or whole terms, however long)."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + LONG_TEXT // 2)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _count(batches):
    """Counts of (lang, source, term) and of the documents that hold it, as sums of many rows (doc null) or, for
    a long text, of one piece of it (doc set)."""
    terms, docs = defaultdict(Counter), defaultdict(Counter)
    held, key = 0, TaskContext.get().partitionId() << 33

    def out(lang, source, term, doc, n, docs):
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "doc", "n", "docs"])

    def send():
        for (lang, source), found in terms.items():
            if found:
                yield out([lang] * len(found), [source] * len(found), list(found), [None] * len(found), list(found.values()), [docs[lang, source][t] for t in found])
        terms.clear()
        docs.clear()

    for batch in slices(batches):
        for text, lang, source in zip(*(batch.column(i) for i in range(3)), strict=True):
            group = (lang.as_py() or "", source.as_py() or "")
            raw = text.as_buffer() if text.is_valid else None
            if raw is None or not raw.size:
                continue
            if raw.size > LONG_TEXT:
                key += 1
                for piece in _pieces(raw.to_pybytes().translate(_TERM)):
                    found = Counter(piece.split())
                    if found:
                        yield out([group[0]] * len(found), [group[1]] * len(found), list(found), [key] * len(found), list(found.values()), [1] * len(found))
                continue
            found = raw.to_pybytes().translate(_TERM).split()
            before = len(terms[group])
            terms[group].update(found)
            docs[group].update(set(found))
            held += len(terms[group]) - before
            if held > HELD:
                yield from send()
                held = 0
    yield from send()


def counts(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all documents (text, lang, source)."""
    parts = scratch.write(docs.mapInArrow(_count, _COUNTS), "counted")
    long = parts.where("doc is not null").groupBy("lang", "source", "term", "doc").agg(F.sum("n").alias("n")).withColumn("docs", F.lit(1).cast("long"))
    some = ["lang", "source", "term", "n", "docs"]
    every = parts.where("doc is null").select(*some).unionAll(long.select(*some))
    return every.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * count / total), exact: by long division in base 1000, so that nothing leaves 64 bits."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b): sums of ``apart`` over the columns."""
    out, step = np.zeros((len(a), len(b)), np.int64), max(1, (1 << 18) // max(1, len(a) * len(b)))
    for at in range(0, a.shape[1], step):
        out += apart(a[:, None, at : at + step], b[None, :, at : at + step]).sum(2)
    return out


def _tile(top: int):
    """The pairs' partial sums (term null) and the first terms of each group (other null) of one tile."""

    def run(key, cells: pa.Table, groups: pa.Table) -> pa.Table:
        lang, block, left, right = (k.as_py() for k in key)
        groups = groups.sort_by("g")
        column = lambda t, c: t.column(c).to_numpy()
        g, total, terms = column(groups, "g"), column(groups, "total"), int(groups.column("terms")[0].as_py())
        names = np.array(cells.column("term").to_pylist(), object)
        names, at = np.unique(names, return_inverse=True) if len(names) else (names, np.zeros(0, np.int64))  # in order of code points, which is that of UTF-8
        n = np.zeros((len(g), len(names)), np.int64)
        n[np.searchsorted(g, column(cells, "g")), at] = column(cells, "n")
        p, none = shares(n + 2, total[:, None]), shares(np.full(len(g), 2, np.int64), total) if terms else None
        a = np.flatnonzero(g // TILE_GROUPS == left)
        b = np.flatnonzero(g // TILE_GROUPS == right)
        sums = _pair_sums(p[a], p[b])
        if terms > len(names):  # the block's other terms
            sums += (terms - len(names)) * apart(none[a][:, None], none[b][None, :])
        i, j = np.nonzero(np.ones(sums.shape, bool) if left != right else np.triu(np.ones(sums.shape, bool), 1))
        rows = [(g[a][i], g[b][j], [None] * len(i), sums[i, j])]
        if left == right and len(names):
            mean = np.zeros(len(names), np.int64)
            mean[at] = column(cells, "of_lang")
            mean = shares(mean + 2, column(groups, "lang_total")[:1])
            value = apart(p, mean[None, :])
            own = (n > 0) & (p > mean[None, :])
            for k in range(len(g)):
                has = np.flatnonzero(own[k])
                first = has[np.lexsort((has, -value[k, has]))][:top]
                rows.append((np.full(len(first), g[k]), None, list(names[first]), value[k, first]))
        size = [len(r[0]) for r in rows]
        return pa.table({
            "lang": pa.array([lang] * sum(size), pa.string()), "g": pa.array(np.concatenate([r[0] for r in rows]).astype(np.int64)),
            "other": pa.array([x for r, s in zip(rows, size, strict=True) for x in (r[1].tolist() if r[1] is not None else [None] * s)], pa.int64()),
            "term": pa.array([x for r in rows for x in r[2]], pa.string()), "value": pa.array(np.concatenate([r[3] for r in rows]).astype(np.int64)),
        })

    return run


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where it is counted to be small; else Spark shuffles, and splits what is skewed."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a group with each other source of
    its language, part ``term`` has its ``top`` own terms."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    blank = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    rows = docs.select(blank(text_col, "text"), blank(lang_col, "lang"), blank(source_col, "source"))
    cells = scratch.write(counts(scratch, rows), "cells")

    terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= least_docs).select("lang", "term", "of_lang")
    kept = scratch.write(cells.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    vocabulary = scratch.write(kept.groupBy("lang", "term").agg(F.first("of_lang").alias("of_lang")), "terms")

    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["size"])
    g = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    groups = groups.withColumn("g", g.cast("long")).join(langs, "lang", "left").fillna(0, ["v"])
    groups = scratch.write(groups.select("lang", "source", "g", (F.col("size") + 2 * F.col("v")).alias("total"), "v"), "groups")
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("v") / TILE_TERMS)).cast("long")
    langs = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count("*").alias("n_groups"), F.sum(F.col("total") - 2 * F.col("v")).alias("size"))
    langs = scratch.write(langs.select("lang", blocks_of.alias("blocks"), F.ceil(F.col("n_groups") / TILE_GROUPS).cast("long").alias("chunks"), (F.col("size") + 2 * F.col("v")).alias("lang_total")), "langs")
    small = _small(langs)

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    per_block = vocabulary.join(small, "lang").groupBy("lang", block).agg(F.count("*").alias("terms"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("__other")
    chunk = F.floor(F.col("g") / TILE_GROUPS).cast("long")
    tile = [F.least("__chunk", "__other").alias("left"), F.greatest("__chunk", "__other").alias("right")]
    there = kept.join(_small(groups.select("lang", "source", "g")), ["lang", "source"]).join(small, "lang")
    there = there.select("lang", block, chunk.alias("__chunk"), other, "g", "term", "n", "of_lang").select("lang", "block", *tile, "g", "term", "n", "of_lang")
    each = groups.select("lang", "g", "total").join(small, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), chunk.alias("__chunk"), other, "g", "total", "lang_total")
    each = each.join(per_block, ["lang", "block"], "left").fillna(0, ["terms"]).select("lang", "block", *tile, "g", "total", "lang_total", "terms")

    keys = ["lang", "block", "left", "right"]
    each = each.select(*(F.col(c).alias(f"{c}_") for c in each.columns)).toDF(*each.columns)  # columns of its own: both sides come from ``groups``
    found = there.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(_tile(top), "lang string, g long, other long, term string, value long")
    found = scratch.write(found, "tiles")
    pairs = found.where("term is null").groupBy("lang", "g", "other").agg(F.sum("value").alias("value"))
    both = pairs.unionAll(pairs.select("lang", F.col("other").alias("g"), F.col("g").alias("other"), "value"))
    name = _small(groups.select("lang", "g", "source"))
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    item = name.select("lang", F.col("g").alias("other"), F.col("source").alias("item"))
    differ = both.join(name, ["lang", "g"]).join(item, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank())
    own = found.where("term is not null").join(name, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", rank()).where(F.col("rank") <= top)
    return differ.unionAll(own)
