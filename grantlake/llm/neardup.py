"""MinHash near-duplicates by a signature-coordinate inverted join.

1. ``sign``: one scan turns each text into its number of distinct word
   shingles, a digest of the full shingle set and ``COORDINATES`` minimum hashes.
2. Rows with equal digests are one class with one representative, so copies
   never meet each other again.
3. Every representative is posted under its (coordinate, value) pairs. A pair of
   similarity s shares each coordinate with probability s, so of texts that are
   similar enough, fewer than ``MATCHES`` shared coordinates have a probability
   below 1e-6. Two signatures with MATCHES coordinates in common share one of
   their COORDINATES - MATCHES + 1 rarest pairs (prefix); the lists of the more
   common pairs, such as those of passages that many texts quote, are skipped,
   and collisions are counted on the signatures of the pairs that remain.
4. Pairs that reach MATCHES are confirmed on the full shingle sets.

No list is expanded into all its pairs. In each round every representative is
held against one leader of its lists, the text most central to its group, and
what is confirmed merges into components. After ``STAR_ROUNDS``, the members of
lists that still hold several components are joined across components by
the rare shingles of their full sets (``prefix_pairs``). Links inside one component
are not looked for: they cannot change it.

Defined cases: null or empty texts and texts without words have no shingles and
link with nothing; a text of fewer than ``width`` words is one shingle; texts of any
length give all their shingles; repeated rows fall into one class, and ``dedup`` keeps one row
of an id; ids that repeat with different texts are one document, confirmed by the least of its texts; a
null id is kept as a row of its own component; of equally central leaders the least id leads; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlake.llm._shared import Scratch, ship, slices
from grantlake.llm._words import mix, shingles, word_hashes

COORDINATES, MATCHES, WIDTH, STAR_ROUNDS = 40, 16, 5, 2
SIMILAR = (75, 100)

_SIGNED = "id long, n_shingles long, digest binary, sig array<long>"
_FACTORS = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    hashes, at = word_hashes(column)
    return [np.unique(shingles(hashes[at[i] : at[i + 1]], width)) for i in range(len(column))]


def _sign(batches, coordinates: int, width: int):
    for batch in slices(batches):
        sets = shingle_sets(batch.column(1), width)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        sig = np.zeros((len(full), coordinates), np.uint64)
        at = 0
        while at < len(full):  # about 256k shingles at a time stay in cache
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), 1 << 18)))
            part = np.concatenate([sets[i] for i in full[at:end]])
            edges = np.concatenate([[0], np.cumsum(sizes[full[at:end]])[:-1]])
            for k in range(coordinates):
                sig[at:end, k] = np.minimum.reduceat(part * _FACTORS[k], edges)
            at = end
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        lengths = np.where(sizes > 0, coordinates, 0)
        values = pa.array(sig.reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(digest, pa.binary()), lists], ["id", "n_shingles", "digest", "sig"])


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES, width: int = WIDTH) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _sign(batches, coordinates, width), _SIGNED)


def _confirm(batches, width: int, percent: tuple[int, int]):
    """(a, text_a, b, text_b) -> (a, b) of the pairs that are similar enough. The
    set of b is kept from row to row, as rows with one b come together."""
    last, last_set = None, None
    for batch in slices(batches):
        sets = shingle_sets(batch.column(1), width)
        a, b, text = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        keep = []
        for i in range(batch.num_rows):
            if b[i] != last or last is None:
                last, last_set = b[i], shingle_sets(text.slice(i, 1), width)[0]
            common = len(np.intersect1d(sets[i], last_set, assume_unique=True))
            if percent[1] * common >= percent[0] * (len(sets[i]) + len(last_set) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: tuple[int, int]) -> DataFrame:
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.join(left, "a").join(right, "b").select("a", "text_a", "b", "text_b")
    return both.mapInArrow(lambda batches: _confirm(batches, width, percent), "a long, b long")


def _explode(batches, width: int):
    for batch in slices(batches, 2 << 20):
        sets = shingle_sets(batch.column(1), width)
        sizes = np.array([len(s) for s in sets], np.int32)
        ids = np.repeat(np.asarray(batch.column(0), np.int64), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "n", "g"])


def prefix_pairs(scratch: Scratch, texts: DataFrame, labels: DataFrame, width: int, percent: tuple[int, int]) -> DataFrame:
    """(a, b) of texts in different components whose full sets may be similar
    enough. Shingles are ordered from rare to common, and two texts can only meet
    at a shingle before which neither has passed too many for the rest to reach the
    similarity, so the common shingles of a large group bring nothing together.

    texts: (id, text); labels: (id, component)."""
    low, high = percent
    grams = scratch.write(texts.mapInArrow(lambda batches: _explode(batches, width), "id long, n int, g long"), "grams")
    shared = grams.groupBy("g").agg(F.count("*").alias("df")).where("df >= 2")
    order = Window.partitionBy("id", "n").orderBy("df", "g")
    mine = grams.join(shared, "g").withColumn("r", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy("id", "n")))
    # passed: shingles of the text before this one, those that no other text has being the rarest
    mine = mine.withColumn("passed", F.col("n") - F.col("m") + F.col("r") - 1).where((F.col("n") - F.col("passed")) * high >= F.col("n") * low)
    # texts a and b can meet at a shingle if n_b * low <= room_a and n_a * low <= room_b
    room = ((F.col("n") - F.col("passed")) * (low + high) - F.col("n") * low).alias("room")
    mine = scratch.write(mine.join(labels, "id").select("g", "id", "component", "n", room), "prefix")
    # a shingle of many texts none of which has room for another brings no two of them together
    bounds = mine.groupBy("g").agg(F.min("n").alias("least"), F.max("room").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    mine = scratch.write(mine.join(bounds, "g").where((F.col("least") * low <= F.col("room")) & (F.col("n") * low <= F.col("most"))).select(*mine.columns), "prefix")
    x, y = mine.toDF("g", "a", "ca", "na", "ra"), mine.toDF("g", "b", "cb", "nb", "rb")
    both = (F.col("nb") * low <= F.col("ra")) & (F.col("na") * low <= F.col("rb"))
    return x.join(y, (x["g"] == y["g"]) & (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & both).select("a", "b").distinct()


def min_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the least id reachable, by
    alternating large and small stars (each round is aggregates and joins)."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = scratch.write(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _similar_size(percent: tuple[int, int]):
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return low * percent[1] >= high * percent[0]


def _collide(pairs: DataFrame, reps: DataFrame, matches: int, percent: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose signatures agree on ``matches`` coordinates and
    whose sets are of sizes that the similarity allows."""
    side = reps.select("rep", "n", "sig")
    wide = pairs.join(side.toDF("a", "n_a", "sig_a"), "a").where("sig_a is not null").join(side.toDF("b", "n_b", "sig_b"), "b")
    agree = F.expr("size(filter(zip_with(sig_a, sig_b, (x, y) -> x = y), z -> z))")
    return wide.where(_similar_size(percent)).where(agree >= matches).select("a", "b")


def link_components(
    scratch: Scratch, docs: DataFrame, reps: DataFrame, matches: int = MATCHES, coordinates: int = COORDINATES, width: int = WIDTH, percent: tuple[int, int] = SIMILAR
) -> DataFrame:
    """(id, component) of the representatives that are linked with others.
    ``docs``: (id, text); ``reps``: (rep, n, sig)."""
    posts = reps.select("rep", F.posexplode("sig").alias("pos", "val"))
    shared = posts.groupBy("pos", "val").agg(F.count("*").alias("df")).where("df >= 2")
    entry = F.struct("df", "val", "pos")
    ranked = posts.join(shared, ["pos", "val"]).groupBy("rep").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    # pairs that no other text has come first in the order, so they fill the prefix first
    room = F.greatest(F.size("e") - matches + 1, F.lit(0))
    weight = F.aggregate("e", F.lit(0.0), lambda t, x: t + F.log2(x["df"]))  # high for a text in the middle of its group
    lists = ranked.select("rep", weight.alias("weight"), F.explode(F.slice(F.col("e"), F.lit(1), room)).alias("x"))
    lists = scratch.write(lists.select("rep", "weight", "x.pos", "x.val"), "lists")
    busy = lists.groupBy("pos", "val").agg(F.count("*").alias("n")).where("n >= 2")
    lists, n = scratch.write_counting(lists.join(busy.select("pos", "val"), ["pos", "val"]), "lists")
    if not n:
        return reps.select(F.col("rep").alias("id"), F.col("rep").alias("component")).limit(0)

    met = lists.select(F.col("rep").alias("id")).distinct()
    texts = scratch.write(docs.join(met, "id").groupBy("id").agg(F.min("text").alias("text")), "texts")
    labels = scratch.write(met.withColumn("component", F.col("id")), "labels")
    key, edges = ["pos", "val"], None
    for step in range(STAR_ROUNDS + 1):
        placed = lists.join(labels.toDF("rep", "comp"), "rep")
        mixed = placed.groupBy(*key).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        placed, n = scratch.write_counting(placed.join(mixed.select(*key), key), "placed")
        if not n:
            break
        if step < STAR_ROUNDS:
            sizes = placed.groupBy(*key, "comp").agg(F.count("*").alias("n"))
            main = sizes.groupBy(*key).agg(F.max(F.struct("n", "comp")).alias("m")).select(*key, F.col("m.comp").alias("main"))
            few = placed if step == 0 else placed.join(main, key).where("comp <> main")
            # one leader for each representative: the weightiest of another component in its
            # lists, at first of all members, then of those outside the largest component
            heads = few.groupBy(*key).agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), "comp")).alias("head"))
            pairs = few.join(heads, key).where("comp <> head.comp").groupBy(F.col("rep").alias("a")).agg((-F.max(F.struct("head.weight", "head.minus"))["minus"]).alias("b"))
        else:
            open_ = scratch.write(placed.select(F.col("rep").alias("id"), F.col("comp").alias("component")).distinct(), "open")
            pairs = prefix_pairs(scratch, texts.join(open_.select("id"), "id", "left_semi"), open_, width, percent)
        found, n = scratch.write_counting(_collide(pairs, reps, matches, percent), "pairs")
        links, n = scratch.write_counting(confirm(found, texts, width, percent), "links") if n else (None, 0)
        if not n:
            continue
        edges = links if edges is None else edges.union(links)
        known = min_components(scratch, edges).withColumnRenamed("component", "c")
        labels = scratch.write(met.join(known, "id", "left").select("id", F.coalesce("c", "id").alias("component")), "labels")
        scratch.drop(placed)
    scratch.drop(texts, lists)
    return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES, matches: int = MATCHES, width: int = WIDTH, percent: tuple[int, int] = SIMILAR, scratch: Scratch | None = None
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, class_id (the least id with
    the same shingle set), component_id, kept."""
    scratch = scratch or Scratch(docs.sparkSession)
    signed = scratch.write(sign(docs, id_col, text_col, coordinates, width), "signed")
    full = signed.where("digest is not null and id is not null")
    reps = scratch.write(full.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "reps")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    labels = link_components(scratch, rows, reps.select("rep", "n", "sig"), matches, coordinates, width, percent)
    classes = reps.select("digest", "rep").join(labels.toDF("rep", "component"), "rep", "left").select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("rep", "id").alias("class_id"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept, one for each id; all rows without an id."""
    scratch = options.pop("scratch", None) or Scratch(docs.sparkSession)
    kept = near_duplicates(docs, id_col, scratch=scratch, **options).where("kept").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows"))
    kept = scratch.write(kept, "kept")
    several = (F.col("__rows") > 1) & F.col("__kept").isNotNull()
    join = lambda k: docs.join(k, docs[id_col].eqNullSafe(k["__kept"]), "left_semi")
    if kept.where(several).isEmpty():
        return join(kept)
    return join(kept.where(~several)).unionByName(join(kept.where(several)).dropDuplicates([id_col]))
