"""Benchmark decontamination by latent semantic retrieval.

1. ``encode``: one scan turns each text into codes of the benchmark's words (0
   for any other word) and writes them to the shared folder.
2. Passages of ``PASSAGE`` words give document frequencies, then TF-IDF rows A,
   over the whole corpus. A randomised SVD sketches A'A with a random test matrix:
   every partition sums its part of A'AW, the parts are added block by block of terms,
   and the driver factors the (terms x sketch) sum (Nystrom). The benchmark's own
   passages join A with as much weight as the corpus, so that the latent space spans them.
3. Windows of about an item's length slide over each text and are compared with the
   items of that length by cosine. Only windows that step 4 would refuse in any case are left
   out: those whose surroundings hold fewer benchmark words, or lighter ones (by inverse
   frequency), than the lightest ``LOW`` of any of these items, and of the pairs of window and item
   above the cosine those whose surroundings do not hold ``LOW`` of the item's words in any order. Runs of
   ``RUN_WORDS`` words that an item has are looked up by hash, whatever stands around them.
4. Candidates are checked word by word: the longest common subsequence of item
   and surroundings must cover ``COVER`` of the item, or ``LOW`` of it if the window's cosine is at least ``CLOSE``
   (words replaced), or ``COVER`` of it once the item is cut in two and its parts change places (clauses swapped, the same cosine),
   both only if the words that they share have ``HEAVY`` of the item's weight, so that frequent words alone are no paraphrase (``LEAST_HEAVY`` of it for ``COVER`` in order);
   and half of its ending (the answer) must be there, unless nearly all of the item is. A long run of the
   item's words in a row counts as well. Of 200 items of the test tables planted among other words, all are found word for word or
   with swapped halves, 97 % with each word replaced by chance 0.2 and 85 % by 0.3; in 2,500 texts nothing else is.

Benchmark items are a stated query set. They are taken in blocks of ``BLOCK_ITEMS`` items or ``BLOCK_WORDS`` words, each
held against all rows, so what is sent to tasks is bounded
by the block. Words are runs of letters, digits and characters beyond ASCII, in lower
case, so that neither case nor marks hide an item.

Items of fewer than ``LEAST_WORDS`` words are looked up whole, word for word, apart
from the latent search; as they may occur by chance, their rows are told by a null cosine. ``find`` reports
them down to one word; ``remove`` keeps texts that hold no more than items of fewer than ``REMOVE_WORDS`` words (a parameter), as
one or two words stand in clean texts, too.

Defined cases: null or empty texts match nothing; texts of any length are searched whole; items without words, null ones included, are not searched for; items and rows that repeat are reported for each id once,
of equally good places the first; a null id is reported as null; an empty table on either side gives no matches; other
columns are ignored. ``remove`` goes by the text, not the id: rows with a null or repeated id go or stay by what they hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.llm._shared import Scratch, ship, slices
from grantlake.llm._words import MARKS, word_hashes

PASSAGE, RANK, OVERSAMPLE, LEAST_WORDS = 64, 48, 8, 8
#: A block of the benchmark ends with the item that brings it to so many items or words.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 500_000
#: Texts go for items of so many words or more.
REMOVE_WORDS = 3
#: Window lengths grow by this factor and step by a third of themselves.
RATIO, STEPS = 1.5, 3
COSINE, COVER, SURE, ANSWER_WORDS = 0.5, 0.75, 0.9, 4
#: A paraphrase: so near in the latent space, so much of it in order will do, with such a part of its weight (inverse frequencies).
CLOSE, LOW, HEAVY = 0.7, 0.6, 0.5
#: And of any match that is not nearly the whole item or a long run.
LEAST_HEAVY = 1 / 3
#: So many words in a row count as the item, too, if they are this share of it.
RUN_WORDS, RUN_SHARE = 20, 0.4
_TERMS = 64  # terms of one block of the sketch
#: At least so many tasks emit a part of the sketch each, more if the cluster runs more at once; so many parts are added in one task.
PARTS, FAN_IN = 256, 64
_CELLS = 1 << 22  # numbers in one matrix of the search
_PART = ["block", "n", "part"]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pc.utf8_lower(column), MARKS)


# -- one block of the benchmark ------------------------------------------------


class Items:
    """The benchmark items of a block, as codes of their words."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        hashes, at = words(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(hashes)
        codes = np.searchsorted(self.vocabulary, hashes) + 1
        rows = [(i, codes[at[k] : at[k + 1]]) for k, i in enumerate(ids) if at[k + 1] - at[k] >= LEAST_WORDS]
        self.ids, self.codes = [i for i, _ in rows], [c for _, c in rows]
        short = [(i, codes[at[k] : at[k + 1]]) for k, i in enumerate(ids) if 0 < at[k + 1] - at[k] < LEAST_WORDS]
        self.short = [([i for i, c in short if len(c) == n], Runs([c for _, c in short if len(c) == n], n)) for n in sorted({len(c) for _, c in short})]
        self.terms = len(self.vocabulary)
        self.bits = np.zeros(1 << 20, bool)  # most other words stop here
        self.bits[self.vocabulary >> np.uint64(44)] = True

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), self.terms - 1)
        same = self.vocabulary[place] == hashes[maybe]
        out[maybe[same]] = place[same] + 1
        return out

    def windows(self) -> dict[int, np.ndarray]:
        """Window length -> items that it searches for."""
        sizes = np.array([len(c) for c in self.codes])
        step = np.maximum(0, np.round(np.log(sizes / LEAST_WORDS) / np.log(RATIO))).astype(int)
        return {int(round(LEAST_WORDS * RATIO**s)): np.flatnonzero(step == s) for s in np.unique(step)}


# -- passages, frequencies, sketch ----------------------------------------------


def passages(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, term, count) of all known words, and the number of passages."""
    sizes = np.array([len(c) for c in codes], np.int64)
    number = -(-sizes // PASSAGE)
    before = np.cumsum(number) - number
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(before, sizes) + place // PASSAGE
    known = flat > 0
    terms = int(flat.max(initial=0)) + 1
    key, count = np.unique(passage[known] * terms + flat[known], return_counts=True)
    return key // terms, key % terms - 1, count, int(number.sum())


def _frequency(batches, terms: int):
    total, n = np.zeros(terms, np.int64), 0
    for codes, _ in _read_codes(batches):
        _, term, _, number = passages(codes)
        total += np.bincount(term, minlength=terms)
        n += number
    for at in range(0, terms, _TERMS):
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([total[at : at + _TERMS].astype(np.float64).tobytes()], pa.binary())], _PART)


def _rows(passage, term, count, idf):
    """Weights of TF-IDF rows of length 1."""
    weight = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(passage, weight * weight))
    return weight / np.maximum(norm[passage], 1e-12)


def sketch(codes: list[np.ndarray], idf: np.ndarray, test: np.ndarray) -> np.ndarray:
    """A'A times the test matrix, for the passages of these texts."""
    passage, term, count, _ = passages(codes)
    out = np.zeros((len(idf), test.shape[1]))
    if not len(passage):
        return out
    weight = _rows(passage, term, count, idf)
    row = np.cumsum(np.diff(passage, prepend=passage[0]) > 0)
    for k, column in enumerate(np.ascontiguousarray(test.T, np.float64)):
        y = np.bincount(row, weight * column[term])
        out[:, k] = np.bincount(term, weight * y[row], len(idf))
    return out


def _sketch(batches, idf, test):
    total = np.zeros((len(idf), test.shape[1]))
    for codes, _ in _read_codes(batches):
        total += sketch(codes, idf, test)
    for at in range(0, len(idf), _TERMS):
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([0], pa.int64()), pa.array([total[at : at + _TERMS].tobytes()], pa.binary())], _PART)


def _add(parts: DataFrame, tasks: int) -> tuple[int, np.ndarray]:
    """Sum blocks of numbers of up to ``tasks`` tasks on the executors, FAN_IN parts in a task, level by level; the driver
    gets one copy."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "n": [pdf["n"].sum()], "part": [sum(np.frombuffer(p) for p in pdf["part"]).tobytes()]})

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        return total(pdf).assign(of=pdf["of"].iloc[0] // FAN_IN)

    parts = parts.withColumn("of", F.spark_partition_id())
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.groupBy("block", F.floor(F.col("of") / FAN_IN)).applyInPandas(level, "block int, n long, part binary, of int")
    rows = sorted(parts.groupBy("block").applyInPandas(total, "block int, n long, part binary").collect(), key=lambda r: r["block"])
    return (rows[0]["n"] if rows else 0), np.concatenate([np.frombuffer(r["part"]) for r in rows]) if rows else np.zeros(0)


def factor(total: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) of A from A'A times ``test``."""
    core = test.T.astype(np.float64) @ total
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(initial=0), 1e-30)
    root = vectors[:, good] / np.sqrt(values[good])
    u, s, _ = np.linalg.svd(total @ root, full_matrices=False)
    keep = slice(0, min(RANK, int((s > 1e-6 * s[0]).sum()) if len(s) else 0))
    return u[:, keep], s[keep]


# -- search ---------------------------------------------------------------------


def _prefixes(a: list[int], b: list[int]) -> int:
    """Bits whose zeros below place k count the longest common subsequence of a[:k] and b."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    return len(a) - _prefixes(a.tolist(), b.tolist()).bit_count()


def swapped(a: np.ndarray, b: np.ndarray) -> int:
    """The most words of ``a`` that ``b`` has in order once ``a`` is cut in two and its parts change places: over all cuts
    of both, the end of ``a`` in the beginning of ``b`` and its beginning in the rest."""
    x, best, n = a.tolist(), 0, len(a)
    y = [w for w in b.tolist() if w in set(x)]
    bits = lambda v: np.array([*map(int, bin(v | 1 << n)[:2:-1])], np.int64)
    for j in range(1, len(y)):
        begin = np.cumsum(1 - bits(_prefixes(x, y[j:])))  # of a[:k], k = 1..n
        end = np.cumsum(1 - bits(_prefixes(x[::-1], y[:j][::-1])))  # of the last 1..n words
        best = max(best, int((begin[:-1] + end[:-1][::-1]).max(initial=0)))
    return best


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of words that both have."""
    best, row = 0, np.zeros(len(b) + 1, np.int64)
    for x in a:
        now = np.zeros_like(row)
        now[1:] = np.where(b == x, row[:-1] + 1, 0)
        best, row = max(best, int(now.max())), now
    return best


class Runs:
    """All runs of ``size`` words of some sequences of codes, by hash."""

    def __init__(self, sequences: list[np.ndarray], size: int):
        sizes = np.array([len(c) for c in sequences], np.int64)
        number = np.maximum(0, sizes - size + 1)
        owner = np.repeat(np.arange(len(sizes)), number)
        offset = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        self.size, self.flat = size, np.concatenate([*sequences, np.zeros(0, np.int32)])
        start = (np.cumsum(sizes) - sizes)[owner] + offset
        key = self._hash(self.flat[start + j] for j in range(size)) if len(start) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.offset, self.start = key[order], owner[order], offset[order], start[order]

    @staticmethod
    def _hash(columns) -> np.ndarray:
        out = np.uint64(0)
        for c in columns:
            out = out * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
        return out

    def find(self, flat: np.ndarray, known: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, owner, offset) of every run in ``flat``; ``known`` sums the words with
        a code before each place, ``stop`` is the end of each place's text."""
        n = len(flat) - self.size + 1
        if n <= 0 or not len(self.key):
            return (np.zeros(0, np.int64),) * 3
        place = np.flatnonzero(known[self.size :] - known[:n] == self.size)
        place = place[place + self.size <= stop[place]]
        key = self._hash(flat[place + j] for j in range(self.size)) if len(place) else np.zeros(0, np.uint64)
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        number = high - low
        place, row = np.repeat(place, number), np.repeat(low - np.cumsum(number) + number, number) + np.arange(number.sum())
        steps = np.arange(self.size)
        same = (flat[place[:, None] + steps] == self.flat[self.start[row][:, None] + steps]).all(1)
        return place[same], self.owner[row[same]], self.offset[row[same]]


class Searcher:
    def __init__(self, items: Items, latent: np.ndarray, idf: np.ndarray):
        # row 0 is of words outside the benchmark
        self.weight = np.concatenate([[0.0], idf])
        self.items, self.latent = items, np.concatenate([np.zeros((1, latent.shape[1])), latent]).astype(np.float32)
        self.groups = []
        for size, group in items.windows().items():
            own = [items.codes[i] for i in group]
            most = [int(np.ceil(LOW * len(c))) for c in own]
            # the least that the surroundings of an accepted window hold
            least = min(np.sort(self.weight[c])[:m].sum() for c, m in zip(own, most, strict=True))
            pad = max(self._pad(len(c), size) for c in own)
            self.groups.append((size, group, (least * (1 - 1e-9) - 1e-9, min(most), pad), self._unit(np.stack([self.latent[c].sum(0) for c in own]))))
        self.runs = Runs(items.codes, RUN_WORDS)
        self.sizes = np.array([len(c) for c in items.codes], np.int64)
        self.flat, self.begin = np.concatenate([*items.codes, np.zeros(0, np.int32)]), np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _pad(length: int, size: int) -> int:
        return max(length, size) - size + -(-size // STEPS)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def candidates(self, codes: list[np.ndarray]):
        """(text, item, start, length, cosine) arrays for windows above COSINE and for
        the places of an item that a run of its words points to."""
        sizes = np.array([len(c) for c in codes], np.int64)
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate(codes)
        mass = np.concatenate([[0.0], np.cumsum(self.weight[flat])])
        sums = np.zeros((self.latent.shape[1], len(flat) + 1))  # of the vectors of the words before each place
        for k, direction in enumerate(np.ascontiguousarray(self.latent.T)):
            np.cumsum(direction[flat], dtype=np.float64, out=sums[k, 1:])
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        end = begin + sizes
        place, item, offset = self.runs.find(flat, known, np.repeat(end, sizes))
        text = np.searchsorted(end, place, "right")
        # one row for each text, item and shift
        runs = np.unique(np.stack([text, item, place - offset]), axis=1).astype(np.int64) if len(place) else np.zeros((3, 0), np.int64)
        for t, i, at in runs.T.tolist():
            words = self.items.codes[i]
            start, stop = max(at, int(begin[t])), min(at + len(words), int(end[t]))
            cos = self._unit(self.latent[flat[start:stop]].sum(0)[None]) @ self._unit(self.latent[words].sum(0)[None]).T
            yield np.array([t]), np.array([i]), np.array([start - begin[t]]), np.array([stop - start]), cos[0]  # as few as there are runs
        for size, group, (least, fewest, pad), targets in self.groups:
            step = max(1, size // STEPS)
            number = np.where(sizes > 0, np.maximum(0, -(-(sizes - size) // step)) + 1, 0)
            text = np.repeat(np.arange(len(codes)), number)
            k = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            start = begin[text] + np.maximum(0, np.minimum(k * step, sizes[text] - size))
            stop = np.minimum(start + size, begin[text] + sizes[text])
            low, high = np.maximum(start - pad, begin[text]), np.minimum(start + size + pad, end[text])
            enough = (known[high] - known[low] >= fewest) & (mass[high] - mass[low] >= least)
            text, start, stop = text[enough], start[enough], stop[enough]
            rows = max(64, _CELLS // max(len(group), self.latent.shape[1]))
            for at in range(0, len(text), rows):
                a, b = start[at : at + rows], stop[at : at + rows]
                cos = self._unit((sums.take(b, axis=1, mode="clip") - sums.take(a, axis=1, mode="clip")).T).astype(np.float32) @ targets.T
                w, g = np.nonzero(cos >= COSINE)
                item, t = group[g], text[at + w]
                # the region that step 4 will look at
                pad = np.maximum(self.sizes[item], b[w] - a[w]) - (b[w] - a[w]) - (-(b[w] - a[w]) // STEPS)
                enough = self._present(flat, np.maximum(a[w] - pad, begin[t]), np.minimum(b[w] + pad, end[t]), item)
                w, g, item, t = w[enough], g[enough], item[enough], t[enough]
                yield t, item, a[w] - begin[t], (b - a)[w], cos[w, g]

    def _present(self, flat: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For each region (low, high) of ``flat`` and item: are LOW of the item's words in it at all? Less
        can be no common subsequence of that length, and long runs have their own search."""
        out = np.zeros(len(item), bool)
        regions, which = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        rows = max(1, _CELLS // (self.items.terms + 1))
        for at in range(0, regions.shape[1], rows):
            a, b = regions[0, at : at + rows], regions[1, at : at + rows]
            lengths = b - a
            words = np.repeat(a - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            there = np.zeros((len(a), self.items.terms + 1), bool)
            there[np.repeat(np.arange(len(a)), lengths), flat[words]] = True
            there[:, 0] = False  # of words outside the benchmark
            mine = order[np.searchsorted(which[order], at) : np.searchsorted(which[order], at + len(a))]
            for k in range(0, len(mine), 4096):
                part = mine[k : k + 4096]
                size = self.sizes[item[part]]
                at_word = np.cumsum(size) - size
                word = self.flat[np.arange(size.sum()) - np.repeat(at_word - self.begin[item[part]], size)]
                held = np.add.reduceat(there[np.repeat(which[part] - at, size), word].astype(np.int64), at_word)
                out[part] = held >= np.ceil(LOW * size)
        return out

    def exact(self, codes: list[np.ndarray]) -> list[tuple]:
        """The first place of each short item in each text, as rows of ``search``."""
        if not codes or not self.items.short:
            return []
        sizes = np.array([len(c) for c in codes], np.int64)
        end, flat = np.cumsum(sizes), np.concatenate(codes)
        known, stop, out = np.concatenate([[0], np.cumsum(flat > 0)]), np.repeat(end, sizes), {}
        for ids, runs in self.items.short:
            place, owner, _ = runs.find(flat, known, stop)
            text = np.searchsorted(end, place, "right")
            for t, k, at in zip(text.tolist(), owner.tolist(), (place - (end - sizes)[text]).tolist(), strict=True):
                out.setdefault((t, ids[k]), (t, ids[k], at, at + runs.size, None, 1.0, 1.0))
        return list(out.values())

    def _shared_weight(self, item: np.ndarray, region: np.ndarray) -> float:
        """The part of an item's weight that is in words of the region: little, if all they share is frequent words."""
        weight = self.weight[item]
        return weight[np.isin(item, region)].sum() / weight.sum() if weight.any() else 1.0  # every passage has them all

    def search(self, codes: list[np.ndarray]) -> list[tuple]:
        """(text, item, start, stop, cosine, cover, answer) of accepted matches,
        the best window of each text and item."""
        found = [np.concatenate(x) for x in zip(*self.candidates(codes), strict=True)] if codes else []
        if not found or not len(found[0]):
            return []
        order, best = np.argsort(-found[4], kind="stable"), {}
        for text, item, start, size, cosine in zip(*(x[order].tolist() for x in found), strict=True):
            item_words = self.items.codes[item]
            if best.get((text, item), (0, 0, 0))[1] >= SURE:
                continue
            pad = self._pad(len(item_words), size)
            low, high = max(0, start - pad), start + size + pad
            region = codes[text][low:high]
            length, last = len(item_words), best.get((text, item), (0, 0, 0))[1]
            in_order = lcs(item_words, region)
            answer = item_words[-ANSWER_WORDS:]
            share = lcs(answer, region) / len(answer)
            cover, taken = in_order / length, False
            weight = self._shared_weight(item_words, region)
            if cover >= SURE or (share >= 0.5 and cover >= COVER and weight >= LEAST_HEAVY):
                taken = True
            elif cosine >= CLOSE and share >= 0.5 and weight >= HEAVY:
                if np.isin(item_words, region).sum() >= COVER * length and (moved := swapped(item_words, region)) >= COVER * length:
                    cover, taken = moved / length, True
                taken = taken or cover >= LOW
            if not taken and cover >= RUN_SHARE and in_order >= RUN_WORDS and longest_run(item_words, region) >= max(RUN_WORDS, RUN_SHARE * length):
                taken = True
            if taken and cover > last:
                best[text, item] = (cosine, cover, share, low, min(high, len(codes[text])))
        return [(t, self.items.ids[i], v[3], v[4], v[0], v[1], v[2]) for (t, i), v in best.items()]


# -- Spark ------------------------------------------------------------------------


def _encode(batches, items):
    for batch in slices(batches):
        hashes, at = words(batch.column(1))
        codes = items.encode(hashes)
        narrow = np.uint16 if items.terms < 65535 else np.uint32
        blobs = [codes[at[i] : at[i + 1]].astype(narrow).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([narrow().itemsize] * batch.num_rows, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "width", "codes"])


def _read_codes(batches):
    for batch in slices(batches, 1 << 20):
        width = batch.column(1).to_pylist()
        yield [np.frombuffer(b.as_buffer(), np.uint16 if w == 2 else np.uint32).astype(np.int32) for b, w in zip(batch.column(2), width, strict=True)], batch.column(0)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, start_word, stop_word, cosine, cover, answer): one row for
    each text and item that it holds."""
    return _find(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "long", benchmark, item_col, item_text_col, scratch)


def _find(rows: DataFrame, kind: str, benchmark: DataFrame, item_col: str, item_text_col: str, scratch: Scratch | None) -> DataFrame:
    """``rows``: (doc_id of type ``kind``, text)."""
    spark = rows.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    schema = f"doc_id {kind}, item_id long, start_word long, stop_word long, cosine double, cover double, answer double"
    asked = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t")).where("t is not null").dropDuplicates(["i", "t"]).orderBy("i", "t")
    out, block, size = spark.createDataFrame([], schema), [], 0

    def held(block) -> DataFrame | None:
        items = Items([r["i"] for r in block], [r["t"] for r in block])
        return _search_block(spark, scratch, rows, items, schema) if items.ids or items.short else None

    for row in asked.toLocalIterator():
        block.append(row)
        size += len(words(pa.array([row["t"]], pa.string()))[0])
        if len(block) == BLOCK_ITEMS or size >= BLOCK_WORDS:
            found = held(block)
            out, block, size = out if found is None else out.union(found), [], 0
    found = held(block) if block else None
    out = out if found is None else out.union(found)
    best = F.max(F.struct("cover", "cosine", "answer", (-F.col("start_word")).alias("s"), "stop_word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", (-F.col("m.s")).alias("start_word"), "m.stop_word", "m.cosine", "m.cover", "m.answer")


def _search_block(spark, scratch: Scratch, rows: DataFrame, items: Items, schema: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)  # of BLOCK_ITEMS items and BLOCK_WORDS words, or one longer item
    codes = scratch.write(rows.mapInArrow(lambda batches: _encode(batches, shared.value), f"{schema.split(',')[0]}, width int, codes binary"), "codes")
    terms, parts = items.terms, "block int, n long, part binary"
    tasks = max(PARTS, spark.sparkContext.defaultParallelism)
    some = codes.coalesce(tasks)  # fewer than that stay as they are
    n, df = _add(some.mapInArrow(lambda batches: _frequency(batches, terms), parts), tasks)
    own, term, count, number = passages(items.codes)
    df = (df if len(df) else np.zeros(terms)) + np.bincount(term, minlength=terms)
    idf = np.log((1 + n + number) / (1 + df))
    test = np.random.default_rng(7).standard_normal((terms, RANK + OVERSAMPLE)).astype(np.float32)
    weights = spark.sparkContext.broadcast((idf, test))
    _, total = _add(some.mapInArrow(lambda batches: _sketch(batches, *weights.value), parts), tasks)
    total = total.reshape(terms, -1) if len(total) else np.zeros((terms, RANK + OVERSAMPLE))
    total = total / max(n, 1) + sketch(items.codes, idf, test) / max(number, 1)
    vectors, values = factor(total, test)
    # word vectors: weights in the latent space, each direction to a common scale
    latent = spark.sparkContext.broadcast(Searcher(items, idf[:, None] * vectors / np.sqrt(values), idf))

    def run(batches):
        searcher = latent.value
        for texts, ids in _read_codes(batches):
            found = searcher.search(texts) + searcher.exact(texts)
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(list(c), pa.int64()) for c in columns[1:4]), *(pa.array(list(c), pa.float64()) for c in columns[4:])], [f.split()[0] for f in schema.split(", ")])

    return codes.mapInArrow(run, schema)


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", scratch: Scratch | None = None, least_words: int = REMOVE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item of ``least_words`` words or more, told by the digest of the text."""
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    found = _find(docs.select(F.sha2(text, 256).alias("doc_id"), text.alias("text")), "string", benchmark, item_col, item_text_col, scratch)
    found = found.where(F.col("cosine").isNotNull() | (F.col("stop_word") - F.col("start_word") >= least_words))
    leaks = scratch.write(found, "leaks").select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, F.sha2(text, 256) == F.col("__leak"), "left_anti")
