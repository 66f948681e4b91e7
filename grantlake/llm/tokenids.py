"""Token-id files of directly addressable codes.

Documents are range-partitioned and sorted by id, encoded with a public
tokenizer, and packed into segments. A segment splits its ids into chunks of
``CHUNK_BITS``: level 0 holds the low chunk of every id, level k the next chunk of
those ids that need more. One bitmap a level says which ids continue, and a rank
directory gives the number of set bits before every ``RANK_BLOCK`` bits, so the
token at any place is found by a few lookups without decoding its neighbours.

Segment layout (little endian): magic, version, number of documents, tokens and
levels; tokens before it in its partition; doc ids and null flags; document
starts; then for each level its length, chunks, bitmap and rank directory.

A table of segments is written with Spark's own writer, so it can go to any
store that Spark reaches, and read back segment by segment.

Defined cases: a null or empty text has the end id alone; a null doc_id comes
first; rows that repeat follow one another, ordered by text; texts are encoded
whole; an empty table gives no segments and no rows.
"""

from __future__ import annotations

import struct
import threading
import zlib
from contextlib import contextmanager
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.llm._shared import Scratch, offsets, ship, slices, trim
from grantlake.llm._words import BLANK, string_buffers

CHUNK_BITS, RANK_BLOCK, END_ID = 8, 512, 1
SEGMENT_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sIQQIQ")
_MAGIC = b"DAC1"
_SEGMENTS = "part int, base long, n_docs long, n_tokens long, blob binary"
_CACHE_WORDS, IDLE_SECONDS = 800_000, 10

#: Bytes with A-Z in lower case, as the tokenizer will have them, and any ASCII white space as a blank.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
_PLAIN[BLANK] = 0x20


# -- encoding ---------------------------------------------------------------


class Encoder:
    """Ids of whole texts. Text between ASCII white space is encoded once a
    process and kept: the tokenizer drops white space and never joins across it.
    That holds for tokenizers whose pre-tokenization splits at white space and
    between letters and stops (``by_words``); others get the whole text.

    Where the model marks word ends in its pieces, new words of lower-case
    letters alone go to it joined by blanks, without the steps that leave them as they are."""

    def __init__(self, path: str, by_words: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare, suffix = None, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if by_words and suffix:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.reset()

    def reset(self) -> None:
        self.places: dict[str, int] = {"": 1}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 1
        self.flat[0] = END_ID
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.starts[1] = self.lengths[0] = 1  # word 0 is the end of a document, word 1 has no ids
        self.n = 2

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep the ids of new words, one word's after the other's."""
        n, used = self.n + len(words), self.used + len(ids)
        if used > len(self.flat):
            self.flat = np.resize(self.flat, used + used // 2)
        if n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, n + n // 2), np.resize(self.lengths, n + n // 2)
        self.flat[self.used : used] = ids
        self.lengths[self.n : n] = lengths
        self.starts[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.places.update(zip(words, range(self.n, n), strict=True))
        self.used, self.n = used, n

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words in a row, end of each word's)."""
        sizes = self.lengths[index]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.flat[np.repeat(self.starts[index] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _by_model(self, words: list[str]) -> None:
        joined = [" ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(words) and (not len(ends) or ends[-1] == len(ids)):
            self._add(words, ids, np.diff(ends, prepend=0))
        else:
            self._by_tokenizer(words)

    def _by_tokenizer(self, words: list[str]) -> None:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._add(words, np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))

    def _learn(self, words: list[str]) -> None:
        """Encode words; a tail of stops after a letter or digit is a word of its own."""
        tailed, heads, tails, known = [], [], [], self.places
        new: dict[str, None] = {}
        for w in words:
            head = w.rstrip(".,")
            if len(head) < len(w) and head and head[-1].isalnum():
                tail = w[len(head) :]
                tailed.append(w)
                heads.append(head)
                tails.append(tail)
                if tail not in known:
                    new[tail] = None
                if head in known:
                    continue
            else:
                head = w
            new[head] = None
        plain = [w for w in new if w.isalpha() and w == w.lower() and is_normalized("NFC", w)] if self.bare else []
        self._by_model(plain)
        self._by_tokenizer([w for w in new if w not in known])
        both = np.fromiter(chain.from_iterable((known[a], known[b]) for a, b in zip(heads, tails, strict=True)), np.int64, 2 * len(heads))
        ids, ends = self._gather(both)
        self._add(tailed, ids, np.diff(ends[1::2], prepend=0))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END_ID at its end; start of each text)."""
        column = column.fill_null("") if column.null_count else column
        if not self.by_words or any(pc.any(pc.match_substring(column, s, ignore_case=True)).as_py() for s in self.special):
            lists = [e.ids + [END_ID] for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
            sizes = np.array([len(x) for x in lists], np.int64)
            return np.concatenate([np.array(x, np.uint32) for x in lists]), np.concatenate([[0], np.cumsum(sizes)])
        if self.n > _CACHE_WORDS:
            self.reset()
        data, edges = string_buffers(column)
        plain = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(edges)), pa.py_buffer(_PLAIN[data]))
        words = pc.split_pattern(plain, " ")  # neighbouring blanks give empty words, which have no ids
        edges = np.asarray(words.offsets, np.int64)
        coded = words.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        place = np.fromiter(map(self.places.get, vocabulary, repeat(-1)), np.int64, len(vocabulary))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            missed = [vocabulary[i] for i in missing]
            self._learn(missed)
            place[missing] = np.fromiter(map(self.places.__getitem__, missed), np.int64, len(missed))
        index = np.asarray(coded.indices)
        index = place[index] if len(index) else np.zeros(0, np.int64)
        edges = edges - edges[0]
        ids, ends = self._gather(np.insert(index, edges[1:], 0))  # the end of each document goes in
        closing = edges[1:] + np.arange(len(edges) - 1)
        return ids, np.concatenate([[0], ends[closing]])


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


_IN_USE = threading.Lock()
_REST: list[threading.Timer] = []


def encoder(path: str, by_words: bool) -> Encoder:
    if (path, by_words) not in _ENCODERS:
        _ENCODERS[path, by_words] = Encoder(path, by_words)
    return _ENCODERS[path, by_words]


def _rest() -> None:
    """Forget kept words: a worker that has nothing to encode shall hold no memory."""
    if _IN_USE.acquire(blocking=False):
        try:
            for e in _ENCODERS.values():
                e.reset()
            trim()
        finally:
            _IN_USE.release()


@contextmanager
def encoding():
    """Around a task's encoding; after IDLE_SECONDS without another, kept words go."""
    with _IN_USE:
        while _REST:
            _REST.pop().cancel()
        yield
        _REST.append(threading.Timer(IDLE_SECONDS, _rest))
        _REST[-1].daemon = True
        _REST[-1].start()


# -- directly addressable codes ----------------------------------------------


def pack(ids: np.ndarray, doc_ids: list, starts: np.ndarray, base: int = 0) -> bytes:
    levels, now = [], ids.astype(np.uint64)
    while True:
        rest = now >> np.uint64(CHUNK_BITS)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        pad = np.zeros(-(-max(len(more), 1) // RANK_BLOCK) * (RANK_BLOCK // 8), np.uint8)
        pad[: len(bits)] = bits
        counts = np.bitwise_count(pad).reshape(-1, RANK_BLOCK // 8).sum(1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint64)
        levels.append(struct.pack("<Q", len(now)) + (now & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes() + pad.tobytes() + ranks.tobytes())
        now = rest[more]
        if not len(now):
            break
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([0 if d is None else d for d in doc_ids], np.int64)
    head = _HEAD.pack(_MAGIC, 1, len(doc_ids), len(ids), len(levels), base)
    return b"".join([head, docs.tobytes(), nulls.tobytes(), starts.astype(np.int64).tobytes(), *levels])


class Segment:
    """A packed segment; nothing is decoded until it is asked for."""

    def __init__(self, blob: bytes):
        magic, version, self.n_docs, self.n_tokens, n_levels, self.base = _HEAD.unpack_from(blob)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        docs, nulls = take(np.int64, self.n_docs), take(np.uint8, self.n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(docs, nulls, strict=True)]
        self.starts = take(np.int64, self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take(np.uint64, 1)[0])
            blocks = -(-max(n, 1) // RANK_BLOCK)
            self.levels.append((take(np.uint8, n), take(np.uint8, blocks * (RANK_BLOCK // 8)), take(np.uint64, blocks)))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i: the directory, whole bytes, then the rest of a byte."""
        if i >= len(bits) * 8:
            return int(ranks[-1]) + int(np.bitwise_count(bits[(len(ranks) - 1) * (RANK_BLOCK // 8) :]).sum())
        block, byte = i // RANK_BLOCK, i // 8
        within = int(np.bitwise_count(bits[block * (RANK_BLOCK // 8) : byte]).sum())
        return int(ranks[block]) + within + (int(bits[byte]) & ((1 << (i % 8)) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The id at place i of the segment."""
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i = self._rank(bits, ranks, i)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids at places start to stop."""
        out, where = np.zeros(stop - start, np.uint64), np.arange(stop - start)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[start:stop].astype(np.uint64) << np.uint64(CHUNK_BITS * k)
            first = start // 8
            more = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            where = where[more]
            if not len(where):
                break
            start, stop = self._rank(bits, ranks, start), self._rank(bits, ranks, stop)
        return out

    def documents(self):
        """(place in the partition, doc_id, ids) of each document."""
        ids = self.tokens(0, self.n_tokens)
        for i, doc in enumerate(self.doc_ids):
            yield self.base + int(self.starts[i]), doc, ids[self.starts[i] : self.starts[i + 1]]


# -- Spark --------------------------------------------------------------------


def _write(batches, path: str, by_words: bool):
    with encoding():
        yield from _segments(batches, path, by_words)
    trim()


def _segments(batches, path: str, by_words: bool):
    coder, base, part = encoder(path, by_words), 0, 0
    held, docs, size = [], [], 0

    def flush():
        nonlocal base, held, docs, size
        ids = np.concatenate([x for x, _ in held])
        lengths = np.concatenate([np.diff(s) for _, s in held])
        blob = pack(ids, docs, np.concatenate([[0], np.cumsum(lengths)]), base)
        row = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([base]), pa.array([len(docs)]), pa.array([len(ids)]), pa.array([blob], pa.binary())], ["part", "base", "n_docs", "n_tokens", "blob"]
        )
        base, held, docs, size = base + len(ids), [], [], 0
        return row

    for batch in slices(batches, 6 << 20):
        if not batch.num_rows:
            continue
        part = batch.column(2)[0].as_py()
        ids, starts = coder.encode(batch.column(1))
        held.append((ids, starts))
        docs += batch.column(0).to_pylist()
        size += len(ids)
        if size >= SEGMENT_TOKENS:
            yield flush()
    if docs:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", by_words: bool = True, partitions: int | None = None) -> None:
    """Encode ``docs`` in ascending id order into token files under ``path``."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    placed = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    placed.mapInArrow(lambda batches: _write(batches, tokenizer, by_words), _SEGMENTS).write.option("compression", "zstd").parquet(path)


def _read(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            part, seg = batch.column(0)[k].as_py(), Segment(batch.column(1)[k].as_buffer().to_pybytes())
            rows = [(part, at, doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for at, doc, ids in seg.documents()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)], ["__part", "at", "doc_id", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the token files alone."""
    ship(spark)
    files = spark.read.schema(_SEGMENTS).parquet(path)
    before = offsets(files.groupBy(F.col("part").alias("__part")).agg(F.sum("n_tokens").alias("n")), "n")
    rows = files.select("part", "blob").mapInArrow(_read, "__part int, at long, doc_id long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "__part").select("doc_id", (F.col("__before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, scratch: Scratch | None = None, **options) -> DataFrame:
    """Write token files to the shared folder and read them back."""
    scratch = scratch or Scratch(docs.sparkSession)
    path = scratch.path("tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
