"""Nulls everywhere, empty tables, repeated rows and clashing columns, for every operator;
and the registered SQL at the smallest size."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from grantlake.llm import chat, decontaminate, language, licenses, mixing, neardup, quality, queries, secrets, tokenids, warc
from grantlake.llm._shared import Scratch
from grantlake.llm.sql import OP7, SQL

DOCS = "doc_id long, text string, lang string, source string"
SF = "/root/testdata/sf0.001"


def _warc(df):
    pages = df.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *[c for c in df.columns if c not in ("doc_id", "text", "source", "url")])
    scratch = Scratch(df.sparkSession)
    warc.write_archive(pages, scratch.path("a"))
    return warc.reconstruct(df.sparkSession, scratch.path("a"))


OPERATORS = {
    "mixing": mixing.plan_mixture,
    "neardup": neardup.near_duplicates,
    "dedup": neardup.dedup,
    "decontaminate": lambda d: decontaminate.remove(d, d.select(F.col("doc_id").alias("item_id"), F.lit("all RIGHTS reserved x").alias("text"))),
    "language": lambda d: language.predict(d, language.fit(d), [F.col("doc_id")]),
    "warc": _warc,
    "quality": quality.score,
    "chat": lambda d: chat.thread(d.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("source").alias("role"), "text", *[c for c in d.columns if c not in ("doc_id", "text", "role", "source")])),
    "licenses": licenses.scan,
    "secrets": lambda d: secrets.render(secrets.scan(d)),
    "tokens": lambda d: tokenids.token_table(d, queries.tokenizer_path()),
}


LONG = "word " * 30_000
ODD = [(None, None, None, None), (1, None, None, None), (2, "", None, "a"), (3, "x", "en", None), (3, "x", "en", None), (4, "All rights reserved.\n> x", "en", "b"), (5, LONG, "en", "b")]
_SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
_NONE = _SHA("")
#: What each operator says of these rows: columns, and one tuple a row.
WANT = {
    "mixing": ("doc_id, size, source_size", [(None, 0, 2), (1, 0, 2), (2, 0, 0), (3, 1, 2), (3, 1, 2), (4, 5, 30005), (5, 30000, 30005)]),
    "neardup": ("doc_id, n_shingles, component_id, kept", [(None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 4, True), (5, 1, 5, True)]),
    "dedup": ("doc_id, source", [(None, None), (1, None), (2, "a"), (3, None), (4, "b"), (5, "b")]),
    "decontaminate": ("doc_id, source", [(None, None), (1, None), (2, "a"), (3, None), (3, None), (5, "b")]),
    "language": ("doc_id, lang_pred, accepted", [(None, "und", False), (1, "und", False), (2, "und", False), (3, "en", True), (3, "en", True), (4, "en", True), (5, "en", True)]),
    "warc": ("record_id, record_type, refers_to, payload_digest", [(None, "response", None, _NONE), (1, "response", None, _NONE), (2, "response", None, _NONE), (3, "response", None, _SHA("x")), (3, "response", None, _SHA("x")), (4, "response", None, _SHA(ODD[5][1])), (5, "response", None, _SHA(LONG))]),
    "quality": ("doc_id, n_words, n_repeat_words, n_lines, base_failed, kept", [(None, 0, 0, 0, True, False), (1, 0, 0, 0, True, False), (2, 0, 0, 0, True, False), (3, 1, 0, 1, True, False), (3, 1, 0, 1, True, False), (4, 5, 0, 2, True, False), (5, 30000, 30000, 1, True, False)]),
    "chat": ("conv_id, turn, position, n_quotes, n_linked, content", [(None, None, 0, 0, 0, ""), (1, 1, 0, 0, 0, ""), (2, 2, 0, 0, 0, ""), (3, 3, 0, 0, 0, "x"), (3, 3, 1, 0, 0, "x"), (4, 4, 0, 1, 0, "All rights reserved."), (5, 5, 0, 0, 0, LONG.strip())]),
    "licenses": ("doc_id, n_words, n_base, first_word, last_word, labels", [(None, 0, 0, None, None, ""), (1, 0, 0, None, None, ""), (2, 0, 0, None, None, ""), (3, 1, 0, None, None, ""), (3, 1, 0, None, None, ""), (4, 4, 1, 0, 0, "reserved"), (5, 30000, 0, None, None, "")]),
    "secrets": ("doc_id, n_assign, n_hex, base_sha256, spans", [(i, 0, 0, _NONE, "") for i in (None, 1, 2, 3, 3, 4, 5)]),
    "tokens": ("doc_id, start", [(None, 0), (1, 1), (2, 2)]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    """Nulls, empty, repeated and very long texts beside columns with the names of results: each row's result."""
    df = spark.createDataFrame(ODD, DOCS)
    clash = df.withColumns({c: F.lit("clash") for c in ("size", "target", "copies", "kept", "n_words", "component_id", "sig", "n_tokens", "start", "score", "digest", "content", "spans", "extra")})
    columns, want = WANT[name]
    got = sorted((tuple(r) for r in OPERATORS[name](clash).select(*columns.split(", ")).collect()), key=lambda r: tuple((x is not None, x) for x in r))
    assert got[: len(want)] == want and len(got) == (len(ODD) if name == "tokens" else len(want))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("name", SQL)
@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(SQL[name])
    got = queries.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda it: sorted(map(repr, it))
    assert rows(tuple(r) for r in got.select(*order).collect()) == rows(want.project(", ".join(order)).fetchall())


def test_quotes_against_sql(spark):
    rows = [(1, 0, "a", "Hello there everyone. This is the first message!\nSecond line is here"), (1, 1, "b", "I think we should go to Paris. What about you?"), (1, 2, "a", "On Monday bob wrote:\n> I think we should\n> go to Paris.\nYes, agreed fully.")]
    rows += [(1, 3, "c", "> Hello there everyone.\n> > nothing matched here\nLate reply to the first"), (1, 4, "c", "more of the same branch"), (1, 5, "d", ">> Hello there everyone.\n> Late reply to the first\nDeep answer now")]
    rows += [(2, 0, "a", "the first half of it\ncontinues here and ends. Ja."), (2, 1, "b", "I agree."), (2, 2, "c", "> the first half of it\n> continues here and ends.\nYes."), (2, 3, "d", "> I agree.\n> > Ja.\nSo do I."), (2, 4, "e", "> > Ja.\n> !\nA third")]
    rows += [(None, 3, "z", "null conv message here"), (None, None, "z", "> null conv message here\nzz"), (3, 5, "q", "> not found quote text")]
    rows += [(9, k, "r", f"message number {k} says something\nline two of {k}" if k % 7 else f"> message number {max(k - 5, 0)} says something\nreply {k} goes here") for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.thread(df)
    conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by the SQL
    want = duckdb.sql(OP7).project(", ".join(got.columns)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    first = {r["turn"]: r for r in got.where("conv_id = 1").collect()}
    assert [t for t, r in sorted(first.items(), key=lambda x: x[1]["position"])] == [0, 3, 4, 1, 2, 5]
    assert first[2]["parent_turn"] == 1 and first[2]["content"] == "Yes, agreed fully."


def test_wrapped_and_short_quotes_link(spark):
    rows = [(1, 0, "a", "the first half of it\ncontinues here and ends. Unrelated words follow."), (1, 1, "b", "I agree."), (1, 2, "c", "> the first half of it\n> continues here and ends.\nYes."), (1, 3, "d", "> I agree.\nSo do I.")]
    got = {r["turn"]: r for r in chat.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[t]["parent_turn"], got[t]["n_linked"]) for t in range(4)] == [(None, 0), (0, 0), (0, 1), (1, 1)]
