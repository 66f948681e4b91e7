"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.llm import chat, decontaminate, divergence, language, licenses, mixing, neardup, negatives, quality, secrets, tokenids, topk, warc
from grantlake.llm._shared import Scratch
from grantlake.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mixture(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.fit(docs.where(~held_out))
    return language.predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = scratch.path("archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, scratch=scratch)
    return warc.reconstruct(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs).select("doc_id", *quality.BASE, "base_failed", "kept")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.thread(table(spark, sf_dir, "conversations"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secrets.render(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("id") % 100 == 0)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


QUERIES = {"op1_mixing": op1_mixing, "op2_minhash": op2_minhash, "op3_decontaminate": op3_decontaminate, "op4_language": op4_language, "op5_warc": op5_warc, "op6_quality": op6_quality, "op7_chat": op7_chat, "op8_licenses": op8_licenses, "op9_secrets": op9_secrets, "op10_tokens": op10_tokens, "op11_negatives": op11_negatives, "op12_divergence": op12_divergence, "op13_topk": op13_topk}
