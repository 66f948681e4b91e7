"""The pipeline on empty tables, nulls, repeats, long texts and columns whose names its stages use."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_odd_rows_change_nothing_else(spark, tmp_path):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache(), spark.read.parquet(f"{SF}/benchmark.parquet")
    odd = spark.createDataFrame([(None, None, None, None), (900_001, None, None, None), (900_002, "", None, "a"), (900_003, "x", "en", None), (900_003, "x", "en", None), (900_004, "word " * 30_000, "en", "b")], "doc_id long, text string, lang string, source string")

    def run(rows, name):
        at = f"{tmp_path}/{name}"
        rows.write.parquet(f"{at}/documents.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        return sorted(map(tuple, corpus_pipeline.run(spark, at).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))

    clash = lambda df: df.withColumn("size", F.lit("s")).withColumn("kept", F.lit("k")).withColumn("source_size", F.lit(1))
    want = run(docs, "plain")
    assert want and run(clash(docs.unionByName(odd, allowMissingColumns=True)), "odd") == want
    assert run(docs.limit(0), "empty") == []
