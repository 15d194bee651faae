"""The corpus pipeline: each stage's decisions against its operator's own, and the rows it may touch."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, neardup, quality

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA).cache()
        if name == "sharding":
            assert made.columns == [*columns, "shard"] and made.count() == docs.count() and made.where("shard not between 0 and 1023").isEmpty()
            break
        assert made.columns == columns
        # every row that stays is one of the input's, unchanged
        assert made.distinct().exceptAll(docs.distinct()).isEmpty()
        if name == "quality classifier":
            kept = quality.ranked(docs, spark.read.parquet(f"{DATA}/labels.parquet")).select("doc_id")
            assert made.select("doc_id").exceptAll(kept).isEmpty() and kept.exceptAll(made.select("doc_id")).isEmpty()
        if name == "MinHash near-dedup":
            assert neardup.groups(made).isEmpty()
            want = brute.near_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
            assert {r.doc_id for r in made.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect() if want.get(r.doc_id, r.doc_id) == r.doc_id}
        if name == "mixing to target weights":
            told = mixing.query(docs).groupBy("doc_id").count()
            assert made.groupBy("doc_id").count().exceptAll(told).isEmpty() and made.count() == mixing.query(docs).count()
        if name == "benchmark decontamination":
            bad = decontaminate.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).select("doc_id").distinct()
            assert made.join(bad, "doc_id", "left_semi").isEmpty() and made.count() == docs.join(bad, "doc_id", "left_anti").count()
        docs = made
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.exceptAll(made).isEmpty() and whole.groupBy("shard").agg(F.count(F.lit(1))).count() > 1


def test_stages_with_awkward_rows(spark, tmp_path):
    rows = [(None, "a b c", None), (1, None, "x"), (2, "", ""), (3, "same text here", "x"), (3, "same text here", "x"), (4, "same text here", None), (5, "word " * 20_000, "y"), (3, "another text", "z"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, None, s, len(t) if t else None) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("shard", F.lit("mine"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(20).write.parquet(f"{tmp_path}/{name}.parquet")
    made = corpus_pipeline.run(spark, str(tmp_path))
    assert set(made.columns) == {*docs.columns, "shard_in"} and {r.shard_in for r in made.collect()} == {"mine"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).isEmpty()
