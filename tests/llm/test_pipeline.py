from pyspark.sql import functions as F

import corpus_pipeline
from loomstrand.llm import common, decontaminate, packing, queries, secrets

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if k == 2:
            assert decontaminate.contamination(docs, common.table(spark, SF, "benchmark")).count() == 0
        if k == 3:
            assert docs.count() == before.count() and not any(secrets.base_spans(r.text) for r in docs.collect())
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.CAPACITY).count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()


def test_stages_on_an_empty_table(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.QUERIES) <= set(names)
