"""A corpus pipeline of five stages, from quality to packed sequences.

Every stage works on all that its predecessor kept. Documents whose quality score is too low go; of every group of near
copies the one of least id stays; documents that hold a benchmark item go; secrets are replaced by a mark; what is left is
packed into sequences.

Null and empty texts are scored, grouped and packed like others, and hold neither items nor secrets. Null ids stay, except
where their own text is rejected. An empty table stays empty. Other columns than those of `documents` are kept until
the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstrand.llm import common, decontaminate, packing, quality, secrets, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is `quality.KEPT_FROM` or more."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.kept(docs, labels, common.fold_of(F.col("doc_id")) != 0)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    import public_tokenizers

    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express none of the learned stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what passes between two is written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{common.shared_folder(spark)}/stage-{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
