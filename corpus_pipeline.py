"""Five-stage corpus pipeline over ``documents``.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept; all
but the last return the columns of ``documents``. ``run`` writes every stage's result as Parquet in
the shared folder and reads it back for the next.

Defined cases: null ids are kept as they are, each row judged by its own text; extra columns pass through; empty
tables give no rows. The rest is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontam, langid, neardup, packing, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null texts too) and those of no likely language; a tie of two labels is not likely enough."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate component (a null id is the smallest), equal rows once."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; of an id with several texts all rows go; null or empty items are held by none."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; all rows and null texts stay."""
    return pii.redact(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece; null text is the end id alone."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", redaction), ("best_fit_packing", best_fit)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of ``documents`` that the stages keep, as ``best_fit`` gives them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"pipeline-{name}")
    return docs
