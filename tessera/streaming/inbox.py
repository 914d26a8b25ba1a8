"""A polled inbox of returned annotations as a stream: each micro-batch is merged into versioned snapshots.

Of entries for the same patch the newest counts, ties go to the greater annotator name, so the state is the
same however files fall into batches. A snapshot is written whole under its batch number before a marker of
one row names it, and a batch that is run again after a failure overwrites its own snapshot only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "patch_id string, annotator string, minute bigint, mask_source string"


def newest(entries: DataFrame) -> DataFrame:
    """One row per patch; entries without a patch are dropped, a null minute counts as the oldest."""
    e = entries.filter("patch_id IS NOT NULL")
    order = F.struct(F.coalesce("minute", F.lit(-1)), F.coalesce("annotator", F.lit("")), F.coalesce("mask_source", F.lit("")))
    return e.groupBy("patch_id").agg(F.max_by(F.struct("annotator", "minute", "mask_source"), order).alias("e")).select("patch_id", "e.*")


def snapshot(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """The state after the last whole batch (``before`` a given one); empty if there is none."""
    try:
        last = spark.read.schema("batch bigint").parquet(f"{state}/done").filter(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("batch")).first()[0]
    except AnalysisException as e:  # no batch has been merged yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    return spark.createDataFrame([], ENTRY) if last is None else spark.read.schema(ENTRY).parquet(f"{state}/snapshot-{last}")


def merge(state: str):
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest(snapshot(spark, state, number).unionByName(batch.select("patch_id", "annotator", "minute", "mask_source"))).write.mode("overwrite").parquet(f"{state}/snapshot-{number}")
        spark.range(1).select(F.lit(number).cast("bigint").alias("batch")).write.mode("append").parquet(f"{state}/done")

    return run


def follow(spark: SparkSession, inbox: str, state: str, files_per_batch: int = 100):
    """Starts a query that merges what lies in the JSON inbox and then ends."""
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).json(inbox)
    return stream.filter("mask_source <> 'untouched'").writeStream.foreachBatch(merge(state)).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start()
