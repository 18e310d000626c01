"""Streaming forms: the curation gate and its running report, exact dedup within a watermark, and resumable generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.curation import Thresholds
from tributary.functions.text import record_key
from tributary.operators import curate
from tributary.operators.inference import JobSettings, generate_into, pending
from tributary.sources.records import read_generation_log


def curate_stream(records: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The gate has no state, so a stream passes through it as a table does."""
    return curate.curate(records, thresholds)


def dedup_stream(records: DataFrame, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first record of each key within the watermark; later rows than that are dropped."""
    keyed = records.withColumn("fingerprint", F.md5(record_key(F.col("instruction"), F.col("input"))))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def generate_stream(records: DataFrame, make_client: Callable, log_path: str, checkpoint: str, settings: JobSettings = JobSettings()):
    """Generates for what arrives and is not in the log yet; answers are in the log as they land, so that a batch that is run
    again asks for the rest only."""

    def batch(rows: DataFrame, _: int) -> None:
        generate_into(log_path, pending(rows, read_generation_log(rows.sparkSession, log_path)), make_client, settings)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def report_stream(records: DataFrame, path: str, checkpoint: str, thresholds: Thresholds = Thresholds()):
    """The gate's report of all records so far, after every batch. Only counts by reason are state. A batch writes its report
    under its own number, over what an attempt before it left."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts = curate.classify(records, thresholds).groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The newest report that ``report_stream`` wrote, as ``curate.report`` gives it."""
    counts = spark.read.schema("outcome string, n long, batch long").option("basePath", path).parquet(path)
    newest = counts.agg(F.max("batch").alias("batch"))
    now = counts.join(F.broadcast(newest), "batch").rollup("outcome").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("outcome") == "kept", F.col("n"))), F.lit(0)).alias("kept"))
    share = F.when(F.col("outcome").isNull(), F.round(F.col("kept") / F.col("n"), 4))
    return now.select(F.coalesce("outcome", F.lit("total")).alias("outcome"), "n", share.alias("keep_rate"))
