"""Structured Streaming ingestion of record files with the batch loaders' rules.

Every record is validated on its own; those that break a rule go to a second output instead of stopping the stream. The
identity of a record is deduplicated within a watermark, so state stays bounded however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.schemas import KINDS
from edgeloom.sources.ndjson import CALL_RECORD, is_call, parse

CALL_IDENTITY = ("caller_name", "callee_name", "call_site", "kind")


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(line_no, line, arrived) of text files as they arrive in a folder."""
    t = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return t.select(F.lit(0).cast("bigint").alias("line_no"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("arrived"))


def call_stream(lines: DataFrame, watermark: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(calls, rejected): valid call records once per identity within the watermark, and the lines that break a rule."""
    rec = parse(lines.select("line_no", "line"), CALL_RECORD) if "arrived" not in lines.columns else _parse_timed(lines)
    call = F.coalesce(is_call(), F.lit(False))
    named = (F.coalesce("caller_name", F.lit("")) != "") & (F.coalesce("callee_name", F.lit("")) != "")
    valid = F.col("bad").isNull() & call & named & F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    good = rec.where(valid).withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(list(CALL_IDENTITY))
    bad = rec.where(F.col("bad").isNotNull() | (call & ~valid)).select("arrived", "line")
    return good.select("arrived", "caller_name", "caller_file", "callee_name", "callee_file", "call_site", "kind"), bad


def _parse_timed(lines: DataFrame) -> DataFrame:
    rec = F.from_json("line", CALL_RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    r = lines.where(F.trim("line") != "").select("arrived", "line", rec.alias("r")).select("arrived", "line", "r.*")
    return r.withColumn("bad", F.when(F.col("bad").isNotNull() | ~F.col("line").rlike(r"(?s)^\s*\{.*\}\s*$"), F.col("line")))


def kind_counts(calls: DataFrame, window: str = "10 minutes") -> DataFrame:
    """(window, kind, edges): arrivals per time window and kind; late files count until the watermark passes."""
    return calls.groupBy(F.window("arrived", window), "kind").agg(F.count(F.lit(1)).alias("edges"))


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Appends parquet files exactly once; processes what is there and stops."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
