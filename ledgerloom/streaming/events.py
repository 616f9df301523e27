"""Streams (an addition to the batch engine): windows, sessions and versions of arriving corrections."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.session import shared_folder


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of parquet files; a single file is found through a pattern, as a stream reads folders."""
    head, _, tail = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{head}/[{tail[0]}]{tail[1:]}")


def run_available(df: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what is available and returns its result, written under the shared folder with its checkpoint.

    In complete mode the last state replaces the one before.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/ledgerloom/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        out = each(batch) if each else batch
        (out.write.mode("overwrite").parquet(f"{at}/out") if mode == "complete" else out.write.mode("overwrite").parquet(f"{at}/out/batch={n}"))

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type, start, n, total per window; events later than the watermark are dropped."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return e.groupBy(F.window("t", every), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return e.groupBy(F.window("t", size, step), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, n: sessions that end after a gap."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return e.groupBy(F.session_window("t", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """The first event of every key within the watermark."""
    return events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", within).dropDuplicatesWithinWatermark(keys)


def latest_versions(corrections: DataFrame) -> DataFrame:
    """correction_group_id, n, latest of corrections as they arrive: a running aggregate, complete after every batch."""
    return corrections.where("correction_group_id IS NOT NULL").groupBy("correction_group_id").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"))
