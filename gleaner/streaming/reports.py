"""Report streams with Structured Streaming: windows, deduplication, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleaner.sources.views import ROLES
from gleaner.storage import Workspace

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Reports older than this against the newest seen are late.
LATENESS = "7 days"


def read_reports(spark: SparkSession, folder: str, max_files: int = 8) -> DataFrame:
    """Reports from files as they land in ``folder``, with event time and watermark."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(folder)
    return raw.select(
        F.get_json_object("props", "$.k").cast("int").alias("cluster_id"), F.col("event_id").alias("report_id"), F.col("user_id").alias("publisher"),
        F.col("ts").cast("timestamp").alias("published_at"), role[F.col("event_type")].alias("role"),
    ).withWatermark("published_at", LATENESS)


def sliding_counts(reports: DataFrame) -> DataFrame:
    """Reports and alerts of each 24-hour window that starts every six hours."""
    return reports.groupBy(F.window("published_at", "24 hours", "6 hours").alias("w"), "role").agg(F.count("*").alias("reports"))


def deduplicated(reports: DataFrame) -> DataFrame:
    """The first report of each id within the watermark."""
    return reports.dropDuplicatesWithinWatermark(["report_id"])


def sessions(reports: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Bursts of a cluster that end with a quiet gap."""
    return reports.groupBy(F.session_window("published_at", gap).alias("w"), "cluster_id").agg(F.count("*").alias("reports"))


def accepted(reports: DataFrame, at: str) -> DataFrame:
    """Reports with a time that is at most two days after ``at``."""
    return reports.where(F.col("published_at") <= F.lit(at).cast("timestamp") + F.expr("INTERVAL 2 DAYS"))


def write_batch(batch: DataFrame, folder: str) -> None:
    batch.write.mode("overwrite").parquet(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Run over all that has landed and return the result as a written table.

    Each micro-batch overwrites its own folder (the batch id is the key), so a
    batch that is run again after a failure writes the same rows once. ``folder``
    is where results and checkpoint stay: a later run with the same folder and the
    same stream goes on behind the last batch that was committed, also after a
    crash in the midst of one. Without it a run has a folder of its own.
    """
    spark = stream.sparkSession
    root = folder.rstrip("/") if folder else Workspace(spark, name).root

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{root}/out/batch={batch_id:06d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{root}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == last)
    return out.drop("batch")
