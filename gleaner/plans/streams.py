"""Streaming queries over the events as files that land; equal to their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog import register
from gleaner.sources import views as V
from gleaner.storage import Workspace
from gleaner.streaming import bursts as B
from gleaner.streaming import reports as S


def landed(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """Events in four files by id, each ``copies`` times, read as a stream."""
    folder = Workspace(spark, "landing").path("events")
    events = V.table(spark, sf_dir, "events").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
    events.repartitionByRange(4, "event_id").write.mode("overwrite").parquet(folder)
    return S.accepted(S.read_reports(spark, folder), V.NOW)


@register("streaming_windows", "P-sliding P-watermark", V.sql("v_reports", """, w AS (SELECT role, unnest(range(4)) AS back, published_at, to_timestamp(floor(epoch(published_at) / 21600) * 21600) AT TIME ZONE 'UTC' AS start FROM v_reports)
    SELECT start - to_hours((back * 6)::BIGINT) AS window_start, role, count(*) AS reports FROM w GROUP BY 1, 2"""))
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_to_table(S.sliding_counts(landed(spark, sf_dir)), "windows")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "role", "reports")


@register("streaming_dedupe", "P-dedup", V.sql("v_reports", " SELECT report_id, publisher, role FROM v_reports"))
def streaming_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report lands twice and is kept once."""
    out = S.run_to_table(S.deduplicated(landed(spark, sf_dir, 2)), "dedupe", "append")
    return out.select("report_id", "publisher", "role")


@register("streaming_session", "P-session P-trigger", V.sql("v_reports", """, g AS (SELECT cluster_id, published_at, CASE WHEN published_at >= lag(published_at) OVER (PARTITION BY cluster_id ORDER BY published_at) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM v_reports),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY cluster_id ORDER BY published_at ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT cluster_id, min(published_at) AS started, count(*) AS reports FROM s GROUP BY cluster_id, session"""))
def streaming_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_to_table(S.sessions(landed(spark, sf_dir)), "sessions")
    return out.select("cluster_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "reports")


@register("streaming_bursts", "P-stateful P-watermark", V.sql("v_reports", """, g AS (SELECT cluster_id, published_at, CASE WHEN published_at < lag(published_at) OVER (PARTITION BY cluster_id ORDER BY published_at) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM v_reports),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY cluster_id ORDER BY published_at ROWS UNBOUNDED PRECEDING) AS burst FROM g),
    s AS (SELECT cluster_id, burst, min(published_at) AS started, max(published_at) AS ended, count(*) AS reports FROM n GROUP BY cluster_id, burst),
    q AS (SELECT *, epoch_us(started) - epoch_us(lag(ended) OVER (PARTITION BY cluster_id ORDER BY burst)) AS gap FROM s),
    k AS (SELECT *, CASE WHEN gap < 168 * 3600000000 THEN gap END AS quiet FROM q),
    f AS (SELECT *, max(CASE WHEN quiet IS NULL THEN started END) OVER (PARTITION BY cluster_id ORDER BY burst ROWS UNBOUNDED PRECEDING) AS first_seen FROM k)
    SELECT cluster_id, first_seen, started, ended, reports, round(quiet / 3.6e9, 6) AS quiet_hours FROM f
    WHERE epoch_ms(ended) + 12 * 3600000 <= (SELECT epoch_ms(max(published_at)) - 7 * 86400000 FROM v_reports)"""))
def streaming_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts that the watermark (seven days) has closed, from state by cluster."""
    out = S.run_to_table(B.bursts(landed(spark, sf_dir)), "bursts", "append")
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "started", "ended")]
    return out.select("cluster_id", *times, "reports", F.round("quiet_hours", 6).alias("quiet_hours"))
