"""Streams with state and a sink that goes on where it stopped."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import bursts as B
from gleaner.streaming import reports as S

START = dt.datetime(2024, 1, 1)


def landing(spark, folder, rows, name):
    """One more file of (event_id, hours, cluster) events."""
    found = [(i, START + dt.timedelta(hours=h), i % 7, "view", 1.0, f'{{"k": {k}}}') for i, h, k in rows]
    spark.createDataFrame(found, S.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    role = spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    rows = role.select(F.get_json_object("props", "$.k").cast("int").alias("cluster_id"), F.col("event_id").alias("report_id"), F.col("ts").cast("timestamp").alias("published_at"))
    return rows.withWatermark("published_at", "48 hours")


def plain(rows):
    return sorted(map(str, rows))


def batch(spark, rows, newest):
    table = spark.createDataFrame([(k, START + dt.timedelta(hours=h)) for _, h, k in rows], "cluster_id int, published_at timestamp_ntz")
    edge = F.lit(START + dt.timedelta(hours=newest - 48)).cast("timestamp")
    return plain(B.bursts_of_table(table).where(F.col("ended") + F.expr("INTERVAL 12 HOURS") <= edge).collect())


def test_bursts_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, i * 0.6 + rng.uniform(-20, 20), rng.choice([1, 2, 2, 2, 3, *range(4, 20)])) for i in range(600)]
    folder = str(tmp_path / "sink")
    parts = [rows[:200] + [(900, 80.0, 77)], rows[200:330], rows[330:500] + [(901, 272.0, 77)], rows[500:]]  # 77 is forgotten between
    for k, part in enumerate(parts):
        landing(spark, tmp_path / "in", part, f"p{k}")
        out = S.run_to_table(B.bursts(stream(spark, tmp_path / "in")), "bursts", "append", folder)
        seen = [r for p in parts[: k + 1] for r in p]
        assert plain(out.collect()) == batch(spark, seen, max(h for _, h, _ in seen))
    assert out.where("cluster_id = 77 and quiet_hours is null and first_seen = started").count() == 2 and out.where("quiet_hours is not null").count() > 20


def test_late_reports_are_dropped_and_others_merged(spark, tmp_path):
    folder = str(tmp_path / "sink")
    landing(spark, tmp_path / "in", [(1, 0, 5), (2, 100, 5)], "a")
    S.run_to_table(B.bursts(stream(spark, tmp_path / "in")), "bursts", "append", folder)
    landing(spark, tmp_path / "in", [(3, 10, 5), (4, 60, 5), (5, 70, 5), (6, 300, 5)], "b")  # 10 h lies under the watermark of 52 h
    out = S.run_to_table(B.bursts(stream(spark, tmp_path / "in")), "bursts", "append", folder)
    found = [(r.started, r.ended, r.reports, r.quiet_hours, r.first_seen) for r in out.orderBy("started").collect()]
    hour = lambda h: START + dt.timedelta(hours=h)
    assert found == [(hour(0), hour(0), 1, None, hour(0)), (hour(60), hour(70), 2, 60.0, hour(0)), (hour(100), hour(100), 1, 30.0, hour(0))]


def test_a_batch_that_failed_is_written_once(spark, tmp_path, monkeypatch):
    folder, whole = str(tmp_path / "sink"), S.write_batch
    rows = [(i, i * 0.1, i % 5) for i in range(60)]
    for k in range(3):
        landing(spark, tmp_path / "in", rows[20 * k : 20 * k + 20], f"p{k}")

    def fails(batch, path):
        whole(batch, path)
        if path.endswith("batch=000001"):
            raise RuntimeError("lost after the write, before the commit")

    monkeypatch.setattr(S, "write_batch", fails)
    with pytest.raises(Exception, match="lost after"):
        S.run_to_table(S.deduplicated(stream(spark, tmp_path / "in")), "ids", "append", folder)
    monkeypatch.setattr(S, "write_batch", whole)
    for _ in range(2):
        out = S.run_to_table(S.deduplicated(stream(spark, tmp_path / "in")), "ids", "append", folder)
        assert sorted(r.report_id for r in out.collect()) == list(range(60))


def test_undated_and_future_reports_are_rejected(spark):
    at = "2024-01-10 00:00:00"
    rows = [(1, dt.datetime(2024, 1, 12)), (2, dt.datetime(2024, 1, 12, 0, 0, 1)), (3, None), (4, dt.datetime(2020, 1, 1))]
    frame = spark.createDataFrame(rows, "report_id int, published_at timestamp_ntz").withColumn("published_at", F.col("published_at").cast("timestamp"))
    assert {r.report_id for r in S.accepted(frame, at).collect()} == {1, 4}


def test_spans_merge_in_any_order():
    rng = random.Random(4)
    times = [rng.randrange(0, 2000) for _ in range(200)]
    expected = B.merged([(t, t, 1) for t in times], 13)
    for _ in range(5):
        rng.shuffle(times)
        spans = []
        for k in range(0, 200, 17):
            spans = B.merged([*spans, *((t, t, 1) for t in times[k : k + 17])], 13)
        assert spans == expected
    assert all(b[0] - a[1] >= 13 for a, b in zip(expected, expected[1:], strict=False)) and sum(n for *_, n in expected) == 200
