"""Bursts of a cluster's reports, with state carried from batch to batch.

A burst is a run of reports without a quiet gap; it is given out once, when the
watermark has passed its end by the gap, so nothing that still may come could
change it. The state of a cluster is when it was first seen, when its last burst
ended, and its open bursts, of which the watermark allows but a few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BURST = "cluster_id int, first_seen timestamp, started timestamp, ended timestamp, reports long, quiet_hours double"
STATE = "first long, last long, starts array<long>, ends array<long>, counts array<long>"
HOUR = 3_600_000_000


def merged(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(start, end, reports) of the spans, those less than ``gap`` apart joined."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(spans):
        if out and start - out[-1][1] < gap:
            out[-1] = out[-1][0], max(end, out[-1][1]), out[-1][2] + n
        else:
            out.append((start, end, n))
    return out


def advance(key: tuple, frames: Iterator[pd.DataFrame], state, gap: int, expiry: int) -> Iterator[pd.DataFrame]:
    """Take a batch's reports of one cluster in, give closed bursts out."""
    first, last, *columns = state.get if state.exists else (None, None, [], [], [])
    spans = list(zip(*columns, strict=True))
    for frame in frames:
        at = frame["published_at"].astype("datetime64[us]").astype("int64")
        spans = merged([*spans, *((t, t, 1) for t in at.tolist())], gap)
    now = state.getCurrentWatermarkMs()
    rows = []
    while spans and (spans[0][1] + gap) // 1000 <= now:
        start, end, n = spans.pop(0)
        quiet = None if last is None or start - last >= expiry else (start - last) / HOUR
        first = start if quiet is None else first
        rows.append((key[0], first, start, end, n, quiet))
        last = end
    wake = ((spans[0][1] + gap) if spans else (last + expiry)) // 1000 - 1
    if not spans and wake < now:
        state.remove()
    else:
        state.update((first, last, *([s[k] for s in spans] for k in range(3))))
        state.setTimeoutTimestamp(max(wake, now))
    if rows:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in BURST.split(", ")])
        yield out.assign(quiet_hours=out["quiet_hours"].astype("float64"), **{c: pd.to_datetime(out[c], unit="us") for c in ("first_seen", "started", "ended")})


def bursts(reports: DataFrame, gap_hours: int = 12, expiry_hours: int = 168) -> DataFrame:
    """Closed bursts of a stream with cluster_id and published_at under a watermark.

    ``first_seen`` is the cluster's first report, carried over its bursts until it is
    quiet for ``expiry_hours``, when it is forgotten and begins anew; ``quiet_hours``
    is the gap before the burst (null for the first). Reports without a cluster are
    one cluster; those later than the watermark are dropped.
    """
    gap, expiry = gap_hours * HOUR, expiry_hours * HOUR
    rows = reports.select("cluster_id", "published_at").groupBy("cluster_id")
    return rows.applyInPandasWithState(lambda key, frames, state: advance(key, frames, state, gap, expiry), BURST, STATE, "append", "EventTimeTimeout")


def bursts_of_table(reports: DataFrame, gap_hours: int = 12, expiry_hours: int = 168) -> DataFrame:
    """The same of a table, all bursts closed: what a stream over it comes to."""
    micros = F.unix_micros(F.col("published_at").cast("timestamp"))
    own = Window.partitionBy("cluster_id").orderBy("at")
    rows = reports.select("cluster_id", micros.alias("at"))
    rows = rows.withColumn("burst", F.sum(F.when(F.col("at") - F.lag("at").over(own) < gap_hours * HOUR, 0).otherwise(1)).over(own))
    spans = rows.groupBy("cluster_id", "burst").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("reports"))
    order = Window.partitionBy("cluster_id").orderBy("burst")
    spans = spans.withColumn("quiet", F.col("start") - F.lag("end").over(order)).withColumn("quiet", F.when(F.col("quiet") < expiry_hours * HOUR, F.col("quiet")))
    spans = spans.withColumn("first", F.last(F.when(F.col("quiet").isNull(), F.col("start")), ignorenulls=True).over(order))
    time = lambda c: F.timestamp_micros(c)
    return spans.select("cluster_id", time("first").alias("first_seen"), time("start").alias("started"), time("end").alias("ended"), "reports", (F.col("quiet") / HOUR).alias("quiet_hours"))
