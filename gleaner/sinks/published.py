"""Versions of a table behind gates: what fails stays out, the former version in place.

A version is written to a folder of its own while metrics are observed in the same
pass; then the gates are judged, and only a version that passes all of them is
named in the manifest, a small table that is appended to. Readers follow the
manifest's last passing row, so they never see a version half written or withheld.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "seq long, version string, passed boolean, failed array<string>, metrics string"


class Gate(NamedTuple):
    """A rule over the whole table: ``metric`` is an aggregate, which must lie between
    ``least`` and ``most``. A null metric (nothing to measure) fails."""

    name: str
    metric: Column
    least: float | None = None
    most: float | None = None

    def holds(self, value: float | None) -> bool:
        return value is not None and (self.least is None or value >= self.least) and (self.most is None or value <= self.most)


def share(part: Column, of: Column) -> Column:
    """Rows of ``part`` over rows of ``of``; null where there are none."""
    return F.count_if(part & of) / F.nullif(F.count_if(of), F.lit(0))


def manifest(spark: SparkSession, folder: str) -> list:
    """The rows of the manifest in order; empty before the first version."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("seq", "version").collect()


def publish(frame: DataFrame, gates: list[Gate], folder: str, partition_by: str | None = None) -> tuple[bool, dict[str, float | None]]:
    """Write ``frame`` as the next version; (whether it was published, its metrics).

    The frame is computed once: its metrics are observed while it is written. An
    empty table is judged like any other. One writer at a time is assumed.
    """
    folder, spark = folder.rstrip("/"), frame.sparkSession
    before = manifest(spark, folder)
    version, seen = f"v{len(before):06d}-{uuid.uuid4().hex[:8]}", Observation()
    measured = frame.observe(seen, F.count("*").alias("rows"), *[g.metric.alias(f"m{k}") for k, g in enumerate(gates)])
    writer = measured.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{folder}/{version}")
    got = seen.get
    metrics = {g.name: None if got[f"m{k}"] is None else float(got[f"m{k}"]) for k, g in enumerate(gates)}
    failed = [g.name for g in gates if not g.holds(metrics[g.name])]
    row = (len(before), version, not failed, failed, json.dumps(metrics | {"rows": got["rows"]}))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return not failed, metrics


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The last version that passed its gates; ValueError if there is none."""
    good = [row for row in manifest(spark, folder.rstrip("/")) if row.passed]
    if not good:
        raise ValueError(f"no version of {folder} has passed its gates")
    return spark.read.parquet(f"{folder.rstrip('/')}/{good[-1].version}")


def verdicts(sources: DataFrame, probe: Column, valid: Column, items: Column, relevant: Column) -> DataFrame:
    """``sources`` with enabled and reason: forbidden or failed probes, feeds that don't
    parse, those of fewer than two items and those without a relevant one are disabled."""
    reason = (
        F.when(probe == 403, "forbidden").when((probe < 200) | (probe >= 300) | probe.isNull(), "unreachable").when(~F.coalesce(valid, F.lit(False)), "invalid feed")
        .when(F.coalesce(items, F.lit(0)) < 2, "fewer than two items").when(F.coalesce(relevant, F.lit(0)) < 1, "no relevant sample")
    )
    return sources.withColumn("reason", reason).withColumn("enabled", F.col("reason").isNull())
