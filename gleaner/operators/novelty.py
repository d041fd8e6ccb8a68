"""What changed between two snapshots: a keyed diff of claims, and update kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of texts that take back, mend or deny an earlier report.
RETRACTION = r"(?i)\b(retract(?:ed|s|ion)?|withdrawn|withdraws)\b"
CORRECTION = r"(?i)\b(corrected|correction|clarif(?:ied|ication)|erratum)\b"
COUNTER = r"(?i)\b(denies|denied|rejects|rejected|refutes|refuted|disputes|disputed)\b"
#: A fresh report is this much newer than the last one of the previous snapshot.
FRESH_MINUTES, QUIET_HOURS, UNMATCHED_HOURS = 20, 12, 8


def claim_diff(previous: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, before, after, change: how often each value stood in both snapshots.

    Change is 'added', 'gone', 'more', 'fewer' or 'same' for the value, and
    'contradicted' for an added value whose keys had others before that still stand.
    Nulls are values and keys like others; repeated rows count.
    """
    on = [*keys, value]
    counted = [side.groupBy(*on).agg(F.count("*").alias(name)) for side, name in ((previous, "before"), (current, "after"))]
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in on]
    both = counted[0].alias("x").join(counted[1].alias("y"), same, "full")
    old = F.col("x.before").isNotNull()
    rows = both.select(*[F.when(old, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(c) for c in on], F.coalesce("before", F.lit(0).cast("long")).alias("before"), F.coalesce("after", F.lit(0).cast("long")).alias("after"))
    stands = rows.groupBy(*keys).agg(F.count_if((F.col("before") > 0) & (F.col("after") > 0)).alias("_stands"))
    near = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys]
    rows = rows.alias("x").join(stands.alias("y"), near, "left").select("x.*", "_stands")
    b, a = F.col("before"), F.col("after")
    change = (
        F.when((b == 0) & (F.col("_stands") > 0), "contradicted").when(b == 0, "added").when(a == 0, "gone").when(a > b, "more").when(a < b, "fewer").otherwise("same")
    )
    return rows.withColumn("change", change).drop("_stands")


def update_kind(
    *, first_snapshot: Column, matched: Column, age_hours: Column, fresh: Column, retracted: Column, corrected: Column, contradicted: Column, countered: Column, official: Column, was_official: Column,
    figures: Column, places: Column, claims: Column, families: Column, words: Column, quiet_hours: Column,
) -> Column:
    """A struct of novelty class, update kind and score for a cluster against its
    previous snapshot.

    ``fresh`` counts reports newer than that; retracted, corrected, countered and
    official are of those; contradicted says that disputes grew; figures, places,
    claims and words count new ones, ``families`` the increase. Rules go in order:
    nothing to compare with, nothing fresh, retraction, correction, then the gains,
    of which the first names the kind and the largest gives the score.
    """
    gained = contradicted | countered | official | (figures > 0) | (places > 0) | (claims > 0)
    zero = F.lit(0.0)
    score = F.greatest(
        F.lit(0.2), F.when(contradicted, 0.85).when(countered, 0.6).otherwise(zero), F.when(official & ~was_official, 0.85).when(official, 0.55).otherwise(zero),
        F.when(figures > 0, 0.7).otherwise(zero), F.when(places > 0, 0.65).otherwise(zero), F.when(claims > 0, 0.6).otherwise(zero),
    )
    score = F.when(quiet_hours >= QUIET_HOURS, F.least(F.lit(1.0), score + 0.1)).otherwise(score)
    kind = (
        F.when(official & ~was_official, "new-official-confirmation").when(contradicted, "new-contradiction").when(countered, "new-counterclaim")
        .when(official & (claims > 0), "new-fact").when(official, "new-authority-statement")
        .when(figures > 0, "new-number").when(places > 0, "new-location").otherwise("new-fact")
    )
    major = (score >= 0.8) | ((figures > 0) & (places > 0)) | (contradicted & official)

    def said(name: str, kind: str | Column, score: float | Column) -> Column:
        return F.struct(F.lit(name).alias("novelty"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.round(F.lit(score) if isinstance(score, float) else score, 2).alias("score"))

    return (
        F.when(first_snapshot, said("unknown", "unknown", 0.5))
        .when(~matched & (age_hours > UNMATCHED_HOURS), said("unknown", "unknown", 0.4))
        .when(~matched, said("new-event", "major-development", 1.0))
        .when(fresh == 0, said("more-of-same", "duplicate", 0.1))
        .when(retracted, said("correction", "retraction", 0.95))
        .when(corrected, said("correction", "correction", 0.9))
        .when(gained, said("new-fact", F.when(major, "major-development").otherwise(kind), score))
        .when(families > 0, said("more-of-same", "new-source-only", 0.3))
        .when(words >= 4, said("more-of-same", "minor-detail", 0.25))
        .when(words >= 1, said("more-of-same", "rephrasing", 0.15))
        .otherwise(said("more-of-same", "duplicate", 0.1))
    )
