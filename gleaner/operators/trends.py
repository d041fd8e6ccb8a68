"""Windowed velocity, trend state and scores of clusters of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scales import Curve, ascending, clamp, descending, half_up
from gleaner.sources.views import hours

# Windows in hours, score curves, weights and floors.
WINDOWS = {"m15": 0.25, "h1": 1, "h3": 3, "h6": 6, "h12": 12, "h24": 24}
RECENCY: Curve = ((15, 1.0), (60, 0.9), (180, 0.74), (360, 0.55), (720, 0.36), (1440, 0.18), (2880, 0.08))
RECENCY_BEYOND = 0.03
VELOCITY: Curve = ((4, 1.0), (2.5, 0.85), (1.6, 0.66), (1.0, 0.46), (0.5, 0.26), (0.2, 0.12))
VELOCITY_BEYOND, VELOCITY_BASELINE = 0.06, 0.15
TREND_WEIGHTS = {"recency": 0.14, "velocity": 0.16, "diversity": 0.12, "geo": 0.14, "category": 0.12, "consequence": 0.16, "novelty": 0.08, "corroboration": 0.08}
SUBSCORE_FLOOR, TREND_MIN, DIVERSITY_CAP = 0.03, 20, 6
NOVELTY_SCORE = {"new-event": 1.0, "correction": 0.9, "new-fact": 0.8, "more-of-same": 0.25, "unknown": 0.5}
EDITORIAL_WEIGHTS = {
    "geo_relevance": 0.2, "category_priority": 0.14, "consequence": 0.18, "information_gain": 0.16,
    "corroboration": 0.12, "meaningful_recency": 0.1, "local_impact": 0.06, "velocity": 0.04,
}
EDITORIAL_RECENCY: Curve = ((30, 1.0), (90, 0.9), (240, 0.72), (480, 0.52), (720, 0.36), (1440, 0.2), (2880, 0.08))
BANDS = (("urgent", 60), ("high", 42), ("standard", 24), ("background", 5))
PENALTY = {"duplicate": 0.22, "stale_12h": 0.12, "stale_24h": 0.26, "syndication": 0.16, "weak_evidence": 0.12}


def trailing_families(reports: DataFrame, at: Column, keys: list[str]) -> DataFrame:
    """Distinct families in each trailing window that ends at ``at``.

    A report counts if its age is between zero and the window's length, both
    inclusive. A family without value counts as the report itself.
    """
    age = hours(at, F.col("published_at"))
    family = F.coalesce(F.col("family").cast("string"), F.concat(F.lit("r"), F.col("report_id").cast("string")))
    counts = [F.count_distinct(F.when((age >= 0) & (age <= h), family)).alias(name) for name, h in WINDOWS.items()]
    return reports.groupBy(*keys).agg(*counts)


def velocity(reports: DataFrame, at: Column, keys: list[str]) -> DataFrame:
    """Acceleration and velocity score: families of the last hour against the
    hourly rate of the six hours before it (at least 0.2).

    With fewer than two reports, or none in the seven hours, it isn't measurable
    and the score is the baseline.
    """
    age = hours(at, F.col("published_at"))
    family = F.coalesce(F.col("family").cast("string"), F.concat(F.lit("r"), F.col("report_id").cast("string")))
    counts = reports.groupBy(*keys).agg(
        F.count("*").alias("reports"),
        F.count_distinct(F.when((age >= 0) & (age <= 1), family)).alias("last_hour"),
        F.count_distinct(F.when((age > 1) & (age <= 7), family)).alias("before"),
    )
    measurable = (F.col("reports") >= 2) & ((F.col("last_hour") > 0) | (F.col("before") > 0))
    rate = F.col("last_hour") / F.greatest(F.col("before") / 6, F.lit(0.2))
    return counts.select(
        *keys,
        "reports",
        measurable.alias("measurable"),
        F.when(measurable, rate).otherwise(0.0).alias("acceleration"),
        F.when(measurable, descending(rate, VELOCITY, VELOCITY_BEYOND)).otherwise(VELOCITY_BASELINE).alias("velocity"),
    )


def trend_state(velocity: Column, age_hours: Column, quiet_hours: Column, prior_seen: Column, new_event: Column) -> Column:
    return (
        F.when(~prior_seen & new_event & (age_hours <= 6), "new")
        .when(prior_seen & (quiet_hours >= 12) & (velocity >= 0.55), "resurging")
        .when(velocity >= 0.8, "fast-rising")
        .when(velocity >= 0.55, "rising")
        .when((velocity <= 0.26) & (age_hours > 6), "fading")
        .otherwise("stable")
    )


def recency(minutes: Column) -> Column:
    return ascending(minutes, RECENCY, RECENCY_BEYOND)


def diversity(families: Column) -> Column:
    return clamp((families - 1) / (DIVERSITY_CAP - 1), 0, 1)


def corroboration(families: Column, official: Column) -> Column:
    return F.when(official & (families >= 1), 1.0).when(families >= 3, 0.9).when(families == 2, 0.65).when(official, 0.5).otherwise(0.2)


def trend_score(parts: dict[str, Column]) -> Column:
    """Weighted geometric mean of floored sub-scores, 0 to 100 in tenths.

    A geographic score of zero makes the whole score zero.
    """
    logs = [w * F.log(F.greatest(parts[name], F.lit(SUBSCORE_FLOOR))) for name, w in TREND_WEIGHTS.items()]
    return F.when(parts["geo"] == 0, 0.0).otherwise(half_up(100 * F.exp(sum(logs[1:], logs[0])), 10))


def editorial_score(parts: dict[str, Column], penalties: Column) -> Column:
    """Weighted arithmetic mean, each contribution in thousandths, less penalties."""
    terms = [half_up(parts[name] * w, 1000) for name, w in EDITORIAL_WEIGHTS.items()]
    return half_up(clamp(sum(terms[1:], terms[0]) - penalties, 0, 1) * 100, 10)


def band(score: Column, bands=BANDS, beyond: str = "suppressed") -> Column:
    return descending(score, tuple((low, name) for name, low in bands), beyond)


def crisis_priority(official_alert, weight, cap_weight, scope, districts, age_hours, sources, primary, lifecycle) -> Column:
    """Capped additive score, 0 to 100; scaled down once over or archived."""
    base = (
        F.when(official_alert, 18).otherwise(0)
        + F.least(weight, F.lit(38))
        + F.least(cap_weight, F.lit(36))
        + F.when(scope == "region", 16).when(scope == "relevant", 6).otherwise(0)
        + F.least(districts * 2, F.lit(12))
        + ascending(age_hours, ((3, 14), (6, 11), (12, 8), (24, 4), (48, 1)), 0)
        + F.least(sources * 3, F.lit(9))
        + F.when(primary, 4).otherwise(0)
    )
    scaled = base * F.when(lifecycle == "all-clear", 0.15).when(lifecycle == "archived", 0.05).otherwise(1.0)
    return clamp(half_up(scaled), 0, 100)


def plain_priority(scope, districts, government, age_hours, sources) -> Column:
    """Capped additive score of non-crisis stories, 0 to 60."""
    base = (
        F.lit(4)
        + F.when(scope == "region", 10).when(scope == "relevant", 6).when(scope == "nation", 3).otherwise(0)
        + F.least(districts * 2, F.lit(8))
        + F.when(government, 4).otherwise(0)
        + ascending(age_hours, ((6, 8), (24, 4), (72, 1)), 0)
        + F.least(sources * 2, F.lit(6))
    )
    return clamp(half_up(base.cast("double")), 0, 60)


def cap_weight(severity: Column, urgency: Column, certainty: Column) -> Column:
    """Additive weight of an alert's severity, urgency and certainty; null adds 0."""
    sev, urg, cer = (F.lower(F.coalesce(c, F.lit(""))) for c in (severity, urgency, certainty))
    return (
        F.when(F.contains(sev, F.lit("extreme")), 20)
        .when(F.contains(sev, F.lit("severe")), 14)
        .when(F.contains(sev, F.lit("moderate")) | (sev == "alert"), 8)
        .when(F.contains(sev, F.lit("minor")) | (sev == "watch"), 3)
        .otherwise(0)
        + F.when(F.contains(urg, F.lit("immediate")), 10).when(F.contains(urg, F.lit("expected")), 5).otherwise(0)
        + F.when(F.contains(cer, F.lit("observed")), 6).when(F.contains(cer, F.lit("likely")), 3).otherwise(0)
    )


def lifecycle(starts: Column, ends: Column, at: Column) -> Column:
    """Over, to come (more than half an hour ahead), or active."""
    return F.when(ends < at, "all-clear").when(starts > at + F.expr("INTERVAL 30 MINUTES"), "developing").otherwise("active")


def verification(role: Column, sources: Column, official: Column) -> Column:
    return (
        F.when(role.isin("official-alert", "primary-document"), "official")
        .when(official & (sources >= 1), "corroborated")
        .when(sources >= 2, "corroborated")
        .when(sources == 1, "single-source")
        .when(role == "developing-unverified", "developing")
        .otherwise("single-source")
    )
