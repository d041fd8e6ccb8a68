"""Claims: grouping, disputes, confidence, evidence and common ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.scales import clamp, half_up
from gleaner.sources.views import hours

# Weights of confidence, common ground and evidence strength.
CONFIDENCE = {"base": 30, "groups": {1: 14, 2: 24, 3: 32}, "primary": 18, "direct": 6, "attributed": -16, "disputed": -22, "syndicated": -8, "unknown": -6, "unknown_cap": 69}
COMMON = {
    "base": 40, "corroborated": 45, "evidence": 10, "single": 25, "attributed": 12, "disputed": 30,
    "hard_dispute": 8, "syndication": 8, "thin_cap": 68, "high": 70, "moderate": 45,
}
UPDATE_MINUTES = 45
STATUS_ORDER = ("corroborated", "partially-corroborated", "attributed", "single-source", "disputed", "outdated", "corrected", "retracted")


def status(attributed: Column, attribution_type: Column, groups: Column, publishers: Column) -> Column:
    """Attribution first; then independent groups; then publishers."""
    return (
        F.when(attributed, "attributed")
        .when(attribution_type, F.when(publishers >= 2, "partially-corroborated").otherwise("single-source"))
        .when(groups >= 2, "corroborated")
        .when(publishers >= 2, "partially-corroborated")
        .otherwise("single-source")
    )


def group_claims(claims: DataFrame, keys: list[str]) -> DataFrame:
    """One row per match key: publishers, independent families, times, status.

    A null family is a group of its own, the publisher.
    """
    family = F.coalesce(F.col("family").cast("string"), F.concat(F.lit("p"), F.col("publisher").cast("string")))
    grouped = claims.groupBy(*keys).agg(
        F.count("*").alias("reports"),
        F.count_distinct("publisher").alias("publishers"),
        F.count_distinct(family).alias("groups"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    )
    return grouped


def numeric_disputes(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Per key with two values or more: the value seen first, and the one that was
    first reported last; an update if its last report is over 45 minutes later.

    Values that are not positive are ignored; equal times go by value.
    """
    values = claims.where("value > 0").groupBy(*keys, "value").agg(F.min("seen_at").alias("earliest"), F.max("seen_at").alias("latest"))
    ends = values.groupBy(*keys).agg(
        F.count("*").alias("values"),
        F.min_by(F.struct("value", "earliest", "latest"), F.struct("earliest", "value")).alias("a"),
        F.max_by(F.struct("value", "earliest", "latest"), F.struct("earliest", "value")).alias("b"),
    )
    ends = ends.where("values >= 2")
    minutes = F.abs(hours(F.col("b.latest"), F.col("a.earliest"))) * 60
    update = minutes > UPDATE_MINUTES
    gap = F.abs(F.col("b.value") - F.col("a.value")) / F.least("a.value", "b.value")
    sure = F.when(update | (gap < 0.2), "low").when(gap < 0.5, "moderate").otherwise("high")
    return ends.select(
        *keys, "values", F.col("a.value").alias("value_a"), F.col("a.earliest").alias("at_a"), F.col("b.value").alias("value_b"), F.col("b.latest").alias("at_b"),
        update.alias("update"), sure.alias("confidence"),
    )


def confidence(groups, publishers, primary, direct, attribution, age_hours, disputed, syndicated, unknown) -> Column:
    unknown_only = unknown & (groups < 2)
    score = (
        F.lit(CONFIDENCE["base"])
        + F.when(groups >= 3, 32).when(groups == 2, 24).when((groups == 1) & (publishers >= 1), 14).otherwise(0)
        + F.when(primary, 18).otherwise(0)
        + F.when(direct & ~attribution, 6).when(attribution, -16).otherwise(0)
        + F.when(age_hours < 6, 6).when(age_hours < 24, 2).otherwise(0)
        + F.when(disputed, -22).otherwise(0)
        + F.when(syndicated, -8).otherwise(0)
        + F.when(unknown_only, -6).otherwise(0)
    )
    bounded = F.least(F.greatest(score, F.lit(0)), F.lit(100))
    return F.when(unknown_only, F.least(bounded, F.lit(CONFIDENCE["unknown_cap"]))).otherwise(bounded)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "moderate").otherwise("low")


def common_ground(claims: DataFrame, keys: list[str]) -> DataFrame:
    """The common-ground index of each event, null below its sample gates.

    ``claims`` has status, evidence boolean, hard_dispute boolean, and per event
    publishers, groups and syndicated counts.
    """
    facts = claims.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status").isin("corroborated", "partially-corroborated")).alias("corroborated"),
        F.count_if(F.col("status") == "single-source").alias("single"),
        F.count_if(F.col("status") == "attributed").alias("attributed"),
        F.count_if(F.col("status") == "disputed").alias("disputed"),
        F.count_if("evidence").alias("evidence"),
        F.count_if("hard_dispute").alias("hard"),
        F.max("event_publishers").alias("event_publishers"),
        F.max("event_groups").alias("event_groups"),
        F.max("event_syndicated").alias("event_syndicated"),
    )
    part = lambda name, weight: half_up(F.col(name) / F.col("n") * weight)
    score = (
        F.lit(float(COMMON["base"]))
        + part("corroborated", COMMON["corroborated"])
        + F.when(F.col("evidence") > 0, COMMON["evidence"]).otherwise(0)
        - part("single", COMMON["single"])
        - part("attributed", COMMON["attributed"])
        - part("disputed", COMMON["disputed"])
        - F.col("hard") * COMMON["hard_dispute"]
        - F.when(F.col("event_syndicated") > F.col("event_groups"), COMMON["syndication"]).otherwise(0)
    )
    broad = (F.col("evidence") > 0) | (F.col("n") >= 3) | (F.col("event_groups") >= 3)
    capped = clamp(F.when(broad, score).otherwise(F.least(score, F.lit(float(COMMON["thin_cap"])))), 0, 100)
    shown = F.when((F.col("event_publishers") >= 2) & (F.col("n") >= 1), capped)
    band = F.when(shown >= COMMON["high"], "high").when(shown >= COMMON["moderate"], "moderate").when(shown.isNotNull(), "low")
    return facts.select(*keys, "n", shown.alias("cgi"), band.alias("band"), F.when(shown.isNull(), "fewer than two publishers").alias("withheld"))


def evidence_status(retracted, corrected, superseded, disputed, groups, primary, attributed) -> Column:
    return (
        F.when(retracted, "retracted").when(corrected, "corrected").when(superseded, "superseded").when(disputed, "disputed")
        .when((groups >= 3) & primary, "confirmed").when(groups >= 3, "well-supported").when(groups == 2, "supported").when(attributed, "attributed").otherwise("single-source")
    )


def hard_disputes(disputes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of disputes that are no update and not of low confidence."""
    return disputes.where("not update and confidence <> 'low'").select(*keys).distinct()


def propagate_disputes(claims: DataFrame, hard: DataFrame, keys: list[str]) -> DataFrame:
    """``claims`` with ``disputed``: its kind is in a hard dispute and it is no attributed
    claim; ``keys`` name event and kind, a null key is in no dispute."""
    marked = claims.join(hard.select(*keys, F.lit(True).alias("_hard")), keys, "left")
    return marked.withColumn("disputed", F.coalesce("_hard", F.lit(False)) & (F.col("status") != "attributed")).drop("_hard")


def ordered_disputes(claims: DataFrame, keys: list[str], subject: str, asserts: str, denies: str, minutes: int = 30) -> DataFrame:
    """Events whose claims about ``subject`` both assert and deny (patterns; a text that
    denies doesn't assert): keys, counts, the latest time of each side, update and
    confidence. Sides over ``minutes`` apart are a development, of low confidence.

    ``claims`` has text and seen_at; null texts say nothing.
    """
    denied = F.col("text").rlike(denies)
    asserted = F.col("text").rlike(asserts) & ~denied
    sides = claims.where(F.col("text").rlike(subject)).groupBy(*keys).agg(
        F.count_if(asserted).alias("asserting"), F.count_if(denied).alias("denying"), F.max(F.when(asserted, F.col("seen_at"))).alias("asserted_at"), F.max(F.when(denied, F.col("seen_at"))).alias("denied_at")
    )
    sides = sides.where("asserting > 0 and denying > 0")
    update = F.abs(hours(F.col("asserted_at"), F.col("denied_at"))) * 60 > minutes
    return sides.withColumn("update", update).withColumn("confidence", F.when(update, "low").otherwise("moderate"))


def equivalence_edges(claims: DataFrame, *, least: float = 0.7, least_key: int = 9) -> DataFrame:
    """(a, b) of claims of one event that say the same: equal kind and object, equal keys
    of at least ``least_key`` characters, or keys whose words overlap by ``least``.

    ``claims`` has id, event, kind, object and key (its words, sorted); null or empty
    kinds, objects and keys are equal to nothing. Equal ones are linked to the least
    id among them; words are compared between different keys only, by a prefix of
    their rarest words.
    """
    bare = F.regexp_replace(F.lower("object"), r"[^\p{L}\p{N}]", "")
    stars = []
    for by, rows in (
        (["event", "kind", "bare"], claims.withColumn("bare", bare).where("kind <> '' and bare <> ''")),
        (["event", "key"], claims.where(F.length("key") >= least_key)),
    ):
        first = rows.groupBy(*by).agg(F.min("id").alias("a"))
        stars.append(rows.join(first, by).where("id <> a").select("a", F.col("id").alias("b")))
    keyed = claims.where("key <> ''").groupBy("event", "key").agg(F.min("id").alias("id"))
    again = claims.where("key <> ''").join(keyed.withColumnRenamed("id", "a"), ["event", "key"]).where("id <> a").select("a", F.col("id").alias("b"))
    words = keyed.withColumn("set", F.array_distinct(F.split("key", " ")))
    counts = words.select("event", F.explode("set").alias("w")).groupBy("event", "w").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "w"))
    probe = words.select("id", "event", F.size("set").alias("n"), F.explode("set").alias("w")).join(counts, ["event", "w"]).withColumn("rank", rank)
    probe = probe.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("id", "event", "n", "w")
    x, y = probe.alias("x"), probe.alias("y")
    fits = (F.col("x.event") == F.col("y.event")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.n") >= least * F.col("y.n")) & (F.col("y.n") >= least * F.col("x.n"))
    pairs = x.join(y, fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    sets = words.select("id", "set")
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("p")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("q")), "b")
    shared = F.size(F.array_intersect("p", "q"))
    alike = pairs.where(shared / (F.size("p") + F.size("q") - shared) >= least).select("a", "b")
    return stars[0].unionByName(stars[1]).unionByName(again).unionByName(alike).distinct()


def canonical_pick(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the id of the claim to show: not attributed, then fewest bars or bullets
    between words, then the most confident, the longest, the least id.

    ``claims`` has id, text, attributed and confidence; null texts come last.
    """
    text = F.coalesce("text", F.lit(""))
    bars = F.size(F.regexp_extract_all(text, F.lit(r"\s[|•]\s"), F.lit(0)))
    order = F.struct(F.coalesce("attributed", F.lit(False)).cast("int").alias("o1"), F.col("text").isNull().alias("o2"), bars.alias("o3"), (-F.coalesce("confidence", F.lit(0))).alias("o4"), (-F.length(text)).alias("o5"), F.col("id").alias("o6"))
    return claims.groupBy(*keys).agg(F.min_by("id", order).alias("canonical"), F.count("*").alias("claims"))
