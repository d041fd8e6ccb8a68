"""Invariants, gates, sweeps, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog import register
from gleaner.operators.topk import first_per_group
from gleaner.plans.claims import _GROUP_SQL, grouped
from gleaner.plans.identity import _PAIRS_SQL, similar_pairs
from gleaner.plans.trends import _EDITED_SQL, edited
from gleaner.sources import views as V
from gleaner.storage import Workspace


@register("snapshot_invariants", "R1", V.sql("v_claims", f""", {_GROUP_SQL}, chk AS (SELECT 'corroborated needs two groups' AS rule, count(*) FILTER (WHERE status = 'corroborated' AND groups < 2) AS violations, count(*) AS checked FROM s
    UNION ALL SELECT 'first seen is not after last seen', count(*) FILTER (WHERE first_seen > last_seen), count(*) FROM s UNION ALL SELECT 'groups are not more than publishers', count(*) FILTER (WHERE groups > publishers), count(*) FROM s
    UNION ALL SELECT 'attributed has an attribution', count(*) FILTER (WHERE status = 'attributed' AND NOT attributed), count(*) FROM s) SELECT rule, violations, checked, violations = 0 AS passes FROM chk"""))
def snapshot_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "corroborated needs two groups": (F.col("status") == "corroborated") & (F.col("groups") < 2),
        "first seen is not after last seen": F.col("first_seen") > F.col("last_seen"),
        "groups are not more than publishers": F.col("groups") > F.col("publishers"),
        "attributed has an attribution": (F.col("status") == "attributed") & ~F.col("attributed"),
    }
    return violations(grouped(spark, sf_dir), rules)


def violations(rows: DataFrame, rules: dict) -> DataFrame:
    """(rule, violations, checked, passes) in one pass over ``rows``."""
    checks = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(rule, F.lit(False)).alias("broken")) for name, rule in rules.items()])
    found = rows.select(F.explode(checks).alias("c")).groupBy("c.rule").agg(F.count_if("c.broken").alias("violations"), F.count("*").alias("checked"))
    return found.withColumn("passes", F.col("violations") == 0)


_SHARES_SQL = f"""{_GROUP_SQL}, a AS (SELECT event_id, avg((status = 'corroborated')::INT) AS cor, avg((status = 'single-source')::INT) AS single, avg((status = 'attributed')::INT) AS att, bool_or(value >= 45) AS ev FROM s GROUP BY event_id)"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda name: F.avg((F.col("status") == name).cast("int"))
    rows = grouped(spark, sf_dir)
    return rows.groupBy("event_id").agg(share("corroborated").alias("cor"), share("single-source").alias("single"), share("attributed").alias("att"), F.bool_or(F.col("value") >= 45).alias("ev"))


@register("weight_sensitivity", "R3 R12", V.sql("v_claims", f""", {_SHARES_SQL}, w AS (SELECT a.*, x.name, x.factor, y.ablate FROM a, (VALUES ('corroborated', 0.8::DOUBLE), ('corroborated', 1.0::DOUBLE), ('corroborated', 1.2::DOUBLE), ('single', 0.8::DOUBLE), ('single', 1.2::DOUBLE)) AS x(name, factor), (VALUES (false), (true)) AS y(ablate)),
    v AS (SELECT *, 40 + cor * 45 * CASE name WHEN 'corroborated' THEN factor ELSE 1 END + CASE WHEN ev AND NOT ablate THEN 10 ELSE 0 END - single * 25 * CASE name WHEN 'single' THEN factor ELSE 1 END - att * 12 AS score, 40 + cor * 45 + CASE WHEN ev THEN 10 ELSE 0 END - single * 25 - att * 12 AS base FROM w)
    SELECT name, factor, ablate, count(*) AS events, round(avg(score - base), 6) AS mean_change, count(*) FILTER (WHERE (score >= 70) <> (base >= 70) OR (score >= 45) <> (base >= 45)) AS band_flips FROM v GROUP BY 1, 2, 3"""))
def weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each weight by 20 % up and down, with and without primary evidence."""
    cases = [("corroborated", 0.8), ("corroborated", 1.0), ("corroborated", 1.2), ("single", 0.8), ("single", 1.2)]
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("factor"), F.lit(a).alias("ablate")) for n, f in cases for a in (False, True)])
    rows = shares(spark, sf_dir).select("*", F.explode(options).alias("o")).select("*", "o.*")
    factor = lambda name: F.when(F.col("name") == name, F.col("factor")).otherwise(1.0)
    evidence = F.when(F.col("ev"), 10).otherwise(0)
    score = 40 + F.col("cor") * 45 * factor("corroborated") + F.when(F.col("ablate"), 0).otherwise(evidence) - F.col("single") * 25 * factor("single") - F.col("att") * 12
    base = 40 + F.col("cor") * 45 + evidence - F.col("single") * 25 - F.col("att") * 12
    rows = rows.withColumns({"score": score, "base": base})
    flips = ((F.col("score") >= 70) != (F.col("base") >= 70)) | ((F.col("score") >= 45) != (F.col("base") >= 45))
    return rows.groupBy("name", "factor", "ablate").agg(F.count("*").alias("events"), F.round(F.avg(F.col("score") - F.col("base")), 6).alias("mean_change"), F.count_if(flips).alias("band_flips"))


@register("threshold_curve", "R4 R5", V.sql("v_articles", f""", {_PAIRS_SQL}, g AS (SELECT a, b, sim, a // 3 = b // 3 OR sim >= 0.95 AS gold FROM p WHERE sim >= 0.4)
    SELECT bar, count(*) FILTER (WHERE sim >= bar) AS merged, count(*) FILTER (WHERE sim >= bar AND gold) AS correct, count(*) FILTER (WHERE gold) AS candidates,
        CASE WHEN count(*) FILTER (WHERE sim >= bar) > 0 THEN round(count(*) FILTER (WHERE sim >= bar AND gold)::DOUBLE / count(*) FILTER (WHERE sim >= bar), 6) END AS precision,
        round(count(*) FILTER (WHERE sim >= bar AND gold)::DOUBLE / nullif(count(*) FILTER (WHERE gold), 0), 6) AS recall FROM g, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE), (1.01::DOUBLE)) AS x(bar) GROUP BY bar"""))
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall among candidates at each merge bar."""
    gold = (F.floor(F.col("a") / 3) == F.floor(F.col("b") / 3)) | (F.col("similarity") >= 0.95)
    rows = similar_pairs(spark, sf_dir, 0.4).withColumn("gold", gold).withColumn("bar", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.7, 0.9, 1.01)])))
    merged = F.col("similarity") >= F.col("bar")
    counts = rows.groupBy("bar").agg(F.count_if(merged).alias("merged"), F.count_if(merged & F.col("gold")).alias("correct"), F.count_if("gold").alias("candidates"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return counts.select("bar", "merged", "correct", "candidates", ratio("correct", "merged").alias("precision"), ratio("correct", "candidates").alias("recall"))


@register("miss_and_impact", "R6 R7", V.sql("v_articles", f""", {_PAIRS_SQL}, m AS (SELECT p.a, p.b, sim, x.publisher = y.publisher AS same_publisher, x.language <> y.language AS cross_language, x.family = y.family AS same_family FROM p JOIN v_articles x ON p.a = x.article_id JOIN v_articles y ON p.b = y.article_id WHERE sim >= 0.5)
    SELECT CASE WHEN sim >= 0.7 THEN 'merged' WHEN cross_language THEN 'cross-language' WHEN same_publisher THEN 'same publisher' WHEN sim < 0.6 THEN 'low overlap' ELSE 'below the bar' END AS cause, count(*) AS pairs, count(*) FILTER (WHERE same_family) AS same_family FROM m GROUP BY 1"""))
def miss_and_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why candidate pairs were not merged, and how many families that leaves apart."""
    who = V.articles(spark, sf_dir).select("article_id", "publisher", "language", "family")
    side = lambda k: who.select(*[F.col(c).alias(k if c == "article_id" else f"{c}_{k}") for c in who.columns])
    rows = similar_pairs(spark, sf_dir, 0.5).join(side("a"), "a").join(side("b"), "b")
    cause = (
        F.when(F.col("similarity") >= 0.7, "merged").when(F.col("language_a") != F.col("language_b"), "cross-language").when(F.col("publisher_a") == F.col("publisher_b"), "same publisher")
        .when(F.col("similarity") < 0.6, "low overlap").otherwise("below the bar")
    )
    return rows.groupBy(cause.alias("cause")).agg(F.count("*").alias("pairs"), F.count_if(F.col("family_a") == F.col("family_b")).alias("same_family"))


@register("audit_samples_verdicts_ablation", "R9 R10", V.sql("v_reports", f"""{_EDITED_SQL}, q AS (SELECT band, cluster_id, row_number() OVER (PARTITION BY band ORDER BY editorial DESC, cluster_id) AS place FROM b),
    picked AS (SELECT * FROM q WHERE place <= CASE band WHEN 'urgent' THEN 6 WHEN 'high' THEN 3 WHEN 'standard' THEN 3 ELSE 2 END),
    probe AS (SELECT cluster_id, count(*) AS items, bool_or(role = 'developing-unverified') AS bad, bool_and(role = 'developing-unverified') AS all_bad, count(DISTINCT publisher) AS probes FROM v_reports GROUP BY cluster_id)
    SELECT band, place, a.cluster_id, CASE WHEN all_bad THEN 'blocked' WHEN items < 2 THEN 'none' WHEN bad AND probes >= 20 THEN 'partial' WHEN bad THEN 'discovery-only' ELSE 'direct' END AS verdict FROM picked a JOIN probe v ON a.cluster_id = v.cluster_id"""))
def audit_samples_verdicts_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota samples of each band, with a verdict from the cluster's probe rows."""
    ranked = first_per_group(Workspace(spark, "audit").keep(edited(spark, sf_dir).select("band", "cluster_id", "editorial"), "edited"), ["band"], [F.desc("editorial"), F.col("cluster_id")], 6)
    quota = F.when(F.col("band") == "urgent", 6).when(F.col("band").isin("high", "standard"), 3).otherwise(2)
    bad = F.col("role") == "developing-unverified"
    probes = V.reports(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("items"), F.bool_or(bad).alias("bad"), F.bool_and(bad).alias("all_bad"), F.count_distinct("publisher").alias("probes"))
    verdict = (
        F.when(F.col("all_bad"), "blocked").when(F.col("items") < 2, "none").when(F.col("bad") & (F.col("probes") >= 20), "partial").when(F.col("bad"), "discovery-only").otherwise("direct")
    )
    return ranked.where(F.col("place") <= quota).join(probes, "cluster_id").select("band", "place", "cluster_id", verdict.alias("verdict"))
