"""Velocity, trend and editorial scores, verification, situation, feed health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.catalog import register
from gleaner.functions.scales import ascending_sql, descending_sql
from gleaner.operators import trends as T
from gleaner.sources import views as V

_AGE = f"(epoch_us(TIMESTAMP '{V.NOW}') - epoch_us(published_at)) / 3.6e9"
_FAMS = ", ".join(f"count(DISTINCT CASE WHEN age >= 0 AND age <= {h} THEN family END) AS {n}" for n, h in T.WINDOWS.items())


@register("trailing_family_windows", "H1", V.sql("v_reports", f", a AS (SELECT *, {_AGE} AS age FROM v_reports) SELECT cluster_id, {_FAMS} FROM a GROUP BY cluster_id"))
def trailing_family_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trailing_families(V.reports(spark, sf_dir), V.now(), ["cluster_id"])


_VELOCITY_SQL = f""", a AS (SELECT *, {_AGE} AS age FROM v_reports),
    c AS (SELECT cluster_id, count(*) AS reports, count(DISTINCT CASE WHEN age >= 0 AND age <= 1 THEN family END) AS n1,
        count(DISTINCT CASE WHEN age > 1 AND age <= 7 THEN family END) AS n6, min(age) AS newest, max(age) AS oldest,
        min(CASE WHEN published_at < TIMESTAMP '{V.PREVIOUS}' THEN age END) AS quiet_from,
        count(DISTINCT CASE WHEN age >= 0 THEN family END) AS families, bool_or(role = 'official-alert' AND age >= 0 AND age <= 24) AS official,
        max(figure) AS figure, count(DISTINCT publisher) AS publishers FROM a WHERE age >= 0 GROUP BY cluster_id),
    m AS (SELECT *, reports >= 2 AND (n1 > 0 OR n6 > 0) AS measurable, n1 / greatest(n6 / 6.0::DOUBLE, 0.2::DOUBLE) AS rate FROM c),
    v AS (SELECT *, CASE WHEN measurable THEN rate ELSE 0 END AS acceleration,
        CASE WHEN measurable THEN {descending_sql("rate", T.VELOCITY, T.VELOCITY_BEYOND)} ELSE {T.VELOCITY_BASELINE}::DOUBLE END AS velocity FROM m)"""


def cluster_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scores below read of each cluster, as of the fixed clock."""
    reports = V.reports(spark, sf_dir).withColumn("age", V.hours(V.now(), F.col("published_at"))).where("age >= 0")
    facts = reports.groupBy("cluster_id").agg(
        F.min("age").alias("newest"),
        F.max("age").alias("oldest"),
        F.min(F.when(F.col("published_at") < V.now(V.PREVIOUS), F.col("age"))).alias("quiet_from"),
        F.count_distinct("family").alias("families"),
        F.bool_or((F.col("role") == "official-alert") & (F.col("age") <= 24)).alias("official"),
        F.max("figure").alias("figure"),
        F.count_distinct("publisher").alias("publishers"),
    )
    return facts.join(T.velocity(reports, V.now(), ["cluster_id"]), "cluster_id")


_STATE_SQL = """CASE WHEN quiet_from IS NULL AND oldest <= 6 THEN 'new' WHEN quiet_from IS NOT NULL AND quiet_from - newest >= 12 AND velocity >= 0.55 THEN 'resurging'
    WHEN velocity >= 0.8 THEN 'fast-rising' WHEN velocity >= 0.55 THEN 'rising' WHEN velocity <= 0.26 AND oldest > 6 THEN 'fading' ELSE 'stable' END"""
_GEO = ((33, 1.0), (66, 0.5), (98, 0.28))
_PARTS_SQL = {
    "recency": ascending_sql("newest * 60", T.RECENCY, T.RECENCY_BEYOND),
    "velocity": "velocity",
    "diversity": "least(greatest((families - 1) / 5.0::DOUBLE, 0), 1)",
    "geo": ascending_sql("cluster_id", _GEO, 0.0),
    "category": "CASE WHEN cluster_id % 3 = 0 THEN 1.0 WHEN cluster_id % 3 = 1 THEN 0.72 ELSE 0.22 END::DOUBLE",
    "consequence": "least(1, least(1, figure / 100.0::DOUBLE) + CASE WHEN official THEN 0.15 ELSE 0 END)",
    "novelty": "CASE WHEN newest <= 3 THEN 0.8 ELSE 0.25 END::DOUBLE",
    "corroboration": "CASE WHEN official AND families >= 1 THEN 1.0 WHEN families >= 3 THEN 0.9 WHEN families = 2 THEN 0.65 WHEN official THEN 0.5 ELSE 0.2 END::DOUBLE",
}
_SCORE_SQL = "CASE WHEN p_geo = 0 THEN 0 ELSE floor(100 * exp(" + " + ".join(f"{w} * ln(greatest(p_{n}, 0.03::DOUBLE))" for n, w in T.TREND_WEIGHTS.items()) + ") * 10 + 0.5) / 10 END"
_SCORED_SQL = f"""{_VELOCITY_SQL}, p AS (SELECT *, {", ".join(f"{x} AS p_{n}" for n, x in _PARTS_SQL.items())}, {_STATE_SQL} AS state FROM v),
    s AS (SELECT *, {_SCORE_SQL} AS score FROM p)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.functions.scales import ascending

    signals = cluster_signals(spark, sf_dir)
    parts = {
        "recency": T.recency(F.col("newest") * 60),
        "velocity": F.col("velocity"),
        "diversity": T.diversity(F.col("families")),
        "geo": ascending(F.col("cluster_id"), _GEO, 0.0),
        "category": F.when(F.col("cluster_id") % 3 == 0, 1.0).when(F.col("cluster_id") % 3 == 1, 0.72).otherwise(0.22),
        "consequence": F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("figure") / 100) + F.when(F.col("official"), 0.15).otherwise(0.0)),
        "novelty": F.when(F.col("newest") <= 3, T.NOVELTY_SCORE["new-fact"]).otherwise(T.NOVELTY_SCORE["more-of-same"]),
        "corroboration": T.corroboration(F.col("families"), F.col("official")),
    }
    seen = F.col("quiet_from").isNotNull()
    state = T.trend_state(F.col("velocity"), F.col("oldest"), F.col("quiet_from") - F.col("newest"), seen, ~seen)
    named = signals.withColumns({f"p_{name}": part for name, part in parts.items()} | {"state": state})
    return named.withColumn("score", T.trend_score({name: F.col(f"p_{name}") for name in parts}))


@register("event_velocity", "H1 H2 H3 I1 I2 J6", V.sql("v_reports", f"""{_SCORED_SQL}
    SELECT cluster_id, reports, families, round(acceleration, 4) AS acceleration, velocity, state, score FROM s
    WHERE score >= {T.TREND_MIN} AND (families >= 2 OR official) ORDER BY score DESC, cluster_id LIMIT 30"""))
def event_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trending list: clusters by trend score."""
    found = scored(spark, sf_dir).where((F.col("score") >= T.TREND_MIN) & ((F.col("families") >= 2) | F.col("official")))
    found = found.orderBy(F.desc("score"), "cluster_id").limit(30)
    return found.select("cluster_id", "reports", "families", F.round("acceleration", 4).alias("acceleration"), "velocity", "state", "score")


@register("trend_score_geomean", "I1 I2 H9", V.sql("v_reports", f"""{_SCORED_SQL}
    SELECT cluster_id, state, score, {", ".join(f"round(p_{n}, 6) AS p_{n}" for n in _PARTS_SQL)} FROM s"""))
def trend_score_geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("cluster_id", "state", "score", *[F.round(f"p_{n}", 6).alias(f"p_{n}") for n in _PARTS_SQL])


_EDITORIAL_SQL = {
    "geo_relevance": "p_geo", "category_priority": "p_category", "consequence": "p_consequence", "information_gain": "p_novelty",
    "corroboration": "CASE WHEN families >= 5 THEN 1 WHEN families = 4 THEN CASE WHEN official THEN 1 ELSE 0.85 END WHEN families = 3 THEN CASE WHEN official THEN 0.88 ELSE 0.72 END WHEN families = 2 THEN CASE WHEN official THEN 0.68 ELSE 0.5 END WHEN official THEN 0.42 ELSE 0.15 END::DOUBLE",
    "meaningful_recency": ascending_sql("newest * 60", T.EDITORIAL_RECENCY, 0.03),
    "local_impact": "CASE WHEN p_geo = 1 THEN least(1, 0.35 + 0.09 * least(publishers, 6) + 0.05 * least(families, 4)) WHEN p_geo = 0.5 THEN 0.1 ELSE 0 END::DOUBLE",
    "velocity": "least(1, velocity)",
}
_PENALTY_SQL = "CASE WHEN newest > 24 THEN 0.26 WHEN newest > 12 THEN 0.12 ELSE 0 END::DOUBLE + CASE WHEN families <= 1 AND NOT official THEN 0.12 ELSE 0 END::DOUBLE + CASE WHEN reports > 1 AND reports > publishers THEN 0.16 * (reports - publishers) / reports ELSE 0 END::DOUBLE"
_EDITORIAL_SCORE = " + ".join(f"floor(({_EDITORIAL_SQL[n]}) * {w} * 1000 + 0.5) / 1000" for n, w in T.EDITORIAL_WEIGHTS.items())
_EDITED_SQL = f"""{_SCORED_SQL}, e AS (SELECT *, floor(least(greatest({_EDITORIAL_SCORE} - ({_PENALTY_SQL}), 0), 1) * 100 * 10 + 0.5) / 10 AS editorial FROM s),
    b AS (SELECT *, CASE WHEN p_geo = 0 THEN 'suppressed' WHEN editorial >= 60 AND p_novelty >= 0.45 AND p_corroboration >= 0.45 THEN 'urgent'
        WHEN editorial >= 42 OR (p_geo = 1 AND p_consequence >= 0.6 AND p_novelty >= 0.5) THEN 'high' WHEN editorial >= 24 THEN 'standard'
        WHEN editorial >= 5 THEN 'background' ELSE 'suppressed' END AS band FROM e)"""


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with editorial score and band."""
    from gleaner.functions.scales import ascending

    official, families = F.col("official"), F.col("families")
    support = (
        F.when(families >= 5, 1.0).when(families == 4, F.when(official, 1.0).otherwise(0.85)).when(families == 3, F.when(official, 0.88).otherwise(0.72))
        .when(families == 2, F.when(official, 0.68).otherwise(0.5)).when(official, 0.42).otherwise(0.15)
    )
    local = F.least(F.lit(1.0), 0.35 + 0.09 * F.least("publishers", F.lit(6)) + 0.05 * F.least(families, F.lit(4)))
    parts = {
        "geo_relevance": F.col("p_geo"),
        "category_priority": F.col("p_category"),
        "consequence": F.col("p_consequence"),
        "information_gain": F.col("p_novelty"),
        "corroboration": support,
        "meaningful_recency": ascending(F.col("newest") * 60, T.EDITORIAL_RECENCY, 0.03),
        "local_impact": F.when(F.col("p_geo") == 1, local).when(F.col("p_geo") == 0.5, 0.1).otherwise(0.0),
        "velocity": F.least(F.lit(1.0), F.col("velocity")),
    }
    copies = F.col("reports") - F.col("publishers")
    penalties = (
        F.when(F.col("newest") > 24, T.PENALTY["stale_24h"]).when(F.col("newest") > 12, T.PENALTY["stale_12h"]).otherwise(0.0)
        + F.when((families <= 1) & ~official, T.PENALTY["weak_evidence"]).otherwise(0.0)
        + F.when((F.col("reports") > 1) & (copies > 0), T.PENALTY["syndication"] * copies / F.col("reports")).otherwise(0.0)
    )
    found = scored(spark, sf_dir).withColumn("editorial", T.editorial_score(parts, penalties))
    urgent = (F.col("editorial") >= 60) & (F.col("p_novelty") >= 0.45) & (F.col("p_corroboration") >= 0.45)
    high = (F.col("editorial") >= 42) | ((F.col("p_geo") == 1) & (F.col("p_consequence") >= 0.6) & (F.col("p_novelty") >= 0.5))
    band = F.when(F.col("p_geo") == 0, "suppressed").when(urgent, "urgent").when(high, "high").otherwise(T.band(F.col("editorial"), T.BANDS[2:]))
    return found.withColumn("band", band)


@register("priority_arithmetic_bands", "I4 I5 B11 B12 B8", V.sql("v_reports", f"""{_EDITED_SQL}
    SELECT cluster_id, editorial, band,
        least(greatest(floor((CASE WHEN official THEN 18 ELSE 0 END + least(figure % 50, 38) + least(figure % 41, 36) + CASE WHEN p_geo = 1 THEN 16 WHEN p_geo = 0.5 THEN 6 ELSE 0 END
            + least(families * 2, 12) + {ascending_sql("newest", ((3, 14), (6, 11), (12, 8), (24, 4), (48, 1)), 0)} + least(publishers * 3, 9) + 0)
            * CASE WHEN newest > 72 THEN 0.05 WHEN newest > 36 THEN 0.15 ELSE 1.0 END::DOUBLE + 0.5), 0), 100)::DOUBLE AS crisis_priority,
        least(greatest(floor(4 + CASE WHEN p_geo = 1 THEN 10 WHEN p_geo = 0.5 THEN 6 ELSE 0 END + least(families * 2, 8) + CASE WHEN official THEN 4 ELSE 0 END
            + {ascending_sql("newest", ((6, 8), (24, 4), (72, 1)), 0)} + least(publishers * 2, 6) + 0.5), 0), 60)::DOUBLE AS plain_priority FROM b"""))
def priority_arithmetic_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("p_geo") == 1, "region").when(F.col("p_geo") == 0.5, "relevant").otherwise("other")
    life = F.when(F.col("newest") > 72, "archived").when(F.col("newest") > 36, "all-clear").otherwise("active")
    crisis = T.crisis_priority(F.col("official"), F.col("figure") % 50, F.col("figure") % 41, scope, F.col("families"), F.col("newest"), F.col("publishers"), F.lit(False), life)
    plain = T.plain_priority(scope, F.col("families"), F.col("official"), F.col("newest"), F.col("publishers"))
    return edited(spark, sf_dir).select("cluster_id", "editorial", "band", crisis.alias("crisis_priority"), plain.alias("plain_priority"))


@register("verification_ladder", "B13 C11", V.sql("v_reports", f""", k AS (SELECT *, floor(figure / 20)::INT AS kind FROM v_reports),
    j AS (SELECT a.report_id, any_value(a.role) AS role, count(DISTINCT CASE WHEN b.publisher <> a.publisher THEN b.publisher END) AS sources,
            coalesce(bool_or(b.publisher <> a.publisher AND b.role = 'official-alert'), false) AS official
        FROM k a LEFT JOIN k b ON a.cluster_id = b.cluster_id AND a.kind IS NOT DISTINCT FROM b.kind AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) < 30 * 3600000000
        GROUP BY a.report_id)
    SELECT report_id, sources, CASE WHEN role IN ('official-alert', 'primary-document') THEN 'official' WHEN official AND sources >= 1 THEN 'corroborated'
        WHEN sources >= 2 THEN 'corroborated' WHEN sources = 1 THEN 'single-source' WHEN role = 'developing-unverified' THEN 'developing' ELSE 'single-source' END AS verification FROM j"""))
def verification_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers within 30 hours that report the same kind, from other publishers; they are
    counted from the ends of each publisher's intervals, so no pairs are made. Reports of
    no cluster have no peers."""
    from gleaner.operators.pairs import peers_in_band

    rows = V.reports(spark, sf_dir).withColumn("kind", F.floor(F.col("figure") / 20).cast("int")).withColumn("who", F.when(F.col("cluster_id").isNotNull(), F.col("publisher")))
    rows = rows.select("report_id", "cluster_id", "kind", "who", "published_at", "role")
    peers = peers_in_band(rows, ["cluster_id", "kind"], "who", "published_at", 30 * 3600, F.col("role") == "official-alert")
    counts = peers.groupBy("report_id").agg(F.any_value("role").alias("role"), F.max("peers").alias("sources"), F.bool_or("flagged").alias("official"))
    return counts.select("report_id", "sources", T.verification(F.col("role"), F.col("sources"), F.col("official")).alias("verification"))


@register("situation_level", "I6", V.sql("v_reports", f"""{_EDITED_SQL}, active AS (SELECT * FROM b WHERE newest <= 24 AND p_geo > 0),
    n AS (SELECT count(*) AS active, count(*) FILTER (WHERE band = 'urgent') AS urgent, count(*) FILTER (WHERE band IN ('urgent', 'high')) AS high, max(editorial) AS top FROM active),
    d AS (SELECT list(cluster_id ORDER BY editorial DESC, cluster_id) AS ids FROM active)
    SELECT active, urgent, high, CASE WHEN urgent >= 3 OR (urgent >= 1 AND high >= 6) THEN 'crisis' WHEN urgent >= 1 OR high >= 5 THEN 'elevated' WHEN high >= 1 THEN 'watch' ELSE 'normal' END AS level,
        array_to_string(list_transform(ids[1:4], lambda x: x::VARCHAR), ',') AS drivers FROM n, d"""))
def situation_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level for all active clusters, and the four that drive it."""
    active = edited(spark, sf_dir).where("newest <= 24 and p_geo > 0")
    drivers = active.orderBy(F.desc("editorial"), "cluster_id").limit(4)
    counts = active.agg(
        F.count("*").alias("active"), F.count_if(F.col("band") == "urgent").alias("urgent"), F.count_if(F.col("band").isin("urgent", "high")).alias("high")
    )
    tops = drivers.agg(F.sort_array(F.collect_list(F.struct((-F.col("editorial")).alias("k"), "cluster_id"))).alias("top"))
    level = (
        F.when((F.col("urgent") >= 3) | ((F.col("urgent") >= 1) & (F.col("high") >= 6)), "crisis")
        .when((F.col("urgent") >= 1) | (F.col("high") >= 5), "elevated")
        .when(F.col("high") >= 1, "watch")
        .otherwise("normal")
    )
    return counts.join(F.broadcast(tops)).select("active", "urgent", "high", level.alias("level"), F.array_join(F.transform("top", lambda x: x["cluster_id"].cast("string")), ",").alias("drivers"))


@register("feed_health_rollup", "B32 G11", V.sql("v_reports", f""", r AS (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY published_at, report_id) AS k,
        count(*) OVER (PARTITION BY publisher) AS n, {_AGE} AS age FROM v_reports),
    f AS (SELECT publisher, count(*) AS items, count(*) FILTER (WHERE role = 'developing-unverified') AS failed, min(age) AS newest FROM r GROUP BY publisher),
    lag AS (SELECT publisher, floor(age * 60 + 0.5)::BIGINT AS median_lag FROM (SELECT publisher, age, row_number() OVER (PARTITION BY publisher ORDER BY age) - 1 AS pos, n FROM r) WHERE pos = n // 2)
    SELECT f.publisher, items, failed, median_lag, CASE WHEN items < 2 THEN 'empty' WHEN failed::DOUBLE / items > 0.5 THEN 'failed' WHEN newest > 72 THEN 'stale' WHEN failed::DOUBLE / items > 0.25 THEN 'degraded' ELSE 'ok' END AS health
    FROM f JOIN lag ON f.publisher = lag.publisher"""))
def feed_health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of each publisher's feed, with its upper median lag in minutes."""
    rows = V.reports(spark, sf_dir).withColumn("age", V.hours(V.now(), F.col("published_at")))
    ordered = Window.partitionBy("publisher").orderBy("age")
    ranked = rows.withColumn("pos", F.row_number().over(ordered) - 1).withColumn("n", F.count("*").over(Window.partitionBy("publisher")))
    found = ranked.groupBy("publisher").agg(
        F.count("*").alias("items"),
        F.count_if(F.col("role") == "developing-unverified").alias("failed"),
        F.min("age").alias("newest"),
        F.max(F.when(F.col("pos") == F.floor(F.col("n") / 2), F.floor(F.col("age") * 60 + 0.5))).alias("median_lag"),
    )
    share = F.col("failed") / F.col("items")
    health = F.when(F.col("items") < 2, "empty").when(share > 0.5, "failed").when(F.col("newest") > 72, "stale").when(share > 0.25, "degraded").otherwise("ok")
    return found.select("publisher", "items", "failed", "median_lag", health.alias("health"))
