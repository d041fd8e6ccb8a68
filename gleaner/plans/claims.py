"""Claim grouping, disputes, supersession, confidence, evidence, independence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.catalog import register
from gleaner.functions import text as X
from gleaner.operators import claims as C
from gleaner.operators.asof import asof_join
from gleaner.operators.components import connected_components
from gleaner.plans.identity import _SET_SQL, similar_pairs, token_sets
from gleaner.sources import views as V
from gleaner.storage import Workspace

#: Claims are judged as of this time.
AT = "2001-11-01 00:00:00"
_ATTR = "(event_id + value::BIGINT) % 11 = 0"
_TYPE = "CASE WHEN value::BIGINT % 7 = 0 THEN 'allegation' ELSE 'statistic' END"
_GROUP_SQL = f"""c AS (SELECT *, {_ATTR} AS attributed, {_TYPE} AS type FROM v_claims),
    g AS (SELECT event_id, kind, value, count(*) AS reports, count(DISTINCT publisher) AS publishers, count(DISTINCT family) AS groups, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
        bool_and(attributed) AS attributed, any_value(type) = 'allegation' AS allegation FROM c GROUP BY event_id, kind, value),
    s AS (SELECT *, CASE WHEN attributed THEN 'attributed' WHEN allegation THEN CASE WHEN publishers >= 2 THEN 'partially-corroborated' ELSE 'single-source' END
        WHEN groups >= 2 THEN 'corroborated' WHEN publishers >= 2 THEN 'partially-corroborated' ELSE 'single-source' END AS status FROM g)"""


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.claims(spark, sf_dir).withColumn("whole", F.col("value").cast("long"))
    found = C.group_claims(rows, ["event_id", "kind", "value", "whole"])
    attributed, allegation = (F.col("event_id") + F.col("whole")) % 11 == 0, F.col("whole") % 7 == 0
    return found.withColumns({"attributed": attributed, "allegation": allegation, "status": C.status(attributed, allegation, F.col("groups"), F.col("publishers"))}).drop("whole")


@register("claim_grouping_status", "E11 E12 F2", V.sql("v_claims", f", {_GROUP_SQL} SELECT event_id, kind, value, reports, publishers, groups, first_seen, last_seen, status FROM s"))
def claim_grouping_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).select("event_id", "kind", "value", "reports", "publishers", "groups", "first_seen", "last_seen", "status")


_DISPUTE_SQL = """w AS (SELECT event_id, kind, value, min(seen_at) AS earliest, max(seen_at) AS latest FROM v_claims WHERE value > 0 GROUP BY event_id, kind, value),
    o AS (SELECT *, row_number() OVER (PARTITION BY event_id, kind ORDER BY earliest, value) AS k, count(*) OVER (PARTITION BY event_id, kind) AS n FROM w),
    d AS (SELECT x.event_id, x.kind, x.n AS values, x.value AS value_a, x.earliest AS at_a, y.value AS value_b, y.latest AS at_b,
        abs(epoch_us(y.latest) - epoch_us(x.earliest)) / 6e7 > 45 AS update, abs(y.value - x.value) / least(x.value, y.value) AS gap FROM o x JOIN o y ON x.event_id = y.event_id AND x.kind = y.kind AND x.k = 1 AND y.k = y.n WHERE x.n >= 2)"""


@register("numeric_disputes", "F6 H10", V.sql("v_claims", f""", {_DISPUTE_SQL} SELECT event_id, kind, values, value_a, at_a, value_b, at_b, update, CASE WHEN update OR gap < 0.2 THEN 'low' WHEN gap < 0.5 THEN 'moderate' ELSE 'high' END AS confidence FROM d"""))
def numeric_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numeric_disputes(V.claims(spark, sf_dir), ["event_id", "kind"])


@register("supersession", "F9", V.sql("v_claims", f""", {_DISPUTE_SQL}, {_GROUP_SQL} SELECT s.event_id, s.kind, s.value, CASE WHEN d.update AND s.value = d.value_a THEN 'outdated' ELSE s.status END AS status, CASE WHEN d.update AND s.value = d.value_a THEN d.value_b END AS superseded_by
    FROM s JOIN d ON s.event_id = d.event_id AND s.kind = d.kind"""))
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that a later figure updates is outdated."""
    disputes = C.numeric_disputes(V.claims(spark, sf_dir), ["event_id", "kind"]).select("event_id", "kind", "value_a", "value_b", "update")
    rows = grouped(spark, sf_dir).join(disputes, ["event_id", "kind"])
    old = F.col("update") & (F.col("value") == F.col("value_a"))
    return rows.select("event_id", "kind", "value", F.when(old, "outdated").otherwise(F.col("status")).alias("status"), F.when(old, F.col("value_b")).alias("superseded_by"))


_DAILY_SQL = """wd AS (SELECT event_id, kind, seen_at::DATE AS day, value, min(seen_at) AS earliest, max(seen_at) AS latest FROM v_claims WHERE value > 0 GROUP BY ALL),
    od AS (SELECT *, row_number() OVER (PARTITION BY event_id, kind, day ORDER BY earliest, value) AS k, count(*) OVER (PARTITION BY event_id, kind, day) AS n FROM wd),
    hard AS (SELECT x.event_id, x.kind, x.day FROM od x JOIN od y ON x.event_id = y.event_id AND x.kind = y.kind AND x.day = y.day AND x.k = 1 AND y.k = y.n
        WHERE x.n >= 2 AND abs(epoch_us(y.latest) - epoch_us(x.earliest)) / 6e7 <= 45 AND abs(y.value - x.value) / least(x.value, y.value) >= 0.2)"""
_JUDGED_SQL = f"""{_GROUP_SQL}, {_DAILY_SQL}, j AS (SELECT s.*, value >= 45 AS primary_record, hard.day IS NOT NULL AND status <> 'attributed' AS disputed, reports > 2 * groups AS syndicated, value::BIGINT % 3 = 0 AS unknown,
        (epoch_us(TIMESTAMP '{AT}') - epoch_us(last_seen)) / 3.6e9 AS age FROM s LEFT JOIN hard ON s.event_id = hard.event_id AND s.kind = hard.kind AND s.last_seen::DATE = hard.day),
    k AS (SELECT *, least(greatest(30 + CASE WHEN groups >= 3 THEN 32 WHEN groups = 2 THEN 24 ELSE 14 END + CASE WHEN primary_record THEN 18 ELSE 0 END + CASE WHEN NOT attributed AND NOT allegation THEN 6 WHEN allegation THEN -16 ELSE 0 END
        + CASE WHEN age < 6 THEN 6 WHEN age < 24 THEN 2 ELSE 0 END + CASE WHEN disputed THEN -22 ELSE 0 END + CASE WHEN syndicated THEN -8 ELSE 0 END + CASE WHEN unknown AND groups < 2 THEN -6 ELSE 0 END, 0), 100) AS raw FROM j),
    f AS (SELECT *, CASE WHEN unknown AND groups < 2 THEN least(raw, 69) ELSE raw END AS confidence FROM k)"""


def daily_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard disputes of an event's kind on one day."""
    keys = ["event_id", "kind", "day"]
    return C.hard_disputes(C.numeric_disputes(V.claims(spark, sf_dir).withColumn("day", F.col("seen_at").cast("date")), keys), keys)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with what confidence takes; disputed if their kind is in a hard dispute
    of the day they were last seen."""
    whole = F.col("value").cast("long")
    rows = grouped(spark, sf_dir).withColumn("day", F.col("last_seen").cast("date"))
    rows = C.propagate_disputes(rows, daily_disputes(spark, sf_dir), ["event_id", "kind", "day"]).drop("day").withColumns(
        {
            "primary_record": F.col("value") >= 45,
            "syndicated": F.col("reports") > 2 * F.col("groups"),
            "unknown": whole % 3 == 0,
            "age": V.hours(V.now(AT), F.col("last_seen")),
        }
    )
    score = C.confidence(
        F.col("groups"), F.col("publishers"), F.col("primary_record"), ~F.col("attributed"), F.col("allegation"), F.col("age"), F.col("disputed"), F.col("syndicated"), F.col("unknown")
    )
    return rows.withColumn("confidence", score)


@register("claim_confidence", "F10 F13", V.sql("v_claims", f""", {_JUDGED_SQL} SELECT event_id, kind, value, confidence, CASE WHEN confidence >= 70 THEN 'high' WHEN confidence >= 40 THEN 'moderate' ELSE 'low' END AS band,
    row_number() OVER (PARTITION BY event_id ORDER BY CASE status WHEN 'corroborated' THEN 0 WHEN 'partially-corroborated' THEN 1 WHEN 'attributed' THEN 2 ELSE 3 END, confidence DESC, kind, value) AS place FROM f"""))
def claim_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, its band, and the claim's place in its event's list."""
    rows = judged(spark, sf_dir)
    rank = F.array_position(F.array(*[F.lit(s) for s in C.STATUS_ORDER]), F.col("status"))
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(rank, F.desc("confidence"), "kind", "value"))
    return rows.select("event_id", "kind", "value", "confidence", C.confidence_band(F.col("confidence")).alias("band"), place.alias("place"))


@register("common_ground_index", "F11", V.sql("v_claims", f""", {_JUDGED_SQL}, e AS (SELECT event_id, count(DISTINCT publisher) AS event_publishers, count(DISTINCT family) AS event_groups, count(*) - count(DISTINCT publisher) AS event_syndicated FROM v_claims GROUP BY event_id),
    a AS (SELECT f.event_id, count(*) AS n, count(*) FILTER (WHERE NOT disputed AND status IN ('corroborated', 'partially-corroborated')) AS cor, count(*) FILTER (WHERE NOT disputed AND status = 'single-source') AS single,
        count(*) FILTER (WHERE NOT disputed AND status = 'attributed') AS att, count(*) FILTER (WHERE disputed) AS dis, count(*) FILTER (WHERE primary_record) AS ev, count(*) FILTER (WHERE disputed AND syndicated) AS hard,
        max(event_publishers) AS event_publishers, max(event_groups) AS event_groups, max(event_syndicated) AS event_syndicated FROM f JOIN e ON f.event_id = e.event_id GROUP BY f.event_id),
    b AS (SELECT *, 40.0::DOUBLE + floor(cor::DOUBLE / n * 45 + 0.5) + CASE WHEN ev > 0 THEN 10 ELSE 0 END - floor(single::DOUBLE / n * 25 + 0.5) - floor(att::DOUBLE / n * 12 + 0.5) - floor(dis::DOUBLE / n * 30 + 0.5) - hard * 8
        - CASE WHEN event_syndicated > event_groups THEN 8 ELSE 0 END AS raw FROM a),
    x AS (SELECT *, CASE WHEN event_publishers >= 2 THEN least(greatest(CASE WHEN ev > 0 OR n >= 3 OR event_groups >= 3 THEN raw ELSE least(raw, 68) END, 0), 100) END AS cgi FROM b)
    SELECT event_id, n, cgi, CASE WHEN cgi >= 70 THEN 'high' WHEN cgi >= 45 THEN 'moderate' WHEN cgi IS NOT NULL THEN 'low' END AS band, CASE WHEN cgi IS NULL THEN 'fewer than two publishers' END AS withheld FROM x"""))
def common_ground_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.claims(spark, sf_dir).groupBy("event_id").agg(
        F.count_distinct("publisher").alias("event_publishers"), F.count_distinct("family").alias("event_groups"), (F.count("*") - F.count_distinct("publisher")).alias("event_syndicated")
    )
    rows = judged(spark, sf_dir).join(events, "event_id")
    rows = rows.select("event_id", F.when(F.col("disputed"), "disputed").otherwise(F.col("status")).alias("status"), F.col("primary_record").alias("evidence"), (F.col("disputed") & F.col("syndicated")).alias("hard_dispute"), "event_publishers", "event_groups", "event_syndicated")
    return C.common_ground(rows, ["event_id"])


@register("evidence_matrix_profile_strength", "F14 F15 F16 F17", V.sql("v_claims", f""", {_JUDGED_SQL}, v AS (SELECT *, CASE WHEN value::BIGINT % 49 = 0 THEN 'retracted' WHEN value::BIGINT % 23 = 0 THEN 'corrected' WHEN value::BIGINT % 19 = 0 THEN 'superseded' WHEN disputed THEN 'disputed'
        WHEN groups >= 3 AND primary_record THEN 'confirmed' WHEN groups >= 3 THEN 'well-supported' WHEN groups = 2 THEN 'supported' WHEN attributed THEN 'attributed' ELSE 'single-source' END AS evidence FROM f),
    n AS (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE evidence IN ('confirmed', 'well-supported', 'supported')) AS supported, count(*) FILTER (WHERE evidence = 'disputed') AS disputed, count(*) FILTER (WHERE evidence = 'single-source') AS single,
        count(*) FILTER (WHERE evidence = 'attributed') AS attributed, count(*) FILTER (WHERE primary_record) AS with_record, count(*) FILTER (WHERE groups >= 3) AS broad, count(*) FILTER (WHERE evidence IN ('retracted', 'corrected', 'superseded')) AS historical FROM v GROUP BY event_id)
    SELECT event_id, n, supported, disputed, single, attributed, historical, CASE WHEN n >= 2 THEN round(least(greatest(30.0::DOUBLE * supported / n + 25.0::DOUBLE * broad / n + CASE WHEN with_record > 0 THEN 15 ELSE 0 END + 20.0::DOUBLE * with_record / n
        - 20.0::DOUBLE * disputed / n - 10.0::DOUBLE * attributed / n - 15.0::DOUBLE * single / n, 0), 100), 4) END AS strength FROM n"""))
def evidence_matrix_profile_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by evidence status, and strength from two claims on."""
    whole = F.col("value").cast("long")
    verdict = C.evidence_status(whole % 49 == 0, whole % 23 == 0, whole % 19 == 0, F.col("disputed"), F.col("groups"), F.col("primary_record"), F.col("attributed"))
    rows = judged(spark, sf_dir).withColumn("evidence", verdict)
    counts = rows.groupBy("event_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("evidence").isin("confirmed", "well-supported", "supported")).alias("supported"),
        F.count_if(F.col("evidence") == "disputed").alias("disputed"),
        F.count_if(F.col("evidence") == "single-source").alias("single"),
        F.count_if(F.col("evidence") == "attributed").alias("attributed"),
        F.count_if("primary_record").alias("with_record"),
        F.count_if(F.col("groups") >= 3).alias("broad"),
        F.count_if(F.col("evidence").isin("retracted", "corrected", "superseded")).alias("historical"),
    )
    share = lambda name: F.col(name) / F.col("n")
    raw = (
        30.0 * share("supported") + 25.0 * share("broad") + F.when(F.col("with_record") > 0, 15).otherwise(0) + 20.0 * share("with_record")
        - 20.0 * share("disputed") - 10.0 * share("attributed") - 15.0 * share("single")
    )
    strength = F.when(F.col("n") >= 2, F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 4))
    return counts.select("event_id", "n", "supported", "disputed", "single", "attributed", "historical", strength.alias("strength"))


@register("evidence_linking", "C7 E16 F12", V.sql("v_claims", """, alerts AS (SELECT event_id, min(seen_at) AS at, kind, count(*) AS copies FROM v_claims WHERE publisher % 10 = 0 GROUP BY event_id, kind),
    one AS (SELECT event_id, count(*) AS n FROM alerts GROUP BY event_id)
    SELECT c.event_id, c.kind, count(DISTINCT c.publisher) AS publishers, bool_or(a.kind = c.kind) AS by_kind, bool_or(o.n = 1) AS only_alert, count(DISTINCT a.kind) AS evidence,
        CASE WHEN bool_or(a.kind = c.kind) THEN 'none' WHEN bool_or(o.n = 1) THEN 'kind not named in the alert' ELSE 'no record found' END AS unknowns
    FROM v_claims c LEFT JOIN alerts a ON c.event_id = a.event_id LEFT JOIN one o ON c.event_id = o.event_id WHERE c.publisher % 10 <> 0 GROUP BY c.event_id, c.kind""").replace("bool_or(a.kind = c.kind) AS by_kind, bool_or(o.n = 1) AS only_alert", "coalesce(bool_or(a.kind = c.kind), false) AS by_kind, coalesce(bool_or(o.n = 1), false) AS only_alert"))
def evidence_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a claim's event: by kind, or as the event's only alert; one row of
    evidence for each distinct alert."""
    rows = V.claims(spark, sf_dir)
    alerts = rows.where("publisher % 10 = 0").select("event_id", F.col("kind").alias("alert")).distinct()
    known = alerts.groupBy("event_id").agg(F.collect_set("alert").alias("alerts"))
    claims = rows.where("publisher % 10 <> 0").groupBy("event_id", "kind").agg(F.count_distinct("publisher").alias("publishers"))
    found = claims.join(known, "event_id", "left")
    by_kind = F.coalesce(F.array_contains("alerts", F.col("kind")), F.lit(False))
    only = F.coalesce(F.size("alerts") == 1, F.lit(False))
    return found.select(
        "event_id", "kind", "publishers", by_kind.alias("by_kind"), only.alias("only_alert"), F.coalesce(F.size("alerts"), F.lit(0)).cast("long").alias("evidence"),
        F.when(by_kind, "none").when(only, "kind not named in the alert").otherwise("no record found").alias("unknowns"),
    ).withColumn("evidence", F.greatest("evidence", F.lit(0).cast("long")))


_INDEPENDENCE_SQL = f"""{_SET_SQL}, m AS (SELECT *, article_id // 12 AS cluster, CASE article_id % 8 WHEN 0 THEN 'PTI' WHEN 1 THEN 'ANI' END AS wire FROM t),
    r AS (SELECT a.article_id AS a, b.article_id AS b, a.cluster, len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0) AS sim, a.publisher = b.publisher AS same_publisher, a.family = b.family AS same_family,
        a.wire = b.wire AS same_wire, (a.wire IS NULL) <> (b.wire IS NULL) AS one_wire, length(a.title) < 40 AND length(b.title) < 40 AS thin FROM m a JOIN m b ON a.cluster = b.cluster AND a.article_id < b.article_id),
    rel AS (SELECT a, b, cluster, CASE WHEN same_publisher THEN 'syndicated' WHEN same_family THEN 'likely-syndicated' WHEN same_wire THEN 'syndicated' WHEN coalesce(sim, 0) >= 0.999 THEN 'likely-syndicated'
        WHEN one_wire THEN 'unknown' WHEN thin THEN 'unknown' WHEN coalesce(sim, 0) >= 0.85 THEN 'likely-syndicated' ELSE 'likely-independent' END AS relation FROM r)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a cluster (of twelve articles) and how they depend on each other."""
    from gleaner.operators.pairs import jaccard

    wire = F.when(F.col("article_id") % 8 == 0, "PTI").when(F.col("article_id") % 8 == 1, "ANI")
    rows = token_sets(spark, sf_dir).withColumn("cluster", F.floor(F.col("article_id") / 12)).withColumn("wire", wire)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.article_id") < F.col("b.article_id")))
    sim = jaccard(F.col("a.w"), F.col("b.w"))
    kind = (
        F.when(F.col("a.publisher") == F.col("b.publisher"), "syndicated")
        .when(F.col("a.family") == F.col("b.family"), "likely-syndicated")
        .when(F.col("a.wire") == F.col("b.wire"), "syndicated")
        .when(sim >= 0.999, "likely-syndicated")
        .when(F.col("a.wire").isNull() != F.col("b.wire").isNull(), "unknown")
        .when((F.length("a.title") < 40) & (F.length("b.title") < 40), "unknown")
        .when(sim >= 0.85, "likely-syndicated")
        .otherwise("likely-independent")
    )
    return pairs.select(F.col("a.article_id").alias("a"), F.col("b.article_id").alias("b"), F.col("a.cluster").alias("cluster"), kind.alias("relation"))


_CLOSE_SQL = """e AS (SELECT a, b FROM rel WHERE relation IN ('syndicated', 'likely-syndicated') UNION SELECT b, a FROM rel WHERE relation IN ('syndicated', 'likely-syndicated')),
    walk AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, walk.root FROM walk JOIN e ON walk.node = e.a), comp AS (SELECT node, min(root) AS component FROM walk GROUP BY node)"""


@register("independence_components", "C12 F1 F19", V.sql("v_articles", f""", {_INDEPENDENCE_SQL}, {_CLOSE_SQL}, g AS (SELECT m.cluster, coalesce(component, article_id) AS grp, count(DISTINCT publisher) AS pubs, count(*) AS n FROM m LEFT JOIN comp ON m.article_id = comp.node GROUP BY 1, 2),
    u AS (SELECT cluster, count(*) FILTER (WHERE relation = 'unknown') AS unknown_pairs FROM rel GROUP BY cluster)
    SELECT g.cluster, count(*) AS independent_groups, sum(pubs - 1)::BIGINT AS syndicated, coalesce(max(unknown_pairs), 0) AS unknown_pairs,
        CASE WHEN count(*) >= 3 THEN 'several independent newsrooms' WHEN count(*) = 2 THEN 'two independent newsrooms' WHEN sum(pubs - 1) > 0 THEN 'one newsroom, syndicated' WHEN coalesce(max(unknown_pairs), 0) > 0 THEN 'unclear' ELSE 'single newsroom' END AS label
    FROM g LEFT JOIN u ON g.cluster = u.cluster GROUP BY g.cluster""").replace("WITH", "WITH RECURSIVE", 1))
def independence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent groups of each cluster: components over syndicated pairs."""
    pairs = relations(spark, sf_dir)
    comps = connected_components(pairs.where(F.col("relation").isin("syndicated", "likely-syndicated")))
    rows = V.articles(spark, sf_dir).withColumn("cluster", F.floor(F.col("article_id") / 12))
    members = rows.join(comps, rows["article_id"] == comps["node"], "left").withColumn("group", F.coalesce("component", "article_id"))
    groups = members.groupBy("cluster", "group").agg(F.count_distinct("publisher").alias("pubs"))
    unknown = pairs.groupBy("cluster").agg(F.count_if(F.col("relation") == "unknown").alias("unknown_pairs"))
    facts = groups.groupBy("cluster").agg(F.count("*").alias("independent_groups"), F.sum(F.col("pubs") - 1).alias("syndicated"))
    facts = facts.join(unknown, "cluster", "left").withColumn("unknown_pairs", F.coalesce("unknown_pairs", F.lit(0).cast("long")))
    label = (
        F.when(F.col("independent_groups") >= 3, "several independent newsrooms").when(F.col("independent_groups") == 2, "two independent newsrooms")
        .when(F.col("syndicated") > 0, "one newsroom, syndicated").when(F.col("unknown_pairs") > 0, "unclear").otherwise("single newsroom")
    )
    return facts.withColumn("label", label)


_FAMILY_EDGES_SQL = f"""{_SET_SQL}, m AS (SELECT *, CASE article_id % 8 WHEN 0 THEN 'PTI' WHEN 1 THEN 'ANI' END AS wire, article_id // 40 AS block FROM t),
    rel AS (SELECT a.article_id AS a, b.article_id AS b, 'syndicated' AS relation FROM m a JOIN m b ON a.block = b.block AND a.article_id < b.article_id
        WHERE a.family = b.family OR a.wire = b.wire OR (len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.85))"""


@register("source_families_hardened", "F3", V.sql("v_articles", f""", {_FAMILY_EDGES_SQL}, {_CLOSE_SQL},
    g AS (SELECT m.block, coalesce(component, article_id) AS source_family, count(*) AS reports, count(DISTINCT publisher) AS publishers, bool_or(official) AS official, bool_or(wire IS NOT NULL) AS wired FROM m LEFT JOIN comp ON m.article_id = comp.node GROUP BY 1, 2)
    SELECT source_family, block, reports, publishers, CASE WHEN official THEN 'official-primary' WHEN wired THEN 'wire' WHEN reports >= 3 AND publishers = 1 THEN 'press-release-echo' WHEN reports >= 2 THEN 'independent' ELSE 'thin' END AS kind FROM g""").replace("WITH", "WITH RECURSIVE", 1))
def source_families_hardened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families by registry, wire credit or near-equal wording, closed; then their kind.

    Equal families and wires chain neighbours within a block, so no pair list of
    a whole family is made."""
    wire = F.when(F.col("article_id") % 8 == 0, "PTI").when(F.col("article_id") % 8 == 1, "ANI")
    rows = token_sets(spark, sf_dir).withColumn("wire", wire).withColumn("block", F.floor(F.col("article_id") / 40))

    def chain(key: str) -> DataFrame:
        previous = F.lag("article_id").over(Window.partitionBy("block", key).orderBy("article_id"))
        return rows.where(F.col(key).isNotNull()).select(previous.alias("a"), F.col("article_id").alias("b")).where("a is not null")

    blocks = rows.select("article_id", "block")
    alike = similar_pairs(spark, sf_dir, 0.85).join(blocks.select(F.col("article_id").alias("a"), F.col("block").alias("x")), "a")
    alike = alike.join(blocks.select(F.col("article_id").alias("b"), F.col("block").alias("y")), "b").where("x = y").select("a", "b")
    comps = connected_components(chain("family").unionByName(chain("wire")).unionByName(alike))
    members = rows.join(comps, rows["article_id"] == comps["node"], "left").withColumn("source_family", F.coalesce("component", "article_id"))
    facts = members.groupBy("source_family", "block").agg(
        F.count("*").alias("reports"), F.count_distinct("publisher").alias("publishers"), F.bool_or("official").alias("official"), F.bool_or(F.col("wire").isNotNull()).alias("wired")
    )
    kind = F.when(F.col("official"), "official-primary").when(F.col("wired"), "wire").when((F.col("reports") >= 3) & (F.col("publishers") == 1), "press-release-echo").when(F.col("reports") >= 2, "independent").otherwise("thin")
    return facts.select("source_family", "block", "reports", "publishers", kind.alias("kind"))


@register("political_coverage", "F18 B27", V.sql("v_speech", """, s AS (SELECT thread_id, turn, role, CASE WHEN regexp_matches(lower(text), '(^| )(not|no|never)( |$)') THEN 'denies' WHEN contains(text, '?') THEN 'asks' WHEN role = 'assistant' THEN 'states' ELSE 'claims' END AS act FROM v_speech)
    SELECT thread_id, count(*) AS turns, count(DISTINCT role) AS actors, count(*) FILTER (WHERE act = 'denies') AS denials, bool_or(role = 'assistant') AS has_response, arg_max(role, turn) <> 'assistant' AS unanswered, arg_min(act, turn) AS opening FROM s GROUP BY thread_id"""))
def political_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors and speech acts of each thread, and whether it was answered."""
    act = (
        F.when(F.lower("text").rlike("(^| )(not|no|never)( |$)"), "denies").when(F.contains("text", F.lit("?")), "asks").when(F.col("role") == "assistant", "states").otherwise("claims")
    )
    rows = V.speech(spark, sf_dir).withColumn("act", act)
    return rows.groupBy("thread_id").agg(
        F.count("*").alias("turns"), F.count_distinct("role").alias("actors"), F.count_if(F.col("act") == "denies").alias("denials"),
        F.bool_or(F.col("role") == "assistant").alias("has_response"), (F.max_by("role", "turn") != "assistant").alias("unanswered"), F.min_by("act", "turn").alias("opening"),
    )


@register("dispute_propagation", "F6 F8", V.sql("v_claims", f""", {_JUDGED_SQL} SELECT event_id, kind, value, status, disputed FROM f"""))
def dispute_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claims a hard dispute of their kind marks."""
    return judged(spark, sf_dir).select("event_id", "kind", "value", "status", "disputed")


_SUBJECT, _ASSERTS, _DENIES = "(?i)th", "(?i)ing", "(?i)ent"


@register("ordered_disputes", "F7", V.sql("v_articles", f""", c AS (SELECT published_at::DATE AS day, coalesce(title, '') AS t, published_at AS seen FROM v_articles WHERE regexp_matches(title, '{_SUBJECT}')),
    s AS (SELECT day, count(*) FILTER (WHERE regexp_matches(t, '{_ASSERTS}') AND NOT regexp_matches(t, '{_DENIES}')) AS asserting, count(*) FILTER (WHERE regexp_matches(t, '{_DENIES}')) AS denying,
        max(seen) FILTER (WHERE regexp_matches(t, '{_ASSERTS}') AND NOT regexp_matches(t, '{_DENIES}')) AS asserted_at, max(seen) FILTER (WHERE regexp_matches(t, '{_DENIES}')) AS denied_at FROM c GROUP BY day)
    SELECT day, asserting, denying, asserted_at, denied_at, abs(epoch_us(asserted_at) - epoch_us(denied_at)) / 6e7 > 30 AS update, CASE WHEN abs(epoch_us(asserted_at) - epoch_us(denied_at)) / 6e7 > 30 THEN 'low' ELSE 'moderate' END AS confidence
    FROM s WHERE asserting > 0 AND denying > 0"""))
def ordered_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which titles about a subject assert and deny; the patterns stand for
    words of orders, which the invented texts don't have."""
    rows = V.articles(spark, sf_dir).select(F.col("published_at").cast("date").alias("day"), F.col("title").alias("text"), F.col("published_at").alias("seen_at"))
    return C.ordered_disputes(rows, ["day"], _SUBJECT, _ASSERTS, _DENIES)


@register("prior_alert", "F7 C11", V.sql("v_reports", """, a AS (SELECT cluster_id, report_id, figure, published_at FROM v_reports WHERE role = 'official-alert'),
    l AS (SELECT cluster_id, published_at, max(report_id) AS report_id, arg_max(figure, report_id) AS figure FROM a GROUP BY cluster_id, published_at)
    SELECT r.report_id, CASE WHEN r.published_at - l.published_at <= INTERVAL 24 HOUR THEN l.report_id END AS alert_id, CASE WHEN r.published_at - l.published_at <= INTERVAL 24 HOUR THEN r.figure - l.figure END AS change
    FROM (SELECT * FROM v_reports WHERE role <> 'official-alert') r ASOF LEFT JOIN l ON r.cluster_id = l.cluster_id AND r.published_at >= l.published_at"""))
def prior_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each report the latest alert of its cluster in the day before, and how the figure changed."""
    rows = V.reports(spark, sf_dir)
    alerts = rows.where("role = 'official-alert'").select("cluster_id", "report_id", "figure", "published_at")
    found = asof_join(rows.where("role <> 'official-alert'").select("cluster_id", "report_id", "figure", "published_at"), alerts, ["cluster_id"], "published_at", "report_id", within_seconds=86_400)
    return found.select("report_id", F.col("match.report_id").alias("alert_id"), (F.col("figure") - F.col("match.figure")).alias("change"))


_FOLD_SQL = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words)}) THEN '{to}'" for to, words in X.KEY_SAME_WORD.items()) + " ELSE w END"
_KEY_SQL = f"""array_to_string(list_sort(list_filter(list_transform(string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: {_FOLD_SQL}),
    lambda w: length(w) > 2 AND w NOT IN ({", ".join(repr(x) for x in X.KEY_STOP_WORDS)}))), ' ')"""


@register("claim_classes", "E13 E17 L-claimkey", V.sql("v_articles", f""", c AS (SELECT article_id AS id, published_at::DATE AS event, publisher AS kind, regexp_extract(title, '[0-9]+') AS object, {_KEY_SQL} AS key, title, official FROM v_articles),
    w AS (SELECT *, list_distinct(string_split(key, ' ')) AS s FROM c),
    e AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.event = b.event AND a.id <> b.id AND ((a.kind = b.kind AND a.object = b.object AND a.object <> '') OR (a.key = b.key AND a.key <> '')
        OR (a.key <> '' AND b.key <> '' AND len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.7))),
    walk AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, walk.root FROM walk JOIN e ON walk.node = e.a), comp AS (SELECT node, min(root) AS component FROM walk GROUP BY node),
    m AS (SELECT coalesce(component, id) AS class, c.*, coalesce(title, '') AS t FROM c LEFT JOIN comp ON id = node)
    SELECT class, arg_min(id, (official::INT, title IS NULL, len(regexp_extract_all(t, '\\s[|•]\\s')), -length(t), id)) AS canonical, count(*) AS claims FROM m GROUP BY class""").replace("WITH", "WITH RECURSIVE", 1))
def claim_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a day that say the same, and which of them to show."""
    rows = V.articles(spark, sf_dir)
    claims = rows.select(
        F.col("article_id").alias("id"), F.col("published_at").cast("date").alias("event"), F.col("publisher").alias("kind"), F.regexp_extract("title", "[0-9]+", 0).alias("object"),
        X.claim_key(F.col("title")).alias("key"), F.col("title").alias("text"), F.col("official").alias("attributed"), F.lit(0).alias("confidence"),
    )
    space = Workspace(spark, "claims")
    claims = space.keep(claims, "claims")
    classes = connected_components(space.keep(C.equivalence_edges(claims), "edges"))
    named = claims.join(classes, claims["id"] == classes["node"], "left").withColumn("class", F.coalesce("component", "id"))
    return C.canonical_pick(named, ["class"])
