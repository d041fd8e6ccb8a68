"""Coverage, asymmetry, ownership, rollups, cohorts and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.catalog import register
from gleaner.functions import text as X
from gleaner.plans.text import tokens_sql
from gleaner.sources import views as V

#: Ownership by family; the packaged publisher dimension of the invented data.
OWNERSHIP = ("PRIVATE", "PUBLIC", "TRUST", "UNKNOWN")
# Sample gates.
MIN_TOTAL, MIN_RATIO, CLEAR_TOTAL, CLEAR_OVER, CLEAR_UNDER = 4, 3, 8, 5, 2


def ownership(family: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in OWNERSHIP]), (family % 4 + 1).cast("int"))


_OWN_SQL = "CASE family % 4 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'PUBLIC' WHEN 2 THEN 'TRUST' ELSE 'UNKNOWN' END"


@register("coverage_landscape", "G1 C2", V.sql("v_claims", f""", t AS (SELECT event_id, 'ownership' AS dimension, {_OWN_SQL} AS value FROM v_claims UNION ALL SELECT event_id, 'kind', kind FROM v_claims
    UNION ALL SELECT event_id, 'locality', CASE WHEN family < 8 THEN 'regional' WHEN family < 20 THEN 'national' ELSE 'foreign' END FROM v_claims),
    n AS (SELECT event_id, count(*) AS total, count(DISTINCT publisher) AS publishers, count(DISTINCT family) AS families FROM v_claims GROUP BY event_id),
    g AS (SELECT event_id, dimension, value, count(*) AS reports FROM t GROUP BY event_id, dimension, value)
    SELECT g.event_id, total, publishers, families, dimension, value, reports, round(reports::DOUBLE / total, 6) AS share FROM g JOIN n ON g.event_id = n.event_id"""))
def coverage_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and distributions of each event, one row for each value of a dimension."""
    rows = V.claims(spark, sf_dir)
    locality = F.when(F.col("family") < 8, "regional").when(F.col("family") < 20, "national").otherwise("foreign")
    pairs = [("ownership", ownership(F.col("family"))), ("kind", F.col("kind")), ("locality", locality)]
    facets = F.array(*[F.struct(F.lit(name).alias("dimension"), value.alias("value")) for name, value in pairs])
    counts = rows.select("event_id", F.explode(facets).alias("f")).groupBy("event_id", "f.dimension", "f.value").agg(F.count("*").alias("reports"))
    totals = rows.groupBy("event_id").agg(F.count("*").alias("total"), F.count_distinct("publisher").alias("publishers"), F.count_distinct("family").alias("families"))
    return counts.join(totals, "event_id").select("event_id", "total", "publishers", "families", "dimension", "value", "reports", F.round(F.col("reports") / F.col("total"), 6).alias("share"))


@register("blindspots", "G2 G4", V.sql("v_claims", f""", s AS (SELECT * FROM v_claims), t AS (SELECT event_id, 'OWNERSHIP' AS type, {_OWN_SQL} AS grp FROM s UNION ALL SELECT event_id, 'KIND', kind FROM s UNION ALL SELECT event_id, 'FAMILY', 'f' || family FROM s),
    n AS (SELECT event_id, count(*) AS total FROM s GROUP BY event_id), c AS (SELECT event_id, type, grp, count(*) AS k FROM t WHERE grp <> 'UNKNOWN' GROUP BY event_id, type, grp),
    g AS (SELECT event_id, type, arg_max(grp, (k, grp)) AS over_group, max(k) AS over_count, arg_min(grp, (k, grp)) AS under_group, min(k) AS under_count, count(*) AS groups FROM c GROUP BY event_id, type)
    SELECT g.event_id, type, over_group, over_count, under_group, under_count, floor(over_count::DOUBLE / greatest(under_count, 1) * 10 + 0.5) / 10 AS ratio,
        CASE WHEN over_count + under_count < 8 OR over_count < 5 THEN 'INSUFFICIENT_COVERAGE' WHEN under_count < 2 THEN 'POSSIBLE_ASYMMETRY' ELSE 'CLEAR_ASYMMETRY' END AS confidence
    FROM g JOIN n ON g.event_id = n.event_id WHERE groups >= 2 AND total >= 4 AND over_count::DOUBLE / greatest(under_count, 1) >= 3"""))
def blindspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest against the smallest known group of each tally, from a ratio of
    three; the sample gates decide how it may be worded."""
    rows = V.claims(spark, sf_dir)
    tallies = F.array(
        *[F.struct(F.lit(t).alias("type"), g.alias("grp")) for t, g in (("OWNERSHIP", ownership(F.col("family"))), ("KIND", F.col("kind")), ("FAMILY", F.concat(F.lit("f"), F.col("family").cast("string"))))]
    )
    counts = rows.select("event_id", F.explode(tallies).alias("t")).where("t.grp <> 'UNKNOWN'").groupBy("event_id", "t.type", "t.grp").agg(F.count("*").alias("k"))
    ends = counts.groupBy("event_id", "type").agg(
        F.max_by("grp", F.struct("k", "grp")).alias("over_group"), F.max("k").alias("over_count"),
        F.min_by("grp", F.struct("k", "grp")).alias("under_group"), F.min("k").alias("under_count"), F.count("*").alias("groups"),
    )
    totals = rows.groupBy("event_id").agg(F.count("*").alias("total"))
    ratio = F.col("over_count") / F.greatest("under_count", F.lit(1))
    sure = (
        F.when((F.col("over_count") + F.col("under_count") < CLEAR_TOTAL) | (F.col("over_count") < CLEAR_OVER), "INSUFFICIENT_COVERAGE")
        .when(F.col("under_count") < CLEAR_UNDER, "POSSIBLE_ASYMMETRY").otherwise("CLEAR_ASYMMETRY")
    )
    found = ends.join(totals, "event_id").where((F.col("groups") >= 2) & (F.col("total") >= MIN_TOTAL) & (ratio >= MIN_RATIO))
    return found.select("event_id", "type", "over_group", "over_count", "under_group", "under_count", (F.floor(ratio * 10 + 0.5) / 10).alias("ratio"), sure.alias("confidence"))


def sample_band(n: Column) -> Column:
    return F.when(n >= 150, "broad").when(n >= 50, "moderate").when(n >= 20, "thin").otherwise("insufficient")


@register("publisher_observed", "G3 G4 B27 B28 B29", V.sql("v_articles", """, f AS (SELECT *, CASE WHEN regexp_matches(lower(title), '(^| )(that|und|que) ') THEN 'critical' WHEN regexp_matches(lower(title), '(^| )(the|der|de) ') THEN 'supportive' ELSE 'neutral-descriptive' END AS stance,
        len(regexp_extract_all(lower(title), '(ing|heit|ción)')) AS loaded, list_distinct(regexp_extract_all(lower(title), '(ing|heit|ción)')) AS phrases, len(regexp_extract_all(lower(title), '(ble|keit|elle)')) > 0 AS emphasis FROM v_articles)
    SELECT publisher, count(*) AS n, count(*) FILTER (WHERE stance = 'critical') AS critical, count(*) FILTER (WHERE stance = 'supportive') AS supportive, sum(len(phrases))::BIGINT AS phrases,
        CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (WHERE loaded >= 2)::DOUBLE / count(*), 6) END AS sensationalism, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (WHERE official OR emphasis)::DOUBLE / count(*), 6) END AS primary_rate,
        CASE WHEN count(*) >= 150 THEN 'broad' WHEN count(*) >= 50 THEN 'moderate' WHEN count(*) >= 20 THEN 'thin' ELSE 'insufficient' END AS sample FROM f GROUP BY publisher"""))
def publisher_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stance counts and rates of each publisher; rates are null under five rows."""
    title = F.lower("title")
    stance = F.when(title.rlike("(^| )(that|und|que) "), "critical").when(title.rlike("(^| )(the|der|de) "), "supportive").otherwise("neutral-descriptive")
    found = F.regexp_extract_all(title, F.lit("(ing|heit|ción)"), F.lit(0))
    rows = V.articles(spark, sf_dir).select("publisher", "official", stance.alias("stance"), found.alias("found"), title.rlike("ble|keit|elle").alias("emphasis"))
    n = F.count("*")
    rate = lambda condition: F.when(n >= 5, F.round(F.count_if(condition) / n, 6))
    return rows.groupBy("publisher").agg(
        n.alias("n"),
        F.count_if(F.col("stance") == "critical").alias("critical"),
        F.count_if(F.col("stance") == "supportive").alias("supportive"),
        F.sum(F.size(F.array_distinct("found"))).alias("phrases"),
        rate(F.size("found") >= 2).alias("sensationalism"),
        rate(F.col("official") | F.col("emphasis")).alias("primary_rate"),
        sample_band(n).alias("sample"),
    )


@register("selection_divergence", "G8", """WITH l AS (SELECT l_suppkey AS publisher, p_brand AS topic, count(*) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    c AS (SELECT topic, sum(k)::DOUBLE / (SELECT sum(k) FROM l) AS corpus FROM l GROUP BY topic), s AS (SELECT publisher, topic, k::DOUBLE / sum(k) OVER (PARTITION BY publisher) AS share, sum(k) OVER (PARTITION BY publisher) AS total FROM l),
    d AS (SELECT publisher, s.topic, total, share - corpus AS deviation FROM s JOIN c ON s.topic = c.topic WHERE total >= 8)
    SELECT publisher, arg_max(topic, (round(abs(deviation), 9), topic)) AS topic, round(arg_max(deviation, (round(abs(deviation), 9), topic)), 6) AS deviation, max(abs(deviation)) >= 0.15 AS diverges FROM d GROUP BY publisher""")
def selection_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each publisher's topic share against the corpus share, at its worst topic."""
    parts = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"))
    counts = V.table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("publisher")).join(parts, "l_partkey").groupBy("publisher", "topic").agg(F.count("*").alias("k"))
    corpus = counts.groupBy("topic").agg(F.sum("k").alias("t"))
    whole = corpus.agg(F.sum("t").alias("all"))
    corpus = corpus.join(F.broadcast(whole)).select("topic", (F.col("t") / F.col("all")).alias("corpus"))
    total = F.sum("k").over(Window.partitionBy("publisher"))
    rows = counts.withColumn("total", total).where("total >= 8").join(corpus, "topic").withColumn("deviation", F.col("k") / F.col("total") - F.col("corpus"))
    worst = F.struct(F.round(F.abs("deviation"), 9), "topic")
    return rows.groupBy("publisher").agg(
        F.max_by("topic", worst).alias("topic"), F.round(F.max_by("deviation", worst), 6).alias("deviation"), (F.max(F.abs("deviation")) >= 0.15).alias("diverges")
    )


_DAILY_SQL = """d AS (SELECT published_at::DATE AS day, publisher, count(*) AS reports, count(*) FILTER (WHERE role = 'official-alert') AS official, count(DISTINCT cluster_id) AS clusters FROM v_reports GROUP BY 1, 2)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reports(spark, sf_dir).groupBy(F.to_date("published_at").alias("day"), "publisher").agg(
        F.count("*").alias("reports"), F.count_if(F.col("role") == "official-alert").alias("official"), F.count_distinct("cluster_id").alias("clusters")
    )


@register("daily_aggregate", "G5", V.sql("v_reports", f", {_DAILY_SQL} SELECT * FROM d"))
def daily_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir)


@register("rollup_windows", "G6", V.sql("v_reports", f""", {_DAILY_SQL}, k AS (SELECT *, dense_rank() OVER (ORDER BY day DESC) AS back FROM d)
    SELECT w AS days, publisher, sum(reports)::BIGINT AS reports, sum(official)::BIGINT AS official, count(DISTINCT day) AS active_days FROM k, (VALUES (7), (30), (90)) AS x(w) WHERE back <= w GROUP BY w, publisher"""))
def rollup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the last 7, 30 and 90 stored days, gaps not counted."""
    rows = daily(spark, sf_dir)
    days = rows.select("day").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("day"))))
    windows = F.filter(F.array(F.lit(7), F.lit(30), F.lit(90)), lambda w: F.col("back") <= w)
    placed = rows.join(F.broadcast(days.where("back <= 90")), "day").select("*", F.explode(windows).alias("days"))
    return placed.groupBy("days", "publisher").agg(F.sum("reports").alias("reports"), F.sum("official").alias("official"), F.count_distinct("day").alias("active_days"))


@register("landscape_leaderboards", "G7 G10 J3", V.sql("v_claims", """, p AS (SELECT 'publisher' AS board, publisher::VARCHAR AS name, count(*) AS n, count(DISTINCT event_id) AS events FROM v_claims GROUP BY publisher),
    k AS (SELECT 'kind' AS board, kind AS name, count(*) AS n, count(DISTINCT event_id) AS events FROM v_claims GROUP BY kind), f AS (SELECT 'family' AS board, family::VARCHAR AS name, count(*) AS n, count(DISTINCT event_id) AS events FROM v_claims GROUP BY family),
    u AS (SELECT * FROM p UNION ALL SELECT * FROM k UNION ALL SELECT * FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY n DESC, name) AS place FROM u)
    SELECT board, place, name, n, events FROM r WHERE place <= 10"""))
def landscape_leaderboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest publishers, kinds and families by claims."""
    rows = V.claims(spark, sf_dir)
    boards = F.array(*[F.struct(F.lit(b).alias("board"), F.col(c).cast("string").alias("name")) for b, c in (("publisher", "publisher"), ("kind", "kind"), ("family", "family"))])
    counts = rows.select("event_id", F.explode(boards).alias("b")).groupBy("b.board", "b.name").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))
    place = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("n"), "name"))
    return counts.withColumn("place", place).where("place <= 10").select("board", "place", "name", "n", "events")


@register("perspective_cohorts", "G18 K5", V.sql("v_articles", """, o AS (SELECT article_id // 12 AS cluster, language, unnest(['ing', 'ble', 'tion', 'keit', 'elle', 'ado']) AS label, lower(title) AS title FROM v_articles),
    h AS (SELECT cluster, language, label FROM o WHERE contains(title, label)), n AS (SELECT article_id // 12 AS cluster, language, count(*) AS n FROM v_articles GROUP BY 1, 2),
    g AS (SELECT n.cluster, n.language, n.n, CASE WHEN n.n >= 2 THEN array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (WHERE label IS NOT NULL), [])), ',') END AS emphasis FROM n LEFT JOIN h ON n.cluster = h.cluster AND n.language = h.language GROUP BY 1, 2, 3)
    SELECT *, count(DISTINCT emphasis) OVER (PARTITION BY cluster) > 1 AS contrast FROM g""").replace("count(DISTINCT emphasis) OVER (PARTITION BY cluster) > 1", "(min(emphasis) OVER (PARTITION BY cluster) <> max(emphasis) OVER (PARTITION BY cluster)) IS TRUE"))
def perspective_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of emphases of each language cohort, null under two reports, and
    whether a cluster's cohorts differ."""
    labels = ("ing", "ble", "tion", "keit", "elle", "ado")
    found = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: F.contains(F.lower("title"), x))
    rows = V.articles(spark, sf_dir).select(F.floor(F.col("article_id") / 12).alias("cluster"), "language", found.alias("found"))
    grouped = rows.groupBy("cluster", "language").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("set"))
    grouped = grouped.withColumn("emphasis", F.when(F.col("n") >= 2, F.array_join("set", ",")))
    own = Window.partitionBy("cluster")
    contrast = F.coalesce(F.min("emphasis").over(own) != F.max("emphasis").over(own), F.lit(False))
    return grouped.select("cluster", "language", "n", "emphasis", contrast.alias("contrast"))


@register("emerging_claims", "G15 C15", V.sql("v_articles", f""", k AS (SELECT publisher, array_to_string(list_sort(list_distinct({tokens_sql('title', 4)}))[1:4], ' ') AS key FROM v_articles WHERE NOT official)
    SELECT key, count(*) AS mentions, count(DISTINCT publisher) AS channels FROM k WHERE key <> '' GROUP BY key HAVING count(*) >= 3 AND count(DISTINCT publisher) >= 2 ORDER BY mentions DESC, key LIMIT 12"""))
def emerging_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched mentions grouped by their four alphabetically first keywords: those
    with three mentions in two channels, the top twelve."""
    mentions = V.articles(spark, sf_dir).where("not official").select("publisher", F.col("title").alias("text"))
    return emerging(mentions, "publisher")


def emerging(mentions: DataFrame, channel: str, *, keywords: int = 4, least_mentions: int = 3, least_channels: int = 2, k: int = 12) -> DataFrame:
    keyed = mentions.withColumn("key", F.array_join(F.slice(F.array_sort(F.array_distinct(X.tokens(F.col("text"), 4))), 1, keywords), " "))
    counts = keyed.where("key <> ''").groupBy("key").agg(F.count("*").alias("mentions"), F.count_distinct(channel).alias("channels"))
    return counts.where((F.col("mentions") >= least_mentions) & (F.col("channels") >= least_channels)).orderBy(F.desc("mentions"), "key").limit(k)


@register("undercovered_groups", "G17", """WITH c AS (SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name)
    SELECT n_name, customers, row_number() OVER (ORDER BY customers DESC, n_name) AS place, customers = 0 AS uncovered FROM c""")
def undercovered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each group of the dimension, those without any included."""
    covered = V.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    groups = V.table(spark, sf_dir, "nation").join(covered, "n_nationkey", "left").select("n_name", F.coalesce("k", F.lit(0).cast("long")).alias("customers"))
    place = F.row_number().over(Window.orderBy(F.desc("customers"), "n_name"))  # one row for each nation
    return groups.select("n_name", "customers", place.alias("place"), (F.col("customers") == 0).alias("uncovered"))


@register("confusion_prf", "G19 R4 R5", """WITH p AS (SELECT quality AS gold, CASE WHEN contains(text, '###') OR contains(text, ' | ') OR contains(text, '!!') THEN 0 ELSE 1 END AS predicted FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT x.class, count(*) FILTER (WHERE gold = class AND predicted = class) AS tp, count(*) FILTER (WHERE gold <> class AND predicted = class) AS fp, count(*) FILTER (WHERE gold = class AND predicted <> class) AS fn FROM p, (VALUES (0), (1), (2)) AS x(class) GROUP BY x.class)
    SELECT class, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) END AS f1 FROM c""")
def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each class; null where nothing was predicted or given."""
    junk = F.contains("text", F.lit("###")) | F.contains("text", F.lit(" | ")) | F.contains("text", F.lit("!!"))
    rows = V.table(spark, sf_dir, "labels").join(V.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("quality").alias("gold"), F.when(junk, 0).otherwise(1).alias("predicted"))
    matrix = rows.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    return prf(matrix, [0, 1, 2])


def prf(matrix: DataFrame, classes: list) -> DataFrame:
    """Per-class scores from a confusion matrix (gold, predicted, n)."""
    rows = matrix.select("*", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    cell = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))
    is_gold, is_called = F.col("gold") == F.col("class"), F.col("predicted") == F.col("class")
    counts = rows.groupBy("class").agg(cell(is_gold & is_called).alias("tp"), cell(~is_gold & is_called).alias("fp"), cell(is_gold & ~is_called).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / F.nullif(b, F.lit(0)), 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("class", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


@register("publisher_dimension_join", "A14 C2 C17 G13 G14 G16", """WITH f AS (SELECT l_suppkey, count(*) AS lines, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY l_suppkey)
    SELECT s_suppkey AS publisher, coalesce(n_name, 'UNKNOWN') AS owner, s_nationkey % 7 AS family, coalesce(lines, 0) AS lines, first_seen, last_seen, CASE WHEN lines IS NULL THEN 'silent' WHEN lines < 20 THEN 'occasional' ELSE 'active' END AS status,
        round(coalesce(lines, 0)::DOUBLE / nullif(sum(coalesce(lines, 0)) OVER (PARTITION BY s_nationkey % 7), 0), 6) AS family_share
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN f ON s_suppkey = l_suppkey""")
def publisher_dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers with owner (UNKNOWN where the registry has none), feed status and
    share of their family's output."""
    facts = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").alias("lines"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen")
    )
    owners = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = V.table(spark, sf_dir, "supplier").join(owners, "s_nationkey", "left").join(facts, "s_suppkey", "left")
    n = F.coalesce("lines", F.lit(0).cast("long"))
    family = F.col("s_nationkey") % 7
    share = F.round(n / F.nullif(F.sum(n).over(Window.partitionBy(family)), F.lit(0)), 6)
    status = F.when(F.col("lines").isNull(), "silent").when(F.col("lines") < 20, "occasional").otherwise("active")
    return rows.select(F.col("s_suppkey").alias("publisher"), F.coalesce("n_name", F.lit("UNKNOWN")).alias("owner"), family.alias("family"), n.alias("lines"), "first_seen", "last_seen", status.alias("status"), share.alias("family_share"))


@register("article_index_lookup", "C1 C18 C19", V.sql("v_claims", """, k AS (SELECT DISTINCT event_id, kind, publisher FROM v_claims), s AS (SELECT event_id, kind, count(*) AS publishers FROM k GROUP BY event_id, kind HAVING count(*) >= 5),
    p AS (SELECT DISTINCT event_id, publisher FROM k), o AS (SELECT p.event_id, p.publisher, s.kind, row_number() OVER (PARTITION BY p.event_id, p.publisher ORDER BY s.publishers DESC, s.kind) AS pos FROM p JOIN s ON p.event_id = s.event_id
        WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.event_id = p.event_id AND k.publisher = p.publisher AND k.kind = s.kind)),
    i AS (SELECT event_id, publisher, array_to_string(list_sort(list(kind)), ',') AS claims FROM k GROUP BY event_id, publisher)
    SELECT i.event_id, i.publisher, claims, coalesce((SELECT array_to_string(list(kind ORDER BY pos), ',') FROM o WHERE o.event_id = i.event_id AND o.publisher = i.publisher AND pos <= 3), '') AS omitted FROM i"""))
def article_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted index of claims by publisher, and up to three well-supported claims
    of the same event that the publisher leaves out."""
    kinds = V.claims(spark, sf_dir).select("event_id", "kind", "publisher").distinct()
    backed = kinds.groupBy("event_id", "kind").agg(F.count("*").alias("publishers")).where("publishers >= 5")
    listed = backed.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("publishers")).alias("k"), "kind"))).alias("backed"))
    index = kinds.groupBy("event_id", "publisher").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).join(listed, "event_id", "left")
    names = F.transform(F.coalesce("backed", F.array().cast("array<struct<k:bigint,kind:string>>")), lambda b: b["kind"])
    missing = F.slice(F.filter(names, lambda k: ~F.array_contains("kinds", k)), 1, 3)
    return index.select("event_id", "publisher", F.array_join("kinds", ",").alias("claims"), F.array_join(missing, ",").alias("omitted"))
