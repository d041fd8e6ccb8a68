"""Novelty, ordered surfaces, search, pages and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.catalog import register
from gleaner.functions import text as X
from gleaner.operators import novelty as N
from gleaner.operators.research import best_by_shared_words
from gleaner.operators.topk import diversified, first_per_group
from gleaner.plans.text import _URL_KEY_SQL, tokens_sql
from gleaner.plans.trends import _EDITED_SQL, edited
from gleaner.sources import views as V
from gleaner.storage import Workspace


@register("timeline_novelty", "H4 H5", V.sql("v_speech", f""", t AS (SELECT thread_id, turn, unnest({tokens_sql('text')}) AS token FROM v_speech), f AS (SELECT thread_id, token, min(turn) AS first_turn FROM t GROUP BY thread_id, token),
    c AS (SELECT t.thread_id, t.turn, count(*) FILTER (WHERE t.turn = first_turn) AS fresh FROM t JOIN f ON t.thread_id = f.thread_id AND t.token = f.token GROUP BY t.thread_id, t.turn),
    a AS (SELECT s.thread_id, s.turn, coalesce(fresh, 0) AS new_tokens, s.turn = min(s.turn) OVER (PARTITION BY s.thread_id) OR coalesce(fresh, 0) >= 2 AS added FROM (SELECT thread_id, turn FROM v_speech GROUP BY 1, 2) s LEFT JOIN c ON s.thread_id = c.thread_id AND s.turn = c.turn)
    SELECT *, coalesce(max(CASE WHEN added THEN turn END) OVER (PARTITION BY thread_id), max(turn) OVER (PARTITION BY thread_id)) AS last_meaningful FROM a"""))
def timeline_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of tokens that no earlier turn had; repeats within a turn count."""
    rows = V.speech(spark, sf_dir)
    words = rows.select("thread_id", "turn", F.explode(X.tokens(F.col("text"))).alias("token"))
    counts = words.groupBy("thread_id", "turn", "token").agg(F.count("*").alias("n"))
    first = F.min("turn").over(Window.partitionBy("thread_id", "token"))
    fresh = counts.withColumn("first", first).where("turn = first").groupBy("thread_id", "turn").agg(F.sum("n").alias("fresh"))
    turns = rows.select("thread_id", "turn").distinct().join(fresh, ["thread_id", "turn"], "left").withColumn("new_tokens", F.coalesce("fresh", F.lit(0).cast("long")))
    own = Window.partitionBy("thread_id")
    added = (F.col("turn") == F.min("turn").over(own)) | (F.col("new_tokens") >= 2)
    turns = turns.select("thread_id", "turn", "new_tokens", added.alias("added"))
    return turns.withColumn("last_meaningful", F.coalesce(F.max(F.when(F.col("added"), F.col("turn"))).over(own), F.max("turn").over(own)))


_SNAP = """SELECT cluster_id, list_sort(list(DISTINCT figure)) AS figures, list_sort(list(DISTINCT family)) AS families, list_sort(list(DISTINCT publisher)) AS publishers, count(*) FILTER (WHERE role = 'official-alert') AS official, count(*) AS reports, max(published_at) AS newest FROM v_reports"""


@register("novelty_update_kind", "I7 I8 K3", V.sql("v_reports", f""", prev AS ({_SNAP} WHERE published_at < TIMESTAMP '2024-01-29' GROUP BY cluster_id), cur AS ({_SNAP} GROUP BY cluster_id),
    d AS (SELECT cur.cluster_id, prev.cluster_id IS NULL AS fresh, len(list_filter(cur.figures, lambda x: NOT list_contains(coalesce(prev.figures, []), x))) AS new_figures, len(list_filter(cur.families, lambda x: NOT list_contains(coalesce(prev.families, []), x))) AS new_families,
        len(list_filter(cur.publishers, lambda x: NOT list_contains(coalesce(prev.publishers, []), x))) AS new_publishers, cur.official > coalesce(prev.official, 0) AS official, cur.reports > coalesce(prev.reports, 0) AS more FROM cur LEFT JOIN prev ON cur.cluster_id = prev.cluster_id),
    k AS (SELECT *, CASE WHEN fresh THEN 'major-development' WHEN official THEN 'new-official-confirmation' WHEN new_figures > 0 THEN 'new-number' WHEN new_families > 0 THEN 'new-location' WHEN new_publishers > 0 THEN 'new-source-only' WHEN more THEN 'rephrasing' ELSE 'duplicate' END AS update_kind FROM d)
    SELECT cluster_id, new_figures, new_families, new_publishers, update_kind, CASE WHEN update_kind IN ('major-development', 'new-official-confirmation') THEN 'high' WHEN update_kind IN ('new-number', 'new-location') THEN CASE WHEN new_figures >= 3 THEN 'high' ELSE 'moderate' END WHEN update_kind = 'new-source-only' THEN 'low' ELSE 'none' END AS significance FROM k"""))
def novelty_update_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed since the previous snapshot, first kind that applies."""
    rows = V.reports(spark, sf_dir)

    def snapshot(reports: DataFrame, suffix: str) -> DataFrame:
        return reports.groupBy("cluster_id").agg(
            F.collect_set("figure").alias(f"figures{suffix}"), F.collect_set("family").alias(f"families{suffix}"), F.collect_set("publisher").alias(f"publishers{suffix}"),
            F.count_if(F.col("role") == "official-alert").alias(f"official{suffix}"), F.count("*").alias(f"reports{suffix}"),
        )

    both = snapshot(rows, "").join(snapshot(rows.where(F.col("published_at") < V.now("2024-01-29 00:00:00")), "_0"), "cluster_id", "left")
    gone = lambda name: F.size(F.array_except(name, F.coalesce(f"{name}_0", F.array().cast("array<bigint>")))).cast("long")
    found = both.select(
        "cluster_id", gone("figures").alias("new_figures"), gone("families").alias("new_families"), gone("publishers").alias("new_publishers"),
        F.col("reports_0").isNull().alias("fresh"), (F.col("official") > F.coalesce("official_0", F.lit(0))).alias("official"), (F.col("reports") > F.coalesce("reports_0", F.lit(0))).alias("more"),
    )
    kind = (
        F.when(F.col("fresh"), "major-development").when(F.col("official"), "new-official-confirmation").when(F.col("new_figures") > 0, "new-number").when(F.col("new_families") > 0, "new-location")
        .when(F.col("new_publishers") > 0, "new-source-only").when(F.col("more"), "rephrasing").otherwise("duplicate")
    )
    found = found.withColumn("update_kind", kind)
    weight = (
        F.when(F.col("update_kind").isin("major-development", "new-official-confirmation"), "high")
        .when(F.col("update_kind").isin("new-number", "new-location"), F.when(F.col("new_figures") >= 3, "high").otherwise("moderate"))
        .when(F.col("update_kind") == "new-source-only", "low").otherwise("none")
    )
    return found.select("cluster_id", "new_figures", "new_families", "new_publishers", "update_kind", weight.alias("significance"))


@register("diversified_topk", "J4 H8", V.sql("v_reports", """, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY figure DESC, report_id) AS k, publisher % 3 <> 0 AS single FROM v_reports),
    d AS (SELECT *, single AND k > 4 AS deferred FROM r), o AS (SELECT *, row_number() OVER (ORDER BY deferred, figure DESC, report_id) AS place FROM d) SELECT place, report_id, family, figure, deferred FROM o WHERE place <= 40"""))
def diversified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.reports(spark, sf_dir)
    return diversified(rows, [F.desc("figure"), F.col("report_id")], "family", F.col("publisher") % 3 != 0, 40).select("place", "report_id", "family", "figure", "deferred")


_RANK_SQL = "row_number() OVER (PARTITION BY surface ORDER BY editorial DESC, newest, cluster_id)"


@register("surfaces", "J2 J5", V.sql("v_reports", f"""{_EDITED_SQL}, u AS (SELECT 'urgent' AS surface, * FROM b WHERE band = 'urgent' UNION ALL SELECT 'right_now', * FROM b WHERE band IN ('urgent', 'high') AND newest <= 6
        UNION ALL SELECT 'watching', * FROM b WHERE band = 'standard' UNION ALL SELECT 'background', * FROM b WHERE band = 'background'),
    r AS (SELECT *, {_RANK_SQL} AS place FROM u) SELECT surface, place, cluster_id, editorial FROM r WHERE place <= CASE surface WHEN 'right_now' THEN 10 WHEN 'watching' THEN 16 WHEN 'background' THEN 40 ELSE 12 END"""))
def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked lists, each with its own limit."""
    rows = Workspace(spark, "surfaces").keep(edited(spark, sf_dir).select("cluster_id", "editorial", "band", "newest"), "edited")
    limits = {"urgent": 12, "right_now": 10, "watching": 16, "background": 40}
    parts = [
        ("urgent", F.col("band") == "urgent"), ("right_now", F.col("band").isin("urgent", "high") & (F.col("newest") <= 6)),
        ("watching", F.col("band") == "standard"), ("background", F.col("band") == "background"),
    ]
    tagged = rows.withColumn("surface", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in parts]), lambda s: s.isNotNull())))
    ranked = first_per_group(tagged, ["surface"], [F.desc("editorial"), F.col("newest"), F.col("cluster_id")], 40)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return ranked.where(F.col("place") <= limit[F.col("surface")]).select("surface", "place", "cluster_id", "editorial")


@register("thread_links_capped", "C10", V.sql("v_speech", f""", s AS (SELECT DISTINCT thread_id, unnest(list_filter({tokens_sql('text')}, lambda w: length(w) >= 7)) AS subject FROM v_speech),
    p AS (SELECT a.thread_id AS a, b.thread_id AS b, count(*) AS shared, min(a.subject) AS subject FROM s a JOIN s b ON a.subject = b.subject AND a.thread_id < b.thread_id AND b.thread_id - a.thread_id <= 40 GROUP BY a.thread_id, b.thread_id),
    e AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM p) SELECT a, b, shared, subject, CASE WHEN shared >= 3 THEN 'follows' ELSE 'relates' END AS relation FROM e WHERE k <= 4"""))
def thread_links_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads near each other (ids stand for time) that share long subjects; at most
    four links a thread. Subjects are cut into blocks of ids, so a common one meets
    only its neighbours."""
    words = V.speech(spark, sf_dir).select("thread_id", F.explode(F.filter(X.tokens(F.col("text")), lambda w: F.length(w) >= 7)).alias("subject")).distinct()
    block = F.floor(F.col("thread_id") / 40)
    a = words.select(F.col("thread_id").alias("a"), "subject", F.explode(F.array(block, block + 1)).alias("block"))
    b = words.select(F.col("thread_id").alias("b"), "subject", block.alias("block"))
    pairs = a.join(b, ["subject", "block"]).where("a < b and b - a <= 40").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("subject").alias("subject"))
    kept = first_per_group(pairs, ["a"], [F.desc("shared"), F.col("b")], 4)
    return kept.select("a", "b", "shared", "subject", F.when(F.col("shared") >= 3, "follows").otherwise("relates").alias("relation"))


@register("search_and_terms", "M1", V.sql("v_articles", """, h AS (SELECT article_id, published_at, lower(title || ' ' || publisher || ' ' || language) AS hay FROM v_articles)
    SELECT article_id FROM h WHERE contains(hay, 'th') AND contains(hay, 'en') AND contains(hay, 'src1') ORDER BY published_at DESC, article_id LIMIT 40"""))
def search_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(V.articles(spark, sf_dir), "th en src1", ["title", "publisher", "language"], 40)


def search(rows: DataFrame, query: str, columns: list[str], k: int) -> DataFrame:
    """Rows whose text has every term of the query; terms under two characters are
    ignored, and a query without terms finds nothing."""
    terms = [t for t in query.lower().split() if len(t) >= 2]
    hay = F.lower(F.concat_ws(" ", *columns))
    found = F.lit(bool(terms))
    for term in terms:
        found = found & F.contains(hay, F.lit(term))
    return rows.where(found).orderBy(F.desc("published_at"), "article_id").limit(k).select("article_id")


@register("search_url", "M2", f"WITH k AS (SELECT page_id, {_URL_KEY_SQL} AS key FROM pages), q AS (SELECT key AS wanted FROM k WHERE page_id = 3) SELECT page_id, key FROM k, q WHERE key = wanted OR starts_with(key, wanted) OR starts_with(wanted, key)")
def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose key equals, begins or continues the wanted URL's key."""
    rows = V.table(spark, sf_dir, "pages").select("page_id", X.url_key(F.col("url")).alias("key"))
    wanted = rows.where("page_id = 3").select(F.col("key").alias("wanted"))
    return rows.join(F.broadcast(wanted), F.startswith("key", F.col("wanted")) | F.startswith("wanted", F.col("key"))).select("page_id", "key")


@register("faceted_page", "M3 M4 M9 J7", V.sql("v_reports", f"""{_EDITED_SQL}, f AS (SELECT *, CASE WHEN p_geo = 1 THEN 'P0' WHEN p_geo = 0.5 THEN 'P1' WHEN p_geo > 0 THEN 'P2' ELSE 'out' END AS tier FROM b),
    r AS (SELECT tier, cluster_id, editorial, row_number() OVER (PARTITION BY tier ORDER BY editorial DESC, cluster_id) AS place, count(*) OVER (PARTITION BY tier) AS of FROM f WHERE band <> 'suppressed')
    SELECT tier, place, cluster_id, editorial, of FROM r WHERE place BETWEEN 13 AND 24"""))
def faceted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twelve of each tier, with the tier's count."""
    tier = F.when(F.col("p_geo") == 1, "P0").when(F.col("p_geo") == 0.5, "P1").when(F.col("p_geo") > 0, "P2").otherwise("out")
    rows = edited(spark, sf_dir).where("band <> 'suppressed'").withColumn("tier", tier)
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("editorial"), "cluster_id"))
    rows = rows.select("tier", place.alias("place"), "cluster_id", "editorial", F.count("*").over(Window.partitionBy("tier")).alias("of"))
    return rows.where("place between 13 and 24")


@register("home_composition", "M8 C15", V.sql("v_reports", f"""{_EDITED_SQL}, n AS (SELECT cluster_id, editorial FROM b ORDER BY editorial DESC, cluster_id LIMIT 10), f AS (SELECT cluster_id, velocity FROM b WHERE cluster_id NOT IN (SELECT cluster_id FROM n) ORDER BY velocity DESC, editorial DESC, cluster_id LIMIT 9),
    r AS (SELECT cluster_id FROM b WHERE p_geo = 1 AND cluster_id NOT IN (SELECT cluster_id FROM n UNION ALL SELECT cluster_id FROM f) ORDER BY editorial DESC, cluster_id LIMIT 12)
    SELECT 'right_now' AS section, cluster_id FROM n UNION ALL SELECT 'fast_rising', cluster_id FROM f UNION ALL SELECT 'region', cluster_id FROM r"""))
def home_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the front page; a cluster is shown in the first that takes it."""
    rows = Workspace(spark, "home").keep(edited(spark, sf_dir).select("cluster_id", "editorial", "velocity", "p_geo"), "edited")
    now = rows.orderBy(F.desc("editorial"), "cluster_id").limit(10).select("cluster_id")
    rising = rows.join(now, "cluster_id", "left_anti").orderBy(F.desc("velocity"), F.desc("editorial"), "cluster_id").limit(9).select("cluster_id")
    region = rows.where("p_geo = 1").join(now.union(rising), "cluster_id", "left_anti").orderBy(F.desc("editorial"), "cluster_id").limit(12).select("cluster_id")
    tag = lambda frame, name: frame.select(F.lit(name).alias("section"), "cluster_id")
    return tag(now, "right_now").union(tag(rising, "fast_rising")).union(tag(region, "region"))


@register("last_known_good_union", "K1", V.sql("v_reports", f""", s AS (SELECT publisher, publisher % 6 = 0 AS failed, publisher % 9 AS failures FROM (SELECT DISTINCT publisher FROM v_reports))
    SELECT report_id, v.publisher, CASE WHEN NOT failed THEN 'ok' WHEN failures + 1 >= 4 THEN 'failed' ELSE 'stale' END AS status, CASE WHEN failed THEN failures + 1 ELSE 0 END AS failures FROM v_reports v JOIN s ON v.publisher = s.publisher
    WHERE NOT failed OR published_at < TIMESTAMP '{V.PREVIOUS}'"""))
def last_known_good_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh rows of feeds that answered, and the previous snapshot's of those that didn't."""
    rows = V.reports(spark, sf_dir)
    failed, failures = F.col("publisher") % 6 == 0, F.col("publisher") % 9
    fresh = rows.where(~failed).select("report_id", "publisher", F.lit("ok").alias("status"), F.lit(0).cast("long").alias("failures"))
    kept = rows.where(failed & (F.col("published_at") < V.now(V.PREVIOUS)))
    kept = kept.select("report_id", "publisher", F.when(failures + 1 >= 4, "failed").otherwise("stale").alias("status"), (failures + 1).alias("failures"))
    return fresh.unionByName(kept)


@register("display_projection_lists", "B34 B35 J1 J3 J8", V.sql("v_reports", f"""{_EDITED_SQL} SELECT cluster_id, band, editorial, families, CASE WHEN p_geo = 1 THEN families ELSE 0 END AS on_ground, band NOT IN ('suppressed', 'background') AND p_geo > 0 AS default_visible, band <> 'suppressed' AS routable,
    row_number() OVER (ORDER BY publishers DESC, CASE WHEN families >= 3 THEN 0 ELSE 1 END, editorial DESC, cluster_id) AS comparison_place FROM b ORDER BY comparison_place LIMIT 60"""))
def display_projection_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark, sf_dir)
    order = [F.desc("publishers"), F.when(F.col("families") >= 3, 0).otherwise(1), F.desc("editorial"), F.col("cluster_id")]
    top = rows.orderBy(*order).limit(60)
    place = F.row_number().over(Window.orderBy(*order))  # over 60 rows
    return top.select(
        "cluster_id", "band", "editorial", "families", F.when(F.col("p_geo") == 1, F.col("families")).otherwise(0).alias("on_ground"),
        (~F.col("band").isin("suppressed", "background") & (F.col("p_geo") > 0)).alias("default_visible"), (F.col("band") != "suppressed").alias("routable"), place.alias("comparison_place"),
    )


@register("explanation_event_state", "I3", V.sql("v_reports", f"""{_EDITED_SQL}, r AS (SELECT cluster_id, state, unnest([{{'w': round(p_geo, 3), 't': 'place'}}, {{'w': round(p_category, 3), 't': 'topic'}}, {{'w': CASE WHEN families >= 3 THEN round(p_diversity, 3) ELSE -0.5 END::DOUBLE, 't': CASE WHEN families >= 3 THEN 'several families' ELSE 'few families' END}},
        {{'w': CASE WHEN official THEN round(p_corroboration, 3) ELSE -0.1 END::DOUBLE, 't': CASE WHEN official THEN 'official source' ELSE 'no official source' END}}]) AS x FROM b),
    o AS (SELECT cluster_id, state, x.t AS reason, row_number() OVER (PARTITION BY cluster_id ORDER BY x.w DESC, x.t) AS k FROM r)
    SELECT cluster_id, any_value(state) AS state, array_to_string(list(reason ORDER BY k), '; ') AS reasons FROM o WHERE k <= 3 GROUP BY cluster_id"""))
def explanation_event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest reasons of each score."""
    many, official = F.col("families") >= 3, F.col("official")
    reason = lambda weight, text: F.struct((-F.round(weight, 3)).alias("k"), text.alias("t"))
    reasons = F.array(
        reason(F.col("p_geo"), F.lit("place")),
        reason(F.col("p_category"), F.lit("topic")),
        reason(F.when(many, F.col("p_diversity")).otherwise(-0.5), F.when(many, "several families").otherwise("few families")),
        reason(F.when(official, F.col("p_corroboration")).otherwise(-0.1), F.when(official, "official source").otherwise("no official source")),
    )
    rows = edited(spark, sf_dir)
    return rows.select("cluster_id", "state", F.array_join(F.transform(F.slice(F.sort_array(reasons), 1, 3), lambda x: x["t"]), "; ").alias("reasons"))


@register("discourse_match", "C9", V.sql("v_speech v_articles", f""", m AS (SELECT thread_id, turn, list_distinct({tokens_sql('text', 4)}) AS w FROM v_speech WHERE role = 'user'), c AS (SELECT article_id, list_distinct({tokens_sql("title", 4)}) AS w FROM v_articles),
    mt AS (SELECT thread_id, turn, unnest(w) AS t FROM m), ct AS (SELECT article_id, unnest(w) AS t FROM c),
    s AS (SELECT thread_id, turn, article_id, sum(CASE WHEN length(ct.t) >= 8 THEN 2 ELSE 1 END)::BIGINT AS score FROM mt JOIN ct ON mt.t = ct.t GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, turn ORDER BY score DESC, article_id) AS k FROM s WHERE score >= 3)
    SELECT thread_id, turn, article_id, score FROM r WHERE k = 1"""))
def discourse_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention's best article by shared words, long ones counting twice, from 3."""
    def lists(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(F.array_distinct(X.tokens(F.col(text), 4))))).alias("words"))

    mentions = Workspace(spark, "mentions").keep(lists(V.speech(spark, sf_dir).where("role = 'user'"), ["thread_id", "turn"], "text"), "rows")
    articles = lists(V.articles(spark, sf_dir), ["article_id"], "title").withColumnRenamed("article_id", "id")
    best = best_by_shared_words(mentions, articles, 3)
    return mentions.join(best, "words").select("thread_id", "turn", F.col("id").alias("article_id"), "score")


@register("snapshot_io_retention", "A13 A15 A17", V.sql("v_reports", """, d AS (SELECT published_at::DATE AS day, cluster_id, count(*) AS reports FROM v_reports GROUP BY 1, 2), k AS (SELECT *, dense_rank() OVER (ORDER BY day DESC) AS back FROM d)
    SELECT day, count(*) AS clusters, sum(reports)::BIGINT AS reports FROM k WHERE back <= 10 GROUP BY day"""))
def snapshot_io_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily history written as partitions and read back; the last ten stay."""
    daily = V.reports(spark, sf_dir).groupBy(F.to_date("published_at").alias("day"), "cluster_id").agg(F.count("*").alias("reports"))
    path = Workspace(spark, "history").path("daily")
    daily.write.mode("overwrite").partitionBy("day").parquet(path)
    stored = spark.read.schema("cluster_id int, reports long, day date").parquet(path)
    days = stored.select("day").distinct().orderBy(F.desc("day")).limit(10)
    return stored.join(F.broadcast(days), "day", "left_semi").groupBy("day").agg(F.count("*").alias("clusters"), F.sum("reports").alias("reports"))


@register("feed_descriptor_change_text", "B36 F19 M9", V.sql("v_reports", """, p AS (SELECT publisher, count(*) AS reports, count(DISTINCT family) AS families, bool_or(role = 'official-alert') AS alerts, count(DISTINCT cluster_id) AS clusters FROM v_reports GROUP BY publisher)
    SELECT publisher, coalesce(CASE WHEN publisher % 5 = 0 THEN 'agency' END, CASE WHEN alerts THEN 'alert-feed' ELSE 'newsroom' END) AS source_type, CASE WHEN publisher % 4 = 0 THEN 15 WHEN reports >= 70 THEN 30 ELSE 60 END AS poll_minutes,
        CASE WHEN families = 1 AND reports > 1 THEN reports || ' reports, one upstream' WHEN families >= 2 THEN families || ' groups' ELSE 'one source' END AS support, regexp_replace('internal:' || publisher || ' changed', '^internal:', '') AS change_text FROM p"""))
def feed_descriptor_change_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.reports(spark, sf_dir).groupBy("publisher").agg(F.count("*").alias("reports"), F.count_distinct("family").alias("families"), F.bool_or(F.col("role") == "official-alert").alias("alerts"))
    kind = F.coalesce(F.when(F.col("publisher") % 5 == 0, "agency"), F.when(F.col("alerts"), "alert-feed").otherwise("newsroom"))
    poll = F.when(F.col("publisher") % 4 == 0, 15).when(F.col("reports") >= 70, 30).otherwise(60)
    support = F.when((F.col("families") == 1) & (F.col("reports") > 1), F.concat("reports", F.lit(" reports, one upstream"))).when(F.col("families") >= 2, F.concat("families", F.lit(" groups"))).otherwise("one source")
    change = F.regexp_replace(F.concat(F.lit("internal:"), "publisher", F.lit(" changed")), "^internal:", "")
    return rows.select("publisher", kind.alias("source_type"), poll.alias("poll_minutes"), support.alias("support"), change.alias("change_text"))


_WEEKS_SQL = f"""now AS (SELECT TIMESTAMP '{V.NOW}' AS n, TIMESTAMP '{V.PREVIOUS}' AS p), cur AS (SELECT v_reports.* FROM v_reports, now WHERE published_at < n AND published_at >= n - INTERVAL 7 DAY),
    old AS (SELECT v_reports.* FROM v_reports, now WHERE published_at < p AND published_at >= p - INTERVAL 7 DAY),
    b AS (SELECT cluster_id, role, figure, count(*) AS n FROM old GROUP BY ALL), a AS (SELECT cluster_id, role, figure, count(*) AS n FROM cur GROUP BY ALL),
    f AS (SELECT coalesce(b.cluster_id, a.cluster_id) AS cluster_id, coalesce(b.role, a.role) AS role, coalesce(b.figure, a.figure) AS figure, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after
        FROM b FULL JOIN a ON b.cluster_id IS NOT DISTINCT FROM a.cluster_id AND b.role IS NOT DISTINCT FROM a.role AND b.figure IS NOT DISTINCT FROM a.figure),
    d AS (SELECT *, CASE WHEN before = 0 AND sum(CASE WHEN before > 0 AND after > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id, role) > 0 THEN 'contradicted' WHEN before = 0 THEN 'added' WHEN after = 0 THEN 'gone'
        WHEN after > before THEN 'more' WHEN after < before THEN 'fewer' ELSE 'same' END AS change FROM f)"""


def weeks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reports of the week before the previous snapshot, and of the week before now."""
    rows = V.reports(spark, sf_dir)
    return tuple(rows.where((F.col("published_at") < V.now(at)) & (F.col("published_at") >= V.now(at) - F.expr("INTERVAL 7 DAYS"))) for at in (V.PREVIOUS, V.NOW))


@register("claim_changes", "I7 K3", V.sql("v_reports", f", {_WEEKS_SQL} SELECT cluster_id, role, figure, before, after, change FROM d"))
def claim_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each cluster and role in two snapshots, and what became of them."""
    return N.claim_diff(*weeks(spark, sf_dir), ["cluster_id", "role"], "figure")


@register("update_kinds", "I7 I8", V.sql("v_reports", f""", {_WEEKS_SQL},
    g AS (SELECT cluster_id, count(*) FILTER (WHERE change IN ('added', 'contradicted')) AS figures, coalesce(bool_or(change = 'contradicted'), false) AS contradicted FROM d GROUP BY cluster_id),
    o AS (SELECT cluster_id, max(published_at) AS last, bool_or(role = 'official-alert') AS was_official, count(DISTINCT family) AS families FROM old GROUP BY cluster_id),
    c AS (SELECT cur.cluster_id, min(published_at) AS earliest, max(published_at) AS newest, count(*) FILTER (WHERE published_at > last + INTERVAL 20 MINUTE) AS fresh,
        coalesce(bool_or(role = 'official-alert' AND published_at > last + INTERVAL 20 MINUTE), false) AS official, count(DISTINCT family) AS families, any_value(last) AS last FROM cur LEFT JOIN o ON cur.cluster_id = o.cluster_id GROUP BY cur.cluster_id),
    x AS (SELECT c.cluster_id, c.last IS NOT NULL AS matched, epoch_us(n) / 3.6e9 - epoch_us(earliest) / 3.6e9 AS age, fresh, coalesce(contradicted, false) AS contradicted, official, coalesce(was_official, false) AS was_official, coalesce(figures, 0) AS figures,
        c.families - coalesce(o.families, 0) AS families, coalesce(greatest(0, (epoch_us(newest) - epoch_us(c.last)) / 3.6e9), 0) AS quiet FROM now, c LEFT JOIN g ON c.cluster_id = g.cluster_id LEFT JOIN o ON c.cluster_id = o.cluster_id),
    s AS (SELECT *, least(1.0::DOUBLE, greatest(0.2::DOUBLE, CASE WHEN contradicted THEN 0.85 ELSE 0 END, CASE WHEN official AND NOT was_official THEN 0.85 WHEN official THEN 0.55 ELSE 0 END, CASE WHEN figures > 0 THEN 0.7 ELSE 0 END) + CASE WHEN quiet >= 12 THEN 0.1 ELSE 0 END) AS score FROM x)
    SELECT cluster_id, CASE WHEN NOT matched AND age > 8 THEN 'unknown' WHEN NOT matched THEN 'major-development' WHEN fresh = 0 THEN 'duplicate'
        WHEN contradicted OR official OR figures > 0 THEN CASE WHEN score >= 0.8 OR (contradicted AND official) THEN 'major-development' WHEN official AND NOT was_official THEN 'new-official-confirmation' WHEN contradicted THEN 'new-contradiction' WHEN official THEN 'new-authority-statement' ELSE 'new-number' END
        WHEN families > 0 THEN 'new-source-only' ELSE 'duplicate' END AS kind,
        round(CASE WHEN NOT matched AND age > 8 THEN 0.4 WHEN NOT matched THEN 1 WHEN fresh = 0 THEN 0.1 WHEN contradicted OR official OR figures > 0 THEN score WHEN families > 0 THEN 0.3 ELSE 0.1 END, 2)::DOUBLE AS score FROM s"""))
def update_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update kind and score of each cluster from the diff of its figures; the events
    have no texts and places, so those rules are held by tests alone."""
    before, after = weeks(spark, sf_dir)
    diff = N.claim_diff(before, after, ["cluster_id", "role"], "figure").groupBy("cluster_id").agg(
        F.count_if(F.col("change").isin("added", "contradicted")).alias("figures"), F.bool_or(F.col("change") == "contradicted").alias("contradicted")
    )
    old = before.groupBy("cluster_id").agg(F.max("published_at").alias("last"), F.bool_or(F.col("role") == "official-alert").alias("was_official"), F.count_distinct("family").alias("old_families"))
    late = F.col("published_at") > F.col("last") + F.expr(f"INTERVAL {N.FRESH_MINUTES} MINUTES")
    now = after.join(old, "cluster_id", "left").groupBy("cluster_id").agg(
        F.min("published_at").alias("earliest"), F.max("published_at").alias("newest"), F.count_if(late).alias("fresh"), F.bool_or((F.col("role") == "official-alert") & late).alias("official"), F.count_distinct("family").alias("families")
    )
    rows = now.join(old, "cluster_id", "left").join(diff, "cluster_id", "left")
    no, zero = F.lit(False), F.lit(0)
    kind = N.update_kind(
        first_snapshot=no, matched=F.col("last").isNotNull(), age_hours=V.hours(V.now(), F.col("earliest")), fresh=F.col("fresh"), retracted=no, corrected=no, contradicted=F.coalesce("contradicted", no), countered=no,
        official=F.coalesce("official", no), was_official=F.coalesce("was_official", no), figures=F.coalesce("figures", zero), places=zero, claims=zero, families=F.col("families") - F.coalesce("old_families", zero), words=zero,
        quiet_hours=F.coalesce(F.greatest(zero, V.hours(F.col("newest"), F.col("last"))), zero),
    )
    return rows.select("cluster_id", kind.alias("u")).select("cluster_id", "u.kind", "u.score")
