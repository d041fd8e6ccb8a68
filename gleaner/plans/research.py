"""Record search and match, echo gate, grounded summaries and their firewall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.catalog import register
from gleaner.functions import text as X
from gleaner.operators import research as R
from gleaner.operators.topk import first_per_group
from gleaner.plans.claims import _JUDGED_SQL, judged
from gleaner.plans.text import tokens_sql
from gleaner.sources import views as V

_WORDS = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
_GRAMS = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [] END"
_BODY_SQL = "body AS (SELECT doc_id AS article_id, text AS body, source FROM documents)"
_CONTAIN_SQL = f"""{_BODY_SQL}, aw AS (SELECT article_id, {_WORDS.format('body')} AS w FROM body), ag AS (SELECT article_id, unnest({_GRAMS}) AS s FROM aw),
    rw AS (SELECT record_id, {_WORDS.format('text')} AS w FROM v_records), rg AS (SELECT record_id, {_GRAMS} AS g FROM rw), rs AS (SELECT record_id, len(g) AS n, unnest(g) AS s FROM rg),
    hit AS (SELECT article_id, record_id, n, count(*) AS shared FROM ag JOIN rs ON ag.s = rs.s GROUP BY 1, 2, 3 HAVING count(*)::DOUBLE / n >= 0.6)"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("body"), "source")


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.containment_join(bodies(spark, sf_dir), V.records(spark, sf_dir), "article_id", "record_id", 0.6)


@register("echo_containment", "C13 F4 F5", V.sql("v_records", f""", {_CONTAIN_SQL}, f AS (SELECT record_id, source, count(*) AS articles, round(max(shared::DOUBLE / n), 6) AS echo FROM hit JOIN body USING (article_id) GROUP BY record_id, source),
    g AS (SELECT record_id, count(*) AS families, count(*) FILTER (WHERE echo >= 0.9) AS echoing, max(echo) AS echo FROM f GROUP BY record_id)
    SELECT record_id, families, echoing, echo, CASE WHEN families - echoing >= 2 THEN 'independent' WHEN families - echoing = 1 THEN 'one-family-and-record' ELSE 'record-only' END AS outcome FROM g"""))
def echo_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families whose articles hold a record, and the gate that collapses echoes."""
    sources = bodies(spark, sf_dir).select("article_id", "source")
    found = contained(spark, sf_dir).join(sources, "article_id").groupBy("record_id", "source").agg(F.round(F.max("containment"), 6).alias("echo"))
    grouped = found.groupBy("record_id").agg(F.count("*").alias("families"), F.count_if(F.col("echo") >= 0.9).alias("echoing"), F.max("echo").alias("echo"))
    return grouped.withColumn("outcome", R.echo_gate(F.col("families"), F.col("echoing"), F.lit(1)))


@register("corpus_as_source", "A11", V.sql("v_articles", """ SELECT article_id AS record_id, publisher AS authority, title, sha256(title || chr(10) || coalesce(excerpt, '')) AS sha256, length(coalesce(excerpt, '')) >= 40 AS body_available FROM v_articles WHERE official"""))
def corpus_as_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official articles as primary records."""
    rows = V.articles(spark, sf_dir).where("official")
    body = F.coalesce("excerpt", F.lit(""))
    return rows.select(F.col("article_id").alias("record_id"), F.col("publisher").alias("authority"), "title", F.sha2(F.concat("title", F.lit("\n"), body), 256).alias("sha256"), (F.length(body) >= 40).alias("body_available"))


_SEARCH_SQL = f"""q AS (SELECT article_id, list_distinct({tokens_sql('title')}) AS w FROM v_articles), qt AS (SELECT article_id, len(w) AS n, unnest(w) AS t FROM q), rt AS (SELECT record_id, unnest(list_distinct({tokens_sql('text')})) AS t FROM v_records),
    sc AS (SELECT article_id, record_id, n, count(*) AS shared, max(length(qt.t)) AS longest FROM qt JOIN rt ON qt.t = rt.t GROUP BY 1, 2, 3), rel AS (SELECT article_id, record_id, shared, round(shared::DOUBLE / n + CASE WHEN longest >= 9 THEN 0.2 ELSE 0 END, 6) AS relevance FROM sc),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY relevance DESC, record_id) AS place FROM rel WHERE relevance >= 0.4) WHERE place <= 3)"""


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search_records(V.articles(spark, sf_dir).select("article_id", F.col("title").alias("body")), V.records(spark, sf_dir), "article_id", "record_id")


@register("record_search", "C5", V.sql("v_articles v_records", f", {_SEARCH_SQL} SELECT article_id, record_id, shared, relevance, place FROM top"))
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, sf_dir)


_UNIT_SQL = "CASE u " + " ".join(f"WHEN '{name}' THEN '{to}'" for name, to in R.UNIT_NAMES.items()) + " ELSE u END"


def figures_sql(text: str) -> str:
    """The list of {value, unit} of a text."""
    parts = f"list_transform(regexp_extract_all({text}, '{R._NUMBER}'), lambda m: {{'v': replace(regexp_extract(m, '^([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '')::DOUBLE, 'u': lower(regexp_extract(m, '(?i){R._UNITS}$', 1))}})"
    named = f"list_transform({parts}, lambda x: {{'value': x.v, 'unit': {_UNIT_SQL.replace('CASE u', 'CASE x.u').replace('ELSE u', 'ELSE x.u')}}})"
    return f"list_filter({named}, lambda x, i: list_position({named}, x) = i)[:{R.MOST_FIGURES}]"


_NEAR = "list_any_value(list_filter(recorded, lambda r: r.unit = c.unit AND abs(c.value - r.value) <= 0.02 * greatest(c.value, r.value)))"


@register("claim_record_match", "C6 N4", V.sql("v_articles v_records", f""", {_SEARCH_SQL}, fc AS (SELECT article_id, {figures_sql("title || chr(10) || excerpt")} AS claimed FROM v_articles), fr AS (SELECT record_id, {figures_sql("text")} AS recorded FROM v_records),
    m AS (SELECT top.article_id, top.record_id, shared, relevance, claimed, recorded FROM top JOIN fc ON top.article_id = fc.article_id JOIN fr ON top.record_id = fr.record_id),
    y AS (SELECT *, len(list_filter(claimed, lambda c: {_NEAR} IS NOT NULL)) AS hits, len(list_filter(claimed, lambda c: {_NEAR} IS NULL AND list_any_value(list_filter(recorded, lambda r: r.unit = c.unit)) IS NOT NULL)) AS against FROM m),
    o AS (SELECT article_id, CASE WHEN shared < 2 THEN 'not_found' WHEN len(claimed) > 0 AND hits = len(claimed) THEN 'corroborated' WHEN relevance >= 0.8 AND against > 0 THEN 'contradicted' ELSE 'not_found' END AS outcome FROM y)
    SELECT article_id, count(*) AS checked, count(*) FILTER (WHERE outcome = 'corroborated') AS corroborated, count(*) FILTER (WHERE outcome = 'contradicted') AS contradicted, bool_and(outcome = 'not_found') AS exhausted FROM o GROUP BY article_id"""))
def claim_record_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a claim's candidate records, by the figures in both texts."""
    claims = V.articles(spark, sf_dir).select("article_id", R.figures_with_units(F.concat("title", F.lit("\n"), "excerpt")).alias("claimed"))
    records = V.records(spark, sf_dir).select("record_id", R.figures_with_units(F.col("text")).alias("recorded"))
    rows = searched(spark, sf_dir).join(claims, "article_id").join(records, "record_id")
    outcome = F.when(F.col("shared") < 2, "not_found").otherwise(R.figure_outcome(F.col("claimed"), F.col("recorded"), F.col("relevance") >= 0.8))
    return rows.withColumn("outcome", outcome).groupBy("article_id").agg(
        F.count("*").alias("checked"), F.count_if(F.col("outcome") == "corroborated").alias("corroborated"), F.count_if(F.col("outcome") == "contradicted").alias("contradicted"), F.bool_and(F.col("outcome") == "not_found").alias("exhausted")
    )


_TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(body, '{pattern}') THEN '{name}'" for name, pattern in R.QUERY_TYPES) + " ELSE 'other' END"


@register("research_queries", "N1 N2 N3", V.sql("v_articles", f""", b AS (SELECT article_id, title || chr(10) || excerpt AS body, official, (epoch_us(TIMESTAMP '{V.NOW}') - epoch_us(published_at)) / 3.6e9 AS age FROM v_articles),
    q AS (SELECT article_id, {_TYPE_SQL} AS type, list_sort(list_distinct(list_transform(regexp_extract_all(body, '\\b[A-Z][a-z]{{3,}}(?:\\s+[A-Z][a-z]{{3,}}){{0,3}}'), lambda n: trim(n)))) AS names, {figures_sql("body")} AS figures, regexp_extract_all(body, '{R._DATE}') AS dates
        FROM b WHERE NOT official AND age <= 30 * 24 AND regexp_matches(body, '{R.CHECKABLE}'))
    SELECT article_id, type, least(len(list_filter(names, lambda n: NOT regexp_matches(n, '^(?i)(The|This|That|Tamil Nadu|India)$'))), {R.MOST_NAMES}) AS names, len(figures) AS figures, least(len(list_distinct(dates)), {R.MOST_DATES}) AS dates FROM q"""))
def research_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look for in records for articles that no official source backs.

    The clock of the articles is the events' own, so the age limit is 30 days here.
    """
    body = F.concat("title", F.lit("\n"), "excerpt")
    rows = V.articles(spark, sf_dir).select("article_id", "official", body.alias("body"), (V.hours(V.now(), F.col("published_at")) / 10).alias("age"))
    asked = rows.where(R.trigger(F.lit(1), F.col("official"), F.col("age"), F.col("body"))).select("article_id", R.record_query(F.col("body")).alias("q"))
    return asked.select("article_id", "q.type", *[F.size(f"q.{c}").cast("long").alias(c) for c in ("names", "figures", "dates")])


_BRIEF_SQL = f"""{_JUDGED_SQL}, ev AS (SELECT event_id, count(*) AS claims, count(*) FILTER (WHERE status = 'corroborated') AS corroborated, count(*) FILTER (WHERE primary_record) AS records, count(*) FILTER (WHERE disputed) AS disputed, max(groups) AS families, max(confidence) AS best FROM f GROUP BY event_id),
    br AS (SELECT *, CASE WHEN claims < 3 THEN 'no claims' WHEN families < 2 AND records = 0 THEN 'single family' WHEN event_id % 10 = 0 THEN 'echo only' WHEN disputed * 4 > claims THEN 'disputed' WHEN best < 40 THEN 'low confidence' END AS withheld FROM ev)"""


def brief_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = judged(spark, sf_dir).groupBy("event_id").agg(
        F.count("*").alias("claims"), F.count_if(F.col("status") == "corroborated").alias("corroborated"), F.count_if("primary_record").alias("records"),
        F.count_if("disputed").alias("disputed"), F.max("groups").alias("families"), F.max("confidence").alias("best"),
    )
    reason = (
        F.when(F.col("claims") < 3, "no claims").when((F.col("families") < 2) & (F.col("records") == 0), "single family").when(F.col("event_id") % 10 == 0, "echo only")
        .when(F.col("disputed") * 4 > F.col("claims"), "disputed").when(F.col("best") < 40, "low confidence")
    )
    return facts.withColumn("withheld", reason)


@register("brief_select_withhold", "O1", V.sql("v_claims", f", {_BRIEF_SQL} SELECT event_id, claims, corroborated, records, families, withheld FROM br"))
def brief_select_withhold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a brief, or the first reason for which it is withheld."""
    return brief_inputs(spark, sf_dir).select("event_id", "claims", "corroborated", "records", "families", "withheld")


@register("brief_firewall", "O5", V.sql("v_records", f""", b AS (SELECT doc_id AS article_id, text AS body, doc_id % 40 AS record_id FROM documents), s AS (SELECT article_id, record_id, unnest(list_filter(string_split_regex(body, '[.\\n]+ ?'), lambda x: length(x) > 20)) AS sentence FROM b),
    c AS (SELECT article_id, sentence, list_filter({_WORDS.format('sentence')}, lambda w: length(w) >= 5) AS need, {_WORDS.format('text')} AS have, regexp_extract_all(sentence, '[0-9]+') AS numbers, text FROM s JOIN v_records USING (record_id)),
    k AS (SELECT article_id, len(list_filter(need, lambda w: list_contains(have, w)))::DOUBLE / greatest(len(need), 1) >= 0.6 AND len(list_filter(numbers, lambda n: NOT contains(text, n))) = 0 AND len(need) > 0 AS supported FROM c)
    SELECT article_id, count(*) AS sentences, count(*) FILTER (WHERE supported) AS kept, CASE WHEN count(*) FILTER (WHERE supported) = 0 THEN 'nothing verified' END AS withheld FROM k GROUP BY article_id"""))
def brief_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that their cited record supports: long words from 60 %, every
    number; a brief without any is withheld."""
    rows = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text", (F.col("doc_id") % 40).alias("record_id"))
    sentences = rows.select("article_id", "record_id", F.explode(F.filter(F.split("text", r"[.\n]+ ?"), lambda x: F.length(x) > 20)).alias("sentence"))
    cited = sentences.join(V.records(spark, sf_dir), "record_id")
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")
    need = F.filter(words("sentence"), lambda w: F.length(w) >= 5)
    checked = cited.select("article_id", "text", need.alias("need"), words("text").alias("have"), F.regexp_extract_all("sentence", F.lit("[0-9]+"), F.lit(0)).alias("numbers"))
    found = X.with_value(F.col("have"), lambda have: F.size(F.filter("need", lambda w: F.array_contains(have, w))))
    share = found / F.greatest(F.size("need"), F.lit(1))
    ok = (share >= 0.6) & F.forall("numbers", lambda n: F.contains("text", n)) & (F.size("need") > 0)
    counts = checked.withColumn("ok", ok).groupBy("article_id").agg(F.count("*").alias("sentences"), F.count_if("ok").alias("kept"))
    return counts.withColumn("withheld", F.when(F.col("kept") == 0, "nothing verified"))


@register("brief_text", "O2 O3", V.sql("v_claims", f""", {_BRIEF_SQL}, r AS (SELECT f.*, row_number() OVER (PARTITION BY event_id, kind ORDER BY confidence DESC, value DESC) AS kk FROM f WHERE NOT disputed),
    p AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, kind, value DESC) AS k FROM r WHERE kk = 1),
    l AS (SELECT event_id, max(CASE WHEN k = 1 THEN groups || ' groups report ' || kind || ' of ' || value::BIGINT || '.' END) AS lead, array_to_string(list(kind || '=' || value::BIGINT ORDER BY k) FILTER (WHERE k BETWEEN 2 AND 7), '; ') AS facts FROM p GROUP BY event_id)
    SELECT br.event_id, CASE WHEN withheld IS NULL THEN lead END AS lead, CASE WHEN withheld IS NULL THEN facts END AS facts, withheld FROM br LEFT JOIN l ON br.event_id = l.event_id"""))
def brief_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead sentence and up to six facts, one for each kind, undisputed ones only."""
    rows = judged(spark, sf_dir).where("not disputed").drop("place")
    best = first_per_group(rows, ["event_id", "kind"], [F.desc("confidence"), F.desc("value")], 1).drop("place")
    ranked = first_per_group(best, ["event_id"], [F.desc("confidence"), F.col("kind"), F.desc("value")], 7)
    whole = F.col("value").cast("long").cast("string")
    lead = F.max(F.when(F.col("place") == 1, F.concat(F.col("groups").cast("string"), F.lit(" groups report "), "kind", F.lit(" of "), whole, F.lit("."))))
    facts = F.sort_array(F.collect_list(F.when(F.col("place") >= 2, F.struct("place", F.concat("kind", F.lit("="), whole).alias("t")))))
    text = ranked.groupBy("event_id").agg(lead.alias("lead"), facts.alias("facts"))
    shown = lambda c: F.when(F.col("withheld").isNull(), c)
    joined = brief_inputs(spark, sf_dir).join(text, "event_id", "left")
    listed = F.when(F.size("facts") > 0, F.array_join(F.transform("facts", lambda x: x["t"]), "; "))
    return joined.select("event_id", shown(F.col("lead")).alias("lead"), shown(listed).alias("facts"), "withheld")


@register("micro_brief", "O7", V.sql("v_articles", """, w AS (SELECT article_id, string_split(trim(regexp_replace(title, '[\\s]+', ' ', 'g')), ' ') AS t, string_split(trim(regexp_replace(split_part(coalesce(excerpt, ''), chr(10), 1), '[\\s]+', ' ', 'g')), ' ') AS e FROM v_articles)
    SELECT article_id, array_to_string((CASE WHEN len(t) < 22 THEN list_concat(t, e) ELSE t END)[1:60], ' ') AS brief FROM w"""))
def micro_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 60 words: the lead, and the first fact where the lead is short."""
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"[\s]+", " ")), " ")
    lead, fact = words(F.col("title")), words(F.substring_index(F.coalesce("excerpt", F.lit("")), "\n", 1))
    return V.articles(spark, sf_dir).select("article_id", F.array_join(F.slice(F.when(F.size(lead) < 22, F.concat(lead, fact)).otherwise(lead), 1, 60), " ").alias("brief"))
