"""Hygiene, URLs, tokens, quantities, ids, lexicons and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.catalog import register
from gleaner.functions import lexicons as L
from gleaner.functions import quantities as Q
from gleaner.functions import text as X
from gleaner.sources import views as V


def _entities_sql(expression: str) -> str:
    for name, char in X.ENTITIES.items():
        expression = f"replace({expression}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expression


_BAD_CODE = "(n > 1114111 OR (n < 32 AND n NOT IN (9, 10)) OR n BETWEEN 127 AND 159 OR n BETWEEN 55296 AND 57343)"


def numeric_entities_sql(x: str, digits: str, value: str) -> str:
    """``value`` gives the number of d, the digits without leading zeros."""
    found = f"regexp_extract(p, '^{digits};', 1)"
    short = f"regexp_replace({found}, '^0+([0-9a-fA-F])', '\\1')"
    number = f"CASE WHEN length({short}) <= 8 THEN {value.format(d=short)} END"
    made = "CASE WHEN {n} IS NULL OR {bad} THEN '' ELSE chr(({n})::INT) END".format(n=f"({number})", bad=_BAD_CODE.replace("n ", f"({number}) "))
    return f"array_to_string(list_transform(string_split({x}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p WHEN {found} = '' THEN '&#' || p ELSE {made} || regexp_replace(p, '^{digits};', '') END), '')"


def decode_sql(x: str) -> str:
    return _entities_sql(numeric_entities_sql(numeric_entities_sql(x, "x([0-9a-fA-F]+)", "('0x' || {d})::BIGINT"), "([0-9]+)", "try_cast({d} AS BIGINT)"))


_TAGLESS_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'g'), '(?s)<[^>]+>', ' ', 'g')"
_STRIP_SQL = f"trim(regexp_replace(regexp_replace({decode_sql(_TAGLESS_SQL)}, '{X.CONTROLS}', '', 'g'), '{X.SPACES}', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_map = lambda table: "MAP {" + ", ".join(f"'{w}': '{to}'" for to, of in table.items() for w in of) + "}"
_STEM_SQL = "coalesce({m}[w], CASE WHEN length(w) > 4 AND ends_with(w, 's') AND NOT regexp_matches(w, '{k}') THEN coalesce({m}[substr(w, 1, length(w) - 1)], substr(w, 1, length(w) - 1)) ELSE w END)".format(m=_map(X.SAME_WORD), k=X.KEEPS_S)


def words_sql(text: str) -> str:
    return f"string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"


def unaccented_sql(text: str) -> str:
    return f"regexp_replace(translate({text}, {_quoted(X.ACCENTED)}, {_quoted(X.PLAIN)}), '[\\x{{0300}}-\\x{{036F}}]', '', 'g')"


def tokens_sql(text: str, least: int = 3) -> str:
    kept = f"list_filter({words_sql(unaccented_sql(f'lower({text})'))}, lambda w: length(w) >= {least} AND w NOT IN ({_STOP}))"
    return f"list_filter(list_transform({kept}, lambda w: {_STEM_SQL}), lambda w: w NOT IN ({_STOP}))"


def clip_sql(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) > {most} THEN rtrim(substr({text}, 1, {most - 1})) || '…' ELSE {text} END"


@register("html_clean", "L-hygiene", f"""WITH t AS (SELECT page_id, {_STRIP_SQL} AS body FROM pages)
    SELECT page_id, md5(body) AS body_md5, length(body) AS n_chars, {clip_sql('body', 360)} AS excerpt FROM t""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = V.table(spark, sf_dir, "pages").select("page_id", X.cleaned(F.col("html")).alias("body"))
    return body.select("page_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.length("body").alias("n_chars"), X.clip(F.col("body"), 360).alias("excerpt"))


_HOST_SQL = "regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1)), CASE lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) WHEN 'https' THEN ':443$' ELSE ':80$' END, '')"
_SAFE_URL_SQL = f"""CASE WHEN regexp_matches(trim(url), '^(?i:https?)://') AND contains({_HOST_SQL}, '.') AND NOT regexp_matches({_HOST_SQL}, '[\\s<>\\^|%]') THEN lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) || '://' || {_HOST_SQL}
    || coalesce(nullif(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END"""
_KEPT_SQL = f"""list_transform(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1), '&'),
    lambda p: p <> '' AND regexp_extract(p, '^([^=]*)', 1) NOT IN ({", ".join(f"'{t}'" for t in X.TRACKING)})), lambda p: replace(p, '%20', '+') || CASE WHEN contains(p, '=') THEN '' ELSE '=' END)"""
_URL_KEY_SQL = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', '')"


@register("url_canonicalise", "L-url", f"WITH u AS (SELECT page_id, url, {_KEPT_SQL} AS kept FROM pages) SELECT page_id, {_SAFE_URL_SQL} AS safe_url, {_URL_KEY_SQL} AS url_key FROM u")
def url_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", X.safe_url(F.col("url")).alias("safe_url"), X.url_key(F.col("url")).alias("url_key"))


@register("listing_scrape", "A9", """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)">', 1) AS links FROM pages),
    e AS (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM l) SELECT page_id, pos, link, length(link) > 5 AS long FROM e""")
def listing_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's links, in order."""
    links = F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)">'), F.lit(1))
    found = V.table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("at", "link"))
    return found.select("page_id", (F.col("at") + 1).cast("long").alias("pos"), "link", (F.length("link") > 5).alias("long"))


@register("alert_json_scan", "A5 A6", """WITH a AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE
        '{"identifier": ' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '"id' || (event_id % 50) || '"' END || ', "severity": "' || event_type || '", "centroid": "' || CASE WHEN event_id % 3 = 0 THEN 'x,1' ELSE round(value, 2)::VARCHAR || ',' || (user_id % 90) END || '"}' END AS raw FROM events),
    p AS (SELECT event_id, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.identifier') END AS identifier, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.severity') END AS severity,
        CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.centroid') END AS centroid FROM a)
    SELECT event_id, identifier, severity, 'urn:alert:' || identifier AS link, CASE WHEN lon IS NOT NULL AND lat IS NOT NULL THEN lon END AS lon, CASE WHEN lon IS NOT NULL AND lat IS NOT NULL THEN lat END AS lat
    FROM (SELECT *, try_cast(split_part(centroid, ',', 1) AS DOUBLE) AS lon, try_cast(split_part(centroid, ',', 2) AS DOUBLE) AS lat FROM p WHERE identifier IS NOT NULL)""")
def alert_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rows from JSON text with an explicit schema; broken text gives no row."""
    events = V.table(spark, sf_dir, "events")
    identifier = F.when(F.col("event_id") % 7 == 0, "null").otherwise(F.concat(F.lit('"id'), F.col("event_id") % 50, F.lit('"')))
    centroid = F.when(F.col("event_id") % 3 == 0, "x,1").otherwise(F.concat(F.round("value", 2).cast("string"), F.lit(","), F.col("user_id") % 90))
    raw = F.concat(F.lit('{"identifier": '), identifier, F.lit(', "severity": "'), "event_type", F.lit('", "centroid": "'), centroid, F.lit('"}'))
    raw = events.select("event_id", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(raw).alias("raw"))
    return scan_alerts(raw, "event_id")


def scan_alerts(raw: DataFrame, key: str) -> DataFrame:
    """(key, identifier, severity, link, lon, lat) of alerts with an identifier."""
    parsed = raw.select(key, F.from_json("raw", "identifier string, severity string, centroid string", {"mode": "PERMISSIVE"}).alias("p")).select(key, "p.*")
    ends = F.split("centroid", ",")
    lon, lat = F.try_element_at(ends, F.lit(1)).try_cast("double"), F.try_element_at(ends, F.lit(2)).try_cast("double")
    both = lon.isNotNull() & lat.isNotNull()
    return parsed.where("identifier is not null").select(
        key, "identifier", "severity", F.concat(F.lit("urn:alert:"), "identifier").alias("link"), F.when(both, lon).alias("lon"), F.when(both, lat).alias("lat")
    )


@register("title_tokens_key", "L-tokens D17", V.sql("v_articles", f"SELECT article_id, len({tokens_sql('title')}) AS n_tokens, array_to_string(list_sort({tokens_sql('title')}), ' ') AS title_key FROM v_articles"))
def title_tokens_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.articles(spark, sf_dir).select("article_id", F.size(X.tokens(F.col("title"))).cast("long").alias("n_tokens"), X.title_key(F.col("title")).alias("title_key"))


@register("language_script_counts", "B14", V.sql("v_articles", """, c AS (SELECT article_id, language, length(regexp_replace(title, '[^஀-௿]', '', 'g')) AS tamil, length(regexp_replace(title, '[^A-Za-z]', '', 'g')) AS latin FROM v_articles)
    SELECT article_id, latin, CASE WHEN tamil >= 12 THEN 'ta' WHEN tamil > 4 AND 2 * tamil >= latin THEN 'ta' WHEN latin > 4 THEN 'en' WHEN tamil > 0 THEN 'ta' ELSE 'unknown' END AS detected FROM c"""))
def language_script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.articles(spark, sf_dir).select("article_id", X.script_letters(F.col("title"), "A-Za-z").cast("long").alias("latin"), X.language_by_script(F.col("title")).alias("detected"))


def _quantities_sql(text: str) -> str:
    parts = [
        f"list_transform(regexp_extract_all(lower({text}), '(?:^|[^\\p{{L}}\\p{{N}}])([0-9][0-9,]*(?:\\.[0-9]+)?) ?{unit}(?:$|[^\\p{{L}}\\p{{N}}])', 1), lambda n: {{'unit': '{unit}', 'dimension': '{dim}', 'value': replace(n, ',', '')::DOUBLE * {factor}::DOUBLE}})"
        for unit, dim, factor in Q.UNITS
    ]
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) == 2 else " || ".join(parts)


_SENTENCE = "'Rain of ' || (article_id % 97) || ' mm and 1,' || (100 + article_id % 900) || ' people, ' || (article_id % 9) || '.5 km off; ' || (article_id % 40) || ' percent'"


@register("quantity_parse", "E4 E5 E6", V.sql("v_articles", f""", t AS (SELECT article_id, {_SENTENCE} AS body FROM v_articles), q AS (SELECT article_id, {_quantities_sql('body')} AS qs FROM t),
    e AS (SELECT article_id, unnest(qs) AS q FROM q) SELECT article_id, q.unit AS unit, q.dimension AS dimension, round(q.value, 6) AS value, abs(q.value - 1500) <= 0.02 * greatest(abs(q.value), 1500) AND q.dimension = 'count' AS near_1500 FROM e"""))
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string("Rain of %d mm and 1,%d people, %d.5 km off; %d percent", F.col("article_id") % 97, 100 + F.col("article_id") % 900, F.col("article_id") % 9, F.col("article_id") % 40)
    found = V.articles(spark, sf_dir).select("article_id", F.explode(Q.quantities(body)).alias("q"))
    probe = F.array(F.struct(F.lit("people").alias("unit"), F.lit("count").alias("dimension"), F.lit(1500.0).alias("value")))
    return found.select("article_id", "q.unit", "q.dimension", F.round("q.value", 6).alias("value"), Q.equivalent(F.array("q"), probe).alias("near_1500"))


def _fold_sql(chars: str, seed: int) -> str:
    return f"list_reduce(list_prepend({seed}::BIGINT, list_transform({chars}, lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) & 4294967295)"


_B36 = "list_reduce(list_prepend('', list_transform(range(7), lambda i: i::VARCHAR)), lambda s, i: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((({n}) // (36::BIGINT ** i::INT)::BIGINT) % 36)::INT + 1, 1) || s)"


@register("stable_id_slug", "L-slug 1.4", V.sql("v_articles", f""", k AS (SELECT article_id, publisher || ' ' || article_id AS body, string_split(publisher || ' ' || article_id, '') AS chars, title FROM v_articles),
    h AS (SELECT *, {_fold_sql('chars', 5381)} AS f, {_fold_sql('list_reverse(chars)', 52711)} AS b FROM k),
    s AS (SELECT article_id, title, ltrim({_B36.format(n='f')}, '0') || ltrim({_B36.format(n='b')}, '0') AS id FROM h)
    SELECT article_id, substr(id, 1, 12) AS stable_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace({unaccented_sql('lower(title)')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 56), '-+$', ''), ''), 'item') || '-' || substr(id, 1, 6) AS slug FROM s"""))
def stable_id_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.articles(spark, sf_dir).select("article_id", "title", X.stable_id(F.concat("publisher", F.lit(" "), F.col("article_id").cast("string"))).alias("stable_id"))
    return ids.select("article_id", "stable_id", F.concat(X.slug(F.col("title")), F.lit("-"), F.substring("stable_id", 1, 6)).alias("slug"))


def _rows_sql(rows: tuple) -> str:
    return "(VALUES " + ", ".join(str(r) for r in rows) + ") AS x(category, term, kind, weight, ord)"


@register("lexicon_category_scores", "B16 B17", V.sql("v_articles", f""", t AS (SELECT article_id, unnest({tokens_sql("title || ' ' || coalesce(excerpt, '')")}) AS term FROM v_articles),
    h AS (SELECT article_id, category, ord, sum(weight) AS points, count(*) FILTER (WHERE kind = 'strong') AS strong, count(*) FILTER (WHERE kind = 'keyword') AS keyword
        FROM t JOIN {_rows_sql(L.CATEGORY_ROWS)} USING (term) GROUP BY article_id, category, ord),
    r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY points DESC, ord) AS k, max(points) OVER (PARTITION BY article_id) AS top,
        max(CASE WHEN category = 'crisis' AND (strong >= 1 OR keyword >= 2) THEN points END) OVER (PARTITION BY article_id) AS crisis FROM h),
    p AS (SELECT article_id, CASE WHEN max(crisis) >= 0.72 * max(top) THEN 'crisis' ELSE max(CASE WHEN k = 1 THEN category END) END AS primary_category, max(top) AS points,
        max(CASE WHEN k = 1 THEN strong END) AS strong, max(CASE WHEN k = 1 THEN keyword END) AS keyword, max(CASE WHEN k = 2 AND points >= 0.5 * top AND points >= 4 THEN category END) AS secondary FROM r GROUP BY article_id)
    SELECT article_id, primary_category, points::BIGINT AS points, CASE WHEN secondary <> primary_category THEN secondary END AS secondary,
        CASE WHEN strong >= 2 OR points >= 20 THEN 'high' WHEN strong >= 1 THEN 'moderate' WHEN keyword >= 2 THEN 'low' ELSE 'weak' END AS confidence FROM p"""))
def lexicon_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category by points; crisis takes precedence from 72 % of the best."""
    docs = V.articles(spark, sf_dir).select("article_id", X.tokens(F.concat_ws(" ", "title", "excerpt")).alias("tokens"))
    hits = L.token_hits(docs, L.lexicon(spark, L.CATEGORY_ROWS), "article_id", "tokens")
    scores = hits.groupBy("article_id", "category", "ord").agg(
        F.sum(F.col("weight") * F.col("hits")).alias("points"),
        F.coalesce(F.sum(F.when(F.col("kind") == "strong", F.col("hits"))), F.lit(0)).alias("strong"),
        F.coalesce(F.sum(F.when(F.col("kind") == "keyword", F.col("hits"))), F.lit(0)).alias("keyword"),
    )
    own = Window.partitionBy("article_id")
    ranked = scores.withColumn("k", F.row_number().over(own.orderBy(F.desc("points"), "ord"))).withColumn("top", F.max("points").over(own))
    sure = (F.col("category") == "crisis") & ((F.col("strong") >= 1) | (F.col("keyword") >= 2))
    best = ranked.groupBy("article_id").agg(
        F.max(F.when(F.col("k") == 1, F.col("category"))).alias("first"),
        F.max(F.when(sure, F.col("points"))).alias("crisis"),
        F.max("top").alias("points"),
        F.max(F.when(F.col("k") == 1, F.col("strong"))).alias("strong"),
        F.max(F.when(F.col("k") == 1, F.col("keyword"))).alias("keyword"),
        F.max(F.when((F.col("k") == 2) & (F.col("points") >= 0.5 * F.col("top")) & (F.col("points") >= 4), F.col("category"))).alias("second"),
    )
    primary = F.when(F.col("crisis") >= 0.72 * F.col("points"), "crisis").otherwise(F.col("first"))
    confidence = F.when((F.col("strong") >= 2) | (F.col("points") >= 20), "high").when(F.col("strong") >= 1, "moderate").when(F.col("keyword") >= 2, "low").otherwise("weak")
    return best.withColumn("primary_category", primary).select(
        "article_id", "primary_category", "points", F.when(F.col("second") != F.col("primary_category"), F.col("second")).alias("secondary"), confidence.alias("confidence")
    )


@register("peak_count_severity", "B18 B19", V.sql("v_reports", """, c AS (SELECT cluster_id, max(figure) AS peak, count(DISTINCT family) AS districts, count(*) FILTER (WHERE role = 'official-alert') AS alerts, count(DISTINCT role) AS roles FROM v_reports GROUP BY cluster_id),
    s AS (SELECT *, list_reverse_sort([least(1, peak / 100.0::DOUBLE), least(1, districts / 12.0::DOUBLE), least(1, alerts / 30.0::DOUBLE)]) AS v FROM c)
    SELECT cluster_id, peak, CASE WHEN peak >= 100 OR alerts >= 25 THEN 'critical' WHEN peak >= 90 OR alerts >= 20 THEN 'severe' WHEN peak >= 50 THEN 'significant' WHEN peak >= 10 THEN 'watch' ELSE 'informational' END AS severity,
        round(least(1, CASE WHEN peak < 20 AND districts <= 1 THEN 0.2 ELSE v[1] + 0.25 * (v[2] + v[3]) END), 6)::DOUBLE AS consequence FROM s"""))
def peak_count_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity from peak figures, and consequence: the largest signal plus a
    quarter of the others, at most 1; isolated incidents stay at 0.2."""
    facts = V.reports(spark, sf_dir).groupBy("cluster_id").agg(
        F.max("figure").alias("peak"), F.count_distinct("family").alias("districts"), F.count_if(F.col("role") == "official-alert").alias("alerts")
    )
    peak, alerts = F.col("peak"), F.col("alerts")
    severity = (
        F.when((peak >= 100) | (alerts >= 25), "critical").when((peak >= 90) | (alerts >= 20), "severe").when(peak >= 50, "significant").when(peak >= 10, "watch").otherwise("informational")
    )
    signals = F.array(*[F.least(F.lit(1.0), F.col(c) / n) for c, n in (("peak", 100), ("districts", 12), ("alerts", 30))])
    ordered = F.sort_array(signals, asc=False)
    combined = ordered[0] + 0.25 * F.aggregate(F.slice(ordered, 2, 2), F.lit(0.0), lambda s, v: s + v)
    isolated = (peak < 20) & (F.col("districts") <= 1)
    return facts.select("cluster_id", "peak", severity.alias("severity"), F.round(F.least(F.lit(1.0), F.when(isolated, 0.2).otherwise(combined)), 6).alias("consequence"))


@register("normalise_reject_reasons", "B1 B3", f"""WITH u AS (SELECT page_id, url, {_KEPT_SQL} AS kept, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS raw FROM pages),
    t AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL ELSE {_SAFE_URL_SQL} END AS url, trim(regexp_replace({decode_sql("raw")}, '{X.SPACES}', ' ', 'g')) AS title, regexp_extract(url, '://([^/]*)', 1) AS feed FROM u),
    r AS (SELECT *, CASE WHEN url IS NULL THEN 'bad-url' WHEN length(title) < 8 THEN 'short-title' WHEN page_id % 13 = 0 THEN 'no-date' END AS reject_reason FROM t)
    SELECT page_id, url, {clip_sql('title', 240)} AS title, reject_reason FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY page_id) AS k FROM r) WHERE k <= 60""")
def normalise_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as items: the reason for which an item is rejected, or null; a feed
    (host) gives its first 60 items, which is the ingest's own limit."""
    title = F.trim(F.regexp_replace(X.decode_entities(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)), X.SPACES, " "))
    rows = V.table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("page_id") % 11 != 0, X.safe_url(F.col("url"))).alias("url"), title.alias("title"), F.regexp_extract("url", "://([^/]*)", 1).alias("feed")
    )
    reason = F.when(F.col("url").isNull(), "bad-url").when(F.length("title") < 8, "short-title").when(F.col("page_id") % 13 == 0, "no-date")
    first = F.row_number().over(Window.partitionBy("feed").orderBy("page_id")) <= 60
    return rows.withColumn("first", first).where("first").select("page_id", "url", X.clip(F.col("title"), 240).alias("title"), reason.alias("reject_reason"))


@register("role_scope_tier", "B2 B4 B6", V.sql("v_articles", f""", t AS (SELECT article_id, official, title, {tokens_sql('title')} AS w FROM v_articles),
    s AS (SELECT *, list_has_any(w, ['thnt', 'schen', 'ciónar']) AS foreign_hit, list_has_any(w, ['that', 'erth', 'und']) AS state_hit, list_filter(list_sort(list_distinct(w)), lambda x: x IN ('onth', 'eren', 'est', 'heat')) AS districts FROM t),
    g AS (SELECT *, CASE WHEN foreign_hit THEN 'excluded' WHEN state_hit THEN 'region' WHEN len(districts) = 1 THEN 'region' WHEN len(districts) > 1 THEN 'nation' ELSE 'none' END AS scope FROM s)
    SELECT article_id, scope, array_to_string(districts, ',') AS districts, CASE WHEN article_id % 9 = 0 THEN 'official-alert' WHEN official AND regexp_matches(lower(title), '(^| )(ing|edon)') THEN 'primary-document' WHEN official THEN 'government-statement'
        WHEN regexp_matches(lower(title), '(^| )(why|hestwh)') THEN 'expert-analysis' ELSE 'media-report' END AS role,
        CASE scope WHEN 'region' THEN 'P0' WHEN 'nation' THEN 'P1' WHEN 'none' THEN 'P2' ELSE CASE WHEN list_has_any(w, ['ente']) THEN 'P2' ELSE 'out' END END AS tier FROM g"""))
def role_scope_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope by an ordered list of rules over lexicon hits; role by feed and title
    (content never makes a feed official); tier by scope."""
    words = X.tokens(F.col("title"))
    rows = V.articles(spark, sf_dir).select("article_id", "official", F.lower("title").alias("title"), words.alias("w"))
    hit = lambda *terms: F.arrays_overlap("w", F.array(*[F.lit(t) for t in terms]))
    rows = rows.withColumn("districts", F.filter(F.array_sort(F.array_distinct("w")), lambda x: x.isin("onth", "eren", "est", "heat")))
    n = F.size("districts")
    scope = F.when(hit("thnt", "schen", "ciónar"), "excluded").when(hit("that", "erth", "und"), "region").when(n == 1, "region").when(n > 1, "nation").otherwise("none")
    role = (
        F.when(F.col("article_id") % 9 == 0, "official-alert").when(F.col("official") & F.col("title").rlike("(^| )(ing|edon)"), "primary-document")
        .when(F.col("official"), "government-statement").when(F.col("title").rlike("(^| )(why|hestwh)"), "expert-analysis").otherwise("media-report")
    )
    rows = rows.withColumn("scope", scope)
    tier = F.when(F.col("scope") == "region", "P0").when(F.col("scope") == "nation", "P1").when((F.col("scope") == "none") | hit("ente"), "P2").otherwise("out")
    return rows.select("article_id", "scope", F.array_join("districts", ",").alias("districts"), role.alias("role"), tier.alias("tier"))


@register("crisis_type_lifecycle", "B7 B8 B9 B10 B15", V.sql("v_articles", f""", t AS (SELECT article_id, published_at, title, unnest({tokens_sql("title || ' ' || coalesce(excerpt, '')")}) AS term FROM v_articles),
    h AS (SELECT article_id, category, ord, max(weight) + 2 * least(count(DISTINCT term) - 1, 2) AS weight FROM t JOIN {_rows_sql(L.CRISIS_ROWS)} USING (term) GROUP BY article_id, category, ord),
    b AS (SELECT article_id, arg_max(category, weight * 100 - ord) AS crisis_type, max(weight) AS weight FROM h GROUP BY article_id),
    a AS (SELECT v.article_id, crisis_type, coalesce(weight, 0) AS weight, title, CASE WHEN published_at + INTERVAL 36 HOUR < TIMESTAMP '2024-01-04' THEN 'all-clear' WHEN published_at > TIMESTAMP '2024-01-04 00:30:00' THEN 'developing' ELSE 'active' END AS lifecycle
        FROM v_articles v LEFT JOIN b ON v.article_id = b.article_id)
    SELECT article_id, crisis_type, weight, lifecycle, weight >= 24 AND lifecycle <> 'all-clear' AS is_crisis, len(regexp_extract_all(title, '[,;|]')) >= 4 OR regexp_matches(title, '(^| )[Ii]ng [Aa]') AS digest FROM a"""))
def crisis_type_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crisis type with most weight (earlier in the list on ties), lifecycle of the
    alert, the crisis predicate and the digest filter."""
    from gleaner.operators.trends import lifecycle

    rows = V.articles(spark, sf_dir)
    docs = rows.select("article_id", X.tokens(F.concat_ws(" ", "title", "excerpt")).alias("tokens"))
    hits = docs.select("article_id", F.explode("tokens").alias("term")).join(L.lexicon(spark, L.CRISIS_ROWS), "term")
    weights = hits.groupBy("article_id", "category", "ord").agg((F.max("weight") + 2 * F.least(F.count_distinct("term") - 1, F.lit(2))).alias("weight"))
    best = weights.groupBy("article_id").agg(F.max_by("category", F.struct("weight", -F.col("ord"))).alias("crisis_type"), F.max("weight").alias("weight"))
    life = lifecycle(F.col("published_at"), F.col("published_at") + F.expr("INTERVAL 36 HOURS"), F.lit("2024-01-04 00:00:00").cast("timestamp_ntz"))
    found = rows.join(best, "article_id", "left").withColumn("lifecycle", life).withColumn("weight", F.coalesce("weight", F.lit(0)))
    digest = (F.size(F.regexp_extract_all("title", F.lit("[,;|]"), F.lit(0))) >= 4) | F.col("title").rlike("(^| )[Ii]ng [Aa]")
    return found.select("article_id", "crisis_type", "weight", "lifecycle", ((F.col("weight") >= 24) & (F.col("lifecycle") != "all-clear")).alias("is_crisis"), digest.alias("digest"))


# Agencies in order; bare acronyms count only in capitals.
WIRES = (("PTI", "(^|[^A-Za-z])PTI([^A-Za-z]|$)"), ("ANI", "(^|[^A-Za-z])ANI([^A-Za-z]|$)"), ("Reuters", "(?i)(^|[^a-z])reuters([^a-z]|$)"), ("AFP", "(^|[^A-Za-z])AFP([^A-Za-z]|$)"), ("AP", "(?i)associated press"))


@register("wire_credit_labels_junk", "B30 B31 B33", V.sql("v_articles", f""", t AS (SELECT article_id, official, publisher, CASE article_id % 6 WHEN 0 THEN 'PTI: ' WHEN 1 THEN 'reuters - ' WHEN 2 THEN 'ani ' WHEN 3 THEN 'Associated Press, ' ELSE '' END || title AS body FROM v_articles)
    SELECT article_id, CASE {" ".join(f"WHEN regexp_matches(body, '{p}') THEN '{n}'" for n, p in WIRES)} END AS wire,
        CASE WHEN article_id % 5 = 0 THEN 'coverage-comparison' WHEN official THEN 'official-alert' ELSE 'single-report' END AS label, length(body) < 30 OR regexp_matches(body, '\\|') OR NOT regexp_matches(body, '[a-z]{{4}}') AS junk FROM t"""))
def wire_credit_labels_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*[F.lit(s) for s in ("PTI: ", "reuters - ", "ani ", "Associated Press, ", "", "")]), (F.col("article_id") % 6 + 1).cast("int"))
    rows = V.articles(spark, sf_dir).withColumn("body", F.concat(lead, "title"))
    wire = F.coalesce(*[F.when(F.col("body").rlike(pattern), name) for name, pattern in WIRES])
    label = F.when(F.col("article_id") % 5 == 0, "coverage-comparison").when(F.col("official"), "official-alert").otherwise("single-report")
    junk = (F.length("body") < 30) | F.col("body").rlike(r"\|") | ~F.col("body").rlike("[a-z]{4}")
    return rows.select("article_id", wire.alias("wire"), label.alias("label"), junk.alias("junk"))


@register("content_hash_store", "A12", "SELECT sha256(html) AS sha256, min(page_id) AS first_page, count(*) AS copies, 'raw/' || substr(sha256(html), 1, 2) || '/' || sha256(html) AS path FROM pages WHERE html IS NOT NULL GROUP BY sha256(html)")
def content_hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed store: one row for each distinct body."""
    rows = V.table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.sha2("html", 256).alias("sha256"))
    found = rows.groupBy("sha256").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies"))
    return found.withColumn("path", F.concat(F.lit("raw/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256"))
