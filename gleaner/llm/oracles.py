"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from gleaner.llm.licenses import TEMPLATES
from gleaner.llm.revisits import NOT_MERGED, TRACKING
from gleaner.llm.url_filter import _HIDDEN, _TAG, RULES

SPACE = r"[\x20\x09-\x0D]+"


def license_scan() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    words = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH template(template_id, license, body) AS (VALUES {values}),
    t AS (SELECT template_id, license, {grams} AS g FROM (SELECT *, {words.format("body")} AS w FROM template)),
    piece AS (
        SELECT doc_id, unnest(list_concat(string_split(text, chr(10)),
            list_filter(string_split_regex(text, '\\n[\\x20\\t\\r]*\\n'), lambda b: contains(b, chr(10))))) AS unit FROM documents),
    numbered AS (SELECT doc_id, row_number() OVER () AS unit_id, {words.format("unit")} AS w FROM piece),
    u AS (SELECT doc_id, unit_id, {grams} AS f FROM numbered WHERE len(w) > 1),
    tw AS (SELECT template_id, {words.format("body")} AS w FROM template),
    pair AS (SELECT template_id, i AS before, w[i + 1] || ' ' || w[i + 2] AS pair, len(w) AS n_words FROM (SELECT *, unnest(range(0, len(w) - 1)) AS i FROM tw)),
    chosen AS (SELECT template_id, pair FROM (SELECT template_id, pair, row_number() OVER (PARTITION BY template_id ORDER BY -length(pair), pair) AS k, count(*) OVER (PARTITION BY template_id) AS n
        FROM (SELECT DISTINCT template_id, pair FROM pair)) WHERE k <= n - ceil(n * 0.8 / 1.2 - 1e-9) + 1),
    anchor AS (SELECT pair.* FROM pair JOIN chosen USING (template_id, pair)),
    dw AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
    dp AS (SELECT doc_id, i AS pos, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT *, unnest(range(1, len(w))) AS i FROM dw)),
    laid AS (SELECT DISTINCT doc_id, template_id, greatest(pos - before, 1) AS a, n_words FROM dp JOIN anchor USING (pair)),
    win AS (SELECT doc_id, template_id, {grams} AS f FROM (SELECT doc_id, template_id, dw.w[a:a + n_words - 1] AS w FROM laid JOIN dw USING (doc_id))),
    p AS (
        SELECT doc_id, unit_id, license, 2.0::DOUBLE * len(list_intersect(f, g)) / (len(f) + len(g)) AS d
        FROM u, t WHERE len(f) * 1.5 + 1e-9 >= len(g) AND len(g) * 1.5 + 1e-9 >= len(f)
        UNION ALL SELECT doc_id, NULL, license, 2.0::DOUBLE * len(list_intersect(f, g)) / (len(f) + len(g)) FROM win JOIN t USING (template_id))
    SELECT doc_id, license, round(max(d), 6) AS dice, count(DISTINCT unit_id) AS n_units FROM p WHERE d >= 0.8 GROUP BY doc_id, license
    """


def source_mixing() -> str:
    return r"""
    WITH r AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
    w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
    l AS (
        SELECT *, cap / weight AS ratio,
            (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    f AS (SELECT *, max(CASE WHEN ratio >= level THEN level END) OVER () AS final FROM l),
    t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f),
    b AS (
        SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::INT ELSE 0 END AS whole,
            target - CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::INT ELSE 0 END * source_size AS budget FROM t),
    c AS (
        SELECT r.doc_id, r.size, b.*, coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS through,
            sum(size) OVER (PARTITION BY r.source, h) AS peers
        FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source),
    e AS (
        SELECT *, least(whole + CASE WHEN budget > 0 AND (through <= budget
            OR (through - peers <= budget AND through - budget < budget - (through - peers))) THEN 1 ELSE 0 END, 3)::INT AS passes FROM c)
    SELECT doc_id, size, source_size, target, (size * passes)::BIGINT AS taken, passes FROM e
    """


def warc_revisits() -> str:
    skip = ", ".join(f"'{name}'" for name in NOT_MERGED)
    return rf"""
    WITH p AS (
        SELECT page_id, url, epoch_ms(0) + to_seconds(1704067200 + page_id * 60) AS base,
            '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' AS tag, length(coalesce(html, ''))::VARCHAR AS size FROM pages),
    raw AS (
        SELECT page_id * 3 AS record_id, url, base AS ts, 'response' AS kind, tag AS etag,
            MAP {{'content-type': 'text/html', 'content-length': size, 'etag': tag, 'cache-control': 'max-age=60'}} AS headers FROM p WHERE page_id % 7 <> 0
        UNION ALL
        SELECT page_id * 3 + 1, url, base + INTERVAL 12 HOUR, 'response', 'W/' || tag,
            MAP {{'content-type': 'text/html', 'content-length': size, 'etag': tag, 'cache-control': 'max-age=60'}} FROM p WHERE page_id % 3 = 0
        UNION ALL
        SELECT page_id * 3 + 2, CASE WHEN contains(url, '#') THEN url WHEN contains(url, '?') THEN url || '&utm_medium=x' ELSE url || '?utm_medium=x' END,
            base + INTERVAL 24 HOUR, 'revisit', CASE WHEN page_id % 5 = 0 THEN '"stale"' ELSE tag END,
            MAP {{'content-length': '0', 'etag': tag, 'cache-control': 'max-age=3600', 'age': page_id::VARCHAR}} FROM p),
    parts AS (
        SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
            regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
            list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                lambda q: q <> '' AND NOT regexp_matches(lower(q), '{TRACKING}'))) AS kept FROM raw),
    c AS (SELECT * EXCLUDE (host, path, kept), host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM parts),
    j AS (
        SELECT v.record_id, v.canonical_url, v.etag, v.headers, f.record_id AS response_id, f.etag AS old_etag, f.headers AS old_headers,
            row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) AS k
        FROM (SELECT * FROM c WHERE kind = 'revisit') v LEFT JOIN (SELECT * FROM c WHERE kind = 'response') f
            ON f.canonical_url = v.canonical_url AND (f.ts, f.record_id) < (v.ts, v.record_id)),
    o AS (
        SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN regexp_replace(etag, '^W/', '') = regexp_replace(old_etag, '^W/', '') THEN 'resolved'
            ELSE 'changed' END AS outcome FROM j WHERE k = 1),
    h AS (
        SELECT *, CASE WHEN outcome = 'resolved' THEN list_concat(
            list_filter(map_entries(headers), lambda x: x.key NOT IN ({skip})),
            list_filter(map_entries(old_headers), lambda x: x.key IN ({skip}) OR NOT list_contains(map_keys(headers), x.key)))
            ELSE map_entries(headers) END AS e FROM o)
    SELECT record_id, canonical_url, CASE WHEN outcome = 'resolved' THEN response_id END AS response_id, outcome,
        array_to_string(list_sort(list_transform(e, lambda x: x.key || ': ' || x.value)), '; ') AS headers FROM h
    """


def benchmark_decontamination() -> str:
    return r"""
    WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
    w AS (
        SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM texts),
    s AS (
        SELECT side, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS shingle FROM w),
    n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id),
    m AS (
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
        FROM (SELECT * FROM s WHERE side = 'd') d JOIN (SELECT * FROM s WHERE side = 'i') i ON d.shingle = i.shingle GROUP BY d.id, i.id)
    SELECT doc_id, item_id, n AS n_item_shingles, n_shared, n_shared::DOUBLE / n AS containment FROM m JOIN n ON m.item_id = n.id WHERE n_shared >= 0.8 * n
    """


def near_dedup() -> str:
    return r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    g AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
    s AS (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS shingle FROM g),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS k
        FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY 1, 2),
    e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (x + y - k)),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    walk AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT t.b, walk.root FROM walk JOIN both_ways t ON walk.node = t.a),
    c AS (SELECT node, min(root) AS root FROM walk GROUP BY node)
    SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM g LEFT JOIN c ON doc_id = node
    """


def exact_dedup() -> str:
    return rf"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS body FROM documents),
    g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.body) AS text_sha256 FROM n JOIN g ON n.body = g.body
    """


def url_filter() -> str:
    values = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(name: str) -> str:
        pattern = rf"""(?is)[\s"'/]{name}{value}""".replace("'", "''")
        return " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3))

    jump = r"""(?is)^\s*[0-9.]+\s*[;,]\s*url\s*=\s*["']?([^"']*)""".replace("'", "''")
    hidden, tag = _HIDDEN.replace("'", "''"), _TAG.replace("'", "''")
    canonical = rf"""
        SELECT raw, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')
            THEN regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', ''), '^www\.', '')
                || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
                || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END ELSE url END AS node
        FROM (SELECT raw, trim(raw) AS url, list_sort(list_filter(string_split(regexp_extract(trim(raw), '^[^?#]*\?([^#]*)', 1), '&'),
            lambda q: q <> '' AND NOT regexp_matches(lower(q), '{TRACKING}'))) AS kept FROM urls)"""
    return rf"""
    WITH RECURSIVE rules(action, rule_host, rule_path) AS (VALUES {values}),
    tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{hidden}', ' ', 'g'), '{tag}')) AS tag FROM pages),
    named AS (
        SELECT url, replace(trim(CASE WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(lower({attribute("rel")}), '\s+'), 'canonical') THEN {attribute("href")}
            WHEN regexp_matches(tag, '(?i)^<meta') AND lower({attribute("http-equiv")}) = 'refresh' THEN regexp_extract({attribute("content")}, '{jump}', 1) END), '&amp;', '&') AS t FROM tags),
    site AS (
        SELECT url, t, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site,
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM named WHERE t <> '' AND t[1] <> '#'),
    link AS (
        SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR site = '' THEN NULL
            WHEN t[:2] = '//' THEN scheme || ':' || t WHEN t[1] = '/' THEN site || t WHEN t[1] = '?' THEN site || path || t
            ELSE site || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || t END AS target FROM site),
    urls AS (SELECT url AS raw FROM pages WHERE url IS NOT NULL UNION SELECT target FROM link WHERE target IS NOT NULL),
    node AS ({canonical}),
    parts AS (
        SELECT raw, CASE WHEN contains(raw, '://') THEN {lower.format("regexp_extract(raw, '(?s)^.*?://([^/?#]*)', 1)")} ELSE '' END AS host,
            CASE WHEN contains(raw, '://') THEN regexp_extract(raw, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM urls),
    best AS (
        SELECT raw, arg_max({{'rule': rule_host || rule_path, 'action': action}}, (length(rule_host || rule_path), action = 'allow', length(rule_host))) AS b
        FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY raw),
    edge AS (SELECT a.node AS a, b.node AS b FROM link JOIN node a ON url = a.raw JOIN node b ON target = b.raw WHERE a.node <> b.node),
    both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
    walk AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT t.b, walk.root FROM walk JOIN both_ways t ON walk.node = t.a),
    class AS (SELECT raw, coalesce((SELECT min(root) FROM walk WHERE walk.node = node.node), node.node) AS class FROM node),
    bad AS (SELECT DISTINCT class FROM class JOIN best USING (raw) WHERE b.action = 'block')
    SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, b.rule AS rule,
        coalesce(b.action, CASE WHEN bad.class IS NOT NULL THEN 'block' END, 'allow') AS verdict, bad.class IS NOT NULL AS class_blocked
    FROM pages LEFT JOIN parts ON pages.url = parts.raw LEFT JOIN best ON pages.url = best.raw LEFT JOIN class ON pages.url = class.raw LEFT JOIN bad ON class.class = bad.class
    """


def source_divergence() -> str:
    share = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * v)"
    return rf"""
    WITH d AS (
        SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
    voc AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN voc USING (lang, term) GROUP BY ALL),
    f AS (SELECT lang, source, term, coalesce(c, 0) AS c, whole FROM g JOIN voc USING (lang) LEFT JOIN c USING (lang, source, term)),
    n AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, sum(c) OVER (PARTITION BY lang) AS n_lang, count(*) OVER (PARTITION BY lang, source) AS v FROM f),
    s AS (SELECT lang, source, term, c, ({share.format("c", "n")})::BIGINT AS p, ({share.format("whole", "n_lang")})::BIGINT AS q FROM n),
    two AS (SELECT a.lang, a.source, a.term, a.p AS p, b.source AS item, b.p AS q FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
    sums AS (SELECT lang, source, item, sum(abs(p - q))::BIGINT AS value FROM two GROUP BY ALL),
    r AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE c > 0 AND p > q),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
    SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
    """


def sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan(),
        "op3_source_mixing": source_mixing(),
        "op4_benchmark_decontamination": benchmark_decontamination(),
        "op5_warc_revisits": warc_revisits(),
        "op6_near_dedup": near_dedup(),
        "op9_exact_dedup": exact_dedup(),
        "op12_url_filter": url_filter(),
        "op13_source_divergence": source_divergence(),
    }
