"""URL filters: rules, aliases over links, odd rows; against DuckDB and by hand."""

import duckdb
import pytest

from gleaner.llm import oracles
from gleaner.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, rule string, host string"
CANON = '<html><head><link rel="canonical" href="{}"></head></html>'
PAGES = [
    (1, "https://a.example.net/de/1", ""),  # blocked by net/
    (2, "https://one.org/x", CANON.format("https://a.example.net/de/1")),
    (3, "http://two.org/y?p=1", "<META content='0; URL=http://one.org/x' HTTP-EQUIV=refresh>"),
    (4, "http://three.org/fr/z", CANON.format("//two.org/y?p=1")),  # allowed by org/fr/
    (5, "http://four.org/a/b", "<link href=../c rel='next canonical'>"),
    (6, "http://four.org/q", "<!-- " + CANON.format("https://a.example.net/de/1") + " --><script>" + CANON.format("https://a.example.net/de/1") + "</script>"),
    (7, "http://example.net/en/", ""),
    (8, "http://EXAMPLE.net/EN/?x=/en/", ""),
    (9, "https://notexample.com/de/1", ""),
    (10, "https://x.y.Example.com/de/1#top", ""),
    (11, "https://example.com", ""),
    (12, "foo.net/bar", CANON.format("/elsewhere")),
    (13, None, CANON.format("https://a.example.net/de/1")),
    (14, "", None),
    (15, "http://one.org/x?utm_source=feed", None),  # canonical form of page 2
    (16, "https://net/", ""),
    (17, "https://five.org/1", CANON.format("https://gone.net/never/crawled")),
    (18, "https://six.org/", "<link rel=canonical href='/s?a=1&amp;b=2'>"),
    (19, "https://six.org/s?a=1&b=2", CANON.format("mailto:x@y.net")),
    (2, "https://one.org/x", CANON.format("https://a.example.net/de/1")),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    rows = [(i, u, h, "clash", "clash") for i, u, h in PAGES]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(at / "pages.parquet"))
    return at


def judged(spark, folder):
    pages = spark.read.parquet(str(folder / "pages.parquet"))
    return U.filter_urls(pages, U.page_links(pages), U.RULES)


def test_verdicts(spark, folder):
    found = {r.page_id: r for r in judged(spark, folder).collect()}
    blocked = {1, 2, 3, 8, 10, 15, 16, 17}
    assert {i for i, r in found.items() if r.verdict == "block"} == blocked
    assert found[4].rule == "org/fr/" and found[4].class_blocked and found[4].verdict == "allow"
    assert found[7].rule == "example.net/en/" and found[8].rule == "net/" and found[10].rule == "example.com/de/"
    assert (found[10].host, found[10].path) == ("x.y.example.com", "/de/1")
    assert all((found[i].host, found[i].path, found[i].rule) == ("", "", None) for i in (12, 13, 14))
    assert found[11].path == "" and found[2].rule is None


def test_rows_equal_the_statement(spark, folder):
    frame = judged(spark, folder)
    order = sorted(frame.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{folder}/pages.parquet/*.parquet'")
    expected = con.sql(f"SELECT {', '.join(order)} FROM ({oracles.url_filter()})").fetchall()
    found = [tuple(r) for r in frame.select(*order).collect()]
    assert len(found) == len(PAGES) and sorted(map(str, found)) == sorted(map(str, expected))


def test_shuffled_joins_give_the_same(spark, folder, monkeypatch):
    from gleaner.operators import components

    expected = sorted(map(str, judged(spark, folder).collect()))
    monkeypatch.setattr(U, "MOST_BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "MOST_BROADCAST_ROWS", 0)
    assert sorted(map(str, judged(spark, folder).collect())) == expected


def test_ties_and_other_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.net/en/1"), (2, "http://b.net/x"), (3, "http://c.de/")], "page_id long, url string")
    links = spark.createDataFrame([], "url string, target string")
    rules = [("block", "b.net", "/x"), ("allow", "B.NET", "/x"), ("block", "a.b.net", "/en/"), ("skip", "c.de", "/"), ("block", None, "/")]
    found = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(pages, links, spark.createDataFrame(rules, "action string, host string, path string")).collect()}
    assert found == {1: ("a.b.net/en/", "block"), 2: ("b.net/x", "allow"), 3: (None, "allow")}
    none = spark.createDataFrame([], "action string, host string, path string")
    assert {r.verdict for r in U.filter_urls(pages, links, none).collect()} == {"allow"}
    assert U.filter_urls(pages.limit(0), links, U.RULES).count() == 0


def test_a_long_chain_with_a_hub(spark):
    urls = [f"http://h{i}.org/p" for i in range(40)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://s{i}.org/") for i in range(200)], "page_id long, url string")
    links = [(a, b) for a, b in zip(urls, urls[1:], strict=False)] + [(f"http://s{i}.org/", urls[20]) for i in range(200)] + [(urls[39], "http://spam.net/")]
    found = U.filter_urls(pages, spark.createDataFrame(links, "url string, target string"), U.RULES)
    assert found.where("verdict = 'block' and class_blocked").count() == 240


def test_very_long_urls_and_markup(spark):
    long = "http://" + "a." * 60_000 + "net/" + "b" * 200_000
    html = "<link rel=canonical href='" + long + "'>" + "<link " + "x" * 300_000 + "<script>" * 200
    pages = spark.createDataFrame([(1, "http://one.org/", html), (2, long, "")], "page_id long, url string, html string")
    assert {r.verdict for r in U.filter_urls(pages, U.page_links(pages), U.RULES).collect()} == {"block"}
