"""Feed documents as raw items: RSS, RDF and Atom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _plain(xml: Column) -> Column:
    """Without prolog, namespaces and prefixes, which XPath would insist on."""
    bare = F.regexp_replace(xml, r"<\?[^>]*\?>|<!DOCTYPE[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1")


def parse_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A row for each item: the feed's columns, pos, title, link, published, summary, guid.

    Text that isn't a feed gives no row and never an error. Atom links prefer
    rel=alternate; ``updated`` goes before ``published``.
    """
    others = [c for c in feeds.columns if c != xml]
    ready = feeds.withColumn("_x", _plain(F.col(xml))).where(F.col("_x").rlike(r"(?s)^\s*<(rss|RDF|feed)\b.*</(rss|RDF|feed)>\s*$"))
    blocks = F.regexp_extract_all("_x", F.lit(r"(?s)(<(?:item|entry)\b.*?</(?:item|entry)>)"), F.lit(1))
    items = ready.select(*others, F.posexplode(blocks).alias("pos", "item"))

    def text(*names: str) -> Column:
        tries = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1), r"^\s*<!\[CDATA\[|\]\]>\s*$", "")), F.lit("")) for n in names]
        return F.coalesce(*tries)

    href = lambda pattern: F.nullif(F.regexp_extract("item", pattern, 1), F.lit(""))
    alternate = F.coalesce(href(r'<link\b[^>]*rel="alternate"[^>]*href="([^"]*)"'), href(r'<link\b[^>]*href="([^"]*)"[^>]*rel="alternate"'), href(r'<link\b[^>]*href="([^"]*)"'))
    return items.select(
        *others, "pos", text("title").alias("title"), F.coalesce(text("link"), alternate).alias("link"), text("pubDate", "updated", "date", "published").alias("published"),
        text("encoded", "description", "summary", "content").alias("summary"), text("guid", "id").alias("guid"),
    )


_ITEM = (
    "title string, link string, description string, encoded string, pubDate string, date string, author string, creator string, category array<string>, guid string, _corrupt string"
)
_ENTRY = (
    "title string, link array<struct<_href:string,_rel:string>>, updated string, published string, summary string, content string, "
    "author struct<name:string>, category array<struct<_term:string>>, id string, _corrupt string"
)


def read_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Items of RSS, RDF and Atom files that have landed in ``folder``, with its
    partition columns: file, title, link, published, summary, author, category, guid,
    corrupt.

    Files are split at their items, so a large one is read by many tasks; namespaces
    are left out, and it takes a scan for items and one for entries. Categories are
    joined by commas, Atom links prefer rel=alternate, ``updated`` goes before
    ``published``. What can't be parsed is kept as text in ``corrupt``, with the other
    columns null. A folder without files of a kind gives none of its rows.
    """

    def scan(tag: str, schema: str) -> DataFrame:
        options = {"rowTag": tag, "ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "nullValue": ""}
        return spark.read.format("xml").options(**options).schema(schema).load(folder).withColumn("file", F.col("_metadata.file_name"))

    filled = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])
    items, entries = scan("item", _ITEM), scan("entry", _ENTRY)
    parts = [c for c in items.columns if c not in {f.split()[0] for f in _ITEM.split(", ")} | {"file"}]
    joined = lambda values: F.nullif(F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), ","), F.lit(""))
    rss = items.select(
        *parts, "file", filled("title").alias("title"), filled("link").alias("link"), filled("pubDate", "date").alias("published"), filled("encoded", "description").alias("summary"),
        filled("author", "creator").alias("author"), joined(F.col("category")).alias("category"), filled("guid").alias("guid"), F.col("_corrupt").alias("corrupt"),
    )
    alternate = F.coalesce(F.get(F.filter("link", lambda x: x["_rel"] == "alternate"), 0)["_href"], F.get("link", 0)["_href"])
    atom = entries.select(
        *parts, "file", filled("title").alias("title"), alternate.alias("link"), filled("updated", "published").alias("published"), filled("summary", "content").alias("summary"),
        filled("author.name").alias("author"), joined(F.transform("category", lambda c: c["_term"])).alias("category"), filled("id").alias("guid"), F.col("_corrupt").alias("corrupt"),
    )
    return rss.unionByName(atom)
