"""WARC revisit records: not-modified captures resolved to full responses.

A revisit says that a resource has not changed since an earlier capture. It is
resolved by an as-of join: the latest earlier full response with the same
canonical URL, whose validators must agree; then the headers that a 304 may
update are merged over the stored ones.

The as-of join never gathers a URL's whole history in one task. Time is cut into
slices of about equal row counts; each slice of a URL is searched on its own, and
only the last response of each slice is carried on to later slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.storage import Workspace

#: Query parameters that don't change what a URL names.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid|igshid|sessionid)="
#: Stored headers that a 304 may not replace (RFC 9111, section 3.2).
NOT_MERGED = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without last slash, sorted query.

    Scheme, fragment and tracking parameters are dropped; host and scheme ignore
    case. A URL without ``scheme://`` stays as it is, trimmed.
    """
    url = F.trim(url)
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(host, path, query)).otherwise(url)


def resolve_revisits(captures: DataFrame, *, slices: int = 256, relative_error: float = 0.001) -> DataFrame:
    """One row per revisit of ``captures``.

    ``captures`` has record_id long, url string, ts timestamp, kind string
    ('response' or 'revisit'), etag string, last_modified string and headers
    map<string,string> (lower-case names); other columns are ignored. The result
    has record_id, canonical_url, ts, response_id, outcome and headers.

    Earlier means an earlier ts, or the same ts and a smaller record_id. Outcome
    is 'resolved', 'changed' (a validator that both carry differs; an entity tag
    decides alone where both have one, and W/ prefixes are ignored), 'unchecked'
    (no validator in common), 'orphan' (no earlier response) or 'undated' (url or
    ts is null). Headers are the merged ones where resolved or unchecked, else
    the revisit's own. Repeated records are resolved each; an empty table gives
    an empty result. Many captures of one URL at one instant share a slice.
    """
    space = Workspace(captures.sparkSession, "revisits")
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", "headers"
    )
    rows = space.keep(rows, "rows")
    cuts = [(i + 1) / slices for i in range(slices - 1)]
    marks = rows.select(F.col("ts").cast("double").alias("at")).approxQuantile("at", cuts, relative_error)
    marks = sorted(set(marks))
    placed = rows.withColumn("slice", F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m < F.col("ts").cast("double"))) if marks else F.lit(0))
    whole = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    stored = F.struct("ts", "record_id", "etag", "last_modified", "headers")

    full = placed.where(whole & (F.col("kind") == "response"))
    last = full.groupBy("canonical_url", "slice").agg(F.max_by(stored, F.struct("ts", "record_id")).alias("last"))
    asked = placed.where(whole & (F.col("kind") == "revisit")).select("canonical_url", "slice").distinct()
    summary = asked.join(last, ["canonical_url", "slice"], "full")
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("canonical_url", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    carried = space.keep(carried.where("carried is not null"), "carried")

    near = Window.partitionBy("canonical_url", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("kind") == "response", stored), ignorenulls=True).over(near)
    found = placed.where(whole).withColumn("seen", seen).where("kind = 'revisit'")
    found = found.join(carried, ["canonical_url", "slice"], "left").withColumn("match", F.coalesce("seen", "carried"))
    undated = placed.where(~whole & (F.col("kind") == "revisit")).withColumn("match", F.lit(None).cast(found.schema["match"].dataType))
    found = found.drop("seen", "carried").unionByName(undated)

    def plain(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    same_tag = plain(F.col("etag")) == plain(F.col("match.etag"))
    same_date = F.col("last_modified") == F.col("match.last_modified")
    outcome = (
        F.when(F.col("canonical_url").isNull() | F.col("ts").isNull(), "undated")
        .when(F.col("match").isNull(), "orphan")
        .when(F.coalesce(same_tag, same_date).isNull(), "unchecked")
        .when(F.coalesce(same_tag, same_date), "resolved")
        .otherwise("changed")
    )
    own = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    old = F.coalesce(F.col("match.headers"), F.create_map().cast("map<string,string>"))
    update = F.map_filter(own, lambda k, _: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "ts",
        F.when(F.col("outcome").isin("resolved", "unchecked"), F.col("match.record_id")).alias("response_id"),
        "outcome",
        F.when(F.col("outcome").isin("resolved", "unchecked"), merged).otherwise(own).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC-like capture records over the table of pages.

    Each page gives a full response (every seventh is missing), a revisit a day
    later under a URL with a tracking parameter (every fifth with another entity
    tag), and every third a second full response between them.
    """
    base = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), 1, 12), F.lit('"'))
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")

    def record(k: int, kind: str, hours: int, url: Column, etag: Column, headers: Column) -> Column:
        return F.struct(
            (F.col("page_id") * 3 + k).alias("record_id"),
            url.alias("url"),
            (base + F.make_dt_interval(hours=F.lit(hours))).alias("ts"),
            F.lit(kind).alias("kind"),
            etag.alias("etag"),
            F.lit(None).cast("string").alias("last_modified"),
            headers.alias("headers"),
        )

    full = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size, F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=60"))
    again = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=3600"), F.lit("age"), F.col("page_id").cast("string"))
    other = F.when(F.col("page_id") % 5 == 0, F.lit('"stale"')).otherwise(tag)
    marked = F.concat("url", F.when(F.contains("url", F.lit("?")), F.lit("&utm_medium=x")).otherwise(F.lit("?utm_medium=x")))
    records = F.array(
        F.when(F.col("page_id") % 7 != 0, record(0, "response", 0, F.col("url"), tag, full)),
        F.when(F.col("page_id") % 3 == 0, record(1, "response", 12, F.col("url"), F.concat(F.lit("W/"), tag), full)),
        record(2, "revisit", 24, F.when(F.contains("url", F.lit("#")), F.col("url")).otherwise(marked), other, again),
    )
    return pages.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")
