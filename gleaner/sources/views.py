"""Report-stream views over the driver's tables.

The tables hold no news, so the engine's queries run on these deterministic
views. Each is defined once for Spark and once as a DuckDB common table
expression with the same integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed clock of the event stream; no query reads the wall clock.
NOW = "2024-01-29 12:00:00"
#: Snapshots: what had been seen by this time, and by NOW.
PREVIOUS = "2024-01-20 00:00:00"

ROLES = {"signup": "official-alert", "purchase": "primary-document", "error": "developing-unverified", "view": "media-report", "click": "expert-analysis"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now(at: str = NOW):
    return F.lit(at).cast("timestamp_ntz")


def hours(later, earlier):
    """Hours between two times, as a double."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, one every seven minutes."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.col("source").alias("publisher"),
        (number % 7).alias("family"),
        F.col("lang").alias("language"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 420).cast("timestamp_ntz").alias("published_at"),
        title.alias("title"),
        F.substr("text", F.length(title) + 2, F.lit(360)).alias("excerpt"),
        (number % 10 == 0).alias("official"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports on clusters."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").cast("int").alias("cluster_id"),
        F.col("event_id").alias("report_id"),
        F.col("user_id").alias("publisher"),
        (F.col("user_id") % 12).alias("family"),
        F.col("ts").alias("published_at"),
        role[F.col("event_type")].alias("role"),
        F.floor("value").alias("figure"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as numeric claims that suppliers publish about events."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"]).select(
        (F.col("l_orderkey") % 200).alias("event_id"),
        F.concat("l_returnflag", "l_linestatus").alias("kind"),
        F.col("l_quantity").alias("value"),
        F.col("l_suppkey").alias("publisher"),
        F.col("s_nationkey").alias("family"),
        F.col("l_shipdate").alias("seen_at"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("record_id"), "text")


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), "turn", "role", "text")


_ROLE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " END"

SQL = {
    "v_articles": """SELECT doc_id AS article_id, source AS publisher, regexp_extract(source, '[0-9]+')::INT % 7 AS family, lang AS language,
        TIMESTAMP '2024-01-01' + to_seconds(doc_id * 420) AS published_at, split_part(text, chr(10), 1) AS title,
        substr(text, length(split_part(text, chr(10), 1)) + 2, 360) AS excerpt, regexp_extract(source, '[0-9]+')::INT % 10 = 0 AS official FROM documents""",
    "v_reports": f"""SELECT json_extract_string(props, '$.k')::INT AS cluster_id, event_id AS report_id, user_id AS publisher, user_id % 12 AS family,
        ts AS published_at, {_ROLE_SQL} AS role, floor(value)::BIGINT AS figure FROM events""",
    "v_claims": """SELECT l_orderkey % 200 AS event_id, l_returnflag || l_linestatus AS kind, l_quantity AS value, l_suppkey AS publisher,
        s_nationkey AS family, l_shipdate AS seen_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "v_records": "SELECT item_id AS record_id, text FROM benchmark",
    "v_speech": "SELECT conv_id AS thread_id, turn, role, text FROM conversations",
}


def sql(views: str, body: str) -> str:
    """``body`` (its own WITH clauses start with a comma) over the named views."""
    return "WITH " + ", ".join(f"{name} AS ({SQL[name]})" for name in views.split()) + " " + body
