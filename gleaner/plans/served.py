"""What is served: gated versions, projections, the search index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog import register
from gleaner.functions import text as X
from gleaner.plans.claims import _GROUP_SQL, grouped
from gleaner.plans.text import words_sql
from gleaner.sinks import index as I
from gleaner.sinks import published as P
from gleaner.sources import views as V
from gleaner.storage import Workspace


def claim_gates() -> list[P.Gate]:
    """The release gates of a snapshot of claims."""
    status = F.col("status")
    return [
        P.Gate("corroborated claims of one group", F.count_if((status == "corroborated") & (F.col("groups") < 2)), most=0),
        P.Gate("attributed claims without attribution", F.count_if((status == "attributed") & ~F.col("attributed")), most=0),
        P.Gate("share of corroborated claims", P.share(status == "corroborated", status.isNotNull()), least=0.01),
        P.Gate("claims", F.count("*"), least=1),
    ]


@register("release_gates", "R2", V.sql("v_claims", f""", {_GROUP_SQL}, m AS (SELECT 0 AS k, 'corroborated claims of one group' AS gate, count(*) FILTER (WHERE status = 'corroborated' AND groups < 2)::DOUBLE AS metric FROM s
    UNION ALL SELECT 1, 'attributed claims without attribution', count(*) FILTER (WHERE status = 'attributed' AND NOT attributed) FROM s
    UNION ALL SELECT 2, 'share of corroborated claims', count(*) FILTER (WHERE status = 'corroborated')::DOUBLE / count(*) FROM s UNION ALL SELECT 3, 'claims', count(*) FROM s)
    SELECT gate, round(metric, 6) AS metric, CASE k WHEN 2 THEN metric >= 0.01 WHEN 3 THEN metric >= 1 ELSE metric <= 0 END AS holds, (SELECT count(*) FROM s) AS published FROM m"""))
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish the claims' snapshot behind its gates; the metrics, and the rows readers get."""
    folder = Workspace(spark, "release").path("claims")
    gates = claim_gates()
    passed, metrics = P.publish(grouped(spark, sf_dir), gates, folder)
    rows = [(g.name, round(metrics[g.name], 6), g.holds(metrics[g.name])) for g in gates]
    count = P.read_published(spark, folder).count() if passed else 0
    return spark.createDataFrame(rows, "gate string, metric double, holds boolean").withColumn("published", F.lit(count).cast("long"))


@register("index_search", "M1 A16", V.sql("v_articles", f""", w AS (SELECT article_id AS id, unnest({words_sql("lower(concat_ws(' ', title, excerpt, publisher, language))")}) AS term FROM v_articles)
    SELECT id, count(*) AS hits FROM w WHERE term IN ('the', 'en') GROUP BY id HAVING count(DISTINCT term) = 2 ORDER BY hits DESC, id LIMIT 40"""))
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of two terms answered from the written index of all articles."""
    folder = Workspace(spark, "index").path("articles")
    I.write_index(V.articles(spark, sf_dir), folder, id_col="article_id", text_cols=["title", "excerpt", "publisher", "language"], shard_bytes=1 << 16)
    return I.search_index(spark, folder, "The en x")


_TYPES = [("figure", r"[0-9]+\s*(per cent|%|crore|lakh)"), ("list", r"[,;].*[,;]"), ("question", r"\?"), ("long", r"^.{80,}"), ("plain", r"\w")]


@register("withheld_profile", "R11 N3", V.sql("v_articles", f""", t AS (SELECT publisher, CASE {" ".join(f"WHEN regexp_matches(title, '{pattern}') THEN '{name}'" for name, pattern in _TYPES)} ELSE 'other' END AS type FROM v_articles WHERE NOT official)
    SELECT type, publisher, count(*) AS withheld FROM t GROUP BY type, publisher"""))
def withheld_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that no official source backs, by type (first rule that fits) and publisher."""
    rows = V.articles(spark, sf_dir).where("not official")
    kind = X.first_match(F.col("title"), _TYPES, "other").alias("type")
    return rows.select("publisher", kind).groupBy("type", "publisher").agg(F.count("*").alias("withheld"))


@register("source_verdicts", "R8", V.sql("v_articles", """, p AS (SELECT publisher, count(*) AS items, count(*) FILTER (WHERE length(title) > 20) AS relevant, CASE WHEN max(family) = 3 THEN 403 WHEN max(family) = 5 THEN 500 ELSE 200 END AS probe FROM v_articles GROUP BY publisher)
    SELECT publisher, items, CASE WHEN probe = 403 THEN 'forbidden' WHEN probe <> 200 THEN 'unreachable' WHEN items < 2 THEN 'fewer than two items' WHEN relevant < 1 THEN 'no relevant sample' END AS reason, probe = 200 AND items >= 2 AND relevant >= 1 AS enabled FROM p"""))
def source_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers that stay enabled; the probe's answer stands in by family, for nothing is fetched."""
    rows = V.articles(spark, sf_dir).groupBy("publisher").agg(F.count("*").alias("items"), F.count_if(F.length("title") > 20).alias("relevant"), F.max("family").alias("family"))
    probe = F.when(F.col("family") == 3, 403).when(F.col("family") == 5, 500).otherwise(200)
    return P.verdicts(rows, probe, F.lit(True), F.col("items"), F.col("relevant")).select("publisher", "items", "reason", "enabled")
