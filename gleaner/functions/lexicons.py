"""Lexicons as data, and scoring against them.

The driver's texts are invented, so queries use frequent invented words; a
deployment passes its own rows. Columns: lexicon, term, kind, weight, ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "category string, term string, kind string, weight int, ord int"
# Fixed values for the invented texts: category, term, kind (keyword or strong), points, list order.
CATEGORY_ROWS = (
    ("crisis", "thnt", "strong", 5, 0), ("crisis", "heat", "keyword", 2, 0), ("crisis", "erth", "keyword", 2, 0),
    ("politics", "that", "keyword", 1, 1), ("politics", "onth", "strong", 5, 1), ("politics", "schen", "keyword", 2, 1),
    ("finance", "eren", "keyword", 2, 2), ("finance", "ciónar", "strong", 4, 2), ("finance", "est", "keyword", 1, 2),
    ("sports", "with", "keyword", 1, 3), ("sports", "und", "keyword", 1, 3), ("sports", "que", "keyword", 1, 3),
)
CRISIS_ROWS = (("flood", "thnt", "any", 30, 0), ("flood", "eret", "any", 30, 0), ("cyclone", "ingth", "any", 34, 1), ("heatwave", "heat", "any", 24, 2), ("earthquake", "erth", "any", 36, 3))


def lexicon(spark: SparkSession, rows: tuple) -> DataFrame:
    """A small table, broadcast: its size is that of the packaged rows."""
    return F.broadcast(spark.createDataFrame(list(rows), SCHEMA))


def token_hits(docs: DataFrame, words: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, category, kind, weight, ord, hits): how often each kind of term occurs."""
    exploded = docs.select(key, F.explode(tokens).alias("term"))
    return exploded.join(words, "term").groupBy(key, "category", "kind", "weight", "ord").agg(F.count("*").alias("hits"), F.count_distinct("term").alias("terms"))
