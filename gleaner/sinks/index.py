"""Served search index: postings by term in shards of bounded size, with a manifest.

Texts become (term, id, count) rows; terms in order are cut into shards of about
equal bytes, which lie in order in folders of neighbouring shards, and the manifest has
each shard's first and last term. A query reads only folders whose shards its terms lie
in, and by Parquet's own bounds only pages that can have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import words

#: Bytes of postings in a shard, about.
SHARD_BYTES = 8 << 20
#: What a posting takes besides its term.
POSTING_BYTES = 12
#: Neighbouring shards that share a folder.
SHARDS_OF_FOLDER = 64


def write_index(rows: DataFrame, folder: str, *, id_col: str, text_cols: list[str], shard_bytes: int = SHARD_BYTES) -> int:
    """Write postings of the words of ``text_cols`` and return the number of shards.

    Words are lower-case runs of letters and digits from two characters on. Null and
    empty texts have none; repeated ids count together. A term with more postings
    than a shard holds goes on in files of the same shard, split by id, so no task
    gets a whole term.
    """
    spark = rows.sparkSession
    found = rows.select(F.col(id_col).alias("id"), F.explode(words(F.concat_ws(" ", *text_cols))).alias("term")).where(F.length("term") >= 2)
    postings = found.groupBy("term", "id").agg(F.count("*").alias("n"))
    postings.write.mode("overwrite").parquet(f"{folder}/raw")
    postings = spark.read.schema(postings.schema).parquet(f"{folder}/raw")
    terms = postings.groupBy("term").agg(F.sum(F.octet_length("term") + POSTING_BYTES).alias("bytes"))
    terms.write.mode("overwrite").parquet(f"{folder}/weights")
    terms = spark.read.schema(terms.schema).parquet(f"{folder}/weights")
    total = terms.agg(F.sum("bytes")).first()[0] or 0
    placed = postings.join(shards_of(terms, max(1, -(-total // shard_bytes)), folder), "term").select("term", "id", "n", "shard")
    spread = placed.withColumn("part", F.floor(F.col("shard") / SHARDS_OF_FOLDER).cast("int")).repartitionByRange("shard", "term", "id").sortWithinPartitions("shard", "term", "id")
    spread.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
    written = spark.read.schema(spread.schema).parquet(f"{folder}/postings")
    listed = written.groupBy("shard").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("postings"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return max(1, spark.read.schema(listed.schema).parquet(f"{folder}/manifest").count())


def shards_of(terms: DataFrame, count: int, folder: str) -> DataFrame:
    """(term, shard): ``count`` shards of about equal bytes in order of terms (fewer if a
    term fills several).

    Terms are written in sorted ranges, whose sums come first, so no task gets them all
    and nothing of them goes through the driver.
    """
    ranged = terms.repartitionByRange("term").withColumn("part", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(f"{folder}/terms")
    ranged = terms.sparkSession.read.schema(ranged.schema).parquet(f"{folder}/terms")
    sums = ranged.groupBy("part").agg(F.sum("bytes").alias("b"))
    before = sums.select("part", (F.sum("b").over(Window.orderBy("part")) - F.col("b")).alias("base"), F.sum("b").over(Window.partitionBy()).alias("total"))
    running = ranged.withColumn("own", F.sum("bytes").over(Window.partitionBy("part").orderBy("term"))).join(F.broadcast(before), "part")
    return running.select("term", F.floor((F.col("base") + F.col("own") - 1) * F.lit(count) / F.col("total")).cast("int").alias("shard"))


def search_index(spark: SparkSession, folder: str, query: str, k: int = 40) -> DataFrame:
    """(id, hits) of the ``k`` rows that have all terms of the query, most occurrences
    first, then the least id. Terms under two characters are ignored; a query without
    terms finds nothing. Only shards that can hold a term are read."""
    terms = sorted({t for t in query.lower().split() if len(t) >= 2})
    listed = spark.read.schema("shard int, first string, last string, postings long").parquet(f"{folder}/manifest").collect()
    if not listed:  # an index of no texts
        return spark.createDataFrame([], "id string, hits long")
    shards = sorted({r.shard for r in listed for t in terms if r.first <= t <= r.last})
    found = spark.read.parquet(f"{folder}/postings").where(F.col("part").isin(sorted({s // SHARDS_OF_FOLDER for s in shards})) & F.col("shard").isin(shards) & F.col("term").isin(terms) if shards else F.lit(False))
    rows = found.groupBy("id").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("hits"))
    return rows.where(F.col("terms") == max(1, len(terms))).orderBy(F.desc("hits"), "id").limit(k).select("id", "hits")
