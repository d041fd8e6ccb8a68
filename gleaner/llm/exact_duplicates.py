"""Exact deduplication by progressive refinement [native].

Rows are grouped by length, then by the hash of a prefix, then by the full hash.
Each round keeps only the groups that still have several rows, and only the last
one reads whole texts: a text that is alone at its length and prefix is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import Workspace, join_checked

#: A broadcast of so many (length, prefix hash) pairs stays under 4 MB.
MOST_BROADCAST_KEYS = 100_000


def one_spaced(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 96,
    hash_all: bool = False,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_hash.

    Texts are equal when identical after :func:`one_spaced`; a null text equals
    an empty one. Of equal texts the smallest id stays. ``text_hash`` (32 bytes,
    SHA-256) is null for rows that an earlier round proved unique, unless
    ``hash_all``. Other columns of ``docs`` are ignored; an empty table gives an
    empty result; rows that repeat an id count in ``group_size``.
    """
    space = Workspace(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).alias("id"), one_spaced(F.col(text_col)).alias("body"))
    rows = rows.select(
        "id",
        "body",
        F.length("body").alias("size"),
        F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix"),
    )
    keys = space.keep(rows.select("size", "prefix"), "keys")
    sizes = space.keep(keys.groupBy("size").count().where("count > 1").select("size"), "sizes")
    shared = join_checked(keys, sizes, "size", "left_semi", MOST_BROADCAST_KEYS)
    prefixes = shared.groupBy("size", "prefix").count().where("count > 1")
    prefixes = space.keep(prefixes.select("size", "prefix", F.lit(True).alias("open")), "prefixes")

    marked = join_checked(rows, prefixes, ["size", "prefix"], "left", MOST_BROADCAST_KEYS)
    is_open = F.coalesce("open", F.lit(False))
    digest = F.unhex(F.sha2("body", 256))
    marked = marked.select("id", is_open.alias("open"), (digest if hash_all else F.when(is_open, digest)).alias("text_hash"))
    marked = space.keep(marked, "marked")

    groups = marked.where("open").groupBy("text_hash").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = space.keep(groups, "groups")
    space.drop("keys", "sizes", "prefixes")
    several = marked.where("open").join(groups, "text_hash").select("id", "keep_id", "group_size", "text_hash")
    alone = marked.where("not open").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_hash")
    return several.unionByName(alone).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_hash",
    )
