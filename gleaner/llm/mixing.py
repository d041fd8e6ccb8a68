"""Mixing sources to target weights by hash-threshold histograms [native].

Every document has a fixed hash. A source takes whole passes over its documents
and, for the rest of its target, the documents below a hash threshold. The
threshold comes from histograms: tokens are summed by source and hash bucket,
the bucket where the running sum crosses the budget is split into finer buckets,
and so on down to one hash value. Nothing is sorted, and each refinement reads
only its sources' boundary buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.storage import Workspace, join_checked

HASH_BITS = 60
BUCKET_BITS = 12
#: Sources have one row each in the joined tables; beyond this they are shuffled.
MOST_BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Words are runs of other characters than ASCII white space; null has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    spaced = F.trim(spaced)
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "))) + 1).cast("long")


def mixing_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the id's digits."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most_passes: int, share: float) -> DataFrame:
    """Targets from (source, source_size): weight by code-point order, null last.

    A source stops at ``most_passes`` times its size and its excess goes to the
    others by weight. That is a water level: sources ordered by capacity per
    weight fill up until the level passes no more of them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    named = named.withColumn("cap", F.col("source_size").cast("double") * most_passes)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = named.withColumn("level", level)
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    final = F.max(fits).over(whole)  # the first row that fits has the highest level of those; none fits: all stop at their cap
    return leveled.withColumn("final", final).select(
        "source",
        "source_size",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"),
    )


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **plan) -> DataFrame:
    """One row per document: id, size, source_size, target, passes, taken.

    ``passes`` is how often the mix takes the document (0 to ``most_passes``) and
    ``taken`` the words that makes. A source's taken words differ from its target
    by at most one document's size: at the boundary the nearer side is chosen.
    Null sources form one source, last in order; empty texts have size 0; rows
    with the same id (or none) have the same hash and are taken together. The
    result depends only on ids, sizes and sources, so reruns agree. ``plan`` are
    the parameters of :func:`source_limits`; other columns are not read.
    """
    space = Workspace(docs.sparkSession, "mixing")
    rows = space.keep(sized(docs, id_col, text_col, source_col), "rows")
    mixed = with_passes(rows, source_limits(rows, space, **plan))
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"))


def repeat_by_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **plan) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix_sources` takes it.

    A row's passes follow from its hash and its source's limits, so texts are
    read again for the result but never shuffled. All columns stay.
    """
    space = Workspace(docs.sparkSession, "mixing")
    sources = source_limits(space.keep(sized(docs, id_col, text_col, source_col), "rows"), space, **plan)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col(source_col).alias("source"), mixing_hash(F.col(id_col)).alias("hash"))
    repeated = with_passes(rows, sources).where("passes > 0").select("row", F.explode(F.sequence(F.lit(1), "passes")).alias("pass"))
    return repeated.select(*[F.col("row")[n].alias(n) for n in names])


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        mixing_hash(F.col(id_col)).alias("hash"),
    )


def source_limits(rows: DataFrame, space: Workspace, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_passes: int = 3, share: float = 1.0) -> DataFrame:
    """For each source of the written table ``rows`` its size and target, its whole
    passes, what they leave of the target (budget) and the hash below which a
    document gets one pass more (limit; null: no document exceeds the budget)."""
    shift = HASH_BITS - BUCKET_BITS
    cells = rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    cells = space.keep(cells, "cells0")
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = source_targets(sizes, weights, most_passes, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("whole", F.least(whole, F.lit(most_passes)))
    sources = sources.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = space.keep(sources, "sources")

    # edge: the hash prefix of the bucket in which a source's running sum crosses its budget
    edges, level = sources.select("source", "budget", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("below")), 0
    while True:
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        crossing = (
            join_same_source(cells, edges, MOST_BROADCAST_SOURCES)
            .withColumn("through", F.col("below") + F.sum("words").over(running))
            .where(F.col("through") > F.col("budget"))
            .groupBy("source", "budget")
            .agg(F.min(F.struct("bucket", (F.col("through") - F.col("words")).alias("below"), "through")).alias("at"))
            .select("source", "budget", F.col("at.bucket").alias("edge"), F.col("at.below").alias("below"), F.col("at.through").alias("through"))
        )
        crossing = space.keep(crossing, f"edges{level + 1}")
        edges, level, shift = crossing.select("source", "budget", "edge", "below"), level + 1, shift - BUCKET_BITS
        if shift < 0:
            break
        inside = join_same_source(rows, edges, MOST_BROADCAST_SOURCES).where(F.shiftright("hash", shift + BUCKET_BITS) == F.col("edge"))
        cells = space.keep(inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words")), f"cells{level}")

    # the boundary document itself: on whichever side leaves the source nearer its budget
    nearer = F.col("through") - F.col("budget") < F.col("budget") - F.col("below")
    limits = crossing.select("source", (F.col("edge") + nearer.cast("long")).alias("limit"))
    sources = sources.alias("s").join(limits.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left").select("s.*", "l.limit")
    return space.keep(sources.withColumn("most_passes", F.lit(most_passes)), "limits")


def with_passes(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (source, hash, ...) with the columns of their source and ``passes``."""
    mixed = join_same_source(rows, sources, MOST_BROADCAST_SOURCES)
    extra = (F.col("budget") > 0) & (F.col("limit").isNull() | (F.col("hash") < F.col("limit")))
    return mixed.withColumn("passes", F.least(F.col("whole") + extra.cast("int"), F.col("most_passes")))


def join_same_source(rows: DataFrame, sources: DataFrame, most_rows: int) -> DataFrame:
    """Join on source, null with null, keeping one source column."""
    right = sources.withColumnRenamed("source", "same_source")
    return join_checked(rows, right, rows["source"].eqNullSafe(right["same_source"]), "inner", most_rows).drop("same_source")
