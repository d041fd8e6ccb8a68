"""Candidate pairs: band joins, blocking and token joins, never cross joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of the cells in which :func:`peers_in_band` counts, in microseconds.
CELL_MICROS = 3_600_000_000


def time_band_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, seconds: int, *, strict: bool = False, how: str = "left") -> DataFrame:
    """Rows with equal keys (null equals null) at most ``seconds`` apart.

    Each right row goes into its time bucket and the two beside it, so the join
    is an equi-join; the exact band is a residual condition. Sides are ``a`` and
    ``b``; with ``strict`` the bound itself is outside.
    """
    micros = seconds * 1_000_000

    def at(side: str) -> Column:
        return F.unix_micros(F.col(f"{side}.{time}").cast("timestamp"))

    a = left.withColumn("_bucket", F.floor(F.unix_micros(F.col(time).cast("timestamp")) / micros)).alias("a")
    b = right.withColumn("_own", F.floor(F.unix_micros(F.col(time).cast("timestamp")) / micros))
    b = b.withColumn("_bucket", F.explode(F.sequence(F.col("_own") - 1, F.col("_own") + 1))).alias("b")
    gap = F.abs(at("a") - at("b"))
    on = (F.col("a._bucket") == F.col("b._bucket")) & ((gap < micros) if strict else (gap <= micros))
    for key in keys:
        on = on & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return a.join(b, on, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys where null equals null; the keys are the left side's."""
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return left.alias("l").join(right.alias("r"), on, how).select("l.*", *[f"r.{c}" for c in right.columns if c not in keys])


def peers_in_band(rows: DataFrame, keys: list[str], who: str, time: str, seconds: int, flag: Column) -> DataFrame:
    """``rows`` with ``peers``, how many other values of ``who`` have a row of equal keys
    (null equals null) less than ``seconds`` away, and ``flagged``, whether one of those
    has such a row where ``flag`` holds. Without time or ``who`` a row has no peers and
    is none.

    No pairs are made. Time is cut into slices as long as the band; all rows that one
    ``who`` has in a slice reach one unbroken interval, so its first and last time say
    all. Intervals of neighbouring slices are merged where they meet, and a time's
    number of ``who`` is that of intervals open then: a running sum over their ends,
    within cells of time upon the sum of the cells before.
    """
    width = seconds * 1_000_000
    marked = rows.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("_slice", F.floor(F.col("_at") / width))
    usable = marked.where(F.col("_at").isNotNull() & F.col(who).isNotNull())
    when_flag = F.when(flag, F.col("_at"))
    slices = usable.groupBy(*keys, who, "_slice").agg(
        F.min("_at").alias("first"), F.max("_at").alias("last"), F.min(when_flag).alias("flag_first"), F.max(when_flag).alias("flag_last")
    )
    own = Window.partitionBy(*keys, who).orderBy("_slice")

    def ends(first: str, last: str, step: Column) -> DataFrame:
        spans = slices.where(F.col(first).isNotNull())
        opens = F.coalesce(F.col(first) - F.lag(last).over(own) >= 2 * width, F.lit(True))
        closes = F.coalesce(F.lead(first).over(own) - F.col(last) >= 2 * width, F.lit(True))
        spans = spans.select(*keys, (F.col(first) - width + 1).alias("from"), (F.col(last) + width).alias("to"), opens.alias("opens"), closes.alias("closes"))
        both = F.array(F.when(F.col("opens"), F.struct(F.col("from").alias("at"), F.lit(1).alias("d"))), F.when(F.col("closes"), F.struct(F.col("to").alias("at"), F.lit(-1).alias("d"))))
        return spans.select(*keys, F.explode(both).alias("e")).where("e is not null").select(*keys, F.col("e.at").alias("_at"), (F.col("e.d") * step).alias("n"), (F.col("e.d") * (1 - step)).alias("f"))

    zero = F.lit(0)
    changes = ends("first", "last", F.lit(1)).unionByName(ends("flag_first", "flag_last", zero)).unionByName(usable.select(*keys, "_at", zero.alias("n"), zero.alias("f")))
    points = changes.groupBy(*keys, "_at").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).withColumn("_cell", F.floor(F.col("_at") / CELL_MICROS))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = points.groupBy(*keys, "_cell").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    cells = cells.select(*keys, "_cell", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "f")])
    within = Window.partitionBy(*keys, "_cell").orderBy("_at")
    counted = points.select(*keys, "_cell", "_at", F.sum("n").over(within).alias("n"), F.sum("f").over(within).alias("f"))
    counted = null_safe_join(counted, cells, [*keys, "_cell"]).select(*keys, "_at", (F.col("n") + F.col("n_before")).alias("_n"), (F.col("f") + F.col("f_before")).alias("_f"))

    def beside(value: str, step: int) -> Column:
        return F.when(F.lag("_slice", step).over(own) == F.col("_slice") - step, F.lag(value, step).over(own))

    mine = slices.select(*keys, who, "_slice", F.col("flag_first").isNotNull().alias("_here"), beside("flag_last", 1).alias("_left"), beside("flag_first", -1).alias("_right"))
    found = null_safe_join(null_safe_join(marked, counted, [*keys, "_at"]), mine, [*keys, who, "_slice"])
    itself = F.coalesce(F.col("_here") | F.coalesce(F.col("_at") - F.col("_left") < width, F.lit(False)) | F.coalesce(F.col("_right") - F.col("_at") < width, F.lit(False)), F.lit(False))
    known = F.col("_at").isNotNull() & F.col(who).isNotNull()
    return found.select(
        *rows.columns, F.when(known, F.col("_n") - 1).otherwise(0).cast("long").alias("peers"), F.coalesce(known & (F.col("_f") - itself.cast("int") > 0), F.lit(False)).alias("flagged")
    )


def capped_blocks(keys: DataFrame, key: str | list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each blocking key: a feature of blocking, which
    trades recall on frequent keys for bounded work."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return keys.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def blocked_pairs(keys: DataFrame, key: str, row: str) -> DataFrame:
    """Distinct pairs (a < b) of rows that share a key."""
    left = keys.select(F.col(key).alias("_k"), F.col(row).alias("a"))
    right = keys.select(F.col(key).alias("_k"), F.col(row).alias("b"))
    return left.join(right, "_k").where("a < b").select("a", "b").distinct()


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty or null."""
    shared = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - shared
    return F.when((F.size(x) > 0) & (F.size(y) > 0), shared / union).otherwise(0.0)


def overlap_fraction(x: Column, y: Column) -> Column:
    """Shared values over the smaller set; 0 if either is empty or null."""
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), shared / F.least(F.size(x), F.size(y))).otherwise(0.0)


def dot(x: Column, y: Column) -> Column:
    """Dot product of two arrays of doubles."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
