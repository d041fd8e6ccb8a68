"""As-of joins: for each row the latest one at or before it, by key.

No key's whole history is gathered: time is cut into slices of about equal row
counts, each slice of a key is searched by itself, and of every slice only its
last right row is carried to later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, order: str, *, within_seconds: int | None = None, slices: int = 64, strict: bool = False) -> DataFrame:
    """``left`` with ``match``, a struct of the right row: that with the greatest
    (time, order) of the same keys at or before the left row's time, or before it
    with ``strict``; null if there is none or it lies more than ``within_seconds``
    back.

    Null keys match one another. Left rows without a time have no match, right rows
    without one are no match. Repeated left rows each get theirs; of right rows equal
    in time and order any one is taken. Tables may be empty.
    """
    micros = lambda: F.unix_micros(F.col(time).cast("timestamp"))
    payload, kept = F.struct(*right.columns), F.struct(*left.columns)
    side = 1 - int(strict)  # at equal times right rows come first, unless they must be earlier
    a = left.select(*keys, micros().alias("_at"), F.lit(side).alias("_side"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_right"), kept.alias("_left"), F.lit(None).cast(dict(right.dtypes)[order]).alias("_order"))
    b = right.where(F.col(time).isNotNull()).select(*keys, micros().alias("_at"), F.lit(1 - side).alias("_side"), payload.alias("_right"), F.lit(None).cast(left.select(kept.alias("x")).schema["x"].dataType).alias("_left"), F.col(order).alias("_order"))
    rows = a.unionByName(b)
    marks = sorted(set(rows.approxQuantile("_at", [(k + 1) / slices for k in range(slices - 1)], 0.005))) if slices > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(int(m)) for m in marks]), lambda m: m < F.col("_at"))) if marks else F.lit(0)
    rows = rows.withColumn("_slice", place)

    last = rows.where("_right is not null").groupBy(*keys, "_slice").agg(F.max_by("_right", F.struct("_at", "_order")).alias("_last"), F.max("_at").alias("_when"))
    asked = rows.where("_left is not null").select(*keys, "_slice").distinct()
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*keys, "_slice")]
    both = asked.alias("x").join(last.alias("y"), same, "full").select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in (*keys, "_slice")], "_last", "_when")
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(*keys, "_slice", F.last(F.when(F.col("_last").isNotNull(), F.struct("_last", "_when")), ignorenulls=True).over(earlier).alias("_carried"))

    near = Window.partitionBy(*keys, "_slice").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("_right").isNotNull(), F.struct(F.col("_right").alias("_last"), F.col("_at").alias("_when"))), ignorenulls=True).over(near)
    found = rows.withColumn("_seen", seen).where("_left is not null").alias("x").join(carried.alias("y"), same, "left").select("x._left", "x._at", F.coalesce("x._seen", "y._carried").alias("_found"))
    fits = F.col("_at").isNotNull() & F.col("_found").isNotNull()
    if within_seconds is not None:
        fits = fits & (F.col("_at") - F.col("_found._when") <= within_seconds * 1_000_000)
    return found.select("_left.*", F.when(fits, F.col("_found._last")).alias("match"))
