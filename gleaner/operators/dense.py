"""Pairs of vectors with exact cosines: all of a block, or candidates by random hyperplanes.

A vector's side of a hyperplane is a bit; two vectors agree in a bit with
probability 1 - angle / pi. Bits make bands, and vectors of one block that agree
in all bits of a band are compared. The number of bands follows from the least
cosine and the chosen miss probability.

Vectors of one group are compared where they lie, as matrices, so only pairs that
are close leave a task. A group beyond TILE rows is cut into tiles, and each pair of
tiles is a group of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.storage import Workspace, join_checked

#: Rows of a tile, about, and of one side of a matrix product.
TILE, STRIP = 4096, 256
#: Groups of several tiles that are broadcast at most.
MOST_BROADCAST_ROWS = 100_000

def bands_for(least: float, bits: int, miss: float) -> int:
    """Bands of ``bits`` that miss a pair of cosine ``least`` with probability ``miss`` at most."""
    return ceil(log(miss) / log(1 - (1 - acos(least) / pi) ** bits))


def hyperplanes(count: int, dimensions: int) -> np.ndarray:
    """Normals of +1 and -1: the sign of (plane, dimension) is by the first bit of a hash."""
    bits = [hashlib.md5(f"{i}:{j}".encode()).digest()[0] < 128 for i in range(count) for j in range(dimensions)]
    return np.where(np.array(bits).reshape(count, dimensions), 1.0, -1.0)


def placed(batches: Iterator[pa.RecordBatch], bits: int, bands: int) -> Iterator[pa.RecordBatch]:
    """id, block, vector, its length and the numbers of its bands (as bytes, none without
    bands); rows without a direction go."""
    planes: dict[int, np.ndarray] = {}
    kind = np.uint8 if bits <= 8 else np.uint32
    for batch in batches:
        kept, numbers, sizes = [], [], []
        for i, x in enumerate(batch.column(2).to_pylist()):
            v = np.array([np.nan if e is None else e for e in x or []], dtype=np.float64)
            norm = np.sqrt((v * v).sum())
            if not (np.isfinite(norm) and norm > 0):
                continue
            if len(v) not in planes:
                planes[len(v)] = hyperplanes(bits * bands, len(v))
            sides = planes[len(v)] @ v >= 0 if bands else np.zeros(0, bool)
            numbers.append((sides.reshape(bands, bits) @ (1 << np.arange(bits))).astype(kind).tobytes())
            kept.append(i)
            sizes.append(len(v))
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(sizes, pa.int32()), pa.array(numbers, pa.binary())], names=["id", "block", "v", "n", "numbers"])


def close_within(batches: Iterator[pa.RecordBatch], least: float, bits: int) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine) of the groups, which come in order: rows are key, tile, band, id,
    v, numbers. A pair counts in the first band that it shares."""
    kind = np.uint8 if bits <= 8 else np.uint32

    def pairs(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        if table.num_rows < 2:
            return
        (lo, hi), band = (table["key"][0].as_py()[k] for k in ("lo", "hi")), table["band"][0].as_py()
        tile = table["tile"].to_numpy()
        ids = table["id"].combine_chunks()
        v = np.asarray(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(table.num_rows, -1)
        norm = np.sqrt((v * v).sum(axis=1))
        unit = v / norm[:, None]
        numbers = np.frombuffer(b"".join(table["numbers"].to_pylist()), dtype=kind).reshape(table.num_rows, -1)
        left, right = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        for begin in range(0, len(left), STRIP):
            some = left[begin : begin + STRIP]
            x, y = np.nonzero(unit[some] @ unit[right].T >= least - 1e-6)
            x, y = some[x], right[y]
            fits = x < y if lo == hi else x != y
            x, y = x[fits], y[fits]
            for at in range(0, len(x), 65536):
                p, q = x[at : at + 65536], y[at : at + 65536]
                cosine = np.einsum("ij,ij->i", v[p], v[q]) / (norm[p] * norm[q])
                fits = (cosine >= least) & ~(numbers[p, :band] == numbers[q, :band]).any(axis=1)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p[fits])), ids.take(pa.array(q[fits])), pa.array(cosine[fits])], names=["a", "b", "cosine"])

    def runs() -> Iterator[tuple[str, pa.RecordBatch]]:
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), dtype=object)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    yield str(keys[i]), batch.slice(i, j - i)

    for _, group in groupby(runs(), key=lambda run: run[0]):
        yield from pairs([rows for _, rows in group])


def cosine_pairs(vectors: DataFrame, *, id_col: str, vector_col: str, block_col: str, least: float = 0.45, bits: int = 8, miss: float | None = 0.1) -> DataFrame:
    """(a, b, cosine) of vectors of one block with a cosine of at least ``least``.

    A pair at the threshold is missed with probability ``miss`` at most, closer ones
    far less; with ``miss`` None all pairs of a block are compared and none is missed.
    What is returned is exact. Vectors that are null, empty, zero or not
    finite have no pairs, nor do those of different length; a null block is a block.
    Repeated ids give no pair with themselves. Copies share every band, so a block of
    copies gives all its pairs: that is the result asked for.
    """
    bands = 0 if miss is None else bands_for(least, bits, miss)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(block_col).alias("block"), F.col(vector_col).alias("v"))
    kinds = dict(rows.dtypes)
    space = Workspace(vectors.sparkSession, "vectors")
    found = space.keep(rows.mapInArrow(lambda batches: placed(batches, bits, bands), f"id {kinds['id']}, block {kinds['block']}, v {kinds['v']}, n int, numbers binary"), "placed")
    width = 1 if bits <= 8 else 4
    number = F.substring("numbers", F.col("band") * width + 1, F.lit(width)) if bands else F.lit(b"")
    keyed = found.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(max(1, bands) - 1)))).withColumn("number", number)
    group = ["block", "n", "band", "number"]
    large = space.keep(keyed.groupBy(*group).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1"), "large")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in group]
    tiled = join_checked(keyed.alias("x"), large.alias("y"), same, "left", MOST_BROADCAST_ROWS).select("x.*", F.coalesce("tiles", F.lit(1)).alias("tiles"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    key = F.struct(*group, F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    dealt = tiled.select(key.alias("key"), "tile", "band", "id", "v", "numbers").repartition("key").sortWithinPartitions("key")
    close = dealt.mapInArrow(lambda batches: close_within(batches, least, bits), f"a {kinds['id']}, b {kinds['id']}, cosine double")
    return close.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"))
