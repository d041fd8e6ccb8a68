"""Source divergence audit: how a source's words differ from its language's.

1. Tasks count words of whole texts by language and source, within bounded memory;
   sums give occurrences of every (language, source, term) and documents of every
   (language, term). Terms of enough documents are kept.
2. Smoothed shares are whole numbers of billionths, in exact arithmetic.
3. Two sources' distance runs over all kept terms, but most terms are missing from
   most sources and have their baseline share there. So a pair's sum is that of the
   two baselines over all terms, corrected by the terms that one source has (from a
   histogram of its shares) and by those that both have (sparse rows).
4. A group's top terms are found without sorting it: histograms over the bits of
   the values, from the highest, find the group's k-th value; of the terms that tie
   there the first by UTF-8 bytes are found by histograms over their bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.storage import Workspace, join_checked

SCALE = 1_000_000_000
#: Terms that a task counts before it hands its sums on.
MOST_TERMS = 200_000
#: Bytes of a text whose words are listed at once.
SLICE = 1 << 20
#: Bits of a value that one histogram tells apart.
BITS = 10
#: Tied terms of a group that are ranked by a sort; more are halved by histograms first.
MOST_TIED = 20_000
#: Rows of a table that is broadcast at most.
MOST_BROADCAST_ROWS = 100_000

GROUP = ("lang", "source")
#: Every byte that is no part of a term is a space, A-Z are a-z.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count, docs of the task's documents, in parts."""
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def part() -> pa.RecordBatch:
        rows = [(lang, source, term.decode(), n, docs[term]) for (lang, source), (counts, docs) in sums.items() for term, n in counts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "count", "docs"])

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            counts, docs = sums.setdefault((lang, source), (Counter(), Counter()))
            before = len(counts)
            own: Counter = Counter()
            spaced, at = text.as_py().translate(_TERMS), 0
            while at < len(spaced):
                end = spaced.find(b" ", at + SLICE)
                end = len(spaced) if end < 0 else end
                own.update(spaced[at:end].split())
                at = end
            counts.update(own)
            docs.update(own.keys())
            held += len(counts) - before
            if held >= MOST_TERMS:
                yield part()
                sums, held = {}, 0
    if held:
        yield part()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exact at any size."""
    above = (count + 5).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + 5 * terms).cast("decimal(19,0)")
    return F.call_function("div", above, below) + 1


def pair_values(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, source, item, q, value for each two sources of a language, both ways.

    ``kept`` has lang, source, term, p (terms that a source has); ``sources`` has
    lang, source, base (the share of a term that it hasn't), n (terms it has) and
    terms (all of the language).
    """
    one = sources.select("lang", "source", "base", "n", "terms")
    other = sources.select("lang", F.col("source").alias("item"), F.col("base").alias("q_base"), F.col("n").alias("q_n"))
    both = one.join(other, "lang").where("source <> item")
    gap = F.abs(F.col("base") - F.col("q_base"))

    # terms of a source against the other's baseline, from a histogram of its shares
    shares = kept.groupBy(*GROUP, "p").agg(F.count("*").alias("m"))
    against = shares.join(other.select("lang", "item", "q_base"), "lang").where("source <> item")
    against = against.groupBy(*GROUP, "item").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("q_base"))).alias("above"))
    back = against.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("above").alias("below"))

    # terms that both have
    based = kept.join(F.broadcast(one.select(*GROUP, "base")) if one.count() <= MOST_BROADCAST_ROWS else one.select(*GROUP, "base"), list(GROUP))
    mate = based.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("base").alias("q_base"))
    shared = based.join(mate, ["lang", "term"]).where("source < item")
    correction = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("q_base")) - F.abs(F.col("q") - F.col("base")) + gap
    shared = shared.groupBy(*GROUP, "item").agg(F.sum(correction).alias("fix"))
    shared = shared.unionByName(shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "fix"))

    on = [*GROUP, "item"]
    found = both.join(against, on, "left").join(back, on, "left").join(shared, on, "left").na.fill(0, ["above", "below", "fix"])
    value = F.col("terms") * gap + (F.col("above") - F.col("n") * gap) + (F.col("below") - F.col("q_n") * gap) + F.col("fix")
    return found.select(*GROUP, "item", value.alias("value"))


def kth_values(values: DataFrame, k: int, top_bit: int, space: Workspace) -> DataFrame:
    """lang, source, least, above: each group's k-th highest value (0 for a group of
    fewer rows) and how many rows lie above it."""
    at = space.keep(values.groupBy(*GROUP).agg(F.count("*").alias("rows")).select(*GROUP, F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("above"), (F.col("rows") < k).alias("few")), "bits0")
    done = at.where("few").drop("few")
    low = top_bit
    while low > 0:
        high, low = low, max(0, low - BITS)
        inside = join_checked(values, at.where("not few").select(*GROUP, "least", "above"), list(GROUP), "inner", MOST_BROADCAST_ROWS)
        inside = inside.where(F.shiftright("value", high) == F.shiftright("least", high))
        bins = inside.groupBy(*GROUP, F.shiftright("value", low).alias("bin")).agg(F.count("*").alias("m"), F.first("above").alias("above"))
        down = Window.partitionBy(*GROUP).orderBy(F.desc("bin"))
        bins = bins.withColumn("through", F.col("above") + F.sum("m").over(down))
        cut = bins.where(F.col("through") >= k).groupBy(*GROUP).agg(F.max_by(F.struct("bin", (F.col("through") - F.col("m")).alias("before")), "bin").alias("cut"))
        cut = cut.select(*GROUP, F.shiftleft("cut.bin", low).alias("least"), F.col("cut.before").alias("above"), F.lit(False).alias("few"))
        at = space.keep(cut, f"bits{high}")
    return at.drop("few").unionByName(done)


def shared_bytes(first: pd.Series, last: pd.Series) -> pd.Series:
    """Bytes with which both begin."""
    return pd.Series([len(commonprefix([bytes(a), bytes(b)])) for a, b in zip(first, last, strict=True)], dtype="int32")


def first_terms(tied: DataFrame, space: Workspace) -> DataFrame:
    """Of each group's ``tied`` rows the ``wanted`` first by the bytes of their terms.

    Groups of more than MOST_TIED rows are narrowed by histograms over the two bytes
    behind what all of them begin with; whole bins before the boundary are taken,
    and the bin on it goes on.
    """
    taken, step = None, 0
    tied = space.keep(tied.withColumn("raw", F.col("term").cast("binary")), "tied0")
    while True:
        sizes = space.keep(tied.groupBy(*GROUP).agg(F.count("*").alias("rows"), F.min("raw").alias("low"), F.max("raw").alias("high"), F.first("wanted").alias("want")), f"sizes{step}")
        large = sizes.where((F.col("rows") > MOST_TIED) & (F.col("rows") > F.col("want")))
        same = F.pandas_udf(shared_bytes, "int")("low", "high")
        large = space.keep(large.select(*GROUP, same.alias("same")), f"large{step}")
        small = join_checked(tied, large, list(GROUP), "left_anti", MOST_BROADCAST_ROWS)
        order = Window.partitionBy(*GROUP).orderBy("raw")
        ready = small.withColumn("place", F.row_number().over(order)).where("place <= wanted").drop("place")
        taken = ready if taken is None else taken.unionByName(ready)
        if not large.limit(1).count():
            return taken.drop("raw", "wanted")
        rows = join_checked(tied, large, list(GROUP), "inner", MOST_BROADCAST_ROWS).withColumn("bin", F.expr("substring(raw, same + 1, 2)")).drop("same")
        bins = rows.groupBy(*GROUP, "bin").agg(F.count("*").alias("m"), F.first("wanted").alias("want"))
        bins = bins.withColumn("through", F.sum("m").over(Window.partitionBy(*GROUP).orderBy("bin")))
        bins = bins.withColumn("before", F.col("through") - F.col("m")).where("before < want")
        bins = space.keep(bins.select(*GROUP, "bin", (F.col("want") - F.col("before")).alias("left"), (F.col("through") <= F.col("want")).alias("all")), f"bins{step}")
        near = join_checked(rows, bins, [*GROUP, "bin"], "inner", MOST_BROADCAST_ROWS).drop("bin")
        taken = taken.unionByName(near.where("all").drop("all", "left"))
        step += 1
        tied = space.keep(near.where("not all").withColumn("wanted", F.col("left")).drop("all", "left"), f"tied{step}")


def top_terms(values: DataFrame, k: int, space: Workspace) -> DataFrame:
    """The ``k`` first rows of each (lang, source), value descending, then term by
    UTF-8 bytes; rows have lang, source, term, value (at least 0, under 2**31)."""
    cut = space.keep(kth_values(values, k, 31, space), "cut")
    near = join_checked(values, cut, list(GROUP), "inner", MOST_BROADCAST_ROWS).where("value >= least")
    near = space.keep(near, "near")
    tied = near.where("value = least").withColumn("wanted", k - F.col("above")).drop("least", "above")
    return near.where("value > least").drop("least", "above").unionByName(first_terms(tied, space))


def divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how sources differ within a language.

    Part 'pair' ranks the other sources of a source's language by the sum of
    absolute differences of smoothed shares over the language's kept terms, part
    'term' the ``top`` terms that a source uses more than its language. Null texts,
    languages and sources are read as empty ones, which are values like others; a
    source without terms has its pairs; a language with one source has none; equal
    values rank by the item's UTF-8 bytes. Repeated rows count each; other columns
    are ignored; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "divergence")
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, count long, docs long")
    counts = space.keep(counted.groupBy(*GROUP, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    vocabulary = space.keep(vocabulary.select("lang", "term", "all"), "vocabulary")
    kept = space.keep(join_checked(counts.drop("docs"), vocabulary, ["lang", "term"], "inner", MOST_BROADCAST_ROWS), "kept")

    groups = space.keep(rows.select(*GROUP).distinct(), "groups")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("whole"))
    sums = kept.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum("count").alias("total"))
    sources = groups.join(sums, list(GROUP), "left").join(langs, "lang", "left").na.fill(0, ["n", "total", "terms", "whole"])
    none = F.lit(0).cast("long")
    base = F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms"))).otherwise(none)
    sources = space.keep(sources.withColumn("base", base), "sources")
    shares = join_checked(kept, sources.select(*GROUP, "total", "terms", "whole"), list(GROUP), "inner", MOST_BROADCAST_ROWS)
    p, q = share(F.col("count"), F.col("total"), F.col("terms")), share(F.col("all"), F.col("whole"), F.col("terms"))
    shares = space.keep(shares.select(*GROUP, "term", p.alias("p"), q.alias("q")), "shares")

    pairs = pair_values(shares.select(*GROUP, "term", "p"), sources).withColumn("part", F.lit("pair"))
    above = space.keep(shares.where("p > q").select(*GROUP, "term", (F.col("p") - F.col("q")).alias("value")), "above")
    terms = top_terms(above, top, space).withColumnRenamed("term", "item").withColumn("part", F.lit("term"))
    order = Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item")
    return pairs.unionByName(terms).select(*GROUP, "part", "item", "value", F.row_number().over(order).alias("rank"))
