"""Event identity of article pairs: relations, signals and the decision gate.

Signatures have places (the struct of :func:`gleaner.operators.gazetteer.places_of`,
null for none), sorted distinct arrays (entities, concepts, actions, tokens),
quantity, incident, hazard, reaction, developing, language, published_at. Pairs
carry two of them as structs ``a`` and ``b``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.gazetteer import concept_overlap, place_relation
from gleaner.operators.pairs import jaccard, overlap_fraction
from gleaner.sources.views import hours
from gleaner.storage import Workspace, join_checked

#: Rows of a tile, about; columns of a matrix product; a token is a column if one of so many pairs of rows shares it.
TILE, STRIP, OFTEN = 1024, 4096, 256
#: Buckets of several tiles that are broadcast at most.
MOST_BROADCAST_ROWS = 100_000


class Vocabulary(NamedTuple):
    """What relates actions and concepts to one another; the defaults are fixed values."""

    #: Actions that are not one another; a side that has both names no conflict.
    conflicts: tuple[tuple[str, str], ...] = (
        ("approve", "propose"), ("approve", "discuss"), ("announce", "discuss"), ("close", "reopen"), ("impose-order", "lift-order"), ("suspend", "resume"), ("welcome", "protest"),
    )
    #: Actions that go together.
    families: tuple[tuple[str, ...], ...] = (("die", "injure", "damage", "rescue"), ("warn", "impose-order", "evacuate", "close"))
    equivalent: tuple[tuple[str, str], ...] = (
        ("holiday", "closure"), ("warning", "alert"), ("heavy-rain", "rain"), ("release", "water"), ("flood", "rain"), ("evacuation", "rescue"), ("power-cut", "power"), ("sea", "coast"),
    )
    generic: tuple[str, ...] = (
        "government", "administration", "district", "weather", "centre", "police", "minister", "chief-minister", "water", "road", "order", "announcement",
    )


# Fixed values.
DEVELOPING = r"(?i)\b(toll|rises|climbs|mounts|updated|revised|latest|so far|now at|death toll|as many as)\b"
ACTION_SCORE = {"same": 1.0, "compatible": 0.6, "unknown": 0.3, "unrelated": 0.15, "conflicting": 0.0}


def action_relation(a: Column, b: Column, vocabulary: Vocabulary) -> Column:
    x, y = a["actions"], b["actions"]
    has = lambda side, value: F.array_contains(side, F.lit(value))
    conflict = F.lit(False)
    for p, q in vocabulary.conflicts:
        conflict = conflict | (has(x, p) & has(y, q) & ~has(y, p)) | (has(x, q) & has(y, p) & ~has(x, p))
    together = F.lit(False)
    for family in vocabulary.families:
        members = F.array(*[F.lit(v) for v in family])
        together = together | (F.arrays_overlap(x, members) & F.arrays_overlap(y, members))
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), "unknown")
        .when(conflict, "conflicting")
        .when(F.arrays_overlap(x, y), "same")
        .when(together, "compatible")
        .otherwise("unrelated")
    )


def scored(table: dict[str, float], value: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[value]


def pair_signals(pairs: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Adds the signals of each pair; empty sets score 0. Pairs that have a ``similarity``
    of their tokens already need no tokens."""
    a, b = F.col("a"), F.col("b")
    days = F.abs(hours(a["published_at"], b["published_at"])) / 24
    top = F.greatest(F.abs(a["quantity"]), F.abs(b["quantity"]))
    apart = F.abs(a["quantity"] - b["quantity"]) / F.greatest(top, F.lit(1e-9))
    shared, score = concept_overlap(a["concepts"], b["concepts"], vocabulary.equivalent, vocabulary.generic)
    return (
        pairs.withColumn("place", place_relation(a["places"], b["places"]))
        .withColumn("exact_place", F.coalesce(F.arrays_overlap(a["places"]["specific"], b["places"]["specific"]), F.lit(False)))
        .withColumn("action", action_relation(a, b, vocabulary))
        .withColumn("entity_score", overlap_fraction(a["entities"], b["entities"]))
        .withColumn("shared_concepts", shared)
        .withColumn("concept_score", score)
        .withColumn("lexical_score", F.col("similarity") if "similarity" in pairs.columns else jaccard(a["tokens"], b["tokens"]))
        .withColumn("days", days)
        .withColumn("temporal_score", F.when(days <= 1.25, 0.8).when(days <= 2.5, 0.5).otherwise(0.2))
        .withColumn("quantity_match", F.coalesce(apart <= 0.02, F.lit(False)))
        .withColumn("penalty", F.when(F.col("action") == "conflicting", 0.6).otherwise(0.0) + F.when((apart > 0.35) & (apart < 5) & (days < 1), 0.25).otherwise(0.0))
        .withColumn("action_score", scored(ACTION_SCORE, F.col("action")))
    )


def decide(signals: DataFrame) -> DataFrame:
    """Adds relation and confidence: an ordered gate, blockers first."""
    a, b, c = F.col("a"), F.col("b"), F.col
    unlike = lambda name: F.coalesce(a[name] != b[name], F.lit(False))
    developing = a["developing"] | b["developing"]
    blocked = c("place").isin("different", "sibling") | (c("action") == "conflicting") | unlike("incident") | unlike("hazard") | ((c("days") > 5) & ~developing)
    entity, same_loc, clean = c("entity_score") > 0, c("place") == "same", c("penalty") == 0
    ok, good, act = c("concept_score") >= 0.34, c("concept_score") >= 0.5, c("action") == "same"
    act_ok, lexical, shared, exact = c("action_score") >= 0.6, c("lexical_score"), c("shared_concepts"), c("exact_place")
    incident = F.coalesce(a["incident"] == b["incident"], F.lit(False))
    cross = a["language"] != b["language"]
    agree = (entity & act) | (act & (shared >= 1)) | (shared >= 2)
    anchored = exact | (shared >= 1) | c("quantity_match")
    verdict = lambda relation, confidence: F.struct(F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))
    gate = (
        F.when(blocked, verdict("different", "high"))
        .when(a["reaction"] != b["reaction"], verdict("related", "low"))
        .when((c("place") == "nested") & good, verdict("part-of", "moderate"))
        .when((c("place") == "nested") & (ok | act_ok), verdict("part-of", "low"))
        .when(same_loc & act & (c("days") > 1.5) & developing, verdict("follow-up", "moderate"))
        .when(cross & same_loc & (c("days") <= 1.25) & agree & clean, verdict("same", "moderate"))
        .when(cross, verdict("uncertain", "low"))
        .when(same_loc & incident & clean & anchored, verdict("same", "moderate"))
        .when(same_loc & incident & clean & entity, verdict("same", "low"))
        .when(same_loc & clean & ((entity & (act | ok)) | (act & (good | exact))), verdict("same", "high"))
        .when(same_loc & clean & ((act & ok) | (good & (act_ok | (lexical >= 0.55))) | (entity & ok) | (good & (shared >= 2) & ((lexical >= 0.45) | act_ok))), verdict("same", "moderate"))
        .when(entity & act & ok & clean, verdict("same", "moderate"))
        .when(same_loc & clean & (lexical >= 0.55) & ok & (act_ok | (c("action") == "unknown")), verdict("same", "low"))
        .when((c("place") == "same-region-only") & clean & (shared >= 1) & ((c("quantity_match") & (act | (c("action") == "unknown"))) | (entity & act) | (act & (shared >= 2) & good)), verdict("same", "moderate"))
        .when(c("quantity_match") & good & (shared >= 1) & clean & (c("place") == "unknown") & (act_ok | (c("action") == "unknown")), verdict("same", "moderate"))
        .when(c("place").isin("same", "nested") & (ok | (c("action") == "compatible")), verdict("related", "low"))
        .otherwise(verdict("different", "moderate"))
    )
    return signals.withColumn("verdict", gate).withColumns({"relation": F.col("verdict.relation"), "confidence": F.col("verdict.confidence")}).drop("verdict")


def cross_cluster_relations(decided: DataFrame, components: DataFrame) -> DataFrame:
    """(cluster_a, cluster_b, relation, edges): how clusters relate, of which no
    pair is the same event.

    ``decided`` has a, b, relation; ``components`` has node, component, and reports
    without one are their own cluster. Edges that part-of, follow-up or related
    articles make between two clusters become one edge of the clusters; of several
    relations the first in that order names it. cluster_a < cluster_b.
    """
    named = {"part-of": 0, "follow-up": 1, "related": 2}
    edges = decided.where(F.col("relation").isin(*named)).select("a", "b", "relation")
    for side in ("a", "b"):
        own = components.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        edges = edges.join(own, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    edges = edges.where("c_a <> c_b").select(F.least("c_a", "c_b").alias("cluster_a"), F.greatest("c_a", "c_b").alias("cluster_b"), "relation")
    order = F.create_map(*[F.lit(v) for pair in named.items() for v in pair])[F.col("relation")]
    return edges.groupBy("cluster_a", "cluster_b").agg(F.min_by("relation", order).alias("relation"), F.count("*").alias("edges"))


def alike_within(rows: pa.Table, least: float, micros: int) -> pa.Table:
    """(x, y, similarity) of a group's rows: id, set, at, right, key; within one tile all
    of them meet, else the left ones meet the right ones.

    Shared tokens are counted in a matrix: frequent tokens by a product, rare ones by
    their pairs.
    """
    key = rows["key"][0].as_py()
    own = not key["next"] and key["lo"] == key["hi"]
    right = rows["right"].to_numpy(zero_copy_only=False)
    x, y = (np.arange(len(right)),) * 2 if own else (np.flatnonzero(~right), np.flatnonzero(right))
    ids, at, sets = rows["id"].combine_chunks(), rows["at"].to_numpy(), rows["set"].combine_chunks()
    size = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
    code = sets.flatten().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    of, count = np.repeat(np.arange(len(size)), size), int(code.max(initial=-1)) + 1

    def postings(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and places in ``side`` of its tokens, by code, and how often each code occurs."""
        place = np.full(len(size), -1)
        place[side] = np.arange(len(side))
        used = np.flatnonzero(place[of] >= 0)
        used = used[np.argsort(code[used], kind="stable")]
        return code[used], place[of[used]], np.bincount(code[used], minlength=count)

    (code_x, row_x, n_x), (code_y, row_y, n_y) = postings(x), postings(y)
    shared = np.zeros(len(x) * len(y))
    often = n_x * n_y * OFTEN >= max(1, len(x) * len(y))
    for some in np.split(np.flatnonzero(often), np.arange(STRIP, often.sum(), STRIP)):
        column = np.full(count, -1)
        column[some] = np.arange(len(some))

        def matrix(codes: np.ndarray, place: np.ndarray, n: int, column: np.ndarray = column, width: int = len(some)) -> np.ndarray:
            dense, has = np.zeros((n, width), np.float32), column[codes] >= 0
            dense[place[has], column[codes[has]]] = 1
            return dense

        shared += (matrix(code_x, row_x, len(x)) @ matrix(code_y, row_y, len(y)).T).ravel()
    rare = np.flatnonzero((~often & (n_y > 0))[code_x])
    begins = np.cumsum(n_y) - n_y
    for begin in range(0, len(rare), 65536):
        some = rare[begin : begin + 65536]
        reach = n_y[code_x[some]]
        ahead = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        met = row_y[np.repeat(begins[code_x[some]], reach) + ahead]
        shared += np.bincount(np.repeat(row_x[some], reach) * len(y) + met, minlength=len(shared))
    shared = shared.reshape(len(x), len(y))
    similar = shared / (size[x][:, None] + size[y][None, :] - shared)
    p, q = np.nonzero((similar >= least) & (np.abs(at[x][:, None] - at[y][None, :]) <= micros))
    if own:
        p, q = p[p < q], q[p < q]
    return pa.table({"x": ids.take(pa.array(x[p])), "y": ids.take(pa.array(y[q])), "similarity": similar[p, q]})


def band_pairs(rows: DataFrame, key: str, tokens: str, time: str, seconds: int, least: float) -> DataFrame:
    """(a, b, similarity) of rows within a time band with Jaccard >= ``least``, above 0.

    Time is cut into buckets as long as the band; rows of a bucket meet one another and
    those of the next where they lie, so only similar pairs leave a task. A bucket beyond
    TILE rows is cut into tiles, and each pair of tiles is a group of its own.
    """
    micros = seconds * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    base = rows.select(F.col(key).alias("id"), F.array_distinct(tokens).alias("set"), at.alias("at")).where((F.size("set") > 0) & F.col("id").isNotNull() & F.col("at").isNotNull())
    space = Workspace(rows.sparkSession, "token-sets")
    base = space.keep(base.withColumn("bucket", F.floor(F.col("at") / micros)), "rows")
    kind = dict(base.dtypes)["id"]
    large = space.keep(base.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1"), "large")
    for name, step in (("tiles", 0), ("after", 1), ("before", -1)):
        base = join_checked(base, large.select((F.col("bucket") - step).alias("bucket"), F.col("tiles").alias(name)), "bucket", "left", MOST_BROADCAST_ROWS)
    tile = F.pmod(F.xxhash64("id"), F.coalesce("tiles", F.lit(1))).cast("int")

    def met(name: str, use) -> Column:
        return F.transform(F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1), use)

    def place(bucket: Column, after: bool, lo: Column, hi: Column, right: Column) -> Column:
        return F.struct(F.struct(bucket.alias("bucket"), F.lit(after).alias("next"), lo.alias("lo"), hi.alias("hi")).alias("key"), right.alias("right"))

    here = F.col("bucket")
    places = F.concat(
        met("tiles", lambda j: place(here, False, F.least("tile", j), F.greatest("tile", j), F.col("tile") > j)),
        met("after", lambda j: place(here, True, F.col("tile"), j, F.lit(False))),
        met("before", lambda j: place(here - 1, True, j, F.col("tile"), F.lit(True))),
    )
    dealt = base.withColumn("tile", tile).select("id", "set", "at", F.explode(places).alias("p")).select("id", "set", "at", "p.right", "p.key")
    found = dealt.groupBy("key").applyInArrow(lambda table: alike_within(table, least, micros), f"x {kind}, y {kind}, similarity double")
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


#: The name it had when candidates came from the rarest tokens.
prefix_pairs = band_pairs


def newest_without_duplicates(rows: DataFrame, key: str, time: str, url_key: Column, publisher: str, title_key: Column, least_title: Column) -> DataFrame:
    """Newest first; a row goes if a newer one has its URL, or its publisher and
    title key where the title is long enough. Rows gone by URL don't register
    their title."""
    order = [F.col(time).desc(), F.col(key).asc()]
    first = rows.withColumn("_url", url_key).withColumn("_title", title_key).withColumn("_long", least_title)
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("_url").orderBy(*order))).where("_k = 1")
    again = F.row_number().over(Window.partitionBy(publisher, "_title", "_long").orderBy(*order))
    return first.withColumn("_k", again).where("_k = 1 or not _long").drop("_url", "_title", "_long", "_k")
