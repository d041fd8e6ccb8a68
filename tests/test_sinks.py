"""Gated versions and the served index."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.sinks import index as I
from gleaner.sinks import published as P


def gates():
    return [P.Gate("negative", F.count_if(F.col("x") < 0), most=0), P.Gate("share of a", P.share(F.col("k") == "a", F.col("k").isNotNull()), least=0.5)]


def table(spark, rows):
    return spark.createDataFrame(rows, "x int, k string")


def test_a_failing_version_leaves_the_former_in_place(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(ValueError):
        P.read_published(spark, folder)
    assert P.publish(table(spark, [(-1, "a")]), gates(), folder) == (False, {"negative": 1.0, "share of a": 1.0})
    with pytest.raises(ValueError):
        P.read_published(spark, folder)
    assert P.publish(table(spark, [(1, "a"), (2, "b"), (3, None)]), gates(), folder)[0]
    assert not P.publish(table(spark, [(1, "b")]), gates(), folder)[0]
    assert not P.publish(table(spark, [(1, None)]), gates(), folder)[0]  # nothing to measure
    assert sorted(r.x for r in P.read_published(spark, folder).collect()) == [1, 2, 3]
    assert P.publish(table(spark, [(9, "a")]), gates(), folder, "k")[0]
    assert [tuple(r) for r in P.read_published(spark, folder).select("x", "k").collect()] == [(9, "a")]
    found = P.manifest(spark, folder)
    assert [r.passed for r in found] == [False, True, False, False, True] and found[2].failed == ["share of a"]


def test_metrics_come_from_the_pass_that_writes(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.range(100).select(F.col("id").cast("int").alias("x"), F.lit("a").alias("k")).mapInArrow(count, "x int, k string")
    assert P.publish(frame, gates(), str(tmp_path / "out"))[0] and seen.value == 100


def test_empty_tables_are_judged(spark, tmp_path):
    least = [P.Gate("rows at least", F.count("*"), least=1)]
    assert P.publish(table(spark, []), least, str(tmp_path / "a")) == (False, {"rows at least": 0.0})
    assert P.publish(table(spark, []), [], str(tmp_path / "b"))[0]


def test_verdicts_of_sources(spark):
    rows = [(403, True, 9, 9, "forbidden"), (None, True, 9, 9, "unreachable"), (500, True, 9, 9, "unreachable"), (200, False, 9, 9, "invalid feed"), (200, True, 1, 1, "fewer than two items"), (200, True, 5, 0, "no relevant sample"), (204, True, 2, 1, None), (200, None, 2, 1, "invalid feed")]
    frame = spark.createDataFrame(rows, "probe int, valid boolean, items int, relevant int, expected string")
    found = P.verdicts(frame, *[F.col(c) for c in ("probe", "valid", "items", "relevant")]).collect()
    assert all(r.reason == r.expected and r.enabled == (r.expected is None) for r in found) and len(found) == len(rows)


def test_first_rule_that_fits(spark):
    frame = spark.createDataFrame([("court of rain",), ("rain",), ("x",), (None,)], "t string")
    kind = X.first_match(frame["t"], [("court", r"\bcourt\b"), ("weather", "rain")], "other")
    assert [r.k for r in frame.select(kind.alias("k")).collect()] == ["court", "weather", "other", "other"]


def test_index_answers_as_a_scan_does(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["été", "漢字", "x", "Hot"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) + (" hot" if i % 3 else ""), rng.choice(["a-b", None]), "clash") for i in range(400)] + [(5, "w1 w1", None, "clash"), (None, "w2", None, "clash")]
    frame = spark.createDataFrame(rows, "id long, text string, other string, term string")
    folder = str(tmp_path / "index")
    shards = I.write_index(frame, folder, id_col="id", text_cols=["text", "other"], shard_bytes=4000)
    assert shards > 5
    sizes = Counter(r.shard for r in spark.read.parquet(f"{folder}/postings").collect())
    hot = spark.read.parquet(f"{folder}/postings").where("term = 'hot'").count()
    assert max(sizes.values()) < 3 * sum(sizes.values()) / shards + hot and len(sizes) == shards
    counts = {}
    for i, text, other, _ in rows:
        counts.setdefault(i, Counter()).update(w for w in (f"{text} {other or ''}".lower().replace("-", " ")).split() if len(w) >= 2)
    for query in ("w1", "hot W2 x", "été 漢字", "none", "x", "", "w5 none", "hot"):
        terms = {t for t in query.lower().split() if len(t) >= 2}
        want = sorted(((sum(c[t] for t in terms), i) for i, c in counts.items() if terms and all(c[t] for t in terms)), key=lambda p: (-p[0], p[1] is not None, p[1]))[:40]
        assert [(r.hits, r.id) for r in I.search_index(spark, folder, query).collect()] == want
    assert I.write_index(frame.limit(0), str(tmp_path / "none"), id_col="id", text_cols=["text"]) == 1
    assert I.search_index(spark, str(tmp_path / "none"), "w1").count() == 0


def test_many_shards_make_few_folders_and_files(spark, tmp_path):
    frame = spark.range(3000).select("id", F.concat_ws(" ", F.lit("hot"), F.concat(F.lit("w"), F.col("id") % 900)).alias("text"))
    folder = tmp_path / "index"
    shards = I.write_index(frame, str(folder), id_col="id", text_cols=["text"], shard_bytes=200)
    assert shards > 200
    assert len(list((folder / "postings").iterdir())) < 50 and len(list((folder / "postings").rglob("*.parquet"))) < 100
    assert [(r.id, r.hits) for r in I.search_index(spark, str(folder), "hot w7").collect()] == [(7, 2), (907, 2), (1807, 2), (2707, 2)]
