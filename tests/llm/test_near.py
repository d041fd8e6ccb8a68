"""Near duplicates, decontamination and their shingles."""

import random

import numpy as np
import pyarrow as pa

from gleaner.llm import near_duplicates as N
from gleaner.llm import shingles as S
from gleaner.llm.decontamination import benchmark_matches


def brute_components(texts, percent=85):
    sets = [S.shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 9)}"
        out.append(" ".join(words))
    return out


def test_shingles_match_plain_python():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "A b\tC", "a b c d e", "é É a b c d e f"] + [" ".join(rng.choice("abcAB") for _ in range(rng.randint(0, 30))) for _ in range(100)]
    data, offsets = S.flat(pa.array(texts))
    for most in (1, 40, 1 << 20):
        sizes = []
        for a, b in S.pieces(offsets, most):
            hashes, owners = S.row_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sizes += np.diff(S.distinct_sets(hashes, owners, b - a)[1]).tolist()
        assert sizes == [len(S.shingle_set(t)) for t in texts]


def test_sliced_arrow_columns():
    column = pa.array(["x y", None, "a b c d e f", "q"]).slice(1, 2)
    data, offsets = S.flat(column)
    assert bytes(data) == b"a b c d e f" and offsets.tolist() == [0, 0, 11]


def test_components_against_brute_force(make):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(400)]
    texts = [None, "", "x", "X", "a b c", "A b c"]
    for size in (12, 40, 90):
        for _ in range(3):
            texts += variants(rng, " ".join(rng.choice(words) for _ in range(size)), 14, 1 + size // 20)
    expected, sizes = brute_components(texts)
    found = {r.doc_id: r for r in N.near_duplicates(make(texts)).collect()}
    assert [found[i].component_id for i in range(len(texts))] == expected
    assert [found[i].n_shingles for i in range(len(texts))] == sizes
    assert all(found[i].kept == (expected[i] == i) for i in range(len(texts)))


def test_large_group_goes_through_blocks(make, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(6)
    texts = variants(rng, " ".join(f"u{i}" for i in range(60)), 120, 5)
    expected, _ = brute_components(texts)
    found = {r.doc_id: r.component_id for r in N.near_duplicates(make(texts)).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def test_miss_probability_bounds():
    for n, m in N.least_matches(0.85, 1e-6):
        assert 0 < m < n


def test_bands_hold_the_miss_bound():
    assert N.bands_for(0.85, 1e-6) == 20 and N.bands_for(0.8, 1e-6) == 28
    for percent in (80, 85, 95, 100):
        assert (1 - (percent / 100) ** N.ROWS) ** N.bands_for(percent / 100, 1e-6) < 1e-6


def test_pipeline_stage_drops_pairs_from_four_fifths(spark, make):
    """A changed word in the middle of s shingles gives (s - 5) / (s + 5)."""
    import corpus_pipeline

    texts, drop = [], set()
    for k, s in enumerate((44, 45, 47, 50, 53, 56, 60, 62)):
        words = [f"p{k}x{i}" for i in range(s + 4)]
        texts += [" ".join(words), " ".join([*words[:20], "changed", *words[21:]])]
        if s >= 45:
            drop.add(2 * k + 1)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, make(texts), "").collect()}
    assert kept == set(range(len(texts))) - drop
    assert {r.doc_id for r in N.near_duplicates(make(texts)).where("not kept").collect()} == {15}


def test_near_odd_rows(odd, empty):
    found = N.near_duplicates(odd).collect()
    assert len(found) == odd.count() and N.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in found}
    assert by[8].component_id == 7 and by[6].component_id == 5 and by[0].component_id == 0 and by[1].component_id == 1 and by[0].n_shingles == 0


def test_containment_against_brute_force(spark, make):
    rng = random.Random(7)
    words = [f"b{i}" for i in range(300)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 9, 14, 30, 70)] + ["one two", "", None]
    texts = [None, "", "one two", "One  two"]
    for _ in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:5]).split()
            if rng.random() < 0.5:
                item[rng.randrange(len(item))] = "edited"
            parts += [" ".join(item).upper(), " ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))]
        texts.append(" \n".join(parts))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in benchmark_matches(make(texts), table).collect()}
    expected = {}
    for i, text in enumerate(texts):
        have = S.shingle_set(text)
        for j, item in enumerate(items):
            want = S.shingle_set(item)
            if want and len(want & have) >= 0.8 * len(want):
                expected[i, j] = (len(want), len(want & have))
    assert found == expected and (2, 5) in found


def test_items_of_one_and_two_shingles_are_not_missed():
    from gleaner.llm import decontamination as D

    rng = random.Random(8)
    for n in (5, 6):
        index = D.index_items(["i"], [" ".join(f"item{i}" for i in range(n))], 5)
        texts = []
        for k in range(1500):
            words = [f"z{rng.randrange(10**6)}" for _ in range(40)]
            at = rng.randrange(40)
            texts.append(" ".join(words[:at] + [f"item{i}" for i in range(n)] + words[at:]))
        data, offsets = S.flat(pa.array(texts))
        assert {row for row, _ in D.candidates(*S.row_shingles(data, offsets, 5), index)} == set(range(len(texts)))


def test_items_in_blocks_and_odd_rows(spark, make, odd, empty, monkeypatch):
    from gleaner.llm import decontamination as D

    monkeypatch.setattr(D, "BLOCK_CHARS", 20)
    table = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in benchmark_matches(odd, table).collect())
    assert found == [(5, 1)] * 4 + [(6, 1)] * 2 + [(7, 2), (8, 2)]
    assert benchmark_matches(empty, table).count() == 0
    assert benchmark_matches(odd, table.limit(0)).count() == 0


def opposed(n):
    """Two words of n letters whose polynomial hashes with an odd base agree from 1,024 on."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomial_hashes_stay_apart(make, spark):
    for n in (1024, 2048, 4096):
        one, two = opposed(n)
        assert len(set(S.word_hashes(*(lambda d: (d, np.array([0, n]), np.array([n, 2 * n])))(np.frombuffer((one + two).encode(), dtype=np.uint8))).tolist())) == 2
        texts = [one, two, f"{one} b c d e f", f"{two} b c d e g", f"x {one} y {two} z w", f"x {two} y {one} z w"]
        found = {r.doc_id: r.component_id for r in N.near_duplicates(make(texts)).collect()}
        assert found == {i: i for i in range(len(texts))}
        items = spark.createDataFrame([(0, f"{one} b c d e"), (1, two), (2, two)], "item_id long, text string")
        assert {(r.doc_id, r.item_id) for r in benchmark_matches(make(texts), items).collect()} == {(2, 0), (1, 1), (1, 2)}


def test_links_hold_for_shingles_not_hashes(make, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(40)]
    texts += [t + " x" for t in texts[:10]]
    monkeypatch.setattr(N, "BLOCK", 8)
    whole = S.word_hashes

    def few(*args, **more):  # any two words may share their hash
        return whole(*args, **more) & np.uint64(3)

    import gleaner.llm.shingles

    pairs = [(i, 40 + i) for i in range(10)]
    left, right = [texts[a] for a, _ in pairs] + [texts[0]], [texts[b] for _, b in pairs] + [texts[1]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array(range(11)), pa.array(left), pa.array(right)], names=list("abcd"))
    assert next(N.verify(iter([batch]), 5, 85))["a"].to_pylist() == list(range(10))
    monkeypatch.setattr(gleaner.llm.shingles, "word_hashes", few)
    n = len(texts)
    signed = N.signatures(*S.distinct_sets(*S.row_shingles(*S.flat(pa.array(texts))), n), 20)
    table = pa.table({"i": [0] * n, "j": [0] * n, "block": [0] * n, "comp": list(range(n)), "id": list(range(n)), "band": [0] * n, "signature": [x.tobytes() for x in signed], "text": texts})
    links = N.decide_blocks(table, [(16, 0)], 5, 85, 0)
    assert set(zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True)) == set(pairs)


def test_rows_of_one_id_make_no_pairs(spark):
    rows = [(i, f"w{i} a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee ff gg") for i in range(2) for _ in range(300)]
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.groupBy("doc_id", "component_id").count().collect().__len__() == 2 and found.count() == 600
