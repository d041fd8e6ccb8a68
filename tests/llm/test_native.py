"""License scan, mixing, revisits and exact deduplication."""

import datetime as dt
import hashlib
import random
import re

from gleaner.llm.exact_duplicates import exact_duplicates
from gleaner.llm.licenses import TEMPLATES, license_scan
from gleaner.llm.mixing import mix_sources, repeat_by_mix
from gleaner.llm.revisits import resolve_revisits


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def test_exact_duplicates_against_brute_force(make):
    rng = random.Random(1)
    texts = [rng.choice(["a", "b", "a  b", "a b", "a\nb", None, "", "ab c"]) for _ in range(200)] + ["p" * 96 + "x", "p" * 96 + "y"]
    found = {r["doc_id"]: r for r in rows(exact_duplicates(make(texts), hash_all=True))}
    normal = [re.sub(r"[\x20\t-\r]+", " ", t or "") for t in texts]
    for i, t in enumerate(normal):
        group = [j for j, u in enumerate(normal) if u == t]
        assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == (group[0], len(group), i == group[0])
        assert bytes(found[i]["text_hash"]) == hashlib.sha256(t.encode()).digest()


def test_exact_duplicates_reads_full_content_only_where_needed(make):
    found = {r["doc_id"]: r["text_hash"] for r in rows(exact_duplicates(make(["same", "same", "other one"])))}
    assert found[0] and found[1] and found[2] is None


def test_exact_duplicates_odd_rows(odd, empty):
    found = rows(exact_duplicates(odd))
    assert len(found) == odd.count() and exact_duplicates(empty).count() == 0
    by = {r["doc_id"]: r for r in found}
    assert by[8]["keep_id"] == 7 and by[1]["keep_id"] == 0 and by[2]["keep_id"] == 2


def test_notices_inside_longer_units(make):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 200)
    words = mit.split(" ")
    comment = "int x;\n/*\n * Copyright\n *\n" + "".join(" * " + " ".join(words[k : k + 9]) + "\n" for k in range(0, len(words), 9)) + " */\nint main() { return 0; }"
    footer = "Some page footer. This work is licensed under the GNU General Public License, version 3. Contact us at any time for more about it and much else."
    edited = "lead in words " * 30 + footer.replace("Public License,", "Public Licence") + " tail" * 40
    found = {(r["doc_id"], r["license"]): (r["dice"], r["n_units"]) for r in rows(license_scan(make([comment, footer, edited, "nothing here", None, ""])))}
    assert found[(0, "MIT")][0] == 1.0 and found[(1, "GPL-3.0")] == (1.0, 0) and found[(2, "GPL-3.0")][0] >= 0.8
    assert {d for d, _ in found} == {0, 1, 2}


def plain_mix(docs):
    """The mix by sorting: (id, size, source) -> id -> (target, passes)."""
    sizes = {}
    for _, size, source in docs:
        sizes[source] = sizes.get(source, 0) + size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1.0 + k % 3 for k, s in enumerate(names)}
    open_, target, budget = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: budget * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        budget -= sum(3.0 * sizes[s] for s in over)
        open_ -= set(over)
    out = {}
    for s in names:
        whole = min(3, int(target[s] // sizes[s])) if sizes[s] else 0
        rest, through, done = target[s] - whole * sizes[s], 0, False
        for h, i, size in sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, size) for i, size, t in docs if t == s):
            extra = not done and rest > 0 and (through + size <= rest or through + size - rest < rest - through)
            done = done or through + size > rest
            through += size
            out[i] = (target[s], min(3, whole + extra))
    return out


def test_mixing_against_sorting(make):
    rng = random.Random(2)
    for case in range(3):
        texts = [None if rng.random() < 0.05 else "w " * rng.randint(0, 60) for _ in range(150)]
        sources = [rng.choice(["b", "a", "é", None, "tiny"][: 2 + case]) for _ in texts]
        expected = plain_mix([(i, len((t or "").split()), s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))])
        for r in rows(mix_sources(make(texts, sources))):
            target, passes = expected[r["doc_id"]]
            assert abs(r["target"] - target) < 1e-6 * max(1, target) and r["passes"] == passes and r["taken"] == passes * r["size"]


def test_mix_repeats_whole_rows(make, odd, empty):
    docs = make([" ".join(["w"] * (1 + i % 40)) for i in range(300)], ["a" if i % 3 else "b" if i % 2 else None for i in range(300)])
    expected = sorted(r["doc_id"] for r in rows(mix_sources(docs)) for _ in range(r["passes"]))
    found = repeat_by_mix(docs)
    assert found.columns == docs.columns and sorted(r["doc_id"] for r in rows(found)) == expected
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    plan = {r["doc_id"]: r["passes"] for r in rows(mix_sources(odd))}
    assert repeat_by_mix(odd).columns == odd.columns
    assert sum(plan[r["doc_id"]] for r in rows(odd)) == repeat_by_mix(odd).count()
    assert repeat_by_mix(empty).count() == 0


def test_mixing_odd_rows(odd, empty):
    found = rows(mix_sources(odd))
    assert len(found) == odd.count() and mix_sources(empty).count() == 0
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)


def test_license_scan(make, odd, empty):
    found = {(r["doc_id"], r["license"]): r for r in rows(license_scan(make(["x\nReleased under the MIT License!\ny", "released  under THE mit license\nReleased under the MIT License.", "no license here", None, ""])))}
    assert set(found) == {(0, "MIT"), (1, "MIT")} and found[1, "MIT"]["n_units"] == 3 and found[0, "MIT"]["dice"] == 1.0
    assert license_scan(odd).count() == 0 and license_scan(empty).count() == 0


def test_license_over_several_lines(make):
    block = "intro\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nend"
    assert [r["license"] for r in rows(license_scan(make([block])))] == ["GPL-3.0-or-later"]


CAPTURE = "record_id long, url string, ts timestamp, kind string, etag string, last_modified string, headers map<string,string>"


def test_revisits(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    data = [
        (1, "http://www.a.org/x/", at(0), "response", '"1"', None, {"content-type": "text/html", "age": "1", "etag": '"1"'}),
        (2, "https://a.org/x?utm_source=q#f", at(1), "revisit", 'W/"1"', None, {"age": "9", "content-type": "no", "content-length": "0"}),
        (3, "https://a.org/x", at(2), "response", '"2"', None, {"etag": '"2"'}),
        (4, "https://a.org/x", at(3), "revisit", '"1"', None, {}),
        (5, "https://a.org/x", at(3), "revisit", None, None, None),
        (6, "https://b.org/", at(3), "revisit", '"1"', None, {}),
        (7, None, at(3), "revisit", '"1"', None, {}),
        (8, "https://a.org/x", None, "revisit", '"1"', None, {}),
        (9, "https://c.org/", at(5), "response", None, "Mon", {"a": "b"}),
        (10, "https://c.org/", at(5), "revisit", None, "Mon", {"c": "d"}),
    ]
    found = {r["record_id"]: r for r in rows(resolve_revisits(spark.createDataFrame(data, CAPTURE), slices=4))}
    assert {k: (r["response_id"], r["outcome"]) for k, r in found.items()} == {
        2: (1, "resolved"), 4: (None, "changed"), 5: (3, "unchecked"), 6: (None, "orphan"), 7: (None, "undated"), 8: (None, "undated"), 10: (9, "resolved"),
    }
    assert found[2]["headers"] == {"content-type": "text/html", "age": "9", "etag": '"1"'}
    assert resolve_revisits(spark.createDataFrame([], CAPTURE)).count() == 0


def test_revisits_against_brute_force(spark):
    rng = random.Random(5)
    data = [(i, f"http://h{rng.randint(0, 2)}.org/", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 300)), rng.choice(["response", "revisit"]), '"1"', None, {}) for i in range(300)]
    found = {r["record_id"]: r["response_id"] for r in rows(resolve_revisits(spark.createDataFrame(data, CAPTURE), slices=7))}
    for i, url, ts, kind, *_ in data:
        if kind == "revisit":
            before = [(t, j) for j, u, t, k, *_ in data if k == "response" and u == url and (t, j) < (ts, i)]
            assert found[i] == (max(before)[1] if before else None)


def test_licenses_in_very_long_texts(make):
    text = "Licensed under CC BY 4.0. " * 200_000
    middle = "word " * 5000 + "Released under the MIT License. " + "word " * 5000
    found = {(r["doc_id"], r["license"]): (r["dice"], r["n_units"]) for r in rows(license_scan(make([text, middle, text.replace(". ", ".\n")])))}
    assert found == {(0, "CC-BY-4.0"): (1.0, 1), (1, "MIT"): (1.0, 0), (2, "CC-BY-4.0"): (1.0, 200_001)}  # whole lines and blocks are units too


def test_notices_across_chunks_of_words(make, monkeypatch):
    from gleaner.llm import licenses

    texts = ["a b c " * k + "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. " + "d e f " * k for k in range(40)]
    expected = {tuple(r.values()) for r in rows(license_scan(make(texts)))}
    monkeypatch.setattr(licenses, "CHUNK_WORDS", max(len(t.split()) for _, t in TEMPLATES) + 40)
    assert {tuple(r.values()) for r in rows(license_scan(make(texts)))} == expected and len(expected) >= 40


def test_shuffled_branches_give_the_same(make, monkeypatch):
    from gleaner.llm import exact_duplicates as X
    from gleaner.llm import mixing as M
    from gleaner.llm import near_duplicates as N
    from gleaner.operators import components as C

    rng = random.Random(21)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(40)) for _ in range(12)]
    texts = [rng.choice(base) + rng.choice(["", "", " end", " other end"]) for _ in range(150)] + [None, "", "  "]
    docs = make(texts, [rng.choice(["hot", "hot", "b", "c", None]) for _ in texts])

    def results():
        return [sorted(map(str, f.collect())) for f in (exact_duplicates(docs), exact_duplicates(docs, hash_all=True), mix_sources(docs), N.near_duplicates(docs, seed=1))]

    expected = results()
    monkeypatch.setattr(X, "MOST_BROADCAST_KEYS", 0)
    monkeypatch.setattr(M, "MOST_BROADCAST_SOURCES", 0)
    monkeypatch.setattr(N, "MOST_BROADCAST_IDS", 0)
    monkeypatch.setattr(C, "MOST_BROADCAST_ROWS", 0)
    monkeypatch.setattr(N, "BLOCK", 16)
    assert results() == expected
