"""Token blocks, and the pipeline held against plain Python."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from gleaner.llm import token_blocks as B
from gleaner.llm.pieces import ByteLevel, alphabet, cuts_at_words
from gleaner.llm.storage import Workspace

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1023, 1024, 1025, 5000):
        for high in (1, 2, 300, 50257, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            if n > 10:
                ids[::97] = 2**32 - 1
            payload, offsets = B.pack(ids)
            assert (B.unpack(payload, offsets) == ids).all()
            if n > 100:
                assert (B.unpack(payload, offsets, 37, n - 9) == ids[37 : n - 9]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(1024, 1000, dtype=np.uint32) + np.arange(1024, dtype=np.uint32) % 16
    plain = len(B.pack(ids)[0])
    ids[[5, 500]] = 4_000_000_000
    assert len(B.pack(ids)[0]) == plain + 2 * 6


def test_encoder_equals_the_library():
    rng, known, library = random.Random(3), B.Encoder(PATH), Tokenizer.from_file(PATH)
    letters = [*"abcdeéñß  \n\t.,'!?1230-_<|>", "'s", " the", "漢", "🙂", "\x1c", "<|endoftext|>", "\r\n", "\x85", "İ", " "]
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(known.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_of_the_encoder_is_bounded():
    rng, known, most, library = random.Random(5), B.Encoder(PATH, 1 << 19), 0, Tokenizer.from_file(PATH)
    for _ in range(300):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 14))) for _ in range(200)]
        text = " ".join([*words, "y" * 5000])
        ids = np.frombuffer(known.encode(text), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        most = max(most, known.known.bytes())
    assert 1 << 18 < most <= 9 << 16 and 1000 < len(known.known) < 20_000


def test_pieces_met_lately_stay_known(monkeypatch):
    known, asked = B.Encoder(PATH, 1 << 14), []
    encode = known.level.encode
    monkeypatch.setattr(known.level, "encode", lambda texts: asked.extend(texts) or encode(texts))
    for k in range(500):
        known.encode(f"a often once{k} often twice{k} twice{k}")
    assert sum("often" in text for text in asked) <= 2 and known.known.bytes() <= 1 << 15


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    from gleaner.llm import pieces

    library, texts = Tokenizer.from_file(PATH), ["a bb cc bb dd", "dd cc  ee\xa0 ff", "bb", " ", "dd ee"]
    for hashed in (lambda n: np.full(n, 7, dtype=np.uint64), lambda n: np.arange(n, dtype=np.uint64) % 3 + 1):
        monkeypatch.setattr(pieces.S, "word_hashes", lambda data, starts, *_, hashed=hashed: hashed(len(starts)))
        known = B.Encoder(PATH)
        for _ in range(3):
            found = [np.frombuffer(ids, dtype="<u4").tolist() for ids in known.encode_all(pa.array(texts))]
            assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_of_every_byte():
    level = ByteLevel(PATH)
    assert len(alphabet()) == 256 and sorted(level.bytes[i][0] for i in range(256)) == list(range(256))
    text = "Añ 漢\x00 <|endoftext|>"
    assert b"".join(level.bytes[i] for i in level.encode([text])[0]) == text.encode()


def test_long_words_of_equal_polynomial_hashes():
    library = Tokenizer.from_file(PATH)
    for n in (1024, 2048, 4096):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        b = a.translate(str.maketrans("ab", "ba"))
        texts = [f"x {a}", f"x {b}", f"{a} {b}", f"y\n{b} {a} {a}"]
        found = [np.frombuffer(ids, dtype="<u4").tolist() for ids in B.Encoder(PATH).encode_all(pa.array(texts))]
        assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_are_not_cut(tmp_path):
    library = Tokenizer.from_file(PATH)
    assert cuts_at_words(json.loads(library.to_str()))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    library.save(str(tmp_path / "other.json"))
    known = B.Encoder(str(tmp_path / "other.json"))
    assert not known.level.cuts
    assert np.frombuffer(known.encode("a b  c"), dtype="<u4").tolist() == library.encode("a b  c", add_special_tokens=False).ids


def test_texts_encoded_together_equal_the_library():
    rng, known, library = random.Random(9), B.Encoder(PATH), Tokenizer.from_file(PATH)
    letters = [*"abcdeéñß\n\t.,'!?1230-_<|>", "'s", "the", "漢", "🙂", "<|endoftext|>", "\r\n", "\x85", "\xa0", *[" "] * 9]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3_000)] + [None, "", " ", "a ", " a", "x" * 200 + " y"]
    for first in range(0, len(texts), 100):
        some = texts[first : first + 100]
        expected = [library.encode(t or "", add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in known.encode_all(pa.array(some, pa.string()))] == expected


def test_file_round_trip(spark, odd, empty):
    library = Tokenizer.from_file(PATH)
    folder = Workspace(spark, "test").path("ids")
    B.write_token_file(odd, folder, PATH, shards=3)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in B.read_token_file(spark, folder).collect())
    expected, start = [], 0
    for r in sorted(odd.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected.append((start, r.doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert found == expected
    B.write_token_file(empty, folder, PATH)
    assert B.read_token_file(spark, folder).count() == 0


def test_rows_without_an_id_come_first(spark):
    folder = Workspace(spark, "test").path("ids")
    rows = spark.createDataFrame([(3, "a b"), (None, "c"), (-1, "d"), (None, None)], "doc_id long, text string")
    B.write_token_file(rows, folder, PATH, shards=2)
    found = sorted(B.read_token_file(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, -1, 3] and sorted(r.n_tokens for r in found[:2]) == [1, 2]
    with pytest.raises(ValueError):
        B.write_token_file(rows.select(rows.doc_id.cast("string"), "text"), folder, PATH)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from gleaner.llm import shingles as S

    rng = random.Random(13)
    word = lambda: "".join(rng.choice(["ba", "ko", "mi", "tu", "re"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n=60: ". ".join(" ".join(word() for _ in range(10)).capitalize() for _ in range(n // 10))
    item = prose(30)
    texts = [prose() if i % 5 else " ".join([word() + "###" for _ in range(50)]) for i in range(200)]
    texts += [texts[1], texts[2] + " end", prose(40) + " " + item + " " + prose(40)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 != 0 or i >= 200), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, seen = corpus_pipeline.STAGES, {}
    current, space = spark.read.parquet(str(tmp_path / "documents.parquet")), Workspace(spark, "stages")
    for name, stage in stages:
        current = space.keep(stage(spark, current, str(tmp_path)), name)
        seen[name] = current.collect()
        if name != stages[-1][0]:
            assert current.columns == docs.columns
    ids = {name: {r.doc_id for r in found} for name, found in seen.items()}
    junk = {i for i in range(200) if i % 5 == 0}
    assert not ids["quality"] & junk and len(ids["quality"]) >= 160
    assert ids["quality"] - ids["near_duplicates"] == {200, 201} & ids["quality"]
    assert ids["near_duplicates"] - ids["decontamination"] == {202}
    assert all(not S.shingle_set(item) & S.shingle_set(r.text) for r in seen["decontamination"])
    assert ids["mixing"] <= ids["decontamination"] and len(seen["token_blocks"]) == len(seen["mixing"])
    total = sum(r.n_tokens for r in seen["token_blocks"])
    assert max(r.start + r.n_tokens for r in seen["token_blocks"]) == total
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["token_blocks"])


def stages_over(spark, folder, docs, labels, items):
    import corpus_pipeline

    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string, source string").write.parquet(str(folder / "benchmark.parquet"))
    current, seen = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        current = Workspace(spark, "odd").keep(stage(spark, current, str(folder)), name)
        if name != "token_blocks":
            assert tuple(current.columns) == corpus_pipeline.COLUMNS
        seen[name] = current.collect()
    return seen


def test_odd_rows_go_through_every_stage(spark, odd, tmp_path):
    rows = odd.collect()
    extra = spark.createDataFrame([(None, "no id here at all", "en", "s", 1, 7, "k", 1.0), (100, "gibberish ### " * 30, "en", "s", 1, 7, "k", 1.0), (100, "gibberish ### " * 30, "en", "s", 1, 7, "k", 1.0)], odd.schema)
    labels = [(r.doc_id, 1, 0) for r in rows] + [(100, 0, 0), (12345, 0, 1), (None, 1, 0)]
    items = [(1, None, "x"), (2, "", "x"), (3, "one two three four", "x"), (3, "one two three four", "x")]
    seen = stages_over(spark, tmp_path, odd.union(extra), labels, items)
    ids = {name: [r.doc_id for r in found] for name, found in seen.items()}
    kept = set(ids["quality"])
    assert {r.doc_id for r in rows} - kept == set() and None in kept and ids["quality"].count(5) == 2
    assert set(ids["near_duplicates"]) == kept - {6, 8} and ids["near_duplicates"].count(5) == 2
    assert set(ids["decontamination"]) == kept - {4, 6, 8}
    assert set(ids["mixing"]) <= set(ids["decontamination"])
    assert sorted(map(str, ids["token_blocks"])) == sorted(map(str, ids["mixing"])) and all(r.n_tokens >= 1 for r in seen["token_blocks"])


def test_empty_tables_go_through_every_stage(spark, empty, tmp_path):
    seen = stages_over(spark, tmp_path, empty, [], [])
    assert all(not found for found in seen.values())
