"""Token alignment against a byte-by-byte version in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from gleaner.llm import alignment as A

PATH_A, PATH_B = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, chunk long, keys string"


def tokens_of(text, a, b, letters):
    """(id, start, end) of both sides' tokens, or two empty lists."""
    whole = f" {text or ''}".encode()
    if not text:
        return [], []
    found = []
    names = [a.id_to_token(i) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    found.append([(a.token_to_id(n), "<|endoftext|>".encode() if n == "<|endoftext|>" else bytes(letters[c] for c in n)) for n in names])
    found.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
    if any(b"".join(x for _, x in side) != whole for side in found):
        return [], []
    out = []
    for side in found:
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain(rows):
    from gleaner.llm.pieces import alphabet

    a, b, letters = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B), alphabet()
    a.encode_special_tokens = True
    docs, counts = [], Counter()
    for doc, text in rows:
        x, y = tokens_of(text, a, b, letters)
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, s, _ in x if low <= s < cut) + "|" + ",".join(str(i) for i, s, _ in y if low <= s < cut))
            low = cut
        links = [(i, j) for i, s, e in x for j, p, q in y if s < q and p < e]
        counts.update(links)
        docs.append((doc, x, y, groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted(
        (doc, len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else "")
        for doc, x, y, groups, links in docs
    )


def found(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, t, 9, "clash") for i, t in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in A.align_tokens(frame, PATH_A, PATH_B).collect())


def test_equals_plain_python(spark, monkeypatch):
    rng = random.Random(11)
    letters = [*"abcdeéñß\n\t.,'!?1230-_<|>", "'s", "the", "漢", "🙂", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "\r\n", "\x85", "\xa0", "　", *[" "] * 9]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["▁", "a ▁ b", "a▁b c", "▀ x", " ", "  ", " a", "a  ", "a\x00b", "the same words again", "the same words again"]
    rows = [*enumerate(texts), (1000, None), (1001, ""), (3, texts[3])]
    expected = plain(rows)
    assert sum(n == 0 for _, n, *_ in expected) == 5
    assert found(spark, rows) == expected
    monkeypatch.setattr(A, "MOST_BROADCAST_ROWS", 0)
    assert found(spark, rows, 7) == expected


def test_long_words_and_texts(spark):
    n = 1024
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {one}"), (2, f"x {two}"), (3, "x" * 300 + " y"), (4, "漢字 " * 400)]
    assert found(spark, rows, 1) == plain(rows)
    long = A.CHUNK_BYTES // 4
    text = " ".join(f"w{i % 1009}" for i in range(long))
    got = found(spark, [(1, text), (2, text), (3, "w1 w2")], 1)
    assert got[0][1:5] == got[1][1:5] and got[0][7] == got[1][7] and got[0][1] > long


def test_empty_tables(spark, empty):
    assert A.align_tokens(empty, PATH_A, PATH_B).count() == 0
    assert found(spark, [(1, None), (2, "")]) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_chunks_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(A, "CHUNK_BYTES", 100)
    monkeypatch.setattr(pyspark, "TaskContext", type("T", (), {"get": classmethod(lambda cls: cls()), "partitionId": lambda self: 2}))
    texts = ["word " * 9, None, "", "x" * 500, *["short"] * 30]
    made = list(A.make_chunks(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])]), PATH_A, PATH_B))
    assert [d for row in made for d in row["doc_ids"][0].as_py()] == list(range(len(texts))) and len(made) > 3
    assert [row["chunk"][0].as_py() for row in made] == [(2 << 32) + k for k in range(len(made))]
    assert all((np.array(row["counts"][0].as_py()) > 0).all() for row in made)
