"""Texts as sequences of pieces that tokenizers encode one by one.

A text is cut ahead of every space that doesn't follow white space, so a run of
white space stays whole. Neither a byte-level pattern nor a vocabulary whose
space marks only begin entries joins what lies on two sides of such a cut; the
pieces' ids, one after another, are the ids of the whole text. All work is done
on byte buffers; where hashes are equal the bytes are compared.
"""

from __future__ import annotations

import json
import re
import secrets
from collections.abc import Callable, Iterable

import numpy as np

from gleaner.llm import shingles as S

#: Bytes that a worker's memory of pieces may take.
MOST_BYTES = 32 << 20
#: Bytes of the longest piece that is remembered.
MOST_PIECE = 64

_BYTES = np.arange(256, dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
# The UTF-8 bytes of the white space beyond ASCII.
_WIDE2 = ("\x85", "\xa0")
_WIDE3 = ("\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
_LAST = np.zeros(256, dtype=bool)
_LAST[[c.encode()[-1] for c in (*_WIDE2, *_WIDE3)]] = True


def ends_blank(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character before each place (1 or more) is white space."""
    out = _BLANK[data[ends - 1]]
    for at in np.flatnonzero(_LAST[data[ends - 1]] & (ends > 1)):
        end = int(ends[at])
        tail = data[max(0, end - 3) : end].tobytes()
        out[at] = tail[-2:].decode(errors="replace") in _WIDE2 or tail.decode(errors="replace") in _WIDE3
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin; ``offsets`` are those of the rows."""
    fresh = data == 0x20
    fresh[:1] = False
    at = np.flatnonzero(fresh)
    fresh[at] = ~ends_blank(data, at)
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(fresh)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after another."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)


def same_bytes(one: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, starts2: np.ndarray, sizes2: np.ndarray) -> np.ndarray:
    """Whether each span of ``one`` has the bytes of that of ``other``; spans aren't empty."""
    out = sizes == sizes2
    rows = np.flatnonzero(out)
    stops = np.cumsum(sizes[rows])
    first = 0
    while first < len(rows):  # so many bytes at once
        last = max(first + 1, int(np.searchsorted(stops, stops[first] + S.PIECE_BYTES)))
        some = rows[first:last]
        equal = one[spans(starts[some], sizes[some])] == other[spans(starts2[some], sizes[some])]
        out[some] = np.logical_and.reduceat(equal, np.cumsum(sizes[some]) - sizes[some])
        first = last
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first place of every distinct piece, and which one each piece is."""
    keys, at, of = np.unique(S.word_hashes(data, starts, ends, _BYTES, seed), return_index=True, return_inverse=True)
    sizes = ends - starts
    others = np.flatnonzero(at[of] != np.arange(len(of)))
    first = at[of[others]]
    wrong = others[~same_bytes(data, starts[others], sizes[others], data, starts[first], sizes[first])]
    if len(wrong):  # different pieces of one hash: each by its bytes, under no hash
        found: dict[bytes, int] = {}
        for i in wrong.tolist():
            of[i] = found.setdefault(data[starts[i] : ends[i]].tobytes(), len(keys) + len(found))
        at = np.concatenate([at, [wrong[np.flatnonzero(of[wrong] == k)[0]] for k in range(len(keys), len(keys) + len(found))]])
        keys = np.concatenate([keys, np.zeros(len(found), dtype=np.uint64)])
    return keys, at, of


class Memory:
    """Values (arrays of uint32) of pieces by hash and bytes, within bounded bytes.

    When it is full, the pieces that were not met since it was last full are
    forgotten, and of the others what exceeds half of the bound.
    """

    def __init__(self, most_bytes: int | None = None):
        self.most, self.seed = MOST_BYTES if most_bytes is None else most_bytes, secrets.randbits(63)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)
        self.met = np.zeros(0, dtype=bool)
        self.letter_at, self.value_at = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
        self.letter_n, self.value_n = np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.uint16)
        self.letters, self.values = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint32)

    def __len__(self) -> int:
        return len(self.key)

    def bytes(self) -> int:
        return 21 * len(self.key) + len(self.letters) + 4 * len(self.values)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The row of each piece, or -1."""
        if not len(self.key) or not len(keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        hit = np.flatnonzero(self.key[at] == keys)
        rows = at[hit]
        hit = hit[same_bytes(data, starts[hit], sizes[hit], self.letters, self.letter_at[rows].astype(np.int64), self.letter_n[rows].astype(np.int64))]
        out = np.full(len(keys), -1)
        out[hit] = at[hit]
        self.met[out[hit]] = True
        return out

    def take(self, rows: np.ndarray) -> None:
        """Keep only these rows."""
        letters = spans(self.letter_at[rows].astype(np.int64), self.letter_n[rows].astype(np.int64))
        values = spans(self.value_at[rows].astype(np.int64), self.value_n[rows].astype(np.int64))
        self.letters, self.values = self.letters[letters], self.values[values]
        self.key, self.met, self.letter_n, self.value_n = self.key[rows], self.met[rows], self.letter_n[rows], self.value_n[rows]
        self.letter_at = (np.cumsum(self.letter_n, dtype=np.int64) - self.letter_n).astype(np.uint32)
        self.value_at = (np.cumsum(self.value_n, dtype=np.int64) - self.value_n).astype(np.uint32)

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        """Remember pieces that ``find`` didn't; long ones, ones of no hash and ones
        whose hash another piece has are left out."""
        short = np.flatnonzero((sizes <= MOST_PIECE) & (count < 65536) & (keys != 0))
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, keys[short]), len(self.key) - 1)
            short = short[self.key[at] != keys[short]]
        letters, values = data[spans(starts[short], sizes[short])], flat[spans(begin[short], count[short])]
        if self.bytes() + 21 * len(short) + len(letters) + 4 * len(values) > self.most:
            self.take(np.flatnonzero(self.met))
            self.met[:] = False
            if 2 * self.bytes() > self.most:
                self.take(np.flatnonzero(np.arange(len(self.key)) * self.bytes() < len(self.key) * (self.most // 2)))
        if 2 * (21 * len(short) + len(letters) + 4 * len(values)) > self.most:
            return
        letter_at = len(self.letters) + np.cumsum(sizes[short]) - sizes[short]
        value_at = len(self.values) + np.cumsum(count[short]) - count[short]
        joined = [
            np.concatenate([old, new.astype(old.dtype)])
            for old, new in ((self.key, keys[short]), (self.met, np.zeros(len(short), dtype=bool)), (self.letter_at, letter_at), (self.value_at, value_at), (self.letter_n, sizes[short]), (self.value_n, count[short]))
        ]
        order = np.argsort(joined[0], kind="stable")
        self.key, self.met, self.letter_at, self.value_at, self.letter_n, self.value_n = (a[order] for a in joined)
        self.letters, self.values = np.concatenate([self.letters, letters]), np.concatenate([self.values, values])


class TwoMemories:
    """A large memory and a small one that new pieces go to, so that few are moved."""

    def __init__(self, most_bytes: int | None = None):
        self.old = Memory(most_bytes)
        self.new = Memory(self.old.most // 8)
        self.new.seed = self.seed = self.old.seed

    def __len__(self) -> int:
        return len(self.old) + len(self.new)

    def bytes(self) -> int:
        return self.old.bytes() + self.new.bytes()

    def values(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, work: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat array, and where in it each piece's values begin and how many they
        are. ``work`` gets the numbers of unknown pieces and returns the same for them."""
        found = [memory.find(keys, data, starts, sizes) for memory in (self.old, self.new)]
        missing = np.flatnonzero((found[0] < 0) & (found[1] < 0))
        flat, at, count = work(missing) if len(missing) else (np.zeros(0, dtype=np.uint32), missing, missing)
        begin, n = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        begin[missing], n[missing] = at, count
        base = len(flat)
        for memory, rows in zip((self.old, self.new), found, strict=True):
            hit = np.flatnonzero(rows >= 0)
            begin[hit], n[hit] = base + memory.value_at[rows[hit]].astype(np.int64), memory.value_n[rows[hit]]
            base += len(memory.values)
        out = np.concatenate([flat, self.old.values, self.new.values])
        if len(missing):
            if self.new.bytes() > self.new.most // 2:
                fresh = self.new
                self.old.add(fresh.key, fresh.letters, fresh.letter_at.astype(np.int64), fresh.letter_n.astype(np.int64), fresh.values, fresh.value_at.astype(np.int64), fresh.value_n.astype(np.int64))
                fresh.clear()
            self.new.add(keys[missing], data, starts[missing], sizes[missing], flat, at, count)
        return out, begin, n


def alphabet() -> dict[str, int]:
    """The letter of a byte-level vocabulary for each byte: printable Latin-1 bytes
    stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def cuts_at_words(parts: dict) -> bool:
    """Whether the tokenizer (its JSON) is one whose texts may be cut into pieces:
    byte-level BPE with the usual pattern, without prefix space or normaliser, and
    added tokens without white space that take none around them."""
    split, model = parts.get("pre_tokenizer") or {}, parts["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    bpe = model["type"] == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
    tight = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in parts.get("added_tokens") or [])
    return bool(plain and bpe and tight and not parts.get("normalizer") and not parts.get("truncation") and not parts.get("padding"))


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library, and its tokens' bytes."""

    def __init__(self, path: str, special: bool = True):
        """``special``: whether a special token's string in a text is that token."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        parts = json.loads(self.tokenizer.to_str())
        self.cuts = cuts_at_words(parts)
        letters, added = alphabet(), {t["id"]: t["content"].encode() for t in parts.get("added_tokens") or []}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = added[i] if i in added else bytes(map(letters.get, token)) if letters.keys() >= set(token) else b""
        self.sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.array(found.ids, dtype=np.uint32) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[str]], Iterable], sizes: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of pieces: a flat array, where each piece's begin, how many they are.

    Pieces that begin with a space and don't end in white space (nor are marked in
    ``apart``) are put together and encoded at once; each one's ids are those up to
    where its bytes end. Others go one by one, and so do all if an end lies within a token (of a vocabulary
    that doesn't cover the bytes). ``sizes`` are the bytes of each id.
    """
    begin, count = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    joins = (data[starts] == 0x20) & (ends - starts > 1) & ~ends_blank(data, ends)
    if apart is not None:
        joins &= ~apart
    joined, flat = np.flatnonzero(joins), np.zeros(0, dtype=np.uint32)
    if len(joined):
        lengths = (ends - starts)[joined]
        ids = np.asarray(next(iter(encode([data[spans(starts[joined], lengths)].tobytes().decode()]))), dtype=np.uint32)
        stops, wanted = np.cumsum(sizes[ids]), np.cumsum(lengths)
        at = np.minimum(np.searchsorted(stops, wanted), len(stops) - 1)
        if len(stops) and stops[-1] == wanted[-1] and (sizes[ids] > 0).all() and (stops[at] == wanted).all():
            flat = ids
            begin[joined] = np.append(0, at[:-1] + 1)
            count[joined] = at + 1 - begin[joined]
        else:
            joins[:] = False
    alone = np.flatnonzero(~joins)
    if len(alone):
        found = [np.asarray(x, dtype=np.uint32) for x in encode([data[starts[k] : ends[k]].tobytes().decode() for k in alone])]
        count[alone] = [len(x) for x in found]
        begin[alone] = len(flat) + np.cumsum(count[alone]) - count[alone]
        flat = np.concatenate([flat, *found])
    return flat, begin, count
