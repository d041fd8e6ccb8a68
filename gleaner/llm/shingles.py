"""Word shingles of Arrow text columns, computed on whole byte buffers.

Words are runs of other bytes than ASCII white space with A-Z lowered; UTF-8
keeps every other character's bytes clear of those ranges. A word's hash is a
sum of its bytes mixed with their places, a shingle's hash chains its words' hashes.
Work goes in pieces of bounded bytes, so memory follows one document at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.arange(256, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_END = np.uint64(0xA0761D6478BD642F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most_bytes``, or of one row."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = max(first + 1, last)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    ink = ~_SPACE[data]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    fresh = np.empty(len(data), dtype=bool)
    fresh[0], fresh[1:] = True, ~ink[:-1]
    fresh[bounds] = True
    done = np.empty(len(data), dtype=bool)
    done[-1], done[:-1] = True, ~ink[1:]
    done[bounds - 1] = True
    starts = np.flatnonzero(ink & fresh)
    ends = np.flatnonzero(ink & done) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUE, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each span, ``values`` standing for them (A-Z as a-z).

    Every byte is mixed with its place in the span and the seed, and the sum is
    mixed again: no word's letters cancel out as a polynomial's do. Who knows the
    seed can still build collisions, so equal hashes prove nothing by themselves.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    first, salt = 0, mix64(np.array([seed], dtype=np.uint64) ^ _END)[0]
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE_BYTES, side="right")))
        s, e = starts[first:last], ends[first:last]
        sizes = e - s
        stops = np.cumsum(sizes)
        place = np.arange(stops[-1]) - np.repeat(stops - sizes, sizes)
        letters = values[data[place + np.repeat(s, sizes)]]
        sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum(mix64((place.astype(np.uint64) << np.uint64(8)) + letters + salt), out=sums[1:])
        out[first:last] = sums[stops] - sums[stops - sizes] + sizes.astype(np.uint64)
        first = last
    return mix64(out ^ salt)


def row_shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of ``width`` words, in order.

    A row with fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    starts, ends, rows = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, seed=seed)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    n = len(words)
    if n >= width:
        total = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            total = mix64(total + words[k : n - width + 1 + k])
        same = rows[: n - width + 1] == rows[width - 1 :]
        hashes, owners = total[same], rows[: n - width + 1][same]
    else:
        hashes, owners = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(rows, short)
        total = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            total[has] = mix64(total[has] + words[begin[has] + k])
        hashes = np.concatenate([hashes, mix64(total ^ _END)])
        owners = np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, owners


def distinct_sets(hashes: np.ndarray, owners: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, sorted within the row, and row offsets."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        new = np.empty(len(hashes), dtype=bool)
        new[0] = True
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[new], owners[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n_rows))])


_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_list(text: str | None) -> list[bytes]:
    """The words of one text as bytes, for checks on few texts."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def shingle_set(text: str | None, width: int = 5) -> set[bytes]:
    """The exact shingles of one text."""
    words = word_list(text)
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
