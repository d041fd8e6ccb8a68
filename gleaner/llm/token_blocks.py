"""Token ids in patched frame-of-reference blocks.

File format: a Parquet table with a row for each chunk of documents, in order.

    shard long         file order: chunks of a shard lie in one file
    chunk long         order within the shard
    start long         ids before this chunk in its shard
    n_ids long         ids of this chunk
    n_null long        documents without an id, the first of the chunk
    doc_ids binary     little-endian int64 of each document (0 for those without)
    ends binary        little-endian int64, ids of the chunk up to each document's end
    blocks binary      little-endian int64 byte offset of each block in payload
    payload binary     the blocks

A block holds ``BLOCK`` ids (the last one may hold fewer): a header of uint32
minimum, uint16 number of ids, uint8 width, uint8 zero, uint32 number of
exceptions; then ``width`` bit planes of the ids less the minimum, lowest bit
first, each of BLOCK / 8 bytes with the first id in the highest bit; then the
exceptions' positions (uint16) and what their high bits add (uint32, shifted
down by width). The width is that of the percentile of PERCENTILES that makes
the block smallest. Any document is found by its block, without reading others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gleaner.llm import shingles as S
from gleaner.llm.pieces import ByteLevel, TwoMemories, distinct, encode_pieces, piece_starts, spans

BLOCK = 1024
PERCENTILES = (75, 90, 95, 99, 100)
CHUNK_IDS = 1 << 18
HEADER = struct.Struct("<IHBBI")
#: Text that is encoded together; a longer text goes alone.
TOGETHER = 1 << 18


def bit_widths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The payload and the block offsets of uint32 ids."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, dtype=np.int64)
    count = -(-n // BLOCK)
    padded = np.full(count * BLOCK, ids[-1], dtype=np.uint32)
    padded[:n] = ids
    grid = padded.reshape(count, BLOCK)
    least = grid.min(axis=1)
    rest = grid - least[:, None]
    # how many ids of each block have up to so many bits
    cells = bit_widths(rest) + 33 * np.arange(count)[:, None]
    up_to = np.bincount(cells.ravel(), minlength=33 * count).reshape(count, 33).cumsum(axis=1)
    options = np.stack([(up_to <= min(BLOCK - 1, BLOCK * p // 100)).sum(axis=1) for p in PERCENTILES], axis=1)
    over = BLOCK - np.take_along_axis(up_to, options, axis=1)
    best = np.argmin(options * BLOCK // 8 + over * 6, axis=1)
    width = options[np.arange(count), best]
    planes: list = [[] for _ in range(count)]
    for b in range(int(width.max())):
        chosen = np.flatnonzero(width > b)
        bits = np.packbits(((rest[chosen] >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1)
        for row, k in enumerate(chosen):
            planes[k].append(bits[row].tobytes())
    high = rest >> width[:, None].astype(np.uint32)
    high[width >= 32] = 0
    out, offsets, at = [], np.zeros(count, dtype=np.int64), 0
    for k in range(count):
        size = min(BLOCK, n - k * BLOCK)
        where = np.flatnonzero(high[k, :size])
        block = b"".join([
            HEADER.pack(int(least[k]), size, int(width[k]), 0, len(where)), *planes[k],
            where.astype("<u2").tobytes(), high[k, where].astype("<u4").tobytes(),
        ])
        offsets[k] = at
        at += len(block)
        out.append(block)
    return b"".join(out), offsets


def unpack_blocks(payload: bytes | memoryview, at: np.ndarray) -> np.ndarray:
    """The ids of the blocks at byte offsets ``at``, one block after another."""
    heads = [HEADER.unpack_from(payload, int(a)) for a in at]
    widths, raw = np.array([h[2] for h in heads]), np.frombuffer(payload, dtype=np.uint8)
    values = np.zeros((len(at), BLOCK), dtype=np.uint32)
    for width in np.unique(widths[widths > 0]):
        chosen, span = np.flatnonzero(widths == width), int(width) * BLOCK // 8
        planes = np.concatenate([raw[a : a + span] for a in at[chosen] + HEADER.size])
        bits = np.unpackbits(planes).reshape(len(chosen), width, BLOCK)
        low = np.zeros((len(chosen), BLOCK, 4), dtype=np.uint8)
        for b in range(width):
            low[:, :, b // 8] |= bits[:, b] << np.uint8(b % 8)
        values[chosen] = low.view("<u4")[:, :, 0]
    for k, (_, _, width, _, extra) in enumerate(heads):
        if extra:
            start = int(at[k]) + HEADER.size + width * BLOCK // 8
            where = np.frombuffer(payload, dtype="<u2", count=extra, offset=start)
            values[k, where] |= np.frombuffer(payload, dtype="<u4", count=extra, offset=start + 2 * extra) << np.uint32(width)
    values += np.array([h[0] for h in heads], dtype=np.uint32)[:, None]
    return np.concatenate([values[:-1].ravel(), values[-1, : heads[-1][1]]])


def unpack(payload: bytes | memoryview, offsets: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive), reading only their blocks."""
    last = BLOCK * len(offsets) if last is None else last
    low, high = first // BLOCK, min(len(offsets), -(-last // BLOCK))
    if low >= high:
        return np.zeros(0, dtype=np.uint32)
    return unpack_blocks(payload, offsets[low:high])[first - low * BLOCK : last - low * BLOCK]


class Encoder:
    """Ids of texts by the tokenizers library, remembered by piece.

    The pieces of many texts (:mod:`gleaner.llm.pieces`) are looked up at once;
    unknown ones are encoded together. Texts of a tokenizer with another pattern
    are encoded whole.
    """

    def __init__(self, path: str, most_bytes: int | None = None):
        self.level = ByteLevel(path)
        self.known = TwoMemories(most_bytes)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian uint32; of null and empty ones none."""
        if not self.level.cuts:
            return [ids.astype("<u4").tobytes() for ids in self.level.encode([text or "" for text in texts.to_pylist()])]
        data, offsets = S.flat(texts)
        starts = piece_starts(data, offsets)
        if not len(starts):
            return [b""] * len(texts)
        ends = np.append(starts[1:], len(data))
        keys, at, of = distinct(data, starts, ends, self.known.seed)
        s, e = starts[at], ends[at]
        flat, begin, count = self.known.values(data, keys, s, e - s, lambda k: encode_pieces(data, s[k], e[k], self.level.encode, self.level.sizes))
        sizes = count[of]
        raw = flat[spans(begin[of], sizes)].astype("<u4").tobytes()
        stops = (4 * np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets)]).tolist()
        return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: words stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_chunks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Chunks of one shard, from its documents in order."""
    from pyspark import TaskContext

    shard, chunk, before = TaskContext.get().partitionId(), 0, 0
    known = encoder(path)
    tail = struct.pack("<I", end_id)
    docs: list[int | None] = []
    parts: list[bytes] = []
    ends: list[int] = []
    size = 0

    def close() -> pa.RecordBatch:
        payload, blocks = pack(np.frombuffer(b"".join(parts), dtype="<u4"))
        known_ids = np.array([d or 0 for d in docs], dtype="<i8")
        row = [shard, chunk, before, size, docs.count(None), known_ids.tobytes(), np.array(ends, dtype="<i8").tobytes(), blocks.astype("<i8").tobytes(), payload]
        kinds = [pa.int64()] * 5 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in CHUNKS.split(", ")])

    for batch in batches:
        for first, last in S.pieces(S.flat(batch.column(1))[1], TOGETHER):
            rows = batch.slice(first, last - first)
            for doc, ids in zip(rows.column(0).to_pylist(), known.encode_all(rows.column(1)), strict=True):
                docs.append(doc)
                parts.append(ids + tail)
                size += len(ids) // 4 + 1
                ends.append(size)
                if size >= CHUNK_IDS:
                    yield close()
                    chunk, before, size = chunk + 1, before + size, 0
                    docs, parts, ends = [], [], []
    if docs:
        yield close()


CHUNKS = "shard long, chunk long, start long, n_ids long, n_null long, doc_ids binary, ends binary, blocks binary, payload binary"


def write_token_file(docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None) -> None:
    """Encode every document and write the chunks in ascending id order.

    Documents are dealt to shards by ranges of ids; texts move once and are
    encoded where they are written. A null or empty text has the end id only, a
    long one may span many blocks. Rows that repeat an id follow one another;
    those without an id come first. Ids must be of an integer type (ValueError);
    other columns are not read. An empty table gives a file without chunks.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be of an integer type")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    count = shards or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(count, "id").sortWithinPartitions("id")
    ordered.mapInArrow(lambda batches: write_chunks(batches, tokenizer_path, end_id), CHUNKS).write.mode("overwrite").parquet(folder)


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard, start, n_null = (batch.column(k)[i].as_py() for k in (0, 1, 2))
            docs, ends, blocks = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype="<i8") for k in (3, 4, 5))
            ids = unpack(batch.column(6)[i].as_buffer(), blocks).astype("<u4")
            begins = np.concatenate([[0], ends[:-1]])
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs), shard)), pa.array(docs, mask=np.arange(len(docs)) < n_null), pa.array(begins + start), pa.array(ends - begins), pa.array(sums, pa.int64())],
                names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    ``start`` counts the ids of all documents before it: those of earlier shards,
    summed over one row for each shard, and those before it in its own.
    """
    chunks = spark.read.schema(CHUNKS).parquet(folder)
    sums = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    rows = chunks.select("shard", "start", "n_null", "doc_ids", "ends", "blocks", "payload").mapInArrow(
        read_rows, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
