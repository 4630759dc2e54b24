"""Token ids on disk in patched frame-of-reference blocks.

A segment, little-endian:
  magic "PFR1", number of documents, ids, blocks and bytes of blocks (4 x u32)
  doc_id (i64 each), whether it is null (u8 each), number of ids (u32 each)
  start of each block from the first block on (u32 each)
  blocks: minimum (u32), width (u8), exceptions (u16), BLOCK values less the minimum in
  `width` bits each, places of the exceptions (u16 each), their upper bits (u32 each)
The last block is filled with its last id. A segment ends with a document, once it has
SEGMENT_IDS ids; its row in the table says what partition and place it has.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkrec.llm.common import documents, stored, with_base
from sparkrec.llm.tokens import encoder

BLOCK = 256
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18
_HEAD = "<4s4I"
_HEAD_SIZE = struct.calcsize(_HEAD)
_BLOCK_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])

SEGMENT_SCHEMA = "part int, segment long, start long, n_ids long, payload binary"


def _bits(n: np.ndarray) -> np.ndarray:
    """How many bits each number below 2^32 needs."""
    return np.frexp(n.astype(np.float64))[1].astype(np.uint8)


def encode_blocks(values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks, and the blocks."""
    if not len(values):
        return np.zeros(0, dtype="<u4"), b""
    full = np.pad(values.astype(np.uint32), (0, -len(values) % BLOCK), mode="edge").reshape(-1, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    k = int(PERCENTILE * (BLOCK - 1))
    width = _bits(np.partition(rest, k, axis=1)[:, k])
    shifted = np.where(width[:, None] < 32, rest >> np.minimum(width, 31)[:, None], 0).astype("<u4")
    outliers = np.count_nonzero(shifted, axis=1)
    size = _BLOCK_HEAD.itemsize
    sizes = size + BLOCK // 8 * width.astype(np.int64) + 6 * outliers
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.uint8)
    heads = np.empty(len(full), dtype=_BLOCK_HEAD)
    heads["least"], heads["width"], heads["exceptions"] = least, width, outliers
    out[starts[:, None] + np.arange(size)] = heads.view(np.uint8).reshape(-1, size)
    for w in np.unique(width[width > 0]).tolist():
        chosen, n = np.flatnonzero(width == w), -(-w // 8)
        low = rest[chosen].astype(">u4").view(np.uint8).reshape(len(chosen), BLOCK, 4)[:, :, 4 - n:]
        bits = np.unpackbits(low, axis=2)[:, :, 8 * n - w:]
        out[starts[chosen, None] + size + np.arange(BLOCK * w // 8)] = np.packbits(bits.reshape(len(chosen), -1), axis=1)
    block, at = np.nonzero(shifted)
    first = starts[block] + size + BLOCK // 8 * width[block].astype(np.int64)
    nth = np.arange(len(block)) - (np.cumsum(outliers) - outliers)[block]
    out[(first + 2 * nth)[:, None] + np.arange(2)] = at.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[(first + 2 * outliers[block] + 4 * nth)[:, None] + np.arange(4)] = shifted[block, at].view(np.uint8).reshape(-1, 4)
    return starts.astype("<u4"), out.tobytes()


def decode_blocks(starts: np.ndarray, data: bytes, n: int) -> np.ndarray:
    """The `n` values of the blocks that begin at `starts`."""
    out = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    raw = np.frombuffer(data, dtype=np.uint8)
    size = _BLOCK_HEAD.itemsize
    heads = raw[starts[:, None].astype(np.int64) + np.arange(size)].copy().view(_BLOCK_HEAD).reshape(-1)
    for w in np.unique(heads["width"]).tolist():
        chosen = np.flatnonzero(heads["width"] == w)
        if w:
            places = starts[chosen, None].astype(np.int64) + size + np.arange(BLOCK * w // 8)
            wholes = -(-w // 8)
            wide = np.zeros((len(chosen), BLOCK, 8 * wholes), dtype=np.uint8)
            wide[:, :, 8 * wholes - w:] = np.unpackbits(raw[places], axis=1).reshape(len(chosen), BLOCK, w)
            full = np.zeros((len(chosen), BLOCK, 4), dtype=np.uint8)
            full[:, :, 4 - wholes:] = np.packbits(wide, axis=2)
            out[chosen] = full.view(">u4").reshape(len(chosen), BLOCK)
    for i in np.flatnonzero(heads["exceptions"]).tolist():
        w, k = int(heads["width"][i]), int(heads["exceptions"][i])
        at = int(starts[i]) + size + BLOCK * w // 8
        out[i, np.frombuffer(data, "<u2", k, at)] |= np.frombuffer(data, "<u4", k, at + 2 * k) << np.uint32(w)
    out += heads["least"][:, None]
    return out.reshape(-1)[:n]


def encode_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One segment of documents, each given by its id and its little-endian 32-bit ids."""
    values = np.frombuffer(b"".join(ids), dtype="<u4")
    starts, blocks = encode_blocks(values)
    return b"".join((
        struct.pack(_HEAD, b"PFR1", len(ids), len(values), len(starts), len(blocks)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array([len(x) // 4 for x in ids], dtype="<u4").tobytes(), starts.tobytes(), blocks))


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids."""
    magic, docs, n, blocks, size = struct.unpack_from(_HEAD, data)
    if magic != b"PFR1":
        raise ValueError("not a segment of ids")
    at = _HEAD_SIZE
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(data, "<u4", blocks, at + 13 * docs)
    body = data[at + 13 * docs + 4 * blocks:][:size]
    return [None if x else d for d, x in zip(doc_ids.tolist(), null)], counts, decode_blocks(starts, body, n)


def read_range(data: bytes, first: int, n: int) -> np.ndarray:
    """`n` ids of a segment from place `first` on; decodes only the blocks that hold them."""
    _, docs, total, blocks, size = struct.unpack_from(_HEAD, data)
    at = _HEAD_SIZE + 13 * docs
    n = max(0, min(n, total - first))
    if not n:
        return np.zeros(0, dtype=np.uint32)
    low, high = first // BLOCK, (first + n - 1) // BLOCK + 1
    starts = np.frombuffer(data, "<u4", blocks, at)[low:high]
    body = data[at + 4 * blocks:][:size]
    return decode_blocks(starts, body, (high - low) * BLOCK)[first - low * BLOCK:][:n]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, *,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write their ids to `path`, in ascending order of doc_id.

    Documents are dealt out by ranges of the id (and a hash of the text, so that even one
    id on very many rows is split), sorted inside, encoded and packed by each task. A
    null text counts as empty, a null id comes first, equal ids follow the hash and then
    the text. An empty table writes no segment. Other columns are not read.
    """
    tail = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = segment = start = 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": [segment], "start": [start], "n_ids": [held],
                "payload": pa.array([encode_segment(doc_ids, ids)], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                doc_ids.append(doc_id)
                ids.append(encode_text(text.as_py()) + tail)
                held += len(ids[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield packed()
                    segment, start, held, doc_ids, ids = segment + 1, start + held, 0, [], []
        if ids:
            yield packed()

    rows = documents(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    stored(ordered.select("doc_id", "text").mapInArrow(segments, SEGMENT_SCHEMA), "ids", path)


def read_ids(spark: SparkSession, path: str, *, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 per document,
    from what `write_ids` wrote; with keep_ids also its little-endian 32-bit ids."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts, values = decode_segment(batch.column("payload")[i].as_py())
                data, ends = values.astype("<u4").tobytes(), np.cumsum(counts.astype(np.int64))
                starts = ends - counts
                own = [data[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(starts + batch.column("at")[i].as_py()),
                    pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    *([pa.array(own, pa.binary())] if keep_ids else []),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])])

    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    placed = with_base(table, "part", F.col("n_ids"), "base")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return placed.select((F.col("base") + F.col("start")).alias("at"), "payload").mapInArrow(unpack, schema)
