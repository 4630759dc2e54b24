"""Media columns: what bytes really are, and what other media lie inside them.

An Aho-Corasick automaton finds magic bytes (and end marks) in one pass over a value;
a validator per format follows the structure from there and gives the length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sparkrec.llm.common import slices, stored

# Fixed values of the formats.
MAGIC = {
    "riff": b"RIFF", "image/png": b"\x89PNG\r\n\x1a\n", "image/gif": b"GIF89a", "gif87": b"GIF87a",
    "image/jpeg": b"\xff\xd8\xff", "image/bmp": b"BM", "application/pdf": b"%PDF-", "application/zip": b"PK\x03\x04",
    "application/ogg": b"OggS", "end of jpeg": b"\xff\xd9", "end of pdf": b"%%EOF", "end of zip": b"PK\x05\x06",
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}
UNKNOWN = "application/octet-stream"
WAV_HEAD = 44
UNIT = 64
BYTES_AT_ONCE = 8_000_000

FOUND = "array<struct<type: string, start: bigint, length: bigint, depth: int>>"
_FOUND = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("depth", pa.int32())]))


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) % 2)
    return b"".join((
        struct.pack("<4sI4s", b"RIFF", WAV_HEAD - 8 + len(samples) + len(pad), b"WAVE"),
        struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8),
        struct.pack("<4sI", b"data", len(samples)), samples, pad))


def wav_samples(data: bytes, start: int, length: int) -> tuple[int, int] | None:
    """Place and number of the bytes in the data chunk of a WAV file."""
    at, end = start + 12, start + length
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return (at + 8, size) if at + 8 + size <= end else None
        at += 8 + size + size % 2
    return None


def _riff(data: bytes, at: int, ends: dict) -> tuple[str, int] | None:
    if at + 12 > len(data):
        return None
    size, kind = struct.unpack_from("<I4s", data, at + 4)
    if kind not in RIFF_TYPES or size < 4 or at + 8 + size > len(data):
        return None
    place, end = at + 12, at + 8 + size
    while place < end:  # its chunks fill it exactly
        if place + 8 > end:
            return None
        chunk = struct.unpack_from("<I", data, place + 4)[0]
        place += 8 + chunk + chunk % 2
    return (RIFF_TYPES[kind], 8 + size) if place in (end, end + 1) else None


def _png(data: bytes, at: int, ends: dict) -> tuple[str, int] | None:
    place, first = at + 8, True
    while place + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, place)
        if first and (name, size) != (b"IHDR", 13) or place + 12 + size > len(data):
            return None
        if zlib.crc32(memoryview(data)[place + 4:place + 8 + size]) != struct.unpack_from(">I", data, place + 8 + size)[0]:
            return None
        place, first = place + 12 + size, False
        if name == b"IEND":
            return "image/png", place - at
    return None


def _gif(data: bytes, at: int, ends: dict) -> tuple[str, int] | None:
    def blocks(p: int) -> int | None:
        while p < len(data):
            if not data[p]:
                return p + 1
            p += 1 + data[p]
        return None

    def colours(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 128 else 0

    if at + 13 > len(data):
        return None
    place: int | None = at + 13 + colours(data[at + 10])
    while place is not None and place < len(data):
        if data[place] == 0x3B:
            return "image/gif", place + 1 - at
        if data[place] == 0x21:
            place = blocks(place + 2)
        elif data[place] == 0x2C and place + 10 < len(data):
            place = blocks(place + 11 + colours(data[place + 9]))
        else:
            return None
    return None


def _next(places: list[int], at: int) -> int | None:
    i = bisect_left(places, at)
    return places[i] if i < len(places) else None


def _jpeg(data: bytes, at: int, ends: dict) -> tuple[str, int] | None:
    place = at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        marker, size = data[place + 1], struct.unpack_from(">H", data, place + 2)[0]
        if not 0xC0 <= marker <= 0xFE or 0xD0 <= marker <= 0xD9 or size < 2:
            return None
        place += 2 + size
        if marker == 0xDA:
            stop = _next(ends["end of jpeg"], place)
            return None if stop is None else ("image/jpeg", stop + 2 - at)
    return None


def _bmp(data: bytes, at: int, ends: dict) -> tuple[str, int] | None:
    if at + 30 > len(data):
        return None
    size, spare, pixels, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", data, at + 2)
    sound = (not spare and 14 + head <= pixels <= size and head in (40, 52, 56, 108, 124) and planes == 1
             and depth in (1, 4, 8, 16, 24, 32) and width > 0 and height and at + size <= len(data))
    if not sound or size < pixels + (width * depth + 31) // 32 * 4 * abs(height) and not data[at + 30]:
        return None
    return "image/bmp", size


def _pdf(data: bytes, at: int, ends: dict) -> tuple[str, int] | None:
    """To the last end mark before the next start, as each update of a file adds one."""
    stop, after = _next(ends["end of pdf"], at), _next(ends["start of pdf"], at + 1)
    if stop is None or not data[at + 5:at + 6].isdigit():
        return None
    until = len(ends["end of pdf"]) if after is None else bisect_left(ends["end of pdf"], after)
    if until and ends["end of pdf"][until - 1] > stop:
        stop = ends["end of pdf"][until - 1]
    return "application/pdf", stop + 5 - at


def _zip_ends(data: bytes, stops: list[int]) -> dict[int, int]:
    """For each place where an archive would begin, the first end record that fits it."""
    fits: dict[int, int] = {}
    for stop in stops:
        if stop + 22 <= len(data):
            size, offset, comment = struct.unpack_from("<IIH", data, stop + 12)
            central = data[stop - size:stop - size + 4] if size <= stop else b""
            if stop - size - offset >= 0 and central in (b"PK\x01\x02", b"PK\x05\x06") and stop + 22 + comment <= len(data):
                fits.setdefault(stop - size - offset, stop + 22 + comment)
    return fits


def _zip(data: bytes, at: int, ends: dict) -> tuple[str, int] | None:
    stop = ends["zip from"].get(at)
    return None if stop is None else ("application/zip", stop - at)


def _ogg(data: bytes, at: int, ends: dict) -> tuple[str, int] | None:
    place = at
    while data[place:place + 5] == b"OggS\0" and place + 27 <= len(data):
        lacing = data[place + 27:place + 27 + data[place + 26]]
        stop = place + 27 + data[place + 26] + sum(lacing)
        if len(lacing) < data[place + 26] or stop > len(data):
            return None
        last, place = data[place + 5] & 4, stop
        if last:
            return "application/ogg", place - at
    return None


VALIDATORS = {"riff": _riff, "image/png": _png, "image/gif": _gif, "gif87": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp,
              "application/pdf": _pdf, "application/zip": _zip, "application/ogg": _ogg}


def automaton():
    import ahocorasick

    tree = ahocorasick.Automaton()
    for name, magic in MAGIC.items():
        tree.add_word(magic.decode("latin-1"), (name, len(magic)))
    tree.make_automaton()
    return tree


def sniff(tree, data: bytes) -> list[dict]:
    """All media in `data` whose structure is sound, outer ones first. One that begins
    inside another must end there too; depth counts what is around it."""
    starts: list[tuple[int, str]] = []
    ends: dict = {"end of jpeg": [], "end of pdf": [], "end of zip": []}
    for last, (name, size) in tree.iter(data.decode("latin-1")):
        if name in ends:
            ends[name].append(last - size + 1)
        else:
            starts.append((last - size + 1, name))
    ends["start of pdf"] = sorted(at for at, name in starts if name == "application/pdf")
    ends["zip from"] = _zip_ends(data, ends["end of zip"])
    found: list[dict] = []
    around: list[int] = []
    for at, name in sorted(starts):
        while around and around[-1] <= at:
            around.pop()
        sound = VALIDATORS[name](data, at, ends)
        if sound and (not around or at + sound[1] <= around[-1]):
            found.append({"type": sound[0], "start": at, "length": sound[1], "depth": len(around)})
            around.append(at + sound[1])
    return found


def _actual(data: bytes, found: list[dict]) -> str:
    """The type of a value: what begins at its first byte, text if it is text, else unknown."""
    if found and found[0]["start"] == 0:
        return found[0]["type"]
    try:
        data.decode()
    except UnicodeDecodeError:
        return UNKNOWN
    return "text/plain" if b"\0" not in data else UNKNOWN


def inspect(df: DataFrame, data_col: str, declared_col: str | None = None, *, keep: tuple[str, ...] = (),
            carve: bool = False) -> DataFrame:
    """`keep`, actual_type, corrected (the declared type was another, or null), media_bytes,
    found, place and number of a WAV file's samples, features, digests (the payload is the
    samples, or else the whole value) and, with carve, the bytes of every medium inside
    (one that is the whole value left out).

    A null value has no type and nothing in it. An empty one is text. Repeated rows are
    inspected as often as they occur. Other columns are not read.
    """
    columns = {c: F.col(c) for c in keep}
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    rows = df.select(*columns.values(), declared.cast("string").alias("_declared"), F.col(data_col).cast("binary").alias("_data"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "actual_type string",
                        "corrected boolean", "media_bytes long", f"found {FOUND}", "samples_at long", "samples long",
                        "features string", "media_sha256 string", "payload_sha256 string", "tail_crc32 long",
                        *(["carved array<binary>"] if carve else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton()
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column("_data")), 0).to_pylist()
            for a, b in slices(whole, sizes, BYTES_AT_ONCE):
                batch = whole.slice(a, b - a)
                out = [_row(tree, v.as_py(), d.as_py(), carve) for v, d in zip(batch.column("_data"), batch.column("_declared"))]
                arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES[:None if carve else -1])]
                names = schema_names[len(keep):]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, *names])

    schema_names = [*keep, "actual_type", "corrected", "media_bytes", "found", "samples_at", "samples", "features",
                    "media_sha256", "payload_sha256", "tail_crc32", *(["carved"] if carve else [])]
    return rows.mapInArrow(run, schema)


_TYPES = [pa.string(), pa.bool_(), pa.int64(), _FOUND, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
          pa.int64(), pa.list_(pa.binary())]


def _row(tree, data: bytes | None, declared: str | None, carve: bool) -> tuple:
    if data is None:
        return (None,) * len(_TYPES)
    found = sniff(tree, data)
    actual = _actual(data, found)
    span = wav_samples(data, 0, found[0]["length"]) if actual == "audio/wav" else None
    payload = data[span[0]:span[0] + span[1]] if span else data
    inside = [f for f in found if f["start"] or f["length"] < len(data)]
    kinds = ",".join(f"{f['type']}@{f['start']}+{f['length']}" for f in inside)
    features = f"{actual};bytes={len(data)};distinct={len(set(payload))};ascii={int(payload.isascii())};inside={kinds}"
    return (actual, declared != actual, len(data), found, span[0] if span else None, span[1] if span else None, features,
            hashlib.sha256(data).hexdigest(), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
            [data[f["start"]:f["start"] + f["length"]] for f in inside] if carve else None)


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text with zeros up to a positive multiple of UNIT."""
    size = F.octet_length(text)
    to = F.greatest(F.ceil(size / UNIT), F.lit(1)) * UNIT
    return F.concat(text.cast("binary"), F.substring(F.lit(b"\0" * UNIT), F.lit(1), (to - size).cast("int")))


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared type and media: each text as the samples of a WAV file,
    stored. A third of the types are declared wrongly, by a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.element_at(F.array(*map(F.lit, ("audio/wav", "audio/wav", "image/png"))),
                                    (F.pmod(F.xxhash64(text), F.lit(3)) + 1).cast("int")).alias("declared"),
                       padded(text).alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole, pc.binary_length(whole.column("samples")).to_pylist(), BYTES_AT_ONCE):
                batch = whole.slice(a, b - a)
                media = pa.array([wav(x.as_py()) for x in batch.column("samples")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_bytes", "declared")), media],
                                                 names=["doc_id", "n_bytes", "declared", "media"])

    return stored(rows.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary"), "media")
