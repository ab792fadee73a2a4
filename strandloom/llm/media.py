"""ISO media containers: writing texts into them and probing containers without decoding payloads.

The probe walks nested boxes, decodes the sample tables, and the runs of movie
fragments, and returns codec, duration, sample and chunk counts, the byte
ranges of the payload and those of the keyframes. The writer stores a payload as a raw 8-bit video track of 8x8
grey frames, so a frame is 64 bytes and storing is lossless.

Null counts as an empty text; an empty text is stored as one frame of zeros.
A container that is cut short or damaged gives an error field instead of an
exception. Repeated rows each get their row, equal texts equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.llm.common import map_texts

FRAME = 64
#: Parameters of the writer.
RATE, KEY_EVERY, CHUNK_FRAMES = 25, 16, 128
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Flags of a track fragment, of a run and of a sample.
BASE, DEFAULT_INDEX, DEFAULT_DURATION, DEFAULT_SIZE, DEFAULT_FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
DATA_OFFSET, FIRST_FLAGS, DURATIONS, SIZES, FLAGS, TIMES = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_KEY = 0x10000


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    """With zeros up to a positive multiple of a frame."""
    return data + b"\0" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def write(payload: bytes) -> bytes:
    """A container with one raw grey 8x8 track; the payload's length is a positive multiple of 64."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK_FRAMES)
    full_chunks, rest = divmod(n, CHUNK_FRAMES)
    to_chunk = ([(1, CHUNK_FRAMES)] if full_chunks else []) + ([(full_chunks + 1, rest)] if rest else [])
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")

    def moov(base: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", -(-n // KEY_EVERY)), np.arange(1, n + 1, KEY_EVERY, dtype=">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(to_chunk)), *(struct.pack(">III", a, k, 1) for a, k in to_chunk)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64", struct.pack(">I", chunks), (base + np.arange(chunks, dtype=">u8") * (FRAME * CHUNK_FRAMES)).astype(">u8").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"grey\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    lead = 8 if len(payload) + 8 <= 0xFFFFFFFF else 16
    base = len(head) + len(moov(0)) + lead
    return head + moov(base) + box(b"mdat", payload)


@dataclass
class Track:
    """What the sample tables of a track say; offsets and sizes are those of its samples in the file."""

    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tables: dict = field(default_factory=dict)

    def ranges(self, only_keys: bool = False) -> list[tuple[int, int]]:
        """Byte ranges (start, end) in the order of the samples, neighbours joined."""
        a, s = (self.offsets[self.keys], self.sizes[self.keys]) if only_keys else (self.offsets, self.sizes)
        if not len(a):
            return []
        cut = np.flatnonzero(a[1:] != a[:-1] + s[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]]) - 1
        return list(zip(a[first].tolist(), (a[last] + s[last]).tolist(), strict=True))


def boxes(data: bytes, start: int, end: int):
    """(kind, body start, body end) of the boxes in data[start:end]."""
    while start < end:
        if end - start < 8:
            raise ValueError(f"a box header is cut short at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        yield kind, body, start + size
        start += size


def probe(data: bytes) -> list[Track]:
    """The tracks of a container. Only headers and tables are read, never payload bytes; ValueError if they cannot be."""
    try:
        return Probe(data).tracks
    except (struct.error, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(f"damaged: {e}") from e


class Probe:
    def __init__(self, data: bytes):
        self.data, self.tracks = data, []
        self.ids: dict[int, Track] = {}  # tracks and their defaults by number
        self.defaults: dict[int, tuple[int, int, int]] = {}
        self.runs: dict[int, list[np.ndarray]] = {}  # offset, size, key by track
        self.now = (0, 0, 0, 0, 0)  # the fragment's track, next offset, defaults
        self.moof = 0
        self.walk(0, len(data))
        for t in self.tracks:
            self.finish(t)
        for number, runs in self.runs.items():
            t = self.ids[number]
            rows = np.concatenate(runs)
            t.keys = np.concatenate([t.keys, len(t.sizes) + np.flatnonzero(rows[:, 2])])
            t.offsets, t.sizes = np.concatenate([t.offsets, rows[:, 0]]), np.concatenate([t.sizes, rows[:, 1]])
        for t in self.tracks:
            if len(t.offsets) and (t.offsets.min() < 0 or t.sizes.min() < 0 or (t.offsets + t.sizes).max() > len(data)):
                raise ValueError("a sample lies outside the file")

    def numbers(self, kind: str, at: int, end: int) -> tuple[int, ...]:
        if at + struct.calcsize(kind) > end:
            raise ValueError(f"a box is cut short at {at}")
        return struct.unpack_from(kind, self.data, at)

    def rows(self, a: int, n: int, width: int, end: int, kind: str = ">u4") -> np.ndarray:
        if a + n * width * int(kind[-1]) > end:
            raise ValueError(f"a table at {a} is cut short")
        return np.frombuffer(self.data, kind, n * width, a).astype(np.int64).reshape(n, width)

    def walk(self, start: int, end: int, depth: int = 0) -> None:
        if depth > 16:
            raise ValueError("boxes are nested too deep")
        for kind, a, b in boxes(self.data, start, end):
            if kind == b"trak":
                self.tracks.append(Track())
            if kind == b"moof":
                self.moof = a - 8 if struct.unpack_from(">I", self.data, a - 8)[0] != 1 else a - 16
            if kind in NESTED:
                self.walk(a, b, depth + 1)
            elif kind in (b"trex", b"tfhd", b"trun"):
                self.fragment(kind, a, b)
            elif self.tracks:
                self.table(self.tracks[-1], kind, a, b)

    def table(self, t: Track, kind: bytes, a: int, b: int) -> None:
        data = self.data
        if kind == b"tkhd":
            self.ids[self.numbers(">I", a + (20 if data[a] == 1 else 12), b)[0]] = t
        elif kind == b"mdhd":
            t.timescale, t.duration = self.numbers(">IQ", a + 20, b) if self.numbers(">B", a, b)[0] == 1 else self.numbers(">II", a + 12, b)
        elif kind == b"hdlr":
            t.handler = data[a + 8 : min(a + 12, b)].decode("latin-1")
        elif kind == b"stsd":
            if self.numbers(">I", a + 4, b)[0]:
                t.codec = data[a + 12 : min(a + 16, b)].decode("latin-1")
                if t.handler == "vide":
                    t.width, t.height = self.numbers(">HH", a + 40, b)
        elif kind == b"stsz":
            one, n = self.numbers(">II", a + 4, b)
            if one and n * one > len(data):
                raise ValueError("the samples are larger than the file")
            t.sizes = np.full(n, one, np.int64) if one else self.rows(a + 12, n, 1, b)[:, 0]
        elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
            n = self.numbers(">I", a + 4, b)[0]
            t.tables[kind] = self.rows(a + 8, n, {b"stts": 2, b"stsc": 3}.get(kind, 1), b, ">u8" if kind == b"co64" else ">u4")

    def fragment(self, kind: bytes, a: int, b: int) -> None:
        """Defaults of a track, those of its fragment, and the samples of a run."""
        flags = self.numbers(">I", a, b)[0] & 0xFFFFFF
        if kind == b"trex":
            number, _, *own = self.numbers(">IIIII", a + 4, b)
            self.defaults[number] = tuple(own)
            return
        at = a + 4
        if kind == b"tfhd":
            number = self.numbers(">I", at, b)[0]
            at, base = at + 4, self.moof
            if flags & BASE:
                base, at = self.numbers(">Q", at, b)[0], at + 8
            at += 4 * bool(flags & DEFAULT_INDEX)
            own = list(self.defaults.get(number, (0, 0, 0)))
            for k, flag in enumerate((DEFAULT_DURATION, DEFAULT_SIZE, DEFAULT_FLAGS)):
                if flags & flag:
                    own[k], at = self.numbers(">I", at, b)[0], at + 4
            self.base = base
            self.now = (number, base, *own)
            return
        number, offset, duration, size, marks = self.now
        t = self.ids.get(number)
        if t is None:
            raise ValueError(f"a fragment of no track: {number}")
        n, at = self.numbers(">I", at, b)[0], at + 4
        if flags & DATA_OFFSET:
            offset, at = self.base + self.numbers(">i", at, b)[0], at + 4
        first = None
        if flags & FIRST_FLAGS:
            first, at = self.numbers(">I", at, b)[0], at + 4
        there = [f for f in (DURATIONS, SIZES, FLAGS, TIMES) if flags & f]
        if not there and n * max(1, size) > len(self.data):
            raise ValueError("a run is larger than the file")
        held = self.rows(at, n, len(there), b) if there else np.zeros((n, 0), np.int64)
        column = lambda f, else_: held[:, there.index(f)] if f in there else np.full(n, else_, np.int64)
        sizes, key = column(SIZES, size), column(FLAGS, marks) & NOT_KEY == 0
        if first is not None and n:
            key[0] = first & NOT_KEY == 0
        starts = offset + np.cumsum(sizes) - sizes
        self.runs.setdefault(number, []).append(np.stack([starts, sizes, key.astype(np.int64)], axis=1))
        t.duration += int(column(DURATIONS, duration).sum())
        self.now = (number, offset + int(sizes.sum()), duration, size, marks)

    def finish(self, t: Track) -> None:
        """Offsets, duration and keyframes from the tables of a track."""
        n = len(t.sizes)
        starts = t.tables.get(b"co64", t.tables.get(b"stco", np.zeros((0, 1), np.int64)))[:, 0]
        runs = t.tables.get(b"stsc", np.zeros((0, 3), np.int64))
        if n:
            if not len(starts) or not len(runs):
                raise ValueError("samples without chunks")
            until = np.append(runs[1:, 0], len(starts) + 1)
            if runs[0, 0] != 1 or (until <= runs[:, 0]).any():
                raise ValueError("the runs of chunks are out of order")
            per = np.minimum(np.repeat(runs[:, 1], until - runs[:, 0]), n)
            if per.sum() < n:
                raise ValueError("the chunks hold fewer samples than stsz")
            chunk = np.searchsorted(np.cumsum(per), np.arange(n), side="right")
            ahead = np.cumsum(t.sizes) - t.sizes
            first = np.searchsorted(chunk, np.arange(len(per)))
            t.offsets = starts[chunk] + ahead - ahead[np.minimum(first, n - 1)][chunk]
        held = t.tables.get(b"stts")
        if held is not None and not t.duration:
            t.duration = int((held[:, 0] * held[:, 1]).sum())
        keys = t.tables.get(b"stss")
        t.keys = np.arange(n) if keys is None else keys[:, 0] - 1
        if len(t.keys) and (t.keys.min() < 0 or t.keys.max() >= n):
            raise ValueError("a keyframe is no sample")


def extract(data: bytes, track: Track) -> bytes:
    """The payload bytes of a track, in the order of its samples."""
    return b"".join(data[a:b] for a, b in track.ranges())


def describe(data: bytes, track: Track) -> str:
    """codec, size, duration in seconds, samples, keyframes and a digest of the keyframes' byte ranges."""
    keys = track.ranges(only_keys=True)
    told = ",".join(f"{a}-{b}" for a, b in keys)
    return (
        f"codec={track.codec.strip()};size={track.width}x{track.height};seconds={track.duration / max(1, track.timescale):.3f};samples={len(track.sizes)};"
        f"keyframes={len(track.keys)};first_key={f'{keys[0][0]}-{keys[0][1]}' if keys else ''};key_ranges={zlib.crc32(told.encode()):08x}"
    )


def probe_media(media: DataFrame, key: str = "media_id", data: str = "data") -> DataFrame:
    """A row per container: codec, timescale, duration, samples and keyframe byte ranges of its first track, or an error."""
    pair = T.ArrayType(T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField(key, media.schema[key].dataType), T.StructField("codec", T.StringType()), T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("key_ranges", pair), T.StructField("error", T.StringType())])

    kinds = [f.type for f in to_arrow_schema(schema)]

    def one(blob):
        try:
            tracks = probe(blob) if blob is not None else []
            t = tracks[0] if tracks else None
            return (t.codec, t.timescale, t.duration, len(t.sizes), [list(x) for x in t.ranges(True)], None) if t else (None,) * 5 + ("no track",)
        except ValueError as e:
            return (None,) * 5 + (str(e),)

    def run(batches):
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(1)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]), *(pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))], names=schema.fieldNames())

    return media.select(key, F.col(data).cast("binary")).mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text in a container, probe it, read the payload back and compare digests; key_ranges: [start, end) of each keyframe's bytes."""
    L, S = T.LongType(), T.StringType()
    names = [("n_bytes", L), ("payload_bytes", L), ("payload_sha256", S), ("tail_crc32", L), ("media_bytes", L), ("media_sha256", S), ("feature", S), ("key_ranges", T.ArrayType(T.ArrayType(L)))]

    def factory():
        def work(texts):
            out = [[] for _ in names]
            for t in texts:
                raw = t.encode("utf-8")
                media = write(padded(raw))
                track = probe(media)[0]
                back = extract(media, track)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), describe(media, track), [list(x) for x in track.ranges(True)])
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            return out

        return work

    return map_texts(docs, factory, T.StructType([T.StructField(n, k) for n, k in names]))
