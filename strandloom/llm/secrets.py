"""Secret scans with a worklist of decoded layers.

A text is scanned as it is. Its URL escapes are replaced, all together, and
its Unicode escapes; base64 is unwrapped, and gzip, zlib, bz2 and xz streams at
any byte of what it holds and of one another; each new layer is scanned and
unwrapped in turn until nothing new appears. Of layers inside one another one
is held at a time each, and compressed streams are read in pieces, anew for
what lies inside them where they are long, so nothing is written to disk.
Every character of a layer knows the stretch of the text that it came from,
so what is found in a layer is reported by its place in the text. A layer
seen before at the same place is not unwrapped again.

Null counts as an empty text and has no spans. Repeated rows each get their
row. Places are code points, the end exclusive.
"""

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from functools import partial
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import free, map_texts

#: The base patterns, the group and the least length that a match needs.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as [A-Z0-9]+ and 20 characters: a shorter rest of a run holds no longer match
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2})+|[^%]+|%")
ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]++(?:[\r\n]++[A-Za-z0-9+/_-]++)*+")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
PADDING = re.compile(r"={0,2}")
LEAST_RUN = 16
#: How a compressed stream starts.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0", re.DOTALL)
#: Bytes without any of these hold nothing: no pattern, escape, run of base64 or UTF-16.
TELLING = re.compile(rb"\0|AKIA|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)|%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|&#|[A-Za-z0-9+/_\r\n-]{16}")
SURROGATE = re.compile("[\ud800-\udfff]")
#: Bytes of a decoded layer that are scanned at once; a larger one is scanned whole, piece by piece.
MOST_UNPACKED = 1 << 20
#: Bytes of a stream inside another that are kept while the outer one is read; a longer one is read again by itself.
KEPT_INSIDE = 1 << 16
#: Bytes that a decompressor takes or gives at a time.
READ = 1 << 16
#: Characters that no pattern, escape or run of base64 holds.
BREAKS = [bytes([c]) for c in b",(){}[]<>!?|*~@$^`"]

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns in one layer."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text with the place in the root text that each of its characters came from."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))


def moved(layer: Layer, text: str, starts: np.ndarray, ends: np.ndarray) -> Layer:
    """A layer of text whose characters came from these places of layer."""
    starts, ends = starts.astype(np.int32), ends.astype(np.int32)
    return Layer(text, starts, ends) if layer.starts is None else Layer(text, layer.starts[starts], layer.ends[ends - 1])


def within(layer: Layer, text: str, a: int, b: int) -> Layer:
    """A layer of text that came as a whole from a stretch of layer."""
    a, b = layer.place(a, b)
    return Layer(text, np.broadcast_to(np.int32(a), len(text)), np.broadcast_to(np.int32(b), len(text)))


def build(layer: Layer, pieces: list[tuple[str, int, int]]) -> Layer:
    """A layer of (characters, start, end) in layer, each piece's characters from that stretch."""
    n, a, b = (np.array(x, np.int64) for x in ([len(s) for s, _, _ in pieces], [x for _, x, _ in pieces], [x for _, _, x in pieces]))
    same = np.repeat(n == b - a, n)  # character by character
    step = np.arange(len(same)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(a, n) + np.where(same, step, 0)
    return moved(layer, "".join([s for s, _, _ in pieces]), starts, np.where(same, starts + 1, np.repeat(b, n)))


def url_layers(layer: Layer):
    """The layer with all its URL escapes replaced: key and value of a secret may lie in different words."""
    text = layer.text
    if not PERCENT.search(text):
        return
    pieces = []
    for m in PERCENTS.finditer(text):
        if len(m[0]) < 3 or m[0][0] != "%":
            pieces.append((m[0], m.start(), m.end()))
            continue
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            at = m.start()
            for c in data.decode("utf-8"):
                n = 3 * len(c.encode("utf-8"))
                pieces.append((c, at, at + n))
                at += n
        except UnicodeDecodeError:
            pieces += [(chr(x), m.start() + 3 * k, m.start() + 3 * k + 3) for k, x in enumerate(data)]
    yield build(layer, pieces)


def unicode_layers(layer: Layer):
    """The layer with all its Unicode escapes replaced."""
    text = layer.text
    pieces, at = [], 0
    for m in ESCAPE.finditer(text):
        if m.start() > at:
            pieces.append((text[at : m.start()], at, m.start()))
        s = m[0]
        code = int(s[2:], 16) if s[0] == "\\" else int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
        low = 0xDC00 <= code < 0xE000 and pieces and pieces[-1][2] == m.start() and len(pieces[-1][0]) == 1 and 0xD800 <= ord(pieces[-1][0]) < 0xDC00
        if low:
            high = pieces.pop()
            pieces.append((chr(0x10000 + (ord(high[0]) - 0xD800 << 10) + code - 0xDC00), high[1], m.end()))
        else:
            pieces.append((chr(code) if code < 0x110000 else "�", m.start(), m.end()))
        at = m.end()
    if not at:
        return
    if at < len(text):
        pieces.append((text[at:], at, len(text)))
    yield build(layer, [("�" if len(s) == 1 and 0xD800 <= ord(s) < 0xE000 else s, x, y) for s, x, y in pieces])


def opened(head: bytes):
    """A decompressor for a stream that starts so, or None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 1 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\0" else None


def inflated(source: Iterator[bytes]):
    """(number of the member, bytes) in bounded pieces: all members of a stream, as far as they can be read."""
    rest, number = b"", 0
    while True:
        while len(rest) < 6 and (more := next(source, b"")):
            rest = (rest + more).lstrip(b"\0") if number else rest + more  # zero bytes may pad members
        d = opened(rest)
        if d is None:
            return
        try:
            while not d.eof:
                out = d.decompress(rest, READ)
                if out:
                    yield number, out
                if isinstance(d, bz2.BZ2Decompressor | lzma.LZMADecompressor):
                    rest, hungry = b"", d.needs_input
                else:
                    rest = d.unconsumed_tail
                    hungry = not rest and len(out) < READ
                if not d.eof and hungry:
                    rest = next(source, b"")
                    if not rest:
                        return
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        rest, number = d.unused_data.lstrip(b"\0"), number + 1


Source = Callable[[], Iterator[bytes]]


def pieces_read(data) -> Iterator[bytes]:
    """The bytes of a buffer, in pieces."""
    for k in range(0, len(data), READ):
        yield bytes(data[k : k + READ])


def unpacked(source: Source, at: int) -> Iterator[bytes]:
    """What all members of a compressed stream at a byte of a source hold."""
    def rest():
        skip = at
        for piece in source():
            if skip < len(piece):
                yield piece[skip:]
            skip = max(0, skip - len(piece))

    for _, out in inflated(rest()):
        yield out


class Streams:
    """Finds compressed streams at every byte of what is fed: by unpacking from each magic number on, as long as that goes well."""

    def __init__(self):
        self.live: dict[int, tuple] = {}
        self.found: dict[int, bytearray | None] = {}  # what a short stream holds; None for a longer one
        self.tail, self.at = b"", 0

    def feed(self, piece: bytes) -> None:
        for at, d in list(self.live.items()):
            if not self.more(at, d, piece):
                del self.live[at]
        data, before = self.tail + piece, self.at - len(self.tail)
        for m in MAGIC.finditer(data):
            if m.end() > len(self.tail) and (d := opened(data[m.start() : m.start() + 8])) and self.more(before + m.start(), d, data[m.start() :]):
                self.live[before + m.start()] = d
        self.tail, self.at = data[-5:], self.at + len(piece)

    def more(self, at: int, d, data: bytes) -> bool:
        """Whether a stream goes on after data."""
        try:
            while not d.eof:
                out = d.decompress(data, READ)
                held = self.found.setdefault(at, bytearray()) if out else None
                if held is not None:
                    held += out
                if self.found.get(at, b"") is None or len(self.found.get(at, b"")) > KEPT_INSIDE:
                    self.found[at] = None  # it will be read by itself
                    return False
                if isinstance(d, bz2.BZ2Decompressor | lzma.LZMADecompressor):
                    data, hungry = b"", d.needs_input
                else:
                    data = d.unconsumed_tail
                    hungry = not data and len(out) < READ
                if hungry and not d.eof:
                    return True
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return False
        if d.unused_data.lstrip(b"\0"):
            self.found[at] = None  # maybe more members
        return False


def opened_layers(source: Source, seen: set[bytes]) -> Iterator[bytes]:
    """The bytes of a source and of all streams inside one another in it, each in pieces that hold whole patterns. One that was seen is not opened again, as a stream may unpack to itself."""
    h, streams = hashlib.blake2b(), Streams()

    def fed():
        for piece in source():
            h.update(piece)
            streams.feed(piece)
            yield piece

    yield from cuts(fed())
    if h.digest() not in seen:
        seen.add(h.digest())
        for at, held in streams.found.items():
            yield from opened_layers(partial(unpacked, source, at) if held is None else partial(pieces_read, held), seen)


def cuts(read: Iterator[bytes]) -> Iterator[bytes]:
    """What is read in pieces of MOST_UNPACKED bytes and more, cut only where no pattern, escape or run of base64 can go on, so nothing is lost at a cut."""
    held = bytearray()
    for piece in read:
        new = max(0, len(held) - 2)
        held += piece
        if len(held) < MOST_UNPACKED:
            continue
        cut = max(held.rfind(b"\0\0\0", new) + 2 if b"\0\0\0" in held[new:] else 0, *(held.rfind(c, new) + 1 for c in BREAKS))
        if cut:
            yield bytes(held[:cut])
            del held[:cut]
    if held:
        yield bytes(held)


def readings(data: bytes):
    """(text, byte that each character starts at, byte that it ends at) of data: as UTF-8, bytes that are not by themselves, and with zero bytes as UTF-16."""
    s = data.decode("utf-8", "surrogateescape")
    code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
    alone = (code >= 0xDC80) & (code < 0xDD00)
    n = np.where(alone, 1, 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))
    ends = np.cumsum(n)
    yield SURROGATE.sub("\ufffd", s), ends - n, ends
    if b"\0" in data:
        for skip in (0, 1):
            size = (len(data) - skip) // 2
            at = skip + 2 * np.arange(size)
            for kind in ("<u2", ">u2"):
                code = np.frombuffer(data, kind, size, skip).astype("<u4")
                code = np.where((code >= 0xD800) & (code < 0xE000), 0xFFFD, code).astype("<u4")  # no pattern has them
                yield code.tobytes().decode("utf-32-le"), at, at + 2


def runs(text: str):
    """Places of the characters of each stretch that may hold base64: lines joined over line breaks, and each line by itself."""
    for m in BASE64.finditer(text):
        if m.end() - m.start() < LEAST_RUN:
            continue
        lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
        if sum(b - a for a, b in lines) >= LEAST_RUN:
            yield np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in lines])
        if len(lines) > 1:
            yield from (np.arange(a, b, dtype=np.int32) for a, b in lines if b - a >= LEAST_RUN)


def base64_layers(layer: Layer):
    """What base64 holds: a blob may follow other characters of its alphabet, so all four ways to group a stretch are tried, and a compressed stream is looked for at every byte."""
    text = layer.text
    for at in runs(text):
        core = "".join([text[k] for k in at]) if at[-1] - at[0] >= len(at) else text[at[0] : at[-1] + 1]
        core = core.replace("-", "+").replace("_", "/")
        last = PADDING.match(text, int(at[-1]) + 1).end()
        for skip in range(4):
            own = core[skip:]
            own = own[:-1] if len(own) % 4 == 1 else own
            data = base64.b64decode(own + "=" * (-len(own) % 4))
            streams = Streams()
            for piece in pieces_read(data):
                streams.feed(piece)
            source, seen = partial(pieces_read, data), set()
            for start, held in streams.found.items():
                x = int(at[skip + start * 4 // 3])
                for piece in opened_layers(partial(unpacked, source, start) if held is None else partial(pieces_read, held), seen):
                    if TELLING.search(piece):
                        for s, _, _ in readings(piece):
                            yield within(layer, s, x, last)
            before = 0
            for piece in cuts(pieces_read(data)):
                if TELLING.search(piece):
                    for s, starts, ends in readings(piece):
                        yield moved(layer, s, at[skip + (before + starts) * 4 // 3], at[skip - 1 - (-(before + ends) * 4 // 3)] + 1)
                before += len(piece)


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """base and what the layers add, by start and kind."""
    found, seen = set(base), set()
    work = [unwrapped(Layer(text))]  # layers inside one another, the innermost last
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        if not new.text:
            continue
        key = (hashlib.blake2b(new.text.encode("utf-8", "replace"), digest_size=16).digest(), *new.place(0, len(new.text)))
        if key in seen:
            continue
        seen.add(key)
        for a, kind, b in base_spans(new.text):
            x, y = new.place(a, b)
            found.add((x, kind, y))
        work.append(unwrapped(new))
    return sorted(found)


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """All layers right under one."""
    for decode in (url_layers, unicode_layers, base64_layers):
        yield from decode(layer)


def told(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    L, S = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField("n_assign", L), T.StructField("n_access", L), T.StructField("n_hex", L), T.StructField("base_sha256", S), T.StructField("spans", S)])

    def factory():
        def work(texts):
            out = [[], [], [], [], []]
            for t in texts:
                base = base_spans(t)
                for k in range(3):
                    out[k].append(sum(s[1] == k for s in base))
                out[3].append(hashlib.sha256(told(base).encode()).hexdigest())
                out[4].append(told(all_spans(t, base)))
            return out

        return work

    return map_texts(docs, factory, schema)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by mark."""
    out, at = [], 0
    joined: list[list[int]] = []
    for a, _, b in all_spans(text, base_spans(text)):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    for a, b in joined:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with secrets replaced in text and n_chars counted anew where text changed; null texts stay null."""
    @F.pandas_udf(T.StringType())
    def redact(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else redacted(t, mark))

    new = free(docs, "redacted")
    out = docs.withColumn(new, redact("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(new) == F.col("text"), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col(new)).select(*docs.columns)
