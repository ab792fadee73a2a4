"""WARC archives under Zstandard: a writer, and a reader that takes nothing on trust.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself plain or compressed; every record is a frame of its own.
The reader loads the dictionary, finds each frame's end from its block
headers, decodes one frame a record, and checks version line, required
headers, lengths and digests.

Archives are rows of a table in the shared folder, of bounded size each, so
executors need no file system of their own. Of records with equal payloads
that with the smallest page_id is the response and the others revisit it;
rows that share this smallest page_id are all responses. A null html is an
empty payload, a null url gives no target header, a null page_id is a revisit
where its payload has a response with an id, else a response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import apart, stored

#: Magic numbers and the profile of a revisit by payload digest.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Parameters: an archive ends at so many records or payload bytes; the dictionary's size and training sample.
RECORDS, PAYLOAD, DICT_BYTES, DICT_SAMPLES = 1024, 4 << 20, 8192, 128
DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(urn: str) -> str | None:
    """The page id that a record id was made of."""
    m = re.fullmatch(r"<urn:page(?::([^>]*))?>", urn)
    if m is None:
        raise ValueError(f"not the id of a page: {urn!r}")
    return None if m[1] is None else unquote(m[1])


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of refers_to that holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records' frames behind a dictionary trained on a bounded sample of them, if they are enough to train one."""
    held, head = None, b""
    if len(records) >= 16:
        try:
            held = zstandard.train_dictionary(DICT_BYTES, [r[:16384] for r in records[:: max(1, len(records) // DICT_SAMPLES)]])
            packed = zstandard.ZstdCompressor(level=9).compress(held.as_bytes())
            head = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
        except zstandard.ZstdError:
            held = None
    c = zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=True, write_content_size=True)
    return head + b"".join([c.compress(r) for r in records])


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at `at` ends, by its header and block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    p = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if p + 3 > len(data):
            raise ValueError(f"the frame at {at} is cut short")
        h = int.from_bytes(data[p : p + 3], "little")
        p += 3 + (1 if h >> 1 & 3 == 1 else h >> 3)
        if h & 1:
            break
    p += 4 * (flags >> 2 & 1)
    if p > len(data):
        raise ValueError(f"the frame at {at} is cut short")
    return p


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each frame but the leading dictionary."""
    at, held = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        n = struct.unpack_from("<I", data, 4)[0]
        own = data[8 : 8 + n]
        if len(own) < n:
            raise ValueError("the dictionary is cut short")
        magic = struct.unpack_from("<I", own)[0]
        if magic == FRAME:
            own = zstandard.ZstdDecompressor().decompress(own)
        elif magic != DICTIONARY:
            raise ValueError("the leading frame holds no dictionary")
        held, at = zstandard.ZstdCompressionDict(own), 8 + n
    d = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 5 <= len(data) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME:
            raise ValueError(f"no frame begins at {at}")
        end = frame_end(data, at)
        yield d.decompressobj().decompress(data[at:end])
        at = end


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; ValueError if anything doesn't fit."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC/1.x record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ValueError(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ValueError(f"headers missing: {missing}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, not {n}")
    return headers, rest[:n]


def read(data: bytes) -> Iterator[tuple[str | None, int, str, str, str | None]]:
    """(page_id, payload_bytes, digest, type, refers_to) of the records of an archive, all checked."""
    for raw in frames(data):
        h, block = parse(raw)
        http, _, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        if not said:
            raise ValueError("the HTTP header has no length")
        n, digest = int(said[1]), h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] == "response":
            if len(payload) != n or payload_digest(payload) != digest:
                raise ValueError(f"payload of {h['warc-record-id']} doesn't match its headers")
            yield page_of(h["warc-record-id"]), n, digest, "response", None
        else:
            yield page_of(h["warc-record-id"]), n, digest, "revisit", page_of(h["warc-refers-to"])


def write_archives(pages: DataFrame) -> DataFrame:
    """archive binary: the pages' records, dedupe decided, in archives of bounded size."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    key = F.concat(F.sha1("payload"), F.xxhash64("payload").cast("string"))
    first = own.select("page_id", key.alias("k")).groupBy("k").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # payloads with one record need no partner, so only repeated ones are looked up
    marked = own.withColumn("k", key).join(apart(first), "k", "left").select(F.col("page_id").cast("string"), "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id").cast("string")).alias("refers_to"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for p, u, b, r in zip(*(batch.column(k) for k in range(4)), strict=True):
                b = b.as_py()
                held.append(record(p.as_py(), u.as_py(), b, r.as_py()))
                size += len(b)
                if len(held) >= RECORDS or size >= PAYLOAD:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["archive"])

    return marked.mapInArrow(run, "archive binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; ids are text."""
    L, S = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField("page_id", S), T.StructField("payload_bytes", L), T.StructField("payload_digest", S), T.StructField("record_type", S), T.StructField("refers_to", S)])
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = list(read(data.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.fieldNames())

    return archives.select("archive").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back."""
    kind = pages.schema["page_id"].dataType
    out = read_archives(stored(write_archives(pages), "warc"))
    return out.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def oracle() -> str:
    """The same in DuckDB; base 32 has five bits a letter, so four letters for five hexadecimal digits."""
    letters = "[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, j // 4 * 5 + 1, 5))::BIGINT >> (15 - j % 4 * 5)) & 31) + 1, 1) for j in range(32)]"
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    f AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload),
    r AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM p JOIN f USING (payload))
    SELECT page_id, payload_bytes, array_to_string({letters}, '') AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""
