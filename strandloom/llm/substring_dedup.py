"""Removal of passages that stand in an earlier document too.

A window is `words` consecutive words of a document (maximal stretches without
the six ASCII white spaces, unchanged), with a Rabin-Karp hash: a polynomial in
the 64-bit hashes of its words, modulo 2**64. A word goes if a window over it
also starts in a document with a smaller doc_id. Windows are judged on the
input. Two different windows of a corpus share a hash with a chance of about
n**2 / 2**65 for n windows.

Every window is counted. Each task first works through chunks of documents:
only the smallest id of a chunk that holds a hash is a question for the others,
so a window found everywhere is shuffled once a chunk and not once a place; the
rest is decided on the spot. Questions travel as packed arrays, one row a chunk
and part of the hashes, and so do the answers. Those to a chunk meet what it
decided itself, and neighbouring windows of a document merge into maximal
intervals.

Null texts have no words. A null doc_id counts as larger than all others; of
equal ids none is smaller, also in repeated rows, which get the same result
each. Documents of fewer words lose none. Rows are told apart by id and text,
so other columns, whatever their names, don't matter. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import apart

WORDS = 13
#: Odd, so that no power of it vanishes modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows that a task works through together, about; one document may hold more.
CHUNK = 1_000_000
#: Distinct words whose hashes a worker keeps.
KEPT = 200_000
#: Stands for a null id.
LAST = (1 << 63) - 1
#: docs, sizes and steps tell places: documents of the chunk, how many windows each, and the steps between them.
ANSWERS = "chunk long, docs binary, sizes binary, steps binary, keys binary, rows binary"
QUESTIONS = f"part int, {ANSWERS}, hashes binary"
PLACES = "key long, row long, starts array<int>, ends array<int>"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KEPT:
            self.clear()
        self[word] = h
        return h


def rolling(own: list[bytes], known: WordHashes, words: int) -> np.ndarray:
    """The hash of the window that begins at each word."""
    if len(own) < words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
    n = len(own) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out *= BASE
        out += h[k : k + n]
    return out


def packed(x: np.ndarray) -> bytes:
    """The bytes of numbers by significance, so that the shuffle's compression takes out those that hardly change."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unpacked(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [start, end) of ascending places."""
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


def by_run(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def equal_runs(values: np.ndarray) -> zip:
    """(begin, end) of each run of equal values."""
    first = by_run(values)
    return zip(first, np.append(first[1:], len(values))[: len(first)], strict=True)


def told(doc: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places, ascending by document, as docs, sizes and steps."""
    first = by_run(doc)
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    return tuple(packed(x.astype(np.uint32)) for x in (doc[first], np.diff(np.append(first, len(doc))), step))


def heard(docs: bytes, sizes: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What told() packed, and how many documents precede each place."""
    doc, size, step = (unpacked(x, np.uint32).astype(np.int64) for x in (docs, sizes, steps))
    at = np.repeat(np.arange(len(doc)), size)
    upto = np.cumsum(step)
    first = np.cumsum(size) - size
    return doc[at], upto - (upto[first] - step[first])[at] if len(at) else upto, at


def ask(parts: int, words: int):
    """(key, row, text) -> QUESTIONS, and for each chunk a row without hashes: keys and rows of its documents, and the places it decided."""

    def chunk(number: int, keys: list[int], rows: list[int], hashes: list[np.ndarray]):
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        key, row = np.array(keys, np.int64)[order], np.array(rows, np.int64)[order]
        size = np.array([len(hashes[k]) for k in order], np.int64)
        h = np.concatenate([hashes[k] for k in order])
        doc = np.repeat(np.arange(len(key), dtype=np.int32), size)
        place = (np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        rank = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int32)[doc]  # equal ids, equal ranks
        by_hash = np.argsort(h)
        first = by_run(h[by_hash])
        count = np.diff(np.append(first, len(h)))
        later = np.zeros(len(h), bool)
        later[by_hash] = rank[by_hash] > np.repeat(np.minimum.reduceat(rank[by_hash], first), count)
        # of a window that a document repeats the first place is asked for
        again = np.zeros(len(h), bool)
        many = by_hash[np.repeat(count > 1, count)]
        many = many[np.lexsort((many, doc[many], h[many]))]
        again[many[1:][(h[many[1:]] == h[many[:-1]]) & (doc[many[1:]] == doc[many[:-1]])]] = True
        gone = np.flatnonzero(later)
        yield number % parts, number, *told(doc[gone], place[gone]), packed(key), packed(row), None
        asked = np.flatnonzero(~later & ~again)
        part = (((h[asked] * BASE) >> np.uint64(40)) % np.uint64(parts)).astype(np.uint32)
        by_part = np.argsort(part, kind="stable")
        for a, b in equal_runs(part[by_part]):
            at = asked[by_part[a:b]]
            yield int(part[by_part[a]]), number, *told(doc[at], place[at]), packed(key[doc[at][by_run(doc[at])]]), b"", h[at].tobytes()

    def run(batches):
        known = WordHashes()
        number = TaskContext.get().partitionId() << 32
        keys, rows, hashes, held = [], [], [], 0
        for batch in batches:
            for key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = rolling((text.as_py() or "").encode("utf-8").split(), known, words)
                if len(h):
                    keys.append(key)
                    rows.append(row)
                    hashes.append(h)
                    held += len(h)
                if held >= CHUNK:
                    yield from as_batches(chunk(number, keys, rows, hashes), QUESTIONS)
                    keys, rows, hashes, held, number = [], [], [], 0, number + 1
        if keys:
            yield from as_batches(chunk(number, keys, rows, hashes), QUESTIONS)

    return run


def as_batches(rows, schema: str, most: int = 1 << 24):
    """Rows in batches of about `most` bytes."""
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[k] for k in kinds]
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(types)], names=names)

    for r in rows:
        held.append(r)
        size += 100 + sum(len(x) for x in r if isinstance(x, bytes | np.ndarray))
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def answer(batches):
    """QUESTIONS sorted by part -> ANSWERS: places of windows that a smaller id has too; rows without hashes go through."""

    def judge(held):
        places = [heard(*r[1:4]) for r in held]
        key = np.concatenate([unpacked(r[4], np.int64)[at] for r, (_, _, at) in zip(held, places, strict=True)])
        h = np.concatenate([np.frombuffer(r[6], np.uint64) for r in held])
        order = np.argsort(h)
        first = by_run(h[order])
        gone = np.zeros(len(h), bool)
        gone[order] = key[order] > np.repeat(np.minimum.reduceat(key[order], first), np.diff(np.append(first, len(h))))
        begin = 0
        for r, (doc, place, _) in zip(held, places, strict=True):
            on = gone[begin : begin + len(doc)]
            begin += len(doc)
            if on.any():
                yield r[0], *told(doc[on], place[on]), b"", b""

    def rows():
        part, held = None, []
        for b in batches:
            for own, *fields in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fields[6] is None:
                    yield tuple(fields[:6])
                    continue
                if own != part and held:
                    yield from judge(held)
                    held = []
                part = own
                held.append(fields)
        if held:
            yield from judge(held)

    yield from as_batches(rows(), ANSWERS)


def settle(batches):
    """ANSWERS sorted by chunk -> PLACES, a row for each document that loses some windows."""

    def merge(held):
        doc, place, _ = (np.concatenate(x) for x in zip(*(heard(*r[1:4]) for r in held), strict=True))
        key, row = (np.concatenate([unpacked(r[k], np.int64) for r in held]) for k in (4, 5))
        both = np.sort(doc << 32 | place)
        doc, place = both >> 32, both & 0xFFFFFFFF
        for a, b in equal_runs(doc):
            yield int(key[doc[a]]), int(row[doc[a]]), *stretches(place[a:b])

    def rows():
        chunk, held = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != chunk and held:
                    yield from merge(held)
                    held = []
                chunk = r[0]
                held.append(r)
        if held:
            yield from merge(held)

    yield from as_batches(rows(), PLACES)


def repeated_windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """key (doc_id, LAST for null), row (xxhash64 of the text), starts and ends of intervals of windows that a smaller id has too.

    Of a window that a document repeats one place may stand for all. Repeated
    rows give equal rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = keyed(docs).select("key", "row", "text").mapInArrow(ask(parts, words), QUESTIONS)
    answered = asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(answer, ANSWERS)
    return answered.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(settle, PLACES)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64("text").alias("row"), "text")


def dropped(own: list[bytes], starts: list[int], ends: list[int], known: WordHashes, words: int) -> np.ndarray:
    """Which words go, given intervals of windows; a window stands for all its equals in the document."""
    edge = np.zeros(len(own) - words + 2, np.int64)
    edge[starts] += 1
    edge[ends] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    h = rolling(own, known, words)
    gone = np.isin(h, h[gone])
    edge = np.zeros(len(own) + 1, np.int64)
    a, b = stretches(np.flatnonzero(gone))
    edge[a] += 1
    np.add.at(edge, b + words - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicated(docs: DataFrame, words: int = WORDS, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and if asked for the kept words (kept_text) and the removed intervals of words (removed)."""
    places = repeated_windows(docs, words).groupBy("key", "row").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    joined = keyed(docs).join(apart(places), ["key", "row"], "left").select("doc_id", "text", "starts", "ends")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType()), T.StructField("removed", spans)] * texts
    schema = T.StructType([joined.schema["doc_id"], *fields])

    def run(batches):
        known = WordHashes()
        for batch in batches:
            rows = []
            for text, starts, ends in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = (text.as_py() or "").encode("utf-8").split()
                gone = dropped(own, starts, ends, known, words) if starts else np.zeros(len(own), bool)
                kept = b" ".join(own[k] for k in np.flatnonzero(~gone).tolist()) if starts else b" ".join(own)
                a, b = stretches(np.flatnonzero(gone)) if texts and starts else ((), ())
                rows.append((len(own), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if texts else None, [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(len(fields)))], names=schema.fieldNames())

    return joined.mapInArrow(run, schema)


def removal_report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduplicated(docs, words, texts=False)


def oracle(words: int = WORDS) -> str:
    blank = r"[\x20\x09-\x0D]+"
    return rf"""
WITH own AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, doc_id, p, array_to_string(list_slice(w, p, p + {words - 1}), ' ') AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {words - 2})) AS p FROM own)),
least AS (SELECT x, min(doc_id) AS m FROM windows GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + {words})) AS q FROM windows JOIN least USING (x) WHERE doc_id > m)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM own),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.q) AS t FROM words LEFT JOIN gone ON words.r = gone.r AND words.q = gone.q WHERE gone.q IS NULL GROUP BY words.r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM own LEFT JOIN kept ON own.r = kept.r LEFT JOIN lost ON own.r = lost.r"""
