"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.sources.shared import stored

__all__ = ["apart", "fold", "free", "join_hot", "labelled_sample", "map_texts", "pieces", "sifted", "stored"]

#: A key is hot if it has more than this part of the rows.
HOT = 10_000
#: Words of the filter that tells rows apart before a join.
SIEVE = 1 << 20
#: Characters of text that one Python call handles at once; a longer text is handled alone.
BATCH_CHARS = 1_000_000


def free(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(df: DataFrame) -> DataFrame:
    """df dealt evenly, so that a join shuffles it anew by its key.

    A join with the result of an aggregate on the same key would take over the
    aggregate's partitions, and adaptive execution can't split a hot key's
    partition of the other side then.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_hot(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """rows joined with other, which has one row a key; how: left or inner.

    A key of more than a HOT-th of the rows is joined by broadcast: there are
    fewer than HOT such keys, whatever the tables' sizes. All others are
    shuffled. Both tables are read more than once, so they should be written.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_"))
    hot = stored(counts.where(F.col("n_") * HOT > F.lit(rows.count())).select(*keys), "hot-keys")
    often = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(other.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return often.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(apart(other), keys, how))


def sifted(rows: DataFrame, keys: DataFrame, of_rows: list[F.Column], of_keys: list[F.Column]) -> tuple[DataFrame, DataFrame]:
    """rows that surely have none of the keys, and the others, by a Bloom filter of at most SIEVE words of 64 bits, whatever the tables' sizes.

    With more keys than it can tell apart all rows are among the others.
    """
    block, mask, word = (free(rows, n) for n in ("block", "mask", "word"))

    def place(cols: list[F.Column]) -> tuple[F.Column, F.Column]:
        x = F.xxhash64(*cols)
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, k).bitwiseAND(63).cast("int")) for k in (40, 46, 52)]
        return x.bitwiseAND(SIEVE - 1).alias(block), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).alias(mask)

    held = keys.select(*place(of_keys)).groupBy(block).agg(F.bit_or(mask).alias(word))
    marked = rows.select("*", *place(of_rows)).join(F.broadcast(held), block, "left")
    maybe = F.coalesce(F.col(word).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
    return marked.where(~maybe).select(*rows.columns), marked.where(maybe).select(*rows.columns)


def pieces(text: str, border: re.Pattern, size: int = BATCH_CHARS, most: int | None = None) -> Iterator[tuple[int, str]]:
    """(start, piece) of a text, cut before the first border after so many characters; without a border it goes on, or is cut after `most` characters."""
    at = 0
    while len(text) - at > size:
        m = border.search(text, at + size, len(text) if most is None else at + most)
        if m is None and (most is None or len(text) - at <= most):
            break
        end = at + most if m is None else m.start()
        yield at, text[at:end]
        at = end
    yield at, text[at:] if at else text


def text_batches(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, list[str]]]:
    """Slices of a batch with about BATCH_CHARS characters; null texts become empty."""
    start, held, out = 0, 0, []
    for i in range(len(texts)):
        t = texts[i].as_py() or ""
        out.append(t)
        held += len(t)
        if held >= BATCH_CHARS:
            yield ids.slice(start, i + 1 - start), out
            start, held, out = i + 1, 0, []
    if out:
        yield ids.slice(start, len(out)), out


def map_texts(docs: DataFrame, factory: Callable[[], Callable[[list[str]], list[list]]], schema: T.StructType, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key and the columns, lists or Arrow arrays, that factory()(texts) returns; other columns of docs are not read."""
    kind = docs.schema[key].dataType
    full = T.StructType([T.StructField(key, kind), *schema.fields])
    names = full.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        gc.freeze()  # models stay for good, and caches of strings hold no cycles: the collector need not walk them often
        gc.set_threshold(200_000, 20, 20)
        types = [f.type for f in to_arrow_schema(full)]
        for batch in batches:
            for ids, texts in text_batches(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids.cast(types[0]), *(c.cast(t) if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(work(texts), types[1:], strict=True))], names=names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, full)


def fold(key: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id has no remainder and is never learnt from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of at most per_class labelled rows of each class outside the held-out fold.

    Ids are chosen by the order of a hash; only the chosen texts, at most
    max_chars long each, reach the driver, so its memory is bounded by
    2 * per_class * max_chars characters whatever the corpus. Of rows that
    share an id the least text is taken; an id labelled both ways counts for
    each class.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold() != 0)).distinct()
    ids = None
    short = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    for y in (0, 1):
        part = own.where(F.col("y") == y).select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(per_class).select("doc_id", "y")
        ids = part if ids is None else ids.unionByName(part)
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.y))]
