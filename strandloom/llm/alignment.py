"""Alignment of two tokenizers' tokens over the same bytes.

Every byte of a text gets a label: 0 none, 1 a token of A ends here, 2 one of B
does, 3 both do. A regular expression scans the label string for spans up to
each 3; the labels of a span say how many tokens of A and B its group has.
Every labelled byte ends a stretch that lies in one token of A and one of B, and
these pairs are all the overlapping ones: the links.

A text is labelled in segments, cut at single spaces between other characters.
No token crosses such a place: the pattern of A begins a word with the space,
and no piece of B holds a space after another character (checked as the
vocabulary is read; texts are labelled whole otherwise). So each worker labels a
repeated short segment once, and long texts are never encoded whole.

Nulls, empty texts and texts that tokens don't give back byte by byte (those
with U+2581) have no tokens: zeros and ''. Repeated rows are aligned and counted
each. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import free, map_texts, stored

#: A border of segments; the characters left and right of it are no white space for either tokenizer.
BORDER = re.compile(r"(?<=[^\s᠎​﻿]) (?=[^\s᠎​﻿])")
GROUP = re.compile(rb"[^\x03]*\x03")
#: Characters of a segment that is kept for the next time, and of all those that a worker keeps.
SHORT = 48
KEPT_CHARS = 4_000_000
#: Bits of an id in the number of a pair.
BITS = 20
#: A table of pairs of up to so many rows goes to every worker (24 bytes a row); a longer one is joined.
SENT_PAIRS = 2_000_000


def byte_of_letter() -> dict[str, int]:
    """What each letter of a byte-level vocabulary stands for: printable bytes themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class TokenBytes:
    """Both tokenizers: ids of texts, and the bytes of ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_of_letter()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("tokenizer A must be byte-level, without a normalizer or a space of its own")
        vocab = {i: t for t, i in spec["model"]["vocab"].items()}
        added = {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
        self.bytes_a = [added[i].encode("utf-8") if i in added else bytes(letters[c] for c in vocab.get(i, "")) for i in range(max([*vocab, *added]) + 1)]
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        crossing = any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i)))
        # unknown characters side by side become one token unless there are bytes for them
        self.apart = not crossing and any(self.b.is_byte(i) for i in range(n))
        if max(len(self.bytes_a), n) >> BITS:
            raise ValueError("a vocabulary has too many entries")

    def split(self, text: str) -> list[str]:
        return BORDER.split(text) if self.apart else [text]


class Aligner:
    """Labels segments and keeps what it found for short ones: counts, the groups as text, and the numbers of the linked pairs."""

    def __init__(self, tokens: TokenBytes):
        self.tokens = tokens
        #: An id with what stands after it: a comma, a bar or a semicolon.
        self.names = [f"{i}{s}" for i in range(max(len(tokens.bytes_a), len(tokens.bytes_b))) for s in ",|;"]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (tokens.bytes_a, tokens.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str | None] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; all 0 if bytes are not given back
        self.pairs = np.zeros(0, np.int64)
        self.pair_start = np.zeros(1, np.int64)

    def label(self, segments: list[str]) -> None:
        """Adds segments: all their bytes in one label string, as each ends with a token of both."""
        t = self.tokens
        ids_a = [x.ids for x in t.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        ids_b = t.b.encode(segments, num_threads=1)
        want = [(" " + s).encode("utf-8") for s in segments]
        good = [b"".join(map(t.bytes_a.__getitem__, x)) == w == b"".join(map(t.bytes_b.__getitem__, y)) for x, y, w in zip(ids_a, ids_b, want, strict=True)]
        flat_a, flat_b = (np.array([i for x, g in zip(ids, good, strict=True) if g for i in x], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        label = np.zeros(int(end_a[-1]) if len(end_a) else 0, np.uint8)
        label[end_a - 1] |= 1
        label[end_b - 1] |= 2
        group_end = np.cumsum(np.fromiter(map(len, GROUP.findall(label.tobytes())), np.int64))
        upto_a, upto_b = np.searchsorted(end_a, group_end, side="right"), np.searchsorted(end_b, group_end, side="right")
        # the text of all groups: A's ids, then B's, with what stands after each
        tail_a, tail_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        tail_a[upto_a - 1], tail_b[upto_b - 1] = 1, 2
        every_a, every_b = np.arange(len(flat_a)), np.arange(len(flat_b))
        name = np.zeros(len(flat_a) + len(flat_b), np.int64)
        name[every_a + np.concatenate([[0], upto_b])[np.searchsorted(upto_a, every_a, side="right")]] = 3 * flat_a + tail_a
        name[every_b + upto_a[np.searchsorted(upto_b, every_b, side="right")]] = 3 * flat_b + tail_b
        words = list(map(self.names.__getitem__, name.tolist()))
        # a labelled byte ends a stretch inside one token of each
        at = np.flatnonzero(label)
        linked = flat_a[np.searchsorted(end_a, at + 1)] << BITS | flat_b[np.searchsorted(end_b, at + 1)]

        bytes_upto = np.cumsum([len(w) * g for w, g in zip(want, good, strict=True)])
        n_a = np.array([len(x) * g for x, g in zip(ids_a, good, strict=True)], np.int64)
        n_b = np.array([len(x) * g for x, g in zip(ids_b, good, strict=True)], np.int64)
        token_upto = np.cumsum(n_a + n_b).tolist()
        n_groups = np.diff(np.searchsorted(group_end, bytes_upto, side="right"), prepend=0)
        link_upto = np.searchsorted(at, bytes_upto, side="left")
        before = 0
        for s, g, upto in zip(segments, good, token_upto, strict=True):
            self.place[s] = len(self.groups)
            self.groups.append("".join(words[before:upto])[:-1] if g else None)
            self.chars += len(s)
            before = upto
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, np.diff(link_upto, prepend=0)], axis=1)])
        self.pair_start = np.concatenate([self.pair_start, self.pair_start[-1] + link_upto])
        self.pairs = np.concatenate([self.pairs, linked])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts and groups of each text; its linked pairs: (start of each text in the list, pairs, how often each)."""
        segments = [[] if not t else self.tokens.split(t) for t in texts]
        new = {s for own in segments for s in own} - self.place.keys()
        if new:
            self.label(sorted(new))
        sizes = np.array([len(own) for own in segments], np.int64)
        at = np.fromiter((self.place[s] for own in segments for s in own), np.int64, int(sizes.sum()))
        start = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.zeros(len(texts), bool)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        bad[text_of[self.counts[at, 0] == 0]] = True
        counts = np.zeros((len(texts), 4), np.int64)
        for k in range(4):
            counts[:, k] = np.bincount(text_of, weights=self.counts[at, k], minlength=len(texts))
        counts[bad] = 0
        groups = ["" if bad[k] else ";".join(map(self.groups.__getitem__, at[start[k] : start[k + 1]].tolist())) for k in range(len(texts))]
        good = ~bad[text_of]
        at, text_of = at[good], text_of[good]
        n = self.counts[at, 3]
        which = np.arange(int(n.sum())) + np.repeat(self.pair_start[at] - (np.cumsum(n) - n), n)
        own, pair = np.repeat(text_of, n).astype(np.int64), self.pairs[which]
        linked, times = np.unique(own << 2 * BITS | pair, return_counts=True)  # fewer texts at once than 2 ** 23
        begin = np.searchsorted(linked, np.arange(len(texts) + 1) << 2 * BITS)
        if self.chars > KEPT_CHARS or any(len(s) > SHORT for s in new):
            self.keep_short(new)
        return counts, groups, begin, linked & (1 << 2 * BITS) - 1, times

    def keep_short(self, new: set[str]) -> None:
        """Forgets all when too much is kept, and long segments at once, as the labels of both lie at the end."""
        if self.chars > KEPT_CHARS:
            self.forget()
            return
        long = [s for s in new if len(s) > SHORT]
        keep = np.ones(len(self.groups), bool)
        for s in long:
            keep[self.place.pop(s)] = False
            self.chars -= len(s)
        move = np.cumsum(keep) - 1
        kept_pairs = np.repeat(keep, self.counts[:, 3])
        self.place = {s: int(move[k]) for s, k in self.place.items()}
        self.groups = [g for g, k in zip(self.groups, keep.tolist(), strict=True) if k]
        self.pairs, self.counts = self.pairs[kept_pairs], self.counts[keep]
        self.pair_start = np.concatenate([[0], np.cumsum(self.counts[:, 3])])


FIELDS = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType())]


def align(docs: DataFrame, path_a: str, path_b: str, groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, the linked pairs (a << 20 | b) with their times, and the groups as text if asked for."""
    schema = T.StructType([T.StructField(n, t) for n, t in FIELDS] + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType(), False)), T.StructField("times", T.ArrayType(T.IntegerType(), False))] + [T.StructField("groups", T.StringType())] * groups)

    def factory():
        aligner = Aligner(TokenBytes(path_a, path_b))

        def work(texts):
            counts, found, begin, pairs, times = aligner.align(texts)
            begin = begin.astype(np.int32)
            digests = [hashlib.sha256(g.encode("ascii")).hexdigest() if g else "" for g in found]
            lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(x)) for x in (pairs, times.astype(np.int32))]
            return [*(counts[:, k] for k in range(4)), digests, *lists, *([found] if groups else [])]

        return work

    return map_texts(docs, factory, schema)


def flat_pairs(batches):
    """Rows with pairs and times -> each pair of a batch once, with its sum."""
    for batch in batches:
        pairs, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
        own, at = np.unique(pairs, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(np.bincount(at, weights=times, minlength=len(own)).astype(np.int64))], names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, pair, n (links of the pair in the corpus), best (n is the highest of its b)."""
    n = aligned.select("pairs", "times").mapInArrow(flat_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = stored(n.select(F.shiftright("pair", BITS).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << BITS) - 1).cast("int").alias("b"), "pair", "n"), "alignment-pairs")
    most = n.groupBy("b").agg(F.max("n").alias("most"))  # one row an id of B's vocabulary, whatever the corpus
    return n.join(most, "b").select("a", "b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scores_sent(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum by looking pairs up in a table that every worker has."""
    rows = counts.select("pair", "n", "best").toArrow()
    pair = rows["pair"].to_numpy()
    order = np.argsort(pair)
    spread = aligned.sparkSession.sparkContext.broadcast((pair[order], rows["n"].to_numpy()[order], rows["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)))
    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = T.StructType([aligned.schema[c] for c in names] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches):
        pair, n, best = spread.value
        for batch in batches:
            lists = batch.column("pairs")
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(pair, lists.flatten().to_numpy(zero_copy_only=False))
            sums = [np.concatenate([[0], np.cumsum(times * x[at])]) if len(at) else np.zeros(1, np.int64) for x in (best, n)]
            upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x[upto[1:]] - x[upto[:-1]]) for x in sums)], names=schema.fieldNames())

    return aligned.mapInArrow(run, schema)


def scores_joined(aligned: DataFrame, counts: DataFrame, row: str) -> DataFrame:
    """The same by a join of all pairs; row names each row of aligned."""
    own = aligned.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(row, F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    sums = own.join(counts.select("pair", "n", "best"), "pair").groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    return aligned.drop("pairs", "times").join(sums, row, "left").withColumns(zero)


def cross_alignment(docs: DataFrame, path_a: str, path_b: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    The pairs of each document are written once; their sums over the corpus
    have a row a pair of ids, sent to the workers while there are at most
    sent_pairs of them and joined beyond.
    """
    row = free(docs, "row_")
    aligned = stored(align(docs, path_a, path_b, groups=False).withColumn(row, F.monotonically_increasing_id()), "alignment")
    counts = stored(pair_counts(aligned), "alignment-counts")
    scored = scores_sent(aligned, counts) if counts.count() <= sent_pairs else scores_joined(aligned, counts, row)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
