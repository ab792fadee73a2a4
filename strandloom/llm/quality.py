"""A quality classifier by supervised subword embeddings.

A document is the average of learned vectors of its words, of the character
n-grams of words and of pairs of neighbouring words, each hashed to a bucket;
a softmax over the average gives the classes. Most pairs of words are rare, so
the two words of a pair are hashed to a few classes each (PAIR_BITS); a pair
counts as often as a word has n-grams, about (PAIR_COUNT).
Vectors and weights are trained by stochastic gradient descent in numpy on a
bounded, class-balanced sample of labelled documents (PER_CLASS of each class,
at most MAX_CHARS characters each); the classes' shares among all labels that
may be learnt from then set the offset. As the score is linear in the average,
each bucket's part of it is worked out once, and scoring adds up parts.

Null and empty texts have no words and get the score of the classes' shares.
Without labels of both classes the score is 0.5 for all. Repeated rows each
get their row. A text of over BATCH_CHARS characters is summed over stretches
cut at white space, and a pair of words over a cut is counted too; a word of over
a million characters without white space may count as several.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import BATCH_CHARS, fold, labelled_sample, map_texts, pieces

BITS, DIM = 17, 12
BUCKETS = 1 << BITS
PER_CLASS, MAX_CHARS, EPOCHS, RATE = 1200, 12_000, 12, 1.2
THRESHOLD = 0.3
SPACE = re.compile(r"\s")
PAIR_BITS, PAIR_COUNT = 5, 8
#: Characters whose features are worked out together.
STRETCH = 1 << 18
#: Odd factors of the places of an n-gram, of the characters of a word, and of the last mixing.
PLACES = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
POWER, MIX = 0x01000193, np.uint32(0x2C1B3C6D)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Buckets of 32-bit numbers."""
    x = x + np.uint32(salt)
    x ^= x >> 15
    x *= MIX
    x ^= x >> 13
    x *= PLACES[0]
    return x >> (32 - BITS)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bucket, number of its text, count) of all words, n-grams of three and four characters of " word ", and pairs."""
    spaced = [" ".join(["", *t.split(), ""]) for t in texts]
    c = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(s) for s in spaced])
    full = c != 32
    start = np.flatnonzero(full[1:] & ~full[:-1]) + 1
    if not len(start):
        return
    end = np.flatnonzero(full[:-1] & ~full[1:]) + 1
    # a word is a polynomial of its characters, whatever its place
    up, down = (np.multiply.accumulate(np.full(len(c), f, np.uint32), dtype=np.uint32) for f in (POWER, pow(POWER, -1, 1 << 32)))
    upto = np.cumsum(c * up, dtype=np.uint32)
    of = text[start]
    word = (upto[end - 1] - upto[start - 1]) * down[start]
    yield mixed(word, 1), of, 1
    a, b, d, e = (c * f for f in PLACES)
    three = a[:-2] + b[1:-1] + d[2:]
    inner = full[1:-1]
    yield mixed(three[inner], 3), text[1:-1][inner], 1
    inner = full[1:-2] & full[2:-1]
    yield mixed((three[:-1] + e[3:])[inner], 4), text[1:-2][inner], 1
    kind = mixed(word, 5) >> (BITS - PAIR_BITS)
    near = of[1:] == of[:-1]
    yield mixed((kind[:-1] * PLACES[1] + kind[1:] * PLACES[2])[near], 2), of[1:][near], PAIR_COUNT


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the share of each."""
    n = np.zeros(BUCKETS, np.float32)
    for bucket, _, count in features([text]):
        n += count * np.bincount(bucket, minlength=BUCKETS).astype(np.float32)
    own = np.flatnonzero(n)
    return own, n[own] / max(1.0, float(n.sum()))


def train(sample: list[tuple[str, int]], share: float | None, seed: int = 7) -> tuple[np.ndarray, float]:
    """(part of the logit by bucket, offset). share: the share of class 1 among all labels."""
    if share is None or len({y for _, y in sample}) < 2:
        return np.zeros(BUCKETS), 0.0
    docs = [(*counted(text), y) for text, y in sample]
    docs = [d for d in docs if len(d[0])]
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            u, n, y = docs[k]
            rate = RATE * (1 - step / steps)
            own = e[u]
            v = n @ own
            z = v @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = w @ p
            w -= rate * np.outer(v, p)
            b -= rate * p
            # a bucket's share of the average scales its step; len(u) keeps steps of long texts alive
            e[u] = own - (rate * min(len(u), 2000)) * n[:, None] * g[None, :] * 0.05
            step += 1
    ones = sum(y for _, y in sample) / len(sample)
    offset = float(b[1] - b[0]) + math.log(share / (1 - share)) - math.log(ones / (1 - ones))
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float64), offset


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    n, ones = labels.where((fold() != 0) & F.col("quality").isin(0, 1)).agg(F.count("*"), F.sum("quality")).first()
    share = ones / n if n and 0 < ones < n else None
    return train(labelled_sample(docs, labels, "quality", PER_CLASS, MAX_CHARS), share)


class Scorer:
    """Scores of texts, the same however they are dealt over calls."""

    def __init__(self, part: np.ndarray, offset: float):
        self.part, self.offset = part, offset

    def __call__(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        held: list[str] = []
        numbers: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            before = None
            for _, piece in pieces(text, SPACE, most=2 * BATCH_CHARS):
                if len(piece) < len(text) and not piece.isspace():
                    if before is not None:
                        self.add_pair(before, piece.split(None, 1)[0], k, total, count)
                    before = piece.rsplit(None, 1)[-1]
                held.append(piece)
                numbers.append(k)
                size += len(piece)
                if size >= STRETCH:
                    self.add(held, numbers, total, count)
                    held, numbers, size = [], [], 0
        if held:
            self.add(held, numbers, total, count)
        z = self.offset + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def add(self, held: list[str], numbers: list[int], total: np.ndarray, count: np.ndarray, sign: int = 1) -> None:
        for bucket, of, times in features(held):
            np.add.at(total, numbers, sign * times * np.bincount(of, self.part[bucket], len(held)))
            np.add.at(count, numbers, sign * times * np.bincount(of, minlength=len(held)))

    def add_pair(self, a: str, b: str, k: int, total: np.ndarray, count: np.ndarray) -> None:
        """What two words have together beyond what each has."""
        for text, sign in ((f"{a} {b}", 1), (a, -1), (b, -1)):
            self.add([text], [k], total, count, sign)


def classify(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. train_docs: the texts of the labels, docs if not given."""
    part, offset = fit(docs if train_docs is None else train_docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((part, offset))  # BUCKETS floats, whatever the corpus

    def factory():
        s = Scorer(*model.value)
        return lambda texts: [s(texts).tolist()]

    scored = map_texts(docs, factory, T.StructType([T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    part, offset = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((part, offset))
    at = docs.columns.index("text")

    def run(batches):
        s = Scorer(*model.value)
        for batch in batches:
            texts = batch.column(at)
            yield batch.filter(pa.array(s([t or "" for t in texts.to_pylist()]) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
