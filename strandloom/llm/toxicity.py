"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens get theirs first: in the training sample a
word, or its first four or five letters, is telling if it stands in toxic
documents far more often than in others (smoothed log odds), and a token with
a telling word or beginning in a toxic document is a toxic token. The field
has two states, a weight for every word of the sample's vocabulary, for the
hashed beginnings and shape of a word and for the transitions; it is trained
by gradient ascent on the exact conditional likelihood. Forward-backward
marginals of a text give the spans (runs of tokens more likely toxic than
not), and their largest value and sum, through a logistic model fitted on the
same sample, the document's score.

The sample is class-balanced and bounded (PER_CLASS documents of each class
of at most MAX_CHARS characters); the share of class 1 among all labels that
may be learnt from sets the offset. Chains of many texts are handled at once:
blocks of BLOCK tokens are multiplied out side by side and then joined in
order, which gives the same marginals as one pass over each text. A long text
is read in stretches, twice: eight bytes a token and a product a block are all
that is held of it.

Tokens are cut from the text as it is and lowered one by one, so spans are
places of the text. Null and empty texts have no tokens, no spans and the
score of such a text under the logistic model. Without labels of both classes
the score is 0.5. Repeated rows each get their row, equal texts equal values;
an id that the labels name twice counts once for each class.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import fold, labelled_sample, map_texts, pieces

PER_CLASS, MAX_CHARS, ROUNDS, RATE = 1500, 8_000, 40, 0.3
FORMS, BLOCK, TELLING, LEAST_DOCS = 1 << 15, 64, 2.5, 4
#: Tokens that are multiplied out at once, a multiple of BLOCK.
STRETCH = 1 << 18
#: Words of which a worker keeps the weight.
CACHE = 200_000
TOKEN = re.compile(r"\w+")
OTHER = re.compile(r"\W")


def tokens(text: str) -> list[str]:
    """Lowered tokens: none holds a line break, so all are lowered together."""
    found = "\n".join(TOKEN.findall(text)).lower()
    return found.split("\n") if found else []


def beginnings(word: str) -> list[str]:
    """The word and its first four and five letters, told apart."""
    return [word, f"4|{word[:4]}", f"5|{word[:5]}"] if len(word) > 3 else [word]


def forms(word: str) -> tuple[int, int, int]:
    """Buckets of a word's first four and five letters and of its first and last two."""
    crc, mask = zlib.crc32, FORMS - 1
    return crc(word[:4].encode("utf-8", "replace"), 4) & mask, crc(word[:5].encode("utf-8", "replace"), 5) & mask, crc((word[:2] + "|" + word[-2:]).encode("utf-8", "replace")) & mask


def transfers(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Blocks of BLOCK transfer matrices, from a token's state to the next one's; identities fill the last block."""
    n = len(emit)
    rows = -(-n // BLOCK)
    m = np.empty((rows * BLOCK, 2, 2))
    m[n:] = np.eye(2)
    m[:n] = np.exp(trans)
    m[:n][first] = np.exp(start)
    m[:n, :, 1] *= np.exp(np.clip(emit, -30, 30))[:, None]
    m /= m.sum(axis=(1, 2), keepdims=True)
    return m.reshape(rows, BLOCK, 2, 2)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=(-2, -1), keepdims=True)


def carried(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the blocks' products: the forward vector before each block and the backward vector after it."""
    carry, back = np.empty((len(ends), 2)), np.empty((len(ends), 2))
    x, y = 0.5, 0.5
    for r, ((p, q), (s, t)) in enumerate(ends.tolist()):
        carry[r] = x, y
        x, y = x * p + y * s, x * q + y * t
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for r in range(len(ends) - 1, -1, -1):
        back[r] = x, y
        (p, q), (s, t) = ends[r].tolist()
        x, y = p * x + q * y, s * x + t * y
        x, y = x / (x + y), y / (x + y)
    return carry, back


def ahead(m: np.ndarray) -> np.ndarray:
    """Products from a block's begin."""
    out = np.empty_like(m)
    out[:, 0] = m[:, 0]
    for k in range(1, BLOCK):
        out[:, k] = scaled(out[:, k - 1] @ m[:, k])
    return out


def vectors(m: np.ndarray, products: np.ndarray, carry: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward vectors of the tokens of some blocks."""
    behind = np.empty_like(m)  # products of what follows a token in its block
    behind[:, BLOCK - 1] = np.eye(2)
    for k in range(BLOCK - 2, -1, -1):
        behind[:, k] = scaled(m[:, k + 1] @ behind[:, k + 1])
    return np.einsum("ri,rkij->rkj", carry, products).reshape(-1, 2), np.einsum("rkij,rj->rki", behind, back).reshape(-1, 2)


def share(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1)


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated chains: P(state 1) of each token, and the scaled forward and backward vectors.

    emit: weight of state 1 over state 0 by token; first: whether a chain begins.
    """
    m = transfers(emit, first, trans, start)
    products = ahead(m)
    alpha, beta = (x[: len(emit)] for x in vectors(m, products, *carried(products[:, -1])))
    return share(alpha, beta), alpha, beta


def probabilities(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(state 1) of each token as by marginals, in stretches."""
    if len(emit) <= STRETCH:
        return marginals(emit, first, trans, start)[0]
    cuts = [slice(k, k + STRETCH) for k in range(0, len(emit), STRETCH)]
    blocks = lambda c: transfers(emit[c], first[c], trans, start)
    carry, back = carried(np.concatenate([ahead(blocks(c))[:, -1] for c in cuts]))
    out = np.empty(len(emit))
    for c in cuts:
        m, rows = blocks(c), slice(c.start // BLOCK, c.start // BLOCK + STRETCH // BLOCK)
        alpha, beta = vectors(m, ahead(m), carry[rows], back[rows])
        out[c] = share(alpha, beta)[: len(out[c])]
    return out


class Model:
    """Weights of the field and of the logistic model over it."""

    def __init__(self):
        self.vocabulary: dict[str, int] = {}
        self.word = np.zeros(1)
        self.form = np.zeros(FORMS)
        self.trans, self.start = np.zeros((2, 2)), np.zeros(2)
        self.logistic = np.zeros(4)

    def score(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        z = self.features(best, total) @ self.logistic
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
        p = np.clip(best, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(len(p)), np.log(p / (1 - p)) / 4, np.log1p(total), best], axis=1)


def by_chain(p: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and summed marginal of each chain; chains may be empty."""
    best, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    on = np.flatnonzero(lengths)
    if len(on):
        at = (np.cumsum(lengths) - lengths)[on]
        best[on], total[on] = np.maximum.reduceat(p, at), np.add.reduceat(p, at)
    return best, total


def train(sample: list[tuple[str, int]], positive: float | None) -> Model:
    """The model from (text, label). positive: the share of label 1 among all labels."""
    model = Model()
    if positive is None or len({y for _, y in sample}) < 2:
        return model
    words = [tokens(t) for t, _ in sample]
    y = np.array([k for _, k in sample])
    seen: list[dict[str, int]] = [{}, {}]
    counts: dict[str, int] = {}
    for w, k in zip(words, y.tolist(), strict=True):
        own = seen[k]
        for x in {b for x in set(w) for b in beginnings(x)}:
            own[x] = own.get(x, 0) + 1
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    telling = {w for w, c in seen[1].items() if c >= LEAST_DOCS and math.log((c + 0.5) / (n1 + 1)) - math.log((seen[0].get(w, 0) + 0.5) / (n0 + 1)) > TELLING}
    model.vocabulary = {w: k + 1 for k, w in enumerate(sorted(w for w, c in counts.items() if c >= 3))}
    lengths = np.array([len(w) for w in words])
    if not lengths.sum():
        return model
    own = {x: (model.vocabulary.get(x, 0), *forms(x), any(b in telling for b in beginnings(x))) for x in counts}
    rows = np.array([own[x] for w in words for x in w], np.int32)
    del seen, own, counts
    word, form, label = rows[:, 0], rows[:, 1:4], rows[:, 4].astype(bool) & np.repeat(y == 1, lengths)
    first = np.zeros(len(rows), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    later = np.flatnonzero(~first)
    model.word = np.zeros(len(model.vocabulary) + 1)
    params = [model.word, model.form, model.trans, model.start]
    squares = [np.full(p.shape, 1e-2) for p in params]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (label[later - 1].astype(int), label[later].astype(int)), 1)
    begun = np.bincount(label[first].astype(int), minlength=2)
    scale = max(1.0, label.sum())
    weights = lambda: model.word[word] + model.form[form[:, 0]] + model.form[form[:, 1]] + model.form[form[:, 2]]
    for _ in range(ROUNDS):
        emit = weights()
        p, alpha, beta = marginals(emit, first, model.trans, model.start)
        gap = label - p
        e = np.exp(np.clip(emit, -30, 30))[later]
        # expected pairs of neighbouring states
        a, b = alpha[later - 1], beta[later]
        xi = [a[:, i] * math.exp(model.trans[i, j]) * (e if j else 1) * b[:, j] for i in (0, 1) for j in (0, 1)]
        whole = sum(xi)
        grads = [np.bincount(word, gap, len(model.word)), sum(np.bincount(form[:, k], gap, FORMS) for k in range(3)), pairs - np.array([(x / whole).sum() for x in xi]).reshape(2, 2), begun - np.array([(1 - p[first]).sum(), p[first].sum()])]
        for v, s, g in zip(params, squares, grads, strict=True):
            g = g / scale - 1e-4 * v
            s += g * g
            v += RATE * 3 * g / np.sqrt(s)
    best, total = by_chain(marginals(weights(), first, model.trans, model.start)[0], lengths)
    x, w = model.features(best, total), np.zeros(4)
    for _ in range(50):  # Newton's steps on the ridge logistic likelihood
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(4)
        w += np.linalg.solve(h, x.T @ (y - q) - 0.1 * w)
    w[0] += math.log(positive / (1 - positive)) - math.log(n1 / n0)
    model.logistic = w
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    n, ones = labels.where((fold() != 0) & F.col("toxic").isin(0, 1)).agg(F.count("*"), F.sum("toxic")).first()
    return train(labelled_sample(docs, labels, "toxic", PER_CLASS, MAX_CHARS), ones / n if n and 0 < ones < n else None)


class Tagger:
    def __init__(self, model: Model):
        self.model, self.word, self.form = model, model.word.tolist(), model.form.tolist()
        self.held: dict[str, float] = {}

    def weights(self, words: list[str]) -> list[float]:
        out = list(map(self.held.get, words))
        if None in out:
            number, word, form = self.model.vocabulary.get, self.word, self.form
            for k, got in enumerate(out):
                if got is None:
                    w = words[k]
                    a, b, c = forms(w)
                    out[k] = got = word[number(w, 0)] + form[a] + form[b] + form[c]
                    if len(w) <= 64:
                        if len(self.held) >= CACHE:
                            self.held.clear()
                        self.held[w] = got
        return out

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all tokens, tokens by text, score by text."""
        each, lengths = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            for _, piece in pieces(t, OTHER):
                each.append(np.array(self.weights(tokens(piece)), np.float64))
                lengths[k] += len(each[-1])
        flat = np.concatenate(each) if each else np.zeros(0)
        p = np.zeros(0)
        if len(flat):
            first = np.zeros(len(flat), bool)
            first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
            p = probabilities(flat, first, self.model.trans, self.model.start)
        return p, lengths, self.model.score(*by_chain(p, lengths))

    def places(self, text: str, wanted: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the tokens with these numbers, in order."""
        out, number, left = [], 0, wanted.tolist()[::-1]
        for at, piece in pieces(text, OTHER):
            for m in TOKEN.finditer(piece):
                if not left:
                    return out
                if number == left[-1]:
                    left.pop()
                    out.append((at + m.start(), at + m.end()))
                number += 1
        return out

    def spans(self, texts: list[str], p: np.ndarray, lengths: np.ndarray) -> list[list[list[int]]]:
        """[start, end] in code points of the runs of tokens with a marginal over a half."""
        if not (p > 0.5).any():
            return [[] for _ in texts]
        out = []
        for t, a, n in zip(texts, (np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), strict=True):
            on = np.flatnonzero(p[a : a + n] > 0.5)
            own: list[list[int]] = []
            if not len(on):
                out.append(own)
                continue
            for k, joined, (x, y) in zip(on.tolist(), np.diff(on, prepend=-2) == 1, self.places(t, on), strict=True):
                if joined:
                    own[-1][1] = y
                else:
                    own.append([x, y])
            out.append(own)
        return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_spans of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # the words of a bounded sample

    def factory():
        tagger = Tagger(model.value)

        def work(texts):
            p, lengths, score = tagger.tag(texts)
            return [score, tagger.spans(texts, p, lengths)]

        return work

    scored = map_texts(docs, factory, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(T.ArrayType(T.IntegerType())))]))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
