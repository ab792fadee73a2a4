"""Token counts of huge documents by overlap resynchronisation.

A text longer than a chunk is encoded in chunks that overlap. Two encodings
are spliced at a position in the overlap where both have a token border and
where the border is proven stable: no piece of the vocabulary holds the
characters to its left and right side by side, so no merge ever crosses it,
whatever stands around. In most vocabularies that is so before a space, around
line breaks and between most characters of scripts written without spaces. If
the overlap has no such place, as in a long run of one letter, it is widened,
up to the whole text.

Null counts as an empty text and has 0 tokens. Repeated rows each get their row.
"""

from __future__ import annotations

import functools

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import map_texts

#: Characters of a chunk and of the first overlap. Any values give the same counts.
CHUNK = 16_384
OVERLAP = 512
BAR = "▁"


class SplicedCounter:
    """Counts tokens of one sentencepiece model."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, min(overlap, chunk // 2)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.size = np.array([1 if self.model.is_byte(i) else len(p.encode("utf-8")) for i, p in enumerate(pieces)], dtype=np.int64)
        #: The proof that the splice needs: pairs of characters that some piece holds side by side.
        self.joined = {p[k : k + 2] for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i)) for k in range(len(p) - 1)}
        #: Without bytes for unknown characters neighbouring ones become one token; such a vocabulary is always encoded whole.
        self.stable = any(self.model.is_byte(i) for i in range(n))

    def borders(self, text: str) -> np.ndarray | None:
        """Byte offsets of the token ends in the text with its leading space; None if offsets don't add up."""
        ids = np.asarray(self.model.encode(text), dtype=np.int64)
        ends = np.cumsum(self.size[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        return ends if len(ids) and ends[-1] == self.offset(text) else None

    @staticmethod
    def offset(head: str) -> int:
        """Bytes that a beginning of a text takes with its leading space, where a space takes three."""
        return 3 + len(head.encode("utf-8")) + 2 * head.count(" ")

    def splice(self, text: str, a: int, b: int, left: np.ndarray, start: int, right: np.ndarray) -> int | None:
        """The last stable place in text[start:b] that is a border of left (encoded from a) and of right (encoded from start)."""
        at = b - 1
        while at > start + 1:
            if text[at - 1 : at + 1].replace(" ", BAR) not in self.joined:
                for ends, base in ((left, a), (right, start)):
                    x = self.offset(text[base:at])
                    k = np.searchsorted(ends, x)
                    if k >= len(ends) or ends[k] != x:
                        break
                else:
                    return at
            at -= 1
        return None

    def count(self, text: str) -> int:
        n = len(text)
        if n <= self.chunk or not self.stable:
            return len(self.model.encode(text))
        total, a, begun, b = 0, 0, 0, self.chunk  # the chunk text[a:b] counts from begun on
        left = self.borders(text[a:b])
        while left is not None:
            # tokens of this chunk that end at begun or before are counted already
            done = int(np.searchsorted(left, self.offset(text[a:begun]), side="right")) if begun > a else 0
            if b >= n:
                return total + len(left) - done
            overlap, at = self.overlap, None
            while at is None:
                start = max(b - overlap, begun)
                end = min(n, start + max(self.chunk, 2 * overlap))
                right = self.borders(text[start:end])
                if right is None:
                    break
                at = self.splice(text, a, b, left, start, right)
                if at is None and start == begun:
                    break
                overlap *= 2
            if right is None:
                break
            if at is None:  # no border in the whole chunk: take a longer one
                b = min(n, a + 2 * (b - a))
                left = self.borders(text[a:b])
                continue
            total += int(np.searchsorted(left, self.offset(text[a:at]), side="right")) - done
            a, begun, b, left = start, at, end, right
        return len(self.model.encode(text))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> SplicedCounter:
    return SplicedCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def factory():
        c = counter(path)
        return lambda texts: [[len(t.encode("utf-8")) for t in texts], [c.count(t) for t in texts]]

    return map_texts(docs, factory, schema).withColumn("over_limit", F.col("n_tokens") > limit)
