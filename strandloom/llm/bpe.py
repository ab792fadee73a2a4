"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that ends its BPE
encoding. An automaton over all vocabulary strings gives the tokens that end
at each position, longest first; a token is the last one of its prefix if it
can stand by itself and is compatible with the last token of the prefix
before it. Following the stored tokens back from the end gives the ids.

Which characters are letters and how they are lowered follows the Unicode
tables of this Python; a stretch with a character that they do not know, or
with a combining mark, whose order depends on their version, is normalised
and cut into pieces by the tokenizer's own tables instead.

Texts: null counts as empty; an empty text has no ids and decodes to an empty
text. Strings of added tokens inside a text become those tokens, as the
library does by default. Repeated rows each get their row.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandloom.llm.common import map_texts, pieces

#: Entries of a worker's cache; the chunk cache keeps one older generation of as many.
CACHE = 100_000
#: The same where token ids are given out and other stages have used the worker before.
SMALL_CACHE = 40_000

#: Bytes of the prefix of a word whose tokens are kept.
HEAD = 5

#: The pieces into which the tokenizer's file splits a normalised text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: Control characters that Python's split() takes for white space and the tokenizer does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")
#: Categories of characters that Unicode versions treat differently: unassigned ones and marks.
UNSURE = {"Cn", "Mn", "Mc", "Me"}
END = "</w>"
#: Where a long text may be cut: white space for Python and for the tokenizer.
BORDER = regex.compile("[ \t\n\r]")
BASE = -1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {}, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


#: The nodes after each symbol, (token, length, fits) of the tokens that end here, and the state's number.
Node = tuple[dict, list, int]


class Batch:
    """Encoded texts: what each distinct stretch gives, which stretches each row has, and which text each row is of.

    A long text is several rows, cut at white space.
    """

    def __init__(self, told: list[str], n: np.ndarray, decoded: list[str], at: np.ndarray, rows: np.ndarray, owner: np.ndarray, count: int):
        on = np.concatenate([[0], np.cumsum(n[at] > 0)])  # a stretch of nothing but what is removed leaves no space
        self.told, self.n, self.decoded, self.owner, self.count = told, n, decoded, owner, count
        self.at, self.rows = at[n[at] > 0], on[rows]

    def sizes(self) -> np.ndarray:
        """Tokens of each text."""
        ends = np.concatenate([[0], np.cumsum(self.n[self.at])])[self.rows]
        return np.bincount(self.owner, np.diff(ends), self.count).astype(np.int64)

    def digests(self, parts: list[str]) -> list[str]:
        """SHA-256 of each text's parts, joined by a space."""
        lists = pa.ListArray.from_arrays(pa.array(self.rows, pa.int32()), pa.array(parts, pa.string()).take(pa.array(self.at)))
        joined = pc.binary_join(lists, " ")
        offsets, data = np.frombuffer(joined.buffers()[1], np.int32), memoryview(joined.buffers()[2] or b"")
        out, held, last, empty = [], hashlib.sha256(), 0, True
        for r, k in enumerate(self.owner.tolist()):
            if k != last:
                out.append(held.hexdigest())
                held, last, empty = hashlib.sha256(), k, True
            a, b = int(offsets[r]), int(offsets[r + 1])
            if b > a:
                if not empty:
                    held.update(b" ")
                held.update(data[a:b])
                empty = False
        return [*out, held.hexdigest()] if self.count else out

    def ids(self) -> pa.ListArray:
        """Token ids of each text."""
        flat = np.array(" ".join([t for t in self.told if t]).split(), np.int32)
        begin, n = (np.cumsum(self.n) - self.n)[self.at], self.n[self.at]
        where = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.sizes())]), pa.int32()), pa.array(flat[where], pa.int32()))


class PrefixBPE:
    """The encoder for one tokenizer file of the word-end BPE kind."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        # only its normalizer and cutter are used; without the vocabulary it takes little memory
        bare = spec | {"added_tokens": [], "post_processor": None, "model": spec["model"] | {"vocab": {}, "merges": []}}
        own = tokenizers.Tokenizer.from_str(json.dumps(bare))
        self.normalizer, self.cutter = own.normalizer, own.pre_tokenizer
        self.symbols = byte_symbols()
        number = {s: b for b, s in enumerate(self.symbols)}
        self.text = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text.update({i: t for t, i in self.added.items()})
        self.added_at = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = r, made
            if made not in self.rank:
                self.rank[made], self.parts[made] = r, (vocab[a], vocab[b])
        special = set(self.added.values())
        # the trie of all vocabulary strings; symbols from 256 on end a word
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        self.symbol: list[int] = [0]
        self.parent: list[int] = [0]
        for t, i in vocab.items():
            if i in special:
                continue
            body, last = (t[: -len(END)], 256) if t.endswith(END) and len(t) > len(END) else (t, 0)
            if all(c in number for c in body):
                keys = [number[c] for c in body]
                keys[-1] += last
                self._add(keys, i)
        self.link: dict[int, int] = {0: 0}
        self.go: dict[int, int] = {}
        self.ends: dict[int, list[tuple[int, int, dict[int, bool]]]] = {}
        self.alone: dict[int, bool] = {}
        #: By token: whether it fits behind each left token met.
        self.fits: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.nodes: dict[int, Node] = {}
        self.words: dict[str, tuple[str, int, str]] = {}
        self.heads: dict[bytes | None, tuple[Node, tuple[int, ...], tuple[int, ...]]] = {}
        #: Characters met that all Unicode versions treat alike.
        self.sure: set[str] = set()
        self.number = {i: str(i) for i in self.text}
        self.root = self._node(0)
        self.chunks: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _add(self, keys: list[int], token: int) -> None:
        at = 0
        for k in keys:
            to = self.child.get(at << 9 | k)
            if to is None:
                to = self.child[at << 9 | k] = len(self.token)
                self.token.append(-1)
                self.depth.append(self.depth[at] + 1)
                self.symbol.append(k)
                self.parent.append(at)
            at = to
        self.token[at] = token

    def _suffix(self, state: int) -> int:
        """The longest proper suffix of a state's string that is in the trie."""
        held = self.link.get(state)
        if held is None:
            up = self.parent[state]
            held = self.link[state] = self._step(self._suffix(up), self.symbol[state]) if up else 0
        return held

    def _step(self, state: int, symbol: int) -> int:
        """The state after one more symbol: the longest suffix read so far that is in the trie."""
        key = state << 9 | symbol
        to = self.go.get(key)
        if to is None:
            to = self.child.get(key)
            if to is None:
                to = self._step(self._suffix(state), symbol) if state else 0
            self.go[key] = to
        return to

    def _ending(self, state: int) -> list[tuple[int, int, dict[int, bool]]]:
        """(token, length, fits) of the tokens that end in this state and can stand by themselves, longest first."""
        held = self.ends.get(state)
        if held is None:
            own = self.token[state]
            held = [(own, self.depth[state], self.fits.setdefault(own, {}))] if own >= 0 and self.whole(own) else []
            if state:
                held = held + self._ending(self._suffix(state))
            self.ends[state] = held
        return held

    def _node(self, state: int) -> Node:
        """A state with the nodes after each symbol met, and what ends in it."""
        held = self.nodes.get(state)
        if held is None:
            held = self.nodes[state] = ({}, self._ending(state), state)
        return held

    def _next(self, node: Node, symbol: int) -> Node:
        held = node[0][symbol] = self._node(self._step(node[2], symbol))
        return held

    def compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether left and right, each formed by itself, stay apart when they stand side by side.

        Undoes the later of the two formations step by step; a merge across the
        border that would have come before the step undone rules the pair out.
        before: only merges of a lower rank than this count at first.
        """
        rank, merge, parts = self.rank, self.merge, self.parts
        limit = len(merge) if before is None else before
        while True:
            across = merge.get((left, right))
            if across is not None and across[0] < limit:
                return False
            a, b = rank.get(left, BASE), rank.get(right, BASE)
            if a == BASE and b == BASE:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:  # of two merges of one rank the left one comes first
                limit, right = b + 1, parts[right][0]

    def whole(self, token: int) -> bool:
        """Whether the encoding of a token's own string is that token."""
        held = self.alone.get(token)
        if held is None:
            r = self.rank.get(token, BASE)
            if r == BASE:
                held = True
            else:
                a, b = self.parts[token]
                held = self.whole(a) and self.whole(b) and self.compatible(a, b, r)
            self.alone[token] = held
        return held

    def word(self, word: str) -> list[int]:
        """Ids of one normalised piece."""
        data = word.encode("utf-8")
        n = len(data)
        head = data[:HEAD] if n > HEAD else None
        held = self.heads.get(head)
        if held is None:
            node, last, size, end = self.root, [0] * n, [0] * n, 0
        else:  # a prefix has the same tokens whatever follows it
            node, last, size = held
            last, size, end = [*last, *([0] * (n - HEAD))], [*size, *([0] * (n - HEAD))], HEAD
        for symbol in data[end:-1]:
            node = node[0].get(symbol) or self._next(node, symbol)
            for token, length, fits in node[1]:
                if end < length:
                    break
                left = last[end - length]
                ok = fits.get(left)
                if ok is None:
                    ok = self.fit(left, token, fits)
                if ok:
                    break
            last[end], size[end] = token, length
            end += 1
            if end == HEAD and head is not None:
                if len(self.heads) >= self.cache // 4:
                    self.heads.clear()
                self.heads[head] = node, tuple(last[:HEAD]), tuple(size[:HEAD])
        symbol = data[-1] + 256
        node = node[0].get(symbol) or self._next(node, symbol)
        for token, length, fits in node[1]:
            if end < length:
                break
            left = last[end - length]
            ok = fits.get(left)
            if ok is None:
                ok = self.fit(left, token, fits)
            if ok:
                break
        last[end], size[end] = token, length
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def fit(self, left: int, right: int, fits: dict[int, bool]) -> bool:
        """What compatible says, kept."""
        self.pairs += 1
        if self.pairs > 4 * self.cache:
            self.pairs = 0
            for held in self.fits.values():
                held.clear()
        ok = fits[left] = self.compatible(left, right)
        return ok

    def pieces(self, chunk: str) -> list[str]:
        """The normalised pieces of a stretch without white space."""
        if chunk.isascii():
            return WORDS.findall(chunk.lower())
        if not self.sure.issuperset(chunk):
            fresh = {c for c in chunk if unicodedata.category(c) not in UNSURE}
            if not fresh.issuperset(chunk):
                folded = self.normalizer.normalize_str(chunk)
                return [folded[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(folded)]
            self.sure |= fresh
        # lower case goes character by character: the final sigma has no form of its own
        folded = unicodedata.normalize("NFC", chunk)
        return WORDS.findall(folded.lower() if "Σ" not in folded else "".join(c.lower() for c in folded))

    def chunk(self, chunk: str) -> tuple[str, int, str]:
        """Of a stretch without white space: ids as text, their number, decoded text."""
        out = []
        for w in self.pieces(chunk):
            got = self.words.get(w)
            if got is None:
                ids = self.word(w)
                got = " ".join([self.number[i] for i in ids]), len(ids), self.decode(ids)
                if len(w) <= 64:
                    if len(self.words) >= self.cache:
                        self.words.clear()
                    self.words[w] = got
            out.append(got)
        if len(out) == 1:
            return out[0]
        return " ".join([x[0] for x in out]), sum([x[1] for x in out]), " ".join([x[2] for x in out])

    def stretches(self, text: str) -> list[str]:
        """The stretches of a text without white space; an added token is one with a space before it."""
        if not any(t in text for t in self.added):
            return SPACE.split(text) if NOT_SPACE.search(text) else text.split()
        out = []
        for k, part in enumerate(self.added_at.split(text)):
            out += [" " + part] if k % 2 else SPACE.split(part) if NOT_SPACE.search(part) else part.split()
        return out

    def look(self, stretch: str) -> tuple[str, int, str]:
        """Ids as text, their number and decoded text of a stretch."""
        got = self.chunks.get(stretch)
        if got is None:
            if stretch[:1] == " ":
                return str(self.added[stretch[1:]]), 1, stretch[1:]
            got = self.older.get(stretch) or self.chunk(stretch)
            if len(stretch) <= 64:
                if len(self.chunks) >= self.cache:
                    self.older, self.chunks = self.chunks, {}
                self.chunks[stretch] = got
        return got

    def spans(self, text: str) -> list[tuple[str, int, str]]:
        return [x for x in map(self.look, self.stretches(text)) if x[1]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for s in self.spans(text) for i in s[0].split(" ")]

    def batch(self, texts: list[str]) -> Batch:
        """All of some texts at once: each stretch that they share is looked up once."""
        each: list[str] = []
        rows, owner = [0], []
        for k, t in enumerate(texts):
            for _, piece in pieces(t, BORDER):
                each += self.stretches(piece)
                rows.append(len(each))
                owner.append(k)
        held = pa.array(each, pa.string()).dictionary_encode()
        del each
        got = [self.look(x) for x in held.dictionary.to_pylist()]
        return Batch([x[0] for x in got], np.array([x[1] for x in got], np.int64), [x[2] for x in got], held.indices.to_numpy(), np.array(rows), np.array(owner, np.int64), len(texts))

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder step, so token strings are joined by one space; unknown ids are left out."""
        held = self.text
        return " ".join([held[i] for i in ids if i in held])


@functools.lru_cache(maxsize=2)
def encoder(path: str, cache: int = CACHE) -> PrefixBPE:
    return PrefixBPE(path, cache)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, token_ids (if asked for), n_tokens, ids_sha256, decoded_sha256 of every document."""
    ids = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([*ids, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def factory():
        bpe = encoder(path, SMALL_CACHE if with_ids else CACHE)

        def work(texts):
            b = bpe.batch(texts)
            return [*([b.ids()] if with_ids else []), pa.array(b.sizes()), b.digests(b.told), b.digests(b.decoded)]

        return work

    return map_texts(docs, factory, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_documents(docs, path, with_ids=False)
