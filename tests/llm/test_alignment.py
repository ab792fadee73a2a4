import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a  b", "x▁y", "<|endoftext|> <s> hi</s>", "naïve  café\n\nfoo\tbar", "日本語 の テキスト", "a\x00b \x1c c", "don't stop 123,456", "  ", "　a b c d", "x" * 3000, "word " * 500]


def texts(n):
    r = random.Random(1)
    letters = "ab cd  \n\t.,'é日本 ​1２😀\x1c\x85᠎<>|s"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokens():
    return alignment.TokenBytes(A, B)


def brute(tokens, text):
    """(n_a, n_b, n_groups), groups, links: both encodings of the whole text, every pair of tokens compared."""
    text = text or ""
    want = (" " + text).encode()
    own = [(tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.bytes_a), (tokens.b.encode(text), tokens.bytes_b)]
    if not text or any(b"".join(table[i] for i in ids) != want for ids, table in own):
        return (0, 0, 0), "", Counter()
    spans = []
    for ids, table in own:
        at, found = 0, []
        for i in ids:
            found.append((at, at := at + len(table[i]), i))
        spans.append(found)
    groups, low = [], 0
    for cut in sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]}):
        groups.append("|".join(",".join(str(s[2]) for s in side if low < s[1] <= cut) for side in spans))
        low = cut
    links = Counter((a[2], b[2]) for a in spans[0] for b in spans[1] if a[0] < b[1] and b[0] < a[1])
    return (len(spans[0]), len(spans[1]), len(groups)), ";".join(groups), links


def wanted(tokens, own):
    """The query's rows without doc_id."""
    found = [brute(tokens, t) for t in own]
    count = sum((links for _, _, links in found), Counter())
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (*n, sum(links.values()), sum(k for p, k in links.items() if count[p] == most[p[1]]), sum(k * count[p] for p, k in links.items()), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for n, g, links in found
    ]


@pytest.mark.parametrize("kept", [4_000_000, 60])
def test_segments_match_whole_texts(tokens, monkeypatch, kept):
    monkeypatch.setattr(alignment, "KEPT_CHARS", kept)
    own, aligner = texts(600), alignment.Aligner(tokens)
    assert tokens.apart
    for k in range(0, len(own), 40):
        counts, groups, begin, pairs, times = aligner.align(own[k : k + 40])
        for i, t in enumerate(own[k : k + 40]):
            n, g, links = brute(tokens, t)
            got = {(p >> alignment.BITS, p & (1 << alignment.BITS) - 1): x for p, x in zip(pairs[begin[i] : begin[i + 1]].tolist(), times[begin[i] : begin[i + 1]].tolist(), strict=True)}
            assert (*counts[i].tolist(), groups[i], got) == (*n, sum(links.values()), g, dict(links))


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, 0])
def test_cross_alignment_matches_brute_force(spark, tokens, sent):
    own = [*texts(150), None, "word word", "word word"]
    docs = spark.createDataFrame([(k if k % 7 else 3, t) for k, t in enumerate(own)] + [(None, "no id")], "doc_id long, text string")
    # columns whose names clash with what the operator makes
    docs = docs.withColumns({"pairs": F.lit(1), "row_": F.lit(2), "Times": F.lit("x"), "n_best": F.lit(3)})
    want = wanted(tokens, [*own, "no id"])
    rows = alignment.cross_alignment(docs, A, B, sent).collect()
    ids = [*(k if k % 7 else 3 for k in range(len(own))), None]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in rows), key=key) == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=key)


def test_groups_and_pairs_are_given_out(spark, tokens):
    docs = spark.createDataFrame([(1, "unhappiness is"), (2, None)], "doc_id long, text string")
    out = alignment.align(docs, A, B)
    assert [r.groups for r in out.orderBy("doc_id").collect()] == [brute(tokens, "unhappiness is")[1], ""]
    count = {(r.a, r.b): r.n for r in alignment.pair_counts(out).collect()}
    assert count == dict(brute(tokens, "unhappiness is")[2])


def test_no_documents(spark):
    assert alignment.cross_alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
