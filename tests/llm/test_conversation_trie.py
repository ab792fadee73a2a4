import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import conversation_trie


def originals(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(own):
    members = defaultdict(list)
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, ids in members.items():
        under = [k for k in members if k[: len(node)] == node]
        kids = {k: any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members) for k in under}
        ends = ",".join(map(str, sorted(c for c in ids if len(own[c]) == len(node))))
        out.add(
            (min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(k) == len(node) + 1 for k in under), sum(not x for x in kids.values()),
             sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k), hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def conversations(n, deep):
    r = random.Random(4)
    rows = []
    for c in range(n):
        for turn in range(r.choice([1, 2, 3, 6, 9])):
            rows.append((c * 7, turn, r.choice(["user", "assistant"]) if r.random() < 0.2 else "user", r.choice(["hi", "ok then", "é🎉"]) if r.random() < 0.7 else "hi"))
    rows += [(1, None, None, None), (1, None, "", ""), (1, 5, "user", "hi"), (1, 5, "user", None), (2, 0, "a:1", "b"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(9000 + k, t, "user", "hi" if t < deep - k else "other") for k in range(3) for t in range(deep)]
    return rows


@pytest.mark.parametrize("deep", [1, 33])
@pytest.mark.parametrize("form", ["rebuilt", "plain"])
def test_trie_matches_brute_force(spark, form, deep):
    rows = conversations(60, deep)
    random.Random(5).shuffle(rows)
    # columns whose names clash with what the operator makes
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"p": F.lit(1), "N": F.lit(2), "x": F.lit("q"), "depth": F.lit(0), "h": F.lit(0)})
    own = originals(rows)
    got = [tuple(r) for r in conversation_trie.trie(getattr(conversation_trie, form)(table)).collect()]
    want = brute(rebuilt(own) if form == "rebuilt" else own)
    assert len(got) == len(want) and set(got) == want


def test_ends_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_IDS", 8)
    rows = [(c, 0, "user", "same") for c in range(95, 140)] + [(-3, 0, "user", "same")]
    own = originals(rows)
    got = {tuple(r) for r in conversation_trie.trie(conversation_trie.plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == brute(own)


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert conversation_trie.trie(conversation_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).count() == 0
