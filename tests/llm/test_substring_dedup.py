import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import substring_dedup


def brute(rows, words):
    """(id, n_words, n_removed, kept_sha256) of every row, by comparing all windows as text."""
    own = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    order = lambda d: (d is None, d or 0)
    for d, w in own:
        for p in range(len(w) - words + 1):
            x = tuple(w[p : p + words])
            least[x] = min(least.get(x, order(d)), order(d))
    out = []
    for d, w in own:
        gone = {q for p in range(len(w) - words + 1) if least[tuple(w[p : p + words])] < order(d) for q in range(p, p + words)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def documents(n):
    r = random.Random(2)
    passages = [[r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(3, 30))] for _ in range(8)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choice(passages) if r.random() < 0.6 else [r.choice("klmnopqrst") * r.randint(1, 4) for _ in range(r.randint(1, 12))]
        rows.append((k, r.choice([" ", "\n", "\t\x0b", "  "]).join(w)))
    rows += [(n, None), (n + 1, ""), (None, rows[5][1]), (None, rows[5][1]), (None, "q w e r t y u i o p a s d"), (3, rows[3][1]), (3, rows[9][1]), (-5, rows[7][1])]
    return rows + [(n + 2, "z " * 400), (n + 3, "z " * 50 + "y " + "z " * 20), (n + 4, "a b \x1c c " * 9), (n + 5, "a b \x1c c " * 9)]


@pytest.mark.parametrize("words, chunk", [(13, 2_000_000), (4, 50), (1, 300)])
def test_removal_matches_brute_force(spark, monkeypatch, words, chunk):
    rows = documents(120)
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # columns whose names clash with what the operator makes
    docs = docs.withColumns({"key": F.lit(1), "row": F.lit("x"), "Starts": F.lit(2), "part": F.lit(3)})
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [tuple(r) for r in substring_dedup.removal_report(docs, words).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, words), key=key)


def test_text_and_intervals_are_given_out(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"first {passage}"), (2, f"so {passage} ends\n {passage}"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in substring_dedup.deduplicated(docs).collect()}
    assert rows[1].kept_text == f"first {passage}" and rows[1].removed == []
    assert rows[2].kept_text == "so ends" and [tuple(x) for x in rows[2].removed] == [(1, 21), (22, 42)]
    assert (rows[3].n_words, rows[3].kept_text) == (0, "")


def test_hot_windows_travel_once_a_chunk(spark):
    same = " ".join("abcdefghijklmnop")
    docs = spark.createDataFrame([(k, same) for k in range(500)], "doc_id long, text string").coalesce(1)
    asked = substring_dedup.keyed(docs).select("key", "row", "text").mapInArrow(substring_dedup.ask(3, 13), substring_dedup.QUESTIONS).collect()
    assert sum(len(r.hashes or b"") // 8 for r in asked) == 4
    assert substring_dedup.repeated_windows(docs).count() == 499


def test_no_documents(spark):
    assert substring_dedup.removal_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
