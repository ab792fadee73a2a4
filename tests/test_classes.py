import random

from strandloom.functions import kernel, long_units
from strandloom.operators.classes import class_frequencies, components, unit_classes
from tests.test_cover import erring


def test_components(spark):
    rnd = random.Random(1)
    edges = [(f"n{a:02}", f"n{b:02}") for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(45)) if a < b] + [(f"p{k:02}", f"p{k + 1:02}") for k in range(20)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()} == root
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_classes_match_all_pairs(spark):
    """Units that err in up to a seventh of their bases, lose one or are turned, among others; a class is what comparing all pairs gives."""
    rnd = random.Random(2)
    own = {"AC", "ACG"}
    for _ in range(8):
        u = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(20, 40)))
        own |= {kernel.turned(x) for x in (u, erring(rnd, u, 0.07), erring(rnd, u, 0.14), u[:5] + u[6:])}
    units = sorted(own)
    root = {u: u for u in units}
    pairs = [(a, b) for a in units for b in units if a < b and min(len(a), len(b)) >= 20 and long_units.similar(kernel.encode(a), kernel.encode(b), 0.3)]
    for _ in units:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.canon: r["class"] for r in unit_classes(spark.createDataFrame([(u,) for u in units], "canon string")).collect()}
    assert got == root
    rows = [(k % 7, u[3:] + u[:3]) for k, u in enumerate(units)]
    want = {}
    for k, u in rows:
        want.setdefault(root[kernel.turned(u)], set()).add(k)
    assert {r["class"]: r.freq for r in class_frequencies(spark.createDataFrame(rows, "read_id int, unit string")).collect()} == {c: len(x) for c, x in want.items()}
