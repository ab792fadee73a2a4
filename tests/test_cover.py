import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna, kernel, long_units, spans
from strandloom.functions.kernel import turned
from strandloom.operators import cover, seeds, suffixes, units
from strandloom.plans import queries
from strandloom.plans.options import Options


def as_spans(bits):
    edge = np.flatnonzero(np.diff(np.asarray(bits, bool), prepend=False, append=False)).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def mosaic(rnd, error=0.08):
    out = "".join(rnd.choice(["AC", "AG", "ACAG", "CAG", "AAT", "ACGTC"]) * rnd.randint(1, 9) for _ in range(rnd.randint(1, 5)))
    return "".join(rnd.choice("ACGT") if rnd.random() < error else c for c in out)


def test_sets_of_intervals(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(200):
        x, y = ([bool(rnd.random() < 0.4) for _ in range(30)] for _ in range(2))
        rows.append((k, as_spans(x), as_spans(y), as_spans(np.array(x) | np.array(y)), as_spans(np.array(x) & np.array(y))))
    df = spark.createDataFrame(rows, f"k int, x {spans.SPANS}, y {spans.SPANS}, u {spans.SPANS}, i {spans.SPANS}")
    got = df.select(spans.union(F.col("x"), F.col("y")) == F.col("u"), spans.merged(spans.intersection(F.col("x"), F.col("y"))) == F.col("i"), spans.total(F.col("u")) == F.expr("aggregate(u, 0, (n, s) -> n + s.b - s.a)"))
    assert all(all(r) for r in got.collect())


@pytest.mark.parametrize("ratio", [0.3, 0.05, 0.6])
def test_scan_matches_the_kernel(spark, ratio):
    rnd = random.Random(2)
    rows, want = [], {}
    for k in range(300):
        n, size, reps = rnd.randint(1, 90), rnd.randint(2, 19), rnd.choice([1, 2])
        bits = lambda p: np.array([v for _ in range(n) for v in [rnd.random() < p] * rnd.randint(1, 8)][:n])  # noqa: B023, E731
        cov, taken = bits(0.6), bits(rnd.choice([0, 0.2]))
        after = taken.copy()
        want[k] = kernel.run_scan(cov, size, reps, ratio, after, True), as_spans(after)
        rows.append((k, n, "A" * size, reps, as_spans(cov), as_spans(taken)))
    df = spark.createDataFrame(rows, f"k int, n int, unit string, reps int, spans {spans.SPANS}, taken {spans.SPANS}")
    for reps in (1, 2):
        own = cover.once(df.where(F.col("reps") == reps), p=spans.pieces(F.col("n"), F.col("spans"), F.col("taken")))
        own = cover.once(own, s=spans.scan(F.col("p"), F.length("unit"), reps, ratio))
        for r in own.select("k", "s.explained", spans.union(F.col("taken"), spans.intersection(F.col("spans"), F.col("s.runs"))).alias("after")).collect():
            assert (r.explained, [tuple(x) for x in r.after]) == want[r.k]


def test_exact_spans_match_the_kernel(spark):
    rnd = random.Random(3)
    rows = [(k, mosaic(rnd), rnd.choice(["AC", "AG", "CAG", "AAT", "AAAG"])) for k in range(150)]
    for reps in (1, 2, 3):
        got = spark.createDataFrame(rows, "k int, seq string, unit string").select("k", spans.exact(F.col("seq"), F.col("unit"), reps).alias("s")).collect()
        for (_, seq, unit), r in zip(rows, sorted(got), strict=True):
            cov = next(kernel.coverage(kernel.encode(seq), [(len(unit), kernel.code_of(unit))], reps, 0.3))
            assert [tuple(x) for x in r.s] == ([] if cov is None else as_spans(cov))


@pytest.mark.parametrize("reps", [2, 1])
def test_key_units_match_the_kernel(spark, reps):
    rnd = random.Random(4)
    opts = Options(max_unit=19)
    rows = [(k, mosaic(rnd)) for k in range(60)] + [(100, "ACGT"), (101, "A" * 30), (102, "")]
    # the second choice depends on the first: beside AC and AG their sum explains nothing more
    rows += [(103, "AC" * 12 + "ACAG" * 3 + "AG" * 9), (104, "AG" * 5 + "CAGAG" * 4 + "CAG" * 8)]
    reads = spark.createDataFrame(rows, "read_id int, seq string")
    got = {r.read_id: r.chosen for r in cover.key_units(reads, suffixes.candidate_units(reads, 2, 19), opts, reps).collect()}
    for k, seq in rows:
        codes = kernel.encode(seq)
        want = kernel.select(codes, kernel.candidates(codes, opts), reps, opts, False) if len(seq) else []
        assert got.get(k, []) == want, seq


def test_candidates_from_suffixes(spark):
    rnd = random.Random(5)
    rows = [(k, mosaic(rnd)) for k in range(30)] + [(40, "A" * 25), (41, "ACGT"), (42, ""), (43, "C"), (44, None), (45, "ACGTTGCATTAGGCATCCGA" * 3 + "ACGTTGCATTAGGCATCCGATT" * 2)]
    reads = spark.createDataFrame(rows, "read_id int, seq string")
    key = lambda df: sorted(map(tuple, df.select("read_id", "unit", "n_occ").collect()))
    assert key(suffixes.candidate_units(reads)) == key(units.candidate_units(reads))
    assert key(suffixes.candidate_units(reads, 3, 40)) == key(units.candidate_units(reads, 3, 40))


def test_suffix_array(spark):
    rnd = random.Random(6)
    rows = [(k, mosaic(rnd, 0.02)) for k in range(8)] + [(20, "AC" * 50), (21, "T"), (22, "")]
    got = suffixes.suffix_array(spark.createDataFrame(rows, "read_id int, seq string")).collect()
    for k, seq in rows:
        own = [r.pos for r in sorted((r for r in got if r.read_id == k), key=lambda r: r.place)]
        assert own == [p + 1 for p in sorted(range(len(seq)), key=lambda p: seq[p:])]


def test_least_rotation(spark):
    rnd = random.Random(7)
    own = ["A", "AC", "CA", "CAGCAG", "AAAA", "TA", *("".join(rnd.choice("ACGT"[: rnd.randint(2, 4)]) for _ in range(rnd.randint(1, 30))) for _ in range(300)), "".join(rnd.choice("AC") for _ in range(999))]
    df = spark.createDataFrame([(u, turned(u)) for u in own] + [(None, None)], "unit string, want string")
    assert all(r[0] for r in df.select(dna.canon(F.col("unit")).eqNullSafe(F.col("want"))).collect())


def erring(rnd, text, share):
    return "".join(rnd.choice("ACGT".replace(c, "")) if rnd.random() < share else c for c in text)


def test_seeds_find_what_lies_on_diagonals(spark):
    """Against laying every unit along every read: the same spans where copies err in up to a seventh of their bases, and none made up."""
    rnd = random.Random(8)
    library = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(20, 60))) for _ in range(12)]
    rows = []
    for k, u in enumerate(library):
        p = rnd.randrange(len(u))
        rows += [(3 * k, u * 4), (3 * k + 1, erring(rnd, (u[p:] + u[:p]) * 5, 0.1)), (3 * k + 2, "ACGT"[k % 4] * 9 + erring(rnd, u * 3, 0.14) + erring(rnd, library[k - 1] * 3, 0.1))]
    rows += [(900, "ACG"), (901, ""), (902, None), (903, "AC" * 60)]
    reads = spark.createDataFrame(rows, "read_id int, seq string")
    index = seeds.seed_index(spark.createDataFrame([(u,) for u in [*library, library[0]]], "unit string"))
    found = seeds.laid(reads, seeds.diagonals(reads, index)).collect()
    every = {}
    for k, seq in rows:
        for u in library if seq else []:
            for r in (2, 1):
                cov = long_units.coverage(kernel.encode(seq), kernel.encode(u), r, 0.3)
                if cov is not None:
                    every[k, u] = r, as_spans(cov)
                    break
    got = {(r.read_id, r.unit): (r.reps, [tuple(s) for s in r.spans]) for r in found}
    own = {(3 * k + d, library[k]) for k in range(12) for d in range(3)} | {(3 * k + 2, library[k - 1]) for k in range(12)}
    assert own <= got.keys()
    bases = lambda s: sum(b - a for a, b in s)
    assert all(bases(got[x][1]) >= 0.97 * bases(every[x][1]) for x in own)
    assert all(x in every and bases(got[x][1]) <= bases(every[x][1]) for x in got)


def test_units_that_stand_once_give_way_to_those_that_stand_twice(spark, tmp_path):
    """the unit of supplier 605 resembles a turn of the long unit and covers some reads once; that of 19244 covers reads that no unit covers twice."""
    spark.range(18).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(605,), (19244,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1).selectExpr("id AS r_regionkey").write.parquet(f"{tmp_path}/region.parquet")
    made = {r.unit for r in queries.unit_library(spark, str(tmp_path)).collect()}
    reads = queries.erring_copies(spark, str(tmp_path))
    once = {(r.unit, r.read_id % 9) for r in seeds.laid(reads, seeds.diagonals(reads, seeds.seed_index(queries.unit_library(spark, str(tmp_path))))).collect() if r.reps == 1}
    other = made - {queries.LONG_UNIT}
    assert {e for u, e in once if u in other} == {0, 1, 2, 8}
    got = {(r.unit, r.reps, r.read_id % 9) for r in queries.QUERIES["long_unit_seeds"](spark, str(tmp_path)).collect()}
    assert {x for x in got if x[2] < 8} == {(queries.LONG_UNIT, 2, e) for e in range(8)}
    assert {(reps, u in other) for u, reps, e in got if e == 8} == {(1, True)}
