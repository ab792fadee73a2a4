import math
import random

import pytest

from strandloom.__main__ import main
from strandloom.functions import kernel, long_units
from strandloom.operators import report
from strandloom.operators.decompose import decompose, global_units
from strandloom.operators.library import with_library
from strandloom.plans.options import Options

UNIT = "ACGGTTACCATGCAATCGGATTC"


def noisy(rnd, s, rate):
    return "".join(rnd.choice("ACGT") if rnd.random() < rate else c for c in s)


def test_long_coverage_matches_brute_force():
    rnd = random.Random(5)
    for k in range(30):
        unit = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(20, 26)))
        s = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 30))) + noisy(rnd, unit * rnd.randint(0, 4), 0.15) + "ACGT"[: k % 5]
        most, best = math.ceil(len(unit) * 0.3), []
        for a in range(len(s)):
            found = 0
            for phase in range(len(unit)):
                ring = (unit[phase:] + unit[:phase]) * (len(s) // len(unit) + 3)
                if a + 3 <= len(s) and s[a : a + 3] == ring[:3]:
                    at, n = a + 3, 0
                    while at + len(unit) <= len(s) and sum(x != y for x, y in zip(s[at : at + len(unit)], ring[at - a :], strict=False)) <= most:
                        at, n = at + len(unit), n + 1
                    found = max(found, n * len(unit))
            best.append(found)
        assert long_units.extents(kernel.encode(s), kernel.encode(unit), 0.3).tolist() == best
        for reps in (1, 2):
            want, at = [False] * len(s), 0
            for a, n in enumerate(best):
                if n >= reps * len(unit) and a >= at:
                    at = a + 3 + n
                    want[a:at] = [True] * (at - a)
            got = long_units.coverage(kernel.encode(s), kernel.encode(unit), reps, 0.3)
            assert (got.tolist() if got is not None else [False] * len(s)) == want


def test_similar_units():
    u = kernel.encode(UNIT)
    assert long_units.similar(u, kernel.encode(UNIT[9:] + UNIT[:9]), 0.0)
    assert long_units.similar(u, kernel.encode(UNIT[5:] + UNIT[1:5]), 0.3)
    assert not long_units.similar(u, kernel.encode("A" * len(UNIT)), 0.1)
    assert not long_units.similar(u, kernel.encode(UNIT * 2), 0.3)


def test_long_user_unit_is_found_with_errors():
    rnd = random.Random(6)
    r = kernel.decompose([noisy(rnd, UNIT * 8, 0.05)], Options(units=(UNIT,)))[0]
    assert r.pattern.endswith(">8") and len(r.units) == 1 and kernel.turned(r.units[0].text) == kernel.turned(UNIT)


def test_user_unit_stands_for_its_class():
    got = kernel.candidates(kernel.encode("CAG" * 9), Options(units=("GCA", "CAG", "GCA")))
    assert [kernel.text_of(c, n) for n, c in got if n == 3] == ["GCA"]
    with pytest.raises(ValueError):
        Options(units=("ACN",))


def test_automatic_long_units_are_distinct():
    got = [n for n, _ in kernel.candidates(kernel.encode("ACGTTGCATTAGGCATCCGA" * 4), Options(max_unit=20))]
    assert got.count(20) == 1


def test_automatic_long_units_stand_twice_in_a_row_and_repeat_no_part():
    far = "ACGTTGCATTAGGCATCCGG"
    lengths = lambda s: {n for n, _ in kernel.candidates(kernel.encode(s), Options())}
    assert 20 in lengths(far * 3) and 20 not in lengths(far + "TTTTT" + far)
    assert 20 not in lengths(("AC" * 9 + "AG") * 4)


def test_automatic_unit_of_20_bases(spark, tmp_path):
    from strandloom.__main__ import annotated, parser
    from strandloom.plans import queries

    unit = queries.TWENTY
    spark.createDataFrame([(k, 20) for k in range(3)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert {r.pattern for r in queries.QUERIES["decompose_twenty"](spark, str(tmp_path)).collect()} == {f"<{unit}>5"}
    (tmp_path / "a.fa").write_text("> r\n" + unit * 6 + "\n")
    assert [r.pattern for r in annotated(spark, parser().parse_args(["-f", str(tmp_path / "a.fa"), "-m", "21"])).collect()] == [f"<{unit}>6"]


def test_library(spark):
    rows = [(1, "AC" * 20), (2, "CA" * 20), (3, "AC")]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    assert sorted((r.read_id, r.pattern) for r in with_library(reads).collect() if r.read_id < 3) == [(1, "<AC>20"), (2, "<CA>20")]
    assert with_library(reads.where("read_id > 9")).collect() == []


def test_library_gives_each_read_the_best_of_all(spark):
    """Against all units of the library as options of each read: the same patterns."""
    rnd = random.Random(5)
    units = ["".join(rnd.choice("ACGT") for _ in range(20)) for _ in range(4)]
    rows = [(3 * k + n, u * 6 if n < 2 else noisy(rnd, u * 6, 0.12)) for k, u in enumerate(units) for n in range(3)]
    rows += [(50, "acgtt" * 5), (51, "ACGTT" * 7), (52, "GTTACCCGA"), (None, units[0] * 3), (None, ""), (53, None)]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    whole = {r.read_id: r.pattern for r in with_library(reads).collect()}
    library = tuple(r.canon for r in global_units(decompose(reads.where("read_id IS NOT NULL"))).where("freq > 1 AND length(canon) >= 20").collect())
    assert len(library) >= 4 and set(whole) >= {*range(12), 50, 51, None}
    together = {r.read_id: r.pattern for r in decompose(reads.where("read_id < 12"), Options(units=library)).collect()}
    assert {k: whole[k] for k in range(12)} == together


def test_short_units_of_a_library_change_nothing(spark):
    rows = [(1, "ACGTT" * 5), (2, "CGTTA" * 6), (3, "GGACGTTCC"), (4, "GACGTTCCACGTTG"), (5, "GGTTCC"), (6, "AACCAACC")]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    got, alone = with_library(reads).collect(), decompose(reads).collect()
    assert sorted(got) == sorted(alone)
    together = decompose(reads, Options(units=tuple(r.canon for r in global_units(decompose(reads)).collect()))).collect()
    assert {(r.read_id, r.discrepancy_ratio) for r in got} == {(r.read_id, r.discrepancy_ratio) for r in together}


def test_lines(spark, tmp_path):
    reads = spark.createDataFrame([(1, 0, "s", "read7", "AC" * 20, 1)], "read_id long, read_ord long, sample_id string, read_name string, seq string, group_size int")
    own = decompose(reads).join(reads, "read_id")
    for name, of, want in (
        ("p", report.pattern_statistics(own), " #haplotypes=1 (40,1,0.00) <AC>20 "),
        ("s", report.pattern_statistics(own, True), " #haplotypes=1 (s,read7,40,1,0.00) <AC>20 "),
        ("x", report.unit_summary(own, global_units(own)), " #haplotypes=1 (s,read7,40,1,1,0.00) [1 (0,AC,2,40,40)] #units=1 (AC,1) "),
        ("n", report.unit_summary(own.where("read_id > 9"), global_units(own.where("read_id > 9"))), " #haplotypes=0 "),
    ):
        report.write_line(of, str(tmp_path / name))
        assert "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))) == want
    assert report.pattern_statistics(own.where("read_id > 9")).collect() == []


def test_command_line(spark, tmp_path):
    head = "GroupSize = 10, Diameter = 4, RadiusFromCentroid = 4, CentroidReadName = s1,read7, CentroidReadLength = 40"
    (tmp_path / "a.fa").write_text(f"> {head}\n" + "AC" * 20 + "\n> plain\n" + "CAG" * 12 + "\n")
    (tmp_path / "haps").write_text("s1\t7\t100|200\n")
    main(["-f", str(tmp_path / "a.fa"), "-h", str(tmp_path / "haps"), "-s", "-d", *(x for k in "oipx" for x in (f"-{k}", str(tmp_path / k)))])
    read = lambda k: [line for p in sorted((tmp_path / k).glob("part-*")) for line in p.read_text().splitlines()]
    assert read("o")[:2] == ["> #Info (s1,read7,40,10,1,0.000) #Pat <AC>20 #Hap <100|200>", "AC" * 20]
    assert read("o")[2] == "> #Info (NA,NA,36,1,1,0.000) #Pat <CAG>12 #Hap <(null)>"
    assert read("i") == ["s1,read7 (40,10,1,0.000) [1 (0,AC,2,40,40)]", "NA,NA (36,1,1,0.000) [1 (0,AGC,3,36,36)]"]
    assert "".join(read("p")).startswith(" #haplotypes=2 (s1,read7,40,10,0.00) <AC>20")
    assert "#units=2 (AC,1) (AGC,1)" in "".join(read("x"))
