import pytest

from strandloom.functions import dna
from strandloom.operators import blocks, evaluate, report, units
from strandloom.operators.decompose import add_haplotypes, decompose, global_units
from strandloom.plans.options import Options
from strandloom.sources import text as sources
from strandloom.streaming import stream
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"> one pattern=<AAAAT>23\r\nacg\r\nTT\r\n>empty\n>two\nAC GT")
    got = sources.read_fasta(spark, str(tmp_path / "a.fa")).collect()
    assert [(r.header, r.seq) for r in got] == [("one pattern=<AAAAT>23", "ACGTT"), ("two", "ACGT")]
    (tmp_path / "b.fa").write_text(">x\nACN\n>y\nAC\n")
    assert [r.header for r in sources.read_fasta(spark, str(tmp_path / "b.fa"), on_invalid="drop").collect()] == ["y"]
    with pytest.raises(Exception, match="invalid read"):
        sources.read_fasta(spark, str(tmp_path / "b.fa")).collect()
    (tmp_path / "c.fa").write_text("")
    assert sources.read_fasta(spark, str(tmp_path / "c.fa")).collect() == []


def test_expressions(spark):
    d = frame(spark, [("CAG", "AGC"), ("AA", "AC"), ("ACA", "CAA")], "a string, b string")
    got = d.select(dna.canon(F.col("a")), dna.same_unit(F.col("a"), F.col("b")), dna.unbordered(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("AGC", True, True), ("AA", False, False), ("AAC", True, False)]


def test_relational_route_finds_the_kernels_units(spark):
    from strandloom.functions.kernel import candidates, encode, text_of

    seqs = ["AC" * 20 + "AG" * 18, "CAG" * 9 + "CCG" * 7, "AAAAAA", "ACGT"]
    reads = frame(spark, list(enumerate(seqs)), "read_id long, seq string")
    got = units.canonical_units(units.candidate_units(reads, high=19)).collect()
    for k, s in enumerate(seqs):
        assert {r.unit for r in got if r.read_id == k} == {text_of(c, n) for n, c in candidates(encode(s), Options())}


def test_decompose(spark):
    reads = frame(spark, [(1, "AC" * 20 + "AG" * 18), (2, None), (3, ""), (4, "ACG"), (5, "cag" * 30), (1, "AC" * 20 + "AG" * 18)], "read_id long, seq string")
    own = decompose(reads)
    assert sorted((r.read_id, r.pattern) for r in own.collect()) == [(1, "<AC>20<AG>18"), (1, "<AC>20<AG>18"), (5, "<CAG>30")]
    assert {(r.canon, r.freq) for r in global_units(own).collect()} == {("AC", 1), ("AG", 1), ("AGC", 1)}
    marked = units.base_labels(decompose(reads.where("read_id = 5"), Options(labels=True))).collect()
    assert len(marked) == 90 and {r.prio for r in marked} == {0}
    with pytest.raises(Exception, match="letters other"):
        decompose(frame(spark, [(1, "ACN")], "read_id long, seq string")).collect()


def test_haplotypes_take_the_first_line(spark):
    r = frame(spark, [(1, "s", "read7"), (2, "s", "x")], "read_id long, sample_id string, read_name string")
    h = frame(spark, [("s", 7, "1|2", 0), ("s", 7, "3|4", 1)], "sample_id string, read_no int, pair_haps string, ord long")
    assert sorted((x.read_id, x.hap) for x in add_haplotypes(r, h).collect()) == [(1, "1|2"), (2, None)]


def test_smoothing_matches_the_kernel(spark):
    import numpy as np
    from strandloom.functions.kernel import smooth

    labels = [[0] * 20 + [1, 2] * 5 + [1] * 30, [0, 1, 1], [2] * 15 + [0] * 4]
    got = blocks.smooth(frame(spark, list(enumerate(labels)), "read_id long, labels array<int>"), 2).collect()
    for r in got:
        x = np.array(labels[r.read_id], np.int32)
        assert r.labels == smooth(smooth(x, 3), 3).tolist()


def test_haplotype_file_with_short_lines(spark, tmp_path):
    (tmp_path / "h").write_text("s1\t7  1|2\n\n s2 x 3|4 rest\ns3\n")
    assert [(r.sample_id, r.read_no, r.pair_haps) for r in sources.read_haplotypes(spark, str(tmp_path / "h")).orderBy("ord").collect()] == [("s1", 7, "1|2"), ("s2", None, "3|4"), ("s3", None, None)]


def test_trf_file(spark, tmp_path):
    hit = "1 90 2 12.7 {} 95 0 100 50 50 0 0 1.0 {} ACAC"
    (tmp_path / "t").write_text("@ (AC)12(AG)3\n" + hit.format(2, "CA") + "\n" + hit.format(200, "AG") + "\nshort line\n@ (A)1\n@(AC)11\r\n" + hit.format(2, "AC") + "\r\n")
    got = sources.read_trf(spark, str(tmp_path / "t")).orderBy("record")
    assert [(r.truth, [(h.unit, h.copies) for h in r.hits]) for r in got.collect()] == [("(AC)12(AG)3", [("CA", 12)]), ("(A)1", []), ("(AC)11", [("AC", 12)])]
    judged = evaluate.verdicts(evaluate.record_patterns(got), 0.0, "truth")
    assert [r.value for r in evaluate.verdict_lines(judged).collect()] == ["No\tAC 12 AG 3\tCA 12", "No\tA 1\t", "Yes\tAC 11\tAC 12"]
    assert tuple(evaluate.totals(judged).first()) == (1, 3)


def test_repeatmasker_scores(spark):
    hits = frame(spark, [("(AC)20(AG)9_1", 41, "GA", 20), ("(AC)20(AG)9_1", 1, "AC", 46), ("(AC)5", 1, "AC", 10), ("(AC)5", 12, "AC", 10)], "id string, begin int, unit string, len int")
    got = {r.id: r.verdict for r in evaluate.verdicts(evaluate.named_patterns(hits), 0.1, "truth").collect()}
    assert got == {"(AC)20(AG)9_1": "Yes", "(AC)5": "No"}


def test_accuracy_tolerance(spark):
    block = "array<struct<unit string, copies int>>"
    d = frame(spark, [([("AC", 10)], [("CA", 11)]), ([("AC", 10)], [("CA", 12)]), ([("AC", 10)], [("AC", 10), ("AG", 3)])], f"truth {block}, pred {block}")
    assert [r[0] for r in d.select(evaluate.agrees(F.col("truth"), F.col("pred"), 0.0)).collect()] == [True, False, False]


def test_simulated_reads_come_back(spark):
    own = sources.simulate(spark, ["ACC", "GTT"], 20, 12, 60)
    got = decompose(own).join(own, "read_id").select(evaluate.agrees(dna.parse_pattern(F.col("header")), dna.parse_pattern(F.col("pattern")), 0.1).alias("ok")).collect()
    assert len(got) == 20 and sum(r.ok for r in got) >= 18


def test_written_fasta(spark, tmp_path):
    reads = frame(spark, [(1, 0, "r", "AC" * 20, 1)], "read_id long, read_ord long, header string, seq string, group_size int")
    own = decompose(reads).join(reads, "read_id")
    report.write_fasta(own, global_units(own), str(tmp_path / "out"), locus="chr1:1-2")
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ["> #Locus chr1:1-2 #Info (40,1,0.000) #Pat <AC>20 #Decomp [1 (0,AC,2,40,40)]", "AC" * 20, "> #Locus chr1:1-2 frequent unit. freq. = 1", "AC"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a\n" + "AC" * 20 + "\n>b\n" + "CA" * 30 + "\n")
    counts = stream.stream_unit_counts(stream.stream_fasta(spark, str(tmp_path / "in")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("units").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.canon, r.freq) for r in spark.table("units").collect()] == [("AC", 2)]
