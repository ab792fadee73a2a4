import pytest
from pyspark.sql import functions as F

import strandloom.operators.decompose as decompose
from strandloom.operators import classes, seeds, staged, suffixes, units
from strandloom.operators.texts import by_text, once_each
from strandloom.plans import queries
from strandloom.sources import text


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Parts of which twelve at a time give one mosaic."""
    path = tmp_path_factory.mktemp("tables")
    part = spark.range(48).selectExpr("id % 2 + 20 * id AS p_partkey", "cast(id div 2 % 2 * 9 AS int) AS p_size", "concat('b', id % 3) AS p_brand")
    part.write.parquet(f"{path}/part.parquet")
    spark.range(6).selectExpr("id AS s_suppkey").write.parquet(f"{path}/supplier.parquet")
    spark.range(5).selectExpr("id AS r_regionkey").write.parquet(f"{path}/region.parquet")
    return str(path)


def test_rows_of_texts_reach_all_reads(spark):
    reads = spark.createDataFrame([(1, "AC", "x"), (2, "AC", "y"), (2, "AC", "z"), (3, "", "x"), (4, None, "x"), (5, "AG", "x")], "read_id int, seq string, name string")
    seen = []

    def work(texts):
        seen.append(sorted(map(str, (r.seq for r in texts.collect()))))
        return texts.select("read_id", F.explode(F.split(F.coalesce("seq", F.lit("nul")), "")).alias("letter")).where("letter != 'G'")

    got = sorted(map(tuple, by_text(reads, work).collect()))
    assert seen == [["", "AC", "AG", "None"]]
    assert got == sorted([(1, "x", c) for c in "AC"] + [(2, n, c) for n in "yz" for c in "AC"] + [(3, "x", "")] + [(4, "x", c) for c in "nul"] + [(5, "x", "A")])


def test_values_that_work_drops_go(spark):
    rows = spark.createDataFrame([(k, k % 3, None if k % 2 else "b") for k in range(12)], "k int, a int, b string")
    got = once_each(rows, ["a", "b"], lambda own: own.where("a < 2").withColumn("c", F.concat_ws(":", F.col("a").cast("string"), "b")))
    assert sorted(map(tuple, got.collect())) == [(k, k % 3, None if k % 2 else "b", f"{k % 3}" + ("" if k % 2 else ":b")) for k in range(12) if k % 3 < 2]


def rows_given(monkeypatch, module, name, run):
    """Rows of what a function gets in a run of a query, and the rows of the result."""
    given, own = [], getattr(module, name)

    def spy(first, *rest, **named):
        given.append(first.count())
        return own(first, *rest, **named)

    monkeypatch.setattr(module, name, spy)
    return given, run().count()


@pytest.mark.parametrize("query, rows", [("key_units", 48), ("suffix_candidates", None), ("suffix_array", None)])
def test_suffixes_of_distinct_reads(spark, tables, monkeypatch, query, rows):
    given, n = rows_given(monkeypatch, suffixes, "suffix_names", lambda: queries.QUERIES[query](spark, tables))
    assert given == [4] and (n >= 48 if rows is None else n == rows)


@pytest.mark.parametrize("query, module, name", [("candidate_units_canon", units, "canonical_units"), ("unit_penalty_top5", units, "top_units"), ("prune_95", units, "prune"), ("long_unit_seeds", seeds, "diagonals"), ("decompose_staged", staged, "staged"), ("decompose_blocks", decompose, "aligned"), ("class_frequencies", classes, "unit_classes")])
def test_steps_get_distinct_texts(spark, tables, monkeypatch, query, module, name):
    given, _ = rows_given(monkeypatch, module, name, lambda: queries.QUERIES[query](spark, tables))
    assert len(given) == 1 and given[0] < 48


@pytest.mark.parametrize("error", [0.0, 0.3, 1.0])
def test_drawn_errors_match_the_expression(spark, error):
    reads = spark.createDataFrame([(k, "ACGT" * (k % 7) + "CA") for k in range(50)] + [(99, None)], "read_id long, seq string")
    got = {r.read_id: r.seq for r in text.with_errors(reads, error).collect()}
    other = {c: "ACGT".replace(c, "") for c in "ACGT"}
    told = F.transform(F.split("seq", ""), lambda c, p: F.array(*(text.draw(F.col("read_id") * 1_000_003 + p * 7_919 + 42, w) for w in (100, 101, 102, 103))))
    for r in reads.where("seq is not null").withColumn("draws", told).collect():
        one = lambda c, d: c if d[0] % 1_000_000 >= error * 1_000_000 else [c + "ACGT"[d[3] % 4], "", other[c][d[2] % 3]][d[1] % 3]  # noqa: B023, E731
        assert got[r.read_id] == "".join(map(one, r.seq, r.draws))
    assert got[99] is None


@pytest.mark.parametrize("query, most", [("unit_summary", [4]), ("decompose_one_error", [12]), ("unit_records", [4]), ("published_example", [1, 1, 1]), ("decompose_blocks", [4])])
def test_one_alignment_a_text(spark, tables, monkeypatch, query, most):
    """F30 to F34: the reads that are aligned grow with the distinct texts and not with the rows."""
    given, n = rows_given(monkeypatch, decompose, "aligned", lambda: queries.QUERIES[query](spark, tables))
    assert len(given) == len(most) and all(a <= b for a, b in zip(given, most, strict=True)) and n > 0
