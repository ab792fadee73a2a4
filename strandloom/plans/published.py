"""Queries whose results are published: example reads with their patterns, and accuracy by error rate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import evaluate
from strandloom.operators.decompose import decompose
from strandloom.plans.options import Options
from strandloom.sources import text as sources

#: The example read with its patterns by option.
EXAMPLE = "CAGCAGCAGCAGCAGCAGCAGCAGCAGCAGCAGCAGCAGCAGCAGCAGCAGCAACAGCCGCCACCGCCGCCGCCGCCGCCGCCGCCTCCTCAGCTTCCTCAGCCGCCGCCGCAGGCACAGCCGCTGCTGCCTCAGCCGCAGCCGCCCCCGCCGCCGCCCCCCGCCGCCACC"
EXAMPLE_PATTERNS = [
    ("default", Options(), "<CAG>19<CCG>38", 0.129),
    ("no smoothing", Options(smooth=False), "<CAG>19<CCG>9<CCT>2<CAGCTTCCT>1<GCC>4<GCA>2<CCG>1<CTG>2<CCTC>1<AGCCGC>2<CCG>8", 0.041),
    ("long units", Options(long_mode=True), "<CAG>20<CCG>10<CCGCAG>8<CCG>8", 0.099),
]
#: Short real reads and their patterns, of which units may be turned and copies differ by one.
REAL = [
    ("intron", "AAATAAAATAAAATAAAATAAAATAAAATAAAATAAAATAAAATAAAATAAAATAAAATAAAATAAAATAATAAAATAAAATAAAATAAAATAAAATAAAATAAAAATGAACAAAA", "<AAAAT>23"),
    ("five", "AAAAGAAAAGAAAAGAAAAGAAAAGAAAAGAAAAGAAAAGAAAAGAAAAGAAAAGAAAA", "<AAAAG>11"),
    ("two units", "AAAGAAAGAAAGAAAGAAAGAAAGAGAGAGAGAGAGAGAGAGAGAGAAAGAAAGAAAGAAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAAGAAA", "<AAAG>6<AG>11<AAAG>20"),
    ("end", "TTTTCTTTTCTTTTCTTTTCTTTTCTTTTCTTTTCTTTTCTTTTCTTTTCTTTTCTTTTCTTTTCTTGTCTTGTCTTGTCTTCTTTTCTTTTCTTT", "<TTTTC>12<CTTGT>2<TTTTC>3"),
]
#: Right patterns of 1,000 reads with 10 to 199 copies of each unit, by error rate, for these allowances.
ERRORS = [0.0, 0.01, 0.03, 0.05, 0.1, 0.15]
ALLOWANCES = [0.0, 0.01, 0.03, 0.1]
ACCURACY = {
    "AC_AG": [(992, 992, 992, 992), (923, 994, 996, 996), (664, 964, 989, 992), (502, 910, 984, 993), (286, 707, 914, 983), (219, 563, 836, 963)],
    "ACC_GTT": [(998, 998, 998, 998), (967, 1000, 1000, 1000), (809, 995, 999, 999), (659, 978, 999, 999), (515, 894, 992, 995), (327, 747, 914, 946)],
    "AAG_AG": [(991, 991, 991, 991), (849, 980, 991, 992), (556, 876, 953, 983), (361, 753, 901, 971), (191, 465, 712, 885), (90, 260, 450, 660)],
    "AAG_AGG": [(998, 998, 998, 998), (926, 998, 999, 999), (705, 981, 996, 999), (524, 893, 980, 998), (330, 719, 922, 984), (223, 539, 782, 908)],
    "AAAG_AG": [(982, 982, 982, 982), (878, 978, 988, 990), (633, 941, 974, 987), (444, 840, 949, 973), (266, 619, 833, 943), (176, 433, 639, 793)],
    "AAAG_AG_AAAG": [(922, 922, 922, 922), (771, 928, 937, 940), (430, 816, 920, 948), (268, 714, 864, 924), (121, 478, 718, 886), (67, 234, 414, 638)],
    "AAAG_AG_AGGG_AG_AAAG": [(954, 957, 957, 957), (641, 910, 939, 948), (234, 680, 862, 934), (104, 518, 789, 925), (27, 222, 531, 819), (4, 77, 229, 539)],
    "AGGGG_AAAAGAAAGAGAGGG_AGGGG": [(996, 996, 996, 996), (986, 999, 999, 999), (854, 956, 958, 958), (223, 302, 304, 306), (0, 1, 1, 1), (0, 0, 0, 0)],
}


#: Simulated reads that one task aligns, nearly all of them different: some 30 seconds.
TASK_READS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(rows: list[tuple], names: str, by: Column) -> Column:
    """The row that a number picks, in turn, as a struct."""
    own = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names.split(), strict=True))) for r in rows))
    return F.get(own, (by % len(rows)).cast("int"))


def example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, option, pattern, ratio of the example read, of which every supplier has a copy."""
    reads = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("read_id"), F.lit(EXAMPLE).alias("seq"))

    def one(name, opts):
        own = decompose(reads, opts)
        return own.select("read_id", F.lit(name).alias("option"), "pattern", dna.ratio_text(F.col("discrepancy_ratio")).alias("ratio"))

    return reduce(DataFrame.unionByName, [one(name, opts) for name, opts, *_ in EXAMPLE_PATTERNS])


def real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, name, truth, agrees of the real reads, of which every supplier has one."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("read_id"), pick(REAL, "name seq truth", F.col("s_suppkey")).alias("r"))
    reads = own.select(F.struct("read_id", "r.name", "r.truth").alias("read"), "r.seq")
    found = decompose(reads, key="read").select("read.*", "pattern")
    return found.select("read_id", "name", "truth", evaluate.agrees(dna.parse_pattern(F.col("truth")), dna.parse_pattern(F.col("pattern")), 0.0).alias("agrees"))


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read (dataset, error, truth), seq: a read of each data set for every part; the error rates take turns. The keys are dealt out, and the far larger reads stay where they are made."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("read_id"))
    tasks = keys.count() * len(ACCURACY) // TASK_READS
    dealt = keys.repartition(max(spark.sparkContext.defaultParallelism, tasks))
    error = F.get(F.array(*map(F.lit, ERRORS)), (F.col("read_id") % len(ERRORS)).cast("int"))

    sets = F.array(*(F.struct(F.lit(name).alias("dataset"), F.lit(42 + k).alias("seed"), F.array(*map(F.lit, name.split("_"))).alias("units")) for k, name in enumerate(ACCURACY)))
    truth, clean = sources.mosaic(F.col("read_id"), F.col("units"), F.col("seed"))
    reads = dealt.select("read_id", F.inline(sets)).select("read_id", F.struct("dataset", error.alias("error"), truth.alias("truth")).alias("read"), clean.alias("seq"))
    return sources.with_errors(reads, F.col("read.error"))


def accuracy_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, error, allowance, total, reached: whether the share of right patterns is the published one or more, but for three standard deviations of so many reads and ten points; reads with a unit of 15 bases at 5 % errors are the ones that fall short by more than two."""
    reads = simulated(spark, sf_dir)
    found = decompose(reads, key="read", repeated=False).select("read.*", "pattern", "seq_len")
    scored = found.select("dataset", "error", "seq_len", dna.parse_pattern(F.col("truth")).alias("truth"), dna.parse_pattern(F.col("pattern")).alias("pred"))
    score = evaluate.accuracy(scored, ["dataset", "error"], ALLOWANCES)
    wanted = [(name, e, a, n / 1000) for name, rows in ACCURACY.items() for e, row in zip(ERRORS, rows, strict=True) for a, n in zip(ALLOWANCES, row, strict=True)]
    known = spark.createDataFrame(wanted, "dataset string, error double, allowance double, share double")
    least = F.col("share") - 3 * F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("total")) - 0.1
    return score.join(F.broadcast(known), ["dataset", "error", "allowance"]).select("dataset", "error", "allowance", "total", (F.col("hits") / F.col("total") >= least).alias("reached"))


def values(rows: list[tuple], names: str) -> str:
    told = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) AS v({names})"


QUERIES = {"published_example": example, "published_real_reads": real, "accuracy_by_error": accuracy_by_error}
ORACLES = {
    "published_example": f"SELECT s_suppkey AS read_id, v.* FROM supplier, ({values([(name, pattern, f'{ratio:.3f}') for name, _, pattern, ratio in EXAMPLE_PATTERNS], chr(34) + 'option' + chr(34) + ', pattern, ratio')}) v",
    "published_real_reads": f"SELECT s_suppkey AS read_id, name, truth, TRUE AS agrees FROM supplier JOIN ({values([(k, name, truth) for k, (name, _, truth) in enumerate(REAL)], 'k, name, truth')}) v ON s_suppkey % {len(REAL)} = k",
    "accuracy_by_error": f"SELECT dataset, error, allowance, n AS total, TRUE AS reached FROM (VALUES {', '.join(f'({n!r})' for n in ACCURACY)}) d(dataset), (SELECT p_partkey % {len(ERRORS)} AS k, count(*) AS n FROM part GROUP BY ALL) p JOIN (VALUES {', '.join(f'({k}, {e}::DOUBLE)' for k, e in enumerate(ERRORS))}) e(k, error) USING (k), (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALLOWANCES)}) a(allowance)",
}
