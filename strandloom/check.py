"""Command lines of the checkers: python -m strandloom.check annotated -i out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import evaluate
from strandloom.sources import text as sources
from strandloom.sources.shared import stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom.check", description=__doc__, add_help=False)
    p.add_argument("--help", action="help")
    p.add_argument("what", choices=("annotated", "repeatmasker", "trf", "parse"), help="records with #Pat and #Annotation, RepeatMasker's or TRF's output; or a table of RepeatMasker's hits")
    p.add_argument("-i", dest="input", required=True, help="file or folder")
    p.add_argument("-a", dest="allowance", type=float, default=0.1, help="share of copies by which a block may be off, beside one copy")
    p.add_argument("-p", dest="each", action="store_true", help="also print the verdict on each read")
    p.add_argument("-o", dest="out", help="folder for the table of hits")
    p.add_argument("-h", dest="homopolymers", action="store_true", help="keep units of one base in the table")
    return p


def scored(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """truth, pred and seq_len (null where the file has no reads) of each read of the input."""
    none = F.lit(None).cast("int").alias("seq_len")
    if a.what == "annotated":
        reads = sources.read_fasta(spark, a.input)
        own = evaluate.annotated_patterns(reads.select(F.struct("header", F.length("seq").alias("n")).alias("read"), "header").select(F.concat_ws("\0", F.col("read.n").cast("string"), "header").alias("header")))
        return own.select("truth", "pred", F.substring_index("header", "\0", 1).cast("int").alias("seq_len"))
    if a.what == "trf":
        return evaluate.record_patterns(sources.read_trf(spark, a.input)).select("truth", "pred", none)
    return evaluate.named_patterns(sources.parse_repeatmasker(spark.read.text(a.input))).select("truth", "pred", none)


def hits_table(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """value: read, its length, begin, end, length, unit and class of RepeatMasker's hits, between tabs."""
    own = sources.parse_repeatmasker(spark.read.text(a.input), a.homopolymers)
    return own.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("id", "total_len", "begin", "end", "len", "unit", "class"))).alias("value"))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandloom-check").getOrCreate()
    if a.what == "parse":
        if not a.out:
            raise SystemExit("parse needs -o")
        hits_table(spark, a).write.text(a.out)
        return
    of = "prediction" if a.what == "annotated" else "truth"
    judged = stored(evaluate.verdicts(scored(spark, a), a.allowance, of), "verdicts")
    if a.each:
        for r in evaluate.verdict_lines(judged).toLocalIterator():
            print(r.value)
    n = judged.agg(F.count_if(F.col("verdict") == "Yes").alias("hits"), F.count("*").alias("total"), F.floor(F.avg("seq_len")).alias("mean")).first()
    print(*(x for x in n if x is not None))


if __name__ == "__main__":
    main()
