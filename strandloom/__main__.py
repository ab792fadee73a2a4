"""The command line: python -m strandloom -f reads.fa -o out."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import report
from strandloom.operators.decompose import add_haplotypes, decompose, global_units
from strandloom.plans.options import Options
from strandloom.sources import text as sources
from strandloom.sources.shared import stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description=__doc__, add_help=False)
    p.add_argument("--help", action="help")
    p.add_argument("-f", dest="fasta", required=True, help="FASTA of reads")
    p.add_argument("-o", dest="out", help="folder for annotated records and units")
    p.add_argument("-i", dest="table", help="folder for the table of reads")
    p.add_argument("-p", dest="patterns", help="folder for the pattern statistics")
    p.add_argument("-x", dest="summary", help="folder for the summary of units")
    p.add_argument("-l", dest="locus", help="text for #Locus")
    p.add_argument("-u", dest="unit", action="append", default=[], help="a further candidate unit; may be repeated")
    p.add_argument("-h", dest="haps", help="table of haplotypes")
    p.add_argument("-r", dest="ratio", type=float, default=Options.max_ratio, help="uncovered share that a run bears")
    p.add_argument("-s", dest="ids", action="store_true", help="show sample and read names")
    p.add_argument("-d", dest="no_decomp", action="store_true", help="leave #Decomp out")
    p.add_argument("-a", dest="annotation", action="store_true", help="repeat the header as #Annotation")
    p.add_argument("-t", dest="time", action="store_true", help="tell the seconds taken")
    p.add_argument("-y", dest="raw", action="store_true", help="no smoothing")
    p.add_argument("-z", dest="long", action="store_true", help="also try long units")
    p.add_argument("-m", dest="max_unit", type=int, choices=range(2, 31), default=Options.max_unit, metavar="2-30", help="bases of automatic units")
    return p


def annotated(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Results with all that the text forms need; the reads' own columns go through the decomposition as part of its key."""
    opts = Options(max_ratio=a.ratio, smooth=not a.raw, long_mode=a.long, max_unit=a.max_unit, units=tuple(u.upper() for u in a.unit))
    reads = sources.numbered(sources.read_fasta(spark, a.fasta))
    keyed = reads.select(F.struct("read_ord", "header", "seq").alias("read"), "seq")
    own = decompose(keyed, opts, key="read").select("read.*", "*").drop("read")
    own = own.withColumns(dna.parse_header(F.col("header")))
    return add_haplotypes(own, sources.read_haplotypes(spark, a.haps)) if a.haps else own


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    began = time.time()
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    own = annotated(spark, a)
    held = stored(own, "results")  # every text form reads the results again
    freq = global_units(held, "read_ord")
    if a.out:
        report.write_fasta(held, freq, a.out, locus=a.locus, with_ids=a.ids, decomp=not a.no_decomp, annotation=a.annotation)
    if a.table:
        report.write_table(held, a.table)
    if a.patterns:
        report.write_line(report.pattern_statistics(held, a.ids), a.patterns)
    if a.summary:
        report.write_line(report.unit_summary(held, freq), a.summary)
    if a.time:
        print(f"{a.fasta}\t{time.time() - began:.6f} sec", file=sys.stderr)


if __name__ == "__main__":
    main()
