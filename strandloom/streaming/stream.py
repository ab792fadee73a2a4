"""Streams of reads: decomposition is stateless, unit frequencies are a running aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators.decompose import decompose
from strandloom.plans.options import Options
from strandloom.sources.text import records


def stream_fasta(spark: SparkSession, path: str, on_invalid: str = "fail", max_read: int | None = None) -> DataFrame:
    """header, seq of the records of FASTA files as they appear in a folder."""
    return records(spark.readStream.option("lineSep", "\n>").text(path), on_invalid, max_read)


def stream_patterns(reads: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """header and decomposition of every read of a stream."""
    return decompose(reads, opts, key="header")


def stream_unit_counts(reads: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """canon, freq: running number of reads by unit; for update or complete output."""
    units = decompose(reads, opts, key="header").select(F.explode(F.array_distinct(F.transform("units", lambda u: dna.canon(u["unit"])))).alias("canon"))
    return units.groupBy("canon").agg(F.count("*").alias("freq"))
