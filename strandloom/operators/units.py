"""Candidate units, their coverage and their selection, as relations.

Every operator takes reads (read_id, seq) or what another one returns. Long
reads go through the kernel instead: an explode has up to 19 rows a base.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import dna, kernel, long_units
from strandloom.functions.long_units import LONG
from strandloom.operators import cover, seeds
from strandloom.operators.decompose import spread
from strandloom.operators.texts import by_text, once_each
from strandloom.sources.shared import stored


def substrings(reads: DataFrame, low: int = 2, high: int = 20) -> DataFrame:
    """read_id, pos (from 1), unit: every substring of low to high bases."""
    n = F.length("seq")
    sized = spread(reads).where(n >= low).select("read_id", "seq", F.explode(F.sequence(F.lit(low), F.least(n, F.lit(high)))).alias("len"))
    placed = sized.select("read_id", "seq", "len", F.explode(F.sequence(F.lit(1), F.length("seq") - F.col("len") + 1)).alias("pos"))
    return placed.select("read_id", "pos", F.substring("seq", F.col("pos"), F.col("len")).alias("unit"))


def candidate_units(reads: DataFrame, low: int = 2, high: int = 20) -> DataFrame:
    """read_id, unit, n_occ: unbordered substrings that occur at least twice in the read."""
    found = substrings(reads, low, high).groupBy("read_id", "unit").agg(F.count("*").alias("n_occ")).where("n_occ >= 2")
    return found.where(dna.unbordered(F.col("unit")))


def canonical_units(units: DataFrame) -> DataFrame:
    """read_id, canon, unit: one unit of each class of rotations, the least that occurs."""
    return units.groupBy("read_id", dna.canon(F.col("unit")).alias("canon")).agg(F.min("unit").alias("unit"))


def all_substrings(reads: DataFrame, high: int = 19) -> DataFrame:
    """canon: distinct substrings up to rotation, those that end at the last base left out."""
    cut = reads.select(F.expr("substring(seq, 1, length(seq) - 1)").alias("seq")).distinct()
    return substrings(cut.select(F.lit(0).alias("read_id"), "seq"), 1, high).select("unit").distinct().select(dna.canon(F.col("unit")).alias("canon")).distinct()


def compression(reads: DataFrame) -> DataFrame:
    """units, substrings, ratio: distinct candidates against distinct substrings, both up to rotation, over all reads."""
    texts = stored(reads.select("seq").distinct().select(F.monotonically_increasing_id().alias("read_id"), "seq"), "texts")
    units = candidate_units(texts).select(dna.canon(F.col("unit")).alias("canon")).agg(F.count_distinct("canon").alias("units"))
    every = all_substrings(texts).agg(F.count("*").alias("substrings"))
    # both sides are one row
    return units.crossJoin(every).select("units", "substrings", (F.col("units") / F.col("substrings")).alias("ratio"))


def exact_coverage(reads: DataFrame, units: DataFrame, reps: int = 2) -> DataFrame:
    """read_id, unit, covered: bases inside exact occurrences of reps copies of a unit of the read."""
    wanted = units.select("read_id", "unit", F.repeat("unit", reps).alias("run")).withColumn("len", F.length("run"))
    sizes = wanted.select("read_id", "len").distinct()
    placed = reads.join(sizes.hint("merge"), "read_id").where(F.length("seq") >= F.col("len")).select("read_id", "seq", "len", F.explode(F.sequence(F.lit(1), F.length("seq") - F.col("len") + 1)).alias("pos"))
    runs = placed.select("read_id", "pos", F.substring("seq", F.col("pos"), F.col("len")).alias("run"))
    met = runs.join(wanted.hint("merge"), ["read_id", "run"])
    bases = met.select("read_id", "unit", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("base"))
    return bases.groupBy("read_id", "unit").agg(F.count_distinct("base").alias("covered"))


def penalty(unit: Column, covered: Column, n: Column) -> Column:
    """Cost of describing a read by a unit: the unit, its copies and the bases left."""
    size = F.length(unit)
    return size + F.floor(covered / size) + n - covered


def top_units(reads: DataFrame, coverage: DataFrame, k: int = 5) -> DataFrame:
    """read_id, unit, covered, penalty, prio: the k cheapest units of each read; ties by length, then spelling."""
    cost = coverage.join(reads.select("read_id", F.length("seq").alias("n")).hint("merge"), "read_id").select("read_id", "unit", "covered", penalty(F.col("unit"), F.col("covered"), F.col("n")).cast("long").alias("penalty"))
    w = Window.partitionBy("read_id").orderBy("penalty", F.length("unit"), "unit")
    return cost.withColumn("prio", F.row_number().over(w) - 1).where(F.col("prio") < k)


def rank_by_bases(units: DataFrame) -> DataFrame:
    """read_id, unit, bases, prio: units by bases, most first."""
    w = Window.partitionBy("read_id").orderBy(F.desc("bases"), "unit")
    return units.select("read_id", "unit", "bases", (F.row_number().over(w) - 1).alias("prio"))


def prune(units: DataFrame, share: float = 0.95) -> DataFrame:
    """read_id, unit, bases: the fewest most frequent units with over `share` of the read's bases (column n)."""
    w = Window.partitionBy("read_id").orderBy(F.desc("bases"), "unit").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("before", F.coalesce(F.sum("bases").over(w), F.lit(0))).where(F.col("before") <= F.col("n") * share).select("read_id", "unit", "bases")


def explained_bases(reads: DataFrame, units: DataFrame, reps: int = 2, ratio: float = 0.3) -> DataFrame:
    """read_id, unit, covered, explained: bases in runs of reps copies of the unit, and those that remain when a run may bear some uncovered ones.

    Units of 20 bases and more are found with errors, shorter ones, which must
    be unbordered, exactly.
    """

    def told(own: DataFrame) -> DataFrame:
        texts, pairs = own.select("read_id", "seq"), own.select("read_id", "unit")
        short = cover.unit_spans(texts, pairs.where(F.length("unit") < LONG), reps)
        long = seeds.laid(texts, pairs.where(F.length("unit") >= LONG), ratio, (reps,)).drop("reps")
        found = cover.explained(short.unionByName(long), reps, ratio).select("read_id", "covered", "explained")
        return own.select("read_id", "unit").join(found.hint("merge"), "read_id", "left").fillna(0, ["covered", "explained"])

    return by_text(units.select("read_id", "unit").distinct().hint("merge").join(reads.select("read_id", "seq"), "read_id"), told, ("seq", "unit")).select("read_id", "unit", "covered", "explained")


def similar_units(pairs: DataFrame, ratio: float = 0.3) -> DataFrame:
    """pairs (a, b) with similar: whether some rotation of the shorter unit aligns with the longer one; equal pairs are aligned once."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([long_units.similar(kernel.encode(x), kernel.encode(y), ratio) for x, y in zip(a, b, strict=True)])

    return once_each(pairs, ["a", "b"], lambda own: spread(own).withColumn("similar", near("a", "b")))


def base_labels(results: DataFrame, key: str = "read_id") -> DataFrame:
    """key, pos, prio of every base of results that were asked for with labels."""
    return results.select(key, F.posexplode("labels").alias("pos", "prio"))
