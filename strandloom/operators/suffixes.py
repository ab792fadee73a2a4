"""Suffixes of all reads in order, by prefix doubling, and repeated substrings from neighbours.

A name is a number for the first bases of a suffix: equal for equal ones, in
their order, over all reads together. Names of h bases in pairs give those of
2 * h bases in one round of joins, so n bases have n rows, whatever the length
of the substrings that are sought. Rows a base compress well, so the joins of
them say that they are merged: by the size of their files they would be sent
through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators.texts import sent
from strandloom.sources.shared import stored

#: Bases that a first name is made of, as digits to the base 5 with 0 after the end.
FIRST = 16


def first_names(reads: DataFrame) -> DataFrame:
    """read_id, pos (from 1), name of up to FIRST bases."""
    places = reads.where(F.length("seq") > 0).select("read_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("pos"))
    digits = F.translate(F.rpad(F.substring("seq", F.col("pos"), F.lit(FIRST)), FIRST, " "), " ACGT", "01234")
    return places.select("read_id", "pos", F.conv(digits, 5, 10).cast("long").alias("name"))


def doubled(named: DataFrame, h: int) -> DataFrame:
    """Names of 2 * h bases from names of h: pairs of names, numbered in their order."""
    after = named.select("read_id", (F.col("pos") - h).alias("pos"), F.col("name").alias("next")).where("pos > 0")
    both = stored(named.join(after.hint("merge"), ["read_id", "pos"], "left").select("read_id", "pos", "name", F.coalesce("next", F.lit(-1).cast("long")).alias("next")), "suffix-pairs")
    order = both.select("name", "next").distinct().orderBy("name", "next")
    # rows of a sorted table are numbered in their order, with gaps between its partitions
    numbers = stored(order.select("name", "next", F.monotonically_increasing_id().alias("new")), "suffix-names")
    return stored(both.join(sent(numbers), ["name", "next"]).select("read_id", "pos", F.col("new").alias("name")), "suffix-order")


def suffix_names(reads: DataFrame, depth: int | None = None) -> DataFrame:
    """read_id, pos, name: in the order of the suffixes by their first `depth` bases, or as many as tell all suffixes of a read apart."""
    named, h = first_names(reads), FIRST
    if depth is None:
        depth = reads.agg(F.max(F.length("seq"))).first()[0] or 0
        named = stored(named, "suffix-order")
        while h < depth and not named.groupBy("read_id", "name").count().where("count > 1").isEmpty():
            named, h = doubled(named, h), 2 * h
        return named
    while h < depth:
        named, h = doubled(stored(named, "suffix-order") if h == FIRST else named, h), 2 * h
    return named


def suffix_array(reads: DataFrame) -> DataFrame:
    """read_id, place (from 0), pos (from 1): the suffixes of each read in order."""
    w = Window.partitionBy("read_id").orderBy("name")
    return suffix_names(reads).select("read_id", (F.row_number().over(w) - 1).alias("place"), "pos")


def common(a: Column, b: Column, most: int) -> Column:
    """Letters at the beginning of two strings that agree, at most `most`."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))
    return F.coalesce(F.least(same, F.length(a), F.length(b)), F.lit(0))


def repeats(reads: DataFrame, low: int = 2, high: int = 20) -> DataFrame:
    """read_id, unit, n_occ: every substring of low to high bases that occurs at least twice in a read.

    Suffixes that begin with it are neighbours in the order; it is told once
    where they begin and once where they end, so rows beyond one a base are
    twice the result.
    """
    named = suffix_names(reads, high + 1)
    heads = named.join(reads.select("read_id", "seq").hint("merge"), "read_id").select("read_id", "name", "pos", F.substring("seq", F.col("pos"), F.lit(high)).alias("head"))
    w = Window.partitionBy("read_id").orderBy("name", "pos")
    own = heads.select("read_id", "name", "pos", "head", F.row_number().over(w).alias("k"), common(F.col("head"), F.lag("head").over(w), high).alias("shared"))
    own = own.withColumns({"before": F.lag("shared", 1, 0).over(w), "after": F.lead("shared", 1, 0).over(w)}).where(F.col("shared") >= low)

    def lengths(beside: str) -> Column:
        least = F.greatest(F.lit(low), F.col(beside) + 1)
        return F.when(least <= F.col("shared"), F.sequence(least, F.col("shared"))).otherwise(F.array().cast("array<int>"))

    told = own.select("read_id", "head", F.explode(F.concat(F.transform(lengths("before"), lambda n: F.struct(n.alias("n"), F.col("k").alias("first"), F.lit(None).cast("int").alias("last"))), F.transform(lengths("after"), lambda n: F.struct(n.alias("n"), F.lit(None).cast("int").alias("first"), F.col("k").alias("last"))))).alias("x"))
    both = told.select("read_id", F.substring("head", F.lit(1), F.col("x.n")).alias("unit"), "x.first", "x.last").groupBy("read_id", "unit").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    return both.select("read_id", "unit", (F.col("last") - F.col("first") + 2).cast("long").alias("n_occ"))


def candidate_units(reads: DataFrame, low: int = 2, high: int = 20) -> DataFrame:
    """read_id, unit, n_occ: unbordered substrings that occur at least twice in the read."""
    return repeats(reads, low, high).where(dna.unbordered(F.col("unit")))
