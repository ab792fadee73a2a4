"""Classes of units that resemble one another, and frequencies by class.

Short units make a class with their rotations. Units of LONG bases and more
resemble each other if some rotation of the shorter one aligns with the longer
one within the tolerance. Pairs to compare share seeds on a diagonal of their
rings, so a unit is not compared with all others; classes are the components
of the pairs that pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.functions.long_units import LONG
from strandloom.operators import seeds
from strandloom.operators.texts import once_each
from strandloom.operators.units import similar_units
from strandloom.sources.shared import stored

#: Bases of a seed and hits on a diagonal that two units need; units that share fewer are told apart without a comparison.
SEED, HITS = 4, 2


def similar_pairs(units: DataFrame, ratio: float = 0.3) -> DataFrame:
    """a, b (a < b) of distinct long units (column canon) that resemble each other."""
    own = units.select("canon").distinct().where(F.length("canon") >= LONG)
    rings = own.select(F.col("canon").alias("read_id"), F.concat("canon", F.left("canon", F.lit(SEED - 1))).alias("seq"))
    index = seeds.seed_index(own.select(F.col("canon").alias("unit")), SEED)
    met = seeds.diagonals(rings, index, SEED, HITS).where("read_id < unit").select(F.col("read_id").alias("a"), F.col("unit").alias("b"))
    return similar_units(met, ratio).where("similar").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that edges (a, b) lead to, for every node that has some.

    In each round a node takes the least root of its neighbours, and then its
    root's root, so paths shrink by half.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "class-edges")
    now = stored(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "class-roots")
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = stored(now.join(near, "node").select("node", "root", F.least("root", "near").alias("new")), "class-least")
        up = least.select(F.col("node").alias("new"), F.col("new").alias("above"))
        after = stored(least.join(up, "new").select("node", "root", F.col("above").alias("new")), "class-roots")
        if after.where("root != new").isEmpty():
            return now
        now = after.select("node", F.col("new").alias("root"))


def unit_classes(units: DataFrame, ratio: float = 0.3) -> DataFrame:
    """canon, class of every unit (column canon): the least unit of its class."""
    root = components(similar_pairs(units, ratio)).withColumnRenamed("node", "canon")
    return units.select("canon").distinct().join(root, "canon", "left").select("canon", F.coalesce("root", "canon").alias("class"))


def class_frequencies(found: DataFrame, key: str = "read_id", ratio: float = 0.3) -> DataFrame:
    """class, freq: reads that have a unit of the class, from rows (key, unit)."""

    def classed(own: DataFrame) -> DataFrame:
        named = stored(own.select("unit", dna.canon(F.col("unit")).alias("canon")), "class-units")
        return named.join(unit_classes(named, ratio).hint("merge"), "canon").select("unit", "class")

    return once_each(found.select(key, "unit"), ["unit"], classed).select(key, "class").distinct().groupBy("class").agg(F.count("*").alias("freq"))
