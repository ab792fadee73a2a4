"""Operators on labels per base: smoothing, runs, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import dna


def smooth(labelled: DataFrame, rounds: int = 1) -> DataFrame:
    """labelled (read_id, labels array<int>) with labels voted on: the most frequent around each place, ties to the smallest.

    Near the ends the window is shifted inwards and keeps its length.
    """
    n = F.size("labels")
    whole = dna.window_length(n)
    w = F.least(whole, n)

    def vote(_, i):
        start = F.greatest(F.lit(0), F.least(i - F.floor(whole / 2).cast("int"), n - w))
        near = F.slice(F.col("labels"), start + 1, w)
        best = F.array_min(F.transform(F.array_distinct(near), lambda q: F.struct((-F.size(F.filter(near, lambda x: x == q))).alias("k"), q.alias("q"))))
        return best["q"]

    out = labelled
    for _ in range(rounds):
        # a generator is a border that projections aren't merged over: a round is worked out once and not for each vote of the next
        out = out.withColumn("labels", F.explode(F.array(F.transform("labels", vote))))
    return out


def runs(labels: DataFrame) -> DataFrame:
    """From (read_id, pos, label): read_id, start, end, label, len of every run."""
    w = Window.partitionBy("read_id").orderBy("pos")
    new = F.when(F.lag("label").over(w) == F.col("label"), 0).otherwise(1)
    marked = labels.withColumn("new", new).withColumn("grp", F.sum("new").over(w))
    return marked.groupBy("read_id", "grp", "label").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("len")).drop("grp")


def joined_runs(parts: DataFrame) -> DataFrame:
    """From (read_id, start, end, label) of stretches [start, end) that fill a read: neighbours of one label as one."""
    w = Window.partitionBy("read_id").orderBy("start")
    new = F.when(F.lag("label").over(w) == F.col("label"), 0).otherwise(1)
    marked = parts.withColumn("new", new).withColumn("grp", F.sum("new").over(w))
    return marked.groupBy("read_id", "grp", "label").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("read_id", "start", "end", "label")


def merge_raw(found: DataFrame, reps: int = 2) -> DataFrame:
    """Runs (with unit_len) as blocks: neighbours shorter than reps copies become one raw block."""
    w = Window.partitionBy("read_id").orderBy("start")
    own = found.withColumn("is_tandem", F.floor(F.col("len") / F.col("unit_len")) >= reps)
    new = F.when(F.col("is_tandem") | F.coalesce(F.lag("is_tandem").over(w), F.lit(True)), 1).otherwise(0)
    marked = own.withColumn("new", new).withColumn("grp", F.sum("new").over(w))
    return marked.groupBy("read_id", "grp", "is_tandem").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("len").alias("len"), F.count("*").alias("n_runs")).drop("grp")
