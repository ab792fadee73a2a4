"""Join of reads with a library of long units by their seeds.

The seeds of all units, in all their turns, make a written index. Seeds of
reads meet it by an equi-join; hits are counted by diagonal, which is the
turn of the unit that a read's first base would have. Only where a diagonal of
a read has enough hits the unit is laid along it, base by base. There is one
pass over the reads, whatever the size of the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import kernel, long_units, spans
from strandloom.operators.cover import explained
from strandloom.operators.decompose import spread
from strandloom.sources.shared import stored

#: Bases of a seed, and hits that a diagonal of a read needs.
SEED = 6
HITS = 3


def unit_seeds(units: DataFrame, seed: int = SEED) -> DataFrame:
    """seed, unit, turn: the bases that follow each place of a unit, as if its copies stood in a row."""
    n = F.length("unit")
    ring = F.concat(F.col("unit"), F.left("unit", F.lit(seed - 1)))
    turns = units.select("unit", ring.alias("ring"), F.explode(F.sequence(F.lit(0), n - 1)).alias("turn"))
    return turns.select(F.substring("ring", F.col("turn") + 1, F.lit(seed)).alias("seed"), "unit", "turn")


def seed_index(units: DataFrame, seed: int = SEED) -> DataFrame:
    """The seeds of distinct units of at least `seed` bases, written once."""
    return stored(unit_seeds(units.select("unit").distinct().where(F.length("unit") >= seed), seed), "unit-seeds")


def read_seeds(reads: DataFrame, seed: int = SEED) -> DataFrame:
    """read_id, place (from 0), seed."""
    long = reads.where(F.length("seq") >= seed).select("read_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - seed)).alias("place"))
    return long.select("read_id", "place", F.substring("seq", F.col("place") + 1, F.lit(seed)).alias("seed"))


def diagonals(reads: DataFrame, index: DataFrame, seed: int = SEED, hits: int = HITS) -> DataFrame:
    """read_id, unit, diagonals: those on which a read and a unit share at least so many seeds."""
    met = read_seeds(reads, seed).join(index.hint("merge"), "seed").select("read_id", "unit", F.pmod(F.col("place") - F.col("turn"), F.length("unit")).alias("diagonal"))
    many = met.groupBy("read_id", "unit", "diagonal").agg(F.count("*").alias("n")).where(F.col("n") >= hits)
    # a unit has no more diagonals than bases
    return many.groupBy("read_id", "unit").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))


def laid(reads: DataFrame, pairs: DataFrame, ratio: float = 0.3, reps: tuple[int, ...] = (2, 1)) -> DataFrame:
    """read_id, unit, n, reps, spans of the units that cover some bases of a read when laid along it.

    pairs: read_id, unit, and maybe the diagonals to lay it along, all of them by
    default. reps: repetitions to try; the first that covers bases counts.
    spans: bases inside whole copies with at most the tolerated differences
    each, and the seed of three bases before them.
    """
    given = "diagonals" in pairs.columns
    both = pairs.join(reads.select("read_id", "seq").hint("merge"), "read_id").select("read_id", "unit", "seq", *["diagonals"] * given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (unit, seq) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for r in reps:
                    cov = long_units.coverage(kernel.encode(seq), kernel.encode(unit), r, ratio, batch.column(3)[k].as_py() if given else None)
                    if cov is not None:
                        edge = np.flatnonzero(np.diff(cov, prepend=False, append=False)).tolist()
                        rows.append((batch.column(0)[k].as_py(), unit, len(seq), r, [{"a": a, "b": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]))
                        break
            if rows:
                kinds = (batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=("read_id", "unit", "n", "reps", "spans"))

    kind = reads.schema["read_id"].dataType.simpleString()
    return spread(both).mapInArrow(run, f"read_id {kind}, unit string, n int, reps int, spans {spans.SPANS}")


def weighed(found: DataFrame, ratio: float = 0.3) -> DataFrame:
    """read_id, unit, reps, cost of describing a read by a unit, from what laid() gives."""
    told = None
    for r in (1, 2):
        own = explained(found.where(F.col("reps") == r), r, ratio)
        told = own if told is None else told.unionByName(own)
    size = F.length("unit")
    return told.select("read_id", "unit", "reps", (size + F.floor(F.col("explained") / size) + F.col("n") - F.col("explained")).cast("int").alias("cost"))


def most_repeated(found: DataFrame) -> DataFrame:
    """Of each read the units at two repetitions, or at one where there are none at two: a read is tried at one only if it fails at two."""
    most = F.max("reps").over(Window.partitionBy("read_id"))
    return found.withColumn("most", most).where(F.col("reps") == F.col("most")).drop("most")


def best_units(costs: DataFrame, top: int) -> DataFrame:
    """Of each read the `top` units by cost, length and spelling at two repetitions, or at one where there are none at two."""
    by = Window.partitionBy("read_id", "reps")
    ranked = costs.withColumn("rank", F.row_number().over(by.orderBy("cost", F.length("unit"), "unit"))).where(F.col("rank") <= top)
    return most_repeated(ranked.drop("rank"))  # at most 2 * top rows a read are left
