"""Alignment of long reads by many tasks.

A read is cut into stretches. First each stretch gives a matrix of the best
scores between its ends; the products with them, one stretch after the other,
are the scores at all cuts. Then each stretch is aligned from the scores at its
begin and tells for every way it may end where that way began; from the read's
end these choose one way through each. Only the two chains over the cuts go
read by read, a stretch at a time and with the scores of one cut in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import kernel, stretch
from strandloom.operators.blocks import joined_runs
from strandloom.sources.shared import stored

#: Bases of a stretch.
STRETCH = 20_000
#: Cells of the stretches that are aligned side by side.
TOGETHER = 1 << 20


def cells_of(units: list[str], held: dict[tuple[str, ...], stretch.Cells]) -> stretch.Cells:
    """Neighbouring rows mostly share their units, so the last cells are kept."""
    own = tuple(units)
    if own not in held:
        held.clear()
        held[own] = stretch.Cells([kernel.encode(u) for u in own])
    return held[own]


def ints(rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int64()))


def alike(batch: pa.RecordBatch, held: dict, square: bool = False) -> Iterator[tuple[stretch.Cells, np.ndarray, list[int]]]:
    """Cells, codes and rows of the stretches of a batch that share units and length, as many together as bounded notes hold."""
    groups: dict = {}
    for r, (units, part) in enumerate(zip(batch["units"].to_pylist(), batch["part"].to_pylist(), strict=True)):
        groups.setdefault((tuple(units), len(part)), []).append((r, part))
    for (units, n), own in groups.items():
        cells = cells_of(units, held)
        most = max(1, TOGETHER // (cells.count * (cells.count if square else n)))
        for at in range(0, len(own), most):
            yield cells, np.stack([kernel.encode(part) for _, part in own[at : at + most]]), [r for r, _ in own[at : at + most]]


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(read_id, k, part, units) -> (read_id, k, matrix, row by row)."""
    held: dict = {}
    for b in batches:
        for cells, codes, rows in alike(b, held, square=True):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b["read_id"].take(at), b["k"].take(at), ints([m.ravel() for m in cells.matrices(codes)])], names=["read_id", "k", "matrix"])


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices in the order of a read -> (read_id, k, scores) at the end of each stretch but the last, which is the begin of the next."""
    read, state = object(), None
    for b in batches:
        rows = []
        for own, k, m in zip(b["read_id"].to_pylist(), b["k"].to_pylist(), b["matrix"], strict=True):
            m = m.values.to_numpy().reshape(int(len(m.values) ** 0.5), -1)
            if own != read:
                read, state = own, np.zeros(len(m), np.int64)
            state = (state[:, None] + m).max(axis=0)
            rows.append((own, k + 1, state))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b["read_id"].type), pa.array([r[1] for r in rows], b["k"].type), ints([r[2] for r in rows])], names=["read_id", "k", "scores"])


def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(read_id, k, part, units, scores at the begin, last) -> the ways through each stretch: where each comes from, its runs, and of a last stretch the cell where the alignment ends (-1: none)."""
    held: dict = {}
    kinds = pa.list_(pa.struct([("len", pa.int32()), ("label", pa.int32())]))
    for b in batches:
        for cells, codes, rows in alike(b, held):
            scores = [b["scores"][r].values for r in rows]
            begin = np.stack([np.zeros(cells.count, np.int64) if x is None else x.to_numpy() for x in scores])
            comes, told, ends = [], [], []
            for r, (end, come, runs) in zip(rows, cells.traced_all(codes, begin), strict=True):
                at = len(end) - 1 - int(np.argmax(end[::-1]))
                # scores have the number of bases added: below it the read is better left without units
                ends.append((at if end[at] >= b["n"][r].as_py() else -1) if b["last"][r].as_py() else None)
                comes.append(come)
                told.append([[{"len": n, "label": u} for n, u in own] for own in runs])
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(b[c].take(taken) for c in ("read_id", "k", "start")), ints(comes), pa.array(told, pa.list_(kinds)), pa.array(ends, pa.int32())], names=["read_id", "k", "start", "come", "ways", "done"])


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ways from the last stretch of each read to its first -> (read_id, k, start, runs) of the one taken; none of a read that is better left without units."""
    read, cell = object(), None
    for b in batches:
        rows = []
        for r in range(b.num_rows):
            own, done = b["read_id"][r].as_py(), b["done"][r].as_py()
            if own != read or done is not None:
                read, cell = own, done
            if cell is not None and cell >= 0:
                rows.append((r, b["ways"][r][cell].as_py()))
                cell = b["come"][r].values[cell].as_py()
        if rows:
            at = pa.array([r for r, _ in rows])
            yield pa.RecordBatch.from_arrays([b[c].take(at) for c in ("read_id", "k", "start")] + [pa.array([w for _, w in rows], b["ways"].type.value_type)], names=["read_id", "k", "start", "runs"])


def align_long(reads: DataFrame, units: DataFrame, size: int = STRETCH) -> DataFrame:
    """read_id, start, end, label: maximal runs [start, end) of bases that the best wrap-around alignment of a read gives to one unit.

    units: read_id, label, unit of each read, labels from 0 on; they are those
    of one alignment of the read with all its units, base by base. Reads
    without bases or units, and those that are better left without units, give
    no rows. read_id is distinct.
    """
    own = units.groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "unit"))), lambda x: x["unit"]).alias("units"))
    # cut in one pass: a substring from each place would go through the read from its begin every time
    pieces = F.regexp_extract_all(F.upper("seq"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = reads.where(F.length("seq") > 0).select("read_id", F.length("seq").alias("n"), F.posexplode(pieces).alias("k", "part"))
    start = (F.col("k") * size).alias("start")
    last = ((F.col("k") + 1) * size >= F.col("n")).alias("last")
    parts = cut.select("read_id", "k", start, last, "n", "part").join(own, "read_id")
    parts = stored(parts.hint("rebalance"), "stretches")
    spark, kind = reads.sparkSession, reads.schema["read_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    maps = parts.where(~F.col("last")).select("read_id", "k", "part", "units").repartition(n, "read_id", "k").mapInArrow(matrices, f"read_id {kind}, k int, matrix array<long>")
    scores = maps.repartition(n, "read_id").sortWithinPartitions("read_id", "k").mapInArrow(forward, f"read_id {kind}, k int, scores array<long>")
    given = parts.join(stored(scores, "stretch-scores"), ["read_id", "k"], "left").repartition(n, "read_id", "k")
    found = given.mapInArrow(ways, f"read_id {kind}, k int, start int, come array<long>, ways array<array<struct<len: int, label: int>>>, done int")
    taken = stored(found, "stretch-ways").repartition(n, "read_id").sortWithinPartitions("read_id", F.desc("k")).mapInArrow(backward, f"read_id {kind}, k int, start int, runs array<struct<len: int, label: int>>")
    runs = taken.select("read_id", "start", F.posexplode("runs").alias("i", "run"))
    before = Window.partitionBy("read_id", "start").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.select("read_id", (F.col("start") + F.coalesce(F.sum("run.len").over(before), F.lit(0))).cast("int").alias("start"), "run.len", "run.label")
    return joined_runs(placed.select("read_id", "start", (F.col("start") + F.col("len")).alias("end"), "label"))
