"""Column expressions over sets of intervals: sorted, disjoint [a, b) as array<struct<a, b>>; all stay in the JVM."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<a: int, b: int>>"


def empty() -> Column:
    return F.array().cast(SPANS)


def span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def total(spans: Column) -> Column:
    """Places inside."""
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["b"] - s["a"])


def merged(spans: Column) -> Column:
    """Any intervals as a set: those that overlap or touch become one."""

    def step(out, s):
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(span(last["a"], F.greatest(last["b"], s["b"]))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["b"] >= s["a"]), joined).otherwise(F.concat(out, F.array(span(s["a"], s["b"]))))

    return F.aggregate(F.array_sort(F.filter(spans, lambda s: s["a"] < s["b"])), empty(), step)


def union(x: Column, y: Column) -> Column:
    return merged(F.concat(x, y))


def intersection(x: Column, y: Column) -> Column:
    return F.flatten(F.transform(x, lambda s: F.transform(F.filter(y, lambda t: (t["a"] < s["b"]) & (s["a"] < t["b"])), lambda t: span(F.greatest(s["a"], t["a"]), F.least(s["b"], t["b"])))))


def exact(seq: Column, unit: Column, reps: int) -> Column:
    """Where reps copies and more of an unbordered unit stand in a row, as a set.

    Copies of an unbordered unit can't overlap, so its longest rows are what a
    pattern finds from the left.
    """
    pattern = F.concat(F.lit("(?:"), unit, F.lit(f"){{{reps},}}"))
    gaps = F.transform(F.split(seq, pattern, -1), F.length)
    rows = F.transform(F.regexp_extract_all(seq, pattern, F.lit(0)), F.length)

    def step(held, x):
        a = held["at"] + x["gap"]
        return F.struct((a + x["row"]).alias("at"), F.concat(held["out"], F.array(span(a, a + x["row"]))).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), rows.alias("row")), lambda x: x["row"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty().alias("out")), step, lambda held: held["out"])


def pieces(n: Column, covered: Column, taken: Column) -> Column:
    """The places 0 to n cut where either set begins or ends: array of (a, b, kind), kind 2 taken, 1 covered, 0 neither."""
    ends = lambda s: F.flatten(F.transform(s, lambda x: F.array(x["a"], x["b"])))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), ends(covered), ends(taken))))
    inside = lambda s, p: F.exists(s, lambda x: (x["a"] <= p) & (p < x["b"]))
    both = F.arrays_zip(F.slice(cuts, 1, F.size(cuts) - 1).alias("a"), F.slice(cuts, 2, F.size(cuts)).alias("b"))
    kind = lambda p: F.when(inside(taken, p), 2).when(inside(covered, p), 1).otherwise(0)
    return F.transform(both, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), kind(x["a"]).alias("kind")))


def scan(cut: Column, size: Column, reps: int, ratio: float) -> Column:
    """From pieces(): struct of `explained`, the bases that a unit of `size` bases explains beside those taken, and `runs`, where.

    A run goes on through uncovered bases while these stay few; one that ends
    with at least reps copies counts its covered bases. A run that an uncovered
    base ends is told from one base before its begin up to the base before its
    end, as in the published tool. Products with the ratio, below 1, are taken
    in single precision.
    """
    r = F.lit(float(np.float32(ratio))).cast("float")
    most_gap = F.ceil(size.cast("float") * r)
    least = size * reps
    full = lambda s: (s["run"] > 0) & (s["run"] >= least)

    def state(total, run, wrong, gap, open_, runs):
        return F.struct(total.cast("int").alias("total"), run.cast("int").alias("run"), wrong.cast("int").alias("wrong"), gap.cast("int").alias("gap"), open_.alias("open"), runs.alias("runs"))

    zero = F.lit(0)

    def ended(s, total, gap, at, open_):
        """The run so far counts if it is long enough, and is over."""
        more = F.when(full(s), s["run"] - s["wrong"]).otherwise(0)
        runs = F.when(full(s), F.concat(s["runs"], F.array(span(at - s["run"], at)))).otherwise(s["runs"])
        return state(total + more, zero, zero, gap, open_, runs)

    def uncovered(s, k):
        """One more uncovered base, at place k; after one that ended a run the rest of the piece ends runs of its own."""
        s = {"total": s["total"], "run": s["run"] + 1, "wrong": s["wrong"] + 1, "gap": s["gap"] + 1, "runs": s["runs"]}
        over = (F.floor(s["run"].cast("float") * r) < s["wrong"]) | (most_gap <= s["gap"])
        return F.when(over, ended(s, s["total"], zero, k, F.lit(False))).otherwise(state(s["total"], s["run"], s["wrong"], s["gap"], F.lit(True), s["runs"]))

    def step(s, x):
        n = x["b"] - x["a"]
        onward = state(s["total"], s["run"] + n, s["wrong"], s["gap"], F.lit(True), s["runs"])
        met = ended(s, s["total"] + n, s["gap"], x["a"], F.lit(True))
        again = state(s["total"], s["run"], s["wrong"], s["gap"], F.lit(True), s["runs"])
        # a gap ends a run at the latest when it has most_gap bases
        through = F.aggregate(F.sequence(x["a"], x["a"] + F.least(n, most_gap.cast("int")) - 1), again, lambda t, k: F.when(t["open"], uncovered(t, k)).otherwise(t))
        return F.when(x["kind"] == 1, onward).when(x["kind"] == 2, met).otherwise(through)

    def last(s):
        end = F.element_at(cut, -1)["b"]
        more = F.when(full(s), s["run"] - s["wrong"]).otherwise(0)
        runs = F.when(full(s), F.concat(s["runs"], F.array(span(end - s["run"], end)))).otherwise(s["runs"])
        return F.struct((s["total"] + more).alias("explained"), runs.alias("runs"))

    return F.aggregate(cut, state(zero, zero, zero, zero, F.lit(True), empty()), step, last)


def tolerated(size: int, ratio: float) -> int:
    return math.ceil(float(np.float32(size) * np.float32(ratio)))
