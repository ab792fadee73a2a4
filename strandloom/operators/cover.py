"""Coverage of reads by units as sets of intervals, and the choice of key units, all as column expressions.

Every step works on one row a read; nothing is shuffled but what candidates and
their coverage need. Rounds of the choice are kept apart by generators, over
which Spark doesn't merge projections, so each is worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna, spans
from strandloom.functions.long_units import LONG
from strandloom.plans.options import Options


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later projections don't work out anew."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def unit_spans(reads: DataFrame, units: DataFrame, reps: int = 2) -> DataFrame:
    """read_id, unit, n (bases of the read), spans: where reps copies and more of an unbordered unit of the read stand in a row, exactly."""
    both = units.select("read_id", "unit").hint("merge").join(reads.select("read_id", "seq"), "read_id")
    return both.select("read_id", "unit", F.length("seq").alias("n"), spans.exact(F.col("seq"), F.col("unit"), reps).alias("spans"))


def explained(covered: DataFrame, reps: int = 2, ratio: float = 0.3, taken: str | None = None) -> DataFrame:
    """covered (read_id, unit, n, spans) with covered and explained: bases inside the spans, and bases told by runs that may bear some others.

    taken: a column with spans that other units have already; they count as
    explained and end a run.
    """
    held = F.col(taken) if taken else spans.empty()
    own = once(covered, pieces=spans.pieces(F.col("n"), F.col("spans"), held))
    own = once(own, scan=spans.scan(F.col("pieces"), F.length("unit"), reps, ratio))
    return own.select(*covered.columns, spans.total(F.col("spans")).alias("covered"), F.col("scan.explained").alias("explained"))


def candidates_of(reads: DataFrame, units: DataFrame, opts: Options = Options(), reps: int = 2) -> DataFrame:  # noqa: B008
    """read_id, n, candidates: the opts.top_units cheapest units of each read with their spans, by cost, length and spelling; unit of `units` under 20 bases."""
    own = explained(unit_spans(reads, units.where(F.length("unit") < LONG), reps).where(F.size("spans") > 0), reps, opts.max_ratio)
    size = F.length("unit")
    cost = size + F.floor(F.col("explained") / size) + F.col("n") - F.col("explained")
    each = own.select("read_id", "n", F.struct(cost.cast("int").alias("cost"), size.alias("size"), "unit", "spans").alias("c"))
    # a read has no more candidates than bases
    return each.groupBy("read_id", "n").agg(F.slice(F.array_sort(F.collect_list("c")), 1, opts.top_units).alias("candidates"))


def choose(weighed: DataFrame, opts: Options = Options(), reps: int = 2) -> DataFrame:  # noqa: B008
    """read_id, chosen (units in the order of choice), taken (spans they explain), left (cost of the description): a greedy weighted cover of each read.

    In each round the candidates are weighed beside what is taken; one that
    makes the description no longer than the best one so far takes its place.
    The bases of its runs are taken then. The rounds end when none is taken.
    """
    zero = F.lit(0)
    now = weighed.select("read_id", "n", "candidates", spans.empty().alias("taken"), zero.alias("so_far"), F.col("n").alias("cost"), F.array().cast("array<int>").alias("picks"))
    for _ in range(opts.top_units):
        scanned = F.transform("candidates", lambda c: spans.scan(spans.pieces(F.col("n"), c["spans"], F.col("taken")), c["size"], reps, opts.max_ratio))
        now = once(now, scans=scanned)

        def weigh(held, k):
            size, count = F.element_at("candidates", k + 1)["size"], F.element_at("scans", k + 1)["explained"]
            more = count - held["so_far"]
            cost = (held["cost"] + size + (more / size).cast("int") - more).cast("int")  # towards zero, as integer division in the published tool
            better = ~F.array_contains("picks", k) & (cost <= held["cost"])
            return F.when(better, F.struct(cost.alias("cost"), count.alias("so_far"), k.alias("pick"))).otherwise(held)

        begin = F.struct(F.col("cost"), F.col("so_far"), F.lit(None).cast("int").alias("pick"))
        every = F.when(F.size("candidates") > 0, F.sequence(zero, F.size("candidates") - 1)).otherwise(F.array().cast("array<int>"))
        now = once(now, best=F.aggregate(every, begin, weigh))
        pick = F.col("best.pick")
        more = spans.union(F.col("taken"), spans.intersection(F.try_element_at("candidates", pick + 1)["spans"], F.try_element_at("scans", pick + 1)["runs"]))
        state = {
            "next_taken": F.when(pick.isNull(), F.col("taken")).otherwise(more),
            "next_picks": F.when(pick.isNull(), F.col("picks")).otherwise(F.array_append("picks", pick)),
            "next_so_far": F.col("best.so_far"),
            "next_cost": F.col("best.cost"),
        }
        now = once(now, **state).select("read_id", "n", "candidates", *(F.col(f"next_{c}").alias(c) for c in ("taken", "so_far", "cost", "picks")))
    names = F.transform("picks", lambda k: F.element_at("candidates", k + 1)["unit"])
    return now.select("read_id", names.alias("chosen"), "taken", F.col("cost").alias("left"))


def key_units(reads: DataFrame, units: DataFrame, opts: Options = Options(), reps: int = 2) -> DataFrame:  # noqa: B008
    """read_id, chosen: the key units of each read among its candidate units (read_id, unit), one of each class of rotations."""
    one = units.groupBy("read_id", dna.canon(F.col("unit")).alias("canon")).agg(F.min("unit").alias("unit"))
    return choose(candidates_of(reads, one, opts, reps), opts, reps)
