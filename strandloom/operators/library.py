"""Decomposition with units that other reads share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.long_units import LONG
from strandloom.operators import seeds
from strandloom.operators.decompose import decompose, global_units
from strandloom.operators.texts import by_text
from strandloom.plans.options import Options
from strandloom.sources.shared import stored


def with_library(reads: DataFrame, opts: Options = Options(), key: str = "read_id", least_reads: int = 2) -> DataFrame:  # noqa: B008
    """Decomposition with a library: units that a first pass finds in at least `least_reads` reads are further candidates in a second one.

    A unit of under LONG bases pays off only where it stands twice, and the read
    has it as a candidate of its own then; so the library holds units of LONG
    bases and more, which occur with errors (opts.long_mode, which also takes
    units that don't pay off, gets no short ones from other reads). They meet the
    reads by their seeds (module seeds), so a unit is weighed only against reads
    that share seeds.HITS seeds with it on a diagonal, and each read gets the
    opts.top_units best ones. The order of the reads doesn't matter, and no task
    and no driver holds the library as a whole. Rows that share a key stay
    apart; null and empty reads give no row.
    """
    number = F.monotonically_increasing_id().alias("row")
    numbered = stored(reads.select(F.struct(number, F.col(key).alias("key")).alias("id"), F.upper("seq").alias("seq")), "library-reads")
    first = stored(decompose(numbered, opts, "id"), "library-first")
    library = global_units(first, "id").where((F.col("freq") >= least_reads) & (F.length("canon") >= LONG)).select(F.col("canon").alias("unit"))
    plain = numbered.select(F.col("id.row").alias("read_id"), "seq")
    index = seeds.seed_index(library)

    def further(texts: DataFrame) -> DataFrame:
        found = seeds.diagonals(texts, index)
        costs = seeds.weighed(stored(seeds.laid(texts, found, opts.max_ratio), "library-laid"), opts.max_ratio)
        return seeds.best_units(costs, opts.top_units).groupBy("read_id").agg(F.sort_array(F.collect_set("unit")).alias("further"))

    extra = by_text(plain, further).hint("merge")
    given = numbered.join(extra, F.col("id.row") == F.col("read_id"), "left").select("id", "seq", "further")
    again = decompose(given, opts, "id", "further")
    return again.select(F.col("id.key").alias(key), *[c for c in again.columns if c != "id"])
