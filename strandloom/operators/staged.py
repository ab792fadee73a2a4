"""Decomposition of reads in DataFrame stages.

Candidates come from the ordered suffixes, key units from interval sets, labels
are voted on, cut into runs and told as text by column expressions. Only the
alignments themselves, of a read with its units and of a run with its unit, are
numpy code on Arrow batches. Results are those of operators.decompose.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.functions import dna, kernel
from strandloom.operators import blocks, cover, suffixes
from strandloom.operators.cover import once
from strandloom.operators.texts import by_text
from strandloom.plans.options import Options
from strandloom.sources.shared import stored

COUNTS = "array<struct<match: int, mismatch: int, insertion: int, deletion: int, phase: int>>"


def with_column(df: DataFrame, name: str, kind: str, work) -> DataFrame:
    """df with a column that work(batch) gives as a list or Arrow array."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    last = to_arrow_schema(schema).field(len(df.columns)).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(work(b), type=last)], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def labels_of(batch: pa.RecordBatch, stay: bool) -> list:
    """The number of the unit at every base of each read, by its alignment with all its units."""
    seqs, units = batch["seq"].to_pylist(), batch["key_units"].to_pylist()
    out: list = [None] * len(seqs)
    for own in kernel.batches([len(s) for s in seqs], [sum(map(len, u)) for u in units]):
        for k, labels in zip(own, kernel.label_batch([kernel.encode(seqs[k]) for k in own], [[kernel.encode(u) for u in units[k]] for k in own], False, stay), strict=True):
            out[k] = labels
    return out


def counts_of(batch: pa.RecordBatch) -> list:
    """Moves and phase of the alignment of each tandem run with copies of its unit."""
    own = batch["tandem_runs"].to_pylist()
    told = iter(kernel.realign([(r["unit"], r["stretch"]) for runs in own for r in runs]))
    return [[dict(zip(("match", "mismatch", "insertion", "deletion", "phase"), next(told), strict=True)) for _ in runs] for runs in own]


def labelled(reads: DataFrame, opts: Options) -> DataFrame:
    """reads (seq, key_units) with labels, voted on if asked for."""
    own = with_column(reads, "labels", "array<int>", partial(labels_of, stay=opts.smooth))
    return blocks.smooth(own, 2) if opts.smooth else own


def share_of(k: Column) -> Column:
    """Bases of a read that have label k."""
    return F.size(F.filter("labels", lambda x: x == k))


def pruned(reads: DataFrame, opts: Options) -> DataFrame:
    """reads with the fewest most frequent key units that together have over opts.min_coverage of the read, least frequent first."""
    ranked = F.array_sort(F.transform("key_units", lambda u, k: F.struct((-share_of(k)).alias("k"), u.alias("unit"))))

    def step(held, x):
        enough = held["total"] > F.length("seq") * F.lit(opts.min_coverage)
        return F.when(enough, held).otherwise(F.struct((held["total"] - x["k"]).alias("total"), F.array_prepend(held["kept"], x["unit"]).alias("kept")))

    own = once(reads, ranked=ranked)
    kept = F.aggregate("ranked", F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("kept")), step, lambda held: held["kept"])
    return own.select("read_id", "seq", kept.alias("key_units"))


def described(reads: DataFrame, reps: int) -> DataFrame:
    """Blocks, pattern, ratios and totals by unit from labels; columns as those of operators.decompose."""
    n = F.length("seq")
    cuts = F.when(n > 1, F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get("labels", i) != F.get("labels", i - 1))).otherwise(F.array().cast("array<int>"))
    own = once(reads, cuts=cuts)
    ends = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("cuts")).alias("a"), F.concat(F.col("cuts"), F.array(n)).alias("b"))

    def run(x):
        label = F.get("labels", x["a"])
        unit = F.when(label >= 0, F.get("key_units", F.greatest(label, F.lit(0))))
        tandem = F.coalesce(F.floor((x["b"] - x["a"]) / F.length(unit)) >= reps, F.lit(False))
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), unit.alias("unit"), tandem.alias("tandem"))

    own = once(own, runs=F.transform(ends, run))
    stretch = lambda a, b: F.substring("seq", a + 1, b - a)
    own = once(own, tandem_runs=F.transform(F.filter("runs", lambda r: r["tandem"]), lambda r: F.struct(r["unit"].alias("unit"), stretch(r["a"], r["b"]).alias("stretch"))))
    own = with_column(own.drop("labels", "cuts"), "told", COUNTS, counts_of)

    def block(unit, copies, a, b, tandem):
        return F.struct(unit.alias("unit"), copies.cast("int").alias("copies"), a.alias("start"), b.alias("end"), F.lit(tandem).alias("is_tandem"))

    def state(k, raw, out):
        return F.struct(k.cast("int").alias("k"), raw.alias("raw"), out.alias("out"))

    def step(s, r):
        """Tandem runs are blocks of their own, other ones join the raw block before them."""
        size = r["b"] - r["a"]
        whole = block(dna.rotate(r["unit"], F.get("told", s["k"])["phase"]), F.floor(size / F.length(r["unit"])), r["a"], r["b"], True)
        last = F.try_element_at(s["out"], F.lit(-1))["start"]
        joined = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(block(stretch(last, r["b"]), F.lit(1), last, r["b"], False)))
        alone = F.concat(s["out"], F.array(block(stretch(r["a"], r["b"]), F.lit(1), r["a"], r["b"], False)))
        return F.when(r["tandem"], state(s["k"] + 1, F.lit(False), F.concat(s["out"], F.array(whole)))).otherwise(state(s["k"], F.lit(True), F.when(s["raw"], joined).otherwise(alone)))

    empty = F.array().cast("array<struct<unit: string, copies: int, start: int, end: int, is_tandem: boolean>>")
    sum_of = lambda runs, f: F.aggregate(runs, F.lit(0), lambda t, r: t + f(r))
    moves = {c: sum_of("told", lambda t: t[c]) for c in ("match", "mismatch", "insertion", "deletion")}  # noqa: B023
    moves["match"] = moves["match"] + sum_of(F.filter("runs", lambda r: ~r["tandem"]), lambda r: r["b"] - r["a"])

    def totals(u):
        mine = F.filter("runs", lambda r: r["unit"] == u)
        bases, tandem = sum_of(mine, lambda r: r["b"] - r["a"]), sum_of(F.filter(mine, lambda r: r["tandem"]), lambda r: r["b"] - r["a"])
        return F.struct((-bases).alias("k"), u.alias("unit"), F.length(u).alias("len"), bases.alias("bases"), tandem.alias("tandem_bases"))

    used = F.array_sort(F.filter(F.transform("key_units", totals), lambda u: u["bases"] > 0))
    own = once(own, blocks=F.aggregate("runs", state(F.lit(0), F.lit(False), empty), step, lambda s: s["out"]), used=used, **moves)
    ratio = lambda c: (c / n).cast("double")
    wrong = F.col("mismatch") + F.col("insertion") + F.col("deletion")
    return own.where(F.size("used") > 0).select(
        "read_id", n.alias("seq_len"), F.lit(reps).alias("min_reps"), F.lit("short").alias("mode"), F.size("used").alias("num_key_units"),
        ratio(F.col("mismatch")).alias("mismatch_ratio"), ratio(F.col("deletion")).alias("deletion_ratio"), ratio(F.col("insertion")).alias("insertion_ratio"), ratio(wrong).alias("discrepancy_ratio"),
        ratio(n - F.col("match") - F.col("mismatch") - F.col("insertion")).alias("clipped_ratio"),
        F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("<"), b["unit"], F.lit(">"), b["copies"])), "").alias("pattern"), "blocks",
        F.transform("used", lambda u, k: F.struct(k.alias("prio"), u["unit"].alias("unit"), u["len"].alias("len"), u["bases"].alias("bases"), u["tandem_bases"].alias("tandem_bases"))).alias("units"),
    )


def passed(reads: DataFrame, units: DataFrame, opts: Options, reps: int) -> DataFrame:
    """The decomposition of the reads that some units explain at so many repetitions."""
    chosen = cover.key_units(reads, units, opts, reps).where(F.size("chosen") > 0).select("read_id", F.col("chosen").alias("key_units"))
    first = stored(labelled(reads.join(chosen.hint("merge"), "read_id"), opts), "staged-labels")
    again = stored(labelled(pruned(first, opts), opts), "staged-labels")
    return described(again, reps)


def decompose_staged(reads: DataFrame, opts: Options = Options(max_unit=19)) -> DataFrame:  # noqa: B008
    """What operators.decompose gives for automatic units under 20 bases without long mode: read_id and the decomposition of every read that some unit explains.

    Reads that no unit explains at two repetitions are tried at one. Null and
    empty reads give no row.
    """
    if opts.max_unit > 19 or opts.long_mode or opts.units:
        raise ValueError("stages take automatic units of up to 19 bases, without long mode")
    own = reads.where(F.length("seq") > 0).select("read_id", F.upper("seq").alias("seq"))
    return by_text(own, lambda texts: staged(texts, opts))


def staged(own: DataFrame, opts: Options) -> DataFrame:
    """decompose_staged of distinct texts in a written table."""
    units = stored(suffixes.candidate_units(own, 2, opts.max_unit).select("read_id", "unit"), "staged-candidates")
    two = stored(passed(own, units, opts, 2), "staged-two")
    rest = own.join(two.select("read_id").hint("merge"), "read_id", "left_anti")
    return two.unionByName(passed(rest, units, opts, 1))
