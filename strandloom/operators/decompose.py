"""Decomposition of reads: distinct ones are dealt evenly and aligned in one Arrow stage; and what follows from its results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.functions import dna
from strandloom.operators.texts import once_each
from strandloom.plans.options import Options

BLOCK = T.StructType([T.StructField("unit", T.StringType()), T.StructField("copies", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("is_tandem", T.BooleanType())])
UNIT = T.StructType([T.StructField("prio", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("len", T.IntegerType()), T.StructField("bases", T.IntegerType()), T.StructField("tandem_bases", T.IntegerType())])
FIELDS = [
    ("seq_len", T.IntegerType()), ("min_reps", T.IntegerType()), ("mode", T.StringType()), ("num_key_units", T.IntegerType()),
    ("mismatch_ratio", T.DoubleType()), ("deletion_ratio", T.DoubleType()), ("insertion_ratio", T.DoubleType()), ("discrepancy_ratio", T.DoubleType()),
    ("clipped_ratio", T.DoubleType()), ("pattern", T.StringType()), ("blocks", T.ArrayType(BLOCK)), ("units", T.ArrayType(UNIT)),
]


#: Bytes of the files that reads come from, for each task that aligns them.
TASK_BYTES = 4 << 20
#: Reads whose candidates a task holds together.
READS = 2_500
#: What Spark gives as the size of a source that it knows nothing of.
UNKNOWN = 1 << 60


def spread(reads: DataFrame) -> DataFrame:
    """reads dealt evenly over as many partitions as there are cores at least, and more for larger sources: a read costs far more to align than to move."""
    spark = reads.sparkSession
    leaves = reads._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN)
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return reads.repartition(max(least, size // TASK_BYTES))


def decompose(reads: DataFrame, opts: Options = Options(), key: str = "read_id", further: str | None = None, repeated: bool = True) -> DataFrame:  # noqa: B008
    """key and the decomposition of every read (column seq) that some unit explains; other reads give no row.

    Null and empty reads give no row. Letters other than ACGT fail or are
    dropped by opts.on_invalid. clipped_ratio is the share of bases that no
    alignment touches. opts.labels adds labels: the prio of the unit at each
    base, -1 where it has none. Reads of one text (and further units) are
    aligned once, but for those of a stream. repeated: False for reads that hardly
    repeat; they are aligned where they lie, so deal them out before. further: a
    column with an array of more candidate units of 20 bases and more for the read
    itself, or null.
    """
    seq = F.upper("seq")
    more = [] if further is None else [further]
    good = dna.valid(seq) & (F.lit(True) if opts.max_read is None else F.length(seq) <= opts.max_read)
    own = reads.select(key, "seq", *more).where(F.length("seq") > 0).select(F.col(key), seq.alias("seq"), *more)
    own = own.where(good) if opts.on_invalid == "drop" else own.withColumn("seq", F.when(good, F.col("seq")).otherwise(F.raise_error(F.lit("a read has letters other than A, C, G, T, or is too long")).cast("string")))
    if reads.isStreaming or not repeated:
        return aligned(own, [key], opts, further)
    return once_each(own, ["seq", *more], lambda texts: aligned(spread(texts), ["seq", *more], opts, further)).drop("seq", *more)


def aligned(own: DataFrame, keep: list[str], opts: Options, further: str | None = None) -> DataFrame:
    """The columns to keep of reads (seq of ACGT) and their decomposition."""
    fields = FIELDS + [("labels", T.ArrayType(T.IntegerType()))] * opts.labels
    schema = T.StructType([*(own.schema[c] for c in keep), *(T.StructField(n, t) for n, t in fields)])

    def run(found):
        from strandloom.functions.kernel import decompose as kernel

        types = [to_arrow_type(t) for _, t in fields]
        for batch in (b.slice(begin, READS) for b in found for begin in range(0, b.num_rows, READS)):
            rows, at = [], []
            for k, r in enumerate(kernel(batch["seq"].to_pylist(), opts, batch[further].to_pylist() if further else None)):
                if r is None:
                    continue
                n = r.length
                touched = r.match + r.mismatch + r.insertion
                at.append(k)
                rows.append((
                    n, r.min_reps, r.mode, len(r.units), r.mismatch / n, r.deletion / n, r.insertion / n, r.wrong / n, (n - touched) / n, r.pattern,
                    [dict(zip(BLOCK.fieldNames(), b, strict=True)) for b in r.blocks],
                    [dict(zip(UNIT.fieldNames(), (p, u.text, len(u.text), u.bases, u.tandem), strict=True)) for p, u in enumerate(r.units)],
                    *([r.labels.tolist()] if opts.labels else []),
                ))
            if rows:
                cols = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(at)) for c in keep), *cols], names=schema.fieldNames())

    return own.mapInArrow(run, schema)


def unit_rows(results: DataFrame, key: str = "read_id") -> DataFrame:
    """key, prio, unit, len, bases, tandem_bases: a row per key unit of a read."""
    return results.select(key, F.inline("units"))


def global_units(results: DataFrame, key: str = "read_id") -> DataFrame:
    """canon, freq: reads that have the unit, by class of rotations."""
    own = unit_rows(results, key).select(key, dna.canon(F.col("unit")).alias("canon")).distinct()
    return own.groupBy("canon").agg(F.count("*").alias("freq"))


def add_haplotypes(results: DataFrame, haps: DataFrame) -> DataFrame:
    """results (sample_id, read_name) with hap, the first line of haps for the sample and the read's number; null without one."""
    first = haps.groupBy("sample_id", "read_no").agg(F.min_by("pair_haps", "ord").alias("hap"))
    number = F.nullif(F.regexp_extract("read_name", r"^read(\d+)", 1), F.lit("")).cast("int")
    return results.withColumn("read_no", number).join(first, ["sample_id", "read_no"], "left").drop("read_no")
