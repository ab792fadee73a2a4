"""Text sources as DataFrames. All are split by Spark's own readers, so large files are read in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators.decompose import spread

SPACES = " \t\n\x0b\f\r"

def read_fasta(spark: SparkSession, path: str, on_invalid: str = "fail", max_read: int | None = None) -> DataFrame:
    """header, seq of every record with bases. on_invalid: fail or drop, for other letters and reads over max_read.

    A record ends where a line begins with `>`, so headers may hold that letter.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    return records(raw, on_invalid, max_read)


def records(raw: DataFrame, on_invalid: str = "fail", max_read: int | None = None) -> DataFrame:
    """header, seq from the `value` of records that still may hold their first `>`."""
    # a generator is a border that projections aren't merged over: each record is cut up once
    body = raw.select(F.explode(F.array(F.translate("value", "\r", ""))).alias("body"))
    at = F.instr("body", "\n")
    head = F.regexp_replace(F.when(at > 0, F.expr("left(body, instr(body, '\n') - 1)")).otherwise(F.col("body")), "^>? ?", "")
    seq = F.when(at > 0, F.upper(F.translate(F.expr("substring(body, instr(body, '\n') + 1)"), SPACES, "")))
    out = body.select(F.inline(F.array(F.struct(head.alias("header"), F.coalesce(seq, F.lit("")).alias("seq"))))).where("seq != ''")
    good = dna.valid(F.col("seq")) & (F.lit(True) if max_read is None else F.length("seq") <= max_read)
    if on_invalid == "drop":
        return out.where(good)
    said = F.concat(F.lit("invalid read: "), F.substring("header", 1, 80))
    return out.withColumn("seq", F.when(good, F.col("seq")).otherwise(F.raise_error(said).cast("string")))


def numbered(reads: DataFrame) -> DataFrame:
    """With read_ord, a number that grows in the order of the file."""
    return reads.withColumn("read_ord", F.monotonically_increasing_id())


def read_haplotypes(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, read_no, pair_haps, and ord, the order of the lines."""
    return parse_haplotypes(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def parse_haplotypes(lines: DataFrame) -> DataFrame:
    """sample_id, read_no, pair_haps, ord from `value` and `ord`; what a short line lacks is null, blank lines go."""
    f = F.split(F.trim(F.translate("value", "\t", " ")), r"\s+")
    return lines.where(F.trim(F.translate("value", "\t", " ")) != "").select(F.get(f, F.lit(0)).alias("sample_id"), F.get(f, F.lit(1)).try_cast("int").alias("read_no"), F.get(f, F.lit(2)).alias("pair_haps"), "ord")


def parse_repeatmasker(lines: DataFrame, keep_homopolymers: bool = False) -> DataFrame:
    """Hits from the `value` of RepeatMasker output lines; header lines have no number in front and go."""
    f = F.split(F.trim("value"), r"\s+")
    left = F.regexp_replace(f[7], "[()]", "").cast("int")
    unit = F.when(f[10] == "Simple_repeat", F.regexp_extract(f[9], r"^\(([^)]*)\)n", 1)).otherwise(f[9])
    hits = lines.where(F.trim("value").rlike(r"^\d") & (F.size(f) >= 11)).select(
        f[4].alias("id"), (f[6].cast("int") + left).alias("total_len"), f[5].cast("int").alias("begin"), f[6].cast("int").alias("end"), (f[6].cast("int") - f[5].cast("int") + 1).alias("len"), unit.alias("unit"), f[10].alias("class")
    )
    return hits if keep_homopolymers else hits.where((F.col("class") != "Simple_repeat") | (F.length("unit") != 1))


def trf_hit(line: Column) -> Column:
    """The fields of a line of TRF's compact output; null if it has fewer than 15."""
    f = F.split(F.trim(line), r"\s+")
    kinds = {"begin": "int", "end": "int", "period": "int", "copies": "int", "consensus": "int"}
    own = [F.get(f, F.lit(k)).try_cast("double").cast(t).alias(n) for k, (n, t) in enumerate(kinds.items())]
    return F.when(F.size(f) >= 15, F.struct(*own, F.get(f, F.lit(13)).alias("unit")))


def parse_trf(lines: DataFrame, part: str, order: str = "ord", longest: int = 200) -> DataFrame:
    """Hits of TRF's compact output, each with the header line above it; consensus of `longest` bases and more go.

    part: a column that splits the lines into independent files, so that no
    window runs over more than one of them. For large files take
    read_trf, which cuts them at headers without a window.
    """
    w = Window.partitionBy(part).orderBy(order)
    head = F.col("value").startswith("@")
    truth = F.last(F.when(head, F.trim(F.expr("substring(value, 2)"))), ignorenulls=True).over(w)
    own = lines.withColumn("truth", truth).where(~head).select("truth", trf_hit(F.col("value")).alias("hit"))
    return own.select("truth", "hit.*").where(F.col("consensus") < longest)


def read_trf(spark: SparkSession, path: str, longest: int = 200) -> DataFrame:
    """record, truth, hits of every header of TRF's compact output, also of those without hits."""
    raw = spark.read.option("lineSep", "\n@").text(path).withColumn("record", F.monotonically_increasing_id())
    return trf_records(raw, longest)


def trf_records(raw: DataFrame, longest: int = 200) -> DataFrame:
    """record, truth, hits from the `value` of records that still may hold their first `@`; hits are in the order of the lines."""
    lines = raw.select("record", F.explode(F.array(F.split(F.translate("value", "\r", ""), "\n"))).alias("lines"))
    hits = F.filter(F.transform(F.expr("slice(lines, 2, size(lines))"), trf_hit), lambda h: h["consensus"] < longest)
    return lines.select("record", F.trim(F.regexp_replace(F.col("lines")[0], "^@", "")).alias("truth"), hits.alias("hits")).where("truth != ''")


#: A prime; draws are numbers below it.
PRIME = 2_147_483_647
ACGT = np.frombuffer(b"ACGT", np.uint8)
#: By letter the bases that may take its place.
OTHER = np.array([[c for c in b"ACGT" if c != x][:3] for x in range(256)], np.uint8)


def draw(x: Column, what: Column | int) -> Column:
    """A number below PRIME that x, not negative, and `what` decide, by arithmetic that any engine repeats."""
    y = (x % PRIME + what * 15_485_863) % PRIME
    for _ in range(2):
        y = (y * y % PRIME * 48_271 + y + 12_345) % PRIME
    return y


def mosaic(read_id: Column, units: Column, seed: Column | int, low: int = 10, high: int = 200) -> tuple[Column, Column]:
    """Header `(U)i(V)j` and bases of the mosaic read that a number, not negative, has of an array of units; copies are uniform in [low, high)."""
    counts = F.transform(units, lambda u, k: (low + draw(read_id * 1_009 + seed, k) % (high - low)).cast("int"))
    header = F.zip_with(units, counts, lambda u, n: F.concat(F.lit("("), u, F.lit(")"), n.cast("string")))
    return F.array_join(header, ""), F.array_join(F.zip_with(units, counts, F.repeat), "")


def mosaics(keys: DataFrame, units: list[str], low: int = 10, high: int = 200, error: float = 0.0, seed: int = 42) -> DataFrame:
    """A mosaic read for each read_id of keys, which is not negative: read_id, header `(U)i(V)j`, seq. Copies are uniform in [low, high); each base errs with probability `error`: a third each inserted after, deleted, replaced."""
    header, clean = mosaic(F.col("read_id"), F.array(*map(F.lit, units)), seed, low, high)
    out = spread(keys).select("read_id", header.alias("header"), clean.alias("seq"))
    return with_errors(out, error, seed) if error > 0 else out


def simulate(spark: SparkSession, units: list[str], n: int, low: int = 10, high: int = 200, error: float = 0.0, seed: int = 42) -> DataFrame:
    """n mosaic reads."""
    return mosaics(spark.range(n).withColumnRenamed("id", "read_id"), units, low, high, error, seed)


#: Bases whose errors are drawn together.
BASES = 1 << 19


def drawn(x: np.ndarray, what: int) -> np.ndarray:
    """What draw gives."""
    y = (x % PRIME + what * 15_485_863) % PRIME
    for _ in range(2):
        y = (y * y % PRIME * 48_271 + y + 12_345) % PRIME
    return y


def erring(ids: np.ndarray, seqs: list[bytes], share: np.ndarray, seed: int) -> list[str]:
    """Reads with errors, of which each base is drawn by its read and place."""
    size = np.array([len(x) for x in seqs])
    text, read = np.frombuffer(b"".join(seqs), np.uint8), np.repeat(np.arange(len(seqs)), size)
    first = np.cumsum(size) - size
    at = ids[read] * 1_000_003 + (np.arange(len(text)) - first[read]) * 7_919 + seed
    hit = np.flatnonzero(drawn(at, 100) % 1_000_000 < share[read])
    kind = drawn(at[hit], 101) % 3
    count = np.ones(len(text), np.int64)
    count[hit] += np.where(kind == 0, 1, np.where(kind == 1, -1, 0))
    out = text.copy()
    other = hit[kind > 1]
    out[other] = OTHER[text[other], drawn(at[other], 102) % 3]
    more = hit[kind == 0]
    ends = np.cumsum(count)
    out = np.repeat(out, count)
    out[ends[more] - 1] = ACGT[drawn(at[more], 103) % 4]
    told, cuts = out.tobytes().decode("ascii"), np.concatenate([[0], ends])[np.concatenate([first, [len(text)]])].tolist()
    return [told[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def with_errors(reads: DataFrame, error: Column | float, seed: int = 42) -> DataFrame:
    """reads (read_id, not negative, and seq of ACGT) with errors at a share of the bases."""
    share = F.round((F.lit(error) if isinstance(error, float) else error) * 1_000_000)

    @F.pandas_udf("string")
    def err(ids: pd.Series, seqs: pd.Series, shares: pd.Series) -> pd.Series:
        own, size, out = [x.encode("ascii") for x in seqs], 0, []
        begin = 0
        for end, x in enumerate(own, 1):
            size += len(x)
            if size >= BASES or end == len(own):
                out += erring(ids.to_numpy()[begin:end], own[begin:end], shares.to_numpy()[begin:end], seed)
                begin, size = end, 0
        return pd.Series(out, dtype=object)

    # called not deterministic so that no filter on the result is moved below it: the errors are drawn once
    err, known = err.asNondeterministic(), F.coalesce("seq", F.lit(""))
    return reads.withColumn("seq", F.when(F.col("seq").isNotNull(), err(F.col("read_id").cast("long"), known, share)))
