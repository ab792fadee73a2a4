"""Text forms of results and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna


def units_text() -> Column:
    """[n (prio,unit,len,bases,tandem) ...]"""
    each = F.transform("units", lambda u: F.concat(F.lit("("), F.concat_ws(",", u["prio"].cast("string"), u["unit"], u["len"].cast("string"), u["bases"].cast("string"), u["tandem_bases"].cast("string")), F.lit(")")))
    return F.concat(F.lit("["), F.concat_ws(" ", F.size("units").cast("string"), F.array_join(each, " ")), F.lit("]"))


def fasta_text(results: DataFrame, locus: str | None = None, with_ids: bool = False, decomp: bool = True, annotation: bool = False) -> DataFrame:
    """read_ord, value: annotated records. results needs header, seq, group_size, and sample_id and read_name for ids; hap is used if there."""
    ratio = dna.ratio_text(F.col("discrepancy_ratio"))
    ids = ["sample_id", "read_name"] if with_ids else []
    info = F.concat_ws(",", *ids, F.col("seq_len").cast("string"), F.col("group_size").cast("string"), *([F.col("num_key_units").cast("string")] if with_ids else []), ratio)
    parts = [*([F.lit(f"#Locus {locus}")] if locus else []), F.concat(F.lit("#Info ("), info, F.lit(")")), F.concat(F.lit("#Pat "), "pattern")]
    if "hap" in results.columns:
        parts.append(F.concat(F.lit("#Hap <"), F.coalesce("hap", F.lit("(null)")), F.lit(">")))
    parts += [F.concat(F.lit("#Decomp "), units_text())] * decomp + [F.concat(F.lit("#Annotation "), "header")] * annotation
    return results.select("read_ord", F.concat(F.lit("> "), F.concat_ws(" ", *parts), F.lit("\n"), "seq").alias("value"))


def unit_records(freq: DataFrame, locus: str | None = None) -> DataFrame:
    """canon, value: the units of a file as records."""
    at = f"#Locus {locus} " if locus else ""
    return freq.select("canon", F.concat(F.lit(f"> {at}frequent unit. freq. = "), F.col("freq").cast("string"), F.lit("\n"), "canon").alias("value"))


def table_text(results: DataFrame) -> DataFrame:
    """read_ord, value: `sample,read (len,group,units,ratio) [units]`."""
    info = F.concat_ws(",", F.col("seq_len").cast("string"), F.col("group_size").cast("string"), F.col("num_key_units").cast("string"), dna.ratio_text(F.col("discrepancy_ratio")))
    return results.select("read_ord", F.concat(F.concat_ws(",", "sample_id", "read_name"), F.lit(" ("), info, F.lit(") "), units_text()).alias("value"))


def write_fasta(results: DataFrame, freq: DataFrame, path: str, **options) -> None:
    """Annotated records in the order of the file, then the units; part files are in order of their names."""
    own = fasta_text(results, **options).select(F.lit(0).alias("k"), F.col("read_ord").alias("o"), F.lit("").alias("c"), "value")
    units = unit_records(freq, options.get("locus")).select(F.lit(1).alias("k"), F.lit(0).cast("long").alias("o"), F.col("canon").alias("c"), "value")
    own.unionByName(units).orderBy("k", "o", "c").select("value").write.text(path)


def write_table(results: DataFrame, path: str) -> None:
    """Lines of the table in the order of the file."""
    table_text(results).orderBy("read_ord").select("value").write.text(path)


def pieces(results: DataFrame, body: Column) -> DataFrame:
    """k, o, c, value: the count of reads, then a piece of text for each."""
    head = results.agg(F.count("*").alias("n")).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("o"), F.lit("").alias("c"), F.concat(F.lit(" #haplotypes="), F.col("n").cast("string")).alias("value"), "n")
    own = results.select(F.lit(1).alias("k"), F.col("read_ord").cast("long").alias("o"), F.lit("").alias("c"), body.alias("value"))
    return head.unionByName(own.withColumn("n", F.lit(1).cast("long")))


def info(with_ids: bool, with_units: bool) -> Column:
    """(sample,read,len,group,units,ratio), the ratio with two digits."""
    names = [*(["sample_id", "read_name"] if with_ids else []), "seq_len", "group_size", *(["num_key_units"] if with_units else [])]
    return F.concat(F.lit("("), F.concat_ws(",", *(F.col(c).cast("string") for c in names), dna.ratio_text(F.col("discrepancy_ratio"), 2)), F.lit(") "))


def pattern_statistics(results: DataFrame, with_ids: bool = False) -> DataFrame:
    """k, o, c, value: the count of reads and the pattern of each, in this order; no rows without reads."""
    return pieces(results, F.concat(info(with_ids, False), "pattern")).where("n > 0").drop("n")


def unit_summary(results: DataFrame, freq: DataFrame) -> DataFrame:
    """k, o, c, value: the count of reads, the units of each, the count of units and each one's frequency, in this order."""
    own = pieces(results, F.concat(info(True, True), units_text())).drop("n")
    head = freq.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(2).alias("k"), F.lit(0).cast("long").alias("o"), F.lit("").alias("c"), F.concat(F.lit("#units="), F.col("n").cast("string")).alias("value"))
    each = freq.select(F.lit(3).alias("k"), F.lit(0).cast("long").alias("o"), F.col("canon").alias("c"), F.concat(F.lit("("), "canon", F.lit(","), F.col("freq").cast("string"), F.lit(")")).alias("value"))
    return own.unionByName(head).unionByName(each)


def write_line(of: DataFrame, path: str) -> None:
    """Pieces as one line, which runs on over the part files in order of their names: no task holds all of it."""
    of.orderBy("k", "o", "c").select("value").write.option("lineSep", " ").text(path)


def summary(results: DataFrame) -> DataFrame:
    """n_haplotypes, n_bases, n_tandem, mean_ratio over all reads with a decomposition: totals that no order of reads changes."""
    tandem = F.aggregate("units", F.lit(0).cast("long"), lambda a, u: a + u["tandem_bases"])
    return results.agg(F.count("*").alias("n_haplotypes"), F.sum("seq_len").alias("n_bases"), F.sum(tandem).alias("n_tandem"), F.avg("discrepancy_ratio").alias("mean_ratio"))
