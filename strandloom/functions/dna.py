"""Column expressions over DNA strings, headers and patterns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The header of a read that stands for a cluster.
CLUSTER = r"GroupSize = (\d+), Diameter = (\d+), RadiusFromCentroid = (\d+), CentroidReadName = ([^,]+),([^,]+), CentroidReadLength = (\d+)"


def clean(seq: Column) -> Column:
    """Upper case."""
    return F.upper(seq)


def valid(seq: Column) -> Column:
    """Whether a string has only the letters A, C, G and T in either case."""
    return seq.rlike("^[ACGTacgt]*$")


def base_codes(seq: Column) -> Column:
    """A, C, G, T as 1 to 4."""
    return F.translate(seq, "ACGT", "1234")


def rotate(unit: Column, k: Column | int) -> Column:
    """The unit from place k on, then what was before it."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.concat(F.substring(unit, k + 1, F.length(unit)), F.substring(unit, F.lit(1), k))


def canon(unit: Column) -> Column:
    """The least rotation: the same for all rotations of a unit and for no others.

    Two rotations, from places i and j, are compared letter by letter. Where
    they differ at the k-th, none of the k + 1 rotations from the greater one's
    place on is the least; so each step passes a letter, and three times the
    length are enough.
    """

    def step(s, _):
        n = F.size(s["letters"])
        a, b = (F.get(s["letters"], (s[x] + s["k"]) % n) for x in "ij")
        i = F.when(a > b, s["i"] + s["k"] + 1).otherwise(s["i"])
        j = F.when(a < b, s["j"] + s["k"] + 1).otherwise(s["j"])
        apart = F.struct(s["letters"].alias("letters"), i.alias("i"), F.when(i == j, j + 1).otherwise(j).alias("j"), F.lit(0).alias("k"))
        on = F.struct(s["letters"].alias("letters"), s["i"].alias("i"), s["j"].alias("j"), (s["k"] + 1).alias("k"))
        over = (s["i"] >= n) | (s["j"] >= n) | (s["k"] >= n)
        return F.when(over, s).when(a == b, on).otherwise(apart)

    begin = F.struct(F.split(unit, "").alias("letters"), F.lit(0).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(3 * F.length(unit), F.lit(1))), begin, step, lambda s: rotate(unit, F.least(s["i"], s["j"])))


def same_unit(a: Column, b: Column) -> Column:
    """Whether one unit is a rotation of the other."""
    return (F.length(a) == F.length(b)) & F.contains(F.concat(b, b), a)


def unbordered(unit: Column) -> Column:
    """Whether no proper prefix is also a suffix."""
    n = F.length(unit)
    return (n == 1) | ~F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda b: F.left(unit, b) == F.right(unit, b))


def window_length(n: Column) -> Column:
    """The smoothing window: an odd fifth of the length between 11 and 41."""
    fifth = F.floor(n / 5)
    return F.least(F.lit(41), F.greatest(F.lit(11), fifth + F.when(fifth % 2 == 0, 1).otherwise(0))).cast("int")


def parse_header(header: Column) -> dict[str, Column]:
    """Columns of a cluster header; other headers give NA names, group size 1 and nulls."""
    got = lambda k: F.nullif(F.regexp_extract(header, CLUSTER, k), F.lit(""))
    return {
        "group_size": F.coalesce(got(1).cast("int"), F.lit(1)), "diameter": got(2).cast("int"), "radius": got(3).cast("int"),
        "sample_id": F.coalesce(got(4), F.lit("NA")), "read_name": F.coalesce(got(5), F.lit("NA")), "centroid_len": got(6).cast("int"),
    }


def tag(header: Column, name: str) -> Column:
    """The value of `#name value` in an annotated header, null without it."""
    return F.nullif(F.regexp_extract(header, f"#{name} (\\S+)", 1), F.lit(""))


def parse_pattern(text: Column) -> Column:
    """`(U)i(V)j` or `<U>i<V>j` as an array of (unit, copies)."""
    units = F.regexp_extract_all(text, F.lit(r"[(<]([ACGT]+)[)>](\d+)"), F.lit(1))
    copies = F.regexp_extract_all(text, F.lit(r"[(<]([ACGT]+)[)>](\d+)"), F.lit(2))
    return F.transform(F.arrays_zip(units.alias("u"), copies.alias("n")), lambda x: F.struct(x["u"].alias("unit"), x["n"].cast("int").alias("copies")))


def trim_suffix(name: Column) -> Column:
    """A name up to its first underscore."""
    return F.substring_index(name, "_", 1)


def ratio_text(x: Column, digits: int = 3) -> Column:
    """A ratio with so many digits, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits))
