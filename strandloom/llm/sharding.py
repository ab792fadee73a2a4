"""Sharding by extendible hashing, in DataFrame operations only.

The key of a row is the leading 60 bits of the MD5 of its id. A directory is
indexed by the leading bits of the key. It begins with one bucket; a bucket
whose rows have more bytes than the limit is split on one more bit, no other
is. The shards are the buckets that are left.

Bytes are first summed by cell, a prefix long enough for cells to be far below
the limit, so splitting works on small sums and not on rows; only the rows of
cells that are still too large are summed again on more bits. A single id
whose rows have more bytes than the limit can't be split by its hash: its rows
are dealt over pages in the same way by a number written with each row, and a
page is over the limit only if its one row is.

A null id has its own key (all zeros) and is sharded like any other. A null or
empty text has 0 bytes, but a row weighs one byte at least, so no shard has
more rows than bytes in the limit. An empty table gives no rows. Repeated rows
count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import join_hot, stored

BITS = 60
#: Bits beyond those that shards of the limit's size would need; cells average a 64th of the limit.
FINER = 6
#: Depths that a cell is looked at before sums of longer steps are made from it.
STEP = 8


def key(column: str) -> Column:
    """60 bits of the MD5 of an id as text, as a long."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def shortened(cell: str, bits: Column | int) -> Column:
    """A prefix without its last bits."""
    return F.call_function("shiftright", F.col(cell), (F.lit(bits) if isinstance(bits, int) else bits).cast("int"))


def split(sums: DataFrame, top: int, bottom: int, limit: int) -> DataFrame:
    """From sums (cell, weight) by prefixes of `bottom` bits: (cell, depth, over) of the bucket that each cell ends in.

    Buckets are looked at from depth `top` on: those of the last STEP depths by
    cell, those above from the sums of a prefix STEP bits shorter. A cell that
    is over the limit by itself ends at depth `bottom`, to be split further.
    """
    low = max(top, bottom - STEP)
    each = sums.select("cell", "weight", F.explode(F.sequence(F.lit(low), F.lit(bottom))).alias("depth")).withColumn("bucket", shortened("cell", F.lit(bottom) - F.col("depth")))
    small = each.groupBy("depth", "bucket").agg(F.sum("weight").alias("total")).where(F.col("total") <= limit)
    # a bucket ends splitting where it is the first on its path within the limit
    ends = each.join(small.select("depth", "bucket"), ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    out = sums.select("cell").join(ends, "cell", "left").select("cell", F.coalesce("depth", F.lit(bottom)).alias("depth"), F.col("depth").isNull().alias("over"))
    if low == top:
        return out
    shorter = stored(sums.groupBy(shortened("cell", bottom - low).alias("cell")).agg(F.sum("weight").alias("weight")), "shards-cells")
    above = split(shorter, top, low, limit).where("not over").select(F.col("cell").alias("up"), F.col("depth").alias("first"))
    met = out.withColumn("up", shortened("cell", bottom - low)).join(above, "up", "left")
    return met.select("cell", F.coalesce("first", "depth").alias("depth"), "over")


def leading(depth: Column) -> Column:
    """The leading bits of the key."""
    return shortened("k", F.lit(BITS) - depth)


def deal(rows: DataFrame, limit: int) -> DataFrame:
    """rows (k, weight, ...) with depth and bucket of each, and over: whether its bucket has all bits and is over the limit still."""
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    top, bottom = 0, min(BITS, max(1, (total // limit).bit_length()) + FINER)
    left, done = rows, None
    while True:
        left = left.withColumn("cell", leading(F.lit(bottom)))
        at = stored(split(stored(left.groupBy("cell").agg(F.sum("weight").alias("weight")), "shards-cells"), top, bottom, limit), "shards-ends")
        placed = stored(join_hot(left, at, ["cell"]).drop("cell"), "shards-placed")
        last = bottom == BITS
        part = placed if last else placed.where("not over")
        done = part if done is None else done.unionByName(part)
        left = placed.where("over").select(*rows.columns)
        if last or left.isEmpty():
            return done.withColumn("bucket", leading(F.col("depth")))
        top, bottom = bottom + 1, min(BITS, bottom + FINER)


def shards(docs: DataFrame, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth, bucket, page: the shard of every row is (depth, bucket, page)."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    own = docs.select(F.col(id_column).alias("doc_id"), key(id_column).alias("k"), size.alias("n_bytes"), F.greatest(size, F.lit(1)).alias("weight"))
    # the row number is written once and only read after that, so a recomputed task can't change it
    dealt = deal(stored(own.withColumn("row", F.monotonically_increasing_id()), "shards-rows"), limit)
    fine = dealt.where("not over").select("doc_id", "n_bytes", "depth", "bucket", F.lit(0).cast("long").alias("page"))
    large = dealt.where("over").select("doc_id", "n_bytes", "weight", F.col("depth").alias("d"), F.col("bucket").alias("b"), "row")
    if not large.isEmpty():  # rows of one id, over the limit: the same by row number; a leading 1 keeps prefixes of all depths distinct
        again = deal(large.withColumn("k", key("row")), limit)
        page = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth").cast("int")).bitwiseOR(F.col("bucket"))
        fine = fine.unionByName(again.select("doc_id", "n_bytes", F.col("d").alias("depth"), F.col("b").alias("bucket"), page.alias("page")))
    return fine.withColumn("depth", F.col("depth").cast("int"))


def directory(assigned: DataFrame) -> DataFrame:
    """A row per shard: its bits, rows and bytes."""
    return assigned.groupBy("depth", "bucket", "page").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("shard_bytes"))


def shard_report(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, depth, bucket, page, shard_docs, shard_bytes of every row."""
    own = stored(shards(docs, limit), "shards")
    at = directory(own)
    return join_hot(own, stored(at, "shards-directory"), ["depth", "bucket", "page"]).select("doc_id", "n_bytes", "depth", "bucket", "page", F.col("n_docs").alias("shard_docs"), "shard_bytes")


def oracle(limit: int) -> str:
    """The same in DuckDB, for tables without an id that is over the limit by itself."""
    return f"""
    WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, 0) AS k FROM documents),
    p AS (SELECT depth, k >> ({BITS} - depth)::BIGINT AS bucket, sum(n_bytes) AS total, sum(greatest(n_bytes, 1)) AS weight, count(*) AS n FROM d, (SELECT unnest(range(0, 41))::BIGINT AS depth) GROUP BY ALL),
    m AS (SELECT d.doc_id, d.k, d.n_bytes, min(p.depth) AS depth FROM d JOIN p ON (d.k >> ({BITS} - p.depth)::BIGINT) = p.bucket WHERE p.weight <= {limit} GROUP BY ALL)
    SELECT m.doc_id, m.n_bytes, m.depth::INTEGER AS depth, p.bucket, 0::BIGINT AS page, p.n::BIGINT AS shard_docs, p.total::BIGINT AS shard_bytes
    FROM m JOIN p ON p.depth = m.depth AND p.bucket = m.k >> ({BITS} - m.depth)::BIGINT"""
