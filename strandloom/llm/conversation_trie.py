"""The trie of conversations that share their first turns.

A node is a distinct sequence of first turns; its key is a 128-bit digest of
the sequence, the exclusive or of the digests of its turns with their places.
So the key of a node's parent is known without looking for it. Sums over
subtrees come by pointer jumping: in each round a node's sum goes to its
ancestor 2**k levels up, and the pointer becomes that of this ancestor, so the
deepest conversation of n turns takes about log2(n) rounds. Each round is
written to the shared folder.

Turns are ordered by turn, null first, ties by role and text; null role or text
becomes empty. Rows without conv_id belong to no conversation and are left out.
Repeated rows are turns like others. Other columns aren't read. An empty table
has no members and gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import apart, stored

#: Conversations share the first turns of the first one of each so many.
FAMILY = 100
MOST_SHARED = 6
#: Ids that are joined to one piece of text before pieces of a node meet.
PIECE_IDS = 4096


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, p (1, 2, ...), role, text of every turn."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", F.row_number().over(w).cast("long").alias("p"), "role", "text")


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, p, role, text) of turns, and (conv_id, n) of conversations."""
    turns = stored(ordered(conversations), "trie-turns")
    return turns, turns.groupBy("conv_id").agg(F.max("p").alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first conversation of their family: turns and conversations as plain() gives them."""
    turns = stored(ordered(conversations), "trie-turns")
    own = turns.groupBy("conv_id").agg(F.max("p").alias("n"))
    leader = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    leads = own.where(F.col("conv_id") == leader).select(F.col("conv_id").alias("leader"), F.col("n").alias("n_leader"))
    convs = own.select("conv_id", "n", leader.alias("leader"), h.alias("h")).join(leads, "leader", "left")
    taken = F.least("h", F.coalesce("n_leader", F.lit(0)))
    convs = stored(convs.select("conv_id", "leader", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "trie-conversations")
    first = turns.where((F.col("p") < MOST_SHARED) & (F.col("conv_id") == leader)).withColumnRenamed("conv_id", "leader")
    shared = convs.where("taken > 0").select("conv_id", "leader", "taken").join(first, "leader").where("p <= taken").select("conv_id", "p", "role", "text")
    rest = turns.join(apart(convs.select("conv_id", "h", "taken")), "conv_id").where("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "role", "text")
    return shared.unionByName(rest), convs.select("conv_id", "n")


def half(digest: F.Column, k: int) -> F.Column:
    """The k-th 64 bits of a hexadecimal digest as a signed number."""
    return F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node and parent (digests x, y) and chars of every first part of every conversation but the empty one."""
    digest = F.md5(F.concat_ws(":", F.col("p"), F.length("role"), "role", "text"))
    marked = turns.select("conv_id", "p", F.length("text").cast("long").alias("chars"), digest.alias("d")).select("conv_id", "p", "chars", half(F.col("d"), 0).alias("tx"), half(F.col("d"), 1).alias("ty"))
    w = Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    upto = marked.withColumns({"x": F.bit_xor("tx").over(w), "y": F.bit_xor("ty").over(w)})
    return upto.select("conv_id", F.col("p").alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("tx")).alias("px"), F.col("y").bitwiseXOR(F.col("ty")).alias("py"), "chars")


def digest_ends(batches):
    """Pieces of ids, sorted by node and place -> the SHA-256 of each node's ids, one piece at a time."""
    node, sha = None, None
    for batch in batches:
        done = []
        for x, y, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (x, y) != node:
                if sha:
                    done.append((*node, sha.hexdigest()))
                node, sha = (x, y), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode("ascii"))
        if done:
            yield ends_batch(done)
    if sha:
        yield ends_batch([(*node, sha.hexdigest())])


def ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names=["x", "y", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """x, y, ends_sha256: of the ids of the conversations that end at each node, ascending."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = members.groupBy("x", "y", F.floor(F.col("conv_id") / PIECE_IDS).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition(n, "x", "y").sortWithinPartitions("x", "y", "piece").mapInArrow(digest_ends, "x long, y long, ends_sha256 string")


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """x, y, n_leaves, saved_tokens of whole subtrees, from nodes with x, y, px, py, depth, leaf, saved."""
    now = stored(nodes.select("x", "y", "depth", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "trie-round")
    step = 1
    while step <= deepest:
        # what lies `step` to 2 * step - 1 levels below comes from the nodes whose pointer leads here
        gain = now.where(F.col("depth") >= step).groupBy(F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        summed = now.join(gain, ["x", "y"], "left")
        up = now.where(F.col("depth") >= step).select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
        summed = summed.select("x", "y", "depth", "ax", "ay", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
        far, near = summed.where(F.col("depth") >= 2 * step), summed.where(F.col("depth") < 2 * step)
        moved = apart(far).join(up, ["ax", "ay"]).select("x", "y", "depth", F.col("bx").alias("ax"), F.col("by").alias("ay"), "n_leaves", "saved_tokens")
        none = F.lit(None).cast("long")
        now = stored(moved.unionByName(near.withColumns({"ax": none, "ay": none})), "trie-round")
        step *= 2
    return now.select("x", "y", "n_leaves", "saved_tokens")


def trie(rows: tuple[DataFrame, DataFrame]) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node; rows: turns and conversations of plain() or rebuilt()."""
    turns, convs = rows
    convs = stored(convs, "trie-members")
    paths = stored(prefixes(turns), "trie-prefixes")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("x"), zero.alias("y"), zero.alias("depth"), none.alias("px"), none.alias("py"), "conv_id", "n_convs", zero.alias("chars"))
    below = paths.groupBy("x", "y", "depth", "px", "py").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = stored(below.select(*root.columns).unionByName(root), "trie-nodes")
    children = nodes.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = stored(nodes.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "trie-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    last = paths.join(apart(convs), "conv_id").where("depth = n").select("x", "y", "conv_id").unionByName(convs.where("n = 0").select(zero.alias("x"), zero.alias("y"), "conv_id"))
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(rolled_up(nodes, deepest), ["x", "y"]).join(ends(last), ["x", "y"], "left")
    whole = apart(whole).join(parents, ["px", "py"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def oracle() -> str:
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""
WITH RECURSIVE bits AS (SELECT range AS i, 0 AS k, range::BIGINT AS c FROM range(256) UNION ALL SELECT i, k + 1, {step} FROM bits WHERE k < 8),
crc AS (SELECT i, c FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
spelt AS (SELECT conv_id, conv_id::VARCHAR AS s, 1 AS k, 4294967295::BIGINT AS c FROM ids
  UNION ALL SELECT conv_id, s, k + 1, xor(spelt.c // 256, crc.c) FROM spelt JOIN crc ON crc.i = xor(spelt.c % 256, ascii(s[k])) WHERE k <= length(s)),
conv AS (SELECT conv_id, xor(c, 4294967295) % {MOST_SHARED} AS h, conv_id - conv_id % {FAMILY} AS leader FROM spelt WHERE k = length(s) + 1),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
many AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
taken AS (SELECT conv.conv_id, h, leader, least(h, coalesce(n, 0)) AS t FROM conv LEFT JOIN many ON many.conv_id = leader),
turns AS (SELECT taken.conv_id, p, role, text FROM taken JOIN own ON own.conv_id = leader WHERE p <= t
  UNION ALL SELECT conv_id, p - h + t, role, text FROM taken JOIN own USING (conv_id) WHERE p > h),
marked AS (SELECT conv_id, p, length(text) AS chars, md5(concat(length(role), ':', role, text)) AS m FROM turns),
paths AS (SELECT conv_id, p AS depth, chars, string_agg(m, ',') OVER (PARTITION BY conv_id ORDER BY p) AS node FROM marked
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv),
deepest AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved FROM paths GROUP BY node, depth),
ends AS (SELECT node, string_agg(conv_id, ',' ORDER BY conv_id) AS e FROM paths JOIN deepest USING (conv_id) WHERE depth = n GROUP BY node),
up AS (SELECT u.node, u.depth, u.saved, a.node AS above, a.depth AS above_depth FROM nodes u JOIN paths a ON a.conv_id = u.conv_id AND a.depth <= u.depth),
kids AS (SELECT above AS node, count(*) AS n FROM up WHERE depth = above_depth + 1 GROUP BY above),
parent AS (SELECT up.node, p.conv_id FROM up JOIN nodes p ON p.node = above WHERE up.depth = above_depth + 1),
sums AS (SELECT above AS node, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum(saved) AS saved FROM up LEFT JOIN kids USING (node) GROUP BY above)
SELECT nodes.conv_id::BIGINT AS conv_id, nodes.depth::BIGINT AS depth, parent.conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN parent USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)"""
