"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits; two that differ in at most 3 bits agree in all but
at most one bit of one of their halves. Each half of 32 bits is covered by a
product code: the perfect Golay code on 23 bits (radius 3), the perfect
Hamming code on 7 bits (radius 1) and the trivial code on 2 bits (radius 0).
A fingerprint's home is the anchor nearest to its half. It is also replicated
to every anchor that lies, in the component where the one bit may differ,
within the covering radius plus one; those are the only homes a half one bit
away can have. So a linked pair meets at a home, and homes are compared with
replicas anchor by anchor, on all 64 bits.

Anchors with many members are cut into a grid of cells of bounded size, each
its own group of rows. A cell returns a spanning star of each of its
components and never all pairs. Components come from alternating large-star
and small-star rounds; every round is written to the shared folder.

Texts: null counts as empty; texts without words have fingerprint zero and
link like any others. Repeated rows and exact copies share a fingerprint and
so a component. A null doc_id is never the smallest id of a component that
has others; a component of only null ids has a null component_id.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import apart, free, join_hot, map_texts, sifted, stored

WORDS = 3
SEED = 42
MAX_BITS = 3
#: Most members of a home or replica part that one cell of an anchor holds.
CELL = 4096
#: Most pairs that are compared in one numpy call.
PAIRS = 2_000_000
SCHEMA = "u long, v long"


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of the shingles of so many words, as an unsigned 64-bit number."""
    own = text.encode("utf-8").lower().split()  # bytes: A-Z alone fall, and only the six ASCII spaces split
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])
    if len(own) <= words:
        spans = [(0, len(joined))]
    else:
        starts = [0, *ends[:-1].tolist()]
        spans = zip(starts[: len(own) - words + 1], (ends[words - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def factory():
        return lambda texts: [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(docs, factory, T.StructType([T.StructField("fp", T.LongType())]))


@lru_cache(maxsize=1)
def code_tables() -> dict[str, np.ndarray]:
    """Nearest anchors and the steps to the other anchors in reach, by syndrome."""

    def tables(length: int, check: int, generator: int, radius: int):
        def remainder(x: int) -> int:
            for k in range(length - 1, check - 1, -1):
                if x >> k & 1:
                    x ^= generator << (k - check)
            return x

        leader = {0: 0}
        layer = [0]
        for _ in range(radius):
            layer = list({x ^ 1 << k for x in layer for k in range(length) if not x >> k & 1})
            for x in layer:
                leader.setdefault(remainder(x), x)
        assert len(leader) == 1 << check
        lead = np.array([leader[s] for s in range(1 << check)], dtype=np.uint32)
        bits = [(1 << k, remainder(1 << k)) for k in range(length)]
        steps = [sorted({(int(e) ^ int(lead[s]) ^ int(lead[s ^ r])) >> check for e, r in bits} - {0}) for s in range(1 << check)]
        most = max(map(len, steps))
        step = np.array([x + [0] * (most - len(x)) for x in steps], dtype=np.uint32)
        return lead, step, np.array([remainder(1 << k) for k in range(length)], dtype=np.uint32)

    g_lead, g_step, g_bits = tables(23, 11, 0b110001110101, 3)
    h_lead, h_step, h_bits = tables(7, 3, 0b1011, 1)
    return {"g_lead": g_lead, "g_step": g_step, "g_bits": g_bits, "h_lead": h_lead, "h_step": h_step, "h_bits": h_bits}


def anchors(half: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The 18-bit home anchor of every 32-bit half, and (row numbers, anchors) of the other anchors in reach."""
    t = code_tables()
    half = half.astype(np.uint32)
    g, h, raw = half >> 9, half >> 2 & 0x7F, half & 3

    def syndrome(x, bits):
        s = np.zeros(len(x), np.uint32)
        for k, b in enumerate(bits):
            s ^= np.where(x >> np.uint32(k) & 1, b, np.uint32(0))
        return s

    gs, hs = syndrome(g, t["g_bits"]), syndrome(h, t["h_bits"])
    gm, hm = (g ^ t["g_lead"][gs]) >> 11, (h ^ t["h_lead"][hs]) >> 3
    home = gm << 6 | hm << 2 | raw
    every, out = np.arange(len(half)), []
    for col in range(t["g_step"].shape[1]):
        s = t["g_step"][gs, col]
        on = s != 0
        out.append((every[on], home[on] ^ s[on] << 6))
    for col in range(t["h_step"].shape[1]):
        s = t["h_step"][hs, col]
        on = s != 0
        out.append((every[on], home[on] ^ s[on] << 2))
    out += [(every, home ^ np.uint32(1)), (every, home ^ np.uint32(2))]
    return home, out


def replicate(batches):
    """fp -> (anchor, fp, home): a row for the home and for every other anchor in reach, for either half."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in (0, 1):
            half = (fp >> np.uint64(32 * k)).astype(np.uint32)
            home, others = anchors(half)
            at = np.concatenate([np.arange(len(fp)), *(i for i, _ in others)])
            key = np.concatenate([home, *(a for _, a in others)]).astype(np.int64) | k << 18
            is_home = np.arange(len(at)) < len(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at].view(np.int64)), pa.array(is_home)], names=["anchor", "fp", "home"])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for the components of the links a-b, without the smallest members themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        np.minimum.at(new, label, new)  # roots hear of what their members found
        new = new[new]
        if (new == label).all():
            break
        label = new
    on = label != np.arange(len(nodes))
    return nodes[on], nodes[label[on]]


def compare(batches):
    """Rows sorted by (anchor, i, j) -> (u, v): stars of the components of each cell's links of home with replica or home."""
    held: list[tuple[np.ndarray, ...]] = []

    def links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray):
        # every row is a possible partner; homes are the ones looked up
        first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)]))
        size = np.diff(np.append(first, len(fp)))
        h = np.flatnonzero(home)
        group = np.searchsorted(first, h, side="right") - 1
        begin, count = first[group], size[group]
        total = np.cumsum(count)
        k = 0
        while k < len(h):
            to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIRS)))
            c = count[k:to]
            row = np.repeat(np.arange(k, to), c)
            partner = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[k:to], c)
            x, y = fp[h[row]], fp[partner]
            on = (x < y) & (np.bitwise_count(x ^ y) <= MAX_BITS)
            if on.any():
                yield stars(x[on].view(np.int64), y[on].view(np.int64))
            k = to

    def flush(rows):
        cell, fp, home = (np.concatenate([r[n] for r in rows]) for n in range(3))
        for u, v in links(cell, fp, home):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in range(3)], axis=1)
        fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        home = batch.column(4).to_numpy(zero_copy_only=False)
        cut = len(fp) - int(np.argmax((cell[::-1] != cell[-1]).any(axis=1))) if (cell != cell[-1]).any() else 0
        if cut:
            held.append((cell[:cut], fp[:cut], home[:cut]))
            yield from flush(held)
            held = []
        held.append((cell[cut:], fp[cut:], home[cut:]))
    if held:
        yield from flush(held)


def links(distinct: DataFrame) -> DataFrame:
    """Stars (u, v) whose components are those of all links of the distinct fingerprints in column fp."""
    rep = stored(distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean"), "simhash-anchors")
    sizes = rep.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home"))
    # only anchors too large for a cell are listed; there are at most (all rows / CELL) of them
    hot = sizes.where(F.col("n") > CELL).select("anchor", F.ceil(F.col("n_home") / CELL).alias("rows"), F.ceil(F.col("n") / CELL).alias("cols"))
    grid = rep.join(hot, "anchor", "left").withColumn("h", F.xxhash64("fp"))
    own_row, own_col = F.pmod("h", F.col("rows")), F.pmod(F.shiftright("h", 20), F.col("cols"))
    zero, none = F.array(F.lit(0).cast("long")), F.col("rows").isNull()
    # as a partner a row lies in one column and all rows of the grid; a home is looked up in one row and all columns
    partner = grid.select("anchor", F.explode(F.when(none, zero).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("rows") - 1, F.lit(0))))).alias("i"), F.when(none, 0).otherwise(own_col).cast("long").alias("j"), "fp", F.when(none, F.col("home")).otherwise(False).alias("home"))
    looked = grid.where(~none & F.col("home")).select("anchor", own_row.cast("long").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("j"), "fp", F.lit(True).alias("home"))
    n = int(rep.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = partner.unionByName(looked).repartition(n, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return cells.mapInArrow(compare, SCHEMA)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u of the links but the smallest of its component, which is v."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "components")

    def seen(df):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = seen(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(apart(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "components")
        after = seen(now)
        if after == before:
            break
        before = after
    return now


def members(distinct: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint that has links; root is the least fingerprint of its component."""
    root = components(links(distinct))
    return root.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(root.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id that links lead to) of every document."""
    own = stored(fingerprints(docs), "simhash-fingerprints")
    first = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-first")
    member = stored(members(first.select("fp")), "simhash-members")
    of_root = stored(member.join(first, "fp").groupBy("root").agg(F.min("first_id").alias("linked_id")), "simhash-roots")
    linked = stored(join_hot(member, of_root, ["root"]).select("fp", "linked_id"), "simhash-linked")
    by_fp = stored(first.join(linked, "fp", "left").select("fp", F.coalesce("linked_id", "first_id").alias("component_id")), "simhash-by-fingerprint")
    return join_hot(own, by_fp, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near-duplicates and all columns.

    It is the row with the smallest doc_id, nulls last, then the smallest hash
    of the text. Rows are told apart by both, so an id that several texts share,
    or null, joins no components. Of rows equal in both one stays.
    """

    def factory():
        def work(texts):
            return [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64), [hashlib.md5(t.encode("utf-8")).hexdigest() for t in texts]]

        return work

    own = stored(map_texts(docs, factory, T.StructType([T.StructField("fp", T.LongType()), T.StructField("h", T.StringType())])), "simhash-rows")
    member = stored(members(own.select("fp").distinct()), "simhash-members")
    rooted = stored(join_hot(own, member, ["fp"]).select("doc_id", "h", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = stored(rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("m")), "simhash-least")
    keeps = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("h") == F.col("m.h"))
    d, t, h = free(docs, "d"), free(docs, "t"), free(docs, "h")
    names = [F.col("doc_id").alias(d), F.col("h").alias(t)]
    match = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t))
    drop = stored(join_hot(rooted, least, ["root"]).where(~keeps).select(*names).distinct(), "simhash-drop")
    # only texts that may have to go are dealt by hash, at any size: no sort, and the same plan for few and many dropped rows
    stay, doubtful = sifted(docs.withColumn(h, F.md5(F.coalesce("text", F.lit("")))), drop, [F.col("doc_id"), F.col(h)], [F.col(d), F.col(t)])
    kept = stay.unionByName(doubtful.join(drop.hint("shuffle_hash"), match, "left_anti"))
    twice = stored(rooted.groupBy("doc_id", "h").count().where("count > 1").select(*names), "simhash-repeated")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    # few rows repeat as a whole; an aggregate that combines before the shuffle leaves one of each
    row = F.struct(*docs.columns)
    one = kept.join(twice, match, "left_semi").groupBy("doc_id", h).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("r")).select("r.*")
    return kept.join(twice, match, "left_anti").select(*docs.columns).unionByName(one)
