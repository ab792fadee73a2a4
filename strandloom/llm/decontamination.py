"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Test items are cut into windows of WINDOW consecutive words (a shorter item is
one window). The training texts are split into words once and the postings of
all test terms written: term, document, place. The lengths of the lists come
from these. The list of a window's rarest term, less the term's offset, holds
the places where the window might begin; it is intersected with the list of
the second rarest term, adjusted likewise, and then with those of all other
terms, read only for documents that are left. What is left are exact phrases.
Proximity matches come from the same lists: the two rarest terms of a window
within NEAR words of each other, in any order.

The lists of terms that are among the two rarest of some window are short and
written once more by themselves. Nothing is broadcast by hint: Spark broadcasts a side whose written size it
knows to be small and shuffles it otherwise. Joins on places are dealt by
document, place and term, so no document and no term is one task's.

Null texts have no words, an item without words has no window, documents
without matches get zeros. Equal items each count. Rows that repeat an id and
a text share their matches and each get a row. doc_id may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import free, stored

WINDOW = 10
#: Words that the two terms of a proximity match may be apart.
NEAR = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The term of the posting that each document has at the place after its last word.
END = " "


def pieces(text: Column) -> Column:
    """A text cut at gaps, A-Z lowered: its words, and an empty piece where it begins or ends with a gap or is empty."""
    return F.split(F.translate(text, UPPER, LOWER), GAP + "+")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, win: the windows of every item."""
    w = F.filter(pieces(F.coalesce("text", F.lit(""))), lambda w: w != "")
    own = benchmark.select("item_id", w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return own.select("item_id", F.explode(F.transform(starts, lambda k: F.slice("w", k, size))).alias("win")).distinct()


def text_hash(text: str = "text") -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.coalesce(F.length(text), F.lit(0)))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, h, at: the places (from 0) of the terms in all texts, and an END at the number of words of each text."""
    text = F.coalesce("text", F.lit(""))
    gap = lambda c: F.translate(c, UPPER, LOWER).rlike(GAP)
    before, after = (text == "") | gap(F.left(text, F.lit(1))), gap(F.right(text, F.lit(1)))
    own = docs.select("doc_id", text_hash().alias("h"), before.cast("int").alias("before"), after.cast("int").alias("after"), F.concat(pieces(text), F.array(F.lit(END))).alias("w"))
    each = own.select("doc_id", "h", "before", "after", F.posexplode("w").alias("at", "term"))
    wanted = terms.unionByName(terms.sparkSession.range(1).select(F.lit(END).alias("term")))
    at = F.col("at") - F.col("before") - F.when(F.col("term") == END, F.col("after")).otherwise(0)
    return each.join(wanted, "term", "left_semi").select("term", "doc_id", "h", at.alias("at"))


def named(lists: DataFrame) -> DataFrame:
    """Postings with names for the other side of a join: d, g, place, word."""
    return lists.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("at").alias("place"), F.col("term").alias("word"))


class Index:
    """The written postings of the terms of a benchmark in a corpus, with its windows."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW):
        self.items = stored(windows(benchmark, size), "decontamination-items")
        terms = stored(self.items.select(F.explode("win").alias("term")).distinct(), "decontamination-terms")
        self.postings = stored(postings(docs, terms), "decontamination-index")
        lengths = stored(self.lists().groupBy("term").agg(F.count("*").alias("n")), "decontamination-lengths")
        # a term without postings rules its windows out
        each = self.items.select("win").distinct().select("win", F.posexplode("win").alias("off", "term")).join(lengths, "term")
        rare = each.groupBy("win").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("terms")).where("size(terms) = size(win)")
        self.windows = stored(rare.withColumn("win_id", F.monotonically_increasing_id()), "decontamination-windows")
        # the lists of the two rarest terms of any window are short; they are written apart, so no search reads or moves all lists
        rarest = self.windows.select(F.explode(F.expr("slice(terms, 1, 2)")).alias("t")).select("t.term").distinct()
        self.short = stored(self.lists().join(stored(rarest, "decontamination-rarest"), "term", "left_semi"), "decontamination-short")

    def lists(self) -> DataFrame:
        return self.postings.where(F.col("term") != END)

    def sizes(self) -> DataFrame:
        """doc_id, h, n_words of every row."""
        return self.postings.where(F.col("term") == END).select("doc_id", "h", F.col("at").cast("long").alias("n_words"))

    def phrases(self) -> DataFrame:
        """win_id, doc_id, h, start, len: every occurrence of every window."""
        term = lambda k, what: F.try_element_at("terms", F.lit(k))[what]
        rarest = self.windows.select("win_id", F.size("win").alias("len"), term(1, "term").alias("term"), term(1, "off").alias("off"), term(2, "term").alias("term2"), term(2, "off").alias("off2"))
        begun = self.short.join(rarest, "term").where("at >= off")
        here = lambda word, place: F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col(word) == F.col("word")) & (F.col(place) == F.col("place"))
        # a row is sent with the place where the second term must stand; the beginning follows from it
        sent = begun.where("len > 1").select("win_id", "doc_id", "h", F.expr("at - off + off2").alias("second"), "term2")
        met = sent.join(named(self.short), here("term2", "second"), "left_semi").join(rarest.select("win_id", "off2", "len"), "win_id").select("win_id", "doc_id", "h", F.expr("second - off2").alias("start"), "len")
        both = met.unionByName(begun.where("len = 1").select("win_id", "doc_id", "h", F.expr("at - off").alias("start"), "len"))
        two = stored(both.distinct(), "decontamination-two-terms")
        others = self.windows.select("win_id", F.explode(F.expr("slice(terms, 3, size(terms))")).alias("t")).select("win_id", "t.off", "t.term")
        left = stored(two.select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct(), "decontamination-left")
        lists = named(self.lists().join(left, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_semi"))
        more = two.where("len > 2").join(others, "win_id").withColumn("wanted", F.expr("start + off")).join(lists, here("term", "wanted"), "left_semi")
        whole = more.groupBy("win_id", "doc_id", "h", "start", "len").agg(F.count("*").alias("n")).where("n = len - 2").drop("n")
        return whole.unionByName(two.where("len <= 2"))

    def near(self, width: int = NEAR) -> DataFrame:
        """doc_id, h, item_id: items of which some window's two rarest terms, unlike each other, stand at most `width` words apart.

        Places are cut into stretches of `width` words; the second term is
        looked for in the first one's stretch and both neighbours.
        """
        two = self.windows.where("size(terms) > 1").select("win", F.col("terms")[0]["term"].alias("term"), F.col("terms")[1]["term"].alias("term2")).where("term != term2")
        pairs = stored(two.join(self.items, "win").select("item_id", "term", "term2").distinct(), "decontamination-pairs")
        only = pairs.select("term", "term2").distinct()
        cut = lambda c: F.floor(F.col(c) / width).cast("int")
        a = self.short.join(only, "term").withColumn("cut", F.explode(F.array(*(cut("at") + k for k in (-1, 0, 1)))))
        b = named(self.short).withColumn("cut2", cut("place"))
        on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("cut") == F.col("cut2")) & (F.col("term2") == F.col("word")) & (F.abs(F.col("at") - F.col("place")) <= width)
        met = a.join(b, on, "left_semi").select("doc_id", "h", "term", "term2").distinct()
        return met.join(pairs, ["term", "term2"]).select("doc_id", "h", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a proximity match) of every document."""
    index = Index(docs, benchmark, size)
    found = stored(index.phrases(), "decontamination-phrases")
    # the words hit are the union of [start, start + len): ordered by start, each adds what reaches past those before
    spans = F.array_sort(F.collect_set(F.struct("start", F.expr("start + len").alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    union = F.aggregate("spans", zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")))
    hit = found.groupBy("doc_id", "h").agg(spans.alias("spans")).select("doc_id", "h", union["n"].alias("n_hit"))
    named = index.windows.select("win_id", "win").join(index.items, "win").select("win_id", "item_id")
    listed = found.select("win_id", "doc_id", "h").distinct().join(named, "win_id").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    close = index.near().groupBy("doc_id", "h").agg(F.count("*").alias("n_near"))
    out = index.sizes()
    for part in (hit, listed, close):
        part = part.withColumnsRenamed({"doc_id": "d", "h": "g"})
        out = out.join(part, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").drop("d", "g")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", zero("n_hit").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"), zero("n_near").alias("n_near"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    found = Index(docs, benchmark).phrases().select("doc_id", "h").distinct()
    d, g = free(docs, "d"), free(docs, "g")
    found = stored(found.toDF(d, g), "decontamination-found")
    return docs.join(found, docs["doc_id"].eqNullSafe(found[d]) & (text_hash() == found[g]), "left_anti")


def oracle(size: int = WINDOW, near: int = NEAR) -> str:
    """The same in DuckDB."""
    cut = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
    WITH d AS (SELECT doc_id, {cut} AS w FROM documents),
    b AS (SELECT item_id, {cut} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, w[k : k + {size - 1}] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT len(win) AS n FROM win),
    grams AS (SELECT doc_id, n, k, w[k : k + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
    found AS (SELECT doc_id, n, k, item_id FROM grams JOIN win USING (win)),
    hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
    items AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM found GROUP BY doc_id),
    terms AS (SELECT DISTINCT unnest(win) AS term FROM win),
    post AS (SELECT doc_id, term, p FROM (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM d) SEMI JOIN terms USING (term)),
    freq AS (SELECT term, count(*) AS n FROM post GROUP BY term),
    rare AS (SELECT win, list(term ORDER BY n, p) AS t FROM (SELECT win, unnest(win) AS term, unnest(range(0, len(win))) AS p FROM (SELECT DISTINCT win FROM win)) JOIN freq USING (term) GROUP BY win HAVING count(*) = len(win)),
    pairs AS (SELECT DISTINCT item_id, t[1] AS t1, t[2] AS t2 FROM rare JOIN win USING (win) WHERE len(t) > 1 AND t[1] <> t[2]),
    met AS (SELECT DISTINCT x.doc_id, t1, t2 FROM (SELECT DISTINCT t1, t2 FROM pairs) JOIN post x ON x.term = t1 JOIN post y ON y.term = t2 AND y.doc_id = x.doc_id AND abs(x.p - y.p) <= {near}),
    close AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_near FROM met JOIN pairs USING (t1, t2) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN close USING (doc_id)"""
