"""Named queries over the test tables, each with DuckDB SQL where SQL can express it.

The tables hold no DNA. Reads come from `part` (two units with copies by key
and size, so the true pattern is known) and from the letters A, C, G, T of
`documents`; labels come from `events`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import blocks, cover, evaluate, report, seeds, suffixes, units
from strandloom.operators.classes import class_frequencies
from strandloom.operators.decompose import add_haplotypes, decompose, global_units, spread, unit_rows
from strandloom.operators.library import with_library
from strandloom.operators.long_reads import align_long
from strandloom.operators.staged import decompose_staged
from strandloom.operators.texts import by_text
from strandloom.plans import published
from strandloom.plans.options import Options
from strandloom.sources import text as sources
from strandloom.sources.shared import stored

PAIRS = [("AC", "AG"), ("ACC", "GTT"), ("CAG", "CCG"), ("AAAG", "AG"), ("AAG", "AGG"), ("AAAAT", "AG")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, i, j, u, v, seq: (AC)i(AG)j from part."""
    i, j = (F.lit(15) + F.col("p_partkey") % 20).cast("int"), (F.lit(15) + F.col("p_size")).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("read_id"), i.alias("i"), j.alias("j"), F.concat(F.repeat(F.lit("AC"), i), F.repeat(F.lit("AG"), j)).alias("seq"))


MOSAIC = "mosaic AS (SELECT p_partkey AS read_id, (15 + p_partkey % 20)::INTEGER AS i, (15 + p_size)::INTEGER AS j, repeat('AC', (15 + p_partkey % 20)::INTEGER) || repeat('AG', (15 + p_size)::INTEGER) AS seq FROM part)"


TWENTY = "ACGTTGCATTAGGCATCCGA"


def twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq: copies of one unit of 20 bases."""
    return mosaic(spark, sf_dir).select("read_id", F.expr(f"repeat('{TWENTY}', i div 3)").alias("seq"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, pair, i, j, u, v, seq: every part with each of six unit pairs."""
    each = F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in PAIRS))).alias("p")
    own = mosaic(spark, sf_dir).select("read_id", "i", "j", each).select("read_id", "i", "j", "p.u", "p.v")
    return own.select(F.concat_ws(":", F.col("read_id").cast("string"), "u", "v").alias("read_id"), "i", "j", "u", "v", F.concat(F.expr("repeat(u, i)"), F.expr("repeat(v, j)")).alias("seq"))


PAIR_SQL = "pairs AS (SELECT read_id::VARCHAR || ':' || u || ':' || v AS read_id, i, j, u, v FROM mosaic, (VALUES " + ", ".join(f"('{u}', '{v}')" for u, v in PAIRS) + ") AS p(u, v))"


def small_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, k, unit: a stretch of 2 to 8 bases of each read."""
    unit = F.substring("seq", (F.col("read_id") % 30 + 1).cast("int"), (F.col("read_id") % 7 + 2).cast("int"))
    return mosaic(spark, sf_dir).select("read_id", (F.col("read_id") % 2).cast("int").alias("k"), unit.alias("unit"))


UNITS = MOSAIC + ", units AS (SELECT read_id, (read_id % 2)::INTEGER AS k, substr(seq, read_id % 30 + 1, read_id % 7 + 2) AS unit FROM mosaic)"
CANON = "list_min([substr(unit, k + 1) || substr(unit, 1, k) for k in range(0, length(unit))])"
UNBORDERED = "(length(unit) = 1 OR NOT list_bool_or([left(unit, b) = right(unit, b) for b in range(1, length(unit))]))"
SUBS = "subs AS (SELECT read_id, p AS pos, substr(seq, p, n) AS unit FROM (SELECT read_id, seq, n, unnest(range(1, length(seq) - n + 2)) AS p FROM (SELECT read_id, seq, unnest(range(2, 21)) AS n FROM mosaic) WHERE length(seq) >= n))"
CANDS = f"{MOSAIC}, {SUBS}, cands AS (SELECT read_id, unit, n_occ FROM (SELECT read_id, unit, count(*) AS n_occ FROM subs GROUP BY ALL) WHERE n_occ >= 2 AND {UNBORDERED})"
ALL = f"alls AS (SELECT DISTINCT {CANON} AS canon FROM (SELECT DISTINCT substr(seq, p, n) AS unit FROM (SELECT seq, n, unnest(range(1, length(seq) - n + 1)) AS p FROM (SELECT seq, unnest(range(1, 20)) AS n FROM mosaic) WHERE length(seq) - 1 >= n)))"
COVER = f"{CANDS}, cover AS (SELECT read_id, unit, count(DISTINCT b) AS covered FROM (SELECT c.read_id, c.unit, unnest(range(p, p + 2 * length(c.unit))) AS b FROM (SELECT cands.read_id, unit, seq, unnest(range(1, length(seq) - 2 * length(unit) + 2)) AS p FROM cands JOIN mosaic USING (read_id)) c WHERE substr(seq, p, 2 * length(c.unit)) = repeat(c.unit, 2)) GROUP BY ALL)"


def of_mosaics(work):
    """A query that gives every mosaic the rows that follow from its text."""
    return lambda spark, sf: by_text(mosaic(spark, sf).select("read_id", "seq"), work)


def covered(texts):
    return units.exact_coverage(texts, stored(units.candidate_units(texts), "candidates"))


def with_bases(texts):
    return covered(texts).withColumnRenamed("covered", "bases").join(texts.select("read_id", F.length("seq").alias("n")).hint("merge"), "read_id")


def labels(spark, sf):
    """read_id (user), pos, label of every event in order."""
    e = table(spark, sf, "events")
    code = F.array_position(F.array(*(F.lit(x) for x in ("click", "error", "purchase", "signup", "view"))), F.col("event_type")).cast("int") - 1
    return e.select(F.col("user_id").alias("read_id"), F.struct("ts", "event_id").alias("pos"), code.alias("label"))


def placed(spark, sf):
    """Labels of each user in order."""
    return labels(spark, sf).groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels"))


def label_runs(spark, sf):
    w = Window.partitionBy("read_id").orderBy("pos")
    return blocks.runs(labels(spark, sf).withColumn("pos", F.row_number().over(w) - 1))


PLACED = "ev AS (SELECT user_id AS read_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS pos, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::INTEGER AS label FROM events)"
RUNS = f"{PLACED}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id, label ORDER BY pos) AS grp FROM ev), runs AS (SELECT read_id, label, min(pos) AS \"start\", max(pos) AS \"end\", count(*) AS len FROM g GROUP BY read_id, label, grp)"

DECOMP = "u AS (SELECT read_id, i, j, '(' || 0 || ',' || CASE WHEN i >= j THEN 'AC,2,' || 2 * i || ',' || 2 * i ELSE 'AG,2,' || 2 * j || ',' || 2 * j END || ') (1,' || CASE WHEN i >= j THEN 'AG,2,' || 2 * j || ',' || 2 * j ELSE 'AC,2,' || 2 * i || ',' || 2 * i END || ')' AS t FROM mosaic)"


def smoothed_sql(rounds: int) -> str:
    """The vote as a join of each place with its window, once per round."""
    whole = "least(41, greatest(11, n // 5 + (n // 5 + 1) % 2))"
    out = f"WITH {PLACED}, sizes AS (SELECT read_id, count(*) AS n FROM ev GROUP BY ALL), l0 AS (SELECT read_id, pos, label FROM ev)"
    out += f", near AS (SELECT read_id, pos, greatest(0, least(pos - {whole} // 2, n - least({whole}, n))) AS a, least({whole}, n) AS w FROM ev JOIN sizes USING (read_id))"
    for k in range(1, rounds + 1):
        out += f", w{k} AS (SELECT near.read_id, near.pos, l.label, count(*) AS c FROM near JOIN l{k - 1} l ON l.read_id = near.read_id AND l.pos >= a AND l.pos < a + w GROUP BY ALL)"
        out += f", l{k} AS (SELECT read_id, pos, label FROM (SELECT *, row_number() OVER (PARTITION BY read_id, pos ORDER BY c DESC, label) AS r FROM w{k}) WHERE r = 1)"
    return out + f" SELECT read_id, pos, label FROM l{rounds}"


def smoothed(rounds):
    return lambda s, d: blocks.smooth(placed(s, d), rounds).select("read_id", F.posexplode("labels").alias("pos", "label"))


def results(spark, sf, opts=Options()):  # noqa: B008
    return decompose(mosaic(spark, sf).select("read_id", "seq"), opts)


def annotated(spark, sf):
    """Results with all columns that the text forms need."""
    own = mosaic(spark, sf)
    more = own.select("read_id", F.col("read_id").alias("read_ord"), "seq", F.lit(1).alias("group_size"), F.concat(F.lit("s"), (F.col("read_id") % 7).cast("string")).alias("sample_id"), F.concat(F.lit("read"), F.col("read_id").cast("string")).alias("read_name"))
    return results(spark, sf).join(more, "read_id").withColumn("header", F.col("read_name"))


def held(spark, sf):
    """The same from a table, for text forms that read results more than once."""
    return stored(annotated(spark, sf), "annotated")


def unit_summary(spark, sf):
    own = held(spark, sf)
    return report.unit_summary(own, global_units(own))


def haplotypes(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string")).alias("sample_id"), (F.col("s_suppkey") % 50).cast("int").alias("read_no"), F.concat_ws("|", F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + 100).cast("string")).alias("pair_haps"), F.col("s_suppkey").alias("ord"))


def haplotype_left_join(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("read_id"), F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string")).alias("sample_id"), F.concat(F.lit("read"), F.col("p_partkey").cast("string")).alias("read_name"))
    return add_haplotypes(p, haplotypes(spark, sf)).select("read_id", "sample_id", "read_name", "hap")


def scored(spark, sf):
    """Truth and a prediction of known distance from it, by tool."""
    own = mosaic(spark, sf)
    block = lambda u, n: F.struct(F.lit(u).alias("unit"), n.cast("int").alias("copies"))
    tools = F.explode(F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(k).alias("k")) for k, t in enumerate(("a", "b", "c"))))).alias("t")
    wrong = F.col("read_id") % 5
    return own.select("read_id", "seq", "i", "j", tools).select(
        F.concat(F.lit("d"), (F.col("read_id") % 3).cast("string")).alias("dataset"), "t.tool", F.length("seq").alias("seq_len"),
        F.array(block("AC", F.col("i")), block("AG", F.col("j"))).alias("truth"),
        F.array(block("CA", F.col("i") + wrong * F.col("t.k")), block("GA", F.col("j"))).alias("pred"),
    )


ALLOWANCES = [0.0, 0.01, 0.02, 0.03, 0.1]
SCORES = f"{MOSAIC}, scores AS (SELECT 'd' || (read_id % 3) AS dataset, tool, allowance, count(*) FILTER (WHERE (read_id % 5) * k <= ceil((i + (read_id % 5) * k) * allowance) + 1) AS hits, count(*) AS total, avg(length(seq)) AS avg_len FROM mosaic, (VALUES ('a', 0), ('b', 1), ('c', 2)) t(tool, k), (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALLOWANCES)}) x(allowance) GROUP BY ALL)"


def noisy(spark, sf, error=0.05):
    """Mosaic reads whose bases err by a hash of read and place."""
    own = spread(mosaic(spark, sf).select("read_id", "seq"))
    hit = lambda p: F.pmod(F.col("read_id") * 104729 + p * 7919, F.lit(10000)) < int(error * 10000)
    return own.withColumn("seq", F.array_join(F.transform(F.split("seq", ""), lambda c, p: F.when(hit(p), F.translate(c, "ACGT", "CGTA")).otherwise(c)), ""))


LONG_UNIT = "ACGGTTACCATGCAATCGGATTC"


def long_reads(spark, sf):
    """read_id, seq: 4 to 11 copies of a long unit, of which each has one base replaced."""
    k = F.col("p_partkey")
    one = F.transform(F.sequence(F.lit(1), (k % 8 + 4).cast("int")), lambda c: F.overlay(F.lit(LONG_UNIT), F.lit("A"), ((k + c * 5) % len(LONG_UNIT) + 1).cast("int")))
    return table(spark, sf, "part").select(k.alias("read_id"), F.array_join(one, "").alias("seq"))


def long_exact(spark, sf):
    """read_id, seq: 4 to 11 exact copies of the long unit; a seed of three bases and the whole copies after it are covered."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("read_id"), F.expr(f"repeat('{LONG_UNIT}', cast(p_partkey % 8 + 4 AS int))").alias("seq"))


def erring_copies(spark, sf):
    """read_id, seq: 4 to 11 copies of the long unit, in each of which the same 0 to 8 bases from the 13th on are replaced; 7 are tolerated."""
    e = (F.col("p_partkey") % 9).cast("int")
    copy = F.concat(F.lit(LONG_UNIT[:12]), F.translate(F.substring(F.lit(LONG_UNIT), F.lit(13), e), "ACGT", "CGTA"), F.substring(F.lit(LONG_UNIT), e + 13, F.lit(24)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("read_id"), F.repeat(copy, (F.col("p_partkey") % 8 + 4).cast("int")).alias("seq"))


def unit_library(spark, sf):
    """unit: one of 24 bases of each supplier, and the long unit."""
    made = F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 24), "0123456789abcdef", "ACGTACGTACGTACGT")
    return table(spark, sf, "supplier").select(made.alias("unit")).unionByName(table(spark, sf, "region").select(F.lit(LONG_UNIT).alias("unit")))


def long_unit_seeds(spark, sf):
    """read_id, unit, reps, a, b: where units of the library cover a read, those at two repetitions, or at one where none covers it at two."""
    reads = erring_copies(spark, sf)
    index = seeds.seed_index(unit_library(spark, sf))
    found = by_text(reads, lambda t: seeds.most_repeated(seeds.laid(t, seeds.diagonals(t, index))).select("read_id", "unit", "reps", "spans"))
    return found.select("read_id", "unit", "reps", F.inline("spans"))


def beside_taken(spark, sf):
    """read_id, unit, covered, explained of two units when the copies of AC are taken."""
    own = mosaic(spark, sf)
    pairs = own.select("read_id", F.explode(F.array(F.lit("CA"), F.lit("AG"), F.lit("GA"))).alias("unit"))
    taken = own.select("read_id", F.array(F.struct(F.lit(0).alias("a"), (2 * F.col("i")).cast("int").alias("b"))).alias("taken"))
    return cover.explained(cover.unit_spans(own, pairs).join(taken, "read_id"), taken="taken").select("read_id", "unit", "covered", "explained")


def key_units(spark, sf):
    chosen = by_text(mosaic(spark, sf).select("read_id", "seq"), lambda t: cover.key_units(t, suffixes.candidate_units(t)))
    return chosen.select("read_id", F.array_join("chosen", ",").alias("chosen"))


def long_alignment(spark, sf):
    """Runs of labels of one read a brand, all its mosaics in a row."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("read_id"), "p_brand")
    own = mosaic(spark, sf).join(part, "read_id").groupBy(F.col("p_brand").alias("read_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("read_id").alias("k"), "seq"))), lambda x: x["seq"]), "").alias("seq"))
    reads = stored(own, "long-reads")
    given = reads.select("read_id", F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.lit(u).alias("unit")) for k, u in enumerate(("AC", "AG"))))).alias("u")).select("read_id", "u.label", "u.unit")
    return align_long(reads, given, 2_000)


def some_clean(spark, sf):
    """read_id, seq: copies of one unit of 20 bases; in every other read each copy has one base replaced."""
    k = F.col("read_id")
    one = F.transform(F.sequence(F.lit(1), (F.col("i") / 3).cast("int")), lambda c: F.overlay(F.lit(TWENTY), F.lit("A"), ((k + c * 7) % 20 + 1).cast("int")))
    return mosaic(spark, sf).select("read_id", F.when(k % 2 == 0, F.expr(f"repeat('{TWENTY}', i div 3)")).otherwise(F.array_join(one, "")).alias("seq"))


def one_error(spark, sf):
    """read_id, seq: a T for a base, a T before it, or the base after it left out, in the middle of the first unit's copies."""
    cut = "i div 2 * 2"
    seq = F.expr(f"CASE read_id % 3 WHEN 0 THEN overlay(seq placing 'T' from {cut} + 1) WHEN 1 THEN concat(left(seq, {cut}), 'T', substring(seq, {cut} + 1)) ELSE concat(left(seq, {cut} + 1), substring(seq, {cut} + 3)) END")
    return mosaic(spark, sf).select("read_id", seq.alias("seq"))


def qualification(spark, sf):
    """read_id, seq: reads without a unit, with a unit that occurs twice but not in a row, and with one in a row."""
    seq = F.expr("CASE read_id % 3 WHEN 0 THEN repeat('A', i) WHEN 1 THEN 'ACGTGGCCACGT' ELSE repeat('AC', i) END")
    return mosaic(spark, sf).select("read_id", seq.alias("seq"))


def two_units(spark, sf):
    return mosaic(spark, sf).select("read_id", F.explode(F.array(F.lit("AC"), F.lit("AG"))).alias("unit"))


def unit_pairs(spark, sf):
    """read_id, kind, a, b: a unit with a rotation of it, with one that has a base replaced, lost, and with another unit."""
    k = (F.col("p_partkey") % 19 + 1).cast("int")
    turned = F.concat(F.expr(f"substring('{TWENTY}', p_partkey % 19 + 2)"), F.expr(f"left('{TWENTY}', p_partkey % 19 + 1)"))
    kinds = {"turned": turned, "replaced": F.overlay(turned, F.lit("T"), k), "lost": F.concat(F.lit(TWENTY[:7]), F.lit(TWENTY[8:])), "other": F.lit("A" * 20), "longer": F.lit(TWENTY * 2)}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), c.alias("b")) for n, c in kinds.items())))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("read_id"), F.lit(TWENTY).alias("a"), each.alias("x")).select("read_id", "x.kind", "a", "x.b")


def haplotype_lines(spark, sf):
    k = F.col("s_suppkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("s"), k.cast("string"))).when(k % 5 == 1, F.lit(" ")).otherwise(F.concat(F.lit("  s"), k.cast("string"), F.lit("\t "), (k % 50).cast("string"), F.lit("  "), k.cast("string"), F.lit("|1")))
    return table(spark, sf, "supplier").select(line.alias("value"), k.alias("ord"))


def annotated_headers(spark, sf):
    """Headers as the annotated FASTA has them; the second block is off by the key modulo 4, and records of units follow."""
    text = F.format_string("#Info (%d,1,0.000) #Pat <CA>%d<AG>%d #Annotation (AC)%d(AG)%d", F.length("seq"), "i", F.col("j") + (F.col("read_id") % 4).cast("int"), "i", "j")
    return mosaic(spark, sf).select(F.when(F.col("read_id") % 9 == 0, F.lit("frequent unit. freq. = 3")).otherwise(F.concat(F.col("read_id").cast("string"), F.lit(" "), text)).alias("header"))


def repeatmasker_hits(spark, sf):
    """Hits of reads that are named by their pattern: two of each, in any order; the second is off by the key modulo 7, and missing where that is 6."""
    name = F.format_string("(AC)%d(AG)%d_%d", "i", "j", "read_id")
    off = (F.col("read_id") % 7).cast("int")
    hits = F.array(F.struct((2 * F.col("i") + 1).alias("begin"), F.lit("GA").alias("unit"), (2 * (F.col("j") + off)).alias("len")), F.struct(F.lit(1).alias("begin"), F.lit("AC").alias("unit"), (2 * F.col("i") + 1).alias("len")))
    return mosaic(spark, sf).select(name.alias("id"), off.alias("off"), F.inline(hits)).where("off != 6 or unit = 'AC'")


def trf_texts(spark, sf):
    """Records of TRF's compact output: no hits, one hit, two, or two with a long consensus."""
    hit = "concat('\n1 90 2 ', {n}, '.7 {c} 95 0 100 50 50 0 0 1.0 {u} {u}{u}')"
    ac, ag, far = hit.format(n="i", c=2, u="AC"), hit.format(n="j + read_id % 7", c=2, u="GA"), hit.format(n="j", c=200, u="AG")
    text = F.expr(f"concat(' (AC)', i, '(AG)', j, CASE read_id % 4 WHEN 0 THEN '' WHEN 1 THEN {ac} WHEN 2 THEN concat({ac}, {far}) ELSE concat({ac}, {far}, {ag}, '\n') END)")
    return mosaic(spark, sf).select(F.col("read_id").alias("record"), text.alias("value"))


def headers(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    text = F.format_string("GroupSize = %d, Diameter = %d, RadiusFromCentroid = %d, CentroidReadName = s%d,read%d, CentroidReadLength = %d", k % 9 + 1, k % 5, k % 4, k % 7, k, k % 300 + 10)
    return c.select(k.alias("key"), F.when(k % 3 == 0, F.concat(F.lit("plain "), k.cast("string"))).otherwise(text).alias("header"))


def fasta_lines(spark, sf):
    """Records in the text form that the reader gets, built from documents."""
    d = table(spark, sf, "documents")
    letters = d.select("doc_id", F.explode(F.array(F.regexp_replace("text", "[^ACGTacgt]", ""))).alias("s"))
    return letters.select(F.expr("concat('> doc ', doc_id, ' pattern=<A>1\r\n', left(s, length(s) div 2), '\n', substring(s, length(s) div 2 + 1), '\n')").alias("value"))


def repeatmasker_lines(spark, sf):
    k = F.col("p_partkey")
    line = F.format_string("  %d 1.0 0.0 0.0 read%d %d %d (%d) + (%s)n Simple_repeat 1 2 (0) %d", k + 10, k, k % 9 + 1, k % 9 + 40, k % 13, F.when(k % 4 == 0, F.lit("A")).otherwise(F.lit("AC")), k)
    return table(spark, sf, "part").select(line.alias("value"))


def trf_lines(spark, sf):
    k = F.col("p_partkey")
    hit = F.format_string("%d %d 2 %d.5 %d 95 0 100 50 50 0 0 1.0 AC ACAC", k % 9 + 1, k % 9 + 40, k % 20 + 2, F.when(k % 10 == 0, 250).otherwise(2))
    lines = F.array(F.struct((k * 2).alias("ord"), F.format_string("@ (AC)%d", k % 20).alias("value")), F.struct((k * 2 + 1).alias("ord"), hit.alias("value")))
    return table(spark, sf, "part").select((k % 16).alias("file"), F.inline(lines))


def draw_sql(x: str, what: int) -> str:
    """The simulator's draw in DuckDB."""
    y = f"(({x}) % {sources.PRIME} + {what * 15_485_863}) % {sources.PRIME}"
    for _ in range(2):
        y = f"list_transform([{y}], lambda y: (y * y % {sources.PRIME} * 48271 + y + 12345) % {sources.PRIME})[1]"
    return y


def errors_sql(error: float) -> str:
    """The simulator's errors on seq in DuckDB."""
    at = "read_id * 1000003 + (p - 1) * 7919 + 42"
    other = f"substr(replace('ACGT', c, ''), {draw_sql(at, 102)} % 3 + 1, 1)"
    new = f"substr('ACGT', {draw_sql(at, 103)} % 4 + 1, 1)"
    one = f"CASE WHEN {draw_sql(at, 100)} % 1000000 >= {round(error * 1_000_000)} THEN c WHEN {draw_sql(at, 101)} % 3 = 0 THEN c || {new} WHEN {draw_sql(at, 101)} % 3 = 1 THEN '' ELSE {other} END"
    return f"array_to_string(list_transform(string_split(seq, ''), lambda c, p: {one}), '')"


QUERIES = {
    "canon_rotation": lambda s, d: small_units(s, d).select("read_id", "unit", dna.canon(F.col("unit")).alias("canon")),
    "rotate_k": lambda s, d: small_units(s, d).select("read_id", dna.rotate(F.col("unit"), F.col("k")).alias("rotated")),
    "same_unit": lambda s, d: small_units(s, d).select("read_id", dna.same_unit(F.col("unit"), dna.rotate(F.col("unit"), 1)).alias("rotation"), dna.same_unit(F.col("unit"), F.reverse("unit")).alias("reversed")),
    "unbordered": lambda s, d: small_units(s, d).select("read_id", dna.unbordered(F.col("unit")).alias("ok")),
    "base_codes": lambda s, d: mosaic(s, d).select("read_id", dna.base_codes(F.col("seq")).alias("codes"), dna.window_length(F.length("seq")).alias("window")),
    "capitalize_filter": lambda s, d: table(s, d, "documents").select("doc_id", dna.valid(F.col("text")).alias("ok"), dna.clean(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("seq")),
    "header_parse": lambda s, d: headers(s, d).select("key", *(c.alias(n) for n, c in dna.parse_header(F.col("header")).items())),
    "pattern_parse": lambda s, d: mosaic(s, d).select("read_id", F.format_string("(AC)%d(AG)%d", "i", "j").alias("t")).select("read_id", F.posexplode(dna.parse_pattern(F.col("t"))).alias("pos", "b")).select("read_id", "pos", "b.unit", "b.copies"),
    "tag_parse": lambda s, d: mosaic(s, d).select("read_id", F.format_string("#Info (1,1,0.1) #Pat <AC>%d<AG>%d #Hap <x>", "i", "j").alias("h")).select("read_id", dna.tag(F.col("h"), "Pat").alias("pat"), dna.tag(F.col("h"), "Locus").alias("locus")),
    "trim_dup": lambda s, d: table(s, d, "part").select("p_partkey", dna.trim_suffix(F.concat_ws("_", "p_brand", F.col("p_size").cast("string"))).alias("name")),
    "fasta_records": lambda s, d: sources.records(fasta_lines(s, d)),
    "candidate_units": of_mosaics(units.candidate_units),
    "suffix_candidates": of_mosaics(suffixes.candidate_units),
    "suffix_array": of_mosaics(suffixes.suffix_array),
    "candidate_units_canon": of_mosaics(lambda t: units.canonical_units(units.candidate_units(t))),
    "all_substrings": lambda s, d: units.all_substrings(mosaic(s, d).select("read_id", "seq")),
    "compression_ratio": lambda s, d: units.compression(mosaic(s, d).select("read_id", "seq")),
    "exact_coverage": of_mosaics(covered),
    "unit_penalty_top5": of_mosaics(lambda t: units.top_units(t, covered(t))),
    "rank_units_by_bases": of_mosaics(lambda t: units.rank_by_bases(with_bases(t))),
    "prune_95": of_mosaics(lambda t: units.prune(with_bases(t))),
    "run_length_blocks": label_runs,
    "raw_run_merge": lambda s, d: blocks.merge_raw(label_runs(s, d).withColumn("unit_len", F.lit(1))),
    "smooth_majority": smoothed(1),
    "smooth_twice": smoothed(2),
    "decompose_mosaic": lambda s, d: results(s, d).select("read_id", "pattern", "num_key_units", "min_reps", "mode"),
    "decompose_pairs": lambda s, d: decompose(pairs(s, d).select("read_id", "seq")).select("read_id", "pattern"),
    "decompose_ratio": lambda s, d: results(s, d).select("read_id", "seq_len", "mismatch_ratio", "deletion_ratio", "insertion_ratio", "discrepancy_ratio", "clipped_ratio"),
    "decompose_units": lambda s, d: unit_rows(results(s, d)).select("read_id", "unit", "len", "bases", "tandem_bases"),
    "decompose_blocks": lambda s, d: results(s, d).select("read_id", F.inline("blocks")),
    "global_units": lambda s, d: global_units(results(s, d)),
    "haplotype_count": lambda s, d: report.summary(results(s, d)),
    "report_table": lambda s, d: report.table_text(annotated(s, d)),
    "report_fasta": lambda s, d: report.fasta_text(annotated(s, d), with_ids=True, decomp=False),
    "pattern_statistics": lambda s, d: report.pattern_statistics(held(s, d), with_ids=True),
    "unit_summary": unit_summary,
    "unit_records": lambda s, d: report.unit_records(global_units(results(s, d)), "chr1"),
    "decompose_user_unit": lambda s, d: decompose(long_reads(s, d), Options(units=(LONG_UNIT,))).select("read_id", "pattern", "num_key_units"),
    "decompose_library": lambda s, d: with_library(some_clean(s, d)).select("read_id", "pattern"),
    "decompose_one_error": lambda s, d: decompose(one_error(s, d)).select("read_id", "pattern", "mismatch_ratio", "insertion_ratio", "deletion_ratio"),
    "decompose_twenty": lambda s, d: decompose(twenty(s, d).select("read_id", "seq")).select("read_id", "pattern"),
    "fallback_reps1": lambda s, d: decompose(qualification(s, d)).select("read_id", "min_reps", "pattern"),
    "base_labels": lambda s, d: units.base_labels(results(s, d, Options(labels=True))),
    "explained_bases": lambda s, d: units.explained_bases(mosaic(s, d).select("read_id", "seq"), two_units(s, d)),
    "beside_taken": beside_taken,
    "key_units": key_units,
    "long_alignment": long_alignment,
    "long_unit_seeds": long_unit_seeds,
    "long_unit_coverage": lambda s, d: units.explained_bases(long_exact(s, d), table(s, d, "part").select(F.col("p_partkey").alias("read_id"), F.lit(LONG_UNIT).alias("unit"))),
    "banded_align_match": lambda s, d: units.similar_units(unit_pairs(s, d)).select("read_id", "kind", "similar"),
    "class_frequencies": lambda s, d: class_frequencies(unit_pairs(s, d).select("read_id", F.col("b").alias("unit"))),
    "haplotype_lines": lambda s, d: sources.parse_haplotypes(haplotype_lines(s, d)),
    "annotated_score": lambda s, d: evaluate.verdicts(evaluate.annotated_patterns(annotated_headers(s, d)), 0.0).select("header", "verdict"),
    "repeatmasker_score": lambda s, d: evaluate.verdict_lines(evaluate.verdicts(evaluate.named_patterns(repeatmasker_hits(s, d)), 0.1, "truth")),
    "trf_score": lambda s, d: evaluate.totals(evaluate.verdicts(evaluate.record_patterns(sources.trf_records(trf_texts(s, d))), 0.1, "truth")),
    "noisy_reads": lambda s, d: sources.with_errors(spread(mosaic(s, d).select("read_id", "seq")), 0.15),
    "haplotype_left_join": haplotype_left_join,
    "accuracy_with_allowance": lambda s, d: evaluate.accuracy(scored(s, d), ["dataset", "tool"], ALLOWANCES),
    "tool_comparison_pivot": lambda s, d: evaluate.compare_tools(evaluate.accuracy(scored(s, d), ["dataset", "tool"], ALLOWANCES), ["a", "b", "c"]),
    "repeatmasker_parse": lambda s, d: sources.parse_repeatmasker(repeatmasker_lines(s, d)),
    "trf_parse": lambda s, d: sources.parse_trf(trf_lines(s, d), part="file"),
    "decompose_noisy": lambda s, d: decompose(noisy(s, d)).select("read_id", "pattern", "discrepancy_ratio"),
    "decompose_complex": lambda s, d: decompose(noisy(s, d), Options(smooth=False)).select("read_id", "pattern", "discrepancy_ratio"),
    "decompose_long": lambda s, d: decompose(noisy(s, d), Options(long_mode=True)).select("read_id", "pattern", "mode", "discrepancy_ratio"),
    "simulate_copies": lambda s, d: sources.mosaics(table(s, d, "customer").select(F.col("c_custkey").alias("read_id")), ["AC", "AGG"], error=0.05),
    "decompose_staged": lambda s, d: decompose_staged(mosaic(s, d).select("read_id", "seq")).select("read_id", "pattern", "num_key_units", "min_reps", "mode"),
    "staged_one_error": lambda s, d: decompose_staged(one_error(s, d)).select("read_id", "pattern", "mismatch_ratio", "insertion_ratio", "deletion_ratio"),
    "staged_fallback": lambda s, d: decompose_staged(qualification(s, d)).select("read_id", "min_reps", "pattern"),
    **published.QUERIES,
}

ORACLES = {
    "canon_rotation": f"WITH {UNITS} SELECT read_id, unit, {CANON} AS canon FROM units",
    "rotate_k": f"WITH {UNITS} SELECT read_id, substr(unit, k + 1) || substr(unit, 1, k) AS rotated FROM units",
    "same_unit": f"WITH {UNITS} SELECT read_id, TRUE AS rotation, contains(reverse(unit) || reverse(unit), unit) AS reversed FROM units",
    "unbordered": f"WITH {UNITS} SELECT read_id, {UNBORDERED} AS ok FROM units",
    "base_codes": f"WITH {MOSAIC} SELECT read_id, translate(seq, 'ACGT', '1234') AS codes, least(41, greatest(11, length(seq) // 5 + (length(seq) // 5 + 1) % 2))::INTEGER AS \"window\" FROM mosaic",
    "capitalize_filter": "SELECT doc_id, regexp_full_match(text, '[ACGTacgt]*') AS ok, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents",
    "header_parse": "SELECT c_custkey AS key, CASE WHEN p THEN 1 ELSE k % 9 + 1 END::INTEGER AS group_size, CASE WHEN p THEN NULL ELSE k % 5 END::INTEGER AS diameter, CASE WHEN p THEN NULL ELSE k % 4 END::INTEGER AS radius, CASE WHEN p THEN 'NA' ELSE 's' || (k % 7) END AS sample_id, CASE WHEN p THEN 'NA' ELSE 'read' || k END AS read_name, CASE WHEN p THEN NULL ELSE k % 300 + 10 END::INTEGER AS centroid_len FROM (SELECT c_custkey, c_custkey AS k, c_custkey % 3 = 0 AS p FROM customer)",
    "pattern_parse": f"WITH {MOSAIC} SELECT read_id, 0 AS pos, 'AC' AS unit, i AS copies FROM mosaic UNION ALL SELECT read_id, 1, 'AG', j FROM mosaic",
    "tag_parse": f"WITH {MOSAIC} SELECT read_id, '<AC>' || i || '<AG>' || j AS pat, NULL::VARCHAR AS locus FROM mosaic",
    "trim_dup": "SELECT p_partkey, split_part(p_brand || '_' || p_size, '_', 1) AS name FROM part",
    "fasta_records": "SELECT 'doc ' || doc_id || ' pattern=<A>1' AS header, seq FROM (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents) WHERE seq <> ''",
    "candidate_units": f"WITH {CANDS} SELECT * FROM cands",
    "suffix_candidates": f"WITH {CANDS} SELECT * FROM cands",
    "suffix_array": f"WITH {MOSAIC} SELECT read_id, pos::INTEGER AS pos, (row_number() OVER (PARTITION BY read_id ORDER BY substr(seq, pos)) - 1)::INTEGER AS place FROM (SELECT read_id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM mosaic)",
    "candidate_units_canon": f"WITH {CANDS} SELECT read_id, {CANON} AS canon, min(unit) AS unit FROM cands GROUP BY ALL",
    "all_substrings": f"WITH {MOSAIC}, {ALL} SELECT canon FROM alls",
    "compression_ratio": f"WITH {CANDS}, {ALL} SELECT a AS units, b AS substrings, a / b AS ratio FROM (SELECT (SELECT count(DISTINCT {CANON}) FROM cands) AS a, (SELECT count(*) FROM alls) AS b)",
    "exact_coverage": f"WITH {COVER} SELECT * FROM cover",
    "unit_penalty_top5": f"WITH {COVER}, p AS (SELECT read_id, unit, covered, (length(unit) + covered // length(unit) + length(seq) - covered)::BIGINT AS penalty FROM cover JOIN mosaic USING (read_id)) SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY read_id ORDER BY penalty, length(unit), unit) - 1)::INTEGER AS prio FROM p) WHERE prio < 5",
    "rank_units_by_bases": f"WITH {COVER} SELECT read_id, unit, covered AS bases, (row_number() OVER (PARTITION BY read_id ORDER BY covered DESC, unit) - 1)::INTEGER AS prio FROM cover",
    "prune_95": f"WITH {COVER} SELECT read_id, unit, bases FROM (SELECT read_id, unit, covered AS bases, length(seq) AS n, coalesce(sum(covered) OVER (PARTITION BY read_id ORDER BY covered DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cover JOIN mosaic USING (read_id)) WHERE before <= n * 0.95",
    "run_length_blocks": f"WITH {RUNS} SELECT read_id, label, \"start\", \"end\", len FROM runs",
    "raw_run_merge": f"WITH {RUNS}, m AS (SELECT *, len >= 2 AS is_tandem FROM runs), n AS (SELECT *, CASE WHEN is_tandem OR coalesce(lag(is_tandem) OVER (PARTITION BY read_id ORDER BY \"start\"), TRUE) THEN 1 ELSE 0 END AS nw FROM m), o AS (SELECT *, sum(nw) OVER (PARTITION BY read_id ORDER BY \"start\") AS b FROM n) SELECT read_id, is_tandem, min(\"start\") AS \"start\", max(\"end\") AS \"end\", sum(len)::BIGINT AS len, count(*) AS n_runs FROM o GROUP BY read_id, b, is_tandem",
    "smooth_majority": smoothed_sql(1),
    "smooth_twice": smoothed_sql(2),
    "decompose_mosaic": f"WITH {MOSAIC} SELECT read_id, '<AC>' || i || '<AG>' || j AS pattern, 2 AS num_key_units, 2 AS min_reps, 'short' AS mode FROM mosaic",
    "decompose_pairs": f"WITH {MOSAIC}, {PAIR_SQL} SELECT read_id, '<' || u || '>' || i || '<' || v || '>' || j AS pattern FROM pairs",
    "decompose_ratio": f"WITH {MOSAIC} SELECT read_id, (2 * (i + j))::INTEGER AS seq_len, 0.0::DOUBLE AS mismatch_ratio, 0.0::DOUBLE AS deletion_ratio, 0.0::DOUBLE AS insertion_ratio, 0.0::DOUBLE AS discrepancy_ratio, 0.0::DOUBLE AS clipped_ratio FROM mosaic",
    "decompose_units": f"WITH {MOSAIC} SELECT read_id, 'AC' AS unit, 2 AS len, 2 * i AS bases, 2 * i AS tandem_bases FROM mosaic UNION ALL SELECT read_id, 'AG', 2, 2 * j, 2 * j FROM mosaic",
    "decompose_blocks": f"WITH {MOSAIC} SELECT read_id, 'AC' AS unit, i AS copies, 0 AS \"start\", 2 * i AS \"end\", TRUE AS is_tandem FROM mosaic UNION ALL SELECT read_id, 'AG', j, 2 * i, 2 * (i + j), TRUE FROM mosaic",
    "global_units": "SELECT canon, count(*) AS freq FROM part, (VALUES ('AC'), ('AG')) u(canon) GROUP BY canon",
    "haplotype_count": f"WITH {MOSAIC} SELECT count(*) AS n_haplotypes, sum(2 * (i + j))::BIGINT AS n_bases, sum(2 * (i + j))::BIGINT AS n_tandem, 0.0::DOUBLE AS mean_ratio FROM mosaic",
    "report_table": f"WITH {MOSAIC}, {DECOMP} SELECT read_id AS read_ord, 's' || (read_id % 7) || ',read' || read_id || ' (' || 2 * (i + j) || ',1,2,0.000) [2 ' || t || ']' AS value FROM u",
    "report_fasta": f"WITH {MOSAIC} SELECT read_id AS read_ord, '> #Info (s' || (read_id % 7) || ',read' || read_id || ',' || 2 * (i + j) || ',1,2,0.000) #Pat <AC>' || i || '<AG>' || j || chr(10) || seq AS value FROM mosaic",
    "pattern_statistics": f"WITH {MOSAIC} SELECT 0 AS k, 0::BIGINT AS o, '' AS c, ' #haplotypes=' || count(*) AS value FROM mosaic HAVING count(*) > 0 UNION ALL SELECT 1, read_id, '', '(s' || (read_id % 7) || ',read' || read_id || ',' || 2 * (i + j) || ',1,0.00) <AC>' || i || '<AG>' || j FROM mosaic",
    "unit_summary": f"WITH {MOSAIC}, {DECOMP} SELECT 0 AS k, 0::BIGINT AS o, '' AS c, ' #haplotypes=' || count(*) AS value FROM mosaic UNION ALL SELECT 1, read_id, '', '(s' || (read_id % 7) || ',read' || read_id || ',' || 2 * (i + j) || ',1,2,0.00) [2 ' || t || ']' FROM u UNION ALL SELECT 2, 0, '', '#units=2' UNION ALL SELECT 3, 0, canon, '(' || canon || ',' || count(*) || ')' FROM mosaic, (VALUES ('AC'), ('AG')) v(canon) GROUP BY canon",
    "unit_records": "SELECT canon, '> #Locus chr1 frequent unit. freq. = ' || count(*) || chr(10) || canon AS value FROM part, (VALUES ('AC'), ('AG')) u(canon) GROUP BY canon",
    "decompose_user_unit": f"SELECT p_partkey AS read_id, CASE WHEN p_partkey % 23 = 19 THEN '<{LONG_UNIT[2:] + LONG_UNIT[:2]}>' ELSE '<{LONG_UNIT}>' END || (p_partkey % 8 + 4) AS pattern, 1 AS num_key_units FROM part",
    "decompose_library": f"WITH {MOSAIC} SELECT read_id, '<{TWENTY}>' || (i // 3) AS pattern FROM mosaic",
    "decompose_one_error": f"WITH {MOSAIC} SELECT read_id, '<AC>' || CASE WHEN k = 2 THEN i - 1 ELSE i END || '<AG>' || j AS pattern, CASE WHEN k = 0 THEN 1 / n ELSE 0 END::DOUBLE AS mismatch_ratio, CASE WHEN k = 1 THEN 1 / (n + 1) ELSE 0 END::DOUBLE AS insertion_ratio, CASE WHEN k = 2 THEN 1 / (n - 1) ELSE 0 END::DOUBLE AS deletion_ratio FROM (SELECT *, read_id % 3 AS k, length(seq) AS n FROM mosaic)",
    "fallback_reps1": f"WITH {MOSAIC} SELECT read_id, CASE read_id % 3 WHEN 1 THEN 1 ELSE 2 END AS min_reps, CASE read_id % 3 WHEN 1 THEN '<ACGT>3' ELSE '<AC>' || i END AS pattern FROM mosaic WHERE read_id % 3 <> 0",
    "base_labels": f"WITH {MOSAIC} SELECT read_id, p::INTEGER AS pos, CASE WHEN (p < 2 * i) = (i >= j) THEN 0 ELSE 1 END AS prio FROM (SELECT *, unnest(range(0, length(seq))) AS p FROM mosaic)",
    "explained_bases": f"WITH {MOSAIC} SELECT read_id, 'AC' AS unit, 2 * i AS covered, 2 * i AS explained FROM mosaic UNION ALL SELECT read_id, 'AG', 2 * j, 2 * j FROM mosaic",
    "beside_taken": f"WITH {MOSAIC} SELECT read_id, 'CA' AS unit, 2 * i AS covered, 2 * i AS explained FROM mosaic UNION ALL SELECT read_id, 'AG', 2 * j, 2 * i + 2 * j FROM mosaic UNION ALL SELECT read_id, 'GA', 2 * j - 2, 2 * i + 2 * j - 2 FROM mosaic",
    "key_units": f"WITH {MOSAIC} SELECT read_id, CASE WHEN i >= j THEN 'AC,AG' ELSE 'AG,AC' END AS chosen FROM mosaic",
    "long_alignment": f"WITH {MOSAIC}, m AS (SELECT p_brand AS read_id, p_partkey AS k, i, j, (sum(2 * (i + j)) OVER (PARTITION BY p_brand ORDER BY p_partkey) - 2 * (i + j))::INTEGER AS o FROM mosaic JOIN part ON p_partkey = read_id) SELECT read_id, o AS start, o + 2 * i AS \"end\", 0 AS label FROM m UNION ALL SELECT read_id, o + 2 * i, o + 2 * i + 2 * j, 1 FROM m",
    "long_unit_seeds": f"SELECT p_partkey AS read_id, '{LONG_UNIT}' AS unit, 2 AS reps, 0 AS a, (23 * (p_partkey % 8 + 3) + 3)::INTEGER AS b FROM part WHERE p_partkey % 9 < 8",
    "long_unit_coverage": f"SELECT p_partkey AS read_id, '{LONG_UNIT}' AS unit, (23 * (p_partkey % 8 + 3) + 3)::INTEGER AS covered, (23 * (p_partkey % 8 + 3) + 3)::INTEGER AS explained FROM part",
    "banded_align_match": "SELECT p_partkey AS read_id, kind, kind IN ('turned', 'replaced', 'lost') AS similar FROM part, (VALUES ('turned'), ('replaced'), ('lost'), ('other'), ('longer')) v(kind)",
    "class_frequencies": f"WITH turns AS (SELECT p_partkey AS read_id, p_partkey % 19 AS k, substr('{TWENTY}', p_partkey % 19 + 2) || left('{TWENTY}', p_partkey % 19 + 1) AS t FROM part), own AS (SELECT read_id, 0 AS c, t AS unit FROM turns UNION ALL SELECT read_id, 0, substr(t, 1, k) || 'T' || substr(t, k + 2) FROM turns UNION ALL SELECT read_id, 3, '{TWENTY[:7] + TWENTY[8:]}' FROM turns UNION ALL SELECT read_id, 1, '{'A' * 20}' FROM turns UNION ALL SELECT read_id, 2, '{TWENTY * 2}' FROM turns) SELECT min({CANON}) AS \"class\", count(DISTINCT read_id) AS freq FROM own GROUP BY c",
    "haplotype_lines": "SELECT 's' || k AS sample_id, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 50 END::INTEGER AS read_no, CASE WHEN k % 5 = 0 THEN NULL ELSE k || '|1' END AS pair_haps, k AS ord FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 5 <> 1",
    "annotated_score": f"WITH {MOSAIC} SELECT read_id || ' #Info (' || length(seq) || ',1,0.000) #Pat <CA>' || i || '<AG>' || (j + read_id % 4) || ' #Annotation (AC)' || i || '(AG)' || j AS header, CASE WHEN read_id % 4 <= 1 THEN 'Yes' ELSE 'No' END AS verdict FROM mosaic WHERE read_id % 9 <> 0",
    "repeatmasker_score": f"WITH {MOSAIC} SELECT CASE WHEN read_id % 7 <> 6 AND read_id % 7 <= ceil(j * 0.1) + 1 THEN 'Yes' ELSE 'No' END || chr(9) || 'AC ' || i || ' AG ' || j || chr(9) || 'AC ' || i || CASE WHEN read_id % 7 = 6 THEN '' ELSE ' GA ' || (j + read_id % 7) END AS value FROM mosaic",
    "trf_score": f"WITH {MOSAIC} SELECT count(*) FILTER (WHERE read_id % 4 = 3 AND read_id % 7 <= ceil(j * 0.1) + 1) AS hits, count(*) AS total FROM mosaic",
    "noisy_reads": f"WITH {MOSAIC} SELECT read_id, {errors_sql(0.15)} AS seq FROM mosaic",
    "simulate_copies": f"SELECT read_id, '(AC)' || a || '(AGG)' || b AS header, {errors_sql(0.05)} AS seq FROM (SELECT read_id, a, b, repeat('AC', a::INTEGER) || repeat('AGG', b::INTEGER) AS seq FROM (SELECT read_id, 10 + {draw_sql('read_id * 1009 + 42', 0)} % 190 AS a, 10 + {draw_sql('read_id * 1009 + 42', 1)} % 190 AS b FROM (SELECT c_custkey AS read_id FROM customer)))",
    **published.ORACLES,
    "decompose_twenty": f"WITH {MOSAIC} SELECT read_id, '<{TWENTY}>' || (i // 3) AS pattern FROM mosaic",
    "haplotype_left_join": "WITH h AS (SELECT 's' || (s_suppkey % 7) AS sample_id, s_suppkey % 50 AS read_no, arg_min(s_suppkey || '|' || (s_suppkey + 100), s_suppkey) AS hap FROM supplier GROUP BY ALL) SELECT p_partkey AS read_id, 's' || (p_partkey % 7) AS sample_id, 'read' || p_partkey AS read_name, hap FROM part LEFT JOIN h ON h.sample_id = 's' || (p_partkey % 7) AND h.read_no = p_partkey",
    "accuracy_with_allowance": f"WITH {SCORES} SELECT * FROM scores",
    "tool_comparison_pivot": f"WITH {SCORES} SELECT dataset, allowance, sum(hits) FILTER (WHERE tool = 'a')::BIGINT AS a, sum(hits) FILTER (WHERE tool = 'b')::BIGINT AS b, sum(hits) FILTER (WHERE tool = 'c')::BIGINT AS c FROM scores GROUP BY ALL",
    "repeatmasker_parse": "SELECT 'read' || k AS id, (k % 9 + 40 + k % 13)::INTEGER AS total_len, (k % 9 + 1)::INTEGER AS begin, (k % 9 + 40)::INTEGER AS \"end\", 40 AS len, 'AC' AS unit, 'Simple_repeat' AS \"class\" FROM (SELECT p_partkey AS k FROM part) WHERE k % 4 <> 0",
    "trf_parse": "SELECT '(AC)' || (k % 20) AS truth, (k % 9 + 1)::INTEGER AS begin, (k % 9 + 40)::INTEGER AS \"end\", 2 AS period, (k % 20 + 2)::INTEGER AS copies, 2 AS consensus, 'AC' AS unit FROM (SELECT p_partkey AS k FROM part) WHERE k % 10 <> 0",
}
ORACLES |= {"decompose_staged": ORACLES["decompose_mosaic"], "staged_one_error": ORACLES["decompose_one_error"], "staged_fallback": ORACLES["fallback_reps1"]}
