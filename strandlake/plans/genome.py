"""Queries of elements, transcripts, genotypes and matched background."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import elements as E
from strandlake.operators import genotypes as G
from strandlake.operators import intervals as I
from strandlake.operators import transcripts as X
from strandlake.plans.registry import query
from strandlake.plans.relational import first_come_sql, spans
from strandlake.plans.tables import MOTIF_SEQ, motif_sequences, read

ELEMENTS = "(SELECT o_orderkey AS element_id, o_orderpriority AS ref, o_custkey * 10 AS s, o_custkey * 10 + 20 + o_orderkey % 50 AS e, o_orderkey % 3 <> 0 AS forward, o_orderkey % 20 AS pos FROM orders)"


def elements(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    start = F.col("o_custkey") * 10
    return o.select(F.col("o_orderkey").alias("element_id"), F.col("o_orderpriority").alias("ref"), start.alias("start"), (start + 20 + F.col("o_orderkey") % 50).alias("end"), (F.col("o_orderkey") % 3 != 0).alias("forward"), (F.col("o_orderkey") % 20).alias("pos"))


def args():
    return [F.col(c) for c in ("start", "end", "forward")]


@query(
    f"SELECT element_id, CASE WHEN forward THEN s + pos ELSE e - 1 - pos END AS at, CASE WHEN forward THEN s + 2 ELSE e - 9 END AS sub_start, CASE WHEN forward THEN s + 9 ELSE e - 2 END AS sub_end, NOT forward AS sub_forward FROM {ELEMENTS}"
)
def element_positions(spark, sf_dir):
    e = elements(spark, sf_dir)
    sub = E.sub_element(F.lit(2), F.lit(9), F.lit(True), *args())
    return e.select("element_id", E.to_reference(F.col("pos"), *args()).alias("at"), sub["start"].alias("sub_start"), sub["end"].alias("sub_end"), sub["forward"].alias("sub_forward"))


@query(
    f"WITH e AS {ELEMENTS} SELECT a.element_id, a.pos, b.element_id AS other_id, CASE WHEN a.ref = b.ref THEN CASE WHEN b.forward THEN x - b.s ELSE b.e - 1 - x END END AS other_pos FROM (SELECT *, CASE WHEN forward THEN s + pos ELSE e - 1 - pos END AS x FROM e) a JOIN e b ON b.element_id = a.element_id + 7"
)
def element_map(spark, sf_dir):
    e = elements(spark, sf_dir)
    wanted = e.select("element_id", "pos", (F.col("element_id") + 7).alias("other_id"))
    return E.map_positions(wanted, e.drop("pos"), e.drop("pos"))


# Variations of each benchmark sequence: a substitution at 10, an insertion at 20, a deletion of 30 to 35.
def varied(spark, sf_dir):
    s = motif_sequences(spark, sf_dir).filter(F.length("seq") >= 40)
    none = F.array().cast(f"array<{E.VARIATION}>")
    v = E.with_variation(none, "D", F.lit(30), F.lit(35), F.lit(""))
    v = E.with_variation(v, "S", F.lit(10), F.lit(12), F.lit("GG"))
    v = E.with_variation(v, "I", F.lit(20), F.lit(20), F.lit("ACAC"))
    return s.withColumn("v", v)


@query(f"SELECT seq_id, substr(seq, 1, 10) || 'GG' || substr(seq, 13, 8) || 'ACAC' || substr(seq, 21, 10) || substr(seq, 36) AS seq FROM {MOTIF_SEQ} WHERE length(seq) >= 40")
def varied_sequence(spark, sf_dir):
    return varied(spark, sf_dir).select("seq_id", E.varied(F.col("seq"), F.lit(0), F.col("v")).alias("seq"))


@query(
    f"SELECT seq_id, p AS pos, CASE WHEN p < 20 THEN p WHEN p < 30 THEN p + 4 WHEN p >= 35 THEN p - 1 END AS region, CASE WHEN p < 20 THEN p WHEN p < 24 THEN NULL WHEN p < 34 THEN p - 4 ELSE p + 1 END AS back, CASE WHEN p BETWEEN 20 AND 23 THEN p - 19 ELSE 0 END AS shift FROM (SELECT seq_id, unnest(range(0, 39)) AS p FROM {MOTIF_SEQ} WHERE length(seq) >= 40)"
)
def variation_positions(spark, sf_dir):
    v = varied(spark, sf_dir).select("seq_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(38).cast("long"))).alias("pos"))
    back, shift = E.reference_position(F.col("pos"), F.lit(0), F.col("v"))
    return v.select("seq_id", "pos", E.region_position(F.col("pos"), F.lit(0), F.col("v")).alias("region"), back.alias("back"), shift.alias("shift"))


EDGES = "(SELECT DISTINCT l_orderkey AS element_id, l_suppkey AS s, l_partkey % 100 AS e FROM lineitem WHERE l_suppkey <> l_partkey % 100)"


def edges(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_id"), F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 100).alias("e"))
    return li.filter("s <> e")


SITES = f"st AS (SELECT element_id, pos, row_number() OVER (PARTITION BY element_id ORDER BY pos) - 1 AS site FROM (SELECT element_id, s AS pos FROM {EDGES} UNION SELECT element_id, e FROM {EDGES}))"


@query(f"WITH {SITES} SELECT element_id, pos, site FROM st")
def element_sites(spark, sf_dir):
    return E.sites(edges(spark, sf_dir))


CONN = f"{SITES}, cn AS (SELECT element_id, row_number() OVER (PARTITION BY element_id ORDER BY a.site, b.site) - 1 AS connection, a.site AS from_site, b.site AS to_site, a.site < b.site AS forward FROM {EDGES} x JOIN st a USING (element_id) JOIN st b USING (element_id) WHERE a.pos = x.s AND b.pos = x.e)"


@query(f"WITH {CONN} SELECT element_id, connection, from_site, to_site, forward FROM cn")
def element_connections(spark, sf_dir):
    e = edges(spark, sf_dir)
    return E.connected(e, E.sites(e))


WANTED = f"wanted AS (SELECT element_id, s, e, element_id % 2 = 1 AS reversed FROM {EDGES} UNION SELECT o_orderkey, o_custkey % 100, o_orderkey % 100, o_orderkey % 2 = 1 FROM orders)"


@query(f"WITH {CONN}, {WANTED}, t AS (SELECT *, CASE WHEN reversed THEN e ELSE s END AS f, CASE WHEN reversed THEN s ELSE e END AS u FROM wanted) SELECT t.element_id, t.s, t.e, reversed, a.site AS from_site, b.site AS to_site, connection FROM t LEFT JOIN st a ON a.element_id = t.element_id AND a.pos = t.f LEFT JOIN st b ON b.element_id = t.element_id AND b.pos = t.u LEFT JOIN cn ON cn.element_id = t.element_id AND cn.from_site = a.site AND cn.to_site = b.site")
def connection_lookup(spark, sf_dir):
    e = edges(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("element_id"), (F.col("o_custkey") % 100).alias("s"), (F.col("o_orderkey") % 100).alias("e"))
    wanted = e.unionByName(o).distinct().withColumn("reversed", F.col("element_id") % 2 == 1)
    s = E.sites(e)
    return E.find_connections(wanted, s, E.connected(e, s))


@query(f"WITH {CONN}, x AS (SELECT cn.*, a.pos AS p, b.pos AS q FROM cn JOIN st a ON a.element_id = cn.element_id AND a.site = from_site JOIN st b ON b.element_id = cn.element_id AND b.site = to_site) SELECT element_id, connection, CASE WHEN forward THEN p - 3 ELSE q - 2 END AS s, CASE WHEN forward THEN q + 1 + 2 ELSE p + 1 + 3 END AS e, forward FROM x")
def connection_elements(spark, sf_dir):
    e = edges(spark, sf_dir)
    s = E.sites(e)
    return E.connection_elements(E.connected(e, s), s, 3, 2)


@query(
    f"WITH e AS {ELEMENTS}, ed AS (SELECT DISTINCT element_id, s % 20 AS s, e % 20 AS e FROM {EDGES} WHERE s % 20 <> e % 20), m AS (SELECT ed.element_id, b.element_id AS other_id, ed.s, ed.e, a.ref = b.ref AS same, CASE WHEN a.forward THEN a.s + ed.s ELSE a.e - 1 - ed.s END AS x, CASE WHEN a.forward THEN a.s + ed.e ELSE a.e - 1 - ed.e END AS y, b.s AS bs, b.e AS be, b.forward AS bf FROM ed JOIN e a USING (element_id) JOIN e b ON b.element_id = ed.element_id + 7) "
    "SELECT element_id, other_id, s, e, CASE WHEN same THEN CASE WHEN bf THEN x - bs ELSE be - 1 - x END END AS other_s, CASE WHEN same THEN CASE WHEN bf THEN y - bs ELSE be - 1 - y END END AS other_e FROM m"
)
def connection_map(spark, sf_dir):
    own = edges(spark, sf_dir).select("element_id", (F.col("s") % 20).alias("s"), (F.col("e") % 20).alias("e")).filter("s <> e").distinct()
    e = elements(spark, sf_dir).drop("pos")
    return E.map_connections(own.withColumn("other_id", F.col("element_id") + 7), e, e)


@query(f"WITH {CONN} SELECT a.element_id, a.connection, b.connection AS next FROM cn a JOIN cn b ON a.element_id = b.element_id AND a.to_site = b.from_site")
def connection_neighbours(spark, sf_dir):
    e = edges(spark, sf_dir)
    return E.neighbours(E.connected(e, E.sites(e)))


@query(f"WITH {SITES}, r AS (SELECT *, pos - 5 AS s, pos + 4 AS e FROM st), n AS (SELECT *, lag(e) OVER w AS l, lead(s) OVER w AS r FROM r WINDOW w AS (PARTITION BY element_id ORDER BY pos)) SELECT element_id, site, CASE WHEN l > s THEN CAST(floor((l + s) / 2) AS BIGINT) ELSE s END AS s, CASE WHEN r < e THEN CAST(floor((r + e) / 2) AS BIGINT) ELSE e END AS e FROM n")
def site_regions(spark, sf_dir):
    return E.site_regions(E.sites(edges(spark, sf_dir)), 5, 3, "regions")


@query(f"WITH {SITES}, n AS (SELECT *, lag(pos) OVER w AS l, lead(pos) OVER w AS r FROM st WINDOW w AS (PARTITION BY element_id ORDER BY pos)) SELECT element_id, site, greatest(pos - 5, coalesce(l + 1, pos - 5)) AS s, least(pos + 4, coalesce(r, pos + 4)) AS e FROM n")
def site_regions_trimmed(spark, sf_dir):
    return E.site_regions(E.sites(edges(spark, sf_dir)), 5, 3, "sites")


@query(f"WITH {SITES}, t AS (SELECT element_id, s AS pos, min(e) AS value FROM {EDGES} GROUP BY ALL) SELECT st.element_id, site, o AS \"offset\", t.value FROM st CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) LEFT JOIN t ON t.element_id = st.element_id AND t.pos = st.pos + o")
def region_features(spark, sf_dir):
    e = edges(spark, sf_dir)
    s = E.sites(e)
    track = e.groupBy("element_id", F.col("s").alias("pos")).agg(F.min("e").alias("value"))
    return E.region_features(E.site_regions(s, 1, 1).join(s.select("element_id", "site", "pos"), ["element_id", "site"]), track, 1, 1)


@query("SELECT event_id, s - 3 AS start_s, s + 3 AS start_e, e - 4 AS end_s, e + 2 AS end_e, (s + e) // 2 - 3 AS mid_s, (s + e) // 2 + 3 AS mid_e FROM (SELECT event_id, cast(floor(epoch(ts)) AS BIGINT) // 60 AS s, cast(floor(epoch(ts)) AS BIGINT) // 60 + 1 + cast(floor(value) AS BIGINT) % 7 AS e FROM events)")
def region_modes(spark, sf_dir):
    s = spans(spark, sf_dir)
    out = s.select("event_id")
    for mode, n in (("start", "start"), ("end", "end"), ("middle", "mid")):
        w = I.windows_of(s, mode, 3).select("event_id", F.col("start").alias(f"{n}_s"), F.col("end").alias(f"{n}_e"))
        out = out.join(w, "event_id")
    return out


# A transcript per order with at least two lines: exons of the lines in order, 10 to 60 bases, gaps of 20 bases.
EXONS = (
    "ln AS (SELECT l_orderkey AS tx_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, CAST(l_quantity AS BIGINT) + 10 AS n FROM lineitem), "
    "ex AS (SELECT tx_id, i, n, sum(n + 20) OVER (PARTITION BY tx_id ORDER BY i) - n - 20 AS s FROM ln), "
    "tr AS (SELECT tx_id, tx_id % 3 <> 0 AS forward, max(s + n) AS hi, count(*) AS k FROM ex GROUP BY tx_id HAVING count(*) >= 2), "
    "cd AS (SELECT tx_id, forward, hi, CASE WHEN tx_id % 4 <> 1 THEN 5 END AS c0, CASE WHEN tx_id % 4 <> 1 THEN hi - 4 END AS c1 FROM tr), "
    "el AS (SELECT tx_id, row_number() OVER (PARTITION BY tx_id ORDER BY CASE WHEN forward THEN s ELSE hi - s - n END) - 1 AS exon, CASE WHEN forward THEN s ELSE hi - s - n END AS s, CASE WHEN forward THEN s + n ELSE hi - s END AS e, CASE WHEN forward THEN c0 ELSE hi - c1 END AS cs, CASE WHEN forward THEN c1 ELSE hi - c0 END AS ce FROM ex JOIN cd USING (tx_id)), "
    "eb AS (SELECT *, sum(e - s) OVER (PARTITION BY tx_id ORDER BY s) - (e - s) AS before FROM el)"
)


def transcripts(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("tx_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "tx_id").withColumn("n", F.col("l_quantity").cast("long") + 10).withColumn("i", F.row_number().over(w))
    s = F.sum(F.col("n") + 20).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - 20
    held = F.array_sort(F.collect_list(F.struct("i", "s", (F.col("s") + F.col("n")).alias("e"))))
    t = li.withColumn("s", s).groupBy("tx_id").agg(held.alias("x")).filter(F.size("x") >= 2)
    hi = F.array_max(F.col("x.e"))
    coded = F.col("tx_id") % 4 != 1
    return t.select("tx_id", F.lit("ref").alias("ref"), F.col("x.s").alias("exon_starts"), F.col("x.e").alias("exon_ends"), (F.col("tx_id") % 3 != 0).alias("forward"), F.when(coded, F.lit(5).cast("long")).alias("cds_start"), F.when(coded, hi - 4).alias("cds_end"))


def exon_rows(spark, sf_dir):
    return X.exons(X.checked(transcripts(spark, sf_dir)))


@query(f"WITH {EXONS} SELECT tx_id, exon, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(before AS BIGINT) AS before FROM eb")
def exon_table(spark, sf_dir):
    return exon_rows(spark, sf_dir).select("tx_id", "exon", "s", "e", "before")


@query(f"WITH {EXONS} SELECT tx_id, exon AS intron, CAST(e AS BIGINT) AS s, CAST(n AS BIGINT) AS e FROM (SELECT *, lead(s) OVER (PARTITION BY tx_id ORDER BY s) AS n FROM eb) WHERE n IS NOT NULL")
def introns(spark, sf_dir):
    return X.introns(exon_rows(spark, sf_dir))


@query(
    f"WITH {EXONS} SELECT tx_id, count(*) AS exons, CAST(max(e) - min(s) AS BIGINT) AS premrna, CAST(sum(e - s) AS BIGINT) AS mrna, CAST(CASE WHEN max(cs) IS NOT NULL THEN sum(greatest(0, least(e, cs) - s)) END AS BIGINT) AS utr5, "
    "CAST(CASE WHEN max(cs) IS NOT NULL THEN sum(greatest(0, least(e, ce) - greatest(s, cs))) END AS BIGINT) AS cds, CAST(CASE WHEN max(cs) IS NOT NULL THEN sum(greatest(0, e - greatest(s, ce))) END AS BIGINT) AS utr3 FROM eb GROUP BY tx_id"
)
def exon_lengths(spark, sf_dir):
    return X.lengths(exon_rows(spark, sf_dir))


@query(f"WITH {EXONS} SELECT tx_id, CAST(min(s) AS BIGINT) AS utr5_s, CAST(max(cs) AS BIGINT) AS utr5_e, CAST(max(ce) AS BIGINT) AS utr3_s, CAST(max(e) AS BIGINT) AS utr3_e FROM eb GROUP BY tx_id HAVING max(cs) IS NOT NULL")
def utr_intervals(spark, sf_dir):
    return X.utr_intervals(exon_rows(spark, sf_dir))


MAPPED = (
    f"{EXONS}, ps AS (SELECT tx_id, p AS pos FROM tr CROSS JOIN (SELECT unnest([0, 4, 5, 17, 33, 60, 95]) AS p)), f AS (SELECT tx_id, sum(greatest(0, least(e, cs) - s)) AS five, sum(greatest(0, least(e, ce) - s)) AS coded, max(cs) AS cs, max(ce) AS ce FROM eb GROUP BY tx_id), "
    "mp AS (SELECT ps.tx_id, ps.pos, max(CASE WHEN ps.pos >= s AND ps.pos < e THEN before + ps.pos - s END) AS m FROM ps JOIN eb USING (tx_id) GROUP BY ALL), "
    "kd AS (SELECT mp.*, f.*, CASE WHEN m IS NULL THEN 'intron' WHEN cs IS NULL THEN 'mrna' WHEN pos < cs THEN 'utr5' WHEN pos < ce THEN 'cds' ELSE 'utr3' END AS kind FROM mp JOIN f ON f.tx_id = mp.tx_id)"
)


def some_positions(spark, sf_dir, name="pos", values=(0, 4, 5, 17, 33, 60, 95)):
    return transcripts(spark, sf_dir).select("tx_id", F.explode(F.array(*[F.lit(v).cast("long") for v in values])).alias(name))


@query(f"WITH {MAPPED} SELECT tx_id, pos, CAST(m AS BIGINT) AS mrna, CAST(CASE WHEN kind = 'utr5' THEN m END AS BIGINT) AS utr5, CAST(CASE WHEN cs IS NOT NULL THEN m - five END AS BIGINT) AS cds, CAST(CASE WHEN kind = 'utr3' THEN m - coded END AS BIGINT) AS utr3, kind FROM kd")
def cds_map(spark, sf_dir):
    return X.on_mrna(some_positions(spark, sf_dir), exon_rows(spark, sf_dir))


@query(f"WITH {EXONS}, ps AS (SELECT tx_id, p AS cds FROM tr CROSS JOIN (SELECT unnest([-2, 0, 1, 30, 70]) AS p)), f AS (SELECT tx_id, sum(greatest(0, least(e, cs) - s)) AS five FROM eb GROUP BY tx_id) SELECT tx_id, cds, CAST(max(CASE WHEN cds + five >= before AND cds + five < before + e - s THEN s + cds + five - before END) AS BIGINT) AS pos FROM ps JOIN f USING (tx_id) JOIN eb USING (tx_id) GROUP BY tx_id, cds")
def cds_to_element(spark, sf_dir):
    return X.from_cds(some_positions(spark, sf_dir, "cds", (-2, 0, 1, 30, 70)), exon_rows(spark, sf_dir))


PAIRS = ((0, 17), (4, 33), (5, 60), (33, 95))


@query(f"WITH {MAPPED}, ab AS (SELECT tx_id, a, b FROM tr CROSS JOIN (VALUES {', '.join(map(str, PAIRS))}) v(a, b)) SELECT ab.tx_id, a AS s, b AS e, CAST(x.m AS BIGINT) AS mrna_s, CAST(y.m AS BIGINT) AS mrna_e, CAST(CASE WHEN x.cs IS NOT NULL THEN x.m - x.five END AS BIGINT) AS cds_s, CAST(CASE WHEN y.cs IS NOT NULL THEN y.m - y.five END AS BIGINT) AS cds_e FROM ab JOIN kd x ON x.tx_id = ab.tx_id AND x.pos = a JOIN kd y ON y.tx_id = ab.tx_id AND y.pos = b")
def transcript_intervals(spark, sf_dir):
    each = transcripts(spark, sf_dir).select("tx_id", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("s"), F.lit(b).cast("long").alias("e")) for a, b in PAIRS])).alias("x")).select("tx_id", "x.*")
    return X.intervals_on_mrna(each, exon_rows(spark, sf_dir)).select("tx_id", "s", "e", "mrna_s", "mrna_e", "cds_s", "cds_e")


@query(f"WITH {EXONS}, ps AS (SELECT tx_id, p AS protein FROM tr CROSS JOIN (SELECT unnest([0, 1, 10, 33]) AS p)), f AS (SELECT tx_id, sum(greatest(0, least(e, cs) - s)) AS five FROM eb GROUP BY tx_id) SELECT tx_id, protein, CAST(max(CASE WHEN 3 * protein + five >= before AND 3 * protein + five < before + e - s THEN s + 3 * protein + five - before END) AS BIGINT) AS pos FROM ps JOIN f USING (tx_id) JOIN eb USING (tx_id) GROUP BY tx_id, protein")
def protein_to_element(spark, sf_dir):
    return X.from_protein(some_positions(spark, sf_dir, "protein", (0, 1, 10, 33)), exon_rows(spark, sf_dir))


@query(f"WITH {MAPPED} SELECT tx_id, pos, CAST(CASE WHEN kind = 'cds' THEN floor((m - five) / 3) END AS BIGINT) AS protein FROM kd")
def protein_map(spark, sf_dir):
    return X.on_protein(some_positions(spark, sf_dir), exon_rows(spark, sf_dir))


@query(f"WITH {EXONS}, f AS (SELECT tx_id, exon, (((before - sum(greatest(0, least(e, cs) - s)) OVER (PARTITION BY tx_id)) % 3) + 3) % 3 AS p, cs FROM eb) SELECT tx_id, CAST(sum(p) AS BIGINT) AS phases FROM f WHERE cs IS NOT NULL GROUP BY tx_id")
def phase_sums(spark, sf_dir):
    return X.phases(exon_rows(spark, sf_dir)).groupBy("tx_id").agg(F.sum("start_phase").alias("phases"))


@query(f"WITH {EXONS}, f AS (SELECT tx_id, sum(greatest(0, least(e, cs) - s)) AS five FROM eb GROUP BY tx_id) SELECT tx_id, exon, CAST(((before - five) % 3 + 3) % 3 AS BIGINT) AS start_phase, CAST(((before - five + e - s) % 3 + 3) % 3 AS BIGINT) AS end_phase FROM eb JOIN f USING (tx_id) WHERE cs IS NOT NULL")
def exon_phases(spark, sf_dir):
    return X.phases(exon_rows(spark, sf_dir))


@query(
    f"WITH {EXONS}, q AS (SELECT tx_id, forward, substr(repeat('ACGTTGCAAC', 200), 1, CAST(hi AS BIGINT)) AS z FROM cd), o AS (SELECT tx_id, CASE WHEN forward THEN z ELSE reverse(translate(z, 'ACGT', 'TGCA')) END AS z FROM q), "
    "m AS (SELECT tx_id, string_agg(substr(z, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)), '' ORDER BY exon) AS mrna, CAST(CASE WHEN max(cs) IS NOT NULL THEN sum(greatest(0, least(e, cs) - s)) END AS BIGINT) AS a, CAST(CASE WHEN max(cs) IS NOT NULL THEN sum(greatest(0, least(e, ce) - greatest(s, cs))) END AS BIGINT) AS b FROM eb JOIN o USING (tx_id) GROUP BY tx_id) "
    "SELECT tx_id, mrna, substr(mrna, 1, a) AS utr5, substr(mrna, a + 1, b) AS cds, substr(mrna, a + b + 1) AS utr3, b // 3 AS aminos FROM m"
)
def spliced_sequences(spark, sf_dir):
    t = transcripts(spark, sf_dir)
    ref = t.select("tx_id", F.substring(F.repeat(F.lit("ACGTTGCAAC"), 200), F.lit(1), F.array_max("exon_ends").cast("int")).alias("seq"))
    s = X.sequences(t, ref, exon_rows(spark, sf_dir))
    return s.select("tx_id", "mrna", "utr5", "cds", "utr3", F.length("protein").cast("long").alias("aminos"))


# Genotypes: subjects are suppliers, variants parts of ten positions in five intervals.
GENO = "(SELECT 'c' || CAST(l_partkey % 5 AS VARCHAR) AS interval, l_partkey % 200 AS pos, l_suppkey AS subject, CAST(CASE WHEN min(l_linenumber) % 6 = 0 THEN NULL ELSE sum(l_linenumber) % 2 END AS INTEGER) AS a1, CAST((sum(l_linenumber) // 2) % 2 AS INTEGER) AS a2, min(l_linenumber) % 2 = 0 AS phased FROM lineitem GROUP BY ALL)"
VARI = "(SELECT DISTINCT 'c' || CAST(p_partkey % 5 AS VARCHAR) AS interval, p_partkey % 200 AS pos, CASE WHEN p_partkey % 200 % 3 = 0 THEN ['A', 'C', 'G'] ELSE ['T', 'G'] END AS alleles FROM part)"


def genotypes(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    g = li.groupBy(F.concat(F.lit("c"), (F.col("l_partkey") % 5).cast("string")).alias("interval"), (F.col("l_partkey") % 200).alias("pos"), F.col("l_suppkey").alias("subject")).agg(F.min("l_linenumber").alias("lo"), F.sum("l_linenumber").alias("t"))
    return g.select("interval", "pos", "subject", F.when(F.col("lo") % 6 != 0, F.col("t") % 2).cast("int").alias("a1"), (F.floor(F.col("t") / 2) % 2).cast("int").alias("a2"), (F.col("lo") % 2 == 0).alias("phased"))


def variants(spark, sf_dir):
    p = F.col("p_partkey")
    alleles = F.when(p % 200 % 3 == 0, F.array(*map(F.lit, "ACG"))).otherwise(F.array(*map(F.lit, "TG")))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("c"), (p % 5).cast("string")).alias("interval"), (p % 200).alias("pos"), alleles.alias("alleles")).distinct()


@query(f"SELECT v.interval, v.pos, CASE WHEN len(alleles) = 2 THEN round(least(f, 1 - f), 6) END AS maf FROM {VARI} v LEFT JOIN (SELECT interval, pos, (count(*) FILTER (a1 = 0) + count(*) FILTER (a2 = 0)) / (2 * count(*)) AS f FROM {GENO} GROUP BY ALL) USING (interval, pos)")
def maf(spark, sf_dir):
    return G.maf(genotypes(spark, sf_dir), variants(spark, sf_dir)).select("interval", "pos", (F.round("maf", 6) + 0.0).alias("maf"))


@query(f"SELECT subject, copy, string_agg(coalesce(alleles[CASE copy WHEN 0 THEN a1 ELSE a2 END + 1], 'N'), '' ORDER BY interval, pos) AS haplotype FROM {GENO} JOIN {VARI} USING (interval, pos) CROSS JOIN (SELECT unnest([0, 1]) AS copy) GROUP BY subject, copy")
def haplotypes(spark, sf_dir):
    return G.haplotypes(genotypes(spark, sf_dir), variants(spark, sf_dir))


@query(f"SELECT interval, pos, subject, copy, CASE WHEN phased THEN CASE copy WHEN 0 THEN a1 ELSE a2 END END AS allele FROM {GENO} CROSS JOIN (SELECT unnest([0, 1]) AS copy)")
def genotype_matrix(spark, sf_dir):
    return G.matrix(genotypes(spark, sf_dir), True)


STILL = f"(SELECT interval, pos, subject, CASE WHEN pos % 7 = 0 THEN 0 ELSE a1 END AS a1, CASE WHEN pos % 7 = 0 THEN 0 ELSE a2 END AS a2, phased FROM {GENO})"


def partly_still(spark, sf_dir):
    """The genotypes, with the reference alone at every seventh position."""
    still = F.col("pos") % 7 == 0
    return genotypes(spark, sf_dir).withColumns({c: F.when(still, F.lit(0)).otherwise(F.col(c)) for c in ("a1", "a2")})


@query(f"SELECT interval, pos FROM {STILL} GROUP BY ALL HAVING NOT coalesce(bool_or(a1 <> a2), false) AND len(list_distinct(list_filter(list(a1) || list(a2), lambda x: x IS NOT NULL))) <= 1")
def invariant_sites(spark, sf_dir):
    return G.invariant(partly_still(spark, sf_dir))


@query(f"WITH g AS (SELECT * FROM {STILL} WHERE subject % 3 < 2), i AS (SELECT interval, pos FROM g GROUP BY ALL HAVING NOT coalesce(bool_or(a1 <> a2), false) AND len(list_distinct(list_filter(list(a1) || list(a2), lambda x: x IS NOT NULL))) <= 1) SELECT g.* FROM g ANTI JOIN i USING (interval, pos)")
def group_genotypes(spark, sf_dir):
    g = partly_still(spark, sf_dir)
    groups = g.select("subject").distinct().select(F.element_at(F.array(*map(F.lit, "xyz")), (F.col("subject") % 3 + 1).cast("int")).alias("group"), "subject")
    return G.selected(g, groups, ["x", "y"], True).select("interval", "pos", "subject", "a1", "a2", "phased")


@query(f"SELECT interval, pos, subject FROM {GENO} WHERE interval = 'c1' OR (interval = 'c2' AND pos >= 50 AND pos < 120)")
def genotypes_within(spark, sf_dir):
    iv = spark.createDataFrame([("c1", None, None), ("c2", 50, 120)], "interval string, start long, end long")
    return G.within(genotypes(spark, sf_dir), iv).select("interval", "pos", "subject")


SPLIT = f"a AS (SELECT * FROM {GENO} WHERE subject % 2 = 0), va AS (SELECT * FROM {VARI}), b AS (SELECT * FROM {GENO} WHERE subject % 2 = 1), vb AS (SELECT interval, pos, [alleles[1], 'N', alleles[2]] AS alleles FROM {VARI})"


@query(
    f"WITH {SPLIT}, s AS (SELECT DISTINCT subject FROM (SELECT subject FROM a UNION SELECT subject FROM b)), u AS (SELECT interval, pos, alleles || ['N'] AS al FROM va), "
    "c AS (SELECT interval, pos, subject, a1, a2, phased FROM a UNION ALL SELECT b.interval, b.pos, subject, CAST(CASE a1 WHEN 0 THEN 0 WHEN 1 THEN len(u.al) - 1 END AS INTEGER), CAST(CASE a2 WHEN 0 THEN 0 WHEN 1 THEN len(u.al) - 1 END AS INTEGER), phased FROM b JOIN u ON u.interval = b.interval AND u.pos = b.pos) "
    "SELECT u.interval, u.pos, s.subject, CASE WHEN c.subject IS NULL THEN 0 ELSE c.a1 END AS a1, CASE WHEN c.subject IS NULL THEN 0 ELSE c.a2 END AS a2, coalesce(c.phased, true) AS phased FROM u CROSS JOIN s LEFT JOIN c ON c.interval = u.interval AND c.pos = u.pos AND c.subject = s.subject WHERE c.subject IS NOT NULL OR (u.pos >= 0 AND u.pos < 100)"
)
def genotype_merge(spark, sf_dir):
    g, v = genotypes(spark, sf_dir), variants(spark, sf_dir)
    other = v.withColumn("alleles", F.array(F.get("alleles", F.lit(0)), F.lit("N"), F.get("alleles", F.lit(1))))
    names = v.select("interval").distinct()
    covered = g.select("subject").distinct().join(names).select("subject", "interval", F.lit(0).cast("long").alias("start"), F.lit(100).cast("long").alias("end"))
    return G.merge(g.filter("subject % 2 = 0"), v, g.filter("subject % 2 = 1"), other, covered)[0].select("interval", "pos", "subject", "a1", "a2", "phased")


@query("WITH s AS (SELECT event_type AS i, cast(floor(epoch(ts)) AS BIGINT) // 60 AS s, cast(floor(epoch(ts)) AS BIGINT) // 60 + 1 + cast(floor(value) AS BIGINT) % 7 AS e FROM events), n AS (SELECT *, CASE WHEN s >= max(e) OVER (PARTITION BY i ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS k FROM s), g AS (SELECT *, sum(k) OVER (PARTITION BY i ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS q FROM n) SELECT i AS interval, min(s) AS start, max(e) AS \"end\" FROM g WHERE i <> 'error' GROUP BY i, q UNION ALL SELECT 'error', NULL, NULL")
def merge_intervals(spark, sf_dir):
    s = spans(spark, sf_dir).select(F.col("chrom").alias("interval"), "start", "end")
    whole = spark.createDataFrame([("error", None, None)], "interval string, start long, end long")
    return G.merged_intervals(s.unionByName(whole))


@query("SELECT event_type AS interval, min(cast(floor(epoch(ts)) AS BIGINT) // 60) AS start, max(cast(floor(epoch(ts)) AS BIGINT) // 60 + 1 + cast(floor(value) AS BIGINT) % 7) AS \"end\" FROM events GROUP BY 1")
def contig_spans(spark, sf_dir):
    return G.spans(spans(spark, sf_dir).select(F.col("chrom").alias("interval"), "start", "end"))


@query("SELECT interval, pos, k, CASE WHEN lag(pos) OVER w = pos THEN 'drop' WHEN lead(pos) OVER w = pos THEN 'mark' ELSE 'keep' END AS action FROM (SELECT DISTINCT 'c' || CAST(p_partkey % 5 AS VARCHAR) AS interval, p_partkey % 40 AS pos, p_size AS k FROM part) WINDOW w AS (PARTITION BY interval ORDER BY pos, k)")
def discordancies(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")).alias("interval"), (F.col("p_partkey") % 40).alias("pos"), F.col("p_size").alias("alleles")).distinct()
    return G.discordant(p).withColumnRenamed("alleles", "k")


@query(f"SELECT interval, subject, copy, pos, alleles[x + 1] AS seq FROM (SELECT interval, pos, subject, copy, CASE copy WHEN 0 THEN a1 ELSE a2 END AS x FROM {GENO} CROSS JOIN (SELECT unnest([0, 1]) AS copy)) JOIN {VARI} USING (interval, pos) WHERE x > 0")
def genotype_variations(spark, sf_dir):
    return G.variations(genotypes(spark, sf_dir), variants(spark, sf_dir))


@query(f"SELECT interval, pos, array_to_string(list_transform(alleles, lambda a: reverse(translate(a, 'ACGT', 'TGCA'))), ',') AS alleles FROM {VARI}")
def reverse_variants(spark, sf_dir):
    return G.reverse(variants(spark, sf_dir)).select("interval", "pos", F.array_join("alleles", ",").alias("alleles"))


WINDOWS = (
    "w AS (SELECT doc_id, source AS chrom, doc_id * 1000000 + 100 * i AS s, substr(text, CAST(100 * i + 1 AS INTEGER), 200) AS t FROM (SELECT doc_id, source, text, unnest(range(0, greatest(0, (length(text) - 101) // 100) + 1)) AS i FROM documents WHERE length(text) > 0)), "
    "k AS (SELECT doc_id, chrom, s, s + length(t) AS e, length(t) AS size, (length(regexp_replace(t, '[^GCgc]', '', 'g')) * 20 // length(t)) * 21 + length(regexp_replace(t, '[^acgtn]', '', 'g')) * 20 // length(t) AS key FROM w), "
    "need AS (SELECT size, key, count(*) AS need FROM k WHERE doc_id % 5 = 0 GROUP BY ALL), free AS (SELECT k.*, md5(concat_ws(':', chrom, s, e)) AS turn, struct_pack(size := size, key := key, turn := md5(concat_ws(':', chrom, s, e)), chrom := chrom) AS id FROM k SEMI JOIN need USING (size, key) WHERE doc_id % 5 > 1)"
)


@query(
    f"WITH {WINDOWS}, f AS ({first_come_sql('free', 'doc_id', 'turn')}), a AS (SELECT k.s AS s, k.e AS e, k.id AS id FROM (SELECT unnest(kept) AS k FROM f)), "
    "r AS (SELECT id.chrom AS chrom, s, e, id.size AS size, id.key AS key, row_number() OVER (PARTITION BY id.size, id.key ORDER BY id.turn, id.chrom, s) AS i FROM a) "
    "SELECT chrom, s AS start, e AS \"end\", r.size, r.key FROM r JOIN need ON need.size = r.size AND need.key = r.key WHERE i <= need"
)
def background(spark, sf_dir):
    """Regions matched in length and GC bin: overlapping windows of whole documents, selected from every fifth, candidates from others."""
    t = read(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", F.col("source").alias("chrom"), "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 101) / 100).cast("int")))).alias("i"))
    cut = t.select("doc_id", "chrom", (F.col("doc_id") * 1000000 + 100 * F.col("i")).alias("start"), F.col("text").substr(100 * F.col("i") + 1, F.lit(200)).alias("seq"))
    d = cut.select("chrom", "start", (F.col("start") + F.length("seq")).alias("end"), "seq", "doc_id")
    chosen, rest = d.filter("doc_id % 5 = 0").drop("doc_id"), d.filter("doc_id % 5 > 1").drop("doc_id")
    return I.background(chosen, d.filter("doc_id % 5 = 1").drop("doc_id"), rest)


@query(f"SELECT interval, pos, subject, a1, a2, phased, row_number() OVER (PARTITION BY interval, pos ORDER BY subject DESC) AS turn FROM {GENO} WHERE subject % 4 <> 0")
def sorted_subjects(spark, sf_dir):
    """Calls with the place of their subject in a given order of names, the others left out."""
    g = genotypes(spark, sf_dir)
    order = g.select("subject").distinct().filter("subject % 4 <> 0").withColumn("place", -F.col("subject"))
    s = G.sorted_subjects(g, order)
    return s.select("interval", "pos", "subject", "a1", "a2", "phased", "turn")


GONE = "(VALUES ('c1', 20, 40), ('c1', 150, 300), ('c2', 0, 200), ('c3', 77, 78), ('c4', 500, 600))"


@query(
    f"WITH iv AS (SELECT interval, min(pos) AS s, max(pos) + 1 AS e FROM {VARI} GROUP BY interval), g AS (SELECT * FROM {GONE} v(interval, gs, ge)), r AS (SELECT i.interval, i.s, i.e, list_sort(list(struct_pack(gs := gs, ge := ge)) FILTER (gs < i.e AND ge > i.s)) AS x FROM iv i LEFT JOIN g USING (interval) GROUP BY ALL), "
    "c AS (SELECT interval, unnest(list_zip([s] || coalesce(list_transform(x, lambda y: y.ge), []), coalesce(list_transform(x, lambda y: y.gs), []) || [e])) AS z FROM r) SELECT interval, z[1] AS start, z[2] AS \"end\" FROM c WHERE z[1] < z[2]"
)
def split_intervals(spark, sf_dir):
    """What removed intervals leave of the covered ones, which they split."""
    v = variants(spark, sf_dir)
    covered = G.genotyping_intervals(v)
    gone = spark.createDataFrame([("c1", 20, 40), ("c1", 150, 300), ("c2", 0, 200), ("c3", 77, 78), ("c4", 500, 600)], "interval string, start long, end long")
    return G.split_intervals(covered, gone)


@query(f"SELECT interval, pos, subject FROM {GENO} t WHERE NOT EXISTS (SELECT 1 FROM {GONE} v(i, s, e) WHERE i = interval AND pos >= s AND pos < e)")
def genotypes_outside(spark, sf_dir):
    gone = spark.createDataFrame([("c1", 20, 40), ("c1", 150, 300), ("c2", 0, 200), ("c3", 77, 78), ("c4", 500, 600)], "interval string, start long, end long")
    return G.outside(genotypes(spark, sf_dir), gone).select("interval", "pos", "subject")


@query(f"SELECT interval, min(pos) AS start, max(pos) + 1 AS \"end\" FROM {VARI} GROUP BY interval")
def genotyping_intervals(spark, sf_dir):
    return G.genotyping_intervals(variants(spark, sf_dir))


@query(
    "SELECT o_orderkey, a0 IS NULL OR (a0 <= b0 AND b1 <= a1) AS holds, a0 IS NULL AS whole, CASE WHEN a0 IS NULL THEN 0 WHEN a0 < b0 THEN -1 WHEN a0 > b0 THEN 1 WHEN a1 < b1 THEN -1 WHEN a1 > b1 THEN 1 ELSE 0 END AS cmp FROM "
    "(SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 40 END AS a0, o_custkey % 40 + 30 AS a1, o_orderkey % 40 AS b0, o_orderkey % 40 + o_orderkey % 9 AS b1 FROM orders)"
)
def interval_contains(spark, sf_dir):
    o, k, c = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    a, b = (F.when(c % 4 > 0, c % 40), c % 40 + 30), (k % 40, k % 40 + k % 9)
    return o.select("o_orderkey", G.contains(a, b).alias("holds"), G.whole(*a).alias("whole"), G.compare(a, b).alias("cmp"))
