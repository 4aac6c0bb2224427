"""Queries of vectors, intervals, ranks, tables and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.functions import arrays as A
from strandlake.functions.stats import binomial_test_udf, fisher_udf, gauss_mass_udf
from strandlake.operators import intervals as I
from strandlake.operators import tables as T
from strandlake.operators import windows as W
from strandlake.plans.registry import query
from strandlake.plans.tables import minutes, read


def r6(x, name=None):
    return (F.round(x, 6) + 0.0).alias(name or x)


LINES = "(SELECT l_orderkey, list(CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS v, list(l_discount ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS d FROM lineitem GROUP BY l_orderkey)"


def vectors(spark, sf_dir):
    """One vector of quantities per order, every fifth line number missing, and one of discounts."""
    q = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity"))
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", q.alias("q"), F.col("l_discount").alias("d"))))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(held.alias("a")).select("l_orderkey", F.col("a.q").alias("v"), F.col("a.d").alias("d"))


@query(
    f"SELECT l_orderkey, list_min(v) AS lo, list_max(v) AS hi, round(list_sum(v), 6) AS total, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squares, round(list_avg(v), 6) AS mean, "
    f"round(list_stddev_samp(v), 6) AS std, len(v) - list_count(v) AS nulls, CASE WHEN list_count(v) = len(v) THEN round(list_sum(v), 6) END AS strict_total FROM {LINES}"
)
def array_aggregates(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out = {"lo": "min", "hi": "max", "total": "sum", "squares": "squares", "mean": "mean", "std": "std"}
    cols = [A.aggregate("v", k).alias(n) if n in ("lo", "hi") else r6(A.aggregate("v", k), n) for n, k in out.items()]
    return v.select("l_orderkey", *cols, A.na_count("v").cast("long").alias("nulls"), r6(A.aggregate("v", "sum", False), "strict_total"))


def _all(f):
    return f"array_to_string(list_transform({f}, lambda x: coalesce(cast(x AS VARCHAR), 'NA')), ',')"


def show(x):
    return F.array_join(F.transform(x, lambda e: e.cast("string")), ",", "NA")


@query(
    f"SELECT l_orderkey, {_all('list_transform(list_zip(v, d), lambda z: cast(round(z[1] * 100) + round(z[2] * 100) AS BIGINT))')} AS plus, "
    f"{_all('list_transform(v, lambda x: x > 25)')} AS above, "
    f"{_all('list_filter(list_transform(range(0, len(v)), lambda i: CASE WHEN v[i + 1] > 25 THEN i END), lambda i: i IS NOT NULL)')} AS at, "
    f"{_all('list_transform(list_reverse(v), lambda x: cast(x AS BIGINT))')} AS back, list_position(v, 10.0) - 1 AS ten FROM {LINES}"
)
def array_ops(spark, sf_dir):
    v = vectors(spark, sf_dir)
    plus = A.zip_with("v", "d", lambda x, y: (F.round(x * 100) + F.round(y * 100)).cast("long"))
    above = F.transform("v", lambda x: x > 25)
    return v.select("l_orderkey", show(plus).alias("plus"), show(above).alias("above"), show(A.which(above)).alias("at"), show(F.transform(F.reverse("v"), lambda x: x.cast("long"))).alias("back"), A.find("v", F.lit(10.0)).cast("long").alias("ten"))


@query(
    f"SELECT l_orderkey, {_all('list_transform(v[1:1] || [0.0, 1.0] || v[2:], lambda x: cast(x AS BIGINT))')} AS inserted, {_all('list_transform(v[1:1] || v[4:], lambda x: cast(x AS BIGINT))')} AS removed, len(list_distinct(v)) AS kinds FROM {LINES}"
)
def array_edits(spark, sf_dir):
    v = vectors(spark, sf_dir)
    longs = lambda x: show(F.transform(x, lambda e: e.cast("long")))
    two = F.array(F.lit(0.0), F.lit(1.0))
    return v.select("l_orderkey", longs(A.insert("v", 1, two)).alias("inserted"), longs(A.remove("v", 1, 2)).alias("removed"), F.size(F.array_distinct(F.filter("v", lambda x: x.isNotNull()))).cast("long").alias("kinds"))


WIN = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(
    f"SELECT event_id, CASE WHEN c = 5 THEN n END AS win_count, CASE WHEN c = 5 THEN lo END AS win_min, CASE WHEN c = 5 THEN hi END AS win_max, CASE WHEN c = 5 THEN round(s, 6) END AS win_sum, CASE WHEN c = 5 THEN round(q, 6) END AS win_squares, "
    f"CASE WHEN c = 5 THEN round(m, 6) END AS win_mean, CASE WHEN c = 5 THEN round(d, 4) END AS win_std FROM (SELECT event_id, count(*) {WIN} AS c, count(value) {WIN} AS n, min(value) {WIN} AS lo, max(value) {WIN} AS hi, sum(value) {WIN} AS s, sum(value * value) {WIN} AS q, avg(value) {WIN} AS m, stddev_samp(value) {WIN} AS d FROM events)"
)
def sliding_agg(spark, sf_dir):
    e = W.sliding(read(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 5, 2)
    return e.select("event_id", "win_count", "win_min", "win_max", r6("win_sum"), r6("win_squares"), r6("win_mean"), (F.round("win_std", 4) + 0.0).alias("win_std"))


SPANS = "(SELECT event_id, event_type AS chrom, cast(floor(epoch(ts)) AS BIGINT) // 60 AS s, cast(floor(epoch(ts)) AS BIGINT) // 60 + 1 + cast(floor(value) AS BIGINT) % 7 AS e FROM events)"
ORDERED = "(SELECT o_orderkey, o_orderpriority AS chrom, cast(epoch(o_orderdate) AS BIGINT) // 86400 AS s, cast(epoch(o_orderdate) AS BIGINT) // 86400 + 1 + o_custkey % 3 AS e FROM orders)"


def spans(spark, sf_dir):
    """Intervals (chrom, start, end) of minutes from events; minutes before 1970 are cut towards it, as by SQL's division."""
    whole = minutes("ts")
    start = whole + ((whole < 0) & (F.second("ts") > 0)).cast("long")
    return read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("chrom"), start.alias("start"), (start + 1 + F.floor("value") % 7).alias("end"))


@query(
    f"SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM {SPANS} a JOIN {SPANS} b ON a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e WHERE a.event_id < b.event_id"
)
def interval_overlap_join(spark, sf_dir):
    s = spans(spark, sf_dir)
    return I.overlapping(s, s, 16).filter("a_event_id < b_event_id").select("a_event_id", "b_event_id", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("shared"))


@query(f"SELECT a.event_id AS a_event_id, b.event_id AS b_event_id FROM {SPANS} a JOIN {SPANS} b ON a.chrom = b.chrom AND b.s <= a.s AND a.e <= b.e WHERE a.event_id <> b.event_id")
def interval_contained(spark, sf_dir):
    s = spans(spark, sf_dir)
    return I.covering(s, s, 0, 16).filter("a_event_id <> b_event_id").select("a_event_id", "b_event_id")


@query(f"WITH s AS {SPANS} SELECT event_id FROM s a WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.event_id % 2 = 1 AND a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e)")
def interval_exclude(spark, sf_dir):
    s = spans(spark, sf_dir)
    return I.excluding(s.filter("event_id % 2 = 0"), s.filter("event_id % 2 = 1"), 16).select("event_id")


@query(
    f"WITH s AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM {SPANS}), g AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT chrom, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY chrom, k"
)
def interval_merge(spark, sf_dir):
    return I.merged(spans(spark, sf_dir), True)


def first_come_sql(rows: str, group: str, order: str) -> str:
    """SQL for the greedy choice: (group, list ``kept``) from rows with s, e, an order and a payload ``id``."""
    one = "struct_pack(s := s, e := e, id := id)"
    meets = "len(list_filter(kept, lambda k: k.s <= x[1].e AND x[1].s <= k.e)) > 0"
    return f"SELECT {group}, list_reduce(list([{one}] ORDER BY {order}), lambda kept, x: CASE WHEN {meets} THEN kept ELSE kept || x END) AS kept FROM {rows} GROUP BY {group}"


@query(f"SELECT k.id AS event_id, chrom, k.s AS start, k.e AS \"end\" FROM (SELECT chrom, unnest(kept) AS k FROM ({first_come_sql(f'(SELECT *, event_id AS id FROM {SPANS})', 'chrom', 'event_id')}))")
def remove_overlaps(spark, sf_dir):
    return I.first_come(spans(spark, sf_dir), "event_id")


PAIR = "(SELECT o_orderkey, o_custkey % 40 AS s1, o_custkey % 40 + o_orderkey % 9 AS e1, o_orderkey % 37 AS s2, o_orderkey % 37 + o_custkey % 11 AS e2 FROM orders)"
_MEET = "(greatest(s1, s2) < least(e1, e2) OR s1 = e2 OR e1 = s2) AND least(s1, s2) < greatest(e1, e2)"


@query(
    f"SELECT o_orderkey, greatest(s1, s2) AS is_, CASE WHEN greatest(s1, s2) < least(e1, e2) THEN least(e1, e2) ELSE greatest(s1, s2) END AS ie, CASE WHEN s2 < s1 THEN s2 ELSE s1 END AS ls, CASE WHEN s2 < s1 THEN least(e2, s1) ELSE s1 END AS le, "
    f"CASE WHEN e2 > e1 THEN greatest(e1, s2) ELSE e1 END AS rs, CASE WHEN e2 > e1 THEN e2 ELSE e1 END AS re, CASE WHEN {_MEET} THEN least(s1, s2) ELSE 0 END AS us, CASE WHEN {_MEET} THEN greatest(e1, e2) ELSE 0 END AS ue, s1 <= s2 AND e2 <= e1 AS contains FROM {PAIR}"
)
def interval_algebra(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = o.select("o_orderkey", (c % 40).alias("s1"), (c % 40 + k % 9).alias("e1"), (k % 37).alias("s2"), (k % 37 + c % 11).alias("e2"))
    args = [F.col(x) for x in ("s1", "e1", "s2", "e2")]
    out = {}
    for f, names in ((A.intersection, ("is_", "ie")), (A.left_difference, ("ls", "le")), (A.right_difference, ("rs", "re")), (A.union, ("us", "ue"))):
        out |= dict(zip(names, f(*args)))
    return p.select("o_orderkey", *[v.cast("long").alias(n) for n, v in out.items()], ((F.col("s1") <= F.col("s2")) & (F.col("e2") <= F.col("e1"))).alias("contains"))


@query("SELECT p_partkey FROM part WHERE ((p_size & 5) = 5 AND (p_size & 2) = 0 OR (p_size & 32) = 32) AND NOT ((p_size & 8) = 8)")
def condition_flags(spark, sf_dir):
    c = (A.Condition.of(5, 2) | A.Condition.of(32)) & ~A.Condition.of(8)
    return read(spark, sf_dir, "part").filter(c.test(F.col("p_size").cast("long"))).select("p_partkey")


PV = "(SELECT o_orderkey, o_orderpriority AS g, (o_totalprice % 1000) / 1000 * (o_custkey % 10 + 1) / 10 AS p FROM orders)"


def pvalues(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") % 1000 / 1000 * (F.col("o_custkey") % 10 + 1) / 10).alias("p"))


def adjusted_sql(x: str, fold: str, h: str = "") -> str:
    return f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS i, count(*) OVER (PARTITION BY g) AS n FROM {PV}), x AS (SELECT *, {x} AS x FROM r) SELECT o_orderkey, round(least(1, {fold}), 6) AS q FROM x"


BACK = "min(x) OVER (PARTITION BY g ORDER BY p, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(adjusted_sql("p * n / i", BACK))
def bh_adjust(spark, sf_dir):
    return W.adjust(pvalues(spark, sf_dir), ["g"], "p", "BH").select("o_orderkey", r6("q"))


@query(f"SELECT o_orderkey, round(least(1, p * count(*) OVER (PARTITION BY g)), 6) AS q FROM {PV}")
def bonferroni(spark, sf_dir):
    return W.adjust(pvalues(spark, sf_dir), ["g"], "p", "bonferroni").select("o_orderkey", r6("q"))


@query(adjusted_sql("p * (n - i + 1)", "max(x) OVER (PARTITION BY g ORDER BY p, i ROWS UNBOUNDED PRECEDING)"))
def holm_adjust(spark, sf_dir):
    return W.adjust(pvalues(spark, sf_dir), ["g"], "p", "holm").select("o_orderkey", r6("q"))


@query(adjusted_sql("p * (n - i + 1)", BACK))
def hochberg_adjust(spark, sf_dir):
    return W.adjust(pvalues(spark, sf_dir), ["g"], "p", "hochberg").select("o_orderkey", r6("q"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2 AS rk FROM orders")
def avg_rank(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", W.rank_average(["o_orderpriority"], "o_custkey").alias("rk"))


@query(
    "WITH t AS (SELECT p_partkey, p_brand, -log10(1 / (1 + p_size)) AS a, -log10(1 / (1 + p_retailprice)) AS b FROM part), r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY a) + (count(*) OVER (PARTITION BY p_brand, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY p_brand ORDER BY b) + (count(*) OVER (PARTITION BY p_brand, b) - 1) / 2 AS rb FROM t) "
    "SELECT p_partkey, ra + rb AS score, row_number() OVER (PARTITION BY p_brand ORDER BY ra + rb DESC, a DESC, p_partkey) AS place FROM r"
)
def combined_rank(spark, sf_dir):
    t = read(spark, sf_dir, "part").select("p_partkey", "p_brand", (-F.log10(1 / (1 + F.col("p_size")))).alias("a"), (-F.log10(1 / (1 + F.col("p_retailprice")))).alias("b"))
    r = t.withColumn("score", W.rank_average(["p_brand"], "a") + W.rank_average(["p_brand"], "b"))
    w = Window.partitionBy("p_brand").orderBy(F.col("score").desc(), F.col("a").desc(), "p_partkey")
    return r.select("p_partkey", "score", F.row_number().over(w).cast("long").alias("place"))


@query(
    "WITH q AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS c FROM customer) SELECT c_custkey, 1 + len(list_filter(c, lambda x: x < c_acctbal)) AS class FROM customer, q"
)
def quantile_class(spark, sf_dir):
    return W.quantile_class(read(spark, sf_dir, "customer"), "c_acctbal", 4).select("c_custkey", "class")


@query("SELECT c_custkey, CASE WHEN k <= 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 10 THEN '4-10' ELSE '>10' END AS category FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer)")
def rank_category(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", W.rank_category(F.row_number().over(w)).alias("category"))


DAILY = "(SELECT o_orderpriority AS g, CAST(strftime(o_orderdate, '%m') AS BIGINT) AS pos, count(*) AS np, sum(o_custkey % 5) AS nn FROM orders GROUP BY ALL)"


@query(f"SELECT a.g, a.pos AS start, b.pos AS \"end\", CAST(sum(c.np) AS BIGINT) AS np, CAST(sum(c.nn) AS BIGINT) AS nn FROM {DAILY} a JOIN {DAILY} b ON a.g = b.g AND a.pos <= b.pos JOIN {DAILY} c ON c.g = a.g AND c.pos BETWEEN a.pos AND b.pos GROUP BY ALL")
def interval_scan(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.month("o_orderdate").cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("np"), F.sum(F.col("o_custkey") % 5).alias("nn"))
    return W.interval_scan(o, ["g"], "pos", ["np", "nn"])


@query("SELECT doc_id, length(text) AS size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def split_semi(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("size"))


@query("SELECT doc_id, length(text) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def split_anti(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", F.length("text").cast("long").alias("size"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def first_match(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return T.first_match(read(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey")


@query("SELECT a.s AS o_orderstatus, b.p AS o_orderpriority, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) b LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 7 = 0) o ON o.o_orderstatus = a.s AND o.o_orderpriority = b.p GROUP BY ALL")
def full_grid(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.when(F.col("o_custkey") % 7 == 0, 1)).alias("n"))
    return T.full_grid(n, "o_orderstatus", "o_orderpriority", "n")


@query("SELECT c_mktsegment, c_nationkey, n, round(n / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS share, round(sum(n) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS cum FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL)")
def share_table(spark, sf_dir):
    return T.shares(read(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey").select("c_mktsegment", "c_nationkey", "n", r6("share"), r6("cum"))


@query("WITH d AS (SELECT DISTINCT o_custkey AS i, o_orderpriority AS c FROM orders), t AS (SELECT c, count(*) AS t FROM d GROUP BY c), b AS (SELECT x.c AS c1, y.c AS c2, count(*) AS common FROM d x JOIN d y ON x.i = y.i GROUP BY ALL) SELECT a.c AS c1, z.c AS c2, coalesce(common, 0) AS common, round(coalesce(common, 0) / (a.t + z.t - coalesce(common, 0)), 6) AS jaccard FROM t a CROSS JOIN t z LEFT JOIN b ON b.c1 = a.c AND b.c2 = z.c")
def jaccard_table(spark, sf_dir):
    return T.jaccard_table(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority").select("c1", "c2", F.col("both").alias("common"), r6("jaccard"))


@query("WITH r AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*) AS po, sum(CASE WHEN a = 1 THEN 1.0 ELSE 0 END) / count(*) AS pa, sum(CASE WHEN b = 1 THEN 1.0 ELSE 0 END) / count(*) AS pb FROM r) SELECT n, round(po, 6) AS agreement, round(pa * pb + (1 - pa) * (1 - pb), 6) AS expected, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM t")
def cohen_kappa(spark, sf_dir):
    return T.cohen_kappa(read(spark, sf_dir, "labels"), "quality", "toxic").select("n", r6("agreement"), r6("expected"), r6("kappa"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_returnflag = 'R') SELECT count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS common, count(*) AS total, round(count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.x = b.x")
def name_jaccard(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return T.name_overlap(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), "l_partkey").select("common", "total", r6("jaccard"))


@query("WITH e AS (SELECT p_type AS m, trim(unnest(string_split(p_name, ' '))) AS category FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD')), n AS (SELECT category, count(*) FILTER (m = 'ECONOMY') AS a, count(*) FILTER (m = 'PROMO') AS b, count(*) FILTER (m = 'STANDARD') AS c FROM e GROUP BY category), k AS (SELECT * FROM n WHERE (CASE WHEN a > 0 THEN 1 ELSE 0 END) + (CASE WHEN b > 0 THEN 1 ELSE 0 END) + (CASE WHEN c > 0 THEN 1 ELSE 0 END) >= 2) SELECT category, round(a / sum(a) OVER (), 6) AS economy, round(b / sum(b) OVER (), 6) AS promo, round(c / sum(c) OVER (), 6) AS standard FROM k")
def category_table(spark, sf_dir):
    kinds = ["ECONOMY", "PROMO", "STANDARD"]
    t = T.category_table(read(spark, sf_dir, "part").filter(F.col("p_type").isin(kinds)), "p_type", "p_name", " ", kinds)
    return t.select("category", *[r6(k, k.lower()) for k in kinds])


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 5")
def top_n_best(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return read(spark, sf_dir, "customer").withColumn("k", F.row_number().over(w)).filter("k <= 5").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY o_custkey")
def distinct_in_years(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter(F.year("o_orderdate").between(1996, 1998))
    return o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("SELECT doc_id FROM documents WHERE NOT contains(text, 'N') AND text IS NOT NULL")
def without_n(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(~F.col("text").contains("N")).select("doc_id")


CURVE = "(SELECT p_brand AS g, cast(p_size AS DOUBLE) AS x, min(p_retailprice) AS y FROM part GROUP BY ALL)"


@query(
    f"WITH c AS {CURVE}, p AS (SELECT p_partkey, p_brand AS g, p_retailprice / 40 AS x FROM part), m AS (SELECT p.p_partkey, p.x, (SELECT max_by(struct_pack(x := c.x, y := c.y), c.x) FROM c WHERE c.g = p.g AND c.x <= p.x) AS lo, (SELECT min_by(struct_pack(x := c.x, y := c.y), c.x) FROM c WHERE c.g = p.g AND c.x >= p.x) AS hi FROM p) "
    "SELECT p_partkey, round(CASE WHEN lo IS NULL THEN hi.y WHEN hi IS NULL OR hi.x = lo.x THEN lo.y ELSE lo.y + (hi.y - lo.y) / (hi.x - lo.x) * (x - lo.x) END, 6) AS y FROM m"
)
def asof_pvalue(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    curve = p.groupBy(F.col("p_brand").alias("g"), F.col("p_size").cast("double").alias("x")).agg(F.min("p_retailprice").alias("y"))
    points = p.select("p_partkey", F.col("p_brand").alias("g"), (F.col("p_retailprice") / 40).alias("x"))
    return T.asof_interpolated(points, curve, "x", "y", ["g"]).select("p_partkey", r6("y"))


BINOM = "(SELECT DISTINCT l_linenumber AS x, 10 + l_suppkey % 5 AS n, 0.05 + (l_partkey % 9) / 10 AS p FROM lineitem)"


@query(
    f"SELECT x, n, round(p, 2) AS p, round(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))), 6) AS upper FROM (SELECT x, n, p, unnest(range(x, n + 1)) AS k FROM {BINOM}) GROUP BY x, n, p"
)
def binomial_test(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_linenumber").alias("x"), (10 + F.col("l_suppkey") % 5).alias("n"), (0.05 + F.col("l_partkey") % 9 / 10).alias("p")).distinct()
    return t.select("x", "n", F.round("p", 2).alias("p"), r6(binomial_test_udf("x", "n", "p", F.lit("upper")), "upper"))


def erf_sql(x: str) -> str:
    """SQL for the error function, by a series of positive terms (it is 1 to the last digit beyond 6)."""
    y = f"greatest(least(abs({x}), 6), 1e-150)"
    return f"(sign({x}) * 2 / sqrt(pi()) * list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln({y}) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2) - {y} * {y}))))"


@query(f"SELECT p_partkey, round(({erf_sql('(p_size / 10.0 + 1.5) / 2.0')} - {erf_sql('(p_size / 10.0 - 1.5) / 2.0')}) / 2, 6) AS mass FROM part")
def erf_integral(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", r6(gauss_mass_udf(F.col("p_size") / 10.0, F.lit(1.5), F.lit(2.0)), "mass"))


@query(
    "WITH t AS (SELECT o_orderpriority AS g, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 2 = 0) AS a, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 2 = 1) AS b, count(*) FILTER (o_orderstatus <> 'F' AND o_custkey % 2 = 0) AS c, count(*) FILTER (o_orderstatus <> 'F' AND o_custkey % 2 = 1) AS d FROM orders GROUP BY 1), "
    "k AS (SELECT *, unnest(range(a, least(a + b, a + c) + 1)) AS k FROM t) SELECT g, a, b, c, d, round(sum(exp(lgamma(a + c + 1) - lgamma(k + 1) - lgamma(a + c - k + 1) + lgamma(b + d + 1) - lgamma(a + b - k + 1) - lgamma(b + d - a - b + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1))), 6) AS p FROM k GROUP BY g, a, b, c, d"
)
def fisher_test(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    f, even = F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0
    t = o.groupBy(F.col("o_orderpriority").alias("g")).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("a", f & even), ("b", f & ~even), ("c", ~f & even), ("d", ~f & ~even))])
    return t.select("g", "a", "b", "c", "d", r6(fisher_udf("a", "b", "c", "d"), "p"))


@query("SELECT n, round(n * ln(f / n) + 2 * (3 + 1), 6) AS aic FROM (SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) / 1000 AS f FROM orders GROUP BY 1)")
def aic(spark, sf_dir):
    """The information criterion of a residual sum over n points with three parameters."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (F.sum("o_totalprice") / 1000).alias("f"))
    return o.select("n", r6(A.aic(F.col("f"), F.col("n"), 3), "aic"))


@query("SELECT DISTINCT n, k, CASE WHEN k < 0 THEN 0.0 ELSE round(list_product(list_transform(range(1, k + 1), lambda i: (n - i + 1) / i) || [1.0]), 6) END AS c FROM (SELECT l_suppkey % 11 - 5 AS n, l_linenumber - 1 AS k FROM lineitem)")
def binomial_coefficient(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 11 - 5).cast("long").alias("n"), (F.col("l_linenumber") - 1).cast("long").alias("k")).distinct()
    return li.select("n", "k", r6(A.choose(F.col("n"), F.col("k")), "c"))


ORDERED_D = "list_sort(list_transform(range(0, len(d)), lambda i: struct_pack(x := d[i + 1], i := i)))"


@query(f"SELECT l_orderkey, {_all(f'list_transform({ORDERED_D}, lambda s: s.i)')} AS places, list_sort(d) = d AS is_sorted FROM {LINES}")
def sort_index(spark, sf_dir):
    """Places of the elements in sorted order (ties by place), and whether a vector is sorted."""
    v = vectors(spark, sf_dir)
    return v.select("l_orderkey", show(A.order("d")).alias("places"), A.is_sorted("d").alias("is_sorted"))


SIGNED = "(SELECT l_suppkey, l_tax - l_discount AS d FROM lineitem)"


@query(
    f"WITH r AS (SELECT l_suppkey, d, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_suppkey, abs(d)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY l_suppkey, abs(d)) AS t FROM {SIGNED} WHERE d <> 0), "
    "g AS (SELECT l_suppkey, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS v, sum(t * t - 1) AS ties FROM r GROUP BY l_suppkey), z AS (SELECT *, v - n * (n + 1) / 4 AS z, n * (n + 1) * (2 * n + 1) / 24 - ties / 48 AS var FROM g), "
    "c AS (SELECT l_suppkey, v, abs((z - sign(z) * 0.5) / sqrt(var)) AS z FROM z) "
    f"SELECT l_suppkey, v, round(least(1, 1 - {erf_sql('z / sqrt(2)')}), 6) AS p FROM c"
)
def wilcoxon_test(spark, sf_dir):
    """Paired signed-rank test of prices against scaled quantities in each supplier's lines."""
    import pandas as pd

    from strandlake.functions.stats import wilcoxon_signed_rank

    def test(pdf):
        v, p = wilcoxon_signed_rank(list(zip(pdf["l_tax"], pdf["l_discount"])))
        return pd.DataFrame({"l_suppkey": [pdf["l_suppkey"].iloc[0]], "v": [v], "p": [p]})

    tested = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_tax", "l_discount").groupBy("l_suppkey").applyInPandas(test, "l_suppkey long, v double, p double")
    return tested.select("l_suppkey", "v", r6("p"))
