import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.operators import elements as E
from strandlake.operators import genotypes as G
from strandlake.operators import intervals as I
from strandlake.operators import transcripts as X

BED = "chrom string, start long, end long, i long"


def intervals(spark, seed, n=60):
    r = random.Random(seed)
    return [(r.choice("ab"), s, s + r.randint(0, 12), i) for i in range(n) for s in [r.randint(0, 150)]]


@pytest.mark.parametrize("width", [4, 64])
def test_overlaps_match_brute_force(spark, width):
    a, b = intervals(spark, 1), intervals(spark, 2)
    da, db = spark.createDataFrame(a, BED), spark.createDataFrame(b, BED)
    got = sorted((r["a_i"], r["b_i"]) for r in I.overlapping(da, db, width).collect())
    meet = lambda x, y: x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]
    assert got == sorted((x[3], y[3]) for x in a for y in b if meet(x, y))
    apart = {r["i"] for r in I.excluding(da, db, width).collect()}
    assert apart == {x[3] for x in a if not any(meet(x, y) for y in b)}


def test_first_come_matches_a_scan(spark):
    a = intervals(spark, 3)
    kept = []
    for x in a:
        if not any(x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2] for y in kept):
            kept.append(x)
    assert {r["i"] for r in I.first_come(spark.createDataFrame(a, BED), "i").collect()} == {x[3] for x in kept}


def test_background_is_matched_and_apart(spark):
    r = random.Random(4)
    rows = [("c", i * 50, i * 50 + 20, "".join(r.choice("ACGTac") for _ in range(20))) for i in range(300)]
    schema = "chrom string, start long, end long, seq string"
    chosen, rest = spark.createDataFrame(rows[:30], schema), spark.createDataFrame(rows[30:], schema)
    out = I.background(chosen, spark.createDataFrame(rows[30:40], schema), rest).collect()
    assert out and len(out) <= 30 and not {x["start"] for x in out} & {x[1] for x in rows[:40]}


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_variations_against_edited_text(spark, data):
    text = data.draw(st.text("ACGT", min_size=12, max_size=30))
    at = sorted(data.draw(st.lists(st.integers(0, len(text) - 3), max_size=3, unique_by=lambda x: x // 4)))
    vs, out, pos = [], [], 0
    for p in at:
        kind = data.draw(st.sampled_from("SID"))
        if p < pos:
            continue
        out.append(text[pos:p])
        if kind == "S":
            vs.append(("S", p, p + 2, "NN"))
            out.append("NN")
            pos = p + 2
        elif kind == "I":
            vs.append(("I", p, p, "GGG"))
            out.append("GGG")
            pos = p
        else:
            vs.append(("D", p, p + 2, ""))
            pos = p + 2
    out.append(text[pos:])
    df = spark.createDataFrame([(text, vs)], f"s string, v array<{E.VARIATION}>")
    assert df.select(E.varied(F.col("s"), F.lit(0), F.col("v"))).first()[0] == "".join(out)


def test_positions_go_and_return(spark):
    df = spark.createDataFrame([(10, 20, True), (10, 20, False)], "s long, e long, f boolean").crossJoin(spark.range(10))
    at = E.to_reference(F.col("id"), F.col("s"), F.col("e"), F.col("f"))
    assert df.filter(E.to_element(at, F.col("s"), F.col("e"), F.col("f")) != F.col("id")).count() == 0


TX = "tx_id long, ref string, exon_starts array<long>, exon_ends array<long>, forward boolean, cds_start long, cds_end long"


def test_transcript_positions(spark):
    t = spark.createDataFrame([(1, "r", [0, 20], [10, 30], True, 5, 26), (2, "r", [0, 20], [10, 30], False, 5, 26), (3, "r", [0], [9], True, None, None)], TX)
    e = X.exons(t)
    n = {r["tx_id"]: r.asDict() for r in X.lengths(e).collect()}
    assert (n[1]["utr5"], n[1]["cds"], n[1]["utr3"], n[1]["mrna"], n[1]["premrna"]) == (5, 11, 4, 20, 30)
    assert (n[2]["utr5"], n[2]["cds"], n[2]["utr3"]) == (4, 11, 5) and n[3]["cds"] is None
    p = spark.createDataFrame([(1, 4), (1, 5), (1, 15), (1, 25), (1, 26)], "tx_id long, pos long")
    kinds = {r["pos"]: (r["kind"], r["cds"]) for r in X.on_mrna(p, e).collect()}
    assert kinds == {4: ("utr5", -1), 5: ("cds", 0), 15: ("intron", None), 25: ("cds", 10), 26: ("utr3", 11)}
    back = X.from_cds(spark.createDataFrame([(1, 10), (1, 99)], "tx_id long, cds long"), e)
    assert {r["cds"]: r["pos"] for r in back.collect()} == {10: 25, 99: None}


def test_empty_coding_region_is_an_error(spark):
    t = spark.createDataFrame([(1, "r", [0], [10], True, 5, 5)], TX)
    with pytest.raises(Exception, match="empty coding region"):
        X.checked(t).collect()


def test_merged_alleles_are_remapped(spark):
    g = "interval string, pos long, subject string, a1 int, a2 int, phased boolean"
    v = "interval string, pos long, alleles array<string>"
    a, va = spark.createDataFrame([("c", 1, "x", 0, 1, True)], g), spark.createDataFrame([("c", 1, ["A", "G"])], v)
    b, vb = spark.createDataFrame([("c", 1, "y", 1, None, False)], g), spark.createDataFrame([("c", 1, ["A", "T"]), ("c", 5, ["C", "G"])], v)
    covered = spark.createDataFrame([("x", "c", 0, 9), ("y", "c", 0, 3)], "subject string, interval string, start long, end long")
    got, vs = G.merge(a, va, b, vb, covered)
    calls = {(r["pos"], r["subject"]): (r["a1"], r["a2"]) for r in got.collect()}
    assert calls == {(1, "x"): (0, 1), (1, "y"): (2, None), (5, "x"): (0, 0)}
    assert {r["pos"]: r["alleles"] for r in vs.collect()} == {1: ["A", "G", "T"], 5: ["C", "G"]}
    with pytest.raises(Exception, match="different reference"):
        G.merge_variants(va, spark.createDataFrame([("c", 1, ["T", "A"])], v)).collect()


def test_chains_are_numbered_alike_whatever_the_bins(spark):
    import random

    rng = random.Random(5)
    rows = [(c, s, s + rng.choice([0, 1, 3, 8, 40]), i) for i, (c, s) in enumerate((rng.choice(["x", "y", None]), rng.randrange(400)) for _ in range(120))]
    for touching in (True, False):
        want, seen = {}, {}
        for c, s, e, i in sorted(rows, key=lambda r: r[1:3]):
            n, reach = seen.get(c, (0, -1))
            n += reach < 0 or (s > reach if touching else s >= reach)
            seen[c], want[i] = (n, max(reach, e)), n
        for width in (7, 64, 1 << 14):
            got = I.clusters(spark.createDataFrame(rows, "chrom string, start long, end long, i int"), touching, width)
            assert got.columns == ["chrom", "start", "end", "i", "cluster"]
            assert {r["i"]: r["cluster"] for r in got.collect()} == want
    assert I.clusters(spark.createDataFrame([], "chrom string, start long, end long")).count() == 0


def test_chains_hold_whichever_side_of_a_join_is_broadcast(spark, monkeypatch):
    """Spark broadcasts the rows where their shuffle ends first, and hands equal ones back in another order."""
    rows = [(c, s, s + 2, i) for i, (c, s) in enumerate((c, 5 * (k % 40)) for k in range(200) for c in "xy")]
    df = spark.createDataFrame(rows, BED)
    join = type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, *args: join(self.hint("broadcast"), *args))
    got = I.clusters(df).groupBy("chrom", "start").agg(F.countDistinct("cluster").alias("n"), F.min("cluster").alias("c")).collect()
    assert {(r["chrom"], r["start"]): (r["n"], r["c"]) for r in got} == {(c, 5 * k): (1, k + 1) for k in range(40) for c in "xy"}
    assert sorted(map(tuple, I.merged(df, True).collect())) == [(c, 5 * k, 5 * k + 2) for c in "xy" for k in range(40)]


@pytest.mark.parametrize("shift", ["0", "INTERVAL 700000 HOUR"])
def test_interval_merge_and_its_sql_on_odd_events(spark, tmp_path, shift):
    from strandlake import plans

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # ties of equal spans are open between threads
    odd = "CASE WHEN i % 11 = 0 THEN NULL WHEN i % 3 = 0 THEN -3.5 ELSE i % 8 END"
    con.execute(
        f"COPY (SELECT i AS event_id, CASE WHEN i % 17 <> 0 THEN TIMESTAMP '2024-01-01 00:00:07.3' {'' if shift == '0' else '- ' + shift} + to_seconds(i * 7919 % 1000 // 2 * 300) END AS ts, i AS user_id, "
        f"CASE i % 4 WHEN 0 THEN NULL WHEN 1 THEN 'late' ELSE 'b' END AS event_type, CAST({odd} AS DOUBLE) AS value, '' AS props FROM range(1, 1500) t(i) "
        f"UNION ALL SELECT -i, TIMESTAMP '1960-01-01 00:00:05' + to_seconds(i // 2 * 600), i, 'first', CAST(CASE WHEN i > 3 THEN -3.5 END AS DOUBLE), '' FROM range(12) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)"
    )
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(plans.oracle_sql()["interval_merge"]).fetchall()
    got = [tuple(r) for r in plans.queries()["interval_merge"](spark, str(tmp_path)).collect()]
    assert len(want) > 100 and sorted(got, key=repr) == sorted(want, key=repr)


def test_first_come_keeps_intervals_without_a_bound(spark):
    rows = [("a", 0, 5, 0), ("a", 3, None, 1), ("a", 4, 6, 2), ("a", None, 9, 3), ("a", 7, 8, 4), ("a", None, None, 5), (None, 1, 2, 6)]
    assert {r["i"] for r in I.first_come(spark.createDataFrame(rows, BED), "i").collect()} == {0, 1, 3, 4, 5, 6}
