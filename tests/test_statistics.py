from math import comb

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import arrays as A
from strandlake.functions import stats as S
from strandlake.operators import windows as W
from strandlake.operators.models import best_threshold, lasso_cv, lasso_path, metrics


def exact(k, n, p):
    return comb(n, k) * p**k * (1 - p) ** (n - k)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 60), st.floats(0.01, 0.99))
def test_binomial_tails(n, x, p):
    x = min(x, n)
    up, low = sum(exact(k, n, p) for k in range(x, n + 1)), sum(exact(k, n, p) for k in range(x + 1))
    assert S.binomial_upper(x, n, p) == pytest.approx(up, rel=1e-9, abs=1e-12)
    assert S.binomial_lower(x, n, p) == pytest.approx(low, rel=1e-9, abs=1e-12)
    if x and x != int(n * p):
        bound = exact(x, n, p) * (1 + 1e-7)
        m = int(n * p)
        far = sum(exact(k, n, p) for k in (range(m, n + 1) if x < m else range(m + 1)) if exact(k, n, p) <= bound)
        assert S.binomial_test(x, n, p, "two") == pytest.approx(min(1, (low if x < m else up) + far), rel=1e-6, abs=1e-9)


def test_no_success_gives_one():
    assert all(S.binomial_test(0, 9, 0.3, t) == 1 for t in ("upper", "lower", "two"))


def test_large_counts_stay_finite():
    assert 0 < S.binomial_upper(501_000, 1_000_000, 0.5) < 0.05


def test_wilcoxon_by_hand():
    v, p = S.wilcoxon_signed_rank([(1.1, 0), (2.2, 0), (3.3, 0), (-4.4, 0), (5.5, 0)])
    assert v == 11 and p == pytest.approx(0.4375)


def test_fisher():
    odds, p = S.fisher_exact(3, 1, 1, 3)
    assert odds == 9 and p == pytest.approx(17 / 70)


def test_adjustment_by_hand(spark):
    df = spark.createDataFrame([(1, 0.01), (1, 0.04), (1, 0.03)], "g int, p double")
    q = {r["p"]: r["q"] for r in W.adjust(df, ["g"], "p").collect()}
    assert q == pytest.approx({0.01: 0.03, 0.04: 0.04, 0.03: 0.04})
    holm = {r["p"]: r["q"] for r in W.adjust(df, ["g"], "p", "holm").collect()}
    assert holm == pytest.approx({0.01: 0.03, 0.03: 0.06, 0.04: 0.06})


def test_interval_scan_size(spark):
    df = spark.createDataFrame([("m", i, i % 3) for i in range(1, 5)], "m string, pos int, n int")
    rows = {(r["start"], r["end"]): r["n"] for r in W.interval_scan(df, ["m"], "pos", ["n"]).collect()}
    assert len(rows) == 10 and rows[1, 4] == 4 and rows[2, 3] == 2


def test_sliding_windows_leave_edges_null(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "g int, i int, v double")
    got = [r["win_sum"] for r in W.sliding(df, ["g"], "i", "v", 3, 1).orderBy("i").collect()]
    assert got == [None, 3, 6, 9, None]


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, None, 3.0],)], "v array<double>")
    row = df.select(A.aggregate("v", "mean").alias("m"), A.aggregate("v", "mean", False).alias("s"), A.na_count("v").alias("n"), A.insert("v", 1, F.array(F.lit(9.0))).alias("i"), A.remove("v", 0, 2).alias("r"), A.match("v", F.array(F.lit(3.0), F.lit(1.0))).alias("k")).first()
    assert tuple(row) == (2.0, None, 1, [1.0, 9.0, None, 3.0], [3.0], [1, None, 0])


@pytest.mark.parametrize("a,b,union", [((0, 5), (5, 9), (0, 9)), ((0, 5), (6, 9), (0, 0)), ((3, 8), (1, 4), (1, 8))])
def test_interval_union(spark, a, b, union):
    s, e = A.union(*[F.lit(x) for x in (*a, *b)])
    assert tuple(spark.range(1).select(s, e).first()) == union


def test_conditions(spark):
    c = ~(A.Condition.of(5, 2) | A.Condition.of(8))
    got = {r["id"] for r in spark.range(16).filter(c.test("id")).collect()}
    assert got == {x for x in range(16) if not ((x & 5 == 5 and not x & 2) or x & 8)}


def test_curves_share_ties(spark):
    rows = [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    m = metrics(df).first()
    assert m["auroc"] == pytest.approx(0.875) and m["accuracy"] == pytest.approx(0.75)
    t = best_threshold(df).first()
    assert t["threshold"] == 0.5 and t["error"] == pytest.approx(0.25)


def test_lasso_finds_the_signal():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = (x[:, 1] + 0.2 * rng.normal(size=300) > 0).astype(float)
    coef, _, _, mean = lasso_path(x, y, np.arange(300) % 5, 15, 150)
    assert mean.max() > 0.95 and abs(coef).argmax() == 1


def test_lasso_on_the_cluster_equals_the_one_in_memory(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((150, 4)) * (rng.random((150, 4)) < 0.8)
    x[:, 3] = 0.5  # constant: no part in a model
    y = (x[:, 1] - x[:, 0] + 0.3 * rng.normal(size=150) > 0).astype(int)
    f = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(150) for j in range(4) if x[i, j]], "seq_id long, motif_id long, bc double")
    labels = spark.createDataFrame([(i, int(y[i]), i % 3) for i in range(150)], "seq_id long, y int, fold int")
    ids, coef, intercept, lam, mean = lasso_cv(f, labels, 6, 120)
    want, b, at, areas = lasso_path(x, y, np.arange(150) % 3, 6, 4000)
    assert ids == [0, 1, 2, 3] and coef[3] == 0
    assert lam == pytest.approx(at) and np.allclose(mean, areas, atol=2e-3)
    assert np.allclose(coef, want, atol=0.02) and intercept == pytest.approx(b, abs=0.02)
    with pytest.raises(ValueError):
        lasso_cv(f, labels.filter("y = 1"), 2, 2)
