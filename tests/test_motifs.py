import itertools
import os

import numpy as np
import pytest

from strandlake.operators import clustering as K
from strandlake.operators import counting as C
from strandlake.operators import factorization as N
from strandlake.operators import pwm as P
from strandlake.operators.similarity import distance
from strandlake.operators.space import KmerSpace


def points(seed=0, n=9):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("method,join", [("single", min), ("complete", max), ("average", lambda v: sum(v) / len(v))])
def test_linkage_matches_brute_force(method, join):
    d = points()
    groups, heights = [{i} for i in range(len(d))], []
    while len(groups) > 1:
        h, a, b = min((join([d[i, j] for i in x for j in y]), k, m) for (k, x), (m, y) in itertools.combinations(enumerate(groups), 2))
        heights.append(h)
        groups[a] |= groups[b]
        del groups[b]
    assert np.allclose([h for _, _, h in K.linkage(d, method)], heights)


def test_cuts_have_the_wanted_number_of_clusters():
    d = points(1)
    for method in K.METHODS:
        for k in (1, 3, 9):
            assert len(set(K.cut(K.linkage(d, method), len(d), k))) == k


def test_silhouettes_agree(spark):
    d, labels = points(2), [0, 0, 1, 1, 1, 2, 2, 2, 3]
    rows = [(i, j, float(d[i, j])) for i in range(9) for j in range(9)]
    got = {r["cluster"]: r["s"] for r in K.cluster_silhouette(spark.createDataFrame(rows, "a long, b long, d double"), spark.createDataFrame(list(enumerate(labels)), "id long, cluster int")).collect()}
    assert [got[c] for c in range(4)] == pytest.approx(K._silhouettes(d, labels)) and got[3] == 0


def family(spark):
    texts = ["ACACACACAC", "ACACACACAA", "GTGGTGGTGG", "GTGGTGGTGC", "TTTTATTTTA", "TTTTATTTTC"]
    return C.distribution(spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string"), KmerSpace(2))


def test_rank_and_initial_motifs(spark):
    d = family(spark)
    info = dict((k, s) for k, s, _ in K.rank_info(distance(d, d)))
    assert max(info, key=info.get) == 3
    assert K.initial_motifs(d, 2, 5).select("cluster").distinct().count() == 3


@pytest.mark.parametrize("init,columns", [("random", 0), ("nndsvd", 0), ("cluster", 0), ("random", 4)])
def test_factorisation_is_non_negative_and_improves(spark, init, columns):
    d = family(spark)
    m = N.factorise(d, 3, columns, init, max_iter=12, seed=1)
    assert (m.w >= 0).all() and np.linalg.norm(m.w, 2) == pytest.approx(1)
    again = N.factorise(d, 3, columns, init, max_iter=12, seed=1)
    assert np.allclose(m.w, again.w)
    if not columns:
        rows = d.toPandas().pivot(index="kmer", columns="seq_id", values="w").fillna(0).loc[m.words].to_numpy()
        err = lambda w: np.linalg.norm(rows - w @ (w.T @ rows))
        assert err(m.w) < err(N.factorise(d, 3, columns, init, max_iter=1, seed=1).w) + 1e-9


def test_leading_pairs_equal_those_of_the_whole_matrix():
    rng = np.random.default_rng(2)
    v = rng.random((60, 5)) @ rng.random((5, 90)) + 0.01 * rng.random((60, 90))
    gram = v @ v.T
    u, s = N.leading(lambda x: gram @ x, 60, 4, np.random.default_rng(0))
    values, vectors = np.linalg.eigh(gram)
    assert np.allclose(s, values[::-1][:4], rtol=1e-6)
    assert np.allclose(np.abs((u * vectors[:, ::-1][:, :4]).sum(axis=0)), 1, atol=1e-6)


def test_product_sums_over_sequences_and_refuses_what_no_task_can_hold(spark):
    d = family(spark)
    rows = d.toPandas().pivot(index="kmer", columns="seq_id", values="w").fillna(0)
    packed, w = N._packed(d, {k: i for i, k in enumerate(rows.index)}), np.random.default_rng(1).random((len(rows), 3))
    assert np.allclose(N.product(packed, w), rows.to_numpy() @ (rows.to_numpy().T @ w))
    with pytest.raises(ValueError):
        N.product(packed, np.broadcast_to(0.0, (N.MAX_CELLS, 2)))


MATRIX = [(f"m{k}", i + 1, *p) for k in range(2) for i, p in enumerate([(0.7, 0.1, 0.1, 0.1), (0.1, 0.2, 0.6, 0.1), (0.25, 0.25, 0.25, 0.25)])]


def matrices(spark):
    return spark.createDataFrame(MATRIX, "name string, pos int, a double, c double, g double, t double")


def test_scan_of_both_strands(spark):
    s = spark.createDataFrame([(0, "ACGTNAC"), (1, "AC")], "seq_id long, seq string")
    score = {r["pos"]: r["score"] for r in P.scores(s, matrices(spark).filter("name = 'm0'"), True).collect()}
    assert score == pytest.approx({1: 0.7 * 0.2 * 0.25, 2: 0.1 * 0.6 * 0.25})
    both = {r["pos"]: r["score"] for r in P.scores(s, matrices(spark).filter("name = 'm0'"), True, True).collect()}
    assert both[2] == pytest.approx(max(0.1 * 0.6 * 0.25, 0.7 * 0.2 * 0.25))


def test_score_distribution_matches_enumeration():
    cols = [[0.5, -1.0, 0.25, -0.5], [1.0, 0.0, -1.0, 0.5], [0.0, 0.25, 0.5, -0.25]]
    scores = [sum(c[b] for c, b in zip(cols, w)) for w in itertools.product(range(4), repeat=3)]
    for s, p in P.distribution(cols, granularity=0.25):
        assert p == pytest.approx(sum(x >= s - 1e-9 for x in scores) / 64)
    t, p = P.threshold(cols, 0.1)
    assert p <= 0.1 and P.p_value(cols, -9) == 1 and P.p_value(cols, 9) == 0


def test_motif_of_a_matrix_and_back(spark):
    w = {r["kmer"]: r["w"] for r in P.motifs(matrices(spark).filter("name = 'm0'"), KmerSpace(2)).collect()}
    assert sum(x * x for x in w.values()) == pytest.approx(1) and len(w) == 16
    m, bc = P.recover(w, [[0.3, 0.2, 0.3, 0.2], [0.2, 0.2, 0.4, 0.2], [0.25] * 4], 2)
    assert bc > 0.999 and m[0].argmax() == 0 and m[1].argmax() == 2
    with pytest.raises(ValueError):
        P.motifs(matrices(spark), KmerSpace(2), pad=2)
    with pytest.raises(ValueError):
        P.motifs(matrices(spark), KmerSpace(3, 1), best=True)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_motif_is_a_query(spark):
    from strandlake.plans import motifs as Q

    ids = {r[0] for r in Q.motifs(spark, SF).select("seq_id").distinct().collect()}
    pairs = Q.tom_match(spark, SF).select("query", "target").collect()
    assert {tuple(r) for r in pairs} == set(itertools.product(ids, ids)) and len(pairs) == len(ids) ** 2
    assert any(r["query"] % 2 for r in Q.tom_best_hit(spark, SF).collect())
