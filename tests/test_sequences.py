from math import sqrt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import counting as C
from strandlake.operators import similarity as M
from strandlake.operators import windows as W
from strandlake.operators.space import KmerSpace, dictionary


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")


def as_dict(df, value):
    return {r["kmer"]: r[value] for r in df.collect()}


def test_counts_of_a_micro_sequence(spark):
    assert as_dict(C.count(seqs(spark, "ACGTA"), KmerSpace(2)), "n") == {"AC": 1, "CG": 1, "GT": 1, "TA": 1}
    both = C.distribution(seqs(spark, "ACGTA"), KmerSpace(2, 0, True))
    assert as_dict(both, "w") == pytest.approx({"AC": sqrt(0.5), "CG": 0.5, "TA": 0.5})


def test_words_never_span_other_characters(spark):
    assert as_dict(C.count(seqs(spark, "ACNGT"), KmerSpace(2)), "n") == {"AC": 1, "GT": 1}
    assert C.count(seqs(spark, "AC"), KmerSpace(3)).count() == 0
    with pytest.raises(Exception, match="invalid character"):
        C.count(seqs(spark, "ACNGT"), KmerSpace(2), strict=True).collect()


def test_dictionary_sizes(spark):
    assert KmerSpace(2).size == 16 and KmerSpace(2, 0, True).size == 10
    assert KmerSpace(8, 2, True).size == 57472
    for space in (KmerSpace(3), KmerSpace(4, 0, True), KmerSpace(4, 2), KmerSpace(4, 2, True), KmerSpace(5, 1, True)):
        assert dictionary(spark, space).count() == space.size


def test_gapped_counts_are_masks_times_plain_ones(spark):
    s = seqs(spark, "ACGTTGCAAC", "NNACGTACGTNNAC")
    plain = C.count(s, KmerSpace(4)).agg(F.sum("n")).first()[0]
    for ds in (False, True):
        assert C.count(s, KmerSpace(4, 2, ds)).agg(F.sum("n")).first()[0] == 6 * plain


def test_long_runs_are_counted_across_pieces(spark):
    text = "ACGTTGCAAC" * 500
    assert C.count(seqs(spark, text), KmerSpace(5)).agg(F.sum("n")).first()[0] == len(text) - 4


def test_both_strands_give_equal_distributions(spark):
    text = "ACGTTGCAACGGT"
    other = S.reverse_complement("seq")
    a, b = seqs(spark, text), seqs(spark, text).select("seq_id", other.alias("seq"))
    for space in (KmerSpace(3, 0, True), KmerSpace(4, 2, True)):
        assert as_dict(C.distribution(a, space), "w") == pytest.approx(as_dict(C.distribution(b, space), "w"))


def test_similarity_and_distance(spark):
    d = C.distribution(seqs(spark, "ACGTACG", "TTTTTT", "ACGTTT"), KmerSpace(2))
    s = {(r["a"], r["b"]): r["s"] for r in M.similarity(d, d).collect()}
    assert all(abs(s[i, i] - 1) < 1e-12 for i in range(3)) and all(0 <= x <= 1 + 1e-12 for x in s.values())
    t = {(r["a"], r["b"]): r["d"] for r in M.distance(d, d).collect()}
    assert t[0, 1] == 1 and t[0, 0] == pytest.approx(0, abs=1e-7) and t[0, 2] == t[2, 0]
    b = {(r["a"], r["b"]): r["d"] for r in M.distance(d, d, True).collect()}
    assert b[0, 1] == max(b.values())


def test_weights_have_unit_length(spark):
    d = C.distribution(seqs(spark, "ACGTACGGGT", "CCCC"), KmerSpace(3, 1))
    assert all(abs(r[1] - 1) < 1e-12 for r in d.groupBy("seq_id").agg(F.sum(F.col("w") * F.col("w"))).collect())


@settings(max_examples=10, deadline=None)
@given(st.text("ACGTN", min_size=0, max_size=40))
def test_window_profiles_match_brute_force(spark, text):
    win, l = 7, 3  # noqa: E741
    got = {(r["start"], r["kmer"]): r["n"] for r in W.profile_counts(seqs(spark, text), win, KmerSpace(l)).collect()}
    want = {}
    for start in range(len(text) - win + 1):
        for i in range(start, start + win - l + 1):
            k = text[i : i + l]
            if set(k) <= set("ACGT"):
                want[start + 1, k] = want.get((start + 1, k), 0) + 1
    assert got == want


def test_estimates_follow_the_mismatch_weights(spark):
    from math import comb

    import numpy as np

    l, gaps = 4, 2  # noqa: E741
    k = l - gaps
    neg = lambda n, j: (-1) ** j * comb(n + j - 1, j)
    w = [sum(comb(l, n) * 3**n for n in range(k - j + 1)) * neg(gaps, j) / (4**l * comb(l, k) * comb(k, j)) for j in range(k + 1)]
    rng = np.random.default_rng(1)
    v = rng.random(4**l)
    words = np.stack([np.arange(4**l) // 4**p % 4 for p in range(l)])
    dist = (words[:, :, None] != words[:, None, :]).sum(axis=0)
    g = np.array([sum(comb(d, j) * comb(l - d, k - j) * w[j] for j in range(k + 1) if k - j <= l - d) for d in range(l + 1)])
    assert np.allclose(C.project(v, l, k), g[dist] @ v)


def test_spaces_have_to_agree(spark):
    d = C.distribution(seqs(spark, "ACGT"), KmerSpace(2))
    with pytest.raises(ValueError):
        C.merge(d, d, KmerSpace(2), KmerSpace(2, 0, True))
    with pytest.raises(ValueError):
        KmerSpace(1)


def test_translation(spark):
    row = seqs(spark, "ATGTGATAAAGNAC").select(S.translate_codons("seq").alias("a"), S.translate_codons("seq", code=S.MITOCHONDRIAL_CODE).alias("m"), S.translate_codons(F.lit("AT")).alias("s")).first()
    assert tuple(row) == ("M**X", "MW*X", "")


def test_both_ways_to_features_agree(spark, monkeypatch):
    d = C.distribution(seqs(spark, "ACGTACG", "TTTTTT", "ACGTTT", "NN", "GGGG"), KmerSpace(2))
    m = C.distribution(seqs(spark, "ACGT", "TTTA"), KmerSpace(2))
    found = lambda: {(r["seq_id"], r["motif_id"]): r["bc"] for r in M.features(d, m).collect()}
    one = found()
    monkeypatch.setattr(M, "MATRIX_CELLS", 0)
    assert one == pytest.approx(found()) and (4, 0) not in one
