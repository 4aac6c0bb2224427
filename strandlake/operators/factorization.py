"""Projective non-negative factorisation of distributions: V is near W (W'V).

V is a DataFrame (seq_id, kmer, w), never collected.  W is small (words by
motifs) and travels with each step; a step is one pass over V that returns
V (V'W), computed per sequence and summed by word before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.linalg import summed

EPS = 1e-12
MAX_WORDS = 1 << 20
#: Numbers of a matrix of words by motifs, which the driver and each task hold a few times over: 1 GB.
MAX_CELLS = 1 << 27
#: Columns beyond the rank and passes over the sequences of the search for the leading singular vectors.
EXTRA, PASSES = 10, 6


def _packed(v: DataFrame, index: dict) -> DataFrame:
    """(seq_id, at, w): one row a sequence, word numbers and weights."""
    spark = v.sparkSession
    words = spark.createDataFrame(list(index.items()), "kmer string, at int")
    return v.join(words, "kmer").groupBy("seq_id").agg(F.collect_list("at").alias("at"), F.collect_list("w").alias("w"))


def product(packed: DataFrame, w, fraction_key: int | None = None, np_columns: int = 0, total: int = 0):
    """V (V'W) as an array, over all sequences or a seeded choice of about ``np_columns`` of them."""
    import numpy as np

    if w.size > MAX_CELLS:
        raise ValueError(f"{w.shape[0]} words by {w.shape[1]} motifs are too many for a task")
    rows = packed
    if fraction_key is not None and total > np_columns:
        rows = packed.filter(F.pmod(F.xxhash64(F.lit(fraction_key), "seq_id"), F.lit(1 << 30)) < int((1 << 30) * np_columns / total))

    def add(out, batch):
        for at, x in zip(batch.column("at"), batch.column("w")):
            at, x = at.values.to_numpy(zero_copy_only=False), x.values.to_numpy(zero_copy_only=False)
            out[at] += np.outer(x, x @ w[at])  # a sequence holds a word once

    return summed(rows.select("at", "w"), w.shape, add)


def update(w, n, sigma=None):
    """One multiplicative step; the result is scaled to unit spectral norm."""
    import numpy as np

    d = w @ (w.T @ n) + n @ (w.T @ w) + EPS
    if sigma is not None:
        d = d + w / sigma
    new = w * (n / d)
    return new / max(np.linalg.norm(new, 2), EPS)


def leading(times, words: int, rank: int, rng):
    """(vectors, values) of the ``rank`` leading eigenpairs of a symmetric matrix V V' given as ``times(x)`` = V (V'x).

    Subspace iteration from random columns: only words by a few more than
    ``rank`` numbers are held, never words by words.
    """
    import numpy as np

    size = min(words, rank + EXTRA)
    q, _ = np.linalg.qr(rng.standard_normal((words, size)))
    for _ in range(PASSES if size < words else 0):
        q, _ = np.linalg.qr(times(q))
    values, turn = np.linalg.eigh(q.T @ times(q))
    order = np.argsort(-values, kind="stable")[:rank]
    return q @ turn[:, order], np.maximum(values[order], 0)


def nndsvd(u, s, rank: int, fill: float = 0.0):
    """Start from the signed parts of the leading eigenpairs (u, s) of a symmetric matrix: the larger part of each vector."""
    import numpy as np

    w = np.zeros((u.shape[0], rank))
    w[:, 0] = np.sqrt(s[0]) * np.abs(u[:, 0])
    for j in range(1, min(rank, len(s))):
        plus, minus = np.maximum(u[:, j], 0), np.maximum(-u[:, j], 0)
        side = plus if np.linalg.norm(plus) >= np.linalg.norm(minus) else minus
        w[:, j] = np.sqrt(s[j]) * side
    w[w < EPS] = fill
    return w


class Motifs:
    """Result of a factorisation: words, W (words by motifs), steps taken."""

    def __init__(self, words: list[str], w, steps: int):
        self.words, self.w, self.steps = words, w, steps

    def frame(self, spark) -> DataFrame:
        """(motif_id, kmer, w), each motif scaled to a distribution's root; zeros left out."""
        rows = [(int(j), self.words[i], float(self.w[i, j])) for i, j in zip(*self.w.nonzero())]
        df = spark.createDataFrame(rows, "motif_id long, kmer string, x double")
        from pyspark.sql import Window

        return df.select("motif_id", "kmer", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("motif_id")))).alias("w"))


def factorise(v: DataFrame, rank: int, np_columns: int = 0, init: str = "random", w0=None, tolerance: float = 1e-6, max_iter: int = 200, seed: int = 0, ard: bool | None = None) -> Motifs:
    """Factorise (seq_id, kmer, w).

    ``np_columns`` 0 uses all sequences each step; else a step adds the product
    over about so many hashed sequences to a running sum (online form).  Rank 0
    starts with half as many motifs as there are sequences and words allow and
    prunes them by their relevance.  ``init``: random, nndsvd, cluster (W0 by
    ``clustering``) or custom with ``w0`` (words by motifs, words sorted).
    """
    import numpy as np

    words = [r["kmer"] for r in v.select("kmer").distinct().limit(MAX_WORDS + 1).collect()]  # the dictionary
    if len(words) > MAX_WORDS:
        raise ValueError("the dictionary is too large to factorise")
    words.sort()
    ard = rank == 0 if ard is None else ard
    total = v.select("seq_id").distinct().count()
    rank = rank or max(1, min(total, len(words)) // 2)
    packed = _packed(v, {k: i for i, k in enumerate(words)}).cache()
    rng = np.random.default_rng(seed)
    if init == "custom":
        if w0 is None or w0.shape[0] != len(words):
            raise ValueError(f"W0 needs {len(words)} rows")
        w = np.array(w0, float)
    elif init == "cluster":
        from strandlake.operators.clustering import labelled
        from strandlake.operators.counting import centroids
        from strandlake.operators.similarity import distance

        rows = centroids(v, labelled(distance(v, v), rank).withColumnRenamed("id", "seq_id")).toPandas()
        w, at = np.zeros((len(words), rank)), {k: i for i, k in enumerate(words)}
        w[rows["kmer"].map(at), rows["cluster"]] = rows["w"]
    elif init == "nndsvd":
        w = nndsvd(*leading(lambda x: product(packed, x), len(words), rank, rng), rank)
    else:
        w = rng.random((len(words), rank))
    w = w / max(np.linalg.norm(w, 2), EPS)
    q, steps = np.zeros_like(w), 0
    for steps in range(1, max_iter + 1):
        if np_columns:
            q = q + product(packed, w, seed * 100_003 + steps, np_columns, total)
            n = q
        else:
            n = product(packed, w)
        sigma = (w * w).sum(axis=0) / len(words) + EPS if ard else None
        new = update(w, n, sigma)
        change = (np.linalg.norm(new - w) / max(np.linalg.norm(w), EPS)) ** 2
        w = new
        if change < tolerance:
            break
    if ard:
        strength = (w * w).sum(axis=0)
        w = w[:, strength > EPS * strength.max()]
    packed.unpersist()
    return Motifs(words, w, steps)
