"""Hierarchical clustering, silhouettes and the choice of a rank.

Distances are (a, b, d) of all pairs, as ``similarity.distance`` gives them.
Linkage runs on the driver over a motif set's distance matrix, whose size is
checked; silhouettes are grouped averages on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.counting import centroids
from strandlake.operators.similarity import distance

MAX_POINTS = 5000

#: Lance-Williams coefficients: of the two merged clusters, of their distance, and of the difference.
METHODS = ("single", "complete", "average", "mcquitty", "ward.D", "ward.D2", "centroid", "median")


def _coefficients(method: str, ni, nj, nk):
    if method == "single":
        return 0.5, 0.5, 0.0, -0.5
    if method == "complete":
        return 0.5, 0.5, 0.0, 0.5
    if method == "average":
        return ni / (ni + nj), nj / (ni + nj), 0.0, 0.0
    if method == "mcquitty":
        return 0.5, 0.5, 0.0, 0.0
    if method in ("ward.D", "ward.D2"):
        t = ni + nj + nk
        return (ni + nk) / t, (nj + nk) / t, -nk / t, 0.0
    if method == "centroid":
        return ni / (ni + nj), nj / (ni + nj), -ni * nj / (ni + nj) ** 2, 0.0
    if method == "median":
        return 0.5, 0.5, -0.25, 0.0
    raise ValueError(f"unknown method {method}")


def linkage(matrix, method: str = "complete") -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of a symmetric distance matrix; a and b are the smallest members of the merged clusters."""
    import numpy as np

    d = np.array(matrix, float)
    n = len(d)
    if method == "ward.D2":
        d = d * d
    size, live = np.ones(n), np.ones(n, bool)
    np.fill_diagonal(d, np.inf)
    out = []
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        a, b, c, g = _coefficients(method, size[i], size[j], size)
        with np.errstate(invalid="ignore"):  # entries of merged clusters are infinite and set below
            row = a * d[i] + b * d[j] + c * h + g * np.abs(np.where(live, d[i] - d[j], 0))
        live[j] = False
        row[~live] = np.inf
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        out.append((i, j, float(h) ** 0.5 if method == "ward.D2" else float(h)))
    return out


def cut(merges: list[tuple[int, int, float]], n: int, k: int | None = None, height: float | None = None) -> list[int]:
    """Cluster of each point, numbered from 0 by first member: k clusters, or merges up to a height."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, _ in merges[: n - k] if k is not None else [m for m in merges if m[2] <= height]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    names: dict[int, int] = {}
    return [names.setdefault(find(i), len(names)) for i in range(n)]


def matrix(distances: DataFrame):
    """(ids, square array) of a motif set's distances, on the driver."""
    import numpy as np

    rows = distances.limit(MAX_POINTS * MAX_POINTS + 1).toPandas()
    ids = sorted(set(rows["a"]))
    if len(rows) > MAX_POINTS * MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points: cluster motifs or a sample")
    at = {x: i for i, x in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    out[rows["a"].map(at), rows["b"].map(at)] = rows["d"]
    return ids, out


def silhouette(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, cluster, s) from distances and labels (id, cluster); alone in a cluster gives 0."""
    la, lb = labels.select(F.col("id").alias("a"), "cluster"), labels.select(F.col("id").alias("b"), F.col("cluster").alias("other"))
    means = distances.filter("a <> b").join(la, "a").join(lb, "b").groupBy("a", "cluster", "other").agg(F.avg("d").alias("m"))
    own = F.max(F.when(F.col("cluster") == F.col("other"), F.col("m")))
    near = F.min(F.when(F.col("cluster") != F.col("other"), F.col("m")))
    both = means.groupBy("a", "cluster").agg(own.alias("x"), near.alias("y"))
    s = F.when(F.col("x").isNull() | F.col("y").isNull(), 0.0).when(F.greatest("x", "y") == 0, 0.0).otherwise((F.col("y") - F.col("x")) / F.greatest("x", "y"))
    return both.select("a", "cluster", s.alias("s"))


def cluster_silhouette(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, s, size)."""
    return silhouette(distances, labels).groupBy("cluster").agg(F.avg("s").alias("s"), F.count(F.lit(1)).alias("size"))


def _silhouettes(d, labels) -> list[float]:
    """Mean silhouette of each cluster, with numpy."""
    import numpy as np

    labels = np.asarray(labels)
    k = labels.max() + 1
    onehot = np.eye(k)[labels]
    sums, sizes = d @ onehot, onehot.sum(axis=0)
    own = sums[np.arange(len(d)), labels] / np.maximum(sizes[labels] - 1, 1)
    rest = np.where(onehot > 0, np.inf, sums / sizes)
    near = rest.min(axis=1) if k > 1 else np.full(len(d), np.inf)
    top = np.maximum(own, near)
    s = np.where((sizes[labels] > 1) & (k > 1) & (top > 0) & np.isfinite(top), (near - own) / np.where(top > 0, top, 1), 0.0)
    return [float(s[labels == c].mean()) for c in range(k)]


def rank_info(distances: DataFrame, method: str = "complete") -> list[tuple[int, float, int]]:
    """(k, mean of the cluster silhouettes, clusters above 0) for every k from 2 to the number of points."""
    _, d = matrix(distances)
    merges, out = linkage(d, method), []
    for k in range(2, len(d) + 1):
        s = _silhouettes(d, cut(merges, len(d), k))
        out.append((k, sum(s) / len(s), sum(x > 0 for x in s)))
    return out


def labelled(distances: DataFrame, k: int, method: str = "complete") -> DataFrame:
    """(id, cluster) of a cut into k clusters."""
    ids, d = matrix(distances)
    return distances.sparkSession.createDataFrame(list(zip(ids, cut(linkage(d, method), len(d), min(k, len(d))))), "id long, cluster int")


def initial_motifs(dist: DataFrame, min_rank: int, max_rank: int, method: str = "complete", good: bool = True, bhattacharyya: bool = False) -> DataFrame:
    """(cluster, kmer, w): centroids of the clusters at the best rank.

    The rank is the k with the best mean silhouette among those with at least
    ``min_rank`` good clusters, at most ``max_rank``; ``good`` leaves out
    clusters with a mean silhouette of 0 or less.
    """
    ids, d = matrix(distance(dist, dist, bhattacharyya))
    merges = linkage(d, method)
    tried = [(sum(s) / len(s), -k) for k in range(2, len(d) + 1) for s in [_silhouettes(d, cut(merges, len(d), k))] if sum(x > 0 for x in s) >= min_rank]
    k = min(-max(tried)[1] if tried else max_rank, max_rank, len(d))
    labels = cut(merges, len(d), k)
    s = _silhouettes(d, labels)
    keep = [(i, c) for i, c in zip(ids, labels) if not good or s[c] > 0]
    return centroids(dist, dist.sparkSession.createDataFrame(keep, "seq_id long, cluster int"))


def reduce_motifs(motifs: DataFrame, rank: int) -> DataFrame:
    """Motifs merged to ``rank`` centroids by ward.D2 on Hellinger distances."""
    labels = labelled(distance(motifs, motifs), rank, "ward.D2")
    return centroids(motifs, labels.withColumnRenamed("id", "seq_id"))


def nearest(distances: DataFrame) -> DataFrame:
    """Each point's nearest other point."""
    w = Window.partitionBy("a").orderBy("d", "b")
    return distances.filter("a <> b").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
