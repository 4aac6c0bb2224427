"""Logistic models on motif features, and curves of their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.linalg import summed

#: Motifs whose matrix of products a task holds: 0.5 GB.
MAX_MOTIFS = 1 << 13

def nonzero(coefficients: DataFrame) -> DataFrame:
    """(outcome, motif_id, coef) without motifs whose coefficients are all zero."""
    some = coefficients.groupBy("motif_id").agg(F.bool_or(F.col("coef") != 0).alias("_some")).filter("_some").select("motif_id")
    return coefficients.join(some, "motif_id", "left_semi")


def predict(features: DataFrame, coefficients: DataFrame, intercepts: DataFrame) -> DataFrame:
    """(seq_id, outcome, p) from features (seq_id, motif_id, bc); intercepts (outcome, intercept), 0 where missing."""
    x = features.join(coefficients, "motif_id").groupBy("seq_id", "outcome").agg(F.sum(F.col("bc") * F.col("coef")).alias("x"))
    return x.join(intercepts, "outcome", "left").select("seq_id", "outcome", (1 / (1 + F.exp(-(F.col("x") + F.coalesce("intercept", F.lit(0.0)))))).alias("p"))


def curve(scores: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by, score, tp, fp, pos, neg): counts at or above each distinct score.

    Ties are grouped before the ordered sums, so only distinct scores meet in a
    window.
    """
    by = by or []
    held = scores.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col(score).desc())
    every = Window.partitionBy(*by)
    return held.select(*by, F.col(score).alias("score"), F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), "p", "n", F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("neg"))


def metrics(scores: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by, auroc, aupr, accuracy): areas with ties shared, step-wise precision, and the best accuracy over thresholds."""
    by = by or []
    c = curve(scores, score, label, by)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("pos") * F.col("neg"))
    pr = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("pos")
    acc = F.greatest(F.max((F.col("tp") + F.col("neg") - F.col("fp")) / (F.col("pos") + F.col("neg"))), F.max(F.col("neg") / (F.col("pos") + F.col("neg"))))
    return c.groupBy(*by).agg(area.alias("auroc"), pr.alias("aupr"), acc.alias("accuracy"))


def best_threshold(scores: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by, threshold, error): the highest score with the least error of the rule ``score > threshold``."""
    by = by or []
    c = curve(scores, score, label, by)
    # Above a score lie those before it in descending order.
    error = ((F.col("pos") - (F.col("tp") - F.col("p"))) + (F.col("fp") - F.col("n"))) / (F.col("pos") + F.col("neg"))
    best = F.min(F.struct(error.alias("error"), (-F.col("score")).alias("at")))
    return c.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.at")).alias("threshold"), F.col("b.error").alias("error"))


def model_correlation(a: DataFrame, b: DataFrame, s11: DataFrame, s12: DataFrame, s22: DataFrame) -> DataFrame:
    """(outcome_a, outcome_b, r): correlation of two models (outcome, motif_id, coef) through motif similarities (a, b, s)."""

    def form(x, s, y, names):
        left = x.select(F.col("outcome").alias(names[0]), F.col("motif_id").alias("a"), F.col("coef").alias("_x"))
        right = y.select(F.col("outcome").alias(names[1]), F.col("motif_id").alias("b"), F.col("coef").alias("_y"))
        return left.join(s, "a").join(right, "b").groupBy(*names).agg(F.sum(F.col("_x") * F.col("s") * F.col("_y")).alias("q"))

    own = lambda x, s, n: form(x, s, x, [n, "_o"]).filter(F.col(n) == F.col("_o")).select(n, F.col("q").alias(f"_{n}"))
    cross = form(a, s12, b, ["outcome_a", "outcome_b"])
    return cross.join(own(a, s11, "outcome_a"), "outcome_a").join(own(b, s22, "outcome_b"), "outcome_b").select("outcome_a", "outcome_b", (F.col("q") / F.sqrt(F.col("_outcome_a") * F.col("_outcome_b"))).alias("r"))


def permutation_p(a, b, s11, s12, s22, n: int, seed: int = 0):
    """(r, p) of two models given as arrays (motifs by outcomes): share of permuted first models at least as far out, by sign."""
    import numpy as np

    rng = np.random.default_rng(seed)

    def corr(x):
        return (x.T @ s12 @ b) / np.sqrt(np.outer(np.einsum("mo,mn,no->o", x, s11, x), np.einsum("mo,mn,no->o", b, s22, b)))

    r = corr(a)
    beyond = np.zeros_like(r)
    for _ in range(n):
        other = corr(a[rng.permutation(len(a))])
        beyond += np.where(r >= 0, other >= r, other <= r)
    return r, beyond / max(1, n)


def lasso_path(x, y, folds, lambdas=50, steps: int = 400):
    """L1 logistic regression by proximal gradient with cross-validation by given folds.

    Returns (coefficients, intercept, lambda, mean AUROC by lambda): the lambda
    with the best mean AUROC over folds, refitted on all rows.
    """
    import numpy as np

    x, y, folds = np.asarray(x, float), np.asarray(y, float), np.asarray(folds)
    mu, sd = x.mean(axis=0), x.std(axis=0)
    z = (x - mu) / np.where(sd > 0, sd, 1)
    top = np.abs(z.T @ (y - y.mean())).max() / len(y)
    grid = np.geomspace(max(top, 1e-9), max(top, 1e-9) * 1e-3, lambdas)

    def fit(rows, lam, w, b):
        zr, yr = z[rows], y[rows]
        rate = 4 / (np.linalg.norm(zr, 2) ** 2 / len(zr) + 1)
        for _ in range(steps):
            g = 1 / (1 + np.exp(-(zr @ w + b))) - yr
            new = w - rate * (zr.T @ g) / len(yr)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * lam, 0)
            b -= rate * g.mean()
            done = np.abs(new - w).max(initial=0) < 1e-7
            w = new
            if done:
                break
        return w, b

    def auc(score, label):
        order = np.argsort(score, kind="stable")
        ranks = np.empty(len(score))
        ranks[order] = np.arange(1, len(score) + 1)
        for v in np.unique(score):
            same = score == v
            ranks[same] = ranks[same].mean()
        p = label.sum()
        return (ranks[label == 1].sum() - p * (p + 1) / 2) / max(1, p * (len(label) - p))

    scores = np.zeros((len(set(folds.tolist())), lambdas))
    for f, fold in enumerate(sorted(set(folds.tolist()))):
        rows, w, b = folds != fold, np.zeros(z.shape[1]), 0.0
        for i, lam in enumerate(grid):
            w, b = fit(rows, lam, w, b)
            scores[f, i] = auc(z[~rows] @ w + b, y[~rows])
    mean = scores.mean(axis=0)
    w, b = np.zeros(z.shape[1]), 0.0
    for lam in grid[: int(mean.argmax()) + 1]:
        w, b = fit(np.ones(len(y), bool), lam, w, b)
    coef = np.where(sd > 0, w / np.where(sd > 0, sd, 1), 0)
    return coef, b - float(coef @ mu), float(grid[mean.argmax()]), mean


def lasso_cv(features: DataFrame, labels: DataFrame, lambdas: int = 50, steps: int = 200):
    """``lasso_path`` on the cluster, for features (seq_id, motif_id, bc) and labels (seq_id, y, fold).

    Returns (motif ids, coefficients, intercept, lambda, mean AUROC by lambda).
    Sequences are packed to a row each and never collected.  A pass adds up the
    gradients of the models of all lambdas, each without one of the folds and
    without none, for an accelerated proximal step; held-out scores are ranked
    on the cluster.  Missing features are 0; rows without y or fold are left
    out; folds without both labels aren't judged, and where no fold has both it
    is an error.
    """
    import numpy as np
    import pyarrow as pa

    ids = [r[0] for r in features.select("motif_id").distinct().limit(MAX_MOTIFS + 1).collect()]
    if len(ids) > MAX_MOTIFS:
        raise ValueError("too many motifs for a model")
    ids.sort()
    index = features.sparkSession.createDataFrame(list(zip(ids, range(len(ids)))), f"motif_id {dict(features.dtypes)['motif_id']}, at int")
    held = features.join(index, "motif_id").join(labels.dropna(subset=["y", "fold"]), "seq_id").groupBy("seq_id", F.col("y").cast("double").alias("y"), F.col("fold").cast("long").alias("fold"))
    packed = held.agg(F.collect_list("at").alias("at"), F.collect_list(F.col("bc").cast("double")).alias("x")).drop("seq_id").persist()
    sizes = {r["fold"]: r for r in packed.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()}
    judged = sorted(f for f, r in sizes.items() if 0 < r["p"] < r["n"])
    if not judged:
        packed.unpersist()
        raise ValueError("no fold has both labels")
    m = len(ids)

    def dense(batch):
        x, at = np.zeros((batch.num_rows, m)), batch.column("at")
        x[np.repeat(np.arange(len(x)), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = batch.column("x").flatten().to_numpy()
        return x, batch.column("y").to_numpy(), batch.column("fold").to_numpy()

    def slices(batch):
        return (dense(batch.slice(i, 1024)) for i in range(0, batch.num_rows, 1024))

    def moments(out, batch):
        for x, y, _ in slices(batch):
            x = np.column_stack([x, y, np.ones(len(x))])
            out += x.T @ x

    both = summed(packed, (m + 2, m + 2), moments)
    n = both[-1, -1]
    mean = both[-1] / n
    cov = both / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:m], 0))
    sd[sd < 1e-9] = np.inf  # a constant feature has no part
    mu, scaled = mean[:m], cov[:m, :m] / np.outer(sd, sd)
    top = max(np.abs(cov[:m, m] / sd).max(initial=0), 1e-9)
    grid = np.geomspace(top, top * 1e-3, lambdas)
    out_of = np.repeat(np.array([*judged, 0]), lambdas)  # the fold a model leaves out
    leaves = np.repeat([True] * len(judged) + [False], lambdas)
    rows = np.repeat([n - sizes[f]["n"] for f in judged] + [n], lambdas)
    rate = rows / n * 4 / max(np.linalg.norm(scaled, 2), 1)
    penalty = np.tile(grid, len(judged) + 1)
    w, t = np.zeros((m + 1, len(rows))), 1.0  # the last row: intercepts
    ahead = w

    def gradients(at):
        def add(out, batch):
            for x, y, fold in slices(batch):
                z = np.column_stack([(x - mu) / sd, np.ones(len(x))])
                off = 1 / (1 + np.exp(-(z @ at))) - y[:, None]
                off[leaves & (fold[:, None] == out_of)] = 0
                out += z.T @ off

        return summed(packed, at.shape, add)

    for _ in range(steps):
        new = ahead - rate * gradients(ahead) / rows
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, moved = new + (t - 1) / after * (new - w), np.abs(new - w).max()
        w, t = new, after
        if moved < 1e-6:
            break

    def scored(batches):
        for batch in batches:
            for x, y, fold in slices(batch):
                z = np.column_stack([(x - mu) / sd, np.ones(len(x))])
                for k, f in enumerate(judged):
                    hit = fold == f
                    if hit.any():
                        own = z[hit] @ w[:, k * lambdas : (k + 1) * lambdas]
                        yield pa.RecordBatch.from_arrays([pa.array(fold[hit]), pa.array(y[hit]), pa.array(own.tolist(), pa.list_(pa.float64()))], names=["fold", "label", "s"])

    scores = packed.mapInArrow(scored, "fold long, label double, s array<double>").select("fold", "label", F.posexplode("s").alias("i", "score"))
    areas = metrics(scores, by=["fold", "i"]).groupBy("i").agg(F.avg("auroc").alias("auroc")).orderBy("i").collect()
    packed.unpersist()
    auroc = np.array([r["auroc"] for r in areas])
    best = len(judged) * lambdas + int(auroc.argmax())
    coef = w[:m, best] / sd
    return ids, coef, float(w[m, best] - coef @ mu), float(grid[auroc.argmax()]), auroc
