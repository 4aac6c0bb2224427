"""Position weight matrices: (name, pos, a, c, g, t) with pos from 1 and probabilities, or counts before ``normalised``."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import canonical, reverse_complement
from strandlake.operators.counting import _pieces
from strandlake.operators.space import KmerSpace

BASES = ("a", "c", "g", "t")
UNIFORM = (0.25, 0.25, 0.25, 0.25)
MAX_CELLS = 1_000_000


def normalised(counts: DataFrame) -> DataFrame:
    """Probabilities, with the column total as ``n``."""
    n = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    return counts.select("name", "pos", *[(F.col(b) / n).alias(b) for b in BASES], n.cast("double").alias("n"))


def pssm(pwm: DataFrame, background=UNIFORM, pseudo: float = 0.1) -> DataFrame:
    """log2 of smoothed probability by background; ``n`` observations a column, 1000 where it isn't given."""
    n = F.col("n") if "n" in pwm.columns else F.lit(1000.0)
    score = lambda b, q: F.log2((F.col(b) * n + q * pseudo) / (n + pseudo) / q)
    return pwm.select("name", "pos", *[score(b, q).alias(b) for b, q in zip(BASES, background)])


def packed(pwm: DataFrame) -> DataFrame:
    """(name, width, cells): one row a matrix, cells base by base and position by position."""
    cells = F.sort_array(F.collect_list(F.struct("pos", F.array(*BASES).alias("v"))))
    return pwm.groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("width"), F.flatten(F.transform(cells, lambda s: s["v"])).alias("cells"))


def _score(window: Column, cells: Column, width: Column, product: bool) -> Column:
    cell = lambda i: F.get(cells, (i - 1) * 4 + F.ascii(F.translate(F.substring(window, i, F.lit(1)), "ACGT", "0123")) - 48)
    start = F.lit(1.0 if product else 0.0)
    return F.aggregate(F.sequence(F.lit(1), width), start, (lambda s, i: s * cell(i)) if product else (lambda s, i: s + cell(i)))


def scores(seqs: DataFrame, matrices: DataFrame, product: bool = False, double_strand: bool = False) -> DataFrame:
    """(seq_id, name, pos, score) at every offset whose window holds only bases; ``product`` multiplies, else sums.

    The matrices of one width ride along as one array, whose size is checked.
    """
    sets = packed(matrices).groupBy("width").agg(F.collect_list(F.struct("name", "cells")).alias("set")).collect()
    if sum(len(m["cells"]) for s in sets for m in s["set"]) > MAX_CELLS:
        raise ValueError("too many matrices for one scan")
    out = None
    for s in sorted(sets, key=lambda r: r["width"]):
        w = s["width"]
        at = _pieces(seqs.select("seq_id", F.translate("seq", "acgt", "ACGT").alias("_s")), w, ["seq_id"]).filter(~F.col("lmer").rlike("[^ACGT]"))
        table = F.array(*[F.struct(F.lit(m["name"]).alias("name"), F.array(*map(F.lit, m["cells"])).alias("cells")) for m in sorted(s["set"], key=lambda m: m["name"])])
        each = at.select("seq_id", "pos", "lmer", F.explode(table).alias("m"))
        score = _score(F.col("lmer"), F.col("m.cells"), F.lit(w), product)
        if double_strand:
            score = F.greatest(score, _score(reverse_complement("lmer"), F.col("m.cells"), F.lit(w), product))
        part = each.select("seq_id", F.col("m.name").alias("name"), F.col("pos").cast("long"), score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def sequence_scores(scored: DataFrame, mode: str = "max") -> DataFrame:
    """(seq_id, name, score): the best or the mean score over offsets."""
    return scored.groupBy("seq_id", "name").agg((F.max("score") if mode == "max" else F.avg("score")).alias("score"))


def score_range(scoring: DataFrame) -> DataFrame:
    """(name, lo, hi): least and largest possible sum."""
    return scoring.groupBy("name").agg(F.sum(F.least(*BASES)).alias("lo"), F.sum(F.greatest(*BASES)).alias("hi"))


def position_information(pwm: DataFrame, background=UNIFORM) -> DataFrame:
    """(name, pos, ic): sum of p log2(p / background)."""
    term = lambda b, q: F.when(F.col(b) > 0, F.col(b) * F.log2(F.col(b) / q)).otherwise(0.0)
    return pwm.select("name", "pos", sum((term(b, q) for b, q in zip(BASES, background)), F.lit(0.0)).alias("ic"))


def motifs(pwm: DataFrame, space: KmerSpace, pad: int | None = None, best: bool = False, background=UNIFORM) -> DataFrame:
    """(name, kmer, w): k-mer distribution of each matrix with ``pad`` background columns on both sides (l - 1 if not given).

    An l-mer's probability is the mean over offsets of the product of its
    letters', or with ``best`` the largest one, where probabilities below one
    over the dictionary size go; gapped words share their l-mers' mean.
    """
    from pyspark.sql import Window

    from strandlake.operators.space import gapped

    l = space.l  # noqa: E741
    pad = l - 1 if pad is None else pad
    if pad >= l:
        raise ValueError("the pad has to be shorter than a word")
    if best and space.gaps:
        raise ValueError("no gapped words by largest probability")
    held = packed(pwm)
    side = F.array_repeat(F.array(*map(F.lit, background)), pad)
    full = held.select("name", F.concat(F.flatten(side), "cells", F.flatten(side)).alias("cells")).withColumn("steps", (F.size("cells") / 4 - l + 1).cast("int"))
    codes = F.transform(F.sequence(F.lit(l - 1), F.lit(0), F.lit(-1)), lambda d: (F.floor(F.col("i") / F.pow(F.lit(4.0), d)) % 4).cast("int"))
    each = full.filter("steps > 0").select("name", "cells", "steps", F.explode(F.sequence(F.lit(0), F.lit(4**l - 1))).alias("i")).withColumn("code", codes)
    prob = lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(l - 1)), F.lit(1.0), lambda s, j: s * F.get("cells", (p + j) * 4 + F.get("code", j)))
    steps = F.sequence(F.lit(0), F.col("steps") - 1)
    whole = F.array_max(F.transform(steps, prob)) if best else F.aggregate(steps, F.lit(0.0), lambda s, p: s + prob(p)) / F.col("steps")
    lmer = F.array_join(F.transform("code", lambda c: F.substring(F.lit("ACGT"), c + 1, F.lit(1))), "")
    p = each.select("name", lmer.alias("lmer"), whole.alias("p"))
    if space.gaps:
        p = p.select("name", F.explode(gapped(F.col("lmer"), space)).alias("kmer"), (F.col("p") / len(space.masks)).alias("p"))
    else:
        p = p.select("name", (canonical("lmer") if space.ds else F.col("lmer")).alias("kmer"), "p")
    n = p.groupBy("name", "kmer").agg(F.sum("p").alias("n"))
    if best:
        n = n.filter(F.col("n") * space.size >= 1)
    return n.filter("n > 0").select("name", "kmer", F.sqrt(F.col("n") / F.sum("n").over(Window.partitionBy("name"))).alias("w"))


def distribution(columns: list[list[float]], background=UNIFORM, granularity: float = 1e-3) -> list[tuple[float, float]]:
    """(score, P(score or more)) by falling score for a matrix of scores, rounded down to ``granularity``.

    A dynamic programme over the positions of integer scores; the table is as
    large as the score range over the granularity, not as the 4^w words.
    """
    held = {0: 1.0}
    for col in columns:
        nxt: dict[int, float] = {}
        for b, q in zip(col, background):
            step = floor(b / granularity)
            for s, p in held.items():
                nxt[s + step] = nxt.get(s + step, 0.0) + p * q
        held = nxt
    out, total = [], 0.0
    for s in sorted(held, reverse=True):
        total += held[s]
        out.append((s * granularity, min(1.0, total)))
    return out


def threshold(columns: list[list[float]], alpha: float, background=UNIFORM, granularity: float = 0.1, finest: float = 1e-4) -> tuple[float, float]:
    """(score, p): the least score whose tail probability is at most ``alpha``, refining until it stands."""
    last = None
    while True:
        d = distribution(columns, background, granularity)
        good = [(s, p) for s, p in d if p <= alpha]
        now = good[-1] if good else (d[0][0] + granularity, 0.0)
        if granularity <= finest or (last is not None and abs(now[1] - last[1]) <= 1e-12):
            return now
        last, granularity = now, granularity / 10


def p_value(columns: list[list[float]], score: float, background=UNIFORM, granularity: float = 1e-3) -> float:
    """P(score or more), read off the distribution linearly between its scores."""
    return read_off(distribution(columns, background, granularity)[::-1], score)


def read_off(d: list[tuple[float, float]], score: float) -> float:
    """P(score or more) by a distribution in ascending order of scores."""
    if score <= d[0][0]:
        return 1.0
    if score > d[-1][0]:
        return 0.0
    from bisect import bisect_left

    at = bisect_left([s for s, _ in d], score)
    (s0, p0), (s1, p1) = d[at - 1], d[at]
    return p1 if score == s1 else p0 + (p1 - p0) * (score - s0) / (s1 - s0)


def distributions(scoring: DataFrame, granularity: float = 1e-2) -> DataFrame:
    """(name, score, p) tables of every scoring matrix, one matrix to a group."""

    def run(pdf):
        import pandas as pd

        rows = distribution(pdf.sort_values("pos")[list(BASES)].to_numpy().tolist(), granularity=granularity)
        return pd.DataFrame({"name": pdf["name"].iloc[0], "score": [s for s, _ in rows], "p": [p for _, p in rows]})

    return scoring.groupBy("name").applyInPandas(run, "name string, score double, p double")


def p_values(scores: DataFrame, scoring: DataFrame, score: str, granularity: float = 1e-3) -> DataFrame:
    """``scores`` (name, score, ...) with ``p``, the tail probability under the matrix of that name.

    A matrix and the scores asked of it meet in one group; its distribution is
    worked out once there.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in scores.dtypes)

    def run(matrix, asked):
        import pandas as pd

        if not len(matrix) or not len(asked):
            return asked.assign(p=pd.Series(dtype=float))[[*names, "p"]].iloc[:0]
        d = distribution(matrix.sort_values("pos")[list(BASES)].to_numpy().tolist(), granularity=granularity)[::-1]
        return asked.assign(p=[read_off(d, x) for x in asked[score]])[[*names, "p"]]

    names = scores.columns
    return scoring.withColumnRenamed("name", "_name").select(F.col("_name"), F.col("pos").alias("pos"), *[F.col(b).alias(b) for b in BASES]).groupBy("_name").cogroup(scores.groupBy("name")).applyInPandas(run, f"{kinds}, p double")


def thresholds(scoring: DataFrame, alpha: float) -> DataFrame:
    """(name, threshold, p) of every scoring matrix."""

    def run(pdf):
        import pandas as pd

        t, p = threshold(pdf.sort_values("pos")[list(BASES)].to_numpy().tolist(), alpha)
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "threshold": [t], "p": [p]})

    return scoring.groupBy("name").applyInPandas(run, "name string, threshold double, p double")


def recover(weights: dict[str, float], start: list[list[float]], l: int, pad: int | None = None, sweeps: int = 200, tol: float = 1e-6):  # noqa: E741
    """(matrix, similarity): the matrix whose k-mer distribution is most alike to a motif (kmer to w).

    Multiplicative updates of every cell from a start matrix, columns kept on
    the simplex; a step is halved until the similarity doesn't fall.
    """
    import numpy as np

    pad = l - 1 if pad is None else pad
    m = np.clip(np.array(start, float), 1e-6, None)
    m /= m.sum(axis=1, keepdims=True)
    target = np.zeros(4**l)
    for k, w in weights.items():
        target[int(k.translate(str.maketrans("ACGT", "0123")), 4)] += w
    digits = np.stack([np.arange(4**l) // 4 ** (l - 1 - j) % 4 for j in range(l)])

    def value(m, grad=False):
        full = np.concatenate([np.full((pad, 4), 0.25), m, np.full((pad, 4), 0.25)])
        steps = len(full) - l + 1
        p, parts = np.zeros(4**l), []
        for s in range(steps):
            f = full[s : s + l][np.arange(l)[:, None], digits]
            prod = f.prod(axis=0)
            p += prod
            parts.append((f, prod))
        p /= p.sum()
        bc = float((target * np.sqrt(p)).sum())
        if not grad:
            return bc
        dp = target / (2 * np.sqrt(np.maximum(p, 1e-300)))
        dp = (dp - (dp * p).sum()) / steps
        g = np.zeros_like(full)
        for s, (f, prod) in enumerate(parts):
            for j in range(l):
                np.add.at(g[s + j], digits[j], dp * prod / f[j])
        return bc, g[pad : pad + len(m)]

    best, step = value(m), 1.0
    for _ in range(sweeps):
        _, g = value(m, True)
        g = g - (g * m).sum(axis=1, keepdims=True)
        while step > 1e-6:
            new = m * np.exp(np.clip(step * g, -20, 20))
            new /= new.sum(axis=1, keepdims=True)
            now = value(new)
            if now >= best:
                break
            step /= 2
        else:
            break
        done, m, best = now - best < tol * max(best, 1e-12) and step <= 1, new, now
        step *= 2
        if done:
            break
    return m, best
