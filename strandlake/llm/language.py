"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are lower-cased and read as UTF-8 bytes, white space and all.  Two gated
recurrent layers, one from each end, read a document; every position gets a
probability for each language, and a document's probabilities are the mean over
all its positions.  So that long documents are read at once rather than byte
after byte, a document is read in windows of ``WINDOW`` positions, and a layer
starts ``CONTEXT`` bytes before a window (the other one as many behind it), so
its state is carried into the window over the bytes that precede it; gates
forget what lies further back (a test compares with reading a document in one
go).  Work is linear in the bytes, and a batch holds ``ROWS`` windows at a
time however long texts are.

Training runs in numpy on the driver, by backpropagation through time, on a
bounded sample: of each language at most ``DOCS`` labelled documents outside
the held-out fold, chosen by a hash of the id (fewer where there are so many
languages that ``SAMPLE`` documents in all would be exceeded), and of each
``PIECES`` windows of ``PIECE`` characters at hashed places over the whole
text.  Every position of a window has the document's language for its target,
and languages weigh the same.  Everything is seeded.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
with no labelled row outside the held-out fold all are ``und``; a null doc_id
is not held out; repeated rows get equal results; an empty table gives an
empty result; other columns are ignored.  ``accepted`` drops what is ``und``
and what scores below ``least_score``; with no labelled row nothing can be
judged, so all texts with a letter stay.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import fresh, small_batches

FOLDS = 5
DOCS, SAMPLE, PIECES, PIECE = 600, 20_000, 4, 96
WINDOW, CONTEXT, ROWS = 448, 24, 1024
HIDDEN, SEED = 12, 5
STEPS, BATCH, RATE = 160, 256, 0.02
UNKNOWN = "und"


def held_out(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def windows(data: bytes) -> list[tuple[bytes, int, int]]:
    """(bytes, context bytes before, own positions) of each window of a document."""
    return [(data[max(0, i - CONTEXT) : i + WINDOW + CONTEXT], min(i, CONTEXT), min(WINDOW, len(data) - i)) for i in range(0, len(data), WINDOW)]


def read_as(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class Network:
    """Weights and the two passes over a batch of equally long byte rows (zero-padded on the right)."""

    def __init__(self, languages: list[str], rng):
        import numpy as np

        self.languages, h, k = languages, HIDDEN, len(languages)
        w = lambda *s: (rng.standard_normal(s) * (0.5 / s[0] ** 0.5 if len(s) > 1 else 0)).astype(np.float32)
        # By direction: input table and recurrent weights for update, reset and candidate, and the reading weights.
        self.p = {f"{n}{d}": x for d in "fb" for n, x in (("E", (rng.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)), ("U", w(h, 2 * h)), ("C", w(h, h)), ("O", w(h, k)))}
        self.p |= {"b": np.zeros(k, np.float32)}
        for d in "fb":
            self.p[f"E{d}"][:, :h] -= 1.0  # keep the state at first

    def states(self, x, mask, d):
        """Hidden states (T, n, h) and what the backward pass needs."""
        import numpy as np

        h, p = HIDDEN, self.p
        e, u, c = p[f"E{d}"], p[f"U{d}"], p[f"C{d}"]
        state, out, kept = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = e[x[t]]
            g = 1 / (1 + np.exp(-(a[:, : 2 * h] + state @ u)))
            z, r = g[:, :h] * mask[t][:, None], g[:, h:]
            n = np.tanh(a[:, 2 * h :] + (r * state) @ c)
            kept.append((t, state, g, z, r, n))
            state = state + z * (n - state)
            out[t] = state
        return out, kept

    def read(self, x, mask, d):
        """``states`` without what training needs, in buffers that are used again."""
        import numpy as np

        h, p, n = HIDDEN, self.p, x.shape[1]
        # The gates' weights with their signs turned, for the logistic function.
        gates, inner, u, c = -p[f"E{d}"][:, : 2 * h], p[f"E{d}"][:, 2 * h :].copy(), -p[f"U{d}"], p[f"C{d}"]
        out = np.empty((*x.shape, h), p["b"].dtype)
        a, g, b, new, r = (np.empty((n, w), out.dtype) for w in (2 * h, 2 * h, h, h, h))
        state, whole = np.zeros((n, h), out.dtype), mask.all(axis=1)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(gates, x[t], axis=0, out=a, mode="clip")
            np.matmul(state, u, out=g)
            g += a
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[:, h:], state, out=r)
            np.matmul(r, c, out=new)
            np.take(inner, x[t], axis=0, out=b, mode="clip")
            new += b
            np.tanh(new, out=new)
            new -= state
            new *= g[:, :h]
            if not whole[t]:
                new *= mask[t][:, None]
            state = np.add(state, new, out=out[t])
        return out

    def probabilities(self, x, mask, keep=False):
        import numpy as np

        if keep:
            (hf, kf), (hb, kb) = self.states(x, mask, "f"), self.states(x, mask, "b")
        else:
            hf, hb, kf, kb = self.read(x, mask, "f"), self.read(x, mask, "b"), [], []
        y = hf @ self.p["Of"] + hb @ self.p["Ob"] + self.p["b"]
        y = np.exp(y - y.max(axis=-1, keepdims=True))
        return y / y.sum(axis=-1, keepdims=True), (hf, kf, hb, kb)

    def gradients(self, x, mask, target, weight):
        """Loss and gradients of the cross-entropy at every position, by backpropagation through time."""
        import numpy as np

        h, p = HIDDEN, self.p
        y, (hf, kf, hb, kb) = self.probabilities(x, mask, True)
        scale = (mask * weight / mask.sum(axis=0))[..., None] / weight.sum()
        loss = -float((np.log(y + 1e-9) * target * scale).sum())
        dy = (y - target) * scale
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["b"] = dy.sum(axis=(0, 1))
        for d, hs, kept in (("f", hf, kf), ("b", hb, kb)):
            g[f"O{d}"] = np.einsum("tnh,tnk->hk", hs, dy)
            dh = np.zeros_like(hs[0])
            above, inputs = dy @ p[f"O{d}"].T, np.empty((*x.shape, 3 * h), hs.dtype)
            for t, state, gate, z, r, n in reversed(kept):
                dh = dh + above[t]
                dn = dh * z * (1 - n * n)
                drs = dn @ p[f"C{d}"].T
                dz = dh * (n - state) * mask[t][:, None] * gate[:, :h] * (1 - gate[:, :h])
                dg = np.concatenate([dz, drs * state * r * (1 - r)], axis=1)
                g[f"C{d}"] += (r * state).T @ dn
                g[f"U{d}"] += state.T @ dg
                inputs[t] = np.concatenate([dg, dn], axis=1)
                dh = dh * (1 - z) + drs * r + dg @ p[f"U{d}"].T
            # Sums of the rows of each byte.
            by = np.argsort(x, axis=None, kind="stable")
            bytes_, starts = np.unique(x.reshape(-1)[by], return_index=True)
            g[f"E{d}"][bytes_] = np.add.reduceat(inputs.reshape(-1, 3 * h)[by], starts, axis=0)
        return loss, g

    def pooled(self, parts: list[tuple[bytes, int, int]]):
        """Sums over each window's own positions of the probabilities: (n, languages)."""
        import numpy as np

        h, p, k = HIDDEN, self.p, len(self.languages)
        out = np.empty((len(parts), k), np.float32)
        by = np.argsort([len(p) for p, _, _ in parts], kind="stable")
        for i in range(0, len(by), ROWS):
            rows = by[i : i + ROWS]
            x, mask = padded([parts[j][0] for j in rows])
            # ``probabilities`` with the languages in front, so that sums over them are sums of rows.
            y = p["Of"].T @ self.read(x, mask, "f").reshape(-1, h).T
            y += p["Ob"].T @ self.read(x, mask, "b").reshape(-1, h).T
            y += p["b"][:, None]
            y -= y.max(axis=0)
            np.exp(y, out=y)
            lead, own = (np.array([parts[j][i] for j in rows]) for i in (1, 2))
            at = np.arange(len(x))[:, None]
            y *= ((at >= lead) & (at < lead + own)).reshape(-1) / y.sum(axis=0)
            out[rows] = y.reshape(k, *x.shape).sum(axis=1).T
        return out


def padded(parts: list[bytes]):
    """(positions, n) bytes and a mask."""
    import numpy as np

    longest = max(map(len, parts))
    x = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in parts), np.uint8).reshape(len(parts), longest).T
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.ascontiguousarray(x), (np.arange(longest)[:, None] < sizes).astype(np.float32)


def sample(docs: DataFrame, per_language: int = DOCS) -> list:
    """(lang, text) rows to learn from, windows of texts: bounded, the same whatever the partitioning."""
    place = F.xxhash64(F.lit(SEED), "doc_id")
    labelled = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(SAMPLE + 1).collect()}  # languages, not documents
    if not counts:
        return []
    if len(counts) > SAMPLE:
        raise ValueError(f"more than {SAMPLE} languages")
    per_language = max(1, min(per_language, SAMPLE // len(counts)))
    # Rows over four times the bound are thinned by their hash before any is moved.
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, max(1, n // (4 * per_language)))])
    labelled = labelled.filter(F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), share[F.col("lang")]) == 0)
    room = F.greatest(F.lit(1), F.length("text") - PIECE + 1)
    parts = [F.substring("text", F.pmod(F.xxhash64(F.lit(SEED + 2 + i), "doc_id"), room).cast("int") + 1, F.lit(PIECE)) for i in range(PIECES)]
    cut = labelled.select("lang", "doc_id", place.alias("h"), F.array(*parts).alias("parts"))
    ranked = cut.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "parts"))).filter(F.col("n") <= per_language)
    rows = sorted((tuple(r) for r in ranked.select("lang", "n", "parts").collect()), key=lambda r: (r[0], r[1]))
    return [(lang, part) for lang, _, own in rows for part in dict.fromkeys(own)]


def train(rows: list) -> Network | None:
    """A network for the languages of ``rows`` ((lang, text) in a fixed order); None without rows."""
    import numpy as np

    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    parts = [read_as(text)[: 2 * PIECE] for _, text in rows]
    of = np.array([languages.index(lang) for lang, _ in rows])
    weights = (1 / np.bincount(of, minlength=len(languages)))[of].astype(np.float32)
    targets = np.eye(len(languages), dtype=np.float32)[of]
    rng = np.random.default_rng(SEED)
    net = Network(languages, rng)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    while step < STEPS:
        # Batches of about equally long windows, in random order.
        shuffled = rng.permutation(len(parts))
        shuffled = shuffled[np.argsort([len(parts[i]) // 16 for i in shuffled], kind="stable")]
        batches = [shuffled[i : i + BATCH] for i in range(0, len(parts), BATCH)]
        for at in rng.permutation(len(batches))[: STEPS - step]:
            rows_ = batches[at]
            x, mask = padded([parts[j] for j in rows_])
            _, g = net.gradients(x, mask, targets[rows_][None], weights[rows_])
            step += 1
            rate = RATE * (1 - 0.9 * step / STEPS)
            for k in net.p:  # Adam
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def documents(net: Network, texts: list[str]):
    """Language index and score of each text; -1 for texts without a letter."""
    import numpy as np

    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    total, sizes, parts, owner = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts)), [], []

    def flush():
        if parts:
            np.add.at(total, owner, net.pooled(parts))
            parts.clear()
            owner.clear()

    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            data = read_as(text)
            sizes[i] = len(data)
            for w in windows(data):
                parts.append(w)
                owner.append(i)
            if len(parts) >= 8 * ROWS:
                flush()
    flush()
    known = np.flatnonzero(sizes)
    best[known] = total[known].argmax(axis=1)
    score[known] = np.clip(total[known].max(axis=1) / sizes[known], 0.0, 1.0)
    return best, score


def annotate(docs: DataFrame, net: Network | None, label: str = "lang_pred", sure: str = "score") -> DataFrame:
    """``docs`` with two more columns of new names: the predicted language and its score."""
    if net is None:
        return docs.withColumns({label: F.lit(UNKNOWN), sure: F.lit(0.0)})
    names, columns = [*net.languages, UNKNOWN], docs.columns

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                best, scores = documents(net, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([names[b] for b in best], pa.string()), pa.array(scores)], names=[*columns, label, sure])

    return small_batches(docs).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{label}` string, `{sure}` double")


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``."""
    return annotate(docs.select("doc_id", held_out().alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """The query's columns, learning from ``docs`` itself."""
    return predict(docs, train(sample(docs)))


def least_score(languages: int) -> float:
    """Mean probability below which a document's language isn't known: well above an even guess, 0.4 at the most."""
    return min(0.4, 1.6 / max(1, languages))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known; the others are rejected."""
    net = train(sample(docs))
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    label, sure = fresh(docs, "lang_pred"), fresh(docs, "score")
    named = annotate(docs, net, label, sure)
    return named.filter((F.col(label) != UNKNOWN) & (F.col(sure) >= least_score(len(net.languages)))).select(*[F.col(f"`{c}`") for c in docs.columns])
