"""Personal data by patterns and a skip-chain conditional random field.

``base_spans`` finds e-mail addresses, IP addresses, card numbers and phone
numbers by fixed patterns over the whole text; these spans always stay.  The
field then labels tokens (runs without white space): each as one of the kinds
or as none.  Its nodes are all tokens that hold a digit or an ``@`` and the
token on either side of them; other tokens can't be personal data of these
kinds and are left out, which cuts a text's chain into pieces but changes
nothing within them.  Neighbouring nodes share chain potentials.  Nodes that
repeat each other (same address, same last ten digits) or resemble each other
(same local part, same last seven digits) share skip potentials however far
apart they are; digits are those of the run of number tokens up to the node,
so a number written in groups meets one written in one piece.  Each repeat is
linked to the first and to the previous of its kind, so evidence is at most
two links away and a group of n costs fewer than 2 n links.  Loopy message
passing runs until messages settle.  Neighbouring tokens of one kind, each
with at least ``SURE``, become a span of that kind if no base span of any kind
meets them: cards that stand beside another number and so fail their pattern,
and later mentions without their prefix or in other groups.

Weights are learned here, in numpy, on a bounded sample: at most ``DOCS`` texts
chosen by a hash of the id, none longer than ``DOC_CHARS``.  Labels are the
base spans' kinds, part of the spans are shown without their pattern's
verdict, and some are mentioned again in another form beside made-up numbers
of the same form, so that context and linked nodes have to tell.  Everything
is seeded.

Defined cases: null text is empty; texts without digits and ``@`` have no
spans; an empty table gives an empty result; with no sampled span the field
adds nothing; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
DOCS, DOC_CHARS, SEED, SURE = 1500, 20_000, 3, 0.8
DAMPING, SETTLED, STEPS, RATE, HIDE = 0.5, 1e-4, 400, 0.1, 0.4
#: Rounds of message passing after which messages that swing are taken as they are: many times the diameter of linked groups.
ROUNDS = 200
#: Rounds of a training step, which starts from the messages of the step before.
TRAIN_ROUNDS = 3
CHAIN, SAME, SIMILAR = range(3)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A digit inside a run of digits can't start a match where the run's first one doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_HOT = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_SOME = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return (sum(map(int, digits[-1::-2])) + sum(int(twice[int(d)]) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each ``@`` ends one run of local characters."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    if not _SOME.search(text):
        return {k: [] for k in KINDS}
    cards = ((m.span(), m[0].replace(" ", "").replace("-", "")) for m in _CARD.finditer(text))
    return {
        "email": emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))],
        "card": [span for span, d in cards if 16 <= len(d) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15],
    }


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


# Features of a node: verdict of its pattern, digits of it and of its run, signs, checks, and hashed neighbouring words.
_SIZES = (1, 2, 3, 4, 5, 7, 8, 10, 11, 12, 16, 17, 20)
_RUNS = (1, 7, 8, 10, 11, 12, 16, 17, 20)
_SIGNS = "@.+(-_\"="
_WORDS = 16
N_FEATURES = 1 + len(KINDS) + len(_SIZES) + 1 + len(_RUNS) + 1 + len(_SIGNS) + 5 + 2 * _WORDS
#: Longest run of digits that is looked at as one number.
RUN_DIGITS = 40
#: Most digits of a number of each kind, which ends its span.
MOST_DIGITS = {"email": 0, "ip": 0, "card": 19, "phone": 15}


class Node:
    """A token: its place, its digits, those of its run up to it, the verdict on it, and its neighbours' words."""

    __slots__ = ("start", "end", "body", "digits", "run", "verdict", "before", "after", "joined", "met")

    def __init__(self, start, end, body):
        self.start, self.end, self.body, self.digits, self.run = start, end, body, digits_of(body), ""
        self.verdict, self.before, self.after, self.joined, self.met = 0, "", "", False, False

    def numeric(self) -> bool:
        return bool(self.digits) and not any(map(str.isalpha, self.body)) and "@" not in self.body

    def ip(self) -> bool:
        parts = self.body.strip(".,;:!?()[]").split(".")
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)


def nodes_of(text: str, base: dict) -> list[Node]:
    """The field's nodes in text order; ``joined``: the node follows the one before it in the text."""
    out: list[Node] = []

    def add(start, end):
        out.append(Node(start, end, text[start:end]))

    for m in _HOT.finditer(text):
        begin, reach = m.start(), out[-1].end if out else 0
        # The token before, if no node yet.
        stop = begin
        while stop > reach and text[stop - 1].isspace():
            stop -= 1
        if stop > reach:
            at = stop
            while at > reach and not text[at - 1].isspace():
                at -= 1
            add(at, stop)
        if not out or begin >= out[-1].end:
            add(begin, m.end())
        after = _TOKEN.search(text, m.end())
        if after and not _SOME.search(after[0]):
            add(*after.span())
    spans = sorted((a, b, 1 + k) for k, kind in enumerate(KINDS) for a, b in base[kind])
    i = 0
    for at, n in enumerate(out):
        last = out[at - 1] if at else None
        n.joined = last is not None and text[last.end : n.start].isspace()
        if last is not None and n.joined:
            n.before, last.after = last.body, n.body
        apart = last is None or not n.joined or not last.numeric() or text[last.end : n.start] != " "
        if n.numeric():
            n.run = ("" if apart else last.run)[-RUN_DIGITS:] + n.digits
        while i < len(spans) and spans[i][1] <= n.start:
            i += 1
        for a, b, verdict in spans[i : i + 8]:
            if a >= n.end:
                break
            if b > n.start:
                n.verdict, n.met = n.verdict or verdict, True
    return out


def features(n: Node, shown: int) -> list[int]:
    """Indices of the features that are on; shown: the verdict to see."""
    body, on, at = n.body, [0], 1
    if shown:
        on.append(at + shown - 1)
    at += len(KINDS)
    on.append(at + sum(len(n.digits) >= s for s in _SIZES))
    at += len(_SIZES) + 1
    on.append(at + sum(len(n.run) >= s for s in _RUNS))
    at += len(_RUNS) + 1
    on += [at + i for i, c in enumerate(_SIGNS) if c in body]
    at += len(_SIGNS)
    checks = (any(map(str.isalpha, body)), n.numeric(), 16 <= len(n.digits) <= 19 and luhn(n.digits), 16 <= len(n.run) <= 19 and luhn(n.run), n.ip())
    on += [at + i for i, x in enumerate(checks) if x]
    at += len(checks)
    for word in (n.before, n.after):
        if word and not _SOME.search(word):
            on.append(at + zlib.crc32(word.lower().encode("utf-8", "replace")) % _WORDS)
        at += _WORDS
    return on


def links_of(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """(node, later node, type)."""
    out = [(i - 1, i, CHAIN) for i, n in enumerate(nodes) if n.joined]
    first: dict = {}
    last: dict = {}
    for i, n in enumerate(nodes):
        body = n.body.lower().strip(".,;:!?()[]<>\"'")
        if "@" in body:
            keys = ((SAME, body), (SIMILAR, body.partition("@")[0]))
        elif n.ip():
            keys = ((SAME, body),)
        elif len(n.run) >= 10:
            keys = ((SAME, n.run[-10:]), (SIMILAR, n.run[-7:]))
        else:
            keys = ((SIMILAR, n.run[-7:]),) if len(n.run) >= 7 else ()
        for key in keys:
            if key in last:
                out += [(j, i, key[0]) for j in {first[key], last[key]}]
            first.setdefault(key, i)
            last[key] = i
    return out


class Field:
    """Weights of the field and message passing over many documents at once."""

    def __init__(self):
        import numpy as np

        k = len(KINDS) + 1  # label 0: other
        self.unary, self.pair = np.zeros((N_FEATURES, k)), np.zeros((3, k, k))

    def scores(self, rows):
        import numpy as np

        flat, starts = rows if isinstance(rows, tuple) else flattened(rows)
        return np.add.reduceat(self.unary[flat], starts, axis=0)

    def beliefs(self, rows, links, rounds=ROUNDS, warm=None):
        """(node probabilities, link probabilities) by damped loopy sum-product.

        warm: a list that holds the messages to start from, if any, and takes the last ones.
        """
        import numpy as np

        u = self.scores(rows)
        n, k = u.shape
        if not len(links):
            p = np.exp(u - u.max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True), np.zeros((0, k, k))
        src, dst, kind = links.T
        e = len(links)
        s, d = np.concatenate([src, dst]), np.concatenate([dst, src])
        rev = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        pot = np.exp(np.concatenate([self.pair, self.pair.transpose(0, 2, 1)]))  # by type, then by type against the link
        types = np.concatenate([kind, kind + len(self.pair)])
        groups = [np.flatnonzero(types == x) for x in range(len(pot))]
        order = np.argsort(d, kind="stable")
        heads, starts = np.unique(d[order], return_index=True)

        def total(m):
            b = u.copy()
            b[heads] += np.add.reduceat(m[order], starts, axis=0)
            return b

        m = warm[0] if warm else np.zeros((2 * e, k))
        for _ in range(rounds):
            x = total(m)[s] - m[rev]
            x = np.exp(x - x.max(axis=1, keepdims=True))
            new = np.empty_like(m)
            for g, w in zip(groups, pot):
                new[g] = x[g] @ w
            new = DAMPING * m + (1 - DAMPING) * np.log(new / new.sum(axis=1, keepdims=True))
            moved, m = float(np.abs(new - m).max()), new
            if moved < SETTLED:
                break
        if warm is not None:
            warm[:] = [m]
        b = total(m)
        both = (b[src] - m[e:])[:, :, None] + (b[dst] - m[:e])[:, None, :] + self.pair[kind]
        b, both = np.exp(b - b.max(axis=1, keepdims=True)), np.exp(both - both.max(axis=(1, 2), keepdims=True))
        return b / b.sum(axis=1, keepdims=True), both / both.sum(axis=(1, 2), keepdims=True)


def flattened(rows: list[list[int]]):
    """(features of all nodes, where each node's start)."""
    import numpy as np

    return np.fromiter((f for r in rows for f in r), np.int64), np.cumsum([0, *map(len, rows)])[:-1]


def graph(texts: list[str]):
    """(base spans per text, nodes as (number of the text, Node), links) of many texts."""
    import numpy as np

    bases, nodes, links = [], [], []
    for t, text in enumerate(texts):
        base = base_spans(text)
        bases.append(base)
        if _SOME.search(text):
            own = nodes_of(text, base)
            links += [(len(nodes) + i, len(nodes) + j, kind) for i, j, kind in links_of(own)]
            nodes += [(t, n) for n in own]
    return bases, nodes, np.array(links, np.int64).reshape(-1, 3)


def retold(text: str, base: dict, rng) -> tuple[str, list[tuple[int, int, int]]]:
    """``text`` with later mentions of some of its spans in another form, and as many made-up ones.

    Returns the new text and (start, end, label) of the mentions; this is what
    teaches the skip potentials, as forms change but the digits or the address
    stay.  Made-up cards and phones that stand beside another number, where
    their patterns fail, teach what such tokens look like by themselves.
    """
    labels, words = [], [w for w in text.split()[:50] if not _SOME.search(w)] or ["and"]

    def add(*mentions):
        nonlocal text
        text += " " + " ".join(words[int(i)] for i in rng.integers(0, len(words), 3))
        for mention, label in mentions:
            text += " "
            labels.append((len(text), len(text) + len(mention), label))
            text += mention

    def made_up(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def checked(digits, good):
        """``digits`` with a last one that makes the check digit right or wrong."""
        right = next(c for c in "0123456789" if luhn(digits[:-1] + c))
        return digits[:-1] + (right if good else str((int(right) + int(rng.integers(1, 10))) % 10))

    def form(kind, digits):
        parts = [digits[-10:-7], digits[-7:-4], digits[-4:]] if kind == "phone" else [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return "-. "[int(rng.integers(0, 3)) if kind == "phone" else 1].join(parts)

    for k, kind in enumerate(KINDS):
        for start, end in base[kind][:2]:
            body = text[start:end]
            if kind == "email":
                add((body.rpartition(".")[0], 1 + k))
                add(("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) + "@" + words[0].strip(".,") + "x", 0))
            elif kind in ("card", "phone") and len(digits_of(body)) >= 10:
                n = len(digits_of(body))
                add((form(kind, digits_of(body)), 1 + k))
                if kind == "card":
                    add((form(kind, checked(made_up(n), False)), 0))
                    other, pair = checked(made_up(16), False), [(checked(made_up(16), True), 1 + k)]
                else:
                    add((form(kind, made_up(n)), 0))
                    other, pair = made_up(9), [(re.sub("[0-9]", lambda _: made_up(1), body), 1 + k)]
                pair.insert(0 if kind == "card" and rng.random() < 0.5 else 1, (other, 0))
                add(*pair)
    return text + " " + words[0], labels


def train(texts: list[str]) -> Field | None:
    """Fit the field to the base spans of ``texts`` and to mentions made from them; None if there are none."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    told = [retold(t, base_spans(t), rng) for t in texts]
    _, nodes, links = graph([t for t, _ in told])
    told = [{(a, b): k for a, b, k in labels} for _, labels in told]

    def label(t, n):
        return next((k for (a, b), k in told[t].items() if a < n.end and n.start < b), n.verdict)

    labels = np.array([label(t, n) for t, n in nodes], np.int64)
    if not len(labels) or not labels.any():
        return None
    hidden = rng.random(len(labels)) < HIDE
    for i, (_, n) in enumerate(nodes):  # a span is hidden whole
        if i and n.joined and n.verdict and n.verdict == nodes[i - 1][1].verdict:
            hidden[i] = hidden[i - 1]
    rows = [features(n, 0 if h or n.verdict != k else n.verdict) for (_, n), h, k in zip(nodes, hidden, labels)]
    field, k = Field(), len(KINDS) + 1
    want, pairs = np.eye(k)[labels], np.eye(k)[labels[links[:, 0]]][:, :, None] * np.eye(k)[labels[links[:, 1]]][:, None, :]
    owner, flat, warm = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), flattened(rows), []
    moments = [np.zeros_like(x) for x in (field.unary, field.pair) for _ in range(2)]
    for step in range(1, STEPS + 1):
        b, both = field.beliefs(flat, links, TRAIN_ROUNDS, warm)
        gu, gp = np.zeros_like(field.unary), np.zeros_like(field.pair)
        np.add.at(gu, flat[0], (want - b)[owner])
        np.add.at(gp, links[:, 2], pairs - both)
        gp[1:] = (gp[1:] + gp[1:].transpose(0, 2, 1)) / 2  # skip potentials have no direction
        for i, (x, g) in enumerate(((field.unary, gu / len(rows)), (field.pair, gp / len(rows)))):
            g = g - 1e-4 * x
            moments[2 * i] = 0.9 * moments[2 * i] + 0.1 * g
            moments[2 * i + 1] = 0.99 * moments[2 * i + 1] + 0.01 * g * g
            x += RATE * (moments[2 * i] / (1 - 0.9**step)) / (np.sqrt(moments[2 * i + 1] / (1 - 0.99**step)) + 1e-8)
    return field


def spans_of(text: str, nodes: list[Node], kinds: list[int]) -> list[tuple[str, int, int]]:
    """Spans of neighbouring nodes of one kind (0: none) that no base span meets, without the signs around them."""
    out, held = [], []  # held: nodes of the open span

    def close():
        if held:
            start, end = held[0].start, held[-1].end
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
                end -= 1
            if any("0" <= c <= "9" or c == "@" for c in text[start:end]):
                out.append((kind, start, end))
            held.clear()

    kind, digits = "", 0
    for n, k in zip(nodes, kinds):
        name = KINDS[k - 1] if k and not n.met else ""
        goes_on = held and name == kind and n.joined and not n.body.startswith("+") and digits + len(n.digits) <= MOST_DIGITS[name]
        if not goes_on:
            close()
            digits = 0
        if name:
            kind = name
            held.append(n)
            digits += len(n.digits)
    close()
    return out


def found(texts: list[str], field: Field | None, sure: float = SURE) -> list[tuple[dict, dict]]:
    """(base spans, all spans) of each text."""
    import numpy as np

    bases, nodes, links = graph(texts)
    every = [{k: [*v] for k, v in b.items()} for b in bases]
    if field is not None and nodes:
        belief, _ = field.beliefs([features(n, n.verdict) for _, n in nodes], links)
        best = np.where(belief.max(axis=1) >= sure, belief.argmax(axis=1), 0).tolist()
        at = 0
        while at < len(nodes):
            t, end = nodes[at][0], at
            while end < len(nodes) and nodes[end][0] == t:
                end += 1
            if any(best[at:end]):
                for kind, a, b in spans_of(texts[t], [n for _, n in nodes[at:end]], best[at:end]):
                    every[t][kind].append((a, b))
            at = end
    return list(zip(bases, every))


def sample(docs: DataFrame, limit: int = DOCS) -> list[str]:
    """At most ``limit`` texts of at most DOC_CHARS with a digit or an @, the same whatever the partitioning."""
    docs = docs.filter((F.length("text") <= DOC_CHARS) & F.col("text").rlike("[0-9@]"))
    n = docs.count()
    share = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(max(1, n // (2 * limit))))
    some = docs.filter(share == 0).select(F.xxhash64(F.lit(SEED + 1), "doc_id", "text").alias("h"), "text")
    return [r["text"] for r in some.orderBy("h", "text").limit(limit).collect()]


def personal_data(docs: DataFrame, field: Field | None) -> DataFrame:
    """The query's columns for every row of ``docs``."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = found([t or "" for t in part.column("text").to_pylist()], field)
                counts = [pa.array([len(b[k]) for b, _ in got], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digests, pa.array([joined(e) for _, e in got], pa.string()), pa.array([sum(map(len, e.values())) for _, e in got], pa.int64())], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def identified(docs: DataFrame) -> DataFrame:
    return personal_data(docs, train(sample(docs)))
