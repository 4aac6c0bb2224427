"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A text is cut by the vocabulary's pattern; each piece is encoded alone.  Bytes
are mapped to Latin-1 characters so that one Aho-Corasick automaton
(pyahocorasick) lists every vocabulary entry at every position of a piece.
The encoder takes the longest entry that is *compatible* with the one before
it, that is, whose concatenation with it encodes to exactly these two tokens;
when none is left it steps back and marks the position as dead.  A prefix of
a piece has at most one compatible token sequence, so a dead position is never
tried again and the work is linear in the piece.  Compatibility of two tokens
is found once by the merge rule itself and memoised.  Entries that the merge
rule cannot reach are left out of the automaton; a piece that is such an entry
as a whole still gets its id, as in the public encoder.

Pieces repeat, so a bounded memo holds their ids.  Texts stream through Arrow
batches; nothing is shuffled.

Defined cases: a null text counts as empty and gives no ids; null and repeated
doc_ids pass through; very long pieces stay linear; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Memo, small_batches

MEMO_PIECES, MEMO_PAIRS = 150_000, 400_000
ROWS = 512


def class_body(prop: str, last: int) -> str:
    """Body of a character class with the code points up to ``last`` that have a property."""
    import regex

    of, out, start, prev = regex.compile(prop), [], None, None
    for c in (*range(0xD800), *range(0xE000, 0x110000)):
        if c > last:
            break
        if of.match(chr(c)):
            if start is None or c != prev + 1:
                if start is not None:
                    out.append((start, prev))
                start = c
            prev = c
    if start is not None:
        out.append((start, prev))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=16)
def splitter(pattern: str, last: int):
    """The pattern for Python's ``re``, exact for texts whose code points are at most ``last``."""
    bodies = {p: class_body(p, last) for p in (r"\s", r"\p{L}", r"\p{N}")}
    inside = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\s|\\p\{[LN]\}", lambda p: bodies[p[0]], m[0]), pattern)
    outside = re.sub(r"(\\p\{[LN]\}|\\s|\\S)", lambda m: f"[^{bodies[chr(92) + 's']}]" if m[0] == r"\S" else f"[{bodies[m[0]]}]", inside)
    return re.compile(outside).findall


def pieces(text: str, pattern: str) -> list[str]:
    """Matches of ``pattern``, with tables only as large as the text needs (long astral tables slow each miss)."""
    if text.isascii():
        return splitter(pattern, 0x7F)(text)
    return splitter(pattern, 0xFFFF if len(text.encode("utf-16-le")) == 2 * len(text) else 0x10FFFF)(text)


class ByteBPE(Memo):
    """Memo from a piece to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        super().__init__(MEMO_PIECES)
        self.ranks, self.pattern = ranks, pattern
        self.token = {v: k for k, v in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.merged(token) == [rank]:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """Ids by the merge rule itself; only for short byte strings."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starts: list[list] = [[] for _ in range(n)]  # by start, shortest first
        for end, (size, rank) in self.automaton.iter(piece.decode("latin-1")):
            starts[end - size + 1].append((size, rank))
        for held in starts:
            held.sort()
        alive, out, pos = bytearray(b"\1") * (n + 1), [], 0
        left = len(starts[0])
        while pos < n:
            held, before = starts[pos], out[-1][1] if out else -1
            while left:
                left -= 1
                size, rank = held[left]
                if alive[pos + size] and (before < 0 or self.compatible(before, rank)):
                    out.append((pos, rank, left))
                    pos += size
                    left = len(starts[pos]) if pos < n else 0
                    break
            else:
                alive[pos] = 0
                pos, _, left = out.pop()
        return [rank for _, rank, _ in out]

    def find(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8"))
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pieces(text, self.pattern)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return ByteBPE(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]) per row of ``docs``; ids: little-endian unsigned 32-bit integers.

    ``decoded`` adds the bytes that the ids stand for, in the same pass: a
    second pass would keep a second Python worker, with its own memo, per task.
    """
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]

    def run(batches):
        import numpy as np

        bpe = load(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.old = {}  # workers live on, for other stages too

    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that the ids stand for."""
    names = encoded.columns

    def run(batches):
        import numpy as np

        bpe = load(path, pattern)
        for batch in batches:
            out = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    return small_batches(encoded).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The query's columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, path, pattern, True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
