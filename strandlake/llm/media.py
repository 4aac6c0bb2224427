"""Media columns: signature sniffing, format validation, type correction and carving.

One Aho-Corasick automaton holds the magic bytes of every known format; it
lists all candidate places in a binary value in one pass.  A candidate counts
only if the format's validator walks its structure and finds its length inside
the value (chunk lengths and checksums for PNG, block chains for GIF, RIFF
chunk sizes for WAV, and so on).  A valid candidate at offset 0 names the
value's type whatever was declared; others that lie in no earlier one are
carved.

``store`` keeps texts losslessly as 8-bit mono PCM WAV, one byte a sample,
padded with zero bytes to a positive multiple of 64; ``features`` reads the
stored values back and finds the samples through the sniffer, not through the
declared type.

Defined cases: null text is empty and becomes 64 zero bytes; null media gives
null features; equal texts give equal values; repeated rows and null ids pass
through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.common import save, scratch, small_batches

BLOCK, RATE, ROWS = 64, 8000, 256
DECLARED = "application/octet-stream"


def png(d: bytes, at: int, memo: dict) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(d):
        size, kind = struct.unpack(">I4s", d[pos : pos + 8])
        end = pos + 12 + size
        if end > len(d) or (first and (kind != b"IHDR" or size != 13)) or struct.unpack(">I", d[end - 4 : end])[0] != zlib.crc32(d[pos + 4 : end - 4]):
            return 0
        if kind == b"IEND":
            return end - at
        pos, first = end, False
    return 0


def followed(pos: int, step, ends: dict):
    """Where the chain of places pos, step(pos), ... ends, its last place; ``ends`` remembers it for each, so no place is walked twice."""
    seen = []
    while pos not in ends:
        seen.append(pos)
        after = step(pos)
        if after is None:
            ends[pos] = pos
        else:
            pos = after
    ends |= dict.fromkeys(seen, ends[pos])
    return ends[pos]


def gif(d: bytes, at: int, memo: dict) -> int:
    def blocks(pos):
        return followed(pos, lambda p: p + d[p] + 1 if p < len(d) and d[p] else None, memo.setdefault("gif blocks", {})) + 1

    def table(flags):
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def part(pos):
        if pos < len(d) and d[pos] == 0x21:
            return blocks(pos + 2)
        return blocks(pos + 10 + table(d[pos + 9]) + 1) if pos + 10 < len(d) and d[pos] == 0x2C else None

    if at + 13 > len(d) or d[at + 3 : at + 6] not in (b"87a", b"89a"):
        return 0
    last = followed(at + 13 + table(d[at + 10]), part, memo.setdefault("gif parts", {}))
    return last + 1 - at if last < len(d) and d[last] == 0x3B else 0


def jpeg(d: bytes, at: int, memo: dict) -> int:
    pos, scanned = at + 2, False
    while pos + 2 <= len(d) and d[pos] == 0xFF:
        mark = d[pos + 1]
        if mark == 0xD9:
            return pos + 2 - at if scanned else 0
        if mark == 0xFF:
            pos += 1
            continue
        if mark < 0xC0 or pos + 4 > len(d):
            return 0
        pos += 2 + struct.unpack(">H", d[pos + 2 : pos + 4])[0]
        if mark == 0xDA:  # entropy-coded data up to the next real marker
            scanned = True
            while (pos := d.find(b"\xff", pos)) >= 0 and pos + 1 < len(d) and (d[pos + 1] == 0 or 0xD0 <= d[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return 0
    return 0


def riff(d: bytes, at: int) -> list[tuple[bytes, int, int]]:
    """(id, start, size) of the chunks of a RIFF file, empty if they don't fit it."""
    if at + 12 > len(d):
        return []
    end, pos, out = at + 8 + struct.unpack("<I", d[at + 4 : at + 8])[0], at + 12, []
    if end > len(d):
        return []
    while pos + 8 <= end:
        kind, size = struct.unpack("<4sI", d[pos : pos + 8])
        if pos + 8 + size > end:
            return []
        out.append((kind, pos + 8, size))
        pos += 8 + size + (size & 1)
    return out if pos >= end else []


def wav(d: bytes, at: int, memo: dict) -> int:
    kinds = [k for k, _, _ in riff(d, at)]
    ok = d[at + 8 : at + 12] == b"WAVE" and b"fmt " in kinds and b"data" in kinds
    return 8 + struct.unpack("<I", d[at + 4 : at + 8])[0] if ok else 0


def bmp(d: bytes, at: int, memo: dict) -> int:
    if at + 30 > len(d):
        return 0
    size, reserved, offset, header, width, height, planes, bits = struct.unpack("<IIIIiiHH", d[at + 2 : at + 30])
    return size if reserved == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height and 14 + header <= offset <= size <= len(d) - at else 0


def pdf(d: bytes, at: int, memo: dict) -> int:
    if not (d[at + 5 : at + 6].isdigit() and d[at + 6 : at + 7] == b"." and d[at + 7 : at + 8].isdigit()):
        return 0
    nextone = d.find(b"%PDF-", at + 8)
    end = d.rfind(b"%%EOF", at, nextone if nextone >= 0 else len(d))
    return end + 5 - at if end >= 0 and d.find(b"startxref", at, end) >= 0 else 0


def zip_ends(d: bytes) -> dict[int, int]:
    """Start of each archive in ``d`` and the end of the first end record that points to it, from one pass over these."""
    out, end = {}, -1
    while (end := d.find(b"PK\x05\x06", end + 1)) >= 0 and end + 22 <= len(d):
        count, size, offset, note = struct.unpack("<HIIH", d[end + 10 : end + 22])
        if end + 22 + note <= len(d) and (not count or d[end - size : end - size + 4] == b"PK\x01\x02"):
            out.setdefault(end - size - offset, end + 22 + note)
    return out


def zipped(d: bytes, at: int, memo: dict) -> int:
    if "zip" not in memo:
        memo["zip"] = zip_ends(d)
    return memo["zip"].get(at, at) - at


def gz(d: bytes, at: int, memo: dict) -> int:
    inflate, pos = zlib.decompressobj(31), at
    try:
        while pos < len(d) and not inflate.eof:
            inflate.decompress(d[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return 0
    return min(pos, len(d)) - len(inflate.unused_data) - at if inflate.eof else 0


def ogg(d: bytes, at: int, memo: dict) -> int:
    def page(pos):
        """End of the page at ``pos``, 0 if there is none."""
        if d[pos : pos + 4] != b"OggS" or pos + 27 > len(d) or d[pos + 4] != 0:
            return 0
        segments = d[pos + 26]
        end = pos + 27 + segments + sum(d[pos + 27 : pos + 27 + segments])
        return end if end <= len(d) and pos + 27 + segments <= len(d) else 0

    last = followed(at, lambda pos: page(pos) if page(pos) and not d[pos + 5] & 4 else None, memo.setdefault("ogg", {}))
    return page(last) - at if page(last) else 0


#: Each format's magic bytes, and its validator, which returns the length or 0 (memo: what validators
#: remember about one value, so that many candidates don't walk the same chain).
FORMATS = {
    "image/png": (b"\x89PNG\r\n\x1a\n", png),
    "image/gif": (b"GIF8", gif),
    "image/jpeg": (b"\xff\xd8\xff", jpeg),
    "image/bmp": (b"BM", bmp),
    "audio/wav": (b"RIFF", wav),
    "audio/ogg": (b"OggS", ogg),
    "application/pdf": (b"%PDF-", pdf),
    "application/zip": (b"PK\x03\x04", zipped),
    "application/gzip": (b"\x1f\x8b\x08", gz),
}


@lru_cache(maxsize=1)
def signatures():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, (magic, _) in FORMATS.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def media_in(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media in ``data``, outermost ones only, by offset."""
    out, free, memo = [], 0, {}
    for end, (kind, size) in signatures().iter(data.decode("latin-1")):
        at = end - size + 1
        if at >= free and (length := FORMATS[kind][1](data, at, memo)):
            out.append((kind, at, length))
            free = at + length
    return out


def sniff(data: bytes, declared: str | None) -> tuple[str, list[tuple[str, int, int]]]:
    """(type, carved media): what starts at offset 0 corrects the declared type."""
    found = media_in(data)
    if found and found[0][1] == 0:
        return found[0][0], found[1:]
    return ("application/octet-stream" if declared in FORMATS or declared is None else declared), found


def as_wav(payload: bytes) -> bytes:
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    return next(media[start : start + size] for kind, start, size in riff(media, 0) if kind == b"data")


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media) per row of ``docs``."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                raw = [(t or "").encode("utf-8") for t in batch.column("text").slice(i, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, ROWS), pa.array([len(x) for x in raw], pa.int64()), pa.array([DECLARED] * len(raw)), pa.array([as_wav(padded(x)) for x in raw], pa.binary())],
                    names=["doc_id", "n_bytes", "declared", "media"],
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, declared string, media binary")


def store(docs: DataFrame) -> DataFrame:
    """The encoded media, written to the shared folder and read again."""
    return save(encode(docs), scratch(docs.sparkSession, "media"))


def opened(media: bytes, declared: str | None) -> tuple[bytes, str]:
    """The payload of a value (a WAV's samples, else the value itself), and its type, structure and carved media as text.

    What the value *is* decides, not what it was declared as.
    """
    kind, carved = sniff(media, declared)
    parts, body = [kind, f"was={declared}"], media
    if kind == "audio/wav":
        at = next(start for k, start, _ in riff(media, 0) if k == b"fmt ")
        code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at : at + 16])
        body = samples(media)
        carved = carved + media_in(body)
        parts += [f"format={code}", f"channels={channels}", f"rate={rate}", f"bits={bits}", f"samples={len(body) * 8 // max(1, bits * channels)}"]
    return body, ";".join([*parts, "carved=" + ",".join(f"{k}@{a}+{n}" for k, a, n in carved)])


def features(media: DataFrame) -> DataFrame:
    """The query's columns, from stored media (doc_id, n_bytes, declared, media)."""

    def row(data, declared):
        if data is None:
            return (None,) * 6
        body, feature = opened(data, declared)
        return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                rows = [row(*x) for x in zip(part.column("media").to_pylist(), part.column("declared").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["doc_id", "n_bytes", *names])

    return small_batches(media).select("doc_id", "n_bytes", "declared", "media").mapInArrow(
        run, f"doc_id {dict(media.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
