"""WARC archives: a writer and a splittable reader.

``write`` puts one record per page into gzip-per-record WARC 1.1 files.  Pages
whose payload (the html in UTF-8) has at least ``REVISIT_BYTES`` bytes and
equals that of a page with a smaller page_id become ``revisit`` records that
refer to the smallest; all others are ``response`` records.  The smallest
page_id of each payload digest comes from a grouped minimum, and only digests
with more than one page are joined back, so a payload that a third of all
pages share costs one row per task.

``read`` splits every file into byte ranges.  A task scans its range for gzip
magic, takes a candidate as a record only if it inflates to a WARC version
line, whole headers and the announced content length, and owns the records
that *start* in its range; it reads past the end for the last one.  After a
valid record the next one starts where it ends, and a file's first at its
first byte; a place where a record must start and none does is an error.  The
record that follows a range's last one is looked at too, so the chain of
records is checked without a gap and a damaged one never vanishes.  Payload
digests are computed from the payloads read and checked against the headers.

Records of other writers are read as well: a record id or reference that is no
``urn:page`` number gives null, a missing length header the payload's own
length (null for a revisit), a digest of another kind the payload's SHA-256
(null for a revisit); warcinfo, request and other records come with their
type, their payload being the block.

A task writes under a name of its own and the manifest lists files of tasks
that finished, so lost executors and repeated tasks do no harm.

Defined cases: null html is an empty payload (response); a null url is
written as an empty target; rows that share page_id and payload are responses
or revisits alike; a null page_id is kept, and never referred to unless all
its copies are null; empty tables give no files and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import open_fs, save, scratch, small_batches

REVISIT_BYTES = 100
SPLIT_BYTES = 8 << 20
PROBE_BYTES = 64 << 10
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "file string, bytes long, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def classified(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    html = F.coalesce("html", F.lit(""))
    held = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    long_enough = F.octet_length("html") >= REVISIT_BYTES
    first = held.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    return held.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member with a response or revisit record."""
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(' ' if c in chr(13) + chr(10) else c for c in url or '')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = HTTP + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives below ``folder``; returns the manifest (file, bytes, records)."""

    def run(batches):
        fs, base = open_fs(folder)
        out, name, size, n = None, f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                page_id, url, html, digest, refers_to = row
                data = record(page_id, url, html.encode("utf-8"), digest, refers_to)
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return save(small_batches(classified(pages)).mapInArrow(run, MANIFEST), f"{folder}-manifest")


def parsed(data: bytes) -> dict | None:
    """The record in an inflated member, or None if it isn't one: headers, ``block``."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        return None
    found = {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in lines[1:]) if s}
    size = found.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        return None
    return found | {"block": rest[:-4]}


class Range:
    """Records of one file that start in [start, end)."""

    def __init__(self, f, start: int, end: int, total: int, strict: bool = False):
        """strict: the file is records from its first byte to its last, so that a gap is an error."""
        self.f, self.start, self.end, self.total, self.strict = f, start, end, total, strict

    def bytes_from(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(min(n, self.total - at))

    def member(self, held: bytes, at: int, base: int):
        """(inflated bytes, end) of the gzip member at file offset ``at``, or None; held: bytes from offset base on."""
        inflate, out, head = zlib.decompressobj(31), [], b""
        chunk, pos = held[at - base : at - base + PROBE_BYTES], at
        try:
            while chunk:
                out.append(inflate.decompress(chunk))
                if len(head) < len(VERSION):  # a candidate is given up after its first bytes
                    head = (head + out[-1])[: len(VERSION)]
                    if not VERSION.startswith(head):
                        return None
                pos += len(chunk)
                if inflate.eof:
                    return b"".join(out), pos - len(inflate.unused_data)
                chunk = held[pos - base : pos - base + PROBE_BYTES] or self.bytes_from(pos, PROBE_BYTES)
        except zlib.error:
            return None
        return None

    def records(self):
        base, held = self.start, self.bytes_from(self.start, self.end - self.start + 2)
        at, due = self.start, self.strict and self.start == 0  # due: a record must start at ``at``
        while at < self.end:
            found = at - base if due else held.find(MAGIC, at - base)
            if found < 0 or base + found >= self.end:
                return
            at = base + found
            whole = self.member(held, at, base)
            record = parsed(whole[0]) if whole else None
            if record is None:
                if due:
                    raise ValueError(f"no record at byte {at}")
                at += 1
                continue
            yield record
            at, due = whole[1], self.strict
        if due and at < self.total:
            whole = self.member(self.bytes_from(at, PROBE_BYTES), at, at)
            if whole is None or parsed(whole[0]) is None:
                raise ValueError(f"no record at byte {at}")


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the files in ``manifest`` (file, bytes, ...), as ``RECORD``."""
    ranges = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / split_bytes))).alias("k"))
    n = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0))).first()[0]
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()])))

    def number(text):
        text = text.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.removeprefix("-").isdecimal() and text.isascii() else None

    def row_of(x):
        kind, http = x.get("warc-type"), x.get("content-type", "").startswith("application/http")
        payload = x["block"].partition(b"\r\n\r\n")[2] if http else x["block"]
        size, (name, _, digest) = x.get("x-payload-length", ""), x.get("warc-payload-digest", "").partition(":")
        size = int(size) if size.isdecimal() else None if kind == "revisit" else len(payload)
        if name.lower() != "sha256" or len(digest) != 64:
            digest = None if kind == "revisit" else hashlib.sha256(payload).hexdigest()
        if kind != "revisit" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("a payload doesn't match its digest")
        return number(x.get("warc-record-id", "")), x.get("warc-target-uri"), size, digest, kind, number(x.get("warc-refers-to", "")), payload

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["file"])
                out, held = [], 0
                try:
                    with fs.open_input_file(at) as f:
                        for x in Range(f, row["k"] * split_bytes, min((row["k"] + 1) * split_bytes, row["bytes"]), row["bytes"], True).records():
                            out.append(row_of(x))
                            held += len(out[-1][-1])
                            if held > 4 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kinds)], schema=kinds)
                                out, held = [], 0
                except ValueError as e:
                    raise RuntimeError(f"{row['file']} is damaged: {e}") from e
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kinds)], schema=kinds)

    return ranges.repartitionByRange(max(1, int(n)), "file", "k").mapInArrow(run, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """The query's columns: write ``pages``, read the archives back."""
    manifest = write(pages, scratch(pages.sparkSession, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
