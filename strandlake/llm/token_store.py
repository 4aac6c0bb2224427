"""Token-id files: a content-addressed store of id chunks with recipes and Merkle manifests.

``write`` encodes every text and writes, below one folder,

* ``encoded``: the encoder's output as a staging table (each text is encoded
  once), removed at the end;
* ``packs``: binary files of unique id chunks.  A rolling hash over the last
  ``WINDOW`` ids cuts an id stream where its low bits are zero, so equal runs
  of ids in different documents become equal chunks; each distinct chunk is
  stored once, under the SHA-256 of its ids;
* ``recipes``: binary files, in ascending doc_id order, with each document's
  id, length, chunk digests and Merkle root;
* manifests (Parquet) with the files that committed tasks wrote, their counts
  and the Merkle root over their entries.

``read`` scans both kinds of files, recomputes every chunk digest and every
file's Merkle root, joins recipes to chunks by digest, and rebuilds each
document, checking its root and length; the query's results come from the ids
so rebuilt.  ``summaries`` puts checksums together from those of the chunks
without moving one.  Only digests and compressed chunks are shuffled.  A task
writes under a name of its own and a manifest lists only files of tasks that
finished, so lost executors and repeated tasks do no harm.

File formats (little-endian).  Pack: ``TOKPACK1``, then per chunk 32 bytes
digest, u32 length, that many bytes of zstd over ids (u16 if the vocabulary
fits, else u32).  Recipe: ``TOKRECI1``, then per document u8 (1: has id),
i64 doc_id, u64 ids, u32 chunks, 32 bytes root, 32 bytes a chunk.

Defined cases: null text is empty and gives the end id alone; null doc_ids sort
first; rows that share a doc_id are documents of their own, in the order of
their texts' hashes; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Memo, open_fs, remove, save, scratch, small_batches

WINDOW, CUT_BITS, MIN_IDS, MAX_IDS = 8, 10, 256, 8192
MEMO_WORDS = 500_000
PACK, RECIPE = b"TOKPACK1", b"TOKRECI1"

#: White space to Python's split() that is none to the tokenizer.
_NO_SPACE = "\x1c\x1d\x1e\x1f"


#: A run of Latin-1 letters between ASCII punctuation other than the apostrophe.
_P = r"[!-&(-/:-@\[-`{-~]*"
_PLAIN = re.compile(f"({_P})([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)({_P})")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


#: The normaliser and the pre-tokenizer for which the rules of ``WordEncoder`` hold.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(path: str) -> bool:
    """Whether the tokenizer in ``path`` is of the make whose texts can be encoded word by word."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    whole = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["content"].split() == [t["content"]] for t in made.get("added_tokens") or [])
    plain = (made["normalizer"], made["pre_tokenizer"], made["model"]["type"], made.get("truncation"), made.get("padding")) == (NORMALISER, PRE_TOKENIZER, "BPE", None, None)
    return whole and plain and not made["model"].get("dropout")


class TextEncoder:
    """Any tokenizer, text by text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class WordEncoder(Memo):
    """Memo from a white-space free run to its ids (u32 bytes), for a tokenizer of which ``by_words`` holds.

    The tokenizer's normaliser and pre-tokenizer drop white space and never
    look across it, so encoding runs one by one equals encoding the text.
    Normalising leaves a lower-cased Latin-1 word as it is, and the
    pre-tokenizer cuts it from the punctuation around it, so such runs go
    straight to the tokenizer's model; all others, and runs with the text of an
    added token in them, take its whole pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(MEMO_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.size = self.tokenizer.model, self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()

    def find(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.part(word.lower())
        if (m := _PLAIN.fullmatch(word)) is None or any(t in word for t in self.added):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        before, core, after = m.groups()
        if before or after:
            return (self[before] if before else b"") + self[core] + (self[after] if after else b"")
        return self.part(core.lower().encode("utf-8").decode("latin-1").translate(self.letters))

    def part(self, text: str) -> bytes:
        """Ids of one pre-token in the vocabulary's letters."""
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, runs(text)))


def runs(text: str) -> list[str]:
    if any(c in text for c in _NO_SPACE):
        return re.split(r"[ \t-\r]+", text)
    return text.split()


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder | TextEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path) if by_words(path) else TextEncoder(path)


@lru_cache(maxsize=1)
def gear():
    """A random 32-bit value for each residue of an id, fixed by its seed."""
    import numpy as np

    return np.random.default_rng(20).integers(0, 2**32, 65536, dtype=np.uint32)


def marks(ids):
    """Ends where the rolling hash over the last WINDOW ids has CUT_BITS zero bits on top."""
    import numpy as np

    g, n = gear()[ids & 0xFFFF], len(ids)
    h = g.copy()
    for k in range(1, min(WINDOW, n)):
        h[k:] += g[: n - k] << np.uint32(k * (32 // WINDOW))
    return np.flatnonzero(h < 1 << (32 - CUT_BITS)) + 1


def cuts(n: int, ends: list[int]) -> list[int]:
    """Ends of the chunks of n ids: at marks, MIN_IDS to MAX_IDS apart (so no window reaches before the ids)."""
    out, last = [], 0
    for at in ends:
        while at - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if at - last >= MIN_IDS:
            out.append(at)
            last = at
    while n - last > MAX_IDS:
        last += MAX_IDS
        out.append(last)
    return out if out and last == n else [*out, n]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged; no leaves: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, turn, n_tokens, digests, payloads): the chunks of each text's ids, compressed; turn: the text's hash."""

    def run(batches):
        import numpy as np
        import zstandard

        words, press = load(path), zstandard.ZstdCompressor(level=1)
        narrow = np.dtype("<u2" if words.size <= 65536 else "<u4")
        end = struct.pack("<I", end_id)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i in range(0, len(texts), 256):
                coded = [words.encode(t) + end for t in texts[i : i + 256]]
                every, at = np.frombuffer(b"".join(coded), "<u4"), 0
                marked = marks(every)
                counts, digests, payloads = [len(x) // 4 for x in coded], [], []
                for n in counts:
                    ids = every[at : at + n]
                    inside = marked[np.searchsorted(marked, at, "right") : np.searchsorted(marked, at + n, "right")] - at if n > MIN_IDS else marked[:0]
                    ends = cuts(n, inside.tolist())
                    parts = [ids[a:b] for a, b in zip([0, *ends], ends)]
                    digests.append([hashlib.sha256(p.tobytes()).digest() for p in parts])
                    payloads.append([press.compress(p.astype(narrow).tobytes()) for p in parts])
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 256), batch.column("turn").slice(i, 256), pa.array(counts, pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(payloads, pa.list_(pa.binary()))],
                    names=["doc_id", "turn", "n_tokens", "digests", "payloads"],
                )

    held = small_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("turn"))
    return held.mapInArrow(run, "doc_id long, turn long, n_tokens long, digests array<binary>, payloads array<binary>")


def _writer(folder: str, magic: bytes, entries):
    """A mapInArrow function: one file a task with what ``entries(batch)`` yields as (bytes, leaf, ids); one manifest row."""

    def run(batches):
        fs, base = open_fs(folder)
        out, leaves, tokens, name = None, [], 0, f"{base}/part-{uuid.uuid4().hex}.bin"
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(name)
                out.write(magic)
            for data, leaf, n in entries(batch):
                out.write(data)
                leaves.append(leaf)
                tokens += n
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [f"{folder}/{name.rsplit('/', 1)[1]}"], "entries": [len(leaves)], "tokens": [tokens], "root": [merkle(leaves)]})

    return run


MANIFEST = "part long, file string, entries long, tokens long, root binary"


def write(docs: DataFrame, path: str, folder: str, end_id: int) -> None:
    encoded = save(encode(docs, path, end_id), f"{folder}/encoded")

    def packed(batch):
        for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield digest + struct.pack("<I", len(payload)) + payload, digest, 0

    def recipe(batch):
        for doc_id, n, digests in zip(*(batch.column(k).to_pylist() for k in range(3))):
            root = merkle(digests)
            yield struct.pack("<BqQI", doc_id is not None, doc_id or 0, n, len(digests)) + root + b"".join(digests), root, n

    # Equal digests with unlike chunks would both stay here and fail when read.
    unique = encoded.select(F.explode(F.arrays_zip("digests", "payloads")).alias("c")).select("c.digests", "c.payloads").distinct()
    save(unique.mapInArrow(_writer(f"{folder}/packs", PACK, packed), MANIFEST), f"{folder}/packs-manifest")
    ordered = encoded.select("doc_id", "turn", "n_tokens", "digests").repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn")
    save(ordered.select("doc_id", "n_tokens", "digests").mapInArrow(_writer(f"{folder}/recipes", RECIPE, recipe), MANIFEST), f"{folder}/recipes-manifest")
    remove(f"{folder}/encoded")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with ``base``, the ids in the files before; one file a task."""
    held = spark.read.parquet(path)
    n = held.count()  # files, not rows
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("base", before).repartitionByRange(max(1, n), "file")


def _damaged(file: str) -> RuntimeError:
    return RuntimeError(f"{file} doesn't match its manifest")


def read_packs(files: DataFrame) -> DataFrame:
    """(digest, n, crc, payload) of every stored chunk, the digest recomputed from its n ids; crc: their CRC-32."""
    names = ["digest", "n", "crc", "payload"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["file"])
                leaves, out = [], []
                with fs.open_input_stream(at) as f:
                    if f.read(8) != PACK:
                        raise _damaged(row["file"])
                    while head := f.read(36):
                        digest, payload = head[:32], f.read(struct.unpack("<I", head[32:])[0])
                        raw = unpack.decompress(payload)
                        read_as = (np.frombuffer(raw, t).astype("<u4").tobytes() for t in ("<u2", "<u4") if len(raw) % np.dtype(t).itemsize == 0)
                        ids = next((x for x in read_as if hashlib.sha256(x).digest() == digest), None)
                        if ids is None:
                            raise _damaged(row["file"])
                        leaves.append(digest)
                        out.append((digest, len(ids) // 4, zlib.crc32(ids), payload))
                        if len(out) == 512:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                            out = []
                if len(leaves) != row["entries"] or merkle(leaves) != row["root"]:
                    raise _damaged(row["file"])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return files.select("file", "entries", "root").mapInArrow(run, "digest binary, n long, crc long, payload binary")


def read_recipes(files: DataFrame) -> DataFrame:
    """(part, ordinal, doc_id, start, n_tokens, root, digests) of every document."""
    names = ["part", "ordinal", "doc_id", "start", "n_tokens", "root", "digests"]
    kinds = pa.schema(list(zip(names, [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.binary())])))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["file"])
                start, leaves, out = row["base"], [], []
                with fs.open_input_stream(at) as f:
                    if f.read(8) != RECIPE:
                        raise _damaged(row["file"])
                    while head := f.read(53):
                        known, doc_id, n, k = struct.unpack("<BqQI", head[:21])
                        digests = f.read(32 * k)
                        out.append((row["part"], len(leaves), doc_id if known else None, start, n, head[21:], [digests[i : i + 32] for i in range(0, 32 * k, 32)]))
                        leaves.append(head[21:])
                        start += n
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=kinds)
                            out = []
                if len(leaves) != row["entries"] or merkle(leaves) != row["root"] or start != row["base"] + row["tokens"]:
                    raise _damaged(row["file"])
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=kinds)

    return files.select("part", "file", "entries", "tokens", "root", "base").mapInArrow(run, "part long, ordinal long, doc_id long, start long, n_tokens long, root binary, digests array<binary>")


def rebuilt(spark: SparkSession, folder: str, carried: list[str]) -> DataFrame:
    """Every document with ``parts``, its chunks in order: position, digest and the ``carried`` columns of ``read_packs``."""
    recipes = read_recipes(_files(spark, f"{folder}/recipes-manifest"))
    chunks = read_packs(_files(spark, f"{folder}/packs-manifest")).select("digest", *carried)
    key = ["part", "ordinal"]
    wanted = recipes.select(*key, "doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    # Spark takes the chunks for as small as the list of files: never broadcast them.
    joined = wanted.hint("merge").join(chunks, "digest", "left")
    return joined.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("doc_id", "start", "n_tokens", "root")], F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("parts")
    )


def _checked(row: dict, n: int) -> None:
    if merkle([p["digest"] for p in row["parts"]]) != row["root"] or n != row["n_tokens"]:
        raise RuntimeError("a document can't be rebuilt from its chunks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, rebuilt and verified; ids: u32 bytes."""

    def run(batches):
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row in batch.select(["n_tokens", "root", "parts"]).to_pylist():
                _checked(row, sum(p["n"] or 0 for p in row["parts"]))
                raw = [(unpack.decompress(p["payload"]), p["n"]) for p in row["parts"]]
                out.append(b"".join(np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in raw))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    whole = rebuilt(spark, folder, ["n", "payload"])
    return whole.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


#: Fixed value: the CRC-32 polynomial, lowest power in the highest bit.
CRC_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC_POLY, bit-reversed."""
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out ^= b
            a ^= bit
        b = (b >> 1) ^ CRC_POLY if b & 1 else b >> 1
        bit >>= 1
    return out


@lru_cache(maxsize=65536)
def _shift(n: int) -> int:
    """x to the power 8 n."""
    out, square, n = 1 << 31, 1 << 30, 8 * n
    while n:
        if n & 1:
            out = _times(square, out)
        square, n = _times(square, square), n >> 1
    return out


def crc_of(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from the parts' (CRC-32, bytes)."""
    crc = 0
    for part, n in parts:
        crc = _times(_shift(n), crc) ^ part
    return crc


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document.

    All files are read and verified, but a document's checksum is put together
    from those of its chunks, so no chunk is shuffled.
    """

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.select(["n_tokens", "root", "parts"]).to_pylist():
                _checked(row, sum(p["n"] or 0 for p in row["parts"]))
                out.append(crc_of([(p["crc"], 4 * p["n"]) for p in row["parts"]]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    whole = rebuilt(spark, folder, ["n", "crc"])
    return whole.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """The query's columns: write ``docs``, read the files back."""
    folder = scratch(docs.sparkSession, "tokens")
    write(docs, path, folder, end_id)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
