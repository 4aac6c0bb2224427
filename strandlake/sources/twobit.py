"""Genomes in 2bit format, read by range through Hadoop-independent seekable files."""

from __future__ import annotations

import struct
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: its signature and the base of each two-bit code.
SIGNATURE, BASES = 0x1A412743, "TCAG"
CHUNK = 1 << 20


class TwoBit:
    """One open file: catalogue of sequences, and decoding of any range of one."""

    def __init__(self, f):
        self.f = f
        head = self._at(0, 16)
        self.order = "<" if struct.unpack("<I", head[:4])[0] == SIGNATURE else ">"
        signature, version, count, _ = struct.unpack(self.order + "4I", head)
        if signature != SIGNATURE or version != 0:
            raise ValueError("not a 2bit file of version 0")
        self.offsets, pos = {}, 16
        for _ in range(count):
            n = self._at(pos, 1)[0]
            data = self._at(pos + 1, n + 4)
            self.offsets[data[:n].decode()] = struct.unpack(self.order + "I", data[n:])[0]
            pos += n + 5
        self.known: dict = {}

    def _at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(n)

    def _ints(self, pos: int, n: int) -> tuple:
        return struct.unpack(f"{self.order}{n}I", self._at(pos, 4 * n))

    def entry(self, name: str):
        """(length, N blocks, masked blocks, offset of the packed bases)."""
        if name not in self.known:
            pos = self.offsets[name]
            length, n = self._ints(pos, 2)
            blocks = list(zip(self._ints(pos + 8, n), self._ints(pos + 8 + 4 * n, n)))
            pos += 8 + 8 * n
            m = self._ints(pos, 1)[0]
            masks = list(zip(self._ints(pos + 4, m), self._ints(pos + 4 + 4 * m, m)))
            self.known[name] = length, blocks, masks, pos + 8 + 8 * m
        return self.known[name]

    def lengths(self) -> dict[str, int]:
        return {name: self.entry(name)[0] for name in self.offsets}

    def fetch(self, name: str, start: int, end: int) -> str:
        """Bases [start, end), N where unknown, lower case where masked; clipped to the sequence."""
        length, blocks, masks, base = self.entry(name)
        start, end = max(0, start), min(end, length)
        if end <= start:
            return ""
        data = self._at(base + start // 4, (end + 3) // 4 - start // 4)
        out = list("".join(BASES[b >> s & 3] for b in data for s in (6, 4, 2, 0))[start % 4 : start % 4 + end - start])
        for runs, change in ((blocks, lambda _: "N"), (masks, str.lower)):
            i = max(0, bisect_right([s for s, _ in runs], start) - 1)
            for s, n in runs[i:]:
                if s >= end:
                    break
                for p in range(max(s, start), min(s + n, end)):
                    out[p - start] = change(out[p - start])
        return "".join(out)


def write_twobit(path, sequences: dict[str, str]) -> None:
    """A 2bit file of the sequences; N and lower case are kept as blocks."""

    def blocks(s, test):
        out, start = [], None
        for i, c in enumerate(s + "\0"):
            if c != "\0" and test(c):
                start = i if start is None else start
            elif start is not None:
                out.append((start, i - start))
                start = None
        return out

    bodies = []
    for s in sequences.values():
        n, m = blocks(s, lambda c: c in "Nn"), blocks(s, str.islower)
        up = s.upper() + "T" * (-len(s) % 4)
        bits = bytes(sum(max(BASES.find(c), 0) << k for c, k in zip(up[i : i + 4], (6, 4, 2, 0))) for i in range(0, len(up), 4))
        ints = lambda xs: struct.pack(f"<{len(xs)}I", *xs)
        parts = [ints([len(s), len(n)]), ints([a for a, _ in n]), ints([b for _, b in n]), ints([len(m)]), ints([a for a, _ in m]), ints([b for _, b in m]), ints([0]), bits]
        bodies.append(b"".join(parts))
    at = 16 + sum(5 + len(k.encode()) for k in sequences)
    from pyarrow import fs

    system, to = fs.FileSystem.from_uri(str(path))
    with system.open_output_stream(to, compression=None) as f:
        f.write(struct.pack("<4I", SIGNATURE, 0, len(sequences), 0))
        for name, body in zip(sequences, bodies):
            f.write(bytes([len(name.encode())]) + name.encode() + struct.pack("<I", at))
            at += len(body)
        for body in bodies:
            f.write(body)


def _open(uri: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(uri)
    return system.open_input_file(at)


def chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length)."""
    with _open(path) as f:
        return spark.createDataFrame(sorted(TwoBit(f).lengths().items()), "chrom string, length long")


def genome(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk_id, seq): the genome in pieces, each decoded by a task that seeks to it."""
    pieces = chromosomes(spark, path).select("chrom", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / chunk))).alias("chunk_id"))

    def run(batches):
        with _open(path) as f:
            two = TwoBit(f)
            for batch in batches:
                rows = list(zip(batch.column("chrom").to_pylist(), batch.column("chunk_id").to_pylist()))
                for i in range(0, len(rows), 16):
                    part = rows[i : i + 16]
                    yield pa.RecordBatch.from_pydict({"chrom": [c for c, _ in part], "chunk_id": [k for _, k in part], "seq": [two.fetch(c, k * chunk, (k + 1) * chunk) for c, k in part]})

    n = spark.sparkContext.defaultParallelism
    return pieces.repartition(n).mapInArrow(run, "chrom string, chunk_id long, seq string")


def fetch(bed: DataFrame, path: str) -> DataFrame:
    """``bed`` with ``seq``, read interval by interval in the tasks that hold them, turned on the - strand."""
    from strandlake.functions.sequence import reverse_complement

    names, kinds = bed.columns, ", ".join(f"`{n}` {t}" for n, t in bed.dtypes)

    def run(batches):
        with _open(path) as f:
            two = TwoBit(f)
            for batch in batches:
                seqs = [two.fetch(c, s, e) if c in two.offsets else None for c, s, e in zip(*(batch.column(n).to_pylist() for n in ("chrom", "start", "end")))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.string())], names=[*names, "seq"])

    out = bed.repartitionByRange("chrom", "start").mapInArrow(run, f"{kinds}, seq string")
    return out.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement("seq")).otherwise(F.col("seq"))) if "strand" in names else out
