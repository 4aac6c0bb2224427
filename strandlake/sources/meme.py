"""Motif files in MEME text format."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SITES = 1_000_000


def parse_meme(text: str) -> list[tuple[str, int, int, float, float, float, float]]:
    """(name, nsites, pos, a, c, g, t) of every motif; a name is the rest of its MOTIF line, trimmed."""
    out, name, sites, pos, open_ = [], None, DEFAULT_SITES, 0, False
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("ALPHABET"):
            letters = s.partition("=")[2].strip()
            if letters and len(letters) != 4:
                raise ValueError(f"an alphabet of four letters is needed, not {letters}")
        elif s.startswith("MOTIF"):
            name, open_ = s[5:].strip(), False
        elif s.startswith("letter-probability matrix"):
            found = re.search(r"nsites=\s*(\d+)", s)
            sites, pos, open_ = int(found[1]) if found else DEFAULT_SITES, 0, name is not None
        elif open_:
            cells = s.split()
            if len(cells) != 4:
                open_ = False if s else open_ and pos == 0
                continue
            p = [float(x) for x in cells]
            total = sum(p)
            if total <= 0:
                raise ValueError(f"an empty column in motif {name}")
            pos += 1
            out.append((name, sites, pos, *[x / total for x in p]))
    return out


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos, a, c, g, t, n) of the motifs of one or more files, each parsed whole in a task."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for text in pdf["value"] for r in parse_meme(text)]
            yield pd.DataFrame(rows, columns=["name", "n", "pos", "a", "c", "g", "t"])[["name", "pos", "a", "c", "g", "t", "n"]].astype({"n": float})

    return spark.read.text(path, wholetext=True).mapInPandas(run, "name string, pos int, a double, c double, g double, t double, n double")


def write_meme(pwm: DataFrame, path: str) -> None:
    """Matrices (name, pos, a, c, g, t, n) as MEME text, one block a motif."""
    row = F.concat_ws(" ", *[F.col(b).cast("string") for b in "acgt"])
    held = pwm.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("x")))).alias("rows"), F.max("n").cast("long").cast("string").alias("n"))
    head = F.concat(F.lit("MEME version 4\n\nALPHABET= ACGT\n\nMOTIF "), "name", F.lit("\nletter-probability matrix: alength= 4 w= "), F.size("rows").cast("string"), F.lit(" nsites= "), "n", F.lit("\n"))
    held.select(F.concat(head, F.array_join(F.transform("rows", lambda r: r["x"]), "\n"), F.lit("\n")).alias("value")).write.text(path)
