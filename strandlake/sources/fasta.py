"""FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import to_dna


def read_fasta(spark: SparkSession, path: str, dna: bool = True) -> DataFrame:
    """(id, description, seq): records are split at a > that starts a line by the text source, so files stay splittable.

    Sequence lines are joined; ``dna`` turns U to T.  A > inside a header is
    part of it.
    """
    # Only a file's first piece keeps its >.
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>", "").alias("value")).filter(F.col("value").rlike(r"\S"))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    seq = to_dna("body") if dna else F.col("body")
    return records.select(head.alias("head"), body.alias("body")).select(F.regexp_extract("head", r"^\s*(\S*)", 1).alias("id"), F.trim(F.regexp_replace("head", r"^\s*\S*", "")).alias("description"), seq.alias("seq"))


def write_fasta(seqs: DataFrame, path: str, id: str = "id", seq: str = "seq") -> None:
    seqs.select(F.concat(F.lit(">"), F.col(id).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)
