"""The input tables in the engine's shapes, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import DENSE, LETTERS, text_to_dna


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def minutes(ts: str):
    """Whole minutes since 1970 of a time stamp, whatever the session's time zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return (days * 1440 + F.hour(ts) * 60 + F.minute(ts)).cast("long")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq): documents, their letters read as bases."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), text_to_dna("text").alias("seq"))


def motif_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq): benchmark items."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), text_to_dna("text").alias("seq"))


DOC_SEQ = f"(SELECT doc_id AS seq_id, translate(lower(coalesce(text, '')), '{LETTERS}', '{DENSE}') AS seq FROM documents)"
MOTIF_SEQ = f"(SELECT item_id AS seq_id, translate(lower(coalesce(text, '')), '{LETTERS}', '{DENSE}') AS seq FROM benchmark)"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def lmers(table: str, l: int) -> str:  # noqa: E741
    """SQL for (seq_id, lmer)."""
    return (
        f"(SELECT seq_id, unnest(list_transform(range(1, length(r) - {l} + 2), lambda i: substr(r, i, {l}))) AS lmer "
        f"FROM (SELECT seq_id, unnest(regexp_extract_all(seq, '[ACGT]+')) AS r FROM {table}))"
    )


def counts(table: str, l: int, ds: bool = False) -> str:  # noqa: E741
    word = f"least(lmer, {rc('lmer')})" if ds else "lmer"
    return f"(SELECT seq_id, {word} AS kmer, count(*) AS n FROM {lmers(table, l)} GROUP BY ALL)"


def dist(table: str, l: int, ds: bool = False) -> str:  # noqa: E741
    return f"(SELECT seq_id, kmer, sqrt(n / sum(n) OVER (PARTITION BY seq_id)) AS w FROM {counts(table, l, ds)})"
