"""Streaming counts of k-mers: an extension, there is no batch-only counterpart of late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.counting import lmers, words
from strandlake.operators.space import KmerSpace


def windowed_counts(stream: DataFrame, space: KmerSpace, window: str, watermark: str, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(window_start, window_end, kmer, n) of sequences (ts, seq) by event time; later rows than the watermark go."""
    timed = stream.withWatermark(ts, watermark).select(F.struct(F.col(ts).alias("ts")).alias("seq_id"), F.col(seq).alias("seq"))
    each = words(lmers(timed, space.l), space).select(F.col("seq_id.ts").alias("ts"), "kmer")
    counted = each.groupBy(F.window("ts", window).alias("w"), "kmer").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "kmer", "n")


def tumbling(stream: DataFrame, key: str, value: str, window: str, watermark: str, ts: str = "ts") -> DataFrame:
    """(window_start, key, n, total) of a keyed event stream."""
    w = stream.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(stream: DataFrame, key: str, gap: str, watermark: str, ts: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events with no pause longer than ``gap``."""
    w = stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
