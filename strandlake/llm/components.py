"""Connected components of an edge table, on the cluster.

Alternating large-star and small-star steps turn every component into a star
around its smallest member in a logarithmic number of rounds.  A node's
neighbours are never gathered: each step takes a grouped minimum (combined
before the shuffle) and joins it back, and every round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import few_files, save, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int) -> DataFrame:
    """(u, v) with v the smallest node reachable from u, for every u that is not the smallest itself.

    ``edges`` has two columns u and v of one orderable type; loops and repeats
    are harmless.  ``most``: about how many edges there are at the most, which
    only sets the number of files.
    """
    base = scratch(edges.sparkSession, "components")
    held = save(few_files(edges.select("u", "v").filter("u != v").distinct(), most), f"{base}/0")
    seen, turn, n = None, 0, held.count()
    while True:
        turn += 1
        held = save(few_files(_small_star(_large_star(held)), 2 * n), f"{base}/{turn}")
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return held
        seen = now
