"""Relational summaries used around the motif operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_match(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """``a`` with the columns of the first row of ``b`` with its key, nulls without one."""
    w = Window.partitionBy(key).orderBy(order)
    return a.join(b.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"), key, "left")


def full_grid(counts: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """(a, b, n) for every pair of the values of two categories, zeros where there is none."""
    right = counts.select(b).distinct().agg(F.collect_list(b).alias("_all"))  # categories, a short list
    grid = counts.select(a).distinct().join(F.broadcast(right)).select(a, F.explode("_all").alias(b))
    return grid.join(counts, [a, b], "left").withColumn(n, F.coalesce(n, F.lit(0)).cast("long"))


def shares(df: DataFrame, group: str, category: str) -> DataFrame:
    """(group, category, n, share, cum): counts, shares of the group and running shares by category."""
    n = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    share = F.col("n") / F.sum("n").over(w)
    return n.withColumn("share", share).withColumn("cum", F.sum("n").over(w.orderBy(category)) / F.sum("n").over(w))


def jaccard_table(df: DataFrame, item: str, category: str) -> DataFrame:
    """(c1, c2, both, jaccard) of all pairs of categories by the items that have both."""
    d = df.select(item, category).distinct()
    sizes = d.groupBy(category).agg(F.count(F.lit(1)).alias("t"))
    left, right = d.select(item, F.col(category).alias("c1")), d.select(item, F.col(category).alias("c2"))
    both = left.join(right, item).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("both"))
    grid = full_grid(both, "c1", "c2", "both")
    t1, t2 = sizes.select(F.col(category).alias("c1"), F.col("t").alias("t1")), sizes.select(F.col(category).alias("c2"), F.col("t").alias("t2"))
    return grid.join(t1, "c1").join(t2, "c2").select("c1", "c2", "both", (F.col("both") / (F.col("t1") + F.col("t2") - F.col("both"))).alias("jaccard"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, expected, kappa) of two ratings."""
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = pairs.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("ra"))
    cols = pairs.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("rb"))
    expected = rows.join(cols, "c").agg(F.sum(F.col("ra").cast("double") * F.col("rb")).alias("e"))
    seen = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("e", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return seen.join(F.broadcast(expected)).select("n", po.alias("agreement"), pe.alias("expected"), ((po - pe) / (1 - pe)).alias("kappa"))


def name_overlap(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(common, total, jaccard) of two sets of names."""
    sides = a.select(name).distinct().withColumn("_a", F.lit(1)).join(b.select(name).distinct().withColumn("_b", F.lit(1)), name, "full")
    out = sides.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("common"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("jaccard", F.when(F.col("total") > 0, F.col("common") / F.col("total")))


def category_table(df: DataFrame, method: str, categories: str, separator: str, methods: list) -> DataFrame:
    """(category, one share a method): multi-valued categories that all but one method cite at least."""
    each = df.select(method, F.explode(F.split(categories, separator)).alias("category")).withColumn("category", F.trim("category"))
    n = each.groupBy("category").pivot(method, methods).count()
    cited = sum((F.coalesce(F.col(f"`{m}`"), F.lit(0)) > 0).cast("int") for m in methods)
    kept = n.filter(cited >= len(methods) - 1)
    w = Window.partitionBy(F.lit(0))  # categories, a short list
    return kept.select("category", *[(F.coalesce(F.col(f"`{m}`"), F.lit(0)) / F.sum(F.coalesce(F.col(f"`{m}`"), F.lit(0))).over(w)).alias(str(m)) for m in methods])


def asof_interpolated(points: DataFrame, curve: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """``points`` with ``y`` read off the piecewise linear ``curve`` at their ``x``; flat beyond its ends.

    Points and curve are merged and sorted once per group; each point sees the
    nearest curve points on both sides.
    """
    names = points.columns
    both = points.withColumn("_y", F.lit(None).cast("double")).withColumn("_row", F.struct(*names)).select(*group, x, "_y", "_row").unionByName(
        curve.select(*group, x, F.col(y).alias("_y")).withColumn("_row", F.lit(None).cast(points.withColumn("_row", F.struct(*names)).schema["_row"].dataType))
    )
    up = Window.partitionBy(*group).orderBy(F.col(x), F.col("_y").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*group).orderBy(F.col(x).desc(), F.col("_y").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("_y").isNotNull(), F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    seen = both.withColumn("_lo", F.last(point, True).over(up)).withColumn("_hi", F.last(point, True).over(down)).filter(F.col("_row").isNotNull())
    slope = (F.col("_hi.y") - F.col("_lo.y")) / (F.col("_hi.x") - F.col("_lo.x"))
    value = F.when(F.col("_lo").isNull(), F.col("_hi.y")).when(F.col("_hi").isNull() | (F.col("_hi.x") == F.col("_lo.x")), F.col("_lo.y")).otherwise(F.col("_lo.y") + slope * (F.col(x) - F.col("_lo.x")))
    return seen.select("_row.*", value.alias(y))
