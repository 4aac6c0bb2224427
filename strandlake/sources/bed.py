"""BED tables: six columns or narrow peaks, gzip by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BED6 = (("chrom", "string"), ("start", "long"), ("end", "long"), ("name", "string"), ("score", "long"), ("strand", "string"))
NARROW_PEAK = (*BED6, ("signal", "double"), ("pvalue", "double"), ("qvalue", "double"), ("peak", "long"))
KINDS = {"bed6": BED6, "narrowPeak": NARROW_PEAK}


def read_bed(spark: SparkSession, path: str, kind: str = "bed6", strict: bool = True) -> DataFrame:
    """Rows of a BED file, cut at tabs or blanks; further columns are left out.

    Comment, track and browser lines and empty lines are skipped.  ``strict``
    raises on short rows and bad numbers, else such rows go.  Any strand but -
    is forward.
    """
    columns = KINDS[kind]
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|track\b|browser\b|$)"))
    parts = F.split(F.trim("value"), r"[\t ]+")
    typed = [F.get("p", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(columns)]
    rows = lines.select(parts.alias("p"), "value").select("value", *typed)
    whole = F.col("chrom").isNotNull()
    for name, t in columns:
        if t != "string":
            whole = whole & F.col(name).isNotNull()
    whole = whole & F.col(columns[-1][0]).isNotNull()
    if strict:
        rows = rows.withColumn("chrom", F.when(whole, F.col("chrom")).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind} row: "), "value"))))
    else:
        rows = rows.filter(whole)
    return rows.withColumn("strand", F.when(F.col("strand") == "-", "-").otherwise("+")).drop("value")


def labelled(bed: DataFrame) -> DataFrame:
    """``bed`` with ``label`` from names that begin with P or N, and ``fold`` from the score."""
    first = F.substring("name", 1, 1)
    return bed.withColumn("label", F.when(first == "P", 1).when(first == "N", 0)).withColumn("fold", F.col("score"))


def write_bed(bed: DataFrame, path: str, kind: str = "bed6") -> None:
    names = [n for n, _ in KINDS[kind]]
    bed.select(F.concat_ws("\t", *[F.col(n).cast("string") for n in names]).alias("value")).write.text(path)
