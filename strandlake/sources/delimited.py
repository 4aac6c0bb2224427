"""Typed delimited text and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"skip": None, "numeric": "double", "integer": "long", "boolean": "boolean", "string": "string", "character": "string"}


def read_delimited(spark: SparkSession, path: str, columns: list[tuple[str, str]], separator: str = "\t", header: int = 0, drop_empty: bool = False) -> DataFrame:
    """Columns (name, type) of delimited text; type skip leaves one out.

    ``drop_empty`` joins repeated separators.  ``header`` lines are skipped in
    each file, by their place in it, so files stay splittable only without one.
    """
    import re

    lines = spark.read.text(path)
    if header:
        lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", r"\r?\n"), header + 1, 2**30)).alias("value"))
    parts = F.split("value", f"(?:{re.escape(separator)}){'+' if drop_empty else ''}")
    out = []
    for i, (name, kind) in enumerate(columns):
        if TYPES[kind] is not None:
            x = F.get("p", F.lit(i))
            out.append((F.substring(x, 1, 1) if kind == "character" else x.cast(TYPES[kind])).alias(name))
    return lines.filter("value <> ''").select(parts.alias("p")).select(*out)


def read_ids(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """(experiment, id): one id a line; the experiment is the file's name unless given."""
    rows = spark.read.text(path).select(F.input_file_name().alias("f"), F.trim("value").alias("id")).filter("id <> ''")
    name = F.regexp_extract("f", r"([^/]+?)(\.[^./]*)?$", 1) if experiment is None else F.lit(experiment)
    return rows.select(name.alias("experiment"), "id")
