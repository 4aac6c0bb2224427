"""Queries of matrices in coordinate form: suppliers by parts, from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import linalg as L
from strandlake.plans.registry import query
from strandlake.plans.tables import read

A = "(SELECT l_suppkey AS row, l_partkey % 50 AS col, sum(l_quantity) AS x FROM lineitem GROUP BY ALL)"
B = "(SELECT l_partkey % 50 AS row, l_linenumber AS col, sum(l_discount) AS x FROM lineitem GROUP BY ALL)"


def matrix(spark, sf_dir, row, col, x):
    return read(spark, sf_dir, "lineitem").groupBy(row.alias("row"), col.alias("col")).agg(F.sum(x).alias("x"))


def a(spark, sf_dir):
    return matrix(spark, sf_dir, F.col("l_suppkey"), F.col("l_partkey") % 50, "l_quantity")


def b(spark, sf_dir):
    return matrix(spark, sf_dir, F.col("l_partkey") % 50, F.col("l_linenumber"), "l_discount")


@query(f"SELECT a.row, b.col, round(sum(a.x * b.x), 4) AS x FROM {A} a JOIN {B} b ON a.col = b.row GROUP BY ALL")
def matrix_multiply(spark, sf_dir):
    return L.multiply(a(spark, sf_dir), b(spark, sf_dir)).select("row", "col", F.round("x", 4).alias("x"))


@query(f"SELECT p.col AS row, q.col AS col, round(sum(p.x * q.x), 4) AS x FROM {A} p JOIN {A} q ON p.row = q.row GROUP BY ALL")
def matrix_gram(spark, sf_dir):
    m = a(spark, sf_dir)
    return L.multiply(m, m, transpose_a=True).select("row", "col", F.round("x", 4).alias("x"))


@query(f"SELECT row, coalesce(sum(x) FILTER (col = 0), 0) AS c0, coalesce(sum(x) FILTER (col = 1), 0) AS c1, coalesce(sum(x) FILTER (col = 2), 0) AS c2 FROM {A} GROUP BY row")
def matrix_dense(spark, sf_dir):
    return L.dense(a(spark, sf_dir), [0, 1, 2]).select("row", *[F.col(str(i)).alias(f"c{i}") for i in range(3)])


@query(f"SELECT row, col - 10 AS col, x FROM {A} WHERE col BETWEEN 10 AND 20")
def matrix_columns(spark, sf_dir):
    wanted = spark.range(10, 21).select(F.col("id").alias("col"), (F.col("id") - 10).alias("new"))
    return L.select_columns(a(spark, sf_dir), wanted)


@query(f"SELECT round(sum((coalesce(p.x, 0) - coalesce(q.x, 0)) * (coalesce(p.x, 0) - coalesce(q.x, 0))) / 1000, 4) AS mse FROM (SELECT * FROM {A} WHERE row % 2 = 0) p FULL JOIN (SELECT * FROM {A} WHERE col % 2 = 0) q ON p.row = q.row AND p.col = q.col")
def matrix_mse(spark, sf_dir):
    m = a(spark, sf_dir)
    return L.mse(m.filter("row % 2 = 0"), m.filter("col % 2 = 0"), 100, 10).select(F.round("mse", 4).alias("mse"))


@query(f"WITH a AS {A} SELECT * FROM a WHERE col IN (SELECT col FROM (SELECT DISTINCT col FROM a) ORDER BY md5('1:' || CAST(col AS VARCHAR)), col LIMIT 5)")
def matrix_sample(spark, sf_dir):
    return L.sample_columns(a(spark, sf_dir), 5, 1)


@query(f"SELECT row, col FROM {A} WHERE x >= 60")
def matrix_find(spark, sf_dir):
    return L.find(a(spark, sf_dir), 60.0)
