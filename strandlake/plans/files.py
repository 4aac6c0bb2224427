"""Queries that write tables in the engine's file formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions.sequence import text_to_dna
from strandlake.plans.motifs import PWM, matrices
from strandlake.plans.registry import query
from strandlake.plans.relational import r6
from strandlake.plans.tables import DENSE, LETTERS, read
from strandlake.runtime import scratch
from strandlake.sources import bed, delimited, fasta, meme, twobit

ROWS = "(SELECT o_orderpriority AS p, o_orderkey AS k, o_custkey AS c FROM orders)"


def regions(spark, sf_dir):
    o, k, c = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(F.regexp_replace("o_orderpriority", " ", "_").alias("chrom"), (c * 10).alias("start"), (c * 10 + k % 50).alias("end"), F.concat(F.element_at(F.array(F.lit("P"), F.lit("N"), F.lit("X")), (k % 3 + 1).cast("int")), k.cast("string")).alias("name"), (k % 7).alias("score"), F.when(k % 2 == 0, "-").otherwise(".").alias("strand"))


BED = f"SELECT replace(p, ' ', '_') AS chrom, c * 10 AS start, c * 10 + k % 50 AS \"end\", ['P', 'N', 'X'][k % 3 + 1] || CAST(k AS VARCHAR) AS name, k % 7 AS score, CASE WHEN k % 2 = 0 THEN '-' ELSE '+' END AS strand FROM {ROWS}"


@query(BED)
def bed_rows(spark, sf_dir):
    path = scratch(spark, "bed")
    bed.write_bed(regions(spark, sf_dir), path)
    return bed.read_bed(spark, path)


@query(f"SELECT name, CASE WHEN name LIKE 'P%' THEN 1 WHEN name LIKE 'N%' THEN 0 END AS label, score AS fold FROM ({BED})")
def bed_labels(spark, sf_dir):
    path = scratch(spark, "bed")
    bed.write_bed(regions(spark, sf_dir), path)
    return bed.labelled(bed.read_bed(spark, path)).select("name", "label", "fold")


@query(f"SELECT b.*, k / 4 AS signal, k / 8 AS pvalue, -1.0 AS qvalue, k % 50 AS peak FROM ({BED}) b JOIN {ROWS} ON substr(name, 2) = CAST(k AS VARCHAR)")
def peak_rows(spark, sf_dir):
    path, k = scratch(spark, "peaks"), F.substring("name", 2, 20).cast("long")
    more = {"signal": k / 4, "pvalue": k / 8, "qvalue": F.lit(-1.0), "peak": k % 50}
    bed.write_bed(regions(spark, sf_dir).withColumns(more), path, "narrowPeak")
    return bed.read_bed(spark, path, "narrowPeak")


DNA = f"regexp_replace(translate(lower(text), '{LETTERS}', '{DENSE}'), '[^ACGT]', 'N', 'g')"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, '' AS description, {DNA} AS seq FROM documents WHERE text IS NOT NULL")
def fasta_records(spark, sf_dir):
    path = scratch(spark, "fasta")
    d = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    fasta.write_fasta(d.select("doc_id", F.regexp_replace(text_to_dna("text"), "[^ACGT]", "N").alias("seq")), path, "doc_id")
    return fasta.read_fasta(spark, path)


@query("SELECT 'ids' AS experiment, CAST(item_id AS VARCHAR) AS id FROM benchmark")
def id_list(spark, sf_dir):
    path = scratch(spark, "ids")
    read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("value")).write.text(path)
    return delimited.read_ids(spark, path, "ids")


@query("SELECT p_partkey AS key, p_brand AS brand, p_size AS size, p_retailprice AS price, p_size > 25 AS large FROM part")
def delimited_rows(spark, sf_dir):
    path = scratch(spark, "delimited")
    p = read(spark, sf_dir, "part")
    fields = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    text = F.concat_ws("\t", *[F.col(c).cast("string") for c in fields], (F.col("p_size") > 25).cast("string"))
    p.select(text.alias("value")).write.text(path)
    kinds = [("key", "integer"), ("name", "skip"), ("brand", "string"), ("size", "integer"), ("price", "numeric"), ("large", "boolean")]
    return delimited.read_delimited(spark, path, kinds)


@query(f"SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY pos) AS INTEGER) AS pos, round(a, 6) AS a, round(c, 6) AS c, round(g, 6) AS g, round(t, 6) AS t FROM {PWM}")
def meme_matrices(spark, sf_dir):
    path = scratch(spark, "meme")
    meme.write_meme(matrices(spark, sf_dir), path)
    return meme.read_meme(spark, path).select("name", "pos", *[r6(b) for b in "acgt"])


CHROMS = f"(SELECT n_name AS chrom, n_nationkey AS k, repeat(regexp_replace(translate(lower(n_name), '{LETTERS}', '{DENSE}'), '[^ACGT]', 'N', 'g'), 40) AS z FROM nation)"


def nations(spark, sf_dir):
    """A sequence for each of the 25 nations, their number being fixed."""
    n = read(spark, sf_dir, "nation")
    seq = F.repeat(F.regexp_replace(text_to_dna("n_name"), "[^ACGT]", "N"), 40)
    path = scratch(spark, "genome") + ".2bit"
    twobit.write_twobit(path, {r["n_name"]: r["seq"] for r in n.select("n_name", seq.alias("seq")).orderBy("n_name").collect()})
    return path


@query(f"SELECT chrom, length(z) AS length FROM {CHROMS}")
def twobit_catalogue(spark, sf_dir):
    return twobit.chromosomes(spark, nations(spark, sf_dir))


FETCHED = f"(SELECT chrom, o_custkey % 100 AS s, o_custkey % 100 + 5 + o_orderkey % 60 AS e, o_orderkey % 2 = 1 AS forward, o_orderkey AS k, z FROM orders JOIN {CHROMS} n ON n.k = o_custkey % 25)"


@query(f"SELECT CAST(k AS VARCHAR) AS name, CASE WHEN forward THEN substr(z, s + 1, e - s) ELSE reverse(translate(substr(z, s + 1, e - s), 'ACGT', 'TGCA')) END AS seq FROM {FETCHED}")
def twobit_ranges(spark, sf_dir):
    o, k, c = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("chrom"))
    rows = o.join(n, c % 25 == F.col("n")).select("chrom", (c % 100).alias("start"), (c % 100 + 5 + k % 60).alias("end"), k.cast("string").alias("name"), F.when(k % 2 == 1, "+").otherwise("-").alias("strand"))
    return twobit.fetch(rows, nations(spark, sf_dir)).select("name", "seq")


@query(f"SELECT chrom, i AS chunk_id, substr(z, CAST(100 * i + 1 AS INTEGER), 100) AS seq FROM (SELECT chrom, z, unnest(range(0, (length(z) + 99) // 100)) AS i FROM {CHROMS})")
def twobit_pieces(spark, sf_dir):
    return twobit.genome(spark, nations(spark, sf_dir), 100)


@query("SELECT doc_id, quality, toxic FROM labels")
def saved_table(spark, sf_dir):
    """A table saved under a name of its own and loaded again."""
    from strandlake.runtime import load, store

    return load(spark, store(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), scratch(spark, "saved")))
