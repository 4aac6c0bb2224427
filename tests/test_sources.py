import gzip

import pytest
from pyspark.sql import functions as F

from strandlake.operators.intervals import sequences
from strandlake.operators.space import KmerSpace
from strandlake.sources import bed, delimited, fasta, meme, twobit
from strandlake.streaming import kmers


def test_bed(spark, tmp_path):
    p = tmp_path / "x.bed.gz"
    with gzip.open(p, "wt") as f:
        f.write("# note\nchr1\t5\t9\tP1\t3\t-\textra\nchr2 0 4 N2 1 .")
    rows = [tuple(r) for r in bed.read_bed(spark, str(p)).collect()]
    assert rows == [("chr1", 5, 9, "P1", 3, "-"), ("chr2", 0, 4, "N2", 1, "+")]
    marked = bed.labelled(bed.read_bed(spark, str(p)))
    assert [(r["label"], r["fold"]) for r in marked.collect()] == [(1, 3), (0, 1)]
    (tmp_path / "bad.bed").write_text("chr1\t5\n")
    with pytest.raises(Exception, match="not a bed6 row"):
        bed.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    assert bed.read_bed(spark, str(tmp_path / "bad.bed"), strict=False).count() == 0
    bed.write_bed(marked, str(tmp_path / "out"))
    assert bed.read_bed(spark, str(tmp_path / "out")).count() == 2


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one two\nACGU\nUU\n\n>b\nNN\n")
    got = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert [tuple(r) for r in got.collect()] == [("a", "one two", "ACGTTT"), ("b", "", "NN")]
    fasta.write_fasta(got, str(tmp_path / "out"))
    assert {r["seq"] for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == {"ACGTTT", "NN"}


def test_fasta_headers_may_hold_the_sign(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s1 A>G variant\r\nAC\r\nGT\r\n>s2 >\nA")
    assert [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "x.fa")).collect()] == [("s1", "A>G variant", "ACGT"), ("s2", ">", "A")]


def test_meme(spark, tmp_path):
    text = "MEME version 5\nALPHABET= ACGT\nMOTIF m1 x \nletter-probability matrix: alength= 4 w= 2 nsites= 50 E= 0\n 0.5 0.5 0 0\n 0 0 1 1\n\nMOTIF m2\nletter-probability matrix: alength= 4 w= 1\n1 0 0 0\n"
    (tmp_path / "x.meme").write_text(text)
    rows = [tuple(r) for r in meme.read_meme(spark, str(tmp_path / "x.meme")).collect()]
    assert rows == [("m1 x", 1, 0.5, 0.5, 0, 0, 50), ("m1 x", 2, 0, 0, 0.5, 0.5, 50), ("m2", 1, 1, 0, 0, 0, meme.DEFAULT_SITES)]
    with pytest.raises(ValueError):
        meme.parse_meme("ALPHABET= ACDEFGH")


def test_twobit(spark, tmp_path):
    genome = {"c1": "NNACGTacgtTTGCANNNg" * 7, "c2": "ACG"}
    path = str(tmp_path / "g.2bit")
    twobit.write_twobit(path, genome)
    assert {r["chrom"]: r["length"] for r in twobit.chromosomes(spark, path).collect()} == {k: len(v) for k, v in genome.items()}
    pieces = twobit.genome(spark, path, 10)
    for name, seq in genome.items():
        parts = sorted((r["chunk_id"], r["seq"]) for r in pieces.filter(F.col("chrom") == name).collect())
        assert "".join(s for _, s in parts) == seq
    rows = spark.createDataFrame([("c1", 3, 25, "a", 1, "+"), ("c1", 8, 31, "b", 1, "-"), ("c2", 0, 3, "c", 1, "+")], "chrom string, start long, end long, name string, score long, strand string")
    turn = str.maketrans("ACGTacgt", "TGCAtgca")
    want = {"a": genome["c1"][3:25], "b": genome["c1"][8:31].translate(turn)[::-1], "c": "ACG"}
    assert {r["name"]: r["seq"] for r in twobit.fetch(rows, path).collect()} == want
    assert {r["name"]: r["seq"] for r in sequences(rows, pieces, 10).collect()} == want


def test_delimited(spark, tmp_path):
    (tmp_path / "x.txt").write_text("h1,h2,h3,h4\n1,2.5,yes,z\n3,4,no,w\n")
    cols = [("a", "integer"), ("b", "numeric"), ("c", "skip"), ("d", "character")]
    assert [tuple(r) for r in delimited.read_delimited(spark, str(tmp_path / "x.txt"), cols, ",", 1).collect()] == [(1, 2.5, "z"), (3, 4.0, "w")]
    (tmp_path / "exp.test_ids").write_text("p1\n\np2\n")
    assert [tuple(r) for r in delimited.read_ids(spark, str(tmp_path / "exp.test_ids")).collect()] == [("exp", "p1"), ("exp", "p2")]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "ACGT"), ("2024-01-01 00:00:50", "ACAC"), ("2024-01-01 02:00:00", "TTT")], "t string, seq string").select(F.to_timestamp("t").alias("ts"), "seq")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = kmers.windowed_counts(stream, KmerSpace(2), "1 minute", "10 minutes")
    q = out.writeStream.format("memory").queryName("kmers").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("select * from kmers").collect()))
    assert got == sorted(map(tuple, kmers.windowed_counts(rows, KmerSpace(2), "1 minute", "10 minutes").collect()))
    assert ("AC", 3) in {(k, n) for _, _, k, n in got}
