"""Dot products of distributions: features, similarities and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similarity(a: DataFrame, b: DataFrame, id_a: str = "a", id_b: str = "b", key: str = "seq_id") -> DataFrame:
    """(id_a, id_b, s): Bhattacharyya coefficients of the pairs that share a word; all other pairs have 0.

    An equi-join on the word with a map-side combined sum; Spark broadcasts the
    smaller side when its measured size allows, else AQE splits frequent words.
    """
    left = a.select(F.col(key).alias(id_a), "kmer", F.col("w").alias("_wa"))
    right = b.select(F.col(key).alias(id_b), "kmer", F.col("w").alias("_wb"))
    return left.join(right, "kmer").groupBy(id_a, id_b).agg(F.sum(F.col("_wa") * F.col("_wb")).alias("s"))


#: Cells (words times motifs) up to which a motif set is shipped to the tasks as one matrix.
MATRIX_CELLS = 4_000_000


def features(sequences: DataFrame, motifs: DataFrame) -> DataFrame:
    """(seq_id, motif_id, bc) of the pairs that share a word.

    The join of ``similarity`` makes a row for every word a sequence shares
    with every motif.  A motif set of at most ``MATRIX_CELLS`` cells, which is
    counted first, goes to the tasks as a matrix instead, and each sequence's
    words become one row that is multiplied there; the grouping is by the
    sequence, as the distribution's own, so nothing more is shuffled.
    """
    size = motifs.agg(F.countDistinct("kmer") * F.countDistinct("seq_id")).first()[0]
    if not size or size > MATRIX_CELLS:
        return similarity(sequences, motifs, "seq_id", "motif_id").withColumnRenamed("s", "bc")
    return _multiplied(sequences, motifs.select("seq_id", "kmer", "w").toPandas(), dict(sequences.dtypes)["seq_id"], dict(motifs.dtypes)["seq_id"])


def _multiplied(sequences: DataFrame, cells, kind: str, motif_kind: str) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    words, names = sorted(set(cells["kmer"])), sorted(set(cells["seq_id"]))
    matrix = np.zeros((len(words) + 1, len(names)))  # the last row is for words no motif has
    at = {k: i for i, k in enumerate(words)}
    np.add.at(matrix, (cells["kmer"].map(at).to_numpy(), cells["seq_id"].map({m: j for j, m in enumerate(names)}).to_numpy()), cells["w"].to_numpy(float))
    rows = sequences.groupBy("seq_id").agg(F.collect_list(F.struct("kmer", "w")).alias("x"))

    def run(batches):
        import pyarrow.compute as pc

        table, ids = pa.array(words), np.array(names)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = part.column("x")
                sizes = pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.list_flatten(x)
                kmer, w = pc.struct_field(flat, "kmer"), pc.struct_field(flat, "w").to_numpy(zero_copy_only=False)
                index = pc.fill_null(pc.index_in(kmer, value_set=table), len(words)).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                bc = np.stack([w[a:b] @ matrix[index[a:b]] for a, b in zip(ends - sizes, ends)])
                row, col = np.nonzero(bc > 0)
                yield pa.RecordBatch.from_arrays([part.column("seq_id").take(pa.array(row)), pa.array(ids[col]), pa.array(bc[row, col])], names=["seq_id", "motif_id", "bc"])

    return rows.mapInArrow(run, f"seq_id {kind}, motif_id {motif_kind}, bc double")


#: Ids that a set of motifs may have where all pairs with it are the result.
SET_IDS = 100_000


def pairs(a: DataFrame, b: DataFrame, id_a: str = "a", id_b: str = "b", key: str = "seq_id") -> DataFrame:
    """All pairs of ids: the dense shape of a result between sets of motifs.

    The second set's ids travel as one array, so it has to be a set of motifs:
    they are counted first, and more than ``SET_IDS`` are an error.
    """
    one = b.select(F.col(key).alias("_id")).distinct()
    if one.limit(SET_IDS + 1).count() > SET_IDS:
        raise ValueError(f"more than {SET_IDS} ids: not a set of motifs")
    ids = one.agg(F.collect_list("_id").alias("_ids"))
    return a.select(F.col(key).alias(id_a)).distinct().join(F.broadcast(ids)).select(id_a, F.explode("_ids").alias(id_b))


def dense(s: DataFrame, a: DataFrame, b: DataFrame, id_a: str = "a", id_b: str = "b", key: str = "seq_id") -> DataFrame:
    """``s`` with its zeros."""
    return pairs(a, b, id_a, id_b, key).join(s, [id_a, id_b], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def distance(a: DataFrame, b: DataFrame, bhattacharyya: bool = False, key: str = "seq_id") -> DataFrame:
    """(a, b, d) of all pairs: sqrt(1 - s), or -ln s with the least positive s in place of zeros."""
    s = dense(similarity(a, b, key=key), a, b, key=key)
    if not bhattacharyya:
        return s.select("a", "b", F.sqrt(F.greatest(1 - F.col("s"), F.lit(0.0))).alias("d"))
    least = s.filter("s > 0").agg(F.min("s").alias("_least"))
    filled = s.join(F.broadcast(least)).withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("_least")))
    return filled.select("a", "b", F.abs(-F.log(F.least("s", F.lit(1.0)))).alias("d"))
