"""Queries of sequences, k-mer counts, distributions and their products."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import counting as C
from strandlake.operators import similarity as M
from strandlake.operators import windows as W
from strandlake.operators.space import KmerSpace, dictionary
from strandlake.plans.registry import query
from strandlake.plans.tables import DOC_SEQ, MOTIF_SEQ, counts, dist, lmers, motif_sequences, rc, read, sequences

L3, D3, L4, G42, G42D = KmerSpace(3), KmerSpace(3, 0, True), KmerSpace(4), KmerSpace(4, 2), KmerSpace(4, 2, True)


def r6(name):
    return (F.round(name, 6) + 0.0).alias(name)


def motifs(spark, sf_dir, space=L3):
    return C.distribution(motif_sequences(spark, sf_dir), space)


@query(f"SELECT seq_id, kmer, n FROM {counts(DOC_SEQ, 3)}")
def kmer_count(spark, sf_dir):
    return C.count(sequences(spark, sf_dir), L3)


@query(f"SELECT seq_id, kmer, n FROM {counts(DOC_SEQ, 3, True)}")
def kmer_count_ds(spark, sf_dir):
    return C.count(sequences(spark, sf_dir), D3)


def gapped_sql(table: str, ds: bool) -> str:
    """Two gaps in four places; masks are numbered by kept places counted from the right."""
    masks = [(3, 4), (2, 4), (1, 4), (2, 3), (1, 3), (1, 2)]  # kept places from the left, in mask order
    own = ", ".join("{'k': " + " || ".join(f"substr(x, {p}, 1)" for p in m) + f", 'm': {i}, 'w': " + " || ".join(f"substr(x, {p}, 1)" if p in m else "'N'" for p in (1, 2, 3, 4)) + "}" for i, m in enumerate(masks))
    if not ds:
        return f"(SELECT seq_id, g.w AS kmer, count(*) AS n FROM (SELECT seq_id, unnest([{own.replace('x,', 'lmer,')}]) AS g FROM {lmers(table, 4)}) GROUP BY ALL)"
    back = [masks.index(tuple(sorted(5 - p for p in m))) for m in masks]
    rows = f"SELECT seq_id, [{own.replace('x,', 'lmer,')}] AS a, [{own.replace('x,', 'r,')}] AS b FROM (SELECT seq_id, lmer, {rc('lmer')} AS r FROM {lmers(table, 4)})"
    pick = ", ".join(f"CASE WHEN (a[{i + 1}].k, a[{i + 1}].m) <= (b[{j + 1}].k, b[{j + 1}].m) THEN a[{i + 1}].w ELSE b[{j + 1}].w END" for i, j in enumerate(back))
    return f"(SELECT seq_id, kmer, count(*) AS n FROM (SELECT seq_id, unnest([{pick}]) AS kmer FROM ({rows})) GROUP BY ALL)"


@query(f"SELECT seq_id, kmer, n FROM {gapped_sql(MOTIF_SEQ, False)}")
def gkmer_count(spark, sf_dir):
    return C.count(motif_sequences(spark, sf_dir), G42)


@query(f"SELECT seq_id, kmer, n FROM {gapped_sql(MOTIF_SEQ, True)}")
def gkmer_count_ds(spark, sf_dir):
    return C.count(motif_sequences(spark, sf_dir), G42D)


LETTER = "substr('ACGT', 1 + (i // {}) % 4, 1)"
WORDS4 = f"(SELECT {LETTER.format(64)} || {LETTER.format(16)} || {LETTER.format(4)} || {LETTER.format(1)} AS lmer FROM range(256) t(i))"


@query(f"SELECT DISTINCT least(lmer, {rc('lmer')}) AS kmer, reverse(translate(least(lmer, {rc('lmer')}), 'ACGT', 'TGCA')) AS rc FROM {WORDS4}")
def kmer_dictionary(spark, sf_dir):
    return dictionary(spark, KmerSpace(4, 0, True))


@query(f"SELECT DISTINCT kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM {gapped_sql(f'(SELECT 1 AS seq_id, lmer AS seq FROM {WORDS4})', True)}")
def gkmer_dictionary(spark, sf_dir):
    return dictionary(spark, G42D)


@query(f"SELECT seq_id, kmer, round(w, 6) AS w FROM {dist(DOC_SEQ, 3)}")
def hellinger(spark, sf_dir):
    return C.distribution(sequences(spark, sf_dir), L3).select("seq_id", "kmer", r6("w"))


@query(f"SELECT s.seq_id, m.seq_id AS motif_id, round(sum(s.w * m.w), 6) AS bc FROM {dist(DOC_SEQ, 3)} s JOIN {dist(MOTIF_SEQ, 3)} m USING (kmer) GROUP BY ALL")
def motif_features(spark, sf_dir):
    return M.features(C.distribution(sequences(spark, sf_dir), L3), motifs(spark, sf_dir)).select("seq_id", "motif_id", r6("bc"))


@query(f"WITH d AS {dist(MOTIF_SEQ, 3)} SELECT x.seq_id AS a, y.seq_id AS b, round(sum(x.w * y.w), 6) AS s FROM d x JOIN d y USING (kmer) GROUP BY ALL")
def motif_similarity(spark, sf_dir):
    m = motifs(spark, sf_dir)
    return M.similarity(m, m).select("a", "b", r6("s"))


DENSE_S = "p AS (SELECT x.seq_id AS a, y.seq_id AS b, sum(x.w * y.w) AS s FROM d x JOIN d y USING (kmer) GROUP BY ALL), g AS (SELECT a.seq_id AS a, b.seq_id AS b FROM (SELECT DISTINCT seq_id FROM d) a CROSS JOIN (SELECT DISTINCT seq_id FROM d) b), q AS (SELECT a, b, coalesce(s, 0) AS s FROM g LEFT JOIN p USING (a, b))"


@query(f"WITH d AS {dist(MOTIF_SEQ, 4)}, {DENSE_S} SELECT a, b, round(sqrt(greatest(1 - s, 0)), 4) AS d FROM q")
def hellinger_distance(spark, sf_dir):
    m = motifs(spark, sf_dir, L4)
    # The root of a rounding error near zero is what remains of the last digits.
    return M.distance(m, m).select("a", "b", (F.round("d", 4) + 0.0).alias("d"))


@query(f"WITH d AS {dist(MOTIF_SEQ, 4)}, {DENSE_S} SELECT a, b, round(abs(-ln(least(CASE WHEN s > 0 THEN s ELSE (SELECT min(s) FROM q WHERE s > 0) END, 1))), 6) AS d FROM q")
def bhattacharyya_distance(spark, sf_dir):
    m = motifs(spark, sf_dir, L4)
    return M.distance(m, m, True).select("a", "b", r6("d"))


@query(f"SELECT seq_id, round(6.0 + sum(w * w * log2(w * w)), 6) AS ic FROM {dist(DOC_SEQ, 3)} GROUP BY seq_id")
def motif_ic(spark, sf_dir):
    return C.information(C.distribution(sequences(spark, sf_dir), L3), L3).select("seq_id", r6("ic"))


#: Thirds of whole items; the last one has what is left.
HALVES = "(SELECT seq_id, substr(seq, CAST({0} * (length(seq) // 3) + 1 AS INTEGER), CAST(CASE WHEN {0} = 2 THEN length(seq) ELSE length(seq) // 3 END AS INTEGER)) AS seq FROM " + MOTIF_SEQ + ")"


def halves(spark, sf_dir):
    m = motif_sequences(spark, sf_dir)
    third = F.floor(F.length("seq") / 3).cast("int")
    return [m.select("seq_id", F.col("seq").substr(i * third + 1, F.length("seq") if i == 2 else third).alias("seq")) for i in range(3)]


@query(
    f"SELECT seq_id, kmer, round(sqrt((coalesce(a.w * a.w, 0) + coalesce(c.w * c.w, 0)) / 2), 6) AS w FROM {dist(HALVES.format(0), 3)} a FULL JOIN {dist(HALVES.format(2), 3)} c USING (seq_id, kmer)"
)
def mix_distribution(spark, sf_dir):
    first, _, third = (C.distribution(h, L3) for h in halves(spark, sf_dir))
    return C.mix(first, third).select("seq_id", "kmer", r6("w"))


@query(
    f"WITH a AS {dist(HALVES.format(0), 3)}, b AS {dist(HALVES.format(1), 3)} SELECT seq_id, kmer, round(w, 6) AS w FROM a UNION ALL SELECT seq_id + (SELECT max(seq_id) + 1 FROM a), kmer, round(w, 6) FROM b"
)
def merge_motifs(spark, sf_dir):
    first, second, _ = (C.distribution(h, L3) for h in halves(spark, sf_dir))
    return C.merge(first, second, L3, L3).select("seq_id", "kmer", r6("w"))


@query(f"SELECT seq_id, kmer, round(w, 6) AS w FROM {dist(DOC_SEQ, 3)} WHERE seq_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def select_distributions(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("seq_id"))
    return C.select(C.distribution(sequences(spark, sf_dir), L3), ids).select("seq_id", "kmer", r6("w"))


def estimate_sql(source: str) -> str:
    """l = 3 with one gap, from the mismatch weights of gapped words."""
    w = "CASE j WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"
    from math import comb

    weight = [sum(comb(3, n) * 3**n for n in range(3 - j)) * (-1) ** j / (64 * 3 * comb(2, j)) for j in range(3)]
    mism = lambda a, b: f"(CASE WHEN substr(k, {a}, 1) <> substr(x, {a}, 1) THEN 1 ELSE 0 END + CASE WHEN substr(k, {b}, 1) <> substr(x, {b}, 1) THEN 1 ELSE 0 END)"
    total = " + ".join(w.replace("j", mism(a, b), 1).format(*weight) for a, b in ((1, 2), (1, 3), (2, 3)))
    words = f"(SELECT {LETTER.format(16)} || {LETTER.format(4)} || {LETTER.format(1)} AS x FROM range(64) t(i))"
    return f"SELECT seq_id, x AS kmer, sum(n * ({total})) AS n FROM (SELECT seq_id, kmer AS k, n FROM {source}) CROSS JOIN {words} GROUP BY ALL"


@query(f"SELECT seq_id, kmer, round(n, 6) AS n FROM ({estimate_sql(counts(MOTIF_SEQ, 3))}) WHERE n > 1e-9")
def estimate_lmers(spark, sf_dir):
    return C.estimated(C.count(motif_sequences(spark, sf_dir), L3), KmerSpace(3, 1), 1e-9).select("seq_id", "kmer", r6("n"))


@query(f"SELECT seq_id, kmer, round(sqrt(n / sum(n) OVER (PARTITION BY seq_id)), 6) AS w FROM ({estimate_sql(f'(SELECT seq_id, kmer, w * w AS n FROM {dist(MOTIF_SEQ, 3)})')}) WHERE n > 1e-9")
def estimate_motifs(spark, sf_dir):
    m = motifs(spark, sf_dir).select("seq_id", "kmer", (F.col("w") * F.col("w")).alias("n"))
    return C.hellinger(C.estimated(m, KmerSpace(3, 1), 1e-9)).select("seq_id", "kmer", r6("w"))


def window_sql(win: int) -> str:
    pos = f"(SELECT seq_id, starts, p AS pos, substr(seq, p, 3) AS kmer FROM (SELECT seq_id, seq, length(seq) - {win} + 1 AS starts, unnest(range(1, length(seq) - 1)) AS p FROM {MOTIF_SEQ}) WHERE starts > 0 AND regexp_full_match(substr(seq, p, 3), '[ACGT]{{3}}'))"
    n = f"(SELECT seq_id, s AS start, kmer, count(*) AS n FROM (SELECT seq_id, kmer, unnest(range(greatest(pos - {win - 3}, 1), least(pos, starts) + 1)) AS s FROM {pos}) GROUP BY ALL)"
    return f"(SELECT seq_id, start, kmer, sqrt(n / sum(n) OVER (PARTITION BY seq_id, start)) AS w FROM {n})"


@query(f"SELECT seq_id, start, kmer, round(w, 6) AS w FROM {window_sql(20)}")
def window_profile(spark, sf_dir):
    return W.profile(motif_sequences(spark, sf_dir), 20, L3).select("seq_id", F.col("start").cast("long"), "kmer", r6("w"))


@query(f"SELECT p.seq_id, start, m.seq_id AS motif_id, round(sum(p.w * m.w), 6) AS bc FROM {window_sql(31)} p JOIN {dist(MOTIF_SEQ, 3)} m USING (kmer) GROUP BY ALL")
def features_profile(spark, sf_dir):
    return W.features_profile(motifs(spark, sf_dir), motif_sequences(spark, sf_dir), 31, L3).select("seq_id", F.col("start").cast("long"), "motif_id", r6("bc"))


@query(f"SELECT seq_id, i AS n, r AS run FROM (SELECT seq_id, unnest(regexp_extract_all(seq, '[ACGT]+')) AS r, generate_subscripts(regexp_extract_all(seq, '[ACGT]+'), 1) AS i FROM {DOC_SEQ})")
def sequence_runs(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", F.posexplode(S.runs("seq")).alias("i", "run")).select("seq_id", (F.col("i") + 1).cast("long").alias("n"), "run")


@query(f"SELECT seq_id, translate(regexp_replace(seq, '[^ACGT]', '4', 'g'), 'ACGT', '0123') AS codes FROM {MOTIF_SEQ}")
def base_codes(spark, sf_dir):
    return motif_sequences(spark, sf_dir).select("seq_id", S.base_codes("seq").alias("codes"))


@query(f"SELECT seq_id, {rc('seq')} AS rc FROM {DOC_SEQ}")
def reverse_complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", S.reverse_complement("seq").alias("rc"))


CODON = "strpos('TCAG', substr(c, {}, 1)) - 1"


def codon_sql(code: str) -> str:
    aa = f"CASE WHEN regexp_full_match(c, '[ACGT]{{3}}') THEN substr('{code}', 1 + 16 * ({CODON.format(1)}) + 4 * ({CODON.format(2)}) + {CODON.format(3)}, 1) ELSE 'X' END"
    return f"coalesce(string_agg({aa}, '' ORDER BY i), '')"


def translated(code: str) -> str:
    return f"SELECT seq_id, {codon_sql(code)} AS protein FROM (SELECT seq_id, i, substr(seq, 3 * i + 1, 3) AS c FROM (SELECT seq_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM {MOTIF_SEQ})) GROUP BY seq_id"


@query(translated(S.STANDARD_CODE))
def translate_codons(spark, sf_dir):
    return motif_sequences(spark, sf_dir).filter(F.length("seq") >= 3).select("seq_id", S.translate_codons("seq").alias("protein"))


@query(translated(S.MITOCHONDRIAL_CODE))
def translate_codons_mt(spark, sf_dir):
    return motif_sequences(spark, sf_dir).filter(F.length("seq") >= 3).select("seq_id", S.translate_codons("seq", code=S.MITOCHONDRIAL_CODE).alias("protein"))


@query(
    "WITH s AS (SELECT doc_id AS seq_id, coalesce(text, '') AS t FROM documents) SELECT seq_id, CASE WHEN length(t) > 0 THEN "
    "(length(regexp_replace(t, '[^GCgc]', '', 'g')) * 20 // length(t)) * 21 + length(regexp_replace(t, '[^acgtn]', '', 'g')) * 20 // length(t) ELSE 0 END AS key FROM s"
)
def gc_repeat_bin(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), S.gc_repeat_key(F.coalesce("text", F.lit(""))).alias("key"))


@query(f"SELECT seq_id, substr(seq, 1, 50) AS first, substr(seq, 51, 50) AS middle, substr(seq, 101, 50) AS last FROM {DOC_SEQ}")
def substring_windows(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s.select("seq_id", *[S.window("seq", a, a + 49).alias(n) for n, a in (("first", 1), ("middle", 51), ("last", 101))])


@query(
    "SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, len(list_filter(string_split(c_name, '#'), lambda x: x <> '')) AS parts, c_name || ':' || c_mktsegment AS both, c_name < c_mktsegment AS before FROM customer"
)
def string_ops(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.lower("c_name").alias("low"), F.upper("c_mktsegment").alias("up"), F.size(S.split_nonempty("c_name", "#")).cast("long").alias("parts"), F.concat("c_name", F.lit(":"), "c_mktsegment").alias("both"), (F.col("c_name") < F.col("c_mktsegment")).alias("before"))


@query(f"SELECT s.seq_id, s.motif_id, s.bc FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(bc, 9) DESC, motif_id) AS k FROM (SELECT s.seq_id, m.seq_id AS motif_id, round(sum(s.w * m.w), 6) AS bc FROM {dist(DOC_SEQ, 3)} s JOIN {dist(MOTIF_SEQ, 3)} m USING (kmer) GROUP BY ALL)) s WHERE k <= 3")
def top_motifs(spark, sf_dir):
    """The three motifs most alike to each sequence."""
    from pyspark.sql import Window

    f = motif_features(spark, sf_dir)
    w = Window.partitionBy("seq_id").orderBy(F.col("bc").desc(), "motif_id")
    return f.withColumn("k", F.row_number().over(w)).filter("k <= 3").drop("k")
