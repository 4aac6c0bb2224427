"""Exact deduplication through content-defined chunk recipes (DataFrame functions only).

Each text is cut where its content says so: a chunk ends after five characters
whose code points have the remainders ``CUT`` by four, about once in two
thousand characters of prose, at the earliest after ``MIN_CHUNK`` characters
and at the latest after ``MAX_CHUNK`` (so do texts without Latin-1 letters).
Cuts depend on nearby characters alone, so equal passages of different
documents give equal chunks.  A document becomes an ordered list of chunk identifiers (64-bit hash
and byte length), a *recipe*.  The chunk dictionary holds each distinct
(identifier, content) once, combined map-side first; an identifier that turns
up with two contents is ambiguous, and documents that use one carry the
SHA-256 of their text beside the recipe.  Documents are equal exactly when
recipe and that tag are equal, so only recipes (16 bytes a chunk) are
shuffled by group; long texts move once, as distinct chunks, for verification.

Defined cases: a null text counts as empty (an empty recipe), and all empty
texts form one group; a null ``doc_id`` can stay only if the group has no
other id; rows that repeat a doc_id and text are counted each and share their
``kept`` flag; columns beyond ``doc_id`` and ``text`` are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import packed, save, scratch, text_or_empty

MIN_CHUNK, MAX_CHUNK, CUT = 256, 16384, (3, 2, 0, 3, 1)


def remainder_class(k: int) -> str:
    """Character class of the code points 32 to 255 with remainder k by four."""
    return "[" + "".join(f"\\x{c:02X}" for c in range(32, 256) if c % 4 == k) + "]"


#: Lazy run up to the first boundary past MIN_CHUNK, else MAX_CHUNK characters, else the rest.
CHUNKS = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<={''.join(map(remainder_class, CUT))})|.{{1,{MAX_CHUNK}}}"


def chunks(text):
    return F.regexp_extract_all(text, F.lit(CHUNKS), F.lit(0))


def chunk_id(chunk):
    return F.struct(F.xxhash64(chunk).alias("h"), F.octet_length(chunk).alias("n"))


def ambiguous_ids(docs: DataFrame) -> DataFrame:
    """Identifiers (h, n) that stand for more than one chunk content."""
    parts = docs.select(F.explode(chunks(text_or_empty())).alias("chunk"))
    held = parts.select(chunk_id(F.col("chunk")).alias("id"), "chunk").distinct()
    return held.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("id")


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe, tag): tag is null unless the recipe uses an ambiguous identifier."""
    base = docs.select(
        "doc_id",
        F.sha2(text_or_empty(), 256).alias("text_sha256"),
        F.transform(chunks(text_or_empty()), chunk_id).alias("recipe"),
    )
    doubted = save(ambiguous_ids(docs), scratch(docs.sparkSession, "ambiguous"))
    if doubted.isEmpty():  # as good as always: the identifiers are verified, nothing is joined
        return base.withColumn("tag", F.lit(None).cast("string"))
    used = base.select("doc_id", F.explode(F.array_distinct("recipe")).alias("id"))
    doubtful = used.join(doubted, "id", "left_semi").select(F.col("doc_id").alias("_doubtful")).distinct()
    return base.join(doubtful, base.doc_id.eqNullSafe(F.col("_doubtful")), "left").select(
        "doc_id", "text_sha256", "recipe", F.when(F.col("_doubtful").isNotNull(), F.col("text_sha256")).alias("tag")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (see the module)."""
    held = recipes(docs)
    groups = held.groupBy("recipe", "tag").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A short key beside the ordered lists keeps the join's sort cheap; the lists themselves decide.
    key = F.xxhash64("recipe").alias("_k")
    left = held.withColumn("_k", key)
    right = groups.select(key, F.col("recipe").alias("_r"), F.col("tag").alias("_t"), "keep_id", "group_size")
    same = (F.col("_k_l") == F.col("_k")) & (F.col("recipe") == F.col("_r")) & F.col("tag").eqNullSafe(F.col("_t"))
    return (
        left.withColumnRenamed("_k", "_k_l")
        .join(right, same)
        .select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; of rows that repeat a kept doc_id and text, one.

    One key for (doc_id, text) serves the join and the choice among repeats, so
    whole rows are shuffled and sorted once.
    """
    key = lambda sha: F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha), 256)
    kept = exact_dedup(docs).filter("kept").select(key(F.col("text_sha256")).alias("_own"))
    held = docs.select(packed(docs), key(F.sha2(text_or_empty(), 256)).alias("_own"))
    stay = held.join(kept, "_own", "left_semi")
    first = F.row_number().over(Window.partitionBy("_own").orderBy("_own"))
    return stay.withColumn("_n", first).filter("_n = 1").select("_row.*")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, true) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
