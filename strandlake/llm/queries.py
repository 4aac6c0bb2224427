"""The ``opN_<name>`` queries and their SQL."""

from __future__ import annotations

import public_tokenizers

from strandlake.llm import byte_bpe, exact_dedup, language, media, mixing, pii, simhash, token_store, url_filter, warc
from strandlake.llm.common import read


def op1_simhash(spark, sf_dir):
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    return warc.archived(read(spark, sf_dir, "pages"))


def op3_token_store(spark, sf_dir):
    return token_store.stored(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language(spark, sf_dir):
    return language.identified(read(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.identified(read(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.taken(read(spark, sf_dir, "documents"))


def op7_media(spark, sf_dir):
    return media.features(media.store(read(spark, sf_dir, "documents")))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return url_filter.url_filter(read(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op10_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_warc": op2_warc,
        "op3_token_store": op3_token_store,
        "op4_language": op4_language,
        "op5_pii": op5_pii,
        "op6_mixing": op6_mixing,
        "op7_media": op7_media,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_url_filter": op9_url_filter,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
        "op9_url_filter": url_filter.ORACLE_SQL,
    }
