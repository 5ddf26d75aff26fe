"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embeddings, exactdedup, lm, mixing, packing, quality, sharding, simhash, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_viterbi_chat": chat.op1_viterbi_chat,
        "op2_tournament_ffd": packing.op2_tournament_ffd,
        "op3_sainte_lague_mix": mixing.op3_sainte_lague_mix,
        "op4_content_sort": exactdedup.op4_content_sort,
        "op5_bit_sliced_simhash": simhash.op5_bit_sliced_simhash,
        "op6_feistel_shards": sharding.op6_feistel_shards,
        "op7_digest_urls": urls.op7_digest_urls,
        "op8_site_bayes": quality.op8_site_bayes,
        "op9_subword_lattice": lm.op9_subword_lattice,
        "op10_projection_forest": embeddings.op10_projection_forest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_content_sort": exactdedup.SQL,
        "op7_digest_urls": urls.SQL,
        "op10_projection_forest": embeddings.SQL,
    }
