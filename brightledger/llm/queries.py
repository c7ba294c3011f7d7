"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL twins."""

from __future__ import annotations

import public_tokenizers

from brightledger.llm import ann, blocks, bpe, interactions, lm, mixing, near, negatives, preferences, quality, rollups, suffix, toxicity
from brightledger.llm.common import read

QUERIES = {
    "op1_toxicity": lambda spark, sf: toxicity.query(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op2_preferences": lambda spark, sf: preferences.query(read(spark, sf, "conversations")),
    "op3_nearest_vectors": lambda spark, sf: ann.query(read(spark, sf, "embeddings")),
    "op4_token_rollups": lambda spark, sf: rollups.query(read(spark, sf, "documents")),
    "op5_repeated_strings": lambda spark, sf: suffix.query(read(spark, sf, "documents")),
    "op6_near_duplicates": lambda spark, sf: near.near_duplicates(read(spark, sf, "documents")),
    "op7_bpe": lambda spark, sf: bpe.query(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op8_lm_scores": lambda spark, sf: lm.score(read(spark, sf, "documents")),
    "op9_quality_rules": lambda spark, sf: quality.query(read(spark, sf, "documents")),
    "op10_source_mix": lambda spark, sf: mixing.query(read(spark, sf, "documents")),
    "op11_repeated_passages": lambda spark, sf: blocks.query(read(spark, sf, "documents")),
    "op12_filter_audit": lambda spark, sf: interactions.query(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op13_hard_negatives": lambda spark, sf: negatives.query(read(spark, sf, "embeddings")),
}
SQL = {
    "op2_preferences": preferences.ORACLE_SQL,
    "op4_token_rollups": rollups.ORACLE_SQL,
    "op6_near_duplicates": near.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op10_source_mix": mixing.ORACLE_SQL,
    "op11_repeated_passages": blocks.ORACLE_SQL,
    "op12_filter_audit": interactions.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
