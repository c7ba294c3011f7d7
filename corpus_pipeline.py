"""The corpus pipeline: toxic documents go, near duplicates go, repeated strings go, sources are mixed, texts are tokenised.

Each stage works on all that its predecessor kept, given as Parquet, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brightledger.llm import bpe, mixing, near, suffix, toxicity
from brightledger.llm.common import materialize, read

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", near.stage),
    ("repeated_strings", suffix.stage),
    ("source_mix", mixing.stage),
    ("bpe", bpe.stage(public_tokenizers.path("word_bpe_49k.json"))),
]

#: Classifiers and tokenizers cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
