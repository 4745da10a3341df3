"""Corpus preparation in five stages; see ``STAGES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moderato.llm.common import documents, stage
from moderato.llm.pipeline_stages import (clean_personal_data, decontaminate, identify_language, one_of_each_group,
                                          pack_sequences)

STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("pii", clean_personal_data),
    ("best_fit_packing", pack_sequences),
]

# Prototypes, a trained tagger and a tokenizer have no SQL form; the tests hold
# the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
