"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import functools

from promolens.llm import (
    op10_toxicity,
    op11_token_counts,
    op12_lexical_search,
    op13_prefix_trie,
    op1_training_order,
    op2_ngram_jaccard_join,
    op3_chat_format,
    op4_bpe,
    op5_url_filter,
    op6_substring_dedup,
    op7_decontamination,
    op8_language_id,
    op9_exact_topk,
)
from promolens.llm.ship import ship

MODULES = (
    op1_training_order, op2_ngram_jaccard_join, op3_chat_format, op4_bpe,
    op5_url_filter, op6_substring_dedup, op7_decontamination, op8_language_id,
    op9_exact_topk, op10_toxicity, op11_token_counts, op12_lexical_search,
    op13_prefix_trie,
)


def shipped(fn):
    @functools.wraps(fn)
    def run(spark, base):
        ship(spark)
        return fn(spark, base)

    return run


def pipeline(spark, base: str):
    """The stages of corpus_pipeline.py at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, base)


def queries() -> dict:
    single = {name: shipped(getattr(m, name)) for m in MODULES for name in [m.__name__.rpartition(".")[2]]}
    return single | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {m.__name__.rpartition(".")[2]: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
