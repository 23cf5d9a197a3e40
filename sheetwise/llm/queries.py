"""The text queries and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, importance, jaccard, oracles, pii, quality_rules, repair, simhash, suffix_dedup, token_store, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op8_bpe": bpe.op8_bpe,
        "op7_token_store": token_store.op7_token_store,
        "op10_importance_resampling": importance.op10_importance_resampling,
        "op2_chat_format": chat.op2_chat_format,
        "op3_warc": warc.op3_warc,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op1_pii": pii.op1_pii,
        "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op11_repair": repair.op11_repair,
        "op12_simhash": simhash.op12_simhash,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
