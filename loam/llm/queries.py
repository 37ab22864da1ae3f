"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.llm import bpe, decontaminate, flac, lm, quality, setjoin, sharding, tokenfiles, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_flac": flac.op2_flac,
        "op3_ngram_jaccard": setjoin.op3_ngram_jaccard,
        "op4_quality": quality.op4_quality,
        "op5_sharding": sharding.op5_sharding,
        "op6_url_filters": urls.op6_url_filters,
        "op7_bpe": bpe.op7_bpe,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_token_files": tokenfiles.op9_token_files,
        "op10_lm": lm.op10_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": urls.OP6_SQL, "op8_decontaminate": decontaminate.OP8_SQL}
