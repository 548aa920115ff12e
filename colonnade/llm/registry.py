"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm import decontam, langid, maxent, minhash, pieces, quotes, sharding, simhash, tokenfiles, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_quotes": quotes.op2_quotes,
        "op3_tokenfiles": tokenfiles.op3_tokenfiles,
        "op4_sharding": sharding.op4_sharding,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_simhash": simhash.op6_simhash,
        "op7_pieces": pieces.op7_pieces,
        "op8_language": langid.op8_language,
        "op9_maxent": maxent.op9_maxent,
        "op10_fingerprints": minhash.op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.OP1_SQL, "op2_quotes": quotes.OP2_SQL}
