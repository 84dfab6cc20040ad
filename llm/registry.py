"""The text operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from llm import bpe, chat, decontaminate, importance, langid, minhash, periodic, quality, sharding, substring, suffix, warc, wordvectors

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
    "op4_suffix_array_dedup": suffix.op4_suffix_array_dedup,
    "op5_language_id": langid.op5_language_id,
    "op6_sharding": sharding.op6_sharding,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_warc": warc.op10_warc,
    "op11_quality_classifier": wordvectors.op11_quality_classifier,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_periodic_runs": periodic.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_substring_dedup": substring.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op3_minhash_near_dedup": minhash.ORACLE,
    "op4_suffix_array_dedup": suffix.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op10_warc": warc.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
}
