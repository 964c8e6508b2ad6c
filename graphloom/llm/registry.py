"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import fingerprints, importance_resampling, kneser_ney, line_templates, masked_lm, mixing, personal_data, quality_rules, sentencepiece_nbest, simhash, source_divergence, token_orc, url_filter


def queries() -> dict:
    return {
        "op1_token_orc": token_orc.op1_token_orc,
        "op2_kneser_ney": kneser_ney.op2_kneser_ney,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_mixing": mixing.op4_mixing,
        "op5_sentencepiece_nbest": sentencepiece_nbest.op5_sentencepiece_nbest,
        "op6_masked_lm": masked_lm.op6_masked_lm,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_simhash": simhash.op8_simhash,
        "op9_line_templates": line_templates.op9_line_templates,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_source_divergence": source_divergence.op11_source_divergence,
        "op12_importance_resampling": importance_resampling.op12_importance_resampling,
        "op13_personal_data": personal_data.op13_personal_data,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    piped = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return piped | {"op4_mixing": mixing.OP4_SQL, "op10_url_filter": url_filter.OP10_SQL, "op11_source_divergence": source_divergence.OP11_SQL}
