"""Queries of the subpackage, and SQL for those that it can express."""

from __future__ import annotations

from . import op1_license, op2_repeats, op3_preference, op4_near, op5_quality, op6_secret, op7_toxicity, op8_mix, op9_decontaminate, op10_neighbours, op11_phrases, op12_bpe, op13_resample

QUERIES = {
    "op1_license_scan": op1_license.op1_license_scan,
    "op2_repeat_removal": op2_repeats.op2_repeat_removal,
    "op3_preference_format": op3_preference.op3_preference_format,
    "op4_near_duplicates": op4_near.op4_near_duplicates,
    "op5_quality": op5_quality.op5_quality,
    "op6_secret_scan": op6_secret.op6_secret_scan,
    "op7_toxicity": op7_toxicity.op7_toxicity,
    "op8_mix_sources": op8_mix.op8_mix_sources,
    "op9_decontaminate": op9_decontaminate.op9_decontaminate,
    "op10_nearest_neighbours": op10_neighbours.op10_nearest_neighbours,
    "op11_phrase_collocations": op11_phrases.op11_phrase_collocations,
    "op12_byte_bpe": op12_bpe.op12_byte_bpe,
    "op13_importance_resample": op13_resample.op13_importance_resample,
}

ORACLE_SQL = {
    "op1_license_scan": op1_license.ORACLE_SQL,
    "op3_preference_format": op3_preference.ORACLE_SQL,
    "op8_mix_sources": op8_mix.ORACLE_SQL,
    "op9_decontaminate": op9_decontaminate.ORACLE_SQL,
    "op11_phrase_collocations": op11_phrases.ORACLE_SQL,
}
