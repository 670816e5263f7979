"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import ann, bitpack, bpe, jaccard, langid, lm, mixing, quality, secrets, toxicity

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_secrets": secrets.op2_secrets,
    "op3_lm_score": lm.op3_lm_score,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_files": bitpack.op5_token_files,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_language_id": langid.op8_language_id,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe": bpe.op10_bpe,
}

#: The other operators are models, tokenizers and encoders, which SQL cannot express; tests hold them against brute force.
SQL: dict[str, str] = {"op7_jaccard_join": jaccard.SQL}
