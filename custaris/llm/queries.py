"""Registered queries of the training-data operators: one opN_<name> for each, applied to whole tables."""

from __future__ import annotations

from . import langid, lm, merkle, mixing, neardup, orderhash, pieces, pii, quality, repeats, secrets, tokalign, toxicity

QUERIES = {
    "op1_neardup": neardup.op1_neardup,
    "op2_lm": lm.op2_lm,
    "op3_language": langid.op3_language,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_repeats": repeats.op6_repeats,
    "op7_pieces": pieces.op7_pieces,
    "op8_orderhash": orderhash.op8_orderhash,
    "op9_pii": pii.op9_pii,
    "op10_mixing": mixing.op10_mixing,
    "op11_alignment": tokalign.op11_alignment,
    "op12_merkle": merkle.op12_merkle,
    "op13_secrets": secrets.op13_secrets,
}

ORACLES = {
    "op1_neardup": neardup.ORACLE,
    "op5_quality": quality.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_alignment": tokalign.op11_alignment,
    "op12_merkle": merkle.ORACLE,
}
