"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tideledger.llm import line_templates, mixing, secrets
from tideledger.llm.audio import op1_audio_features
from tideledger.llm.interpolation import op4_interpolated_lm
from tideledger.llm.langid import op5_language_id
from tideledger.llm.pieces import op9_piece_dropout
from tideledger.llm.quality_rules import op7_quality_rules
from tideledger.llm.resample import op10_importance_resampling
from tideledger.llm.simhash import op8_simhash

QUERIES = {
    "op1_audio_features": op1_audio_features,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_interpolated_lm": op4_interpolated_lm,
    "op5_language_id": op5_language_id,
    "op6_line_templates": line_templates.op6_line_templates,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_piece_dropout": op9_piece_dropout,
    "op10_importance_resampling": op10_importance_resampling,
}

ORACLES = {
    "op2_secret_scan": secrets.ORACLE,
    "op3_source_mixing": mixing.ORACLE,
    "op6_line_templates": line_templates.ORACLE,
}
