"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import ball_tree, brown_lm, compression_quality, decontaminate, filter_audit, line_dedup, pieces, pii, secrets, simhash, suffix_repeats, url_filter, whitening

QUERIES = {
    "op1_ball_tree": ball_tree.op1_ball_tree,
    "op2_secrets": secrets.op2_secrets,
    "op3_pii": pii.op3_pii,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_simhash": simhash.op5_simhash,
    "op6_pieces": pieces.op6_pieces,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_compression_quality": compression_quality.op9_compression_quality,
    "op10_brown_lm": brown_lm.op10_brown_lm,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_suffix_repeats": suffix_repeats.op12_suffix_repeats,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op1_ball_tree": ball_tree.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_suffix_repeats": suffix_repeats.ORACLE_SQL,
}
