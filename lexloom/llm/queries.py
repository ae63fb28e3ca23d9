"""Queries and SQL of the subpackage, by name."""

from __future__ import annotations

from . import bpe, chat, cotrain, decontam, langid, lattice, licenses, near_dup, quality_rules, warc

QUERIES = {
    "op1_lm_score": lattice.op1_lm_score,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_chat_format": chat.op3_chat_format,
    "op4_bpe": bpe.op4_bpe,
    "op5_warc": warc.op5_warc,
    "op6_quality": cotrain.op6_quality,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_langid": langid.op9_langid,
    "op10_near_dup": near_dup.op10_near_dup,
}

ORACLE_SQL: dict[str, str] = {"op3_chat_format": chat.SQL, "op5_warc": warc.SQL, "op7_quality_rules": quality_rules.SQL}
