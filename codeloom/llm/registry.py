"""The queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

from . import bpe, ctw, decontaminate, matroska, pii, ppm, quality, simhash, toxicity, warc_zip

QUERIES = {
    "op1_language_id": ppm.op1_language_id,
    "op2_matroska": matroska.op2_matroska,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_pii": pii.op4_pii,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_ctw": ctw.op8_ctw,
    "op9_warc_zip": warc_zip.op9_warc_zip,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLE_SQL = {"op9_warc_zip": warc_zip.ORACLE, "op10_decontamination": decontaminate.ORACLE}
