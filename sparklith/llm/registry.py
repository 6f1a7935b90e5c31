"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontaminate, langid, lm, minhash, packing, quality, substring, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_chat": chat.op2_chat,
    "op3_minhash": minhash.op3_minhash,
    "op4_language_id": langid.op4_language_id,
    "op5_kneser_ney": lm.op5_kneser_ney,
    "op6_ann": ann.op6_ann,
    "op7_substring": substring.op7_substring,
    "op8_quality_qda": quality.op8_quality_qda,
    "op9_packing": packing.op9_packing,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op3_minhash": minhash.OP3_SQL,
    "op7_substring": substring.OP7_SQL,
}
