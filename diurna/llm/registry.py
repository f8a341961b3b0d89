"""Queries of this folder, and SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from . import bpe, decontam, hnsw, langid, licences, pii, quality, simhash, tokenfile, urls

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_quality": quality.op2_quality,
    "op3_token_file": tokenfile.op3_token_file,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_language": langid.op5_language,
    "op6_url_filter": urls.op6_url_filter,
    "op7_surrogates": pii.op7_surrogates,
    "op8_simhash_groups": simhash.op8_simhash_groups,
    "op9_licences": licences.op9_licences,
    "op10_nearest": hnsw.op10_nearest,
}

ORACLES: dict[str, str] = {
    "op4_decontaminate": decontam.ORACLE,
    "op6_url_filter": urls.ORACLE,
    "op9_licences": licences.ORACLE,
}
