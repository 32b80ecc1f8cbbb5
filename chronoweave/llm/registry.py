"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, decontaminate, html, jpeg, langid, licenses, linededup, quality, simhash, toxicity

LLM_QUERIES = {
    "op1_bpe_round_trip": bpe.query,
    "op2_jpeg_media": jpeg.query,
    "op3_language_id": langid.query,
    "op4_html_text": html.query,
    "op5_toxicity": toxicity.query,
    "op6_license_scan": licenses.query,
    "op7_quality": quality.query,
    "op8_simhash": simhash.query,
    "op9_decontaminate": decontaminate.query,
    "op10_line_dedup": linededup.query,
}

LLM_ORACLES: dict[str, str] = {
    "op6_license_scan": licenses.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
}
