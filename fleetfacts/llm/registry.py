"""Queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from fleetfacts.llm import chat_format, chat_repair, decontaminate, filter_audit, fingerprint, html_text, license_scan, near_dedup, pii, toxicity, warc
from fleetfacts.llm.bpe import op9_bpe
from fleetfacts.llm.secret_scan import op10_secrets

QUERIES = {
    "op1_chat": chat_format.op1_chat,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_pii": pii.op4_pii,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_html": html_text.op8_html,
    "op9_bpe": op9_bpe,
    "op10_secrets": op10_secrets,
    "op11_chat_repair": chat_repair.op11_chat_repair,
    "op12_license": license_scan.op12_license,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_chat": chat_format.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op6_warc": warc.SQL,
    "op11_chat_repair": chat_repair.SQL,
    "op12_license": license_scan.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
