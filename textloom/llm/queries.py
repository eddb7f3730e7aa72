"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from textloom.llm import audit, bpe, decontaminate, exact, lines, pii, resample, secrets, simhash, substrings, toxicity, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_vectors": vectors.op2_vectors,
    "op3_bpe": bpe.op3_bpe,
    "op4_simhash": simhash.op4_simhash,
    "op5_substrings": substrings.op5_substrings,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_pii": pii.op7_pii,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_secrets": secrets.op9_secrets,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_resample": resample.op11_resample,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_exact_dedup": exact.op13_exact_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_vectors": vectors.ORACLE,
    "op5_substrings": substrings.ORACLE,
    "op6_line_dedup": lines.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op11_resample": resample.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op13_exact_dedup": exact.ORACLE,
}
