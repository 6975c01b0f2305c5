"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from tessera.llm import bpe, exact_dedup, gif, html_extract, license_scan, near_dedup, packing, pii, quality, token_files

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_licenses": license_scan.op2_licenses,
    "op3_gif": gif.op3_gif,
    "op4_packing": packing.op4_packing,
    "op5_pii": pii.op5_pii,
    "op6_quality": quality.op6_quality,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_bpe": bpe.op9_bpe,
    "op10_html": html_extract.op10_html,
}

ORACLES = {
    "op2_licenses": license_scan.OP2_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
