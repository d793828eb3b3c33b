"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import op1_chat_format, op2_secret_scan, op3_decontaminate, op4_quality, op5_bpe, op6_suffix_dedup, op7_recompression, op8_bottomk, op9_url_filter, op10_token_blocks, op11_quality_nbsvm, op12_divergence, op13_periodic_runs

MODULES = (op1_chat_format, op2_secret_scan, op3_decontaminate, op4_quality, op5_bpe, op6_suffix_dedup, op7_recompression, op8_bottomk, op9_url_filter, op10_token_blocks, op11_quality_nbsvm, op12_divergence, op13_periodic_runs)


def queries() -> dict:
    return {m.__name__.rpartition(".")[2]: m.query for m in MODULES}


def oracle_sql() -> dict:
    return {m.__name__.rpartition(".")[2]: m.SQL for m in MODULES if getattr(m, "SQL", None)}
