"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from importlib import import_module

#: Query name to module and function.
NAMES = {
    "op5_site_bayes": "sitebayes",
    "op4_minhash": "neardup",
    "op1_fingerprint": "fingerprint",
    "op10_toxicity": "toxicity",
    "op2_pii": "pii",
    "op3_quality": "quality",
    "op6_packing": "packing",
    "op7_secrets": "secrets",
    "op8_bpe_prefix": "bpe",
    "op9_id_files": "idfiles",
}


def queries():
    return {name: getattr(import_module(f"lathe.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {}
