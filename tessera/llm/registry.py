"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_dac", "op2_pieces", "op3_urlfilter", "op4_warc", "op5_langid", "op6_secrets", "op7_near_duplicates", "op8_pii", "op9_topk", "op10_decontaminate"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"tessera.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"tessera.llm.{m}").ORACLES.items()}
