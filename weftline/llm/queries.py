"""The queries of this subpackage and their SQL, one operator each."""

from __future__ import annotations

import importlib

MODULES = ["line_dedup", "sentencepiece_scan", "token_counts", "near_vectors", "suffixes", "quality", "secrets_scan", "jaccard", "licenses", "mixing", "manifest", "whitening", "context_mixing"]


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"weftline.llm.{module}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
