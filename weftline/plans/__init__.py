"""Queries over the driver tables, with the SQL that checks them.

Each module has QUERIES (name to function of (spark, sf_dir)) and ORACLE (name
to SQL); names that SQL cannot express have none.
"""

from __future__ import annotations

import importlib

MODULES = ["dialogue", "tokens", "layouts", "sequences", "corpus", "vectors", "tracks", "rotation", "turning", "skeletons", "motion", "classes", "loaders", "files", "streams"]


def collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"weftline.plans.{module}"), name)
    return out


def queries() -> dict:
    return collect("QUERIES")


def oracle_sql() -> dict:
    return collect("ORACLE")
