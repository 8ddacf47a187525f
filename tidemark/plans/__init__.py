"""Queries over the test tables: each an operator of the library, with its SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("features", "relational", "scoring", "graphs", "texts", "streams", "situation", "served", "desk")


def all_queries() -> tuple[dict, dict]:
    from tidemark.plans import registry

    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")
    return dict(registry.QUERIES), dict(registry.SQL)
