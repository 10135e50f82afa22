"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("simhash_queries", "layout_queries", "screen_queries", "text_queries", "line_queries", "token_queries", "audit_queries")


def llm_queries() -> dict:
    found = {}
    for name in MODULES:
        found.update(import_module(f"askweave.llm.{name}").QUERIES)
    return found


def llm_sql() -> dict:
    found = {}
    for name in MODULES:
        found.update(getattr(import_module(f"askweave.llm.{name}"), "SQL", {}))
    return found
