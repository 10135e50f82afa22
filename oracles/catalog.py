"""All SQL twins."""

from __future__ import annotations

from importlib import import_module

AREAS = ("text", "retrieval", "evaluation", "semantics", "feedback", "recommendation")


def all_sql() -> dict:
    found = {}
    for area in AREAS:
        found.update(import_module(f"oracles.{area}_sql").SQL)
    return found
