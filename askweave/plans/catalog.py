"""All registered queries."""

from __future__ import annotations

from importlib import import_module

AREAS = ("text", "retrieval", "evaluation", "semantics", "feedback", "recommendation")


def all_queries() -> dict:
    found = {}
    for area in AREAS:
        found.update(import_module(f"askweave.plans.{area}_queries").QUERIES)
    return found
