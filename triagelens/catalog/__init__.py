"""Registered queries with their check SQL, grouped by area."""

from __future__ import annotations

import importlib

AREAS = ["evaluation", "rollout", "texts", "decisions", "search", "operations", "streams"]


def _modules():
    return [importlib.import_module(f"{__name__}.{a}") for a in AREAS]


def all_queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
