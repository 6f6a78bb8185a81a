"""All registered queries."""

from __future__ import annotations

from . import analytics, relational, spaces, text
from .registry import PLANS, Plan

MODULES = (relational, text, analytics, spaces)


def all_plans() -> dict[str, Plan]:
    return dict(PLANS)


def coverage() -> dict[str, list[str]]:
    """Survey id -> names of the queries that show it."""
    out: dict[str, list[str]] = {}
    for p in PLANS.values():
        for i in p.ids:
            out.setdefault(i, []).append(p.name)
    return out
