"""Registered queries of the audit engine and their oracles."""

from __future__ import annotations

from crawlens.plans.oracles import ORACLES
from crawlens.plans.queries import QUERIES


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
