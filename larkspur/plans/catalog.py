"""All queries of the library and their DuckDB twins."""

from __future__ import annotations

import importlib

MODULES = ("larkspur.operators.market", "larkspur.operators.names", "larkspur.operators.history", "larkspur.operators.relations", "larkspur.operators.matching", "larkspur.operators.pages", "larkspur.operators.vocabulary", "larkspur.operators.retrieval", "larkspur.operators.producers", "larkspur.operators.prices", "larkspur.operators.sitemaps", "larkspur.operators.decisions", "larkspur.streaming.events")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(m).ORACLES.items()}
