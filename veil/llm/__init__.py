"""Operators for preparing training text, each with its query. Nothing else in the library imports this package."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> tuple[dict, dict]:
    """All queries and SQL of the package; importing a query module registers it."""
    from veil.llm import queries  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
