"""The registered queries of the engine's own operators."""

from __future__ import annotations

from importlib import import_module

from strandlake.plans.registry import QUERIES, SQL

MODULES = ("sequences", "relational", "motifs", "genome", "events", "matrices", "files")


def _load() -> None:
    for name in MODULES:
        import_module(f"strandlake.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(SQL)
