"""Registered queries: name to Spark query and to the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL where SQL can express it."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap
