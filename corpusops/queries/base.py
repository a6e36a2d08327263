"""How queries and the SQL beside them are registered."""

from __future__ import annotations

from collections.abc import Callable

from corpusops.views import duck_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL if there is any.

    sql: a SELECT, or common table expressions and a SELECT after ``WITH``; with views, those of corpusops.views come before.
    """

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            rest = sql.strip()
            head = f"WITH RECURSIVE {duck_views()}"
            ORACLES[f.__name__] = rest if not views else f"{head}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"{head} {rest}"
        return f

    return register
