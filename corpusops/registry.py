"""Queries of the core library: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL beside them."""

from __future__ import annotations

from corpusops.queries import audits, filed, linking, repairs, text  # noqa: F401
from corpusops.queries.base import ORACLES, QUERIES  # noqa: F401
