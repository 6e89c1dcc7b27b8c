"""Queries by name, with the DuckDB SQL that returns the same rows."""

from __future__ import annotations

from lumenary.queries import browse, classify, feeds, ingest, lifecycle, reports, runs, scoring, text  # noqa: F401
from lumenary.queries.register import ORACLES, QUERIES  # noqa: F401
