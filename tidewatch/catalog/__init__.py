"""Registered queries with the SQL they must agree with."""

from __future__ import annotations

from tidewatch.catalog.registry import QUERIES, Query


def registered() -> dict[str, Query]:
    from tidewatch.catalog import jobs, relational, reports  # noqa: F401

    return dict(QUERIES)
