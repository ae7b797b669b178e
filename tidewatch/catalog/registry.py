"""Registration of queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewatch.catalog.sql_parts import PARTS
from tidewatch.catalog.views import as_oracle
from tidewatch.session import pin_utc

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` may name the parts of ``sql_parts`` in braces."""

    def register(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(pin_utc(spark), sf_dir)

        assert name not in QUERIES, name
        QUERIES[name] = Query(run, as_oracle(sql, PARTS) if sql else None)
        return build

    return register
