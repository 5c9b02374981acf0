"""The catalogue of queries: name, inventory ids, DataFrame builder and reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Builder
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name`` for the inventory ``ids`` (space separated)."""

    def register(build: Builder) -> Builder:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, tuple(ids.split()), build, sql)
        return build

    return register


def load_all() -> dict[str, Query]:
    """Import every plan module once so that the catalogue is complete."""
    from siftmill.plans import (  # noqa: F401
        code_plans,
        feedback_plans,
        findings_plans,
        html_plans,
        mining_plans,
        scan_plans,
        session_plans,
        stream_plans,
        token_plans,
        usage_plans,
    )

    return CATALOG
