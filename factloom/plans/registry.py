"""Named queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans.facts import Facts, with_facts
from factloom.session import tune

BUILDERS: dict[str, Callable[[Facts], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a builder; ``oracle`` may name derived tables freely."""

    def register(build: Callable[[Facts], DataFrame]):
        BUILDERS[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def _load() -> None:
    from factloom.plans import (  # noqa: F401
        q_calls,
        q_diagnose,
        q_hierarchy,
        q_lookup,
        q_names,
        q_resolve,
        q_search,
        q_snapshots,
        q_text,
        q_traces,
        q_views,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        return lambda spark, sf_dir: build(Facts(tune(spark), sf_dir))

    return {name: bind(build) for name, build in BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_facts(sql) for name, sql in ORACLES.items()}
