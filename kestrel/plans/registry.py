"""Registry of named checks: a Spark builder plus, where SQL can say it, an oracle.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's tables.  The oracle is an independent DuckDB SQL text over the same
parquet files (views named after the tables).  Column names and types match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"duplicate check name {name}")
        _BUILDERS[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their checks.
    from kestrel.plans import (  # noqa: F401
        retrieval_plans, prepare_plans, profile_plans, split_plans, tfidf_plans,
        rerank_plans, expand_plans, pseudo_plans, evaluate_plans, diagnose_plans,
        model_plans, round_plans, io_plans, coverage_plans, composite_plans,
    )


def builders() -> dict[str, Builder]:
    _load_all()
    return dict(_BUILDERS)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
