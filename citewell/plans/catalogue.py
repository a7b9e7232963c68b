"""All queries of the indicator engine by name, each with its SQL twin where SQL can express it.

Names begin with the operator's id in the survey.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, nudge: bool = True) -> Callable[[Query], Query]:
    """Registers a query and its SQL.

    With ``nudge`` the SQL rounds as ``fixture.rounded`` does: a hair is added
    first, so exact ties don't hang on the order of summation.
    """

    def put(build: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = build
        if sql:
            _SQL[name] = sql.replace("round(", "round(1e-12 + ") if nudge else sql
        return build

    return put


def _load() -> None:
    for part in ("cube_queries", "topic_queries", "frame_queries", "scalar_queries", "source_queries", "time_queries"):
        importlib.import_module(f"citewell.plans.{part}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
