"""All registered queries: name -> callable, and name -> DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import adapter

FLAGSHIP = "a03_spending_by_category"

_QUERIES: dict = {}
_SQL: dict = {}
#: One letter a type in declarations of results: long, string, money, date, boolean, float. Money goes out as double, dates as text.
_SPARK = {"l": "bigint", "s": "string", "m": "double", "d": "string", "b": "boolean", "f": "double"}
_DUCK = {"l": "BIGINT", "s": "VARCHAR", "m": "DOUBLE", "d": "VARCHAR", "b": "BOOLEAN", "f": "DOUBLE"}


def register(name: str, out: str, frames: str = "", sql: str | None = None):
    """Decorator: adds a query over the canonical `frames` (given as DataFrames in that order), or over (spark, sf_dir) without.

    out: "column type, ..."; both sides are cast to it. sql: the oracle over the same frames.
    """
    columns = [c.split() for c in out.split(",")]
    names = frames.split()

    def add(f):
        assert name not in _QUERIES, name

        def query(spark, sf_dir) -> DataFrame:
            df = f(*[adapter.frame(spark, sf_dir, n) for n in names]) if names else f(spark, sf_dir)
            return df.select(*[F.col(c).cast(_SPARK[t]).alias(c) for c, t in columns])

        _QUERIES[name] = query
        if sql is not None:
            body = sql.strip()
            if names:
                rest = body[4:].lstrip() if body[:5].upper() == "WITH " else None
                body = f"{adapter.ctes(*names)}, {rest}" if rest else f"{adapter.ctes(*names)} {body}"
            _SQL[name] = f"SELECT {', '.join(f'CAST({c} AS {_DUCK[t]}) AS {c}' for c, t in columns)} FROM ({body})"
        return f

    return add


def sql_of(name: str) -> str:
    """The oracle SQL of a query whose plan module has been imported, to be used as a subquery of another."""
    return _SQL[name]


def query_of(name: str):
    return _QUERIES[name]


def _load() -> None:
    """Import the plan modules, whose decorators fill the registry."""
    from ledgerlake import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"ledgerlake.plans.{module.name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)
