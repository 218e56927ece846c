"""queries() / oracle_sql() registry for the driver's correctness gate.

Each key maps to a callable (spark, sf_dir) -> DataFrame over the given
tables (or fixtures Spark derives from them) and, where SQL can express it,
to the DuckDB text of the same computation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import split as S
from ..sources import fixtures as X
from ..sources import sqlgen as g

_Q: dict = {}
_SQL: dict = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        _Q[key] = fn
        if sql is not None:
            _SQL[key] = sql
        return fn
    return deco


def queries() -> dict:
    _load()
    return dict(_Q)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _Q["population_fitness"](spark, sf_dir)


_loaded = False


def _load():
    global _loaded
    if not _loaded:
        _loaded = True
        from . import queries_clean, queries_model, queries_search, queries_two_gen, sql_search  # noqa: F401
