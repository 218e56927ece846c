"""Queries over the given tables, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from . import queries as Q
from . import sql as S


def queries() -> dict:
    return dict(Q.QUERIES)


def oracle_sql() -> dict:
    return dict(S.ORACLES)
