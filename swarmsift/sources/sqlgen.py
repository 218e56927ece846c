"""Tiny dialect layer so a fixture or oracle is written once and rendered
for Spark (``selectExpr``) and for DuckDB (oracle SQL).

Only the handful of functions whose spelling differs are abstracted.
"""

from __future__ import annotations

import math


def u(dialect: str, seed: int, tag: str, *keys: str) -> str:
    inner_parts = [f"'{seed}'", f"'{tag}'"] + [f"CAST({k} AS STRING)" if dialect == "spark"
                                               else f"CAST({k} AS VARCHAR)" for k in keys]
    inner = "concat_ws(':', " + ", ".join(inner_parts) + ")"
    if dialect == "spark":
        h = f"CAST(conv(substring(md5({inner}), 1, 8), 16, 10) AS DOUBLE)"
    else:
        h = f"CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)"
    return f"(({h} + 0.5) / 4294967296.0)"


def u_chunk(dialect: str, seed: int, tag: str, chunk: int, *keys: str) -> str:
    """The ``chunk``-th (0..3) 32-bit slice of one md5 as a uniform: four
    independent uniforms per digest (the digest is computed once per row —
    common-subexpression elimination)."""
    inner_parts = [f"'{seed}'", f"'{tag}'"] + [f"CAST({k} AS STRING)" if dialect == "spark"
                                               else f"CAST({k} AS VARCHAR)" for k in keys]
    inner = "concat_ws(':', " + ", ".join(inner_parts) + ")"
    start = 1 + 8 * chunk
    if dialect == "spark":
        h = f"CAST(conv(substring(md5({inner}), {start}, 8), 16, 10) AS DOUBLE)"
    else:
        h = f"CAST(('0x' || substr(md5({inner}), {start}, 8)) AS BIGINT)"
    return f"(({h} + 0.5) / 4294967296.0)"


def randint(dialect: str, seed: int, tag: str, n: str, *keys: str) -> str:
    return f"CAST(floor({u(dialect, seed, tag, *keys)} * ({n})) AS INT)"


def gauss(dialect: str, seed: int, tag: str, *keys: str) -> str:
    u1 = u(dialect, seed, tag + ".g1", *keys)
    u2 = u(dialect, seed, tag + ".g2", *keys)
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"


def s(dialect: str) -> str:
    return "STRING" if dialect == "spark" else "VARCHAR"


def elem(dialect: str, arr: str, one_based_idx: str) -> str:
    return f"element_at({arr}, {one_based_idx})" if dialect == "spark" else f"list_extract({arr}, {one_based_idx})"


def regex_strip(dialect: str, text: str, pattern: str) -> str:
    if dialect == "spark":
        return f"regexp_replace({text}, '{pattern}', '')"
    return f"regexp_replace({text}, '{pattern}', '', 'g')"


def transform(dialect: str, arr: str, var: str, body: str) -> str:
    if dialect == "spark":
        return f"transform({arr}, {var} -> {body})"
    return f"list_transform({arr}, lambda {var}: {body})"


def days_since(dialect: str, ts: str, origin: str) -> str:
    if dialect == "spark":
        return f"datediff(CAST({ts} AS DATE), DATE'{origin}')"
    return f"date_diff('day', DATE '{origin}', CAST({ts} AS DATE))"


def qi(name: str, dialect: str) -> str:
    """Quote an identifier."""
    if dialect == "spark":
        return "`" + name.replace("`", "``") + "`"
    return '"' + name.replace('"', '""') + '"'
