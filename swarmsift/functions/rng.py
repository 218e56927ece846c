"""Partitioning-independent randomness.

``F.rand(seed)`` and ``DataFrame.sample`` depend on how rows are laid out in
partitions, so the same seed gives different rows after a repartition.  Here
a uniform number is a pure function of (seed, tag, key…):

    u = (first 32 bits of md5("seed:tag:k1:k2…") + 0.5) / 2^32   ∈ (0, 1)

The same value is computed by DuckDB with
``(CAST(('0x' || substr(md5(s), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0``,
which is what the oracle SQL uses.  Keys must be integers or plain strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(seed: int, tag: str, keys) -> Column:
    parts = [F.lit(str(seed)), F.lit(tag)] + [
        k if isinstance(k, Column) else F.lit(str(k)) for k in keys
    ]
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def uniform(seed: int, tag: str, *keys) -> Column:
    """Hash-uniform in (0, 1) keyed by seed, tag and key columns."""
    h = F.conv(F.substring(F.md5(_key(seed, tag, keys)), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(TWO32)


def randint(seed: int, tag: str, n, *keys) -> Column:
    """Uniform integer in [0, n) (``n`` a column or int)."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.floor(uniform(seed, tag, *keys) * n_col).cast("int")


def gauss(seed: int, tag: str, *keys) -> Column:
    """Standard normal via Box–Muller on two independent hash-uniforms."""
    u1 = uniform(seed, tag + ".g1", *keys)
    u2 = uniform(seed, tag + ".g2", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def sql_uniform(seed: int, tag: str, *keys: str) -> str:
    """DuckDB text of :func:`uniform`; ``keys`` are SQL expressions."""
    inner = " || ':' || ".join([f"'{seed}'", f"'{tag}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"((CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def sql_randint(seed: int, tag: str, n: str, *keys: str) -> str:
    return f"CAST(floor({sql_uniform(seed, tag, *keys)} * ({n})) AS INTEGER)"


def sql_gauss(seed: int, tag: str, *keys: str) -> str:
    u1 = sql_uniform(seed, tag + ".g1", *keys)
    u2 = sql_uniform(seed, tag + ".g2", *keys)
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"
