"""Numeric column expressions with the reference's NULL / NaN / ∞ rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: the spellings of infinity that
# the tolerant cast turns into NULL (matched after lower(), without trim).
INFINITY_SPELLINGS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def q(name: str) -> str:
    """Backtick-quote a column name (names like ``Flow Byts/s`` are common)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.  Chains of casts and filters stay as long as they
    read, where Spark would put a copy of the value at every mention."""
    return F.get(F.transform(F.array(value), use), 0)


def tolerant_double_typed(c: Column, is_double: bool) -> Column:
    """:func:`tolerant_double` specialised by input type.  On a double the
    string form matches an infinity spelling exactly when the value is ±∞
    (NaN prints as "nan", finite values never match), so the string
    round-trip is replaced by two comparisons — same result, far cheaper."""
    if is_double:
        return let(c, lambda v: F.when(v.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(v))
    return tolerant_double(c)


def tolerant_double(c: Column) -> Column:
    """Infinity spellings → NULL, then ``try_cast(… AS double)``.

    Applied to a column that is already double, ``lower()`` sees the string
    form (``infinity``/``-infinity``/``nan``), so a second pass turns ±∞ into
    NULL and keeps NaN — exactly what running the reference's helper twice
    does.
    """
    blanked = let(c, lambda v: F.when(F.lower(v).isin(*INFINITY_SPELLINGS), F.lit(None)).otherwise(v))
    return blanked.try_cast("double")


def finite_or_zero(c: Column) -> Column:
    """NaN, ±∞ and NULL → 0.0 (model-time imputation)."""
    d = c.try_cast("double")
    valid = ~(F.isnan(d) | d.isNull() | (d == F.lit(float("inf"))) | (d == F.lit(float("-inf"))))
    return F.when(valid, d).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """Overflow-safe logistic function."""
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(
        F.exp(x) / (F.lit(1.0) + F.exp(x))
    )


def saturating_sigmoid(x: Column) -> Column:
    """Logistic function clamped to exactly 0/1 beyond ±35."""
    return (
        F.when(x >= 35, F.lit(1.0))
        .when(x <= -35, F.lit(0.0))
        .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))
    )
