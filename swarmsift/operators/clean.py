"""Cleaning operators: drop, tolerant cast, row filters, the composed
pipeline and a one-pass row-count audit.

All of them are narrow (no shuffle): filters stay next to the scan and the
chain of casts collapses into one Project under Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, tolerant_double, tolerant_double_typed

# Fixed values that must equal the reference (column names of the flow
# table it cleans), in the reference's order.
DEFAULT_DROP = [
    "Protocol", "Timestamp",
    "Flow ID", "Src IP", "Src Port", "Dst IP",
    "Bwd Blk Rate Avg", "Fwd Byts/b Avg", "Bwd Pkts/b Avg", "Fwd Blk Rate Avg",
    "Bwd PSH Flags", "Fwd Pkts/b Avg", "Bwd Byts/b Avg", "Bwd URG Flags",
    "Init Fwd Win Byts", "Init Bwd Win Byts",
]
DEFAULT_NONNEG = ["Fwd Header Len", "Flow Duration", "Flow IAT Min"]
DEFAULT_NONZERO = [
    "Tot Fwd Pkts", "Tot Bwd Pkts", "Pkt Len Min", "Pkt Len Max",
    "Pkt Len Mean", "Flow Byts/s", "Flow Pkts/s", "Fwd Header Len",
]
DEFAULT_NOT_NAN = ["Flow Byts/s", "Flow Pkts/s"]
DEFAULT_CRITICAL = ["Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "Flow Byts/s", "Flow Pkts/s"]


@dataclass(frozen=True)
class CleanSpec:
    drop: list = field(default_factory=lambda: list(DEFAULT_DROP))
    nonneg: list = field(default_factory=lambda: list(DEFAULT_NONNEG))
    nonzero: list = field(default_factory=lambda: list(DEFAULT_NONZERO))
    not_nan: list = field(default_factory=lambda: list(DEFAULT_NOT_NAN))
    critical: list = field(default_factory=lambda: list(DEFAULT_CRITICAL))
    drop_null_critical: bool = False  # inactive in the reference


def drop_columns(df: DataFrame, names=None) -> DataFrame:
    names = DEFAULT_DROP if names is None else names
    present = [n for n in names if n in df.columns]
    return df.drop(*present)


def try_cast_double(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        return df
    is_double = dict(df.dtypes)[name] == "double"
    return df.withColumn(name, tolerant_double_typed(col(name), is_double))


def filter_nonneg(df: DataFrame, name: str) -> DataFrame:
    """Keep NULL or ≥ 0 (NaN is kept: it orders above every number)."""
    if name not in df.columns:
        return df
    df = try_cast_double(df, name)
    return df.filter(F.coalesce(col(name) >= 0, F.lit(True)))


def filter_nonzero(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        return df
    df = try_cast_double(df, name)
    return df.filter(F.coalesce(col(name) != 0, F.lit(True)))


def filter_not_nan(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        return df
    df = try_cast_double(df, name)
    return df.filter(~F.isnan(col(name)))  # isnan of NULL is false


def drop_null_critical(df: DataFrame, names=None) -> DataFrame:
    keep = [n for n in (DEFAULT_CRITICAL if names is None else names) if n in df.columns]
    return df.na.drop(subset=keep) if keep else df


def repeated_header_filter(df: DataFrame, label: str = "Label") -> DataFrame:
    """Drop rows repeating the header; NULL labels go too (three-valued logic)."""
    if label not in df.columns:
        return df
    return df.filter(col(label) != F.lit(label))


def clean_pipeline(df: DataFrame, spec: CleanSpec | None = None) -> DataFrame:
    """Drop → non-negative → non-zero → not-NaN (→ optional NULL drop)."""
    spec = spec or CleanSpec()
    df = drop_columns(df, spec.drop)
    for c in spec.nonneg:
        df = filter_nonneg(df, c)
    for c in spec.nonzero:
        df = filter_nonzero(df, c)
    for c in spec.not_nan:
        df = filter_not_nan(df, c)
    if spec.drop_null_critical:
        df = drop_null_critical(df, spec.critical)
    return df


def clean_audit(df: DataFrame, spec: CleanSpec | None = None) -> DataFrame:
    """Row/column counts of the three reference stages in ONE scan.

    The reference runs three count() actions, each re-reading the input.
    Here every stage predicate is evaluated on the same rows and counted
    with ``count_if`` — a single aggregation with map-side partials.
    """
    spec = spec or CleanSpec()
    dropped = drop_columns(df, spec.drop)
    n_after_drop = len(dropped.columns)
    # Apply the pipeline's casts without its filters, remembering each
    # filter as a boolean column instead.
    cur = dropped
    keep_terms = []
    for i, c in enumerate(spec.nonneg):
        if c in cur.columns:
            cur = try_cast_double(cur, c)
            cur = cur.withColumn(f"__k{len(keep_terms)}", col(c).isNull() | (col(c) >= 0))
            keep_terms.append(f"__k{len(keep_terms)}")
    for c in spec.nonzero:
        if c in cur.columns:
            cur = try_cast_double(cur, c)
            cur = cur.withColumn(f"__k{len(keep_terms)}", col(c).isNull() | (col(c) != 0))
            keep_terms.append(f"__k{len(keep_terms)}")
    for c in spec.not_nan:
        if c in cur.columns:
            cur = try_cast_double(cur, c)
            cur = cur.withColumn(f"__k{len(keep_terms)}", col(c).isNull() | ~F.isnan(col(c)))
            keep_terms.append(f"__k{len(keep_terms)}")
    keep = F.lit(True)
    for k in keep_terms:
        keep = keep & F.col(k)
    agg = cur.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(keep).alias("n_clean"),
    )
    stages = F.array(
        F.struct(F.lit(1).alias("stage"), F.lit("initial").alias("stage_name"),
                 F.col("n_rows").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")),
        F.struct(F.lit(2).alias("stage"), F.lit("after_drop").alias("stage_name"),
                 F.col("n_rows").alias("n_rows"), F.lit(n_after_drop).alias("n_columns")),
        F.struct(F.lit(3).alias("stage"), F.lit("after_filters").alias("stage_name"),
                 F.col("n_clean").alias("n_rows"), F.lit(n_after_drop).alias("n_columns")),
    )
    return agg.select(F.inline(stages)).select(
        F.col("stage").cast("int").alias("stage"),
        F.col("stage_name"),
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("n_columns").cast("int").alias("n_columns"),
    )


def label_distribution(df: DataFrame, label: str = "Label", top: int | None = None) -> DataFrame:
    """Count per label, most frequent first; ``top`` limits what is displayed
    (the reference shows 50), by default every label is returned."""
    counts = (
        df.groupBy(col(label).alias(label))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(label))
    )
    return counts if top is None else counts.limit(top)
