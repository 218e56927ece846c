"""Label binarization, reproducible splits and samples, balance reports.

Randomness is the hash-uniform of the row key, so a row lands in the same
split whatever the partitioning or executor count (``F.rand`` does not
have that property).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..functions.rng import uniform


def binarize_target(df: DataFrame, label: str = "Label", positive: str = "Benign",
                    negative: str = "Attack", target: str = "Target") -> DataFrame:
    """``positive`` stays, anything else (NULL included) becomes ``negative``."""
    return df.withColumn(
        target, F.when(col(label) == F.lit(positive), F.lit(positive)).otherwise(F.lit(negative))
    )


def split_flag(df: DataFrame, keys: list, seed: int = 13, train_frac: float = 0.8,
               flag: str = "is_train") -> DataFrame:
    return df.withColumn(flag, uniform(seed, "split", *[col(k) for k in keys]) < F.lit(train_frac))


def split_train_test(df: DataFrame, keys: list, seed: int = 13, train_frac: float = 0.8):
    """(train, test) with one fixed threshold, as the reference does."""
    flagged = split_flag(df, keys, seed, train_frac, "__is_train")
    train = flagged.filter(F.col("__is_train")).drop("__is_train")
    test = flagged.filter(~F.col("__is_train")).drop("__is_train")
    return train, test


def bernoulli_sample(df: DataFrame, keys: list, fraction: float, seed: int = 13,
                     tag: str = "sample") -> DataFrame:
    """Sample without replacement; row membership is a function of its key."""
    return df.filter(uniform(seed, tag, *[col(k) for k in keys]) < F.lit(fraction))


def split_balance(flagged: DataFrame, label: str, flag: str = "is_train") -> DataFrame:
    """Per-label train/test counts in ONE aggregation.

    Same rows as the full outer join of the two per-split counts (a label
    absent from one side gets NULL there), but one scan and one shuffle
    instead of two scans, two aggregations and a join.
    """
    return (
        flagged.groupBy(col(label).alias(label))
        .agg(F.count_if(F.col(flag)).alias("train_count"),
             F.count_if(~F.col(flag)).alias("test_count"))
        .select(label,
                F.nullif(F.col("train_count"), F.lit(0)).alias("train_count"),
                F.nullif(F.col("test_count"), F.lit(0)).alias("test_count"))
        .orderBy(F.desc_nulls_last("train_count"))
    )


def split_balance_join(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """The reference's form: counts per split, full outer join on the label.

    Both inputs are aggregated first, so the join sees one row per label per
    side — the planner broadcasts or co-partitions them cheaply.
    """
    a = train.groupBy(col(label).alias(label)).agg(F.count(F.lit(1)).alias("train_count"))
    b = test.groupBy(col(label).alias(label)).agg(F.count(F.lit(1)).alias("test_count"))
    return a.join(b, on=label, how="full_outer").orderBy(F.desc_nulls_last("train_count"))


def feature_table(df: DataFrame, exclude=("Label", "Target")) -> DataFrame:
    """Ordered feature list (feature_idx, name, n_values): the position in the
    schema is the feature's identity — masks index into it — and n_values its
    number of non-NULL values, counted in one scan."""
    names = [c for c in df.columns if c not in set(exclude)]
    counts = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("feature_idx"), F.lit(c).alias("name"), F.col(f"n{i}").alias("n_values"))
        for i, c in enumerate(names)])))
