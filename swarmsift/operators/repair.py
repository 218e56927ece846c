"""Mask repair and feature ordering.

Orders (priority, importance rank) are over the feature list, which has
one row per column — small by construction — so an order is turned into a
literal permutation and repair is a row-local array expression: no
explode, no shuffle, whatever the population size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masks import mask_size

ABSENT_PRIORITY = 10_000


def resolve_names(names: list, features: list, suffix: str = "__binned") -> list:
    """Map a name to ``name + suffix`` when only the binned column exists
    (the reference's warm lists name columns that were replaced by their
    binned versions and so silently matched nothing)."""
    fs = set(features)
    return [n if n in fs or (n + suffix) not in fs else n + suffix for n in names]


def priority_table(spark, names: list) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "prio int, name string") \
        .select("name", "prio")


def priority_order(features: DataFrame, priority: DataFrame) -> DataFrame:
    """(feature_idx, name, prio, ord): listed names first in list order,
    then the rest by index.  The window spans the feature list only."""
    j = features.join(F.broadcast(priority), "name", "left")
    w = Window.orderBy(F.col("prio").isNull(), F.coalesce("prio", F.lit(ABSENT_PRIORITY)), "feature_idx")
    return j.select("feature_idx", "name", "prio", (F.row_number().over(w) - 1).cast("int").alias("ord"))


def warm_mask(features: DataFrame, priority: DataFrame) -> DataFrame:
    """One row: mask bit = feature named in the priority list."""
    j = features.join(F.broadcast(priority), "name", "left")
    bits = F.array_sort(F.collect_list(F.struct("feature_idx", F.col("prio").isNotNull().cast("int").alias("bit"))))
    return j.agg(F.transform(bits, lambda s: s["bit"]).alias("mask"))


def order_list(order_df: DataFrame) -> list:
    """Collect (feature_idx, ord) → python list ord[feature_idx] (N items)."""
    rows = order_df.select("feature_idx", "ord").collect()
    out = [0] * len(rows)
    for r in rows:
        out[r["feature_idx"]] = r["ord"]
    return out


def _ranks(mask: Column, ordv: list):
    n = len(ordv)
    o = F.array(*[F.lit(int(v)) for v in ordv])
    idx = F.sequence(F.lit(0), F.lit(n - 1))

    def rank_among(bit: int):
        return lambda i: F.size(F.filter(idx, lambda j: (mask[j] == bit) & (o[j] < o[i])))
    return idx, rank_among(1), rank_among(0)


def repair_expr(mask: Column, ordv: list, k_min: int, k_max: int) -> Column:
    """Over k_max → keep the best k_max by order; under max(1, k_min) → add
    unset features in order."""
    idx, one_rank, zero_rank = _ranks(mask, ordv)
    k = mask_size(mask)
    t_min = max(1, k_min)
    return (F.when(k > k_max, F.transform(idx, lambda i: ((mask[i] == 1) & (one_rank(i) < k_max)).cast("int")))
            .when(k < t_min, F.transform(idx, lambda i: ((mask[i] == 1) | (zero_rank(i) < (F.lit(t_min) - k)))
                                         .cast("int")))
            .otherwise(mask))


def repair_cap_expr(mask: Column, ordv: list, k_cap: int) -> Column:
    """Cap-only repair: empty → top k_cap by order; over cap → best k_cap."""
    idx, one_rank, zero_rank = _ranks(mask, ordv)
    k = mask_size(mask)
    return (F.when(k == 0, F.transform(idx, lambda i: (zero_rank(i) < k_cap).cast("int")))
            .when(k > k_cap, F.transform(idx, lambda i: ((mask[i] == 1) & (one_rank(i) < k_cap)).cast("int")))
            .otherwise(mask))


def repair_by_priority(pop: DataFrame, ordv: list, k_min: int, k_max: int, mask: str = "mask") -> DataFrame:
    return pop.withColumn(mask, repair_expr(F.col(mask), ordv, k_min, k_max))


def repair_by_importance(pop: DataFrame, rank_ordv: list, k_cap: int = 9, mask: str = "mask") -> DataFrame:
    return pop.withColumn(mask, repair_cap_expr(F.col(mask), rank_ordv, k_cap))


def importance_rank(imp: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_idx, name, importance, rank): 1-based, importance desc,
    ties by index (a stable sort); features without importance get 0."""
    j = features.join(imp.select("feature_idx", "importance"), "feature_idx", "left") \
        .withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    w = Window.orderBy(F.desc("importance"), "feature_idx")
    return j.select("feature_idx", "name", "importance", F.row_number().over(w).cast("int").alias("rank"))


def importance_topk(ranked: DataFrame, k: int = 20) -> DataFrame:
    """Top-k lines ``name: 0.123456`` (the reference's text report)."""
    return ranked.filter(F.col("rank") <= k).select(
        "rank", F.format_string("%s: %.6f", F.col("name"), F.col("importance")).alias("line"))


def best_member(pop: DataFrame, obj: str = "obj", member: str = "member") -> DataFrame:
    """Arg-max member, first (lowest id) wins ties — one aggregation."""
    cols = [c for c in pop.columns]
    packed = F.struct(F.col(obj).alias("__o"), (-F.col(member)).alias("__m"),
                      *[F.col(c) for c in cols])
    return pop.agg(F.max(packed).alias("b")).select(*[F.col("b")[c].alias(c) for c in cols])
