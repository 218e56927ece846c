"""Mask (feature-subset) operators on population tables.

A population is a DataFrame ``(member int, mask array<int>, …)``; masks
index the ordered feature list.  All randomness is hash-uniform keyed by
(seed, tag, generation, member, position), so a step's output does not
depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform


def mask_size(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, b: a + b)


def ensure_one_bit(mask: Column, n: int, seed: int, tag: str, *keys) -> Column:
    """Empty mask → set bit ⌊u·n⌋ (the reference's ``randrange(n)``)."""
    j = F.floor(uniform(seed, tag + ".fix", *keys) * F.lit(n)).cast("int")
    return F.when(mask_size(mask) == 0,
                  F.transform(mask, lambda b, i: F.when(i == j, F.lit(1)).otherwise(b))).otherwise(mask)


def random_masks(spark: SparkSession, n_members: int, n_features: int, p: float, seed: int,
                 tag: str = "init", gen: int = 0) -> DataFrame:
    """(member, mask): Bernoulli(p) bits, at least one bit set."""
    members = spark.range(n_members).select(F.col("id").cast("int").alias("member"))
    keys = (F.lit(gen), F.col("member"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)),
                       lambda j: F.when(uniform(seed, tag, *keys, j) < F.lit(p), 1).otherwise(0))
    return members.select("member", ensure_one_bit(bits, n_features, seed, tag, *keys).alias("mask"))


def random_masks_over(members: DataFrame, n_features: int, p: float, seed: int,
                      tag: str = "init", gen: int = 0) -> DataFrame:
    """One Bernoulli(p) mask per row of ``members`` (column ``member``)."""
    keys = (F.lit(gen), F.col("member"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)),
                       lambda j: F.when(uniform(seed, tag, *keys, j) < F.lit(p), 1).otherwise(0))
    return members.select("member", ensure_one_bit(bits, n_features, seed, tag, *keys).alias("mask"))


def selected_features(pop: DataFrame, features: DataFrame) -> DataFrame:
    """(member, feature_idx, name) for every set bit: posexplode ⋈ features
    (the feature table is one row per column — broadcast)."""
    bits = pop.select("member", F.posexplode("mask").alias("feature_idx", "bit")).filter("bit = 1")
    return bits.join(F.broadcast(features), "feature_idx").select("member", "feature_idx", "name")


def penalised_objective(f1: Column, k: Column, n_features: int, lam: float) -> Column:
    """F1 − λ·k/N; an empty subset scores −1."""
    return F.when(k == 0, F.lit(-1.0)).otherwise(f1 - F.lit(lam) * k / F.lit(float(n_features)))


def hardcap_objective(f1: Column, k: Column, lam: float = 0.03, k_cap: int = 9,
                      big_penalty: float = 0.10) -> Column:
    """f1 − λ·k − 0.10·max(0, k − cap) (the PSO run's objective)."""
    return f1 - F.lit(lam) * k - F.lit(big_penalty) * F.greatest(k - F.lit(k_cap), F.lit(0))


def greedy_accept(new_obj: Column, old_obj: Column, new_k: Column, old_k: Column) -> Column:
    """Better, or equal within 1e-12 with fewer bits."""
    return (new_obj > old_obj) | ((F.abs(new_obj - old_obj) < F.lit(1e-12)) & (new_k < old_k))


def mask_key(mask):
    """The bits of a mask packed into longs, 62 a long: a join key of a fraction of its size."""
    starts = F.when(F.size(mask) > 0, F.sequence(F.lit(1), F.size(mask), F.lit(62))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.aggregate(
        F.slice(mask, at, 62), F.lit(0).cast("bigint"), lambda key, bit: key * F.lit(2).cast("bigint") + bit))
