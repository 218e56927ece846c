"""Ant colony optimisation (binary): pheromone table in, ants out,
pheromone update from a scored generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.rng import uniform
from ..masks import ensure_one_bit  # noqa: F401


@dataclass
class ACOParams:
    num_ants: int = 10
    iters: int = 10
    alpha: float = 1.0
    beta: float = 0.0
    rho: float = 0.2
    q: float = 1.0
    seed: int = 13
    max_evals: int = 300
    patience: int = 6
    p0: float | None = None     # inclusion probability of the strongest feature; None: k_max/n
    heuristic: bool = False     # eta from information gain instead of 1.0 (matters when beta is not 0)
    reference_start: bool = False  # the reference's rule: p0 = 1 and patience counted per ant


def init_pheromone(features: DataFrame, tau0: float = 1.0, eta: float = 1.0) -> DataFrame:
    return features.select("feature_idx", F.lit(float(tau0)).alias("tau"), F.lit(float(eta)).alias("eta"))


def information_gain(rows: DataFrame) -> DataFrame:
    """(feature_idx, eta): what knowing a feature's bin takes off the entropy of the label, in bits
    a row, rounded to 6 decimals.  ``rows`` has bins array<int> and label.

    One count by (feature, bin, label), merged map-side; what follows has at most features x bins x
    labels rows."""
    n = rows.select("label", F.posexplode("bins").alias("feature_idx", "bin")) \
        .groupBy("feature_idx", "bin", "label").agg(F.count("*").alias("n"))
    given = -F.col("n") * F.log2(F.col("n") / F.sum("n").over(Window.partitionBy("feature_idx", "bin")))
    per = n.withColumn("given", given).groupBy("feature_idx", "label").agg(
        F.sum("n").alias("n"), F.sum("given").alias("given"))
    alone = -F.col("n") * F.log2(F.col("n") / F.sum("n").over(Window.partitionBy("feature_idx")))
    return per.withColumn("alone", alone).groupBy("feature_idx").agg(
        (F.round((F.sum("alone") - F.sum("given")) / F.sum("n"), 6) + F.lit(0.0)).alias("eta"))


def heuristic_pheromone(features: DataFrame, gain: DataFrame, tau0: float = 1.0) -> DataFrame:
    """Starting pheromone with eta from ``gain``; 0.0 for a feature without rows."""
    return features.select("feature_idx").join(gain, "feature_idx", "left").select(
        "feature_idx", F.lit(float(tau0)).alias("tau"), F.coalesce("eta", F.lit(0.0)).alias("eta"))


def probabilities(pher: DataFrame, alpha: float, beta: float, p0: float = 1.0) -> DataFrame:
    """p = p0 · clip(τ^α·η^β, 1e-12) / max, clipped to [1e-6, 1 − 1e-6].
    The max is one aggregate over the feature table.  With p0 = 1 (the
    reference's rule) equal pheromones make every ant take every feature."""
    score = F.greatest(F.pow("tau", F.lit(alpha)) * F.pow("eta", F.lit(beta)), F.lit(1e-12))
    s = pher.withColumn("score", score)
    mx = s.agg(F.max("score").alias("m")).first()["m"]
    return s.select("feature_idx", F.least(F.greatest(F.lit(float(p0)) * (F.col("score") / F.lit(mx)), F.lit(1e-6)),
                                           F.lit(1 - 1e-6)).alias("p"))


def ants(spark, probs: DataFrame, n_ants: int, seed: int, gen: int) -> DataFrame:
    """(member=ant, mask): independent Bernoulli(p_j) bits.  The
    probability vector has one entry per feature (small) and is inlined."""
    pv = [r["p"] for r in probs.orderBy("feature_idx").collect()]
    parr = F.array(*[F.lit(float(v)) for v in pv])
    base = spark.range(n_ants).select(F.col("id").cast("int").alias("member"))
    keys = (F.lit(gen), F.col("member"))
    mask = F.transform(parr, lambda p, j: F.when(uniform(seed, "aco.ant", *keys, j) < p, 1).otherwise(0))
    return base.select("member", mask.alias("mask"))


def update(pher: DataFrame, scored_ants: DataFrame, best_mask: list, best_obj: float,
           rho: float, q: float) -> DataFrame:
    """τ ← clamp(τ(1−ρ) + Σ_{obj>0} q·obj·bit + [best>0] 0.5·q·best·bit_best,
    1e-6, 1e6).  The deposit is posexplode + groupBy(feature_idx)."""
    dep = (scored_ants.filter(F.col("obj") > 0)
           .select("obj", F.posexplode("mask").alias("feature_idx", "bit"))
           .groupBy("feature_idx").agg(F.sum(F.lit(q) * F.col("obj") * F.col("bit")).alias("dep")))
    bonus_w = 0.5 * q * best_obj if best_obj > 0 else 0.0
    bb = F.array(*[F.lit(int(b)) for b in best_mask])
    t = pher.join(dep, "feature_idx", "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
    new = F.col("tau") * F.lit(1.0 - rho) + F.col("dep") + F.lit(bonus_w) * bb[F.col("feature_idx")]
    return t.select("feature_idx", F.least(F.greatest(new, F.lit(1e-6)), F.lit(1e6)).alias("tau"), "eta")


def start_mask(spark, n: int, k_min: int, seed: int) -> DataFrame:
    """No warm mask: max(1, k_min) distinct random positions (one row)."""
    k = max(1, k_min)
    idx = spark.range(n).select(F.col("id").cast("int").alias("j"))
    top = idx.withColumn("u", uniform(seed, "aco.start", F.col("j")))
    chosen = top.orderBy("u", "j").limit(k).agg(F.collect_list("j").alias("js"))
    return chosen.select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                     lambda i: F.array_contains(F.col("js"), i).cast("int")).alias("mask"))
