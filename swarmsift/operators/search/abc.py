"""Artificial bee colony (binary), synchronous generations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.rng import uniform
from ...session import cut_lineage
from ..masks import ensure_one_bit, greedy_accept, mask_size
from .common import dense, neighbour, other_index, running_sum


@dataclass
class ABCParams:
    num_bees: int = 20
    max_iters: int = 50
    limit: int = 10
    lam: float = 0.01
    seed: int = 13
    init_p: float = 0.3
    scout_p: float = 0.2


def neighbours(pop: DataFrame, n: int, seed: int, gen: int) -> DataFrame:
    """Employed bees: each bee i moves toward a random other bee k.
    Output (member, mask=candidate, parent_mask, parent_obj, parent_k, trials)."""
    p = pop.count() if "idx" not in pop.columns else None
    d = dense(pop) if "idx" not in pop.columns else pop
    p = p or d.count()
    keys = (F.lit(gen), F.lit("emp"), F.col("idx"))
    me = d.withColumn("partner", other_index(F.col("idx"), p, seed, "abc.emp.k", *keys))
    partner = d.select(F.col("idx").alias("partner"), F.col("mask").alias("pmask"))
    j = me.join(partner, "partner")
    return j.select("member", "idx",
                    neighbour(F.col("mask"), F.col("pmask"), n, seed, "abc.nb", *keys).alias("cand"),
                    "mask", "obj", "k", "trials")


def employed_accept(scored: DataFrame) -> DataFrame:
    """scored: (member, idx, cand, cand_obj, cand_k, mask, obj, k, trials)."""
    acc = greedy_accept(F.col("cand_obj"), F.col("obj"), F.col("cand_k"), F.col("k"))
    return scored.select(
        "member", "idx",
        F.when(acc, F.col("cand")).otherwise(F.col("mask")).alias("mask"),
        F.when(acc, F.col("cand_obj")).otherwise(F.col("obj")).alias("obj"),
        F.when(acc, F.col("cand_k")).otherwise(F.col("k")).alias("k"),
        F.when(acc, F.lit(0)).otherwise(F.col("trials") + 1).alias("trials"))


def roulette(pop: DataFrame, n_onlookers: int, seed: int, gen: int) -> DataFrame:
    """(onlooker, idx): fitness-proportional choice with probabilities
    (f − min + 1e-9)/Σ frozen at phase start; first cumulative ≥ r wins,
    fallback 0.  Intervals and draws meet by an equi-join on cells of the unit
    interval, as many as there are bees, so each cell holds few intervals."""
    d = dense(pop) if "idx" not in pop.columns else pop
    stats = d.agg(F.min("obj").alias("mn"), F.count(F.lit(1)).alias("p"))
    s = stats.first()
    shifted = F.col("obj") - F.lit(s["mn"]) + F.lit(1e-9)
    total = d.agg(F.sum(shifted).alias("t")).first()["t"]
    prob = F.lit(1.0 / s["p"]) if total == 0 else shifted / F.lit(total)
    probs = d.select("idx", prob.alias("prob"))
    cum = cut_lineage(running_sum(probs, "prob", "hi"), "roulette")
    # An interval begins where the one before ends, so that no draw falls between two.
    cum = cum.join(cum.select((F.col("idx") + 1).alias("idx"), F.col("hi").alias("lo")), "idx", "left") \
        .withColumn("lo", F.coalesce("lo", F.lit(0.0)))
    cells = int(s["p"])
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells))
    cum = cum.select("idx", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    spark = pop.sparkSession
    ons = spark.range(n_onlookers).select(F.col("id").cast("int").alias("onlooker"))
    ons = ons.withColumn("r", uniform(seed, "abc.onl.r", F.lit(gen), F.col("onlooker")))
    hit = ons.withColumn("cell", cell(F.col("r"))) \
        .join(cum, "cell", "left") \
        .withColumn("idx", F.when((F.col("r") > F.col("lo")) & (F.col("r") <= F.col("hi")), F.col("idx"))) \
        .groupBy("onlooker", "r").agg(F.min("idx").alias("idx"))
    return hit.select("onlooker", "r", F.coalesce("idx", F.lit(0)).alias("idx"))


def onlooker_candidates(pop: DataFrame, picks: DataFrame, n: int, seed: int, gen: int) -> DataFrame:
    d = dense(pop) if "idx" not in pop.columns else pop
    p = d.count()
    keys = (F.lit(gen), F.lit("onl"), F.col("onlooker"))
    j = picks.join(d.select("idx", "member", "mask"), "idx")
    j = j.withColumn("partner", other_index(F.col("idx"), p, seed, "abc.onl.k", *keys))
    partner = d.select(F.col("idx").alias("partner"), F.col("mask").alias("pmask"))
    j = j.join(partner, "partner")
    return j.select("onlooker", "idx", "member",
                    neighbour(F.col("mask"), F.col("pmask"), n, seed, "abc.nb", *keys).alias("cand"))


def onlooker_accept(pop: DataFrame, scored: DataFrame) -> DataFrame:
    """scored: (onlooker, idx, cand, cand_obj, cand_k).  Several onlookers
    on one bee: the best candidate (obj desc, fewer bits, lowest onlooker)
    is tried; trials reset on acceptance, else += number of onlookers."""
    W = Window
    w = W.partitionBy("idx").orderBy(F.desc("cand_obj"), F.asc("cand_k"), F.asc("onlooker"))
    best = (scored.withColumn("rk", F.row_number().over(w))
            .withColumn("hits", F.count(F.lit(1)).over(W.partitionBy("idx")))
            .filter("rk = 1").select("idx", "cand", "cand_obj", "cand_k", "hits"))
    j = pop.join(best, "idx", "left")
    acc = F.col("cand").isNotNull() & greedy_accept(F.col("cand_obj"), F.col("obj"), F.col("cand_k"), F.col("k"))
    return j.select(
        "member", "idx",
        F.when(acc, F.col("cand")).otherwise(F.col("mask")).alias("mask"),
        F.when(acc, F.col("cand_obj")).otherwise(F.col("obj")).alias("obj"),
        F.when(acc, F.col("cand_k")).otherwise(F.col("k")).alias("k"),
        F.when(acc, F.lit(0)).otherwise(F.col("trials") + F.coalesce("hits", F.lit(0))).alias("trials"))


def scouts(pop: DataFrame, n: int, limit: int, p: float, seed: int, gen: int) -> DataFrame:
    """Bees with trials ≥ limit get a fresh Bernoulli(p) mask (to be
    re-scored unconditionally); ``scout`` marks them."""
    keys = (F.lit(gen), F.col("member"))
    fresh = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                        lambda j: F.when(uniform(seed, "abc.scout", *keys, j) < F.lit(p), 1).otherwise(0))
    fresh = ensure_one_bit(fresh, n, seed, "abc.scout", *keys)
    is_scout = F.col("trials") >= F.lit(limit)
    return pop.withColumn("scout", is_scout) \
        .withColumn("mask", F.when(is_scout, fresh).otherwise(F.col("mask"))) \
        .withColumn("trials", F.when(is_scout, F.lit(0)).otherwise(F.col("trials")))
