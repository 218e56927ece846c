"""Flower pollination (binary): elites, Lévy-step global pollination,
local pollination, strict-improvement replacement, evaluation budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.numeric import saturating_sigmoid
from ...functions.rng import gauss, uniform
from .common import dense, other_index


@dataclass
class FPAParams:
    pop_size: int = 12
    iters: int = 12
    p_global: float = 0.8
    levy_beta: float = 1.5
    step_scale: float = 0.25
    seed: int = 13
    elitism: int = 1
    patience: int = 5
    max_evals: int | None = None
    init_k: int = 9


def levy_step(seed: int, beta: float, scale: float, *keys):
    """gauss / (|gauss|^(1/β) + 1e-12) · scale — one scalar per candidate."""
    u = gauss(seed, "fpa.levy.u", *keys)
    v = F.pow(F.abs(gauss(seed, "fpa.levy.v", *keys)), F.lit(1.0 / beta))
    return (u / (v + F.lit(1e-12))) * F.lit(scale)


def global_pollination(x, gbest, step, seed: int, *keys):
    """Flip bit i with p = |σ((g_i − x_i)·step) − ½|·2 (bits equal to
    gbest never flip)."""
    return F.transform(x, lambda b, i: F.when(
        uniform(seed, "fpa.flip", *keys, i)
        < F.abs(saturating_sigmoid((gbest[i] - b).cast("double") * step) - F.lit(0.5)) * F.lit(2.0),
        F.lit(1) - b).otherwise(b))


def local_pollination(a, b, seed: int, *keys):
    return F.transform(a, lambda ai, i: F.when(uniform(seed, "fpa.loc", *keys, i) < F.lit(0.5), ai)
                       .otherwise(b[i]))


def elites(pop: DataFrame, e: int) -> DataFrame:
    w = Window.orderBy(F.desc("obj"), F.asc("member"))
    return pop.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= e).drop("__r")


def init_masks(spark, n_members: int, n: int, k: int, seed: int, first_member: int = 0,
               members: DataFrame | None = None) -> DataFrame:
    """(member, mask) with exactly min(k, n) bits at hash-random positions
    (the reference's shuffle-and-take)."""
    kk = max(1, min(k, n))
    m = members.select("member") if members is not None else \
        spark.range(first_member, first_member + n_members).select(F.col("id").cast("int").alias("member"))
    us = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                     lambda j: F.struct(uniform(seed, "fpa.init", F.col("member"), j).alias("u"), j.alias("j")))
    chosen = F.transform(F.slice(F.array_sort(us), 1, kk), lambda s: s["j"])
    return m.select("member", F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                          lambda i: F.array_contains(chosen, i).cast("int")).alias("mask"))


def propose(pop: DataFrame, gbest: list, prm: FPAParams, gen: int, budget_left: int | None) -> DataFrame:
    """Offspring for slots e..P−1: (slot, parent member/obj, cand mask,
    is_copy).  Slots past the remaining budget copy member slot mod P."""
    spark = pop.sparkSession
    d = dense(pop)
    p = prm.pop_size
    slots = spark.range(prm.elitism, p).select(F.col("id").cast("int").alias("slot"))
    keys = (F.lit(gen), F.col("slot"))
    slots = slots.withColumn("parent", F.floor(uniform(prm.seed, "fpa.parent", *keys) * F.lit(p)).cast("int")) \
        .withColumn("glob", uniform(prm.seed, "fpa.glob", *keys) < F.lit(prm.p_global)) \
        .withColumn("a", F.floor(uniform(prm.seed, "fpa.a", *keys) * F.lit(p)).cast("int"))
    slots = slots.withColumn("b", other_index(F.col("a"), p, prm.seed, "fpa.b", *keys))
    if budget_left is not None:
        slots = slots.withColumn("is_copy", (F.col("slot") - F.lit(prm.elitism)) >= F.lit(budget_left))
        slots = slots.withColumn("parent", F.when(F.col("is_copy"), F.col("slot") % F.lit(p))
                                 .otherwise(F.col("parent")))
    else:
        slots = slots.withColumn("is_copy", F.lit(False))
    pm = d.select(F.col("idx").alias("parent"), F.col("member").alias("parent_member"),
                  F.col("mask").alias("x"), F.col("obj").alias("parent_obj"), F.col("k").alias("parent_k"))
    am = d.select(F.col("idx").alias("a"), F.col("mask").alias("ma"))
    bm = d.select(F.col("idx").alias("b"), F.col("mask").alias("mb"))
    j = slots.join(pm, "parent").join(am, "a").join(bm, "b")
    g = F.array(*[F.lit(int(v)) for v in gbest])
    step = levy_step(prm.seed, prm.levy_beta, prm.step_scale, *keys)
    cand = F.when(F.col("glob"), global_pollination(F.col("x"), g, step, prm.seed, *keys)) \
        .otherwise(local_pollination(F.col("ma"), F.col("mb"), prm.seed, *keys))
    return j.select("slot", "parent_member", "x", "parent_obj", "parent_k", "is_copy",
                    F.when(F.col("is_copy"), F.col("x")).otherwise(cand).alias("mask"))


def accept(elite: DataFrame, scored: DataFrame) -> DataFrame:
    """New generation: elites keep slots 0..e−1; offspring replace their
    parent only when strictly better."""
    better = (~F.col("is_copy")) & (F.col("obj") > F.col("parent_obj"))
    off = scored.select(F.col("slot").alias("member"),
                        F.when(better, F.col("mask")).otherwise(F.col("x")).alias("mask"),
                        F.when(better, F.col("obj")).otherwise(F.col("parent_obj")).alias("obj"),
                        F.when(better, F.col("k")).otherwise(F.col("parent_k")).alias("k"))
    w = Window.orderBy(F.desc("obj"), F.asc("member"))
    el = elite.withColumn("member", (F.row_number().over(w) - 1).cast("int")).select("member", "mask", "obj", "k")
    return el.unionByName(off)
