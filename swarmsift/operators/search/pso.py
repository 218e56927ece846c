"""Binary particle swarm: velocity, sigmoid binarisation, bests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.numeric import sigmoid
from ...functions.rng import uniform
from ..masks import ensure_one_bit, greedy_accept


@dataclass
class PSOParams:
    swarm_size: int = 20
    iters: int = 50
    w: float = 0.7
    c1: float = 1.5
    c2: float = 1.5
    vmax: float = 4.0
    seed: int = 13
    restarts: int = 1
    greedy: bool = False          # True: the reference's move-only-if-better rule


def start(spark, n_particles: int, n: int, seed: int, restart: int = 0, p: float = 0.3,
          members: DataFrame | None = None) -> DataFrame:
    """(member, mask, vel): Bernoulli(p) masks (≥ 1 bit), velocities U(−1, 1)."""
    m = members.select("member") if members is not None else \
        spark.range(n_particles).select(F.col("id").cast("int").alias("member"))
    keys = (F.lit(restart), F.col("member"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda j: F.when(uniform(seed, "pso.init", *keys, j) < F.lit(p), 1).otherwise(0))
    vel = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                      lambda j: uniform(seed, "pso.vel", *keys, j) * F.lit(2.0) - F.lit(1.0))
    return m.select(F.lit(restart).alias("restart"), "member",
                    ensure_one_bit(bits, n, seed, "pso.init", *keys).alias("mask"), vel.alias("vel"))


def velocity(sw: DataFrame, gbest_col, prm: PSOParams, gen: int):
    """clip(w·v + c1·r1·(pbest − x) + c2·r2·(gbest − x), ±vmax), fresh
    r1, r2 per dimension; gbest is an array column (per restart)."""
    keys = (F.col("restart"), F.lit(gen), F.col("member"))
    return F.transform(F.col("vel"), lambda v, d: F.least(F.greatest(
        F.lit(prm.w) * v
        + F.lit(prm.c1) * uniform(prm.seed, "pso.r1", *keys, d) * (F.col("pbest")[d] - F.col("mask")[d])
        + F.lit(prm.c2) * uniform(prm.seed, "pso.r2", *keys, d) * (gbest_col[d] - F.col("mask")[d]),
        F.lit(-prm.vmax)), F.lit(prm.vmax)))


def binarize(vel_col, n: int, prm: PSOParams, gen: int):
    keys = (F.col("restart"), F.lit(gen), F.col("member"))
    bits = F.transform(vel_col, lambda v, d: F.when(uniform(prm.seed, "pso.bit", *keys, d) < sigmoid(v), 1)
                       .otherwise(0))
    return ensure_one_bit(bits, n, prm.seed, "pso.bit", *keys)


def step(sw: DataFrame, gbest: DataFrame, n: int, prm: PSOParams, gen: int) -> DataFrame:
    """Move every particle (velocity → binarize).  ``gbest`` is
    (restart, gbest array) — one row per restart, broadcast."""
    j = sw.join(F.broadcast(gbest.select("restart", "gbest")), "restart")
    j = j.withColumn("vel", velocity(j, F.col("gbest"), prm, gen))
    return j.withColumn("cand", binarize(F.col("vel"), n, prm, gen)).drop("gbest")


def accept(scored: DataFrame, greedy: bool) -> DataFrame:
    """scored: (…, mask, obj, k, cand, cand_obj, cand_k, pbest, pbest_obj,
    pbest_k, vel).  Standard: always move, pbest by the G1 rule.  Greedy
    (reference): move only when G1 accepts; pbest follows the move."""
    acc = greedy_accept(F.col("cand_obj"), F.col("obj"), F.col("cand_k"), F.col("k"))
    pb = greedy_accept(F.col("cand_obj"), F.col("pbest_obj"), F.col("cand_k"), F.col("pbest_k"))
    move = acc if greedy else F.lit(True)
    upd_pb = (acc & pb) if greedy else pb
    return scored.select(
        "restart", "member", "vel",
        F.when(move, F.col("cand")).otherwise(F.col("mask")).alias("mask"),
        F.when(move, F.col("cand_obj")).otherwise(F.col("obj")).alias("obj"),
        F.when(move, F.col("cand_k")).otherwise(F.col("k")).alias("k"),
        F.when(upd_pb, F.col("cand")).otherwise(F.col("pbest")).alias("pbest"),
        F.when(upd_pb, F.col("cand_obj")).otherwise(F.col("pbest_obj")).alias("pbest_obj"),
        F.when(upd_pb, F.col("cand_k")).otherwise(F.col("pbest_k")).alias("pbest_k"))


def gbest_of(sw: DataFrame) -> DataFrame:
    """Per restart: best pbest by obj, then fewer bits, then member."""
    packed = F.struct(F.col("pbest_obj").alias("o"), (-F.col("pbest_k")).alias("nk"),
                      (-F.col("member")).alias("nm"), F.col("pbest").alias("m"), F.col("pbest_k").alias("k"))
    return sw.groupBy("restart").agg(F.max(packed).alias("b")).select(
        "restart", F.col("b.m").alias("gbest"), F.col("b.o").alias("gbest_obj"), F.col("b.k").alias("gbest_k"))
