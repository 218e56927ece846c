"""Registered keys: masks, repair, objectives and search steps over the
population fixture (one member per embeddings row, 64 features), and full
searches on the documents fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators import masks as M
from ..operators import repair as R
from ..operators.search import abc as ABC
from ..operators.search import aco as ACO
from ..operators.search import fpa as FPA
from ..operators.search import pso as PSO
from ..operators.search.common import dense, pseudo_scorer
from ..sources import fixtures as X
from .registry import register

N = 64
# Fixed warm-start list for the 64-feature fixture (parameter, like the
# reference's named warm lists).
E_PRIORITY = ["f07", "f21", "f03", "f42", "f15", "f58", "f33", "f11", "f49"]
SEED = 13
GEN = 1


def p_pop(spark, sf):
    """(member, mask, obj, k, trials) from embeddings."""
    return X.population(spark, sf).withColumn("k", M.mask_size(F.col("mask")))


def e_features(spark, sf):
    """(feature_idx, name) of every dimension that occurs in the table."""
    emb = X.read(spark, sf, "embeddings")
    return emb.select(F.posexplode("embedding").alias("feature_idx", "v")).select("feature_idx").distinct() \
        .select("feature_idx", F.format_string("f%02d", "feature_idx").alias("name"))


def e_order(spark, sf):
    return R.order_list(R.priority_order(e_features(spark, sf), R.priority_table(spark, E_PRIORITY)))


def e_rank_order(spark, sf):
    """Importance proxy derived from the table: mean |component| per
    dimension, ranked descending (ties by index)."""
    emb = X.read(spark, sf, "embeddings")
    imp = emb.select(F.posexplode("embedding").alias("feature_idx", "v")).groupBy("feature_idx") \
        .agg(F.avg(F.abs("v")).alias("importance"))
    ranked = R.importance_rank(imp, e_features(spark, sf))
    return ranked, [r["rank"] - 1 for r in ranked.orderBy("feature_idx").collect()]


@register("random_masks")
def q_random_masks(spark, sf):
    members = X.read(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("member"))
    return M.random_masks_over(members, N, 0.3, SEED, "init")


@register("selected_features")
def q_selected_features(spark, sf):
    return M.selected_features(p_pop(spark, sf), e_features(spark, sf))


@register("penalised_objective")
def q_penalised_objective(spark, sf):
    p = p_pop(spark, sf)
    return p.select("member", "k", M.penalised_objective(F.col("obj"), F.col("k"), N, 0.01).alias("objective"))


@register("hardcap_objective")
def q_hardcap_objective(spark, sf):
    p = p_pop(spark, sf)
    return p.select("member", "k", M.hardcap_objective(F.col("obj"), F.col("k")).alias("objective"))


@register("priority_order")
def q_priority_order(spark, sf):
    return R.priority_order(e_features(spark, sf), R.priority_table(spark, E_PRIORITY))


@register("warm_mask")
def q_warm_mask(spark, sf):
    return R.warm_mask(e_features(spark, sf), R.priority_table(spark, E_PRIORITY))


@register("repair_by_priority")
def q_repair_by_priority(spark, sf):
    p = p_pop(spark, sf).select("member", "mask")
    return R.repair_by_priority(p, e_order(spark, sf), 5, 9)


@register("repair_by_importance")
def q_repair_by_importance(spark, sf):
    p = p_pop(spark, sf).select("member", "mask")
    _, ordv = e_rank_order(spark, sf)
    return R.repair_by_importance(p, ordv, 9)


@register("best_member")
def q_best_member(spark, sf):
    return R.best_member(p_pop(spark, sf).select("member", "mask", "obj", "k"))


@register("greedy_accept")
def q_greedy_accept(spark, sf):
    p = p_pop(spark, sf)
    new_obj = F.round(uniform(SEED, "p.new", F.col("member")), 6)
    new_k = F.lit(N) - F.col("k")
    return p.select("member", M.greedy_accept(new_obj, F.col("obj"), new_k, F.col("k")).alias("accept"))


# ------------------------------------------------------------------ ABC

def p_dense(spark, sf):
    return dense(p_pop(spark, sf))


@register("abc_neighbors")
def q_abc_neighbors(spark, sf):
    return ABC.neighbours(p_dense(spark, sf), N, SEED, GEN).select("member", "cand")


def _abc_employed(spark, sf):
    nb = ABC.neighbours(p_dense(spark, sf), N, SEED, GEN)
    sc = pseudo_scorer(SEED, "abc.emp.obj", GEN)(nb.select("member", F.col("cand").alias("mask")))
    sc = sc.select("member", F.col("obj").alias("cand_obj"), F.col("k").alias("cand_k"))
    return ABC.employed_accept(nb.join(sc, "member"))


@register("abc_employed")
def q_abc_employed(spark, sf):
    return _abc_employed(spark, sf)


@register("abc_roulette")
def q_abc_roulette(spark, sf):
    pop = p_dense(spark, sf)
    return ABC.roulette(pop, pop.count(), SEED, GEN).select("onlooker", "idx")


@register("abc_onlooker")
def q_abc_onlooker(spark, sf):
    pop = p_dense(spark, sf)
    picks = ABC.roulette(pop, pop.count(), SEED, GEN)
    oc = ABC.onlooker_candidates(pop, picks, N, SEED, GEN)
    sc = pseudo_scorer(SEED, "abc.onl.obj", GEN)(oc.select(F.col("onlooker").alias("member"),
                                                           F.col("cand").alias("mask")))
    sc = sc.select(F.col("member").alias("onlooker"), F.col("obj").alias("cand_obj"), F.col("k").alias("cand_k"))
    return ABC.onlooker_accept(pop, oc.join(sc, "onlooker"))


@register("abc_scouts")
def q_abc_scouts(spark, sf):
    return ABC.scouts(p_pop(spark, sf), N, 5, 0.2, SEED, GEN).select("member", "mask", "trials", "scout")


# ------------------------------------------------------------------ ACO

def p_pheromone(spark, sf):
    """τ_j = 1 + Σ obj·bit_j over the fixture population (table-derived)."""
    p = p_pop(spark, sf)
    return (p.select("obj", F.posexplode("mask").alias("feature_idx", "bit"))
            .groupBy("feature_idx").agg((F.lit(1.0) + F.sum(F.col("obj") * F.col("bit"))).alias("tau"))
            .withColumn("eta", F.lit(1.0)))


@register("aco_probabilities")
def q_aco_probabilities(spark, sf):
    return ACO.probabilities(p_pheromone(spark, sf), 1.0, 0.0)


@register("aco_ants")
def q_aco_ants(spark, sf):
    return ACO.ants(spark, ACO.probabilities(p_pheromone(spark, sf), 1.0, 0.0), 10, SEED, GEN)


@register("aco_update")
def q_aco_update(spark, sf):
    p = p_pop(spark, sf)
    b = R.best_member(p.select("member", "mask", "obj", "k")).first()
    return ACO.update(p_pheromone(spark, sf), p, list(b["mask"]), float(b["obj"]), 0.25, 1.0)


@register("aco_start")
def q_aco_start(spark, sf):
    n = e_features(spark, sf).count()
    start = ACO.start_mask(spark, n, 5, SEED).select(F.lit(0).alias("member"), "mask")
    return R.repair_by_priority(start, e_order(spark, sf), 5, 10)


# ------------------------------------------------------------------ FPA

FPA_PRM = FPA.FPAParams(pop_size=10, iters=10, patience=4, max_evals=400)


@register("fpa_levy")
def q_fpa_levy(spark, sf):
    p = p_pop(spark, sf)
    return p.select("member", FPA.levy_step(SEED, 1.5, 0.25, F.lit(GEN), F.col("member")).alias("step"))


def _gbest(spark, sf):
    return list(R.best_member(p_pop(spark, sf).select("member", "mask", "obj", "k")).first()["mask"])


@register("fpa_global")
def q_fpa_global(spark, sf):
    p = p_pop(spark, sf)
    g = F.array(*[F.lit(int(v)) for v in _gbest(spark, sf)])
    keys = (F.lit(GEN), F.col("member"))
    step = FPA.levy_step(SEED, 1.5, 0.25, *keys)
    return p.select("member", FPA.global_pollination(F.col("mask"), g, step, SEED, *keys).alias("cand"))


@register("fpa_local")
def q_fpa_local(spark, sf):
    d = p_dense(spark, sf)
    n_pop = d.count()
    other = d.select(((F.col("idx") + 1) % F.lit(n_pop)).alias("idx"), F.col("mask").alias("mb"))
    j = d.join(other, "idx")
    keys = (F.lit(GEN), F.col("member"))
    return j.select("member", FPA.local_pollination(F.col("mask"), F.col("mb"), SEED, *keys).alias("cand"))


@register("fpa_elites")
def q_fpa_elites(spark, sf):
    return FPA.elites(p_pop(spark, sf).select("member", "mask", "obj", "k"), 3)


@register("fpa_start")
def q_fpa_start(spark, sf):
    m = FPA.init_masks(spark, 0, N, 9, SEED, members=p_pop(spark, sf))
    return R.repair_by_priority(m, e_order(spark, sf), 5, 9)


def _fpa_generation(spark, sf, budget):
    pop = p_pop(spark, sf).select("member", "mask", "obj", "k")
    n_pop = pop.count()
    prm = FPA.FPAParams(pop_size=n_pop, elitism=1)
    off = FPA.propose(pop, _gbest(spark, sf), prm, GEN, budget(n_pop))
    off = off.withColumn("mask", R.repair_expr(F.col("mask"), e_order(spark, sf), 5, 9))
    sc = pseudo_scorer(SEED, "fpa.obj", GEN)(off.select(F.col("slot").alias("member"), "mask"))
    scored = off.join(sc.select(F.col("member").alias("slot"), "obj", "k"), "slot")
    return FPA.accept(FPA.elites(pop, 1), scored)


@register("fpa_generation")
def q_fpa_generation(spark, sf):
    return _fpa_generation(spark, sf, lambda n: None)


@register("fpa_generation_budget")
def q_fpa_generation_budget(spark, sf):
    """A generation whose budget ends half way: the slots past it copy members."""
    return _fpa_generation(spark, sf, lambda n: n // 2)


# ------------------------------------------------------------------ PSO

PSO_PRM = PSO.PSOParams(swarm_size=3, iters=6, w=0.7, c1=1.4, c2=1.4, vmax=4.0, seed=SEED, restarts=6)


def p_swarm(spark, sf):
    """Particles at hashed positions with hashed scores; their bests are the fixture's members, elsewhere."""
    best = p_pop(spark, sf).select("member", F.col("mask").alias("pbest"), F.col("obj").alias("pbest_obj"),
                                   F.col("k").alias("pbest_k"))
    s = PSO.start(spark, 0, N, SEED, 0, members=best)
    return s.join(best, "member").withColumn("obj", F.round(uniform(SEED, "pso.pos", F.col("member")), 6)) \
        .withColumn("k", M.mask_size(F.col("mask")))


@register("pso_start")
def q_pso_start(spark, sf):
    return PSO.start(spark, 0, N, SEED, 0, members=p_pop(spark, sf))


def _pso_gbest(sw):
    return PSO.gbest_of(sw)


@register("pso_velocity")
def q_pso_velocity(spark, sf):
    sw = p_swarm(spark, sf)
    j = sw.join(F.broadcast(_pso_gbest(sw).select("restart", "gbest")), "restart")
    return j.select("member", PSO.velocity(j, F.col("gbest"), PSO_PRM, GEN).alias("vel"))


@register("pso_binarize")
def q_pso_binarize(spark, sf):
    sw = p_swarm(spark, sf)
    moved = PSO.step(sw, _pso_gbest(sw), N, PSO_PRM, GEN)
    return moved.select("member", "cand")


def _pso_update(spark, sf, greedy):
    sw = p_swarm(spark, sf)
    moved = PSO.step(sw, _pso_gbest(sw), N, PSO_PRM, GEN)
    sc = pseudo_scorer(SEED, "pso.obj", GEN)(moved.select("member", F.col("cand").alias("mask")))
    sc = sc.select("member", F.col("obj").alias("cand_obj"), F.col("k").alias("cand_k"))
    return PSO.accept(moved.join(sc, "member"), greedy=greedy).select(
        "member", "mask", "obj", "k", "pbest", "pbest_obj", "pbest_k")


@register("pso_best_update")
def q_pso_best_update(spark, sf):
    return _pso_update(spark, sf, greedy=False)


@register("pso_greedy_update")
def q_pso_greedy_update(spark, sf):
    """The move-only-if-better rule."""
    return _pso_update(spark, sf, greedy=True)


# ------------------------------------------------------------------ full runs on documents

from . import runs  # noqa: E402,F401


@register("selected_features_text")
def q_selected_features_text(spark, sf):
    """The best member's selected feature names written as a text file
    (one per line) and read back."""
    from ..session import scratch_path
    from ..sources import reports as RP
    best = R.best_member(p_pop(spark, sf).select("member", "mask", "obj", "k"))
    names = M.selected_features(best, e_features(spark, sf))
    path = scratch_path(spark, "selected_features")
    RP.write_selected_features(names, path)
    return spark.read.text(path).select(F.col("value").alias("name"))
