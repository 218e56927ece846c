"""End-to-end subset searches (ABC, ACO, FPA, PSO) and the final retrain.

Each generation is: propose all candidates → score them together (memoised by mask) →
accept → take the population (members × feature bits) to the driver, so the loop
survives executor loss and lineage stays one generation deep.  With ``resume`` (a folder on
shared storage) generations and scored masks are kept there, and a search goes on after the
last complete generation it finds.
"""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import fitness as FT
from ..operators import growth as G
from ..operators import masks as M
from ..operators import repair as R
from ..operators import tree as TR
from ..operators.search import abc as ABC
from ..operators.search import aco as ACO
from ..operators.search import fpa as FPA
from ..operators.search import pso as PSO
from ..operators.search.common import dense
from ..session import cut_lineage, local_rows, local_table
from .state import Generations, ScoreTable


EVALUATORS = ("tree", "mllib", "entropy")


class Scorer:
    """Memoised population scorer over a prepared :class:`TreeData`.

    ``objective``: "penalised" (F1 − λ·k/N) or "hardcap"
    (F1 − λ·k − big·max(0, k − cap)).  ``evaluations`` counts every
    candidate handed in (the reference's budget unit), ``fits`` only the
    distinct new masks actually scored.  The memo maps mask → score; it is
    bounded by the number of evaluations (population-sized per call).  With
    ``resume`` it is a table in that folder instead, also of earlier searches."""

    def __init__(self, data: TR.TreeData, max_depth: int, lam: float = 0.01,
                 objective: str = "penalised", k_cap: int = 9, big_penalty: float = 0.10,
                 metric: str = "f1", evaluator: str = "tree", parallelism: int = 8, resume: str | None = None):
        self.data, self.depth, self.lam = data, max_depth, lam
        # "tree": path-keyed trees of the whole population together; "mllib": a fit per mask;
        # "entropy": the closed-form score, without trees.
        if evaluator not in EVALUATORS:
            raise ValueError(f"unknown evaluator {evaluator!r}")
        self.evaluator, self.parallelism = evaluator, parallelism
        self.objective, self.k_cap, self.big = objective, k_cap, big_penalty
        self.metric = metric
        self.memo: dict = {}
        self.table = None
        if resume:
            run = f"{evaluator}/{metric}/{max_depth}/{','.join(data.features)}"
            self.table = ScoreTable(data.rows.sparkSession, f"{resume.rstrip('/')}/scores", run)
        self.evaluations = 0
        self.fits = 0
        self.growth: G.Growth | None = None  # what the trees of earlier calls counted

    def __call__(self, cands: DataFrame) -> DataFrame:
        spark = cands.sparkSession
        if self.table:
            cands = cut_lineage(cands, "candidates")
            self.evaluations += cands.count()
            new = sorted(tuple(r["mask"]) for r in self.table.unscored(cands).collect())  # population-sized
            if new:
                self.fits += len(new)
                self.table.append(self._score(spark, new))
            return self.table.join(cands).withColumnRenamed("score", "f1").withColumn("obj", self._objective())
        cands = local_rows(cands)
        rows = cands.select("member", "mask").collect()  # population-sized
        self.evaluations += len(rows)
        new = sorted({tuple(r["mask"]) for r in rows} - set(self.memo))
        if new:
            self.fits += len(new)
            self.memo |= self._score(spark, new)
        out = [(r["member"], *self.memo[tuple(r["mask"])]) for r in rows]
        sc = local_table(spark, out, "member int, f1 double, k int")
        return cands.join(sc.withColumn("obj", self._objective()), "member")

    def _score(self, spark, masks: list) -> dict:
        """{mask: (score, size)}"""
        if self.evaluator == "mllib":
            res = FT.mllib_fitness(list(enumerate([list(m) for m in masks])), self.data.ml_rows, self.data.features,
                                   self.depth, self.lam, parallelism=self.parallelism, metric=self.metric)
            return {masks[i]: (float(f1), int(k)) for i, k, f1, _ in res}
        if self.evaluator == "entropy":
            return {m: (s, sum(m)) for m, s in FT.entropy_scores(spark, masks, self.data).items()}
        if self.growth is None and self.data.n_classes <= B.MOST_CLASSES:
            self.growth = G.Growth(self.data)
        scored = FT.score_masks(spark, masks, self.data, self.depth, self.metric, self.growth)
        return {m: (f1, k) for m, (k, f1, *_) in scored.items()}

    def _objective(self):
        f1, k = F.col("f1"), F.col("k")
        if self.objective == "hardcap":
            return M.hardcap_objective(f1, k, self.lam, self.k_cap, self.big)
        if self.objective == "legacy_hardcap":
            # the reference unpacks (obj, f1, k) as (obj, acc, f1), so its
            # "f1" is k: objective k − λ·k (rewards size, ignores accuracy)
            return M.hardcap_objective(k.cast("double"), k, self.lam, self.k_cap, self.big)
        return M.penalised_objective(f1, k, len(self.data.features), self.lam)


def _best(pop: DataFrame) -> dict:
    r = R.best_member(pop.select("member", "mask", "obj", "k")).first()
    return {"mask": list(r["mask"]), "obj": float(r["obj"]), "k": int(r["k"])}


def _kept(resume: str | None, data: TR.TreeData, algo: str, prm, iters: str, **more) -> Generations | None:
    """The generations folder of a resumable search; the number of iterations may change."""
    if not resume:
        return None
    settings = {"algo": algo, "features": list(data.features), **asdict(prm), **more}
    del settings[iters]
    return Generations(data.rows.sparkSession, f"{resume.rstrip('/')}/{algo}", settings)


def select_abc(data: TR.TreeData, prm: ABC.ABCParams, max_depth: int = 4, evaluator: str = "tree",
               resume: str | None = None) -> dict:
    spark = data.rows.sparkSession
    n = len(data.features)
    score = Scorer(data, max_depth, prm.lam, evaluator=evaluator, resume=resume)
    kept = _kept(resume, data, "abc", prm, "max_iters", max_depth=max_depth, evaluator=evaluator)
    t0 = time.time()
    done = 0
    if kept and (saved := kept.latest(prm.max_iters)):
        done, pop, state = saved
        best, history = state["best"], state["history"]
        score.evaluations, score.fits = state["evaluations"], state["fits"]
    else:
        pop = M.random_masks(spark, prm.num_bees, n, prm.init_p, prm.seed, "abc.init")
        pop = score(pop).select("member", "mask", "obj", "k", F.lit(0).alias("trials"))
        pop = local_rows(dense(pop))
        best = _best(pop)
        history = [{"iter": 0, "best_obj": best["obj"], "best_k": best["k"]}]
    for it in range(done + 1, prm.max_iters + 1):
        nb = ABC.neighbours(pop, n, prm.seed, it)
        sc = score(nb.select("member", F.col("cand").alias("mask"))).select(
            "member", F.col("mask").alias("cand"), F.col("obj").alias("cand_obj"), F.col("k").alias("cand_k"))
        pop = local_rows(ABC.employed_accept(nb.drop("cand").join(sc, "member")))
        picks = ABC.roulette(pop, prm.num_bees, prm.seed, it)
        oc = local_rows(ABC.onlooker_candidates(pop, picks, n, prm.seed, it))
        osc = score(oc.select(F.col("onlooker").alias("member"), F.col("cand").alias("mask"))).select(
            F.col("member").alias("onlooker"), F.col("obj").alias("cand_obj"), F.col("k").alias("cand_k"))
        pop = local_rows(ABC.onlooker_accept(pop, oc.join(osc, "onlooker")))
        sc_pop = ABC.scouts(pop, n, prm.limit, prm.scout_p, prm.seed, it)
        scouts = sc_pop.filter("scout")
        if scouts.limit(1).count():
            rs = score(scouts.select("member", "mask")).select("member", F.col("obj").alias("s_obj"),
                                                               F.col("k").alias("s_k"))
            sc_pop = sc_pop.join(rs, "member", "left").withColumn(
                "obj", F.coalesce("s_obj", "obj")).withColumn("k", F.coalesce("s_k", "k")).drop("s_obj", "s_k")
        pop = local_rows(sc_pop.drop("scout"))
        b = _best(pop)
        if b["obj"] > best["obj"]:
            best = b
        history.append({"iter": it, "best_obj": best["obj"], "best_k": best["k"]})
        if kept:
            pop = kept.save(it, pop, {"best": best, "history": history, "evaluations": score.evaluations, "fits": score.fits})
    return {"algo": "abc", "best_mask": best["mask"], "best_obj": best["obj"], "history": history,
            "evaluations": score.evaluations, "fits": score.fits, "iters": prm.max_iters, "lambda": prm.lam,
            "elapsed_search_sec": time.time() - t0, "params": asdict(prm)}


def select_aco(data: TR.TreeData, prm: ACO.ACOParams, max_depth: int = 6, lam: float = 0.01,
               ordv: list | None = None, k_min: int = 5, k_max: int = 10,
               init_mask: list | None = None, evaluator: str = "tree", resume: str | None = None) -> dict:
    if not data.features:
        raise ValueError("ACO needs at least one feature")
    spark = data.rows.sparkSession
    n = len(data.features)
    ordv = ordv or list(range(n))
    p0 = 1.0 if prm.reference_start else (min(1.0, k_max / n) if prm.p0 is None else prm.p0)
    score = Scorer(data, max_depth, lam, evaluator=evaluator, resume=resume)
    kept = _kept(resume, data, "aco", prm, "iters", max_depth=max_depth, lam=lam, ordv=ordv, k_min=k_min, k_max=k_max,
                 init_mask=init_mask, evaluator=evaluator)
    t0 = time.time()
    done = 0
    if kept and (saved := kept.latest(prm.iters)):
        done, pher, state = saved
        best, evals, no_improve, history = (state[x] for x in ("best", "evals", "no_improve", "history"))
        score.fits = state["fits"]
    else:
        feats = spark.createDataFrame([(i,) for i in range(n)], "feature_idx int")
        pher = ACO.init_pheromone(feats)
        if prm.heuristic:
            pher = local_rows(ACO.heuristic_pheromone(feats, ACO.information_gain(data.rows.filter("is_train"))))
        if init_mask is not None:
            start = spark.createDataFrame([(0, init_mask)], "member int, mask array<int>")
        else:
            start = ACO.start_mask(spark, n, k_min, prm.seed).select(F.lit(0).alias("member"), "mask")
        start = R.repair_by_priority(start, ordv, k_min, k_max)
        best = _best(score(start))
        evals, no_improve, history = 1, 0, [best["obj"]]
    for it in range(done, prm.iters):
        if it and (evals >= prm.max_evals or no_improve >= prm.patience):
            break
        probs = ACO.probabilities(pher, prm.alpha, prm.beta, p0)
        ants = ACO.ants(spark, probs, prm.num_ants, prm.seed, it)
        left = prm.max_evals - evals
        ants = ants.filter(F.col("member") < F.lit(max(1, left)))
        ants = R.repair_by_priority(ants, ordv, k_min, k_max)
        scored = local_rows(score(ants).select("member", "mask", "obj", "k"))
        before = best["obj"]
        for r in scored.orderBy("member").select("member", "obj", "k", "mask").collect():  # ≤ num_ants rows
            evals += 1
            if r["obj"] > best["obj"]:
                best = {"mask": list(r["mask"]), "obj": float(r["obj"]), "k": int(r["k"])}
                no_improve = 0
            elif prm.reference_start:
                no_improve += 1
        if not prm.reference_start:
            no_improve = 0 if best["obj"] > before else no_improve + 1
        pher = local_rows(ACO.update(pher, scored, best["mask"], best["obj"], prm.rho, prm.q))
        history.append(best["obj"])
        if kept:
            pher = kept.save(it + 1, pher, {"best": best, "evals": evals, "no_improve": no_improve, "history": history,
                                            "fits": score.fits})
    return {"algo": "aco", "best_mask": best["mask"], "best_obj": best["obj"], "history": history,
            "evaluations": evals, "fits": score.fits, "iters": prm.iters, "lambda": lam,
            "elapsed_search_sec": time.time() - t0, "params": asdict(prm)}


def select_fpa(data: TR.TreeData, prm: FPA.FPAParams, max_depth: int = 12, lam: float = 0.01,
               ordv: list | None = None, k_min: int = 5, k_max: int = 9,
               init_mask: list | None = None, evaluator: str = "tree", resume: str | None = None) -> dict:
    spark = data.rows.sparkSession
    n = len(data.features)
    ordv = ordv or list(range(n))
    score = Scorer(data, max_depth, lam, evaluator=evaluator, resume=resume)
    kept = _kept(resume, data, "fpa", prm, "iters", max_depth=max_depth, lam=lam, ordv=ordv, k_min=k_min, k_max=k_max,
                 init_mask=init_mask, evaluator=evaluator)
    t0 = time.time()
    done = 0
    if kept and (saved := kept.latest(prm.iters)):
        done, pop, state = saved
        best, n_eval, no_improve, history = (state[x] for x in ("best", "n_eval", "no_improve", "history"))
        score.fits = state["fits"]
    else:
        n_rand = prm.pop_size - (1 if init_mask is not None else 0)
        pop = FPA.init_masks(spark, n_rand, n, prm.init_k, prm.seed, 1 if init_mask is not None else 0)
        if init_mask is not None:
            pop = spark.createDataFrame([(0, init_mask)], "member int, mask array<int>").unionByName(pop)
        pop = R.repair_by_priority(pop, ordv, k_min, k_max)
        pop = local_rows(score(pop).select("member", "mask", "obj", "k"))
        best = _best(pop)
        n_eval, no_improve, history = prm.pop_size, 0, [best["obj"]]
    for it in range(done, prm.iters):
        if it and prm.patience is not None and no_improve >= prm.patience:
            break
        if prm.max_evals is not None and n_eval >= prm.max_evals:
            break
        el = FPA.elites(pop, prm.elitism)
        left = None if prm.max_evals is None else prm.max_evals - n_eval
        off = FPA.propose(pop, best["mask"], prm, it, left)
        off = local_rows(off.withColumn("mask", F.when(F.col("is_copy"), F.col("mask")).otherwise(
            R.repair_expr(F.col("mask"), ordv, k_min, k_max))))
        real = off.filter(~F.col("is_copy"))
        n_real = real.count()
        sc = score(real.select(F.col("slot").alias("member"), "mask")).select(
            F.col("member").alias("slot"), "obj", "k")
        scored = off.join(sc, "slot", "left")
        n_eval += n_real
        pop = local_rows(FPA.accept(el, scored))
        b = _best(pop)
        if b["obj"] > best["obj"]:
            best, no_improve = b, 0
        else:
            no_improve += 1
        history.append(best["obj"])
        if kept:
            pop = kept.save(it + 1, pop, {"best": best, "n_eval": n_eval, "no_improve": no_improve, "history": history,
                                          "fits": score.fits})
    stopped = (prm.patience is not None and no_improve >= prm.patience) or \
        (prm.max_evals is not None and n_eval >= prm.max_evals)
    return {"algo": "fpa", "best_mask": best["mask"], "best_obj": best["obj"], "history": history,
            "evaluations": n_eval, "fits": score.fits, "iters": prm.iters, "stopped_early": stopped, "lambda": lam,
            "elapsed_search_sec": time.time() - t0, "params": asdict(prm)}


def select_pso(data: TR.TreeData, prm: PSO.PSOParams, max_depth: int = 2, lam: float = 0.03,
               rank_ordv: list | None = None, k_cap: int = 9, big_penalty: float = 0.10,
               legacy_objective: bool = False, evaluator: str = "tree", resume: str | None = None) -> dict:
    """All restarts are one population keyed by (restart, member).
    ``legacy_objective=True`` reproduces the reference's k − 0.03·k score."""
    spark = data.rows.sparkSession
    n = len(data.features)
    rank_ordv = rank_ordv or list(range(n))
    score = Scorer(data, max_depth, lam, "legacy_hardcap" if legacy_objective else "hardcap", k_cap, big_penalty,
                   evaluator=evaluator, resume=resume)
    kept = _kept(resume, data, "pso", prm, "iters", max_depth=max_depth, lam=lam, rank_ordv=rank_ordv, k_cap=k_cap,
                 big_penalty=big_penalty, legacy_objective=legacy_objective, evaluator=evaluator)
    t0 = time.time()
    done = 0
    if kept and (saved := kept.latest(prm.iters)):
        done, sw, state = saved
        history = state["history"]
        score.evaluations, score.fits = state["evaluations"], state["fits"]
        gb = local_rows(PSO.gbest_of(sw))
    else:
        sw = None
        for r in range(prm.restarts):
            s = PSO.start(spark, prm.swarm_size, n, prm.seed, r)
            sw = s if sw is None else sw.unionByName(s)
        sw = sw.withColumn("mask", R.repair_cap_expr(F.col("mask"), rank_ordv, k_cap))
        sw = sw.withColumn("pid", F.col("restart") * F.lit(prm.swarm_size) + F.col("member"))
        sc = score(sw.select(F.col("pid").alias("member"), "mask")).select(F.col("member").alias("pid"), "obj", "k")
        sw = sw.join(sc, "pid").withColumn("pbest", F.col("mask")).withColumn("pbest_obj", F.col("obj")) \
            .withColumn("pbest_k", F.col("k"))
        sw = local_rows(sw)
        gb = local_rows(PSO.gbest_of(sw))
        history = [{"iter": 0, "best_obj": float(gb.agg(F.max("gbest_obj")).first()[0])}]
    for it in range(done + 1, prm.iters + 1):
        moved = PSO.step(sw, gb, n, prm, it)
        moved = moved.withColumn("cand", R.repair_cap_expr(F.col("cand"), rank_ordv, k_cap))
        moved = local_rows(moved)
        cs = score(moved.select(F.col("pid").alias("member"), F.col("cand").alias("mask"))).select(
            F.col("member").alias("pid"), F.col("obj").alias("cand_obj"), F.col("k").alias("cand_k"))
        sw = PSO.accept(moved.join(cs, "pid"), prm.greedy)
        sw = local_rows(sw.withColumn("pid", F.col("restart") * F.lit(prm.swarm_size) + F.col("member")))
        gb = local_rows(PSO.gbest_of(sw))
        history.append({"iter": it, "best_obj": float(gb.agg(F.max("gbest_obj")).first()[0])})
        if kept:
            sw = kept.save(it, sw, {"history": history, "evaluations": score.evaluations, "fits": score.fits})
    # best over restarts, strict > in restart order
    rows = gb.orderBy("restart").collect()  # one row per restart
    best = None
    for r in rows:
        if best is None or r["gbest_obj"] > best["obj"]:
            best = {"mask": list(r["gbest"]), "obj": float(r["gbest_obj"]), "k": int(r["gbest_k"])}
    return {"algo": "pso", "best_mask": best["mask"], "best_obj": best["obj"], "history": history,
            "evaluations": score.evaluations, "fits": score.fits, "iters": prm.iters,
            "elapsed_search_sec": time.time() - t0, "params": asdict(prm),
            "lambda": lam, "k_cap": k_cap, "big_penalty": big_penalty}


def final_retrain(df: DataFrame, features: list, label: str, is_train, max_depth: int = 12,
                  seed: int = 13) -> dict:
    """Retrain the winner with MLlib on the full split; time fit AND
    evaluation (the reference timed a lazy transform)."""
    from pyspark.ml.classification import DecisionTreeClassifier

    from ..operators import metrics as ME
    from ..operators import prepare as PR
    base = PR.impute_zero(df, features).withColumn("is_train", is_train)
    labels = PR.label_index(base.filter("is_train"), label)
    base = PR.apply_label_index(base, label, labels, "label")
    base = PR.assemble_vector(base, features).select("features", "label", "is_train")
    # MLlib makes one pass per level: read a written table, not the
    # upstream plan (which would be recomputed on every pass)
    base = cut_lineage(base, "retrain_input")
    t1 = time.time()
    model = DecisionTreeClassifier(featuresCol="features", labelCol="label", impurity="entropy",
                                   maxDepth=max_depth, seed=seed).fit(base.filter("is_train"))
    pred = model.transform(base.filter("not is_train"))
    met = ME.classification_metrics(pred).first().asDict()
    elapsed = time.time() - t1
    imps = list(model.featureImportances.toArray())
    return {"metrics": met, "elapsed_finaltrain_sec": elapsed,
            "importances": [(i, features[i], float(v)) for i, v in enumerate(imps)],
            "predictions": pred}
