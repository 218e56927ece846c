"""Searches stopped and resumed, and scored masks kept as a table."""

import pytest
from pyspark.sql import functions as F

from swarmsift.functions.rng import uniform
from swarmsift.operators import masks as M
from swarmsift.operators import tree as TR
from swarmsift.operators.search import abc as ABC
from swarmsift.operators.search import aco as ACO
from swarmsift.operators.search import fpa as FPA
from swarmsift.operators.search import pso as PSO
from swarmsift.plans import select as SEL
from swarmsift.plans.state import Generations


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(300).select(F.col("id").alias("rid"), *[uniform(1, f"rs{i}", F.col("id")).alias(f"x{i}") for i in range(7)])
    df = df.withColumn("y", F.when(F.col("x3") + 0.3 * F.col("x5") > 0.6, "A").otherwise("B"))
    return TR.prepare_tree_data(df, [f"x{i}" for i in range(7)], "y", uniform(2, "split", F.col("rid")) < 0.8)


SEARCHES = {
    "abc": lambda data, n, folder: SEL.select_abc(
        data, ABC.ABCParams(num_bees=3, max_iters=n, limit=1), evaluator="entropy", resume=folder),
    "aco": lambda data, n, folder: SEL.select_aco(
        data, ACO.ACOParams(num_ants=3, iters=n, beta=1.0, heuristic=True), k_min=1, k_max=3, evaluator="entropy", resume=folder),
    "fpa": lambda data, n, folder: SEL.select_fpa(
        data, FPA.FPAParams(pop_size=4, iters=n, init_k=2, max_evals=9), k_min=1, k_max=3, evaluator="entropy", resume=folder),
    "pso": lambda data, n, folder: SEL.select_pso(
        data, PSO.PSOParams(swarm_size=2, iters=n, restarts=2, greedy=True), k_cap=3, evaluator="entropy", resume=folder),
}


@pytest.mark.parametrize("algo", list(SEARCHES))
def test_stopped_and_resumed_equals_uninterrupted(data, tmp_path, algo):
    search = SEARCHES[algo]
    whole = search(data, 3, None)
    search(data, 2, str(tmp_path))
    resumed = search(data, 3, str(tmp_path))
    for key in ("best_mask", "best_obj", "history", "evaluations", "fits"):
        assert resumed[key] == whole[key], key
    again = search(data, 3, str(tmp_path))  # nothing left to do
    assert (again["history"], again["fits"]) == (whole["history"], whole["fits"])


def test_scored_masks_are_scored_once(spark, data, tmp_path):
    cands = M.random_masks(spark, 12, 7, 0.4, 5)
    first = SEL.Scorer(data, 4, evaluator="entropy", resume=str(tmp_path))
    plain = SEL.Scorer(data, 4, evaluator="entropy")
    pick = lambda df: sorted((r.member, tuple(r.mask), r.f1, r.k, r.obj) for r in df.collect())
    want = pick(plain(cands))
    assert pick(first(cands)) == want and first.fits == plain.fits > 0
    second = SEL.Scorer(data, 4, evaluator="entropy", resume=str(tmp_path))
    assert pick(second(cands)) == want and second.fits == 0
    other = SEL.Scorer(data, 5, evaluator="entropy", resume=str(tmp_path))  # another depth is another score
    other(cands)
    assert other.fits == first.fits


def test_keys_and_generations(spark, tmp_path):
    masks = [[0] * 70, [1] + [0] * 69, [0] * 69 + [1], [1] * 70, [0] * 61 + [1] + [0] * 8]
    keys = [tuple(r[0]) for r in spark.createDataFrame([(m,) for m in masks], "mask array<int>")
            .select(M.mask_key(F.col("mask"))).collect()]
    assert len(set(keys)) == 5 and keys[0] == (0, 0) and keys[2] == (0, 1) and keys[4] == (1, 0)
    kept = Generations(spark, str(tmp_path / "g"), {"seed": 1})
    assert kept.latest(9) is None
    for it in (1, 2, 11):
        kept.save(it, spark.createDataFrame([(it,)], "member int"), {"it": it})
    (tmp_path / "g" / "generation-000012").mkdir()  # begun, never completed
    it, pop, state = kept.latest(99)
    assert (it, pop.first().member, state) == (11, 11, {"it": 11})
    assert kept.latest(10)[0] == 2
    with pytest.raises(ValueError):
        Generations(spark, str(tmp_path / "g"), {"seed": 2}).latest(9)
