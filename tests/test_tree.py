"""Path-keyed tree vs MLlib, and planted-signal recovery."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from swarmsift.functions.rng import uniform
from swarmsift.operators import fitness as FT
from swarmsift.operators import masks as M
from swarmsift.operators import tree as TR
from swarmsift.plans import select as SEL
from swarmsift.operators.search import fpa as FPA
from swarmsift.session import cut_lineage
from swarmsift.sources import fixtures as X


@pytest.fixture(scope="module")
def documents(spark):
    d = cut_lineage(X.doc_features(spark, "/root/testdata/sf0.1").repartition(8), "docs")
    return TR.prepare_tree_data(d, X.D_FEATURES, "Target", uniform(13, "split", F.col("doc_id")) < 0.8)


@pytest.mark.parametrize("depth", [2, 4, 6, 12])
def test_tree_close_to_mllib(spark, documents, depth):
    pop = M.random_masks(spark, 2, len(X.D_FEATURES), 0.5, 13)
    ours = {r["member"]: r["f1"] for r in FT.population_fitness(pop, documents, depth).collect()}
    theirs = FT.mllib_fitness([(r["member"], r["mask"]) for r in pop.collect()], documents.ml_rows, X.D_FEATURES, depth)
    for member, _, f1, _ in theirs:
        assert abs(f1 - ours[member]) < 0.02


def test_no_row_is_copied_per_candidate(spark, documents):
    cands = spark.createDataFrame([(c, list(range(c, c + 5))) for c in range(6)], "cand int, feats array<int>")
    records, trie = TR.grow_population(documents, cands, 4)
    wanted = {r[9]: [0, 1] for r in records if r[5] is None}
    n_bins = 33
    for df in (TR.path_histogram(documents.rows.filter("is_train"), trie, wanted, 11, n_bins, 3),
               TR.population_confusion(documents, records, trie)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    # Candidates share nodes: fewer paths than nodes.
    assert len({r[9] for r in records}) < len(records)


def test_larger_sibling_by_subtraction_equals_a_count(spark, documents):
    cands = spark.createDataFrame([(0, list(range(11)))], "cand int, feats array<int>")
    records, trie = TR.grow_population(documents, cands, 3)
    _, _, left, right = trie.splits[0][0]
    train, every = documents.rows.filter("is_train"), list(range(11))

    def hist(path):
        return TR.path_histogram(train, trie, {path: every}, 11, 33, 3)
    both = TR.child_histograms(hist(0), train, trie, [(0, left, right, every)], 11, 33, 3)
    assert sorted(both.filter(F.col("path") == right).collect()) == sorted(hist(right).select(both.columns).collect())
    assert sorted(both.filter(F.col("path") == left).collect()) == sorted(hist(left).select(both.columns).collect())
    n = {r[9]: r[3] for r in records}
    assert n[0] == n[left] + n[right] == train.count()


def test_scores_do_not_depend_on_partitions_or_flushes(spark, documents, monkeypatch):
    pop = M.random_masks(spark, 4, 11, 0.4, 5)
    want = sorted(FT.population_fitness(pop, documents, 3).collect())
    monkeypatch.setattr(TR, "HELD_CELLS", 10)
    other = replace(documents, rows=documents.rows.repartition(13))
    assert sorted(FT.population_fitness(pop, other, 3).collect()) == want


@pytest.mark.parametrize("cells", [0, 3000])
def test_tables_and_driver_take_the_same_splits(spark, documents, monkeypatch, cells):
    cands = spark.createDataFrame([(c, list(range(c, c + 5))) for c in range(3)], "cand int, feats array<int>")
    want, _ = TR.grow_population(documents, cands, 4)
    monkeypatch.setattr(TR, "LOCAL_CELLS", cells)
    got, _ = TR.grow_population(documents, cands, 4)
    assert sorted(r[:9] for r in got) == sorted(r[:9] for r in want)


def test_empty_mask_and_empty_train(spark):
    df = spark.range(40).select("id", (F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") % 5 > 2, "a").otherwise("b").alias("y"))
    pop = spark.createDataFrame([(0, [0]), (1, [1])], "member int, mask array<int>")
    got = {r.member: r for r in FT.population_fitness(pop, TR.prepare_tree_data(df, ["x"], "y", F.col("id") < 30), 2).collect()}
    assert (got[0].obj, got[0].f1) == (-1.0, 0.0) and got[1].f1 == 1.0
    got = FT.population_fitness(pop, TR.prepare_tree_data(df, ["x"], "y", F.lit(False)), 2).collect()
    assert {r.f1 for r in got} == {0.0}


def test_fpa_recovers_planted_signal(spark):
    # label = x3 > 0.5 XOR nothing else; 8 noise columns
    n, feats = 9, [f"x{i}" for i in range(9)]
    df = spark.range(600).select(F.col("id").alias("rid"), *[
        uniform(1, f"pl{i}", F.col("id")).alias(f"x{i}") for i in range(n)])
    df = df.withColumn("y", F.when(F.col("x3") > 0.5, "A").otherwise("B"))
    data = TR.prepare_tree_data(df, feats, "y", uniform(2, "split", F.col("rid")) < 0.8)
    res = SEL.select_fpa(data, FPA.FPAParams(pop_size=10, iters=4, patience=3, max_evals=60, init_k=3),
                         max_depth=2, ordv=list(range(n)), k_min=1, k_max=3)
    assert res["best_mask"][3] == 1
    assert res["best_obj"] > 0.9


def test_pso_legacy_objective_is_size_score(spark):
    from swarmsift.operators.search import pso as PSO
    from swarmsift.plans import runs
    data = runs.search_data(spark, "/root/testdata/sf0.001", 1.0)
    res = SEL.select_pso(data, PSO.PSOParams(swarm_size=3, iters=1, restarts=1), legacy_objective=True)
    k = sum(res["best_mask"])
    assert abs(res["best_obj"] - (k - 0.03 * k)) < 1e-9
