"""No caps, no dropped rows, counts instead of sketches, no one-task windows."""

import math

import pytest
from pyspark.sql import functions as F

from swarmsift.functions.rng import uniform
from swarmsift.operators import clean as C
from swarmsift.operators import discretize as Z
from swarmsift.operators import tree as TR
from swarmsift.operators.search import aco as ACO
from swarmsift.operators.search.common import dense, running_sum
from swarmsift.plans import select as SEL


def test_label_distribution_returns_every_label(spark):
    df = spark.range(180).select(F.concat(F.lit("l"), F.col("id") % 60).alias("Label"))
    assert C.label_distribution(df).count() == 60
    assert C.label_distribution(df, top=50).count() == 50


def test_null_labels_stay_in_the_fit(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"),
                                 F.when(F.col("id") % 4 != 0, F.when(F.col("id") % 3 == 0, "a").otherwise("b")).alias("y"))
    data = TR.prepare_tree_data(df, ["x"], "y", F.lit(True))
    root = TR.grow_trees(data, spark.createDataFrame([(0, [0])], "cand int, feats array<int>"), 1).filter("node = 1").first()
    assert root["n"] == 400 and list(root["counts"])[2] == 100


@pytest.mark.parametrize("buckets", [2, 10, 32])
def test_cuts_are_exact_ranks(spark, buckets):
    n = 3000
    inf = float("inf")
    rows = [(float(i % 50) ** 3 if i % 3 else 0.0, 10.0 ** (i % 600 - 300) * (-1) ** i, inf if i % 5 == 0 else -inf if i % 5 == 1 else 1e308 * (-1) ** i,
             None if i % 2 else f" {i % 17} ", "abc" if i % 4 else ("nan" if i % 8 else None), 7.0) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d string, e string, f double").repartition(7)
    got = Z.fit_splits(df, list("abcdef"), buckets)

    def number(v):
        try:
            v = float(v)
        except (TypeError, ValueError):
            return None
        return None if math.isnan(v) else v
    for k, name in enumerate("abcdef"):
        v = sorted(x for x in (number(r[k]) for r in rows) if x is not None)
        want = {-inf, inf} | {v[math.ceil(j / buckets * len(v)) - 1] + 0.0 for j in range(1, buckets) if v}
        assert got[name] == sorted(want), name


def test_saved_cuts_round_trip(spark, tmp_path):
    splits = {"x": [float("-inf"), 0.1, 2.0, float("inf")], "y": [float("-inf"), float("inf")]}
    Z.save_splits(splits, 10, spark, str(tmp_path / "d"))
    assert Z.load_splits(spark, str(tmp_path / "d")) == splits


def test_dense_ids_and_running_sums(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).cast("int").alias("member"), uniform(3, "v", F.col("id")).alias("v"))
    d = dense(df.filter("member % 3 = 0").repartition(9))
    assert "Window" not in d._jdf.queryExecution().executedPlan().toString()
    rows = d.orderBy("member").collect()
    assert [r["idx"] for r in rows] == list(range(len(rows)))
    total = 0.0
    for r in running_sum(d, "v", "s", block=64).orderBy("idx").collect():
        total += r["v"]
        assert r["s"] == pytest.approx(total, abs=1e-9)


def test_aco_probabilities_and_errors(spark):
    pher = ACO.init_pheromone(spark.range(20).select(F.col("id").cast("int").alias("feature_idx")))
    p = [r["p"] for r in ACO.probabilities(pher, 1.0, 0.0, p0=0.25).collect()]
    assert p == [0.25] * 20
    with pytest.raises(ValueError, match="feature"):
        SEL.select_aco(TR.TreeData(None, 0, [], {}, None), ACO.ACOParams())
    with pytest.raises(ValueError, match="evaluator"):
        SEL.Scorer(None, 2, evaluator="auto")
