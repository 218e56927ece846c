"""Information gain as the ants' heuristic."""

import math
from collections import Counter

from pyspark.sql import functions as F

from swarmsift.operators.search import aco as ACO


def gain(pairs):
    def h(counts):
        n = sum(counts)
        return -sum(c / n * math.log2(c / n) for c in counts)
    by_bin = {}
    for b, y in pairs:
        by_bin.setdefault(b, []).append(y)
    return h(Counter(y for _, y in pairs).values()) - sum(
        len(ys) / len(pairs) * h(Counter(ys).values()) for ys in by_bin.values())


def test_gain_against_brute_force(spark):
    rows = [((i * 7) % 3, [(i * 7) % 3, i % 5, 0, (i * i) % 4]) for i in range(400)]
    got = {r.feature_idx: r.eta for r in ACO.information_gain(
        spark.createDataFrame(rows, "label int, bins array<int>").repartition(5)).collect()}
    for j in range(4):
        assert abs(got[j] - gain([(b[j], y) for y, b in rows])) < 1e-6
    one_label = spark.createDataFrame([(1, [0, 1]), (1, [1, 1])], "label int, bins array<int>")
    assert [r.eta for r in ACO.information_gain(one_label).collect()] == [0.0, 0.0]
    assert ACO.information_gain(one_label.limit(0)).count() == 0


def test_beta_changes_the_masks(spark):
    rows = spark.createDataFrame([(i % 2, [i % 2, (i // 2) % 3, (i // 3) % 2, 1]) for i in range(300)], "label int, bins array<int>")
    feats = spark.createDataFrame([(j,) for j in range(4)], "feature_idx int")
    pher = ACO.heuristic_pheromone(feats, ACO.information_gain(rows))
    drawn = {}
    for beta in (0.0, 1.0):
        probs = ACO.probabilities(pher, 1.0, beta, 0.5)
        sums = ACO.ants(spark, probs, 200, 13, 1).select(F.posexplode("mask").alias("j", "b")).groupBy("j").agg(F.sum("b").alias("n"))
        drawn[beta] = {r.j: r.n for r in sums.collect()}
    assert drawn[0.0][0] == drawn[1.0][0]  # the feature that is the label keeps the full share
    assert all(drawn[0.0][j] > 60 and drawn[1.0][j] < 10 for j in (1, 2, 3))
