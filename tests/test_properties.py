"""Properties: split is partition-independent, repair bounds, metrics."""

from pyspark.sql import functions as F

from swarmsift.operators import masks as M
from swarmsift.operators import metrics as ME
from swarmsift.operators import repair as R
from swarmsift.operators import split as S
from swarmsift.plans.queries_model import L_DISC  # noqa: F401

SF01 = "/root/testdata/sf0.01"


def test_split_independent_of_partitioning(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = S.split_flag(li, keys).filter("is_train").select(*keys)
    b = S.split_flag(li.repartition(13), keys).filter("is_train").select(*keys)
    assert a.count() == b.count() == a.intersect(b).count()
    train, test = S.split_train_test(li, keys)
    assert train.count() + test.count() == li.count()


def test_repair_bounds_and_idempotence(spark):
    n = 20
    pop = M.random_masks(spark, 40, n, 0.5, 3)
    ordv = list(reversed(range(n)))
    rep = R.repair_by_priority(pop, ordv, 5, 9)
    ks = [sum(r["mask"]) for r in rep.collect()]
    assert all(5 <= k <= 9 for k in ks)
    again = R.repair_by_priority(rep, ordv, 5, 9)
    assert sorted(map(tuple, [r["mask"] for r in rep.collect()])) == \
        sorted(map(tuple, [r["mask"] for r in again.collect()]))
    empty = spark.createDataFrame([(0, [0] * n)], "member int, mask array<int>")
    top = R.repair_by_importance(empty, list(range(n)), 3).first()["mask"]
    assert top[:3] == [1, 1, 1] and sum(top) == 3


def test_repair_prefers_priority(spark):
    ordv = [3, 0, 1, 2]  # feature 1 first, then 2, 3, 0
    pop = spark.createDataFrame([(0, [1, 1, 1, 1]), (1, [0, 0, 0, 0])], "member int, mask array<int>")
    got = {r["member"]: r["mask"] for r in R.repair_by_priority(pop, ordv, 2, 2).collect()}
    assert got == {0: [0, 1, 1, 0], 1: [0, 1, 1, 0]}


def test_masks_never_empty(spark):
    pop = M.random_masks(spark, 200, 5, 0.01, 1)
    assert all(sum(r["mask"]) >= 1 for r in pop.collect())


def test_metrics_match_mllib_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator as Ev
    rows = [(float(i % 3), float((i * 7) % 3 if i % 4 else i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    ours = ME.classification_metrics(df).first()
    for m in ["accuracy", "f1", "weightedPrecision", "weightedRecall"]:
        assert abs(ours[m] - Ev(metricName=m).evaluate(df)) < 1e-12


def test_best_member_first_wins_ties(spark):
    pop = spark.createDataFrame([(3, [1], 0.5, 1), (1, [1], 0.5, 1), (2, [1], 0.4, 1)],
                                "member int, mask array<int>, obj double, k int")
    assert R.best_member(pop).first()["member"] == 1


def test_greedy_accept(spark):
    df = spark.createDataFrame([(0.5, 0.4, 3, 2), (0.4, 0.4, 2, 3), (0.4, 0.4, 3, 3)], "n double, o double, nk int, ok int")
    got = [r[0] for r in df.select(M.greedy_accept(F.col("n"), F.col("o"), F.col("nk"), F.col("ok"))).collect()]
    assert got == [True, True, False]
