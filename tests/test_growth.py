"""Trees on blocks of columns: the same splits and scores as the path-keyed trees, on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmsift.functions.rng import uniform
from swarmsift.operators import blocks as B
from swarmsift.operators import discretize as Z
from swarmsift.operators import growth as G
from swarmsift.operators import tree as TR
from swarmsift.plans import runs

from .conftest import SF001

FEATS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 3000, 1, 5).select(F.col("id").alias("rid"), *[uniform(1, f"gr{i}", F.col("id")).alias(f"x{i}") for i in range(4)],
                                           (F.col("id") % 3).cast("double").alias("x4"), F.lit(1.5).alias("x5"))
    noise = uniform(1, "noise", F.col("rid"))
    y = F.when(noise < 0.02, F.lit(None)).when((F.col("x1") + F.col("x3") > 1) != (noise > 0.9), "a").otherwise("b")
    return df.withColumn("y", y)


def is_train():
    return uniform(2, "split", F.col("rid")) < 0.7


@pytest.mark.parametrize("depth, whole, node_rows", [(3, 4, 10 ** 6), (6, 1, 10 ** 6), (6, 2, 400), (6, 9, 1), (0, 4, 1)])
def test_splits_and_scores_equal_path_keyed_trees(spark, rows, monkeypatch, depth, whole, node_rows):
    data = TR.prepare_tree_data(rows, FEATS, "y", is_train())
    cands = {0: [0, 1, 2], 1: [1, 3, 4], 2: [5], 3: list(range(6)), 4: []}
    records, trie = TR.grow_population(data, spark.createDataFrame(list(cands.items()), "cand int, feats array<int>"), max(1, depth))
    want = sorted((r.cand, int(r.label), int(r.prediction), r["count"]) for r in TR.population_confusion(data, records, trie).collect())
    monkeypatch.setattr(G, "WHOLE_LEVELS", whole)
    monkeypatch.setattr(G, "NODE_ROWS", node_rows)
    monkeypatch.setattr(G, "DRIVER_BYTES", 0 if depth == 3 else 1 << 20)
    monkeypatch.setattr(B, "CHUNK_ROWS", 500)
    growth = G.Growth(data)
    got, confusion = growth.grow(cands, max(1, depth))
    assert confusion == want
    if depth < 6 or whole == 9:
        assert sorted(r[:9] for r in got) == sorted(r[:9] for r in records)
        monkeypatch.setattr(growth, "_count", None)  # all that a second call needs is known
    assert growth.grow(cands, max(1, depth))[1] == want


def test_cuts_in_few_passes_are_exact(spark):
    step = [1.0, np.nextafter(1.0, 2.0), np.nextafter(np.nextafter(1.0, 2.0), 2.0)]
    data = [(float(step[i % 3]), 10.0 ** (i % 600 - 300) * (-1) ** i, None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(i),
             float("inf") if i % 2 else -0.0, 7.0, float(i * i % 977)) for i in range(3000)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double, f double").repartition(7)
    from swarmsift.operators import prepare as PR
    want = Z.fit_splits(PR.impute_zero(df, list("abcdef")), list("abcdef"), 32)
    assert B.exact_splits(df, [F.col(c) for c in "abcdef"], 32) == [want[c] for c in "abcdef"]
    assert B.exact_splits(df.limit(0), [F.col("a")], 4) == [[float("-inf"), float("inf")]]


def test_written_table_is_binned_as_any_other(spark, rows):
    nulls = rows.withColumn("x2", F.when(F.col("rid") % 7 != 0, F.col("x2")))
    want = TR.prepare_tree_data(nulls, FEATS, "y", is_train())
    got = TR.prepare_tree_data(nulls, FEATS, "y", is_train(), written=True)
    assert got.splits == want.splits
    cols = ["is_train", "label", "bins", "packed"]
    assert sorted(got.rows.select(cols).collect()) == sorted(want.rows.select(cols).collect())

    def counts(data):
        return G.Growth(data).grow({0: list(range(6))}, 5)
    assert counts(got) == counts(want)


@pytest.mark.parametrize("search", ["leaderboard", "run_report"])
def test_searches_fit_on_every_train_row(spark, monkeypatch, search):
    """F8, F9: the trees of the candidates were fitted on a share of the train rows."""
    seen = []
    monkeypatch.setattr(runs.SEL, f"select_{'fpa' if search == 'run_report' else 'abc'}", lambda data, *_, **__: seen.append(data))
    monkeypatch.setattr(runs, "cheap_rank", lambda *_: None)
    (runs.run_fpa if search == "run_report" else runs.run_abc)(spark, SF001)
    growth = G.Growth(seen[0])
    growth.grow({0: [0]}, 1)
    root = growth.hist[0, 0].sum(axis=0)
    wide = runs.wide(spark, SF001)
    train = wide.filter(runs.wide_is_train()).count()
    assert root[:growth.n_classes].sum() == train and root.sum() == wide.count()
    with pytest.raises(ValueError):
        runs.search_data(spark, SF001, 0.25)
