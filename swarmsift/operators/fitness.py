"""Population fitness: score every candidate subset of a population with path-keyed
trees grown together (the searches' evaluator), with concurrent MLlib fits, or in closed
form by conditional entropy.

Score = F1(test) − λ·k/N (empty subset: −1, F1 0).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_table
from . import blocks as B
from . import growth as G
from . import masks as M
from . import metrics as ME
from . import tree as TR


def population_fitness(pop: DataFrame, data: TR.TreeData, max_depth: int, lam: float = 0.01,
                       metric: str = "f1") -> DataFrame:
    """pop (member, mask, …) → pop + (k, f1, accuracy, macro_f1, obj).

    All members are grown together (one job per tree level, nodes shared by path) and scored
    in one job.  Members with equal masks are one candidate.  The population (members ×
    feature bits) is small by construction; it is read once to assign dense candidate ids."""
    spark = pop.sparkSession
    rows = sorted(pop.select("member", "mask").collect(), key=lambda r: r["member"])  # population-sized
    scored = score_masks(spark, [tuple(r["mask"]) for r in rows], data, max_depth, metric)
    out = [(r["member"], *scored[tuple(r["mask"])]) for r in rows]
    sc = spark.createDataFrame(out, "member int, k int, f1 double, accuracy double, macro_f1 double")
    obj = M.penalised_objective(F.col("f1"), F.col("k"), len(data.features), lam)
    return pop.join(F.broadcast(sc.withColumn("obj", obj)), "member")


def score_masks(spark, masks: list, data: TR.TreeData, max_depth: int, metric: str = "f1",
                growth: G.Growth | None = None) -> dict:
    """{mask: (k, metric, accuracy, macro_f1)} of the distinct masks; 0.0 for an empty one.
    ``growth`` keeps what was counted for a search's next call."""
    distinct = sorted(set(masks))
    feats = [[j for j, b in enumerate(m) if b == 1] for m in distinct]
    if data.n_classes <= B.MOST_CLASSES:
        _, found = (growth or G.Growth(data)).grow(dict(enumerate(feats)), max_depth)
        confusion = local_table(spark, [(c, float(y), float(p), n) for c, y, p, n in found],
                                "cand int, label double, prediction double, count long")
        records = found
    else:
        cands = spark.createDataFrame(list(enumerate(feats)), "cand int, feats array<int>")
        records, trie = TR.grow_population(data, cands, max_depth)
        confusion = TR.population_confusion(data, records, trie) if records else None
    by = {}
    if records:
        by = {r["cand"]: r for r in ME.metrics_from_confusion(confusion, ["cand"]).collect()}  # a row per candidate
    out = {}
    for i, m in enumerate(distinct):
        r = by.get(i)
        out[m] = (len(feats[i]), *[float(r[c]) if r else 0.0 for c in (metric, "accuracy", "macro_f1")])
    return out


#: Bins that make one cell of the closed-form score: 32 bins give 4 cells a feature.
CELL_BINS = 8


def entropy_scores(spark, masks: list, data: TR.TreeData, cell_bins: int = CELL_BINS) -> dict:
    """{mask: 1 − H(label | cells of the selected features) / H(label)} over the train rows,
    rounded to 6 decimals; 0.0 for an empty mask or a single label.

    No tree: rows are first counted by (all cells, label), then one aggregation counts every
    mask's (cells, label); both merge map-side."""
    feats = [(i, [j for j, b in enumerate(m) if b == 1]) for i, m in enumerate(masks)]
    cells = F.transform("bins", lambda b: F.floor(b / cell_bins).cast("int"))
    every = data.rows.filter("is_train").select(cells.alias("cells"), "label") \
        .groupBy("cells", "label").agg(F.count("*").alias("n"))
    chosen = F.array(*[F.struct(F.lit(i).alias("cand"), F.array(*[F.lit(j) for j in f]).cast("array<int>").alias("feats"))
                       for i, f in feats])
    per = every.select("cells", "label", "n", F.explode(chosen).alias("c")) \
        .select("c.cand", F.transform("c.feats", lambda j: F.col("cells")[j]).alias("cell"), "label", "n") \
        .groupBy("cand", "cell", "label").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("cand", "cell"))  # as many rows as labels
    bits = per.select("cand", "label", "n", (-F.col("n") * F.log2(F.col("n") / total)).alias("bits"))
    given = bits.groupBy("cand", "label").agg(F.sum("bits").alias("bits"), F.sum("n").alias("n")).collect()  # masks x labels
    out = {}
    for i, m in enumerate(masks):
        mine = [r for r in given if r["cand"] == i]
        n = sum(r["n"] for r in mine)
        alone = sum(-r["n"] * math.log2(r["n"] / n) for r in mine)
        out[m] = round(1 - sum(r["bits"] for r in mine) / alone, 6) + 0.0 if alone > 0 and any(m) else 0.0
    return out


def mllib_fitness(pop_rows: list, prepared: DataFrame, features: list, max_depth: int,
                  lam: float = 0.01, seed: int = 13, parallelism: int = 4,
                  label: str = "label", metric: str = "f1") -> list:
    """Evaluator A: one MLlib DecisionTreeClassifier per mask, submitted as
    concurrent Spark jobs.  ``pop_rows`` is a list of (member, mask) — the
    population (members × features bits) is small by construction.
    ``prepared`` has ``features`` (vector of all columns), ``label`` and
    ``is_train``."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorSlicer

    n = len(features)

    def score(item):
        member, mask = item
        idx = [i for i, b in enumerate(mask) if b == 1]
        if not idx:
            return member, 0, 0.0, -1.0
        sl = VectorSlicer(inputCol="features", outputCol="sub", indices=idx).transform(prepared)
        model = DecisionTreeClassifier(featuresCol="sub", labelCol=label, impurity="entropy",
                                       maxDepth=max_depth, seed=seed).fit(sl.filter("is_train"))
        pred = model.transform(sl.filter("not is_train"))
        f1 = ME.classification_metrics(pred, label, "prediction").first()[metric]
        return member, len(idx), f1, f1 - lam * len(idx) / n

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        return list(ex.map(score, pop_rows))
