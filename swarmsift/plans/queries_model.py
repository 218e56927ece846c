"""Registered keys: discretizer, preparation, metrics and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators import discretize as Z
from ..operators import split as S
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as X
from ..sources import sqlgen as g
from .registry import register

L_DISC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
L_SPLIT_U = g.u("duckdb", 13, "split", *X.LINEITEM_KEY)


def sql_cuts(source: str, cols: list, nb: int = 10) -> str:
    """Cut table (column, split_idx, value) in DuckDB: rank ⌈(j/B)·n⌉."""
    vals = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({g.qi(c, 'duckdb')} AS DOUBLE) AS x FROM {source}" for c in cols)
    return f"""(WITH v AS ({vals}),
      c AS (SELECT col, x FROM v WHERE x IS NOT NULL AND NOT isnan(x)),
      r AS (SELECT col, x, row_number() OVER (PARTITION BY col ORDER BY x) AS rn,
                   count(*) OVER (PARTITION BY col) AS n FROM c),
      p AS (SELECT unnest(range(1, {nb})) AS j),
      q AS (SELECT r.col, r.x + 0.0 AS x FROM r JOIN p
              ON r.rn = CAST(ceil((CAST(p.j AS DOUBLE) / {float(nb)!r}) * CAST(r.n AS DOUBLE)) AS BIGINT)),
      e AS (SELECT col, x FROM q UNION SELECT DISTINCT col, CAST('-inf' AS DOUBLE) FROM v
            UNION SELECT DISTINCT col, CAST('inf' AS DOUBLE) FROM v)
      SELECT col AS "column", CAST(row_number() OVER (PARTITION BY col ORDER BY x) - 1 AS INTEGER) AS split_idx,
             x AS value FROM e)"""


L_TRAIN = f"(SELECT * FROM lineitem WHERE {L_SPLIT_U} < 0.8)"


def l_train(spark, sf):
    train, _ = S.split_train_test(X.read(spark, sf, "lineitem"), X.LINEITEM_KEY, seed=13)
    return train


def l_splits(spark, sf):
    return Z.fit_splits(l_train(spark, sf), L_DISC, num_buckets=10)


@register("quantile_cuts", "SELECT * FROM " + sql_cuts(L_TRAIN, L_DISC))
def q_quantile_cuts(spark, sf):
    return Z.quantile_cuts(l_train(spark, sf), L_DISC, num_buckets=10)


def sql_bucket(c: str, cuts_cte: str = "cuts") -> str:
    lst = f"(SELECT list(value ORDER BY split_idx) FROM {cuts_cte} WHERE \"column\" = '{c}')"
    x = f"CAST({g.qi(c, 'duckdb')} AS DOUBLE)"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN CAST(len({lst}) - 1 AS DOUBLE) "
            f"ELSE CAST(len(list_filter({lst}[2:len({lst}) - 1], lambda s: s <= {x})) AS DOUBLE) END")


@register("bucketize",
          f"WITH cuts AS {sql_cuts(L_TRAIN, L_DISC)} SELECT {', '.join(X.LINEITEM_KEY)}, "
          + ", ".join(f"{sql_bucket(c)} AS {c}__binned" for c in L_DISC) + " FROM lineitem")
def q_bucketize(spark, sf):
    li = X.read(spark, sf, "lineitem").select(*X.LINEITEM_KEY, *L_DISC)
    return Z.bucketize(li, l_splits(spark, sf)).drop(*L_DISC)


L_KEEP = X.LINEITEM_KEY + ["l_linestatus", "l_shipdate"]


@register("discretize_project",
          f"WITH cuts AS {sql_cuts(L_TRAIN, L_DISC)} SELECT l_returnflag, {', '.join(L_KEEP)}, "
          + ", ".join(f"{sql_bucket(c)} AS {c}__binned" for c in L_DISC) + " FROM lineitem")
def q_discretize_project(spark, sf):
    li = X.read(spark, sf, "lineitem")
    binned = Z.bucketize(li, l_splits(spark, sf))
    return Z.discretize_project(binned, "l_returnflag", L_KEEP + L_DISC, L_DISC)


@register("splits_manifest",
          f"SELECT \"column\", 10 AS num_buckets, list(value ORDER BY split_idx) AS splits "
          f"FROM {sql_cuts(L_TRAIN, L_DISC)} GROUP BY 1")
def q_splits_manifest(spark, sf):
    return Z.splits_manifest(l_splits(spark, sf), 10, spark)


@register("splits_saved", "SELECT * FROM " + sql_cuts(L_TRAIN, L_DISC))
def q_splits_saved(spark, sf):
    """A fitted discretizer written as a table and read back."""
    path = scratch_path(spark, "discretizer")
    Z.save_splits(l_splits(spark, sf), 10, spark, path)
    back = Z.load_splits(spark, path)
    return spark.createDataFrame([(c, i, v) for c, vs in back.items() for i, v in enumerate(vs)],
                                 "column string, split_idx int, value double")


@register("manifest_json",
          f"SELECT list(DISTINCT \"column\" ORDER BY \"column\") AS columns_binned, 10 AS num_buckets, count(*) AS n_splits, "
          f"sum(value) FILTER (NOT isinf(value)) AS total FROM {sql_cuts(L_TRAIN, L_DISC)}")
def q_manifest_json(spark, sf):
    """The JSON manifest written and read back; ±∞ are JSON strings."""
    path = scratch_path(spark, "manifest")
    Z.write_manifest(l_splits(spark, sf), 10, spark, path)
    back = spark.read.schema("columns_binned array<string>, num_buckets int, splits map<string,array<string>>").json(path)
    one = back.select("columns_binned", "num_buckets", F.explode(F.flatten(F.map_values("splits"))).alias("v"))
    x = F.col("v").cast("double")
    return one.groupBy("columns_binned", "num_buckets").agg(
        F.count("*").alias("n_splits"), F.sum(F.when(F.abs(x) < float("inf"), x)).alias("total"))


# Columns of the dirty string table that the reference would discretize.
DIRTY_DISC = ["Dst Port", "Flow Pkts/s", "Flow IAT Min", "Fwd IAT Min", "Idle Std"]


def sql_plain_cast(name):
    """Spark's try_cast of a string to double in DuckDB: white space trimmed, +inf accepted."""
    c = f"trim(CAST({g.qi(name, 'duckdb')} AS VARCHAR))"
    return f"TRY_CAST(CASE WHEN starts_with({c}, '+') THEN substr({c}, 2) ELSE {c} END AS DOUBLE)"


def _dirty(where="TRUE"):
    cols = ", ".join(f"{sql_plain_cast(c)} AS {g.qi(c, 'duckdb')}" for c in DIRTY_DISC)
    return f"(SELECT {cols}, CAST(NULL AS DOUBLE) AS nothing FROM dl WHERE {where})"


def dirty_frame(spark, sf):
    """All-string columns with NaN, ∞, blanks, words and NULLs, and a column of NULLs; written
    once, as fitting cuts reads them several times."""
    return cut_lineage(X.dirty_lineitem(spark, sf).select(*[F.col(f"`{c}`") for c in DIRTY_DISC],
                                                          F.lit(None).cast("string").alias("nothing")), "dirty")


DIRTY_ALL = [*DIRTY_DISC, "nothing"]
DIRTY_CTE = "WITH dl AS (" + X.dirty_lineitem_sql() + ") "


@register("quantile_cuts_dirty", DIRTY_CTE + "SELECT * FROM " + sql_cuts(_dirty(), DIRTY_ALL))
def q_quantile_cuts_dirty(spark, sf):
    return Z.quantile_cuts(dirty_frame(spark, sf), DIRTY_ALL, num_buckets=10)


@register("bucketize_dirty",
          DIRTY_CTE + f", src AS {_dirty()}, cuts AS {sql_cuts('src', DIRTY_ALL)}, binned AS (SELECT "
          + ", ".join(f"{sql_bucket(c)} AS {g.qi(c + '__binned', 'duckdb')}" for c in DIRTY_ALL) + " FROM src) "
          + "SELECT *, count(*) AS n FROM binned GROUP BY ALL")
def q_bucketize_dirty(spark, sf):
    df = dirty_frame(spark, sf)
    binned = Z.bucketize(df, Z.fit_splits(df, DIRTY_ALL)).drop(*DIRTY_ALL)
    return binned.groupBy(*[F.col(f"`{c}__binned`") for c in DIRTY_ALL]).agg(F.count("*").alias("n"))


CSD_KEYS = ["Dst Port", "Fwd IAT Min", "Idle Std"]  # still strings after cleaning
CSD_U = g.u("duckdb", 13, "csd.split", *[g.qi(c, "duckdb") for c in CSD_KEYS])


def _csd_sql():
    from .queries_clean import sql_clean
    cast = ", ".join(f"{sql_plain_cast(c)} AS {g.qi(c, 'duckdb')}" for c in DIRTY_DISC)
    return (DIRTY_CTE + f", sp AS (SELECT *, {CSD_U} < 0.8 AS is_train FROM {sql_clean('dl')}), "
            f"src AS (SELECT is_train, CASE WHEN \"Label\" = 'Benign' THEN 'Benign' ELSE 'Attack' END AS \"Target\", {cast} FROM sp), "
            f"cuts AS {sql_cuts('(SELECT * FROM src WHERE is_train)', DIRTY_DISC)}, binned AS (SELECT is_train, \"Target\", "
            + ", ".join(f"{sql_bucket(c)} AS {g.qi(c + '__binned', 'duckdb')}" for c in DIRTY_DISC)
            + " FROM src) SELECT *, count(*) AS n FROM binned GROUP BY ALL")


@register("clean_split_discretize", _csd_sql())
def q_clean_split_discretize(spark, sf):
    """The whole path on the dirty table: clean, binarize, split, fit cuts on the
    train rows, bucketize both splits, project."""
    from ..operators import clean as C
    from .queries_clean import dl_clean_input
    df = S.binarize_target(C.clean_pipeline(dl_clean_input(spark, sf)))
    df = df.withColumn("is_train", uniform(13, "csd.split", *[F.col(f"`{c}`") for c in CSD_KEYS]) < F.lit(0.8))
    df = cut_lineage(df.select("is_train", "Target", *[F.col(f"`{c}`") for c in DIRTY_DISC]), "clean_split")
    out = Z.bucketize(df, Z.fit_splits(df.filter("is_train"), DIRTY_DISC))
    names = [f"{c}__binned" for c in DIRTY_DISC]
    return out.groupBy("is_train", "Target", *[F.col(f"`{c}`") for c in names]).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ prepare / score / tree
from ..operators import masks as M  # noqa: E402
from ..operators import metrics as ME  # noqa: E402
from ..operators import prepare as PR  # noqa: E402
from ..operators import tree as TR  # noqa: E402
from . import sql_tree as ST  # noqa: E402
from .queries_clean import DL_CTE, NUMERIC  # noqa: E402

D_SPLIT_U = g.u("duckdb", 13, "split", "doc_id")


def d_is_train():
    return uniform(13, "split", F.col("doc_id")) < F.lit(0.8)


@register("impute_zero",
          DL_CTE + "SELECT \"Label\", " + ", ".join(f"{ST.impute(n)} AS {g.qi(n, 'duckdb')}" for n in NUMERIC)
          + " FROM dl")
def q_impute_zero(spark, sf):
    df = X.dirty_lineitem(spark, sf).select("Label", *[F.col(f"`{n}`") for n in NUMERIC])
    return PR.impute_zero(df, NUMERIC)


@register("assemble_features",
          "WITH d AS (" + X.doc_features_sql() + ") SELECT doc_id, ["
          + ", ".join(ST.impute(c) for c in X.D_FEATURES) + "] AS features FROM d")
def q_assemble_features(spark, sf):
    d = PR.impute_zero(X.doc_features(spark, sf), X.D_FEATURES)
    return PR.to_array(PR.assemble_vector(d, X.D_FEATURES)).select("doc_id", "features")


@register("label_index",
          f"WITH d AS ({X.doc_features_sql()}) SELECT \"Target\" AS label, "
          f"CAST(row_number() OVER (ORDER BY count(*) DESC, \"Target\") - 1 AS DOUBLE) AS label_idx "
          f"FROM d WHERE {D_SPLIT_U} < 0.8 AND \"Target\" IS NOT NULL GROUP BY \"Target\"")
def q_label_index(spark, sf):
    d = X.doc_features(spark, sf).filter(d_is_train())
    return PR.label_index(d, "Target")


_CACHE: dict = {}


def d_tree(spark, sf, depth=1):
    """Prepared documents table + the depth-``depth`` trees of the hashed
    population (cached per session/sf so several keys share one fit)."""
    key = (spark.sparkContext.applicationId, sf, depth)
    if key not in _CACHE:
        from .runs import docs
        base = (*key[:2], "data")
        if base not in _CACHE:
            _CACHE[base] = TR.prepare_tree_data(docs(spark, sf), X.D_FEATURES, "Target", d_is_train())
        data = _CACHE[base]
        pop = M.random_masks(spark, ST.POP, ST.N, ST.P_INIT, ST.SEED)
        cands = TR.dense_candidates(pop)
        nodes = TR.grow_trees(data, cands.select("cand", "feats"), depth, ST.POP)
        _CACHE[key] = (data, cands, nodes)
    return _CACHE[key]


@register("tree_histogram", ST.with_all() + "SELECT cand, node, f, b, c0, c1 FROM hist")
def q_tree_histogram(spark, sf):
    data, cands, _ = d_tree(spark, sf)
    return TR.root_histogram(data, cands.select("cand", "feats")).select("cand", "node", "f", "b", "c0", "c1")  # no NULL label here


@register("tree_fit_batched", ST.with_all() + """
SELECT cand, 1 AS node, 0 AS depth, n, CASE WHEN is_split THEN f END AS f, CASE WHEN is_split THEN b END AS b,
       CASE WHEN is_split THEN gain END AS gain, root_pred AS pred FROM model
UNION ALL SELECT cand, 2, 1, l0 + l1, NULL, NULL, NULL, left_pred FROM model WHERE is_split
UNION ALL SELECT cand, 3, 1, (t0 - l0) + (t1 - l1), NULL, NULL, NULL, right_pred FROM model WHERE is_split""")
def q_tree_fit_batched(spark, sf):
    _, _, nodes = d_tree(spark, sf)
    return nodes.select("cand", "node", "depth", "n", "f", "b", "gain", "pred")


@register("tree_predict", ST.with_all() + "SELECT cand, label, prediction FROM pred")
def q_tree_predict(spark, sf):
    data, _, nodes = d_tree(spark, sf)
    return TR.predict(data, nodes, 1, ST.POP)


NULL_LABEL = f"({g.u('duckdb', 13, 'null_label', 'doc_id')}) < 0.15"


@register("tree_null_labels",
          "WITH " + ST.base_ctes().replace('SELECT doc_id, "Target",', f'SELECT doc_id, CASE WHEN {NULL_LABEL} THEN NULL ELSE "Target" END AS "Target",', 1)
          + ", c AS (SELECT count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1, count(*) FILTER (label = 2) AS c2 "
          "FROM rows WHERE is_train) SELECT 0 AS cand, 1 AS node, c0 + c1 + c2 AS n, [c0, c1, c2] AS counts, "
          "CAST(CASE WHEN c2 > c0 AND c2 > c1 THEN 2 WHEN c1 > c0 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM c")
def q_tree_null_labels(spark, sf):
    """NULL labels are a class of their own in the fit: the root counts every train row."""
    from .runs import docs
    hidden = uniform(13, "null_label", F.col("doc_id")) < F.lit(0.15)
    df = docs(spark, sf).withColumn("Target", F.when(~hidden, F.col("Target")))
    data = TR.prepare_tree_data(df, X.D_FEATURES, "Target", d_is_train())
    cands = spark.createDataFrame([(0, list(range(len(X.D_FEATURES))))], "cand int, feats array<int>")
    return TR.grow_trees(data, cands, 1).filter("node = 1").select("cand", "node", "n", "counts", "pred")


@register("confusion_matrix", ST.with_all() + "SELECT cand, label, prediction, count FROM conf")
def q_confusion_matrix(spark, sf):
    data, _, nodes = d_tree(spark, sf)
    return ME.confusion_matrix(TR.predict(data, nodes, 1, ST.POP), by=["cand"])


@register("classification_metrics", ST.with_all() + "SELECT * FROM met")
def q_classification_metrics(spark, sf):
    data, _, nodes = d_tree(spark, sf)
    return ME.classification_metrics(TR.predict(data, nodes, 1, ST.POP), by=["cand"])


@register("feature_importance", ST.with_all() + "SELECT cand, f AS feature_idx, CAST(1.0 AS DOUBLE) AS importance FROM model WHERE is_split")
def q_feature_importance(spark, sf):
    _, _, nodes = d_tree(spark, sf)
    return TR.importances(nodes, X.D_FEATURES)


@register("population_fitness", ST.with_all() + f"""
SELECT c.member, CAST(len(c.feats) AS INTEGER) AS k, m.f1,
       CASE WHEN len(c.feats) = 0 THEN -1.0 ELSE m.f1 - {ST.LAM} * len(c.feats) / {float(ST.N)} END AS obj
FROM cands c JOIN met m USING (cand)""")
def q_population_fitness(spark, sf):
    from ..operators import fitness as FT
    data = d_tree(spark, sf)[0]
    pop = M.random_masks(spark, ST.POP, ST.N, ST.P_INIT, ST.SEED)
    return FT.population_fitness(pop, data, max_depth=1, lam=ST.LAM).select("member", "k", "f1", "obj")


# ------------------------------------------------------------------ trees below the root

@register("tree_fit_d2", ST.with_depth(2) + "SELECT cand, node, depth, n, f, b, gain, pred FROM nodes")
def q_tree_fit_d2(spark, sf):
    _, _, nodes = d_tree(spark, sf, 2)
    return nodes.select("cand", "node", "depth", "n", "f", "b", "gain", "pred")


@register("tree_predict_d3", ST.with_depth(3) + "SELECT cand, label, prediction FROM pred")
def q_tree_predict_d3(spark, sf):
    data, _, nodes = d_tree(spark, sf, 3)
    return TR.predict(data, nodes, 3, ST.POP)


@register("feature_importance_d3", ST.with_depth(3) + """
SELECT cand, f AS feature_idx, round(sum(gain * n) / sum(sum(gain * n)) OVER (PARTITION BY cand), 9) AS importance
FROM nodes WHERE f IS NOT NULL GROUP BY cand, f""")
def q_feature_importance_d3(spark, sf):
    _, _, nodes = d_tree(spark, sf, 3)
    return TR.importances(nodes, X.D_FEATURES).withColumn("importance", F.round("importance", 9))


@register("population_fitness_d3", ST.with_depth(3) + f"""
SELECT c.member, CAST(len(c.feats) AS INTEGER) AS k, m.f1, m.accuracy, m.macro_f1,
       CASE WHEN len(c.feats) = 0 THEN -1.0 ELSE m.f1 - {ST.LAM} * len(c.feats) / {float(ST.N)} END AS obj
FROM cands c JOIN met m USING (cand)""")
def q_population_fitness_d3(spark, sf):
    from ..operators import fitness as FT
    data = d_tree(spark, sf)[0]
    pop = M.random_masks(spark, ST.POP, ST.N, ST.P_INIT, ST.SEED)
    return FT.population_fitness(pop, data, max_depth=3, lam=ST.LAM).select("member", "k", "f1", "accuracy", "macro_f1", "obj")


@register("subset_entropy", "WITH " + ST.base_ctes() + ",\n" + ST.pop_ctes() + """,
cell AS (SELECT c.member, r.label, list_transform(c.feats, lambda f: r.bins[f + 1] // 8) AS cell, count(*) AS n
  FROM rows r JOIN cands c ON TRUE WHERE r.is_train GROUP BY ALL),
given AS (SELECT member, label, n, -n * log2(n / sum(n) OVER (PARTITION BY member, cell)) AS bits FROM cell),
per AS (SELECT member, label, sum(n) AS n, sum(bits) AS bits FROM given GROUP BY ALL),
own AS (SELECT member, bits, -n * log2(n / sum(n) OVER (PARTITION BY member)) AS alone FROM per)
SELECT member, round(1 - sum(bits) / sum(alone), 6) + 0.0 AS score FROM own GROUP BY member""")
def q_subset_entropy(spark, sf):
    """Closed-form score of the hashed population's masks: what share of the label's entropy they explain."""
    from ..operators import fitness as FT
    rows = M.random_masks(spark, ST.POP, ST.N, ST.P_INIT, ST.SEED).collect()  # population-sized
    scores = FT.entropy_scores(spark, [tuple(r["mask"]) for r in rows], d_tree(spark, sf)[0])
    return spark.createDataFrame([(r["member"], scores[tuple(r["mask"])]) for r in rows], "member int, score double")


_GAIN = "WITH " + ST.base_ctes() + f""",
cell AS (SELECT feature_idx, bin, label, count(*) AS n FROM (SELECT unnest(bins) AS bin, label,
  unnest(list_transform(range({ST.N}), lambda i: CAST(i AS INTEGER))) AS feature_idx FROM rows WHERE is_train) GROUP BY ALL),
given AS (SELECT feature_idx, label, n, -n * log2(n / sum(n) OVER (PARTITION BY feature_idx, bin)) AS bits FROM cell),
per AS (SELECT feature_idx, label, sum(n) AS n, sum(bits) AS bits FROM given GROUP BY ALL),
own AS (SELECT feature_idx, n, bits, -n * log2(n / sum(n) OVER (PARTITION BY feature_idx)) AS alone FROM per),
gain AS (SELECT feature_idx, round((sum(alone) - sum(bits)) / sum(n), 6) + 0.0 AS eta FROM own GROUP BY feature_idx)
"""


def d_gain(spark, sf):
    from ..operators.search import aco as ACO
    return ACO.information_gain(d_tree(spark, sf)[0].rows.filter("is_train"))


@register("aco_heuristic", _GAIN + "SELECT feature_idx, eta FROM gain")
def q_aco_heuristic(spark, sf):
    """Information gain of every feature over the train rows."""
    return d_gain(spark, sf)


@register("aco_probabilities_beta", _GAIN + """,
sc AS (SELECT feature_idx, greatest(pow(1.0 + feature_idx / 8.0, 1.0) * pow(eta, 0.5), 1e-12) AS score FROM gain)
SELECT feature_idx, least(greatest(0.6 * (score / (SELECT max(score) FROM sc)), 1e-6), 1 - 1e-6) AS p FROM sc""")
def q_aco_probabilities_beta(spark, sf):
    """Inclusion probabilities where pheromone, heuristic (beta 0.5) and the strongest feature's share all count."""
    from ..operators.search import aco as ACO
    gain = d_gain(spark, sf)
    pher = ACO.heuristic_pheromone(gain, gain).withColumn("tau", 1.0 + F.col("feature_idx") / 8.0)
    return ACO.probabilities(pher, 1.0, 0.5, 0.6)


@register("majority_baseline", "WITH " + ST.base_ctes() + """,
conf AS (SELECT CAST(label AS DOUBLE) AS label, 0.0 AS prediction, count(*) AS count FROM rows WHERE NOT is_train GROUP BY 1),
act AS (SELECT label AS cls, sum(count) AS support, sum(CASE WHEN label = prediction THEN count ELSE 0 END) AS tp FROM conf GROUP BY 1),
per AS (SELECT a.cls, a.support, a.tp, CASE WHEN a.cls = 0.0 THEN a.tp / (SELECT sum(count) FROM conf) ELSE 0.0 END AS prec,
               a.tp / a.support AS rec FROM act a),
per2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1c FROM per)
SELECT sum(tp) / sum(support) AS accuracy, sum(f1c * support) / sum(support) AS f1,
       sum(prec * support) / sum(support) AS "weightedPrecision", sum(rec * support) / sum(support) AS "weightedRecall",
       avg(f1c) AS macro_f1 FROM per2""")
def q_majority_baseline(spark, sf):
    data = d_tree(spark, sf)[0]
    r = data.rows.select(F.col("label").cast("double").alias("label"), "is_train")
    return ME.majority_baseline(r.filter("is_train"), r.filter("not is_train"))
