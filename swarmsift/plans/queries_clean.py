"""Registered keys: cleaning, sources/sinks, label and split operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators import clean as C
from ..operators import split as S
from ..session import cut_lineage, scratch_path
from ..sources import csvio
from ..sources import fixtures as X
from ..sources.sqlgen import qi
from .registry import register

DL_CTE = "WITH dl AS (" + X.dirty_lineitem_sql() + ") "
NUMERIC = [n for n, _ in X.DL_NUMERIC]
INF_SQL = "('inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity')"


def _d(name):
    return qi(name, "duckdb")


def sql_tolerant(name):
    c = _d(name)
    return f"TRY_CAST(CASE WHEN lower(CAST({c} AS VARCHAR)) IN {INF_SQL} THEN NULL ELSE {c} END AS DOUBLE)"


def sql_step(prev, name, cond):
    """One tolerant-cast + filter step as a DuckDB subquery."""
    c = _d(name)
    return f"(SELECT * FROM (SELECT * REPLACE ({sql_tolerant(name)} AS {c}) FROM {prev}) WHERE {cond.format(c=c)})"


def sql_clean(source, spec=None, present=None):
    spec = spec or C.CleanSpec()
    present = set(present) if present is not None else {n for n, _ in X.dirty_lineitem_exprs("duckdb")}
    drop = [n for n in spec.drop if n in present] + ["__file"]
    cur = f"(SELECT * EXCLUDE ({', '.join(_d(n) for n in drop)}) FROM {source})"
    for n in spec.nonneg:
        if n in present:
            cur = sql_step(cur, n, "{c} IS NULL OR {c} >= 0")
    for n in spec.nonzero:
        if n in present:
            cur = sql_step(cur, n, "{c} IS NULL OR {c} != 0")
    for n in spec.not_nan:
        if n in present:
            cur = sql_step(cur, n, "{c} IS NULL OR NOT isnan({c})")
    if spec.drop_null_critical:
        # DataFrame.na.drop drops NULL *and* NaN
        conds = " AND ".join(f"{_d(n)} IS NOT NULL AND NOT isnan({_d(n)})" for n in spec.critical if n in present)
        cur = f"(SELECT * FROM {cur} WHERE {conds})"
    return cur


_DL: dict = {}


def session_key(spark):
    """Identifies a session's application; object ids are reused, these are not."""
    return spark.sparkContext.applicationId


def dl(spark, sf):
    """The dirty string view stands in for a raw CSV scan: it is written
    once per session (parquet under the checkpoint folder, a file for each
    task of the scan: no shuffle) so the cleaning plans run over a plain scan."""
    key = (session_key(spark), sf)
    if key not in _DL:
        _DL[key] = cut_lineage(X.dirty_lineitem(spark, sf), "dl")
    return _DL[key]


def dl_clean_input(spark, sf):
    return dl(spark, sf).drop("__file")


# ------------------------------------------------------------------ sources

@register("csv_union_by_name",
          # a CSV field that is empty reads back as NULL
          DL_CTE + "SELECT nullif(COLUMNS(*), '') FROM (SELECT * EXCLUDE (__file) FROM (SELECT * EXCLUDE ("
          + ", ".join(_d(n) for n in X.DL_ONLY_B) + ") FROM dl WHERE __file = 'a' AND \"Label\" != 'Label') "
          "UNION ALL BY NAME SELECT * EXCLUDE (__file) FROM (SELECT * EXCLUDE ("
          + ", ".join(_d(n) for n in X.DL_ONLY_A) + ") FROM dl WHERE __file = 'b' AND \"Label\" != 'Label'))")
def q_csv_union_by_name(spark, sf):
    """Write DL as two CSV files with different columns (file b: reversed
    column order, header names padded with spaces), then scan them back:
    per-file header read, name trim, header-row filter, union by name."""
    base = scratch_path(spark, "dl_csv")
    paths = csvio.write_two_flow_files(dl(spark, sf), base, X.DL_ONLY_A, X.DL_ONLY_B)
    return csvio.read_flow_csvs(spark, paths)


@register("csv_sink_roundtrip", "SELECT * FROM lineitem")
def q_csv_sink_roundtrip(spark, sf):
    li = X.read(spark, sf, "lineitem")
    path = scratch_path(spark, "lineitem_csv")
    csvio.write_csv(li, path)
    return csvio.read_csv_typed(spark, path, li.schema)


@register("parquet_sink_roundtrip", "SELECT * FROM lineitem")
def q_parquet_sink_roundtrip(spark, sf):
    li = X.read(spark, sf, "lineitem")
    path = scratch_path(spark, "lineitem_parquet")
    csvio.write_parquet(li, path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ cleaning

@register("repeated_header_filter",
          DL_CTE + "SELECT * EXCLUDE (__file) FROM dl WHERE \"Label\" != 'Label'")
def q_repeated_header_filter(spark, sf):
    return C.repeated_header_filter(dl_clean_input(spark, sf))


@register("drop_columns",
          DL_CTE + "SELECT * EXCLUDE (__file, " + ", ".join(_d(n) for n, _ in X.DL_DROPPED) + ") FROM dl")
def q_drop_columns(spark, sf):
    return C.drop_columns(dl_clean_input(spark, sf))


@register("try_cast_double",
          DL_CTE + "SELECT \"Label\", " + ", ".join(f"{sql_tolerant(n)} AS {_d(n)}" for n in NUMERIC) + " FROM dl")
def q_try_cast_double(spark, sf):
    df = dl_clean_input(spark, sf).select("Label", *[F.col(f"`{n}`") for n in NUMERIC])
    for n in NUMERIC:
        df = C.try_cast_double(df, n)
    return df


@register("filter_nonneg", "SELECT * FROM customer WHERE c_acctbal IS NULL OR c_acctbal >= 0")
def q_filter_nonneg(spark, sf):
    return C.filter_nonneg(X.read(spark, sf, "customer"), "c_acctbal")


@register("filter_nonzero",
          "SELECT * FROM lineitem WHERE (l_discount IS NULL OR l_discount != 0) AND (l_tax IS NULL OR l_tax != 0)")
def q_filter_nonzero(spark, sf):
    return C.filter_nonzero(C.filter_nonzero(X.read(spark, sf, "lineitem"), "l_discount"), "l_tax")


@register("filter_not_nan",
          DL_CTE + "SELECT * FROM " + sql_step(sql_step("(SELECT * EXCLUDE (__file) FROM dl)", "Flow Byts/s",
                                                        "{c} IS NULL OR NOT isnan({c})"),
                                               "Flow Pkts/s", "{c} IS NULL OR NOT isnan({c})"))
def q_filter_not_nan(spark, sf):
    df = dl_clean_input(spark, sf)
    for n in C.DEFAULT_NOT_NAN:
        df = C.filter_not_nan(df, n)
    return df


@register("clean_pipeline", DL_CTE + "SELECT * FROM " + sql_clean("dl"))
def q_clean_pipeline(spark, sf):
    return C.clean_pipeline(dl_clean_input(spark, sf))


@register("drop_null_critical",
          DL_CTE + "SELECT * FROM " + sql_clean("dl", C.CleanSpec(drop_null_critical=True)))
def q_drop_null_critical(spark, sf):
    return C.clean_pipeline(dl_clean_input(spark, sf), C.CleanSpec(drop_null_critical=True))


_n_cols = len(X.dirty_lineitem_exprs("duckdb")) - 1
_n_after = _n_cols - len(X.DL_DROPPED)


@register("clean_audit",
          DL_CTE + f"SELECT * FROM (VALUES (1, 'initial', (SELECT count(*) FROM dl), {_n_cols}), "
          f"(2, 'after_drop', (SELECT count(*) FROM dl), {_n_after}), "
          f"(3, 'after_filters', (SELECT count(*) FROM {sql_clean('dl')}), {_n_after})) "
          "AS t(stage, stage_name, n_rows, n_columns)")
def q_clean_audit(spark, sf):
    return C.clean_audit(dl_clean_input(spark, sf))


@register("label_distribution",
          DL_CTE + "SELECT \"Label\", count(*) AS count FROM " + sql_clean("dl")
          + " GROUP BY 1")
def q_label_distribution(spark, sf):
    return C.label_distribution(C.clean_pipeline(dl_clean_input(spark, sf)), "Label")


# ------------------------------------------------------------------ label / split

@register("binarize_target",
          DL_CTE + "SELECT \"Label\", CASE WHEN \"Label\" = 'Benign' THEN 'Benign' ELSE 'Attack' END AS \"Target\" FROM dl")
def q_binarize_target(spark, sf):
    return S.binarize_target(dl_clean_input(spark, sf).select("Label"))


_LK = ", ".join(X.LINEITEM_KEY)
_SPLIT_U = X.g.u("duckdb", 13, "split", *X.LINEITEM_KEY)


@register("split_train_test", f"SELECT {_LK}, {_SPLIT_U} < 0.8 AS is_train FROM lineitem")
def q_split_train_test(spark, sf):
    li = X.read(spark, sf, "lineitem").select(*X.LINEITEM_KEY)
    return S.split_flag(li, X.LINEITEM_KEY, seed=13, train_frac=0.8)


_BAL = (f"SELECT l_returnflag, NULLIF(count(*) FILTER (WHERE {_SPLIT_U} < 0.8), 0) AS train_count, "
        f"NULLIF(count(*) FILTER (WHERE NOT ({_SPLIT_U} < 0.8)), 0) AS test_count FROM lineitem GROUP BY 1")


@register("split_balance", _BAL)
def q_split_balance(spark, sf):
    li = S.split_flag(X.read(spark, sf, "lineitem"), X.LINEITEM_KEY, seed=13)
    return S.split_balance(li, "l_returnflag")


@register("split_balance_join", _BAL)
def q_split_balance_join(spark, sf):
    train, test = S.split_train_test(X.read(spark, sf, "lineitem"), X.LINEITEM_KEY, seed=13)
    return S.split_balance_join(train, test, "l_returnflag")


@register("bernoulli_sample",
          f"SELECT * FROM lineitem WHERE {X.g.u('duckdb', 13, 'sample', *X.LINEITEM_KEY)} < 0.2")
def q_bernoulli_sample(spark, sf):
    return S.bernoulli_sample(X.read(spark, sf, "lineitem"), X.LINEITEM_KEY, 0.2, seed=13)


@register("feature_table",
          "WITH d AS (" + X.doc_features_sql() + ") "
          + " UNION ALL ".join(f"SELECT {i} AS feature_idx, '{n}' AS name, count({n}) AS n_values FROM d"
                               for i, n in enumerate(X.D_FEATURES)))
def q_feature_table(spark, sf):
    return S.feature_table(X.doc_features(spark, sf), exclude=("Label", "Target", "doc_id"))


_FOLDER_SQL = (
    DL_CTE + "SELECT nullif(COLUMNS(*), '') FROM (SELECT * EXCLUDE (__file) FROM (SELECT * EXCLUDE ("
    + ", ".join(_d(n) for n in X.DL_ONLY_B) + ") FROM dl WHERE __file = 'a' AND \"Label\" != 'Label') "
    "UNION ALL BY NAME SELECT * EXCLUDE (__file) FROM (SELECT * EXCLUDE ("
    + ", ".join(_d(n) for n in X.DL_ONLY_A) + ") FROM dl WHERE __file = 'b' AND \"Label\" != 'Label'))")


@register("csv_folder_scan", _FOLDER_SQL)
def q_csv_folder_scan(spark, sf):
    """The same two files, found by listing their folder."""
    base = scratch_path(spark, "dl_folder")
    csvio.write_two_flow_files(dl(spark, sf), base, X.DL_ONLY_A, X.DL_ONLY_B)
    return csvio.read_flow_csvs(spark, csvio.list_csv_files(spark, base))


@register("csv_header_groups", _FOLDER_SQL)
def q_csv_header_groups(spark, sf):
    """The same rows in 24 files or more of three layouts (half of file a's rows in reversed column
    order): one scan for each layout.  Each task writes its own files; only a table read in fewer
    than eight tasks is dealt to eight."""
    base = scratch_path(spark, "dl_layouts")
    df = dl(spark, sf)
    spread = df.rdd.getNumPartitions() < 8
    half = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(2)) == 0
    cols = [c for c in df.columns if c != "__file"]
    a_cols = [c for c in cols if c not in X.DL_ONLY_B]
    b_cols = [c for c in cols if c not in X.DL_ONLY_A]
    layouts = {"a1": (df.filter((col("__file") == "a") & half), a_cols),
               "a2": (df.filter((col("__file") == "a") & ~half), a_cols[::-1]),
               "b": (df.filter(col("__file") == "b"), b_cols[::-1])}
    for name, (part, order) in layouts.items():
        part = part.select(*[col(c).alias(f" {c} ") for c in order])
        csvio.write_csv(part.repartition(8) if spread else part, f"{base}/{name}.csv")
    return csvio.read_flow_csvs(spark, csvio.list_csv_files(spark, base))


@register("csv_sink_8_files", "SELECT * FROM customer")
def q_csv_sink_8_files(spark, sf):
    """The reference's eight-file form of the CSV sink, read back."""
    df = X.read(spark, sf, "customer")
    path = scratch_path(spark, "customer_csv8")
    csvio.write_csv(df, path, num_files=8)
    return csvio.read_csv_typed(spark, path, df.schema)
