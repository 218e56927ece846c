"""Steps whose disk or time grew faster than the tables: what is dealt, written and computed how often."""

import threading

from pyspark.sql import functions as F

from swarmsift.operators import clean as C
from swarmsift.plans import queries_clean as QC
from swarmsift.plans import queries_model as QM
from swarmsift.plans import runs
from swarmsift.sources import csvio
from swarmsift.sources import fixtures as X

from .conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dirty_table_is_written_without_a_shuffle(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(QC, "cut_lineage", lambda df, name: seen.append(plan(df)) or df)
    monkeypatch.setattr(QC, "_DL", {})
    QC.dl(spark, SF001)
    assert seen and "Exchange" not in seen[0]


def test_cuts_of_the_dirty_table_read_a_written_one(spark):
    assert all("/scratch/dirty" in f for f in QM.dirty_frame(spark, SF001).inputFiles())


def test_layouts_are_written_without_a_shuffle(spark, monkeypatch):
    seen = []
    names = [n for n, _ in X.dirty_lineitem_exprs("spark") if n != "__file"]
    big = spark.range(0, 90, 1, 9).select(*[F.lit("x").alias(n) for n in names], F.lit("a").alias("__file"))
    monkeypatch.setattr(QC, "dl", lambda *_: big)
    monkeypatch.setattr(QC, "cut_lineage", lambda df, name: df)
    monkeypatch.setattr(csvio, "write_csv", lambda df, path: seen.append(plan(df)))
    monkeypatch.setattr(csvio, "list_csv_files", lambda *_: [])
    monkeypatch.setattr(csvio, "read_flow_csvs", lambda *_: None)
    QC.q_csv_header_groups(spark, SF001)
    assert len(seen) == 3 and not any("Exchange" in p for p in seen)


def test_a_value_is_cast_once_for_each_filter(spark):
    df = spark.createDataFrame([("1",), (" inf",), ("inf",), ("x",), ("-1",), ("0",), ("nan",), (None,)], "a string")
    out = C.filter_not_nan(C.filter_nonzero(C.filter_nonneg(df, "a"), "a"), "a")
    assert sorted(map(str, (r["a"] for r in out.collect()))) == ["1.0", "None", "None", "None", "None"]
    condition = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x)
    assert condition.count("cast(") <= 3


def joins_above(df, column):
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    leaf = next(i for i, x in enumerate(lines) if "Relation" in x and column in x)
    at, count = depth[leaf], 0
    for i in range(leaf, -1, -1):
        if depth[i] < at:
            at = depth[i]
            count += lines[i].lstrip(" :+-").startswith("Join")
    return count


def test_lines_meet_three_tables_only(spark):
    """Parts, suppliers and orders, each with all that belongs to it."""
    df = X.wide_table(spark, SF001)
    leaves = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" in x and "l_orderkey" in x]
    assert leaves and joins_above(df, "l_orderkey") <= 3


def test_wide_rows_with_repeated_and_missing_keys(spark, tmp_path):
    import re
    keys = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "orders": ["o_orderkey", "o_custkey"], "part": ["p_partkey"],
            "supplier": ["s_suppkey", "s_nationkey"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey"]}
    for t, names in keys.items():
        df = X.read(spark, SF001, t).limit(10 if t != "lineitem" else 100)
        df = df.withColumns({k: F.when(F.xxhash64(*df.columns) % 11 != 0, (F.col(k) % 5).cast(df.schema[k].dataType)) for k in names})
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    sql, tables = X.wide_source(), {t: X.read(spark, str(tmp_path), t) for t in keys}
    for t in tables:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    want = X._render(spark, spark.sql(sql, **tables), X.w_exprs("spark"))
    got = X.wide_table(spark, str(tmp_path))
    total = [F.count("*"), F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)"))]
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.agg(*total).first() == want.agg(*total).first() and got.limit(1).count()


def test_searches_of_the_leaderboard_overlap(spark, monkeypatch):
    together = threading.Barrier(4, timeout=20)
    monkeypatch.setattr(runs, "wide", lambda *_: None)
    monkeypatch.setattr(runs, "search_data", lambda *_: None)
    monkeypatch.setattr(runs, "cached", lambda fn, *_: together.wait() and None or fn.__name__)
    names = ("algo", "subset_size", "accuracy", "f1", "weightedPrecision", "weightedRecall", "macro_f1",
             "elapsed_search_sec", "elapsed_finaltrain_sec")
    monkeypatch.setattr(runs, "report", lambda s, _, name: s.range(1).select(*[F.lit(name).alias(n) for n in names]))
    assert runs.q_leaderboard(spark, SF001).count() == 4


def test_lines_are_dealt_without_suppliers_and_once_by_part(spark):
    """columns of suppliers and a second deal of all lines, for the groupings of parts, filled the disk."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [x for x in plan(X.wide_table(spark, SF001)).split("\n") if x.strip()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    dealt = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(l_" in x or "Exchange hashpartitioning(part_key" in x]
    by_part = [i for i in dealt if "(l_partkey" in lines[i] or "(part_key" in lines[i]]
    by_order = next(i for i in dealt if "(l_orderkey" in lines[i] and any("l_shipdate" in x for x in lines[i:i + 3]))
    below = lines[by_order + 1:next((i for i in range(by_order + 1, len(lines)) if depth[i] <= depth[by_order]), len(lines))]
    assert len(by_part) == 1 and not any("s_acctbal" in x for x in below)
