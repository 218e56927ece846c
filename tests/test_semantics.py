"""The NULL / NaN / infinity table (survey §1.1) on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from swarmsift.operators import clean as C
from swarmsift.operators import discretize as Z
from swarmsift.operators import prepare as PR
from swarmsift.operators import split as S

INF = float("inf")


@pytest.mark.parametrize("raw,expected", [
    ("inf", None), ("+inf", None), ("-Infinity", None), ("INFINITY", None),
    (" inf", INF),            # no trim before the spelling match: parses to +inf
    ("NaN", "nan"), ("nan", "nan"), ("-5", -5.0), ("0", 0.0), ("1e3", 1000.0),
    ("", None), ("abc", None), (None, None),
])
def test_tolerant_cast(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "x string")
    v = C.try_cast_double(df, "x").first()["x"]
    if expected == "nan":
        assert math.isnan(v)
    else:
        assert v == expected


def test_second_pass_turns_infinity_into_null(spark):
    df = spark.createDataFrame([(" inf",), ("NaN",), ("2",)], "x string")
    once = C.try_cast_double(df, "x")
    twice = [r["x"] for r in C.try_cast_double(once, "x").collect()]
    assert twice[0] is None and math.isnan(twice[1]) and twice[2] == 2.0


def test_filters_keep_null_and_nan(spark):
    df = spark.createDataFrame([(None,), ("NaN",), ("-1",), ("0",), ("3",)], "x string")
    assert C.filter_nonneg(df, "x").count() == 4          # NULL, NaN, 0, 3
    assert C.filter_nonzero(df, "x").count() == 4         # NULL, NaN, -1, 3
    assert C.filter_not_nan(df, "x").count() == 4         # all but NaN


def test_header_filter_drops_null_labels(spark):
    df = spark.createDataFrame([("Label",), (None,), ("Benign",), (" Label",)], "Label string")
    assert sorted(r[0] for r in C.repeated_header_filter(df).collect()) == [" Label", "Benign"]


def test_binarize_null_is_attack(spark):
    df = spark.createDataFrame([("Benign",), (None,), ("DoS",)], "Label string")
    assert [r["Target"] for r in S.binarize_target(df).collect()] == ["Benign", "Attack", "Attack"]


def test_impute_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (INF,), (-INF,), (None,), (2.5,)], "x double")
    assert [r["x"] for r in PR.impute_zero(df, ["x"]).collect()] == [0.0, 0.0, 0.0, 0.0, 2.5]


def test_bucketizer_keep(spark):
    splits = [-INF, 0.0, 5.0, INF]
    df = spark.createDataFrame([(float("nan"),), (INF,), (-INF,), (None,), (0.0,), (4.9,), (5.0,)], "x double")
    got = [r["b"] for r in df.select(Z.bucket_expr(F.col("x"), splits).alias("b")).collect()]
    assert got == [3.0, 2.0, 0.0, None, 1.0, 1.0, 2.0]


def test_duplicate_quantiles_collapse(spark):
    rows = [(0.0,)] * 90 + [(float(i),) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "x double")
    assert Z.fit_splits(df, ["x"], 10)["x"][:2] == [-INF, 0.0]
    const = spark.createDataFrame([(7.0,)] * 20, "x double")
    assert Z.fit_splits(const, ["x"], 10)["x"] == [-INF, 7.0, INF]
    empty = spark.createDataFrame([(None,)] * 3, "x double")
    assert Z.fit_splits(empty, ["x"], 10)["x"] == [-INF, INF]


def test_exact_quantiles_match_rank_rule(spark):
    vals = [float((i * 7919) % 1000) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    want = sorted({-INF, INF, *[s[math.ceil(j / 10 * len(s)) - 1] for j in range(1, 10)]})
    assert Z.fit_splits(df, ["x"], 10)["x"] == want


def test_label_index_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "y string")
    idx = {r["label"]: r["label_idx"] for r in PR.label_index(df, "y").collect()}
    assert idx == {"c": 0.0, "a": 1.0, "b": 2.0}
