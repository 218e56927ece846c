"""Quantile discretizer: cut points fit on train, bucketize train and test.

Cut points follow Spark's QuantileDiscretizer: probabilities j/B for
j = 0..B, the end points replaced by −∞/+∞, duplicates removed; NULL and
NaN are ignored when fitting.  The quantile at p is the value of rank
⌈p·n⌉ among the n non-NULL, non-NaN values.

``exact=True`` (default) returns exactly that value, at any scale, by counting:

1. one aggregation finds each column's count and finite range;
2. each round cuts the interval that holds a wanted rank into ``CELLS`` cells and counts
   values per (column, interval, cell), with each cell's smallest and largest value (cells are
   equal in the logarithm where an interval spans magnitudes); the
   cell of the wanted rank is the next interval, and a cell with one distinct value ends
   the search.

Counts merge map-side, a round returns at most columns x buckets x CELLS short rows
to as many reduce groups, and no sketch, window or single reducer is involved.  A hot value
(say a third of all rows equal to 0) is one counter.  −∞ and +∞ are counted beside the
cells.  Strings are cast tolerantly (``try_cast``).

``exact=False`` is the reference's one-pass sketch (relative error).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col

NEG_INF, POS_INF = float("-inf"), float("inf")


CELLS = 4096


def _splits_from_cuts(cuts: list) -> list:
    vals = [NEG_INF] + [c + 0.0 for c in cuts] + [POS_INF]
    out = []
    for v in vals:
        if not out or v != out[-1]:
            out.append(v)
    return sorted(set(out))


def quantile_cuts(df: DataFrame, cols: list, num_buckets: int = 10,
                  relative_error: float = 0.001, exact: bool = True) -> DataFrame:
    """Fit cut points.  Returns ``(column, split_idx, value)`` — the full
    Bucketizer split array per column, −∞ … +∞."""
    splits = fit_splits(df, cols, num_buckets, relative_error, exact)
    rows = [(c, i, v) for c in cols for i, v in enumerate(splits[c])]
    return df.sparkSession.createDataFrame(rows, "column string, split_idx int, value double")


def fit_splits(df: DataFrame, cols: list, num_buckets: int = 10,
               relative_error: float = 0.001, exact: bool = True) -> dict:
    probs = [j / num_buckets for j in range(1, num_buckets)]
    xs = df.select(*[F.when(~F.isnan(col(c).try_cast("double")), col(c).try_cast("double")).alias(f"__x{i}")
                     for i, c in enumerate(cols)])
    if not exact:
        acc = max(1, int(round(1.0 / relative_error)))
        aggs = [F.count(f"__x{i}").alias(f"n{i}") for i in range(len(cols))] + \
            [F.percentile_approx(f"__x{i}", probs, acc).alias(f"p{i}") for i in range(len(cols))]
        r = xs.agg(*aggs).first()
        return {c: (_splits_from_cuts(list(r[f"p{i}"])) if r[f"n{i}"] else [NEG_INF, POS_INF])
                for i, c in enumerate(cols)}

    finite = [F.when(F.abs(f"__x{i}") < F.lit(POS_INF), F.col(f"__x{i}")) for i in range(len(cols))]
    first = xs.agg(*[a for i in range(len(cols)) for a in (
        F.count(f"__x{i}").alias(f"n{i}"), F.count_if(F.col(f"__x{i}") == NEG_INF).alias(f"lo{i}"),
        F.count(finite[i]).alias(f"f{i}"), F.min(finite[i]).alias(f"a{i}"), F.max(finite[i]).alias(f"b{i}"))]).first() \
        if cols else None
    cuts = {i: {} for i in range(len(cols))}
    # (column, low, high) -> [(quantile, rank among the finite values of the interval)]
    open_: dict = {}
    for i in range(len(cols)):
        n, low, fin = (int(first[f"{k}{i}"]) for k in ("n", "lo", "f"))
        for j, p in enumerate(probs) if n else ():
            rank = math.ceil(p * n)
            if rank <= low or rank > low + fin:
                cuts[i][j] = NEG_INF if rank <= low else POS_INF
            else:
                open_.setdefault((i, first[f"a{i}"], first[f"b{i}"]), []).append((j, rank - low))
    while open_:
        found, wanted = _count_cells(xs, len(cols), list(open_)), {}
        for key, targets in open_.items():
            i, lo, hi = key
            cells = found[key]
            for j, rank in targets:
                below = 0
                for n, x, y in cells:
                    if below + n >= rank:
                        break
                    below += n
                if x == y:
                    cuts[i][j] = x
                else:
                    wanted.setdefault((i, x, y), []).append((j, rank - below))
        open_ = wanted
    return {c: (_splits_from_cuts([cuts[i][j] for j in range(len(probs))]) if cuts[i] else [NEG_INF, POS_INF])
            for i, c in enumerate(cols)}


def _wide(lo: float, hi: float) -> bool:
    """Whether an interval spans magnitudes, so that equal cells would be filled unequally."""
    return lo < hi and (lo <= 0 <= hi or max(abs(lo), abs(hi)) / 16 > min(abs(lo), abs(hi)))


def _magnitude(x):
    """Ascends with x, by one for each doubling."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


def _count_cells(xs: DataFrame, n_cols: int, intervals: list) -> dict:
    """{interval: [(count, least, largest value) of its cells, in order]}."""
    kind = "array<struct<k:int,lo:double,hi:double,log:boolean>>"
    of = [F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(_wide(lo, hi)).alias("log"))
                    for k, (i, lo, hi) in enumerate(intervals) if i == c]).cast(kind) for c in range(n_cols)]
    long = xs.select(F.posexplode(F.array(*[F.col(f"__x{c}") for c in range(n_cols)])).alias("c", "x")) \
        .filter(F.col("x").isNotNull())
    inside = F.filter(F.array(*of)[F.col("c")], lambda v: (F.col("x") >= v["lo"]) & (F.col("x") <= v["hi"]))
    at = long.select("x", F.explode(inside).alias("v")) \
        .select("x", "v", *[F.when(F.col("v.log"), _magnitude(c)).otherwise(c / 2).alias(n)  # halves cannot overflow
                            for n, c in (("gx", F.col("x")), ("gl", F.col("v.lo")), ("gh", F.col("v.hi")))])
    share = (F.col("gx") - F.col("gl")) / (F.col("gh") - F.col("gl"))
    cell = F.when(F.col("v.hi") > F.col("v.lo"), F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0))
    rows = at.select(F.col("v.k").alias("k"), cell.cast("int").alias("cell"), "x").groupBy("k", "cell") \
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    out: dict = {v: [] for v in intervals}
    for r in sorted(rows, key=lambda r: (r["k"], r["cell"])):
        out[intervals[r["k"]]].append((int(r["n"]), r["lo"], r["hi"]))
    return out


def bucket_expr(x, splits: list):
    """Bucketizer(handleInvalid='keep') as a column expression: [lo, hi)
    buckets, +∞ in the last one, NaN → extra bucket, NULL → NULL."""
    inner = F.array(*[F.lit(float(v)) for v in splits[1:-1]]) if len(splits) > 2 else F.array().cast("array<double>")
    nb = len(splits) - 1
    xd = x.try_cast("double")
    return (F.when(xd.isNull(), F.lit(None).cast("double"))
            .when(F.isnan(xd), F.lit(float(nb)))
            .otherwise(F.size(F.filter(inner, lambda s: s <= xd)).cast("double")))


def bucketize(df: DataFrame, splits: dict, suffix: str = "__binned") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": bucket_expr(col(c), s) for c, s in splits.items()})


def splits_from_table(cuts: DataFrame) -> dict:
    """Collect a (column, split_idx, value) table — columns × buckets rows."""
    out: dict = {}
    for r in cuts.orderBy("column", "split_idx").collect():
        out.setdefault(r["column"], []).append(r["value"])
    return out


def discretize_project(df: DataFrame, label: str, features: list, binned: list,
                       suffix: str = "__binned") -> DataFrame:
    """label + non-binned features + ``<c>__binned`` (originals dropped)."""
    keep = [label] + [c for c in features if c not in binned] + [f"{c}{suffix}" for c in binned]
    return df.select(*[col(c) for c in keep])


def save_splits(splits: dict, num_buckets: int, spark, path: str) -> None:
    """Persist a fitted discretizer as a table (column, split_idx, value, num_buckets)."""
    rows = [(c, i, float(v), num_buckets) for c, vs in splits.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "column string, split_idx int, value double, num_buckets int") \
        .write.mode("overwrite").parquet(path)


def load_splits(spark, path: str) -> dict:
    return splits_from_table(spark.read.parquet(path))


def splits_manifest(splits: dict, num_buckets: int, spark) -> DataFrame:
    """One row per binned column: (column, num_buckets, splits)."""
    rows = [(c, num_buckets, [float(v) for v in s]) for c, s in splits.items()]
    return spark.createDataFrame(rows, "column string, num_buckets int, splits array<double>")


def write_manifest(splits: dict, num_buckets: int, spark, path: str) -> None:
    """The cut-point manifest as one JSON object {columns_binned, num_buckets, splits}."""
    table = splits_manifest(splits, num_buckets, spark)
    entry = F.struct("column", "splits")
    table.agg(F.array_sort(F.collect_list("column")).alias("columns_binned"), F.max("num_buckets").alias("num_buckets"),
              F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("splits")) \
        .coalesce(1).write.mode("overwrite").json(path)
