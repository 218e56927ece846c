"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, shuffle_partitions

__all__ = ["cut_lineage", "scratch_path", "shuffle_partitions", "table", "groups_for", "batches",
           "slices", "tidy", "mix64", "gather_ranges", "let", "blocks", "running"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named table with just the columns an operator works on, so that
    extra columns, whatever their names, never reach it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def blocks(values: Column, size: int) -> Column:
    """The array cut into arrays of ``size`` elements, the last one shorter; an empty array has none."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(size))) \
        .otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(values, at, size))


def running(values: Column, add: Callable[[Column, Column], Column], size: int = 128) -> Column:
    """For each element of an array of longs, ``add`` over all elements before it, from 0.

    A fold that appends to an array copies it at every step.  Here folds run inside blocks of
    ``size`` elements and over one total a block, so that n elements copy about size * n +
    (n / size)^2 values instead of n^2."""
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("before"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(add(acc["total"], x).alias("total"),
                        F.concat(acc["before"], F.array(acc["total"])).alias("before"))

    def spread(folded: Column) -> Column:
        totals = F.aggregate(F.transform(folded, lambda b: b["total"]), zero, step)["before"]
        return F.flatten(F.zip_with(folded, totals, lambda b, t: F.transform(b["before"], lambda v: add(v, t))))

    return let(values, lambda v: let(F.transform(blocks(v, size), lambda b: F.aggregate(b, zero, step)), spread))


def groups_for(spark: SparkSession, rows: int, per_group: int) -> int:
    """Number of hash groups such that one holds about ``per_group`` rows; grows with the data."""
    return max(shuffle_partitions(spark), -(-rows // per_group))


def batches(it: Iterator, max_rows: int, max_chars: int, text: str) -> Iterator:
    """Cut pandas batches by rows and by total text length, so that one batch
    holds at most ``max_chars`` characters or a single longer row."""
    for pdf in it:
        if not len(pdf):
            continue
        size = pdf[text].str.len().fillna(0).to_numpy(np.int64)
        lo = 0
        total = 0
        for i, s in enumerate(size):
            if i > lo and (total + s > max_chars or i - lo >= max_rows):
                yield pdf.iloc[lo:i]
                lo, total = i, 0
            total += s
        yield pdf.iloc[lo:]


def slices(batch, text: int, max_rows: int, max_bytes: int) -> Iterator:
    """Cut an Arrow batch by rows and by the bytes of column ``text``; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, s in enumerate(size):
        if i > lo and (total + s > max_bytes or i - lo >= max_rows):
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += int(s)
    if batch.num_rows:
        yield batch.slice(lo)


def give_back() -> None:
    """Hands the free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others have no such call
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition, handing free memory back between batches and at the end, where ``forget``
    empties what it remembers.  Spark uses its Python workers again: what Arrow and malloc keep
    of one stage counts in the executor's memory during the next ones."""
    def whole(it):
        def each():
            for batch in it:
                yield batch
                del batch
                give_back()

        yield from run(each())
        forget()
        give_back()

    return whole


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser, vectorised over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, … of every range, ranges after one another."""
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return np.empty(0, np.int64)
    out = np.ones(int(lengths.sum()), np.int64)
    ends = np.cumsum(lengths)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a row number unique within the frame; write the frame before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def join_by_hot_key(left: DataFrame, right: DataFrame, key: list[str], weight: str, total: int,
                    share: int = 200) -> DataFrame:
    """Left join of ``left`` with ``right``, which has one row per key and in
    ``weight`` the key's number of rows in ``left`` (``total`` in all).  Keys
    with over 1/``share`` of the rows, fewer than ``share`` keys, are joined
    by broadcast; no task takes them whole.  The rest goes by shuffle."""
    value = [c for c in right.columns if c not in key]
    hot = right.filter(F.col(weight) * share > total)
    cold = right.filter(F.col(weight) * share <= total)
    one = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    first = one.filter("__hot").drop("__hot")
    rest = one.filter("__hot is null").drop("__hot", *value).join(cold, key, "left")
    return first.unionByName(rest.select(first.columns))
