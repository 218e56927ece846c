"""Shared pieces: dense member ids, neighbour moves, scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.rng import uniform
from ...session import cut_lineage
from ..masks import ensure_one_bit, greedy_accept, mask_size  # noqa: F401


def dense(pop: DataFrame, member: str = "member", out: str = "idx") -> DataFrame:
    """0..P-1 ids in member order without a one-task window: rows are range
    partitioned and sorted, numbered within their partition, written, and
    moved on by the number of rows in the partitions before (one row each)."""
    at = "__at"
    t = cut_lineage(pop.repartitionByRange(member).sortWithinPartitions(member)
                    .withColumn(at, F.monotonically_increasing_id()), "dense")
    part = F.shiftright(at, 33).cast("int")  # the id is partition << 33 | row
    sizes = {r["p"]: r["n"] for r in t.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.array(*[F.lit(b) for b in before or [0]])
    return t.withColumn(out, (offset[part] + F.col(at).bitwiseAND((1 << 33) - 1)).cast("int")).drop(at)


def running_sum(df: DataFrame, value: str, out: str, idx: str = "idx", block: int = 1024) -> DataFrame:
    """Sum of ``value`` up to and with each row in ``idx`` order (0..P-1): within
    blocks of ``block`` rows, plus the sums of the blocks before."""
    b = df.withColumn("__b", F.floor(F.col(idx) / block))
    sums = {r["__b"]: r["s"] for r in b.groupBy("__b").agg(F.sum(value).alias("s")).collect()}  # P / block rows
    before, total = [], 0.0
    for k in range(int(max(sums, default=-1)) + 1):
        before.append((k, total))
        total += sums.get(k, 0.0)
    offsets = df.sparkSession.createDataFrame(before, "__b long, __before double")
    w = Window.partitionBy("__b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn(out, F.sum(value).over(w)).join(offsets, "__b") \
        .withColumn(out, F.col("__before") + F.col(out)).drop("__b", "__before")


def other_index(i: Column, p: int, seed: int, tag: str, *keys) -> Column:
    """A uniformly random index ≠ i among p (the reference re-draws until
    different; this is the same distribution without a loop)."""
    off = F.floor(uniform(seed, tag, *keys) * F.lit(p - 1)).cast("int")
    return ((i + F.lit(1) + off) % F.lit(p)).cast("int")


def flip_at(mask: Column, j: Column) -> Column:
    return F.transform(mask, lambda b, i: F.when(i == j, F.lit(1) - b).otherwise(b))


def neighbour(x: Column, y: Column, n: int, seed: int, tag: str, *keys) -> Column:
    """ABC move: bit j ← partner's bit (50 %) or flipped; 10 % flip another
    bit; never empty."""
    j = F.floor(uniform(seed, tag + ".j", *keys) * F.lit(n)).cast("int")
    copy = uniform(seed, tag + ".c", *keys) < F.lit(0.5)
    v = F.transform(x, lambda b, i: F.when(i == j, F.when(copy, y[j]).otherwise(F.lit(1) - b)).otherwise(b))
    extra = uniform(seed, tag + ".p", *keys) < F.lit(0.1)
    k2 = F.floor(uniform(seed, tag + ".k", *keys) * F.lit(n)).cast("int")
    v = F.when(extra, flip_at(v, k2)).otherwise(v)
    return ensure_one_bit(v, n, seed, tag, *keys)


def pseudo_scorer(seed: int, tag: str, gen: int):
    """Hash-derived objective for step checks without fitting trees:
    obj = round(u(seed, tag, gen, member), 6)."""
    def score(cands: DataFrame) -> DataFrame:
        return cands.withColumn("obj", F.round(uniform(seed, tag, F.lit(gen), F.col("member")), 6)) \
            .withColumn("k", mask_size(F.col("mask"))).withColumn("f1", F.col("obj"))
    return score
