"""Approximate nearest neighbours by vantage-point trees, one per shard.

Nearness is the cosine in double precision; trees are cut by the angle between vectors,
which obeys the triangle inequality.

1. Rows are dealt into shards by a hash of their row number: at most about ``SHARD_MB``
   of vectors each, more shards while the session has more partitions to fill.  A shard
   gets its own vectors first, then every query, in batches, from one sorted partition.
2. A tree node picks the vantage point whose angles spread most, splits its rows at the
   median angle and keeps the least and largest angle of either half.
3. Queries go down in groups, nearer half first.  A half is passed over when
   ``factor`` times the least angle that the triangle inequality leaves to it is beyond
   the query's k-th nearest so far.  Factor one gives the exact result; larger factors
   pass over more.
4. Pairs that reach the k-th nearest are scored on the original vectors, term by term in
   order, so that equal vectors get equal scores; each shard returns its k nearest a query
   and a ranking over the shards keeps k.

Vectors without neighbourhood structure (64 random directions) leave little to prune, and
what a larger factor passes over there costs recall as the table grows; the default is
therefore one.  README gives recall and work by factor.

Only the k + 1 rows of smallest id among equal vectors of a shard can be among k nearest;
the others are left out of its tree.

Defined results: null, empty or zero vectors and those that hold null or non-finite
components take no part; vectors of different lengths are not compared; rows without an
id are candidates, returned with a null vec_id after others of the same score; rows that
repeat an id are rows of their own, and each is a query of its own if its id is one;
fewer candidates than k give fewer rows; ties go to the smaller vec_id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions, with_row_id

K, EVERY, FACTOR = 5, 50, 1.0
SHARD_MB, LEAST_ROWS = 64, 4096    # a shard's vectors in double precision; no shard is cut below so many rows
LEAF, TRIED, SEEN = 256, 5, 200    # rows of a leaf; vantage points tried, and rows they are tried on
BATCH = 2048                       # queries searched together
SLACK = 1e-7                       # rounding of angles near 0
NEAR = 1e-11                       # rounding of a matrix product against the sum term by term


def exact_cosine(a: np.ndarray, b: np.ndarray, a_norm: np.ndarray, b_norm: np.ndarray) -> np.ndarray:
    """Cosine of row pairs, summed in order of the components."""
    dot = np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
    return dot / (a_norm * b_norm)


def norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return np.sqrt(total)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


class Tree:
    """Vantage-point tree over the rows of one shard.

    ids break ties (smaller first); rows tell a query its own row."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, seed: int = 1):
        self.norm = norms(vectors)
        self.unit = vectors / self.norm[:, None]
        self.rng = np.random.default_rng(seed)
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # (lo, hi) of a leaf, or (vantage point, left, its angles, right, its angles)
        self.compared = 0
        self.root = self._grow(0, len(ids))
        self.vectors, self.unit, self.norm = vectors[self.order], self.unit[self.order], self.norm[self.order]
        self.ids, self.rows = ids[self.order], rows[self.order]

    def _grow(self, lo: int, hi: int) -> int:
        if hi - lo <= LEAF:
            self.nodes.append((lo, hi))
            return len(self.nodes) - 1
        own = self.order[lo:hi]
        tried = self.unit[self.rng.choice(own, TRIED)]
        seen = self.unit[self.rng.choice(own, SEEN)]
        vantage = tried[np.argmax(angles(seen @ tried.T).std(axis=0))]
        apart = angles(self.unit[own] @ vantage)
        by = np.argsort(apart, kind="stable")
        self.order[lo:hi], apart = own[by], apart[by]
        mid = (hi - lo) // 2
        left, right = self._grow(lo, lo + mid), self._grow(lo + mid, hi)
        self.nodes.append((vantage, left, (apart[0], apart[mid - 1]), right, (apart[mid], apart[-1])))
        return len(self.nodes) - 1

    def search(self, vectors: np.ndarray, rows: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, positions) of the k nearest of each query, -inf and -1 where there are fewer."""
        self.q, self.q_rows, self.q_norm = vectors, rows, norms(vectors)
        self.q_unit = vectors / self.q_norm[:, None]
        self.best = np.full((len(rows), k), -np.inf)
        self.at = np.full((len(rows), k), -1)
        self.factor = factor
        self._down(self.root, np.arange(len(rows)))
        return self.best, self.at

    def _down(self, node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        if len(self.nodes[node]) == 2:
            self._leaf(*self.nodes[node], who)
            return
        vantage, left, near, right, far = self.nodes[node]
        apart = angles(self.q_unit[who] @ vantage)
        first_left = apart <= (near[1] + far[0]) / 2
        self._down(left, who[first_left])
        self._down(right, who[~first_left])
        for child, (low, high), mine in ((right, far, first_left), (left, near, ~first_left)):
            at_least = np.maximum(low - apart[mine], apart[mine] - high)
            reach = angles(self.best[who[mine], -1]) + SLACK  # the k-th so far; pi while there are fewer
            self._down(child, who[mine][self.factor * at_least <= reach])

    def _leaf(self, lo: int, hi: int, who: np.ndarray) -> None:
        self.compared += len(who) * (hi - lo)
        like = self.q_unit[who] @ self.unit[lo:hi].T
        least = self.best[who, -1]
        k = self.best.shape[1] + 1  # the query's own row may be one of them
        if hi - lo > k:
            least = np.maximum(least, np.partition(like, -k, axis=1)[:, -k])
        a, b = np.nonzero(like >= least[:, None] - NEAR)
        b += lo
        fine = self.rows[b] != self.q_rows[who[a]]
        a, b = who[a[fine]], b[fine]
        score = np.empty(len(a))
        for s in range(0, len(a), 1 << 15):
            x, y = a[s:s + (1 << 15)], b[s:s + (1 << 15)]
            score[s:s + (1 << 15)] = exact_cosine(self.q[x], self.vectors[y], self.q_norm[x], self.norm[y])
        touched = np.unique(a)
        k = self.best.shape[1]
        a = np.concatenate([np.repeat(touched, k), a])
        b = np.concatenate([self.at[touched].ravel(), b])
        score = np.concatenate([self.best[touched].ravel(), score])
        by = np.lexsort((np.where(b < 0, np.iinfo(np.int64).max, self.ids[b]), -score, a))
        a, b, score = a[by], b[by], score[by]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        top = place < k
        self.best[a[top], place[top]], self.at[a[top], place[top]] = score[top], b[top]


def first_copies(vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows that are among the ``most`` rows of smallest id of their vector."""
    plain = np.ascontiguousarray(vectors + 0.0)  # -0.0 is 0.0
    _, which = np.unique(plain.view(np.dtype((np.void, plain.shape[1] * plain.itemsize))).ravel(), return_inverse=True)
    by = np.lexsort((ids, which))
    place = np.arange(len(by)) - np.searchsorted(which[by], which[by])
    return by[place < most]


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows in double precision, scaled so that no square overflows or vanishes."""
    x = np.array(column.tolist(), np.float64)
    top = np.abs(x).max(axis=1)
    odd = (top > 1e100) | (top < 1e-100)
    x[odd] /= top[odd, None]
    return x


NO_ID = 2**63 - 1  # stands for a null id inside the operator


def _search_shards(it, k: int, factor: float):
    """Rows of whole shards, each shard's vectors before its queries -> k nearest of each query in the shard."""
    key, held, tree = None, [], None
    for pdf in it:
        for now, part in pdf.groupby(["dims", "shard", "query"], sort=False):
            if now[:2] != key:
                key, held, tree = now[:2], [], None
            if not now[2]:
                held.append((_matrix(part["vector"]), part["id"].to_numpy(np.int64), part["row"].to_numpy(np.int64)))
                continue
            if tree is None and held:
                vectors, ids, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                keep, held = first_copies(vectors, ids, k + 1), []
                tree = Tree(vectors[keep], ids[keep], rows[keep])
            if tree is None:
                continue
            for lo in range(0, len(part), BATCH):
                asked = part.iloc[lo:lo + BATCH]
                score, at = tree.search(_matrix(asked["vector"]), asked["row"].to_numpy(np.int64), k, factor)
                q, place = np.nonzero(at >= 0)
                ids = tree.ids[at[q, place]]
                yield pd.DataFrame({"row": asked["row"].to_numpy(np.int64)[q], "query_id": asked["id"].to_numpy(np.int64)[q],
                                    "vec_id": pd.arrays.IntegerArray(ids, ids == NO_ID), "score": score[q, place]})


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, key: str = "vec_id",
            vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row whose id is divisible by ``every``."""
    if factor < 1:
        raise ValueError("a factor below one would not pass over more, but prune less than the exact search")
    spark = vectors.sparkSession
    x = F.col("vector")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vec).alias("vector"))
    rows = cut_lineage(with_row_id(rows.filter(fine).withColumn("dims", F.size("vector")), "row"), "vectors")

    # Shards by vector length; the table has one row per length that occurs.
    n = F.count("*")
    shards = F.greatest(F.ceil(n * F.col("dims") * 8 / (SHARD_MB << 20)),
                        F.least(F.lit(shuffle_partitions(spark)), F.ceil(n / LEAST_ROWS))).cast("int")
    sizes = F.broadcast(rows.groupBy("dims").agg(shards.alias("shards")))
    mine = rows.join(sizes, "dims").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")) \
        .withColumn("query", F.lit(False))
    asked = rows.filter((F.col("id") % every == 0) & (F.col("id") != NO_ID)).join(sizes, "dims") \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("query", F.lit(True))
    cols = ["dims", "shard", "query", "row", "id", "vector"]
    dealt = mine.select(cols).unionByName(asked.select(cols)).repartition("dims", "shard") \
        .sortWithinPartitions("dims", "shard", "query")
    found = dealt.mapInPandas(lambda it: _search_shards(it, k, factor), "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
