"""Near-duplicate vectors by collision counting over one-dimensional projections.

Vectors of one label, dimension and content form a class first; only its smallest id
is compared.  Each representative is projected on random directions.  Two unit vectors
at cosine 0.98 are 0.2 apart, so a projection of their difference has standard deviation
0.2.  ``COUNTED`` projections count collisions: a vector collides with a query if it lies
in the window of half width ``half`` = three such deviations centred on the query, and a
pair is verified by cosine in double precision if it collides on at least ``needed`` of
them, the largest count that 99.99 % of pairs at the threshold reach.

So that windows hold few vectors whatever the table's size, the sorted projections are cut into
ranges first: a table of ranges takes ``dims`` further projections, each cut into ranges of four
half widths at a random offset, and a vector lies in one cell of each table.  A pair at the
threshold stays together on one projection with probability 0.93 (``together``);
``tables_for`` takes as many tables as make 99.99 % of such pairs meet in one of them: 7 with 4 projections
(64,000 vectors), 11 with 8 (a million), 27 with 18 (a billion).  That is all that is written per
vector.  ``dims`` grows with the logarithm of the number of vectors, so cells do not fill up.
Within a cell vectors are sorted by one projection, and each query meets only its window there.
A pair counts in the first table in which it shares a cell, so once.

Nothing is emitted per pair: a cell hands on, per vector, its number of links, and a
forest of the links it found.  Cells over ``BLOCK`` vectors are compared block against
block, so a task holds two blocks at most.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, null labels and null ids: no links, a component of their own; different
dimensions are never compared; repeated rows are copies of each other (and of
their own id); pairs exactly at the threshold are linked; other columns of the input, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_by_hot_key, with_row_id
from .components import components

LEAST_DIMS, CELL, COUNTED = 4, 2, 24
SIGMAS = 3.0
RECALL = 0.9999
PER_CELL = 4000
BLOCK = 2000


def dims_for(rows: int) -> int:
    """Projections per table; a cell halves the vectors about once per projection."""
    return max(LEAST_DIMS, ceil(log2(max(1, rows) / PER_CELL)))


def together() -> float:
    """Chance that a pair at the threshold lies in one range of a projection: its mean distance there
    over the range's width."""
    return 1 - sqrt(2 / pi) / (2 * SIGMAS * CELL)


def tables_for(dims: int, recall: float = RECALL) -> int:
    """Tables of ``dims`` projections such that a pair at the threshold shares a cell of one with ``recall``."""
    return ceil(log(1 - recall) / log(1 - together() ** dims))


def needed(m: int, p: float, recall: float = RECALL) -> int:
    """Largest count that a pair colliding with probability p per projection reaches with ``recall``."""
    tail = 0.0
    for k in range(m, -1, -1):
        tail += comb(m, k) * p ** k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


def _project(vectors: list, tables: int, dims: int) -> np.ndarray:
    """Unit vectors times fixed random directions (``COUNTED``, then ``dims`` a table); directions
    depend on the dimension alone."""
    out = np.empty((len(vectors), COUNTED + tables * dims))
    sizes = np.array([len(v) for v in vectors])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = np.array([vectors[i] for i in at], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rng = np.random.default_rng((int(d), tables, dims))
        out[at] = x @ rng.standard_normal((int(d), COUNTED + tables * dims))
    return out


def _cells(projections: np.ndarray, tables: int, dims: int, half: float) -> np.ndarray:
    """A number per vector and table for the cell it lies in; cells that share a number are one."""
    width = 2 * half * CELL
    rng = np.random.default_rng(99)
    at = np.floor((projections[:, COUNTED:] + rng.uniform(0, width, tables * dims)) / width).astype(np.int64)
    odd = rng.integers(-1 << 62, 1 << 62, tables * dims) * 2 + 1
    return (at * odd).reshape(len(at), tables, dims).sum(axis=2)


def _spots(reps: DataFrame, tables: int, dims: int, half: float) -> DataFrame:
    """The cell of each vector in each table."""
    def run(it):
        for pdf in it:
            if len(pdf):
                found = _cells(_project(pdf["embedding"].tolist(), tables, dims), tables, dims, half)
                yield pd.DataFrame({"rep": pdf["rep"], "kind_label": pdf["label"], "cells": list(found),
                                    "size": [len(v) for v in pdf["embedding"]]})

    label = reps.schema["label"].dataType.simpleString()
    found = reps.select("rep", "label", "embedding").mapInPandas(run, f"rep long, kind_label {label}, cells array<long>, size int")
    return found.select("rep", F.struct(F.col("kind_label").alias("label"), "size").alias("kind"), F.posexplode("cells").alias("tbl", "cell"))


def compare(q, c, same: bool, tbl: int, half: float, least: int, cosine: float):
    """Links between query and candidate rows of one cell: (ids, links per id, forest edges).

    q and c are (ids, copies, counted projections, cells, unit vectors); with ``same`` they are one block."""
    q, c = ([x[np.argsort(side[2][:, 0], kind="stable")] for x in side] for side in (q, c))
    (qi, qm, qp, qh, qv), (ci, cm, cp, ch, cv) = q, c
    count_q, count_c = np.zeros(len(qi), np.int64), np.zeros(len(ci), np.int64)
    ids = np.unique(np.concatenate([qi, ci]))
    root = np.arange(len(ids))
    at_q, at_c = np.searchsorted(ids, qi), np.searchsorted(ids, ci)
    edges = []
    for lo in range(0, len(qi), 256):
        part = slice(lo, lo + 256)
        # The windows of these queries on the sorted projection.
        left = np.searchsorted(cp[:, 0], qp[part, 0][0] - half, "left")
        right = np.searchsorted(cp[:, 0], qp[part, 0][-1] + half, "right")
        near = slice(left, right)
        ok = qi[part, None] < ci[near] if same else np.ones((len(qi[part]), right - left), bool)
        for t in range(tbl):
            ok &= qh[part, t, None] != ch[near, t]
        if not ok.any():
            continue
        total = np.zeros(ok.shape, np.int16)
        for k in range(COUNTED):
            total += np.abs(qp[part, k, None] - cp[near, k]) <= half
        a, b = np.nonzero(ok & (total >= least))
        a, b = a + lo, b + left
        sim = np.empty(len(a))
        for s in range(0, len(a), 1 << 15):
            x, y = a[s:s + (1 << 15)], b[s:s + (1 << 15)]
            sim[s:s + (1 << 15)] = np.einsum("ij,ij->i", qv[x], cv[y])
        a, b = a[sim >= cosine], b[sim >= cosine]
        np.add.at(count_q, a, cm[b])
        np.add.at(count_c, b, qm[a])
        for i in np.unique(a):
            mine = at_c[b[a == i]]
            own = root[at_q[i]]
            others = np.setdiff1d(root[mine], [own])
            for r in others:
                first = mine[root[mine] == r][0]
                edges.append((ids[at_q[i]], ids[first]))
            root[np.isin(root, others)] = own
    return np.concatenate([qi, ci]), np.concatenate([count_q, count_c]), edges


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", vec: str = "embedding",
                    label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() \
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vec).alias("embedding"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = cut_lineage(rows.withColumn("h1", F.xxhash64("label", "embedding"))
                       .withColumn("h2", F.xxhash64(F.lit(7), "embedding", "label")), "vectors")
    good = rows.filter("fine")
    # A class is known by a number of its own: an id whose rows hold different vectors is in several.
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = cut_lineage(with_row_id(classes, "rep"), "vector_classes")
    reps = good.join(classes, ["h1", "h2", "vec_id"]).dropDuplicates(["rep"])
    reps = cut_lineage(reps.select("rep", "copies", "label", "embedding"), "vector_reps")

    n = reps.count()
    dims = dims_for(n)
    tables = tables_for(dims)
    half = SIGMAS * sqrt(2 - 2 * cosine)
    least = needed(COUNTED, erf(SIGMAS / sqrt(2)))
    spots = cut_lineage(_spots(reps, tables, dims, half), "cells")
    cell = ["kind", "tbl", "cell"]
    sizes = spots.groupBy(*cell).agg(F.count("*").alias("all")).filter("all > 1")
    dealt = join_by_hot_key(spots, cut_lineage(sizes, "cell_sizes"), cell, "all", n * tables) \
        .filter("all is not null") \
        .withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("rep", *cell, "own", F.least("own", "other").alias("bq"), F.greatest("own", "other").alias("bc")) \
        .join(reps.select("rep", "copies", "embedding"), "rep")

    def run(key, pdf):
        V = np.array(pdf["embedding"].tolist(), np.float64)
        V /= np.linalg.norm(V, axis=1, keepdims=True)
        P = _project(pdf["embedding"].tolist(), tables, dims)
        H = _cells(P, tables, dims, half)
        ids, copies = pdf["rep"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        same = key[3] == key[4]
        first = pdf["own"].to_numpy() == key[3]
        side = [(ids[m], copies[m], P[m, :COUNTED], H[m], V[m]) for m in (first, first if same else ~first)]
        who, links, edges = compare(*side, same, int(key[1]), half, least, cosine)
        who, links = who[links > 0], links[links > 0]
        return pd.DataFrame({"a": pd.array([*who, *[e[0] for e in edges]], "Int64"),
                             "b": pd.array([*[pd.NA] * len(who), *[e[1] for e in edges]], "Int64"),
                             "n": pd.array([*links, *[0] * len(edges)], "Int64")})

    found = dealt.groupBy(*cell, "bq", "bc").applyInPandas(run, "a long, b long, n long")
    found = cut_lineage(found, "vector_links")
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(found.filter("b is not null").select("a", "b").distinct()) \
        .select(F.col("id").alias("rep"), F.col("component_id").alias("comp"))
    in_comp = cut_lineage(classes.join(links, "rep", "left").join(comp, "rep", "left")
                          .withColumn("comp", F.coalesce("comp", "rep")), "class_components")
    least = in_comp.groupBy("comp").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("members"))
    by_class = join_by_hot_key(in_comp, cut_lineage(least, "component_ids"), ["comp"], "members", n).select(
        "h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = join_by_hot_key(good.select("vec_id", "h1", "h2"), by_class, ["h1", "h2"], "copies", rows.count()) \
        .select("vec_id", "n_links", "component_id")
    bad = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                         F.col("vec_id").alias("component_id"))
    return joined.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
