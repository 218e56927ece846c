"""Near-duplicate texts by an LSH forest over MinHash signatures.

1. One pass over the texts hashes each distinct word, forms the set of distinct
   shingles and its signature of ``TREES * DEPTH`` minima.  Texts with equal sets form a
   class (found by aggregation); only its smallest id goes on.
2. Tree t orders signatures by their t-th run of minima.  A region is the texts that
   share the first ``LEAST`` minima of a tree; two texts with similarity s meet in at
   least one region with probability 1-(1-s^3)^14, 0.99995 at 0.8.
3. Within a region, sorted by signature, neighbours with the longest common prefixes
   are compared first; the region then ascends, comparing texts not yet connected
   there, until it is one component or every pair was compared.  So its depth adapts:
   a group of near copies costs about one comparison per text, and nothing is lost by
   it.  Compared are one-byte signature sketches; pairs passing ``PASS`` of the
   positions and the size bound are candidates, and a region hands on only a forest.
   Regions over ``BLOCK`` texts are compared block against block.
4. Candidates are confirmed on full shingle sets.  Where that leaves texts that candidates
   had joined in several components, the largest of these is compared with the others, and
   the others among themselves, block by block on full sets; each text is sent to that
   comparison once per block it meets, and again only a forest of links comes out.
5. Components come from alternating star contractions.

Words are told apart by 64-bit hashes, shingles by a 64-bit mix of four of them.

Defined results: null or empty text, or one without words: no shingles, linked with
nothing; fewer words than a shingle: the whole sequence is the one shingle; repeated
rows of one id each get a row (were their texts to differ, the one with the smallest
hash stands for the id); null id: its texts link with
nothing, component null, kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut_lineage, join_by_hot_key, mix64, tidy
from .components import components

TREES, DEPTH, LEAST = 14, 8, 3
SIGS = TREES * DEPTH
PASS = 0.64         # 4 standard deviations of the estimate below 0.8
BLOCK = 2000
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 32, SIGS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SIGS, dtype=np.uint64).astype(np.uint32)
_C = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                                 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [t.lower().split() for t in texts]
    flat = np.array([w for ws in split for w in ws] or [b""], object)
    codes, uniq = pd.factorize(flat)
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in uniq], np.uint64)[codes]
    out, at = [], 0
    for ws in split:
        n = len(ws)
        w = words[at:at + n]
        at += n
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        k = min(width, n)
        h = np.full(n - k + 1, np.uint64(k))
        for i in range(k):
            h = mix64(h * _C[i % 8] + w[i:n - k + 1 + i])
        out.append(np.unique(h))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Text x SIGS minima; texts without shingles get the largest value."""
    sig = np.full((len(sets), SIGS), np.uint32(0xFFFFFFFF))
    has = [i for i, s in enumerate(sets) if len(s)]
    lo = 0
    while lo < len(has):
        hi, total = lo, 0
        while hi < len(has) and (hi == lo or total + len(sets[has[hi]]) <= 1 << 16):
            total += len(sets[has[hi]])
            hi += 1
        rows = has[lo:hi]
        x = (np.concatenate([sets[i] for i in rows]) >> np.uint64(32)).astype(np.uint32)
        first = np.cumsum([0, *[len(sets[i]) for i in rows[:-1]]])
        buf = np.empty_like(x)
        for k in range(SIGS):
            np.multiply(x, _A[k], out=buf)
            buf += _B[k]
            sig[rows, k] = np.minimum.reduceat(buf, first)
        lo = hi
    return sig


FEATURES = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"


def features(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    def run(it):
        for pdf in batches(it, 5000, 1_000_000, "text"):
            sets = shingle_sets(pdf["text"].tolist(), width)
            sig = signatures(sets)
            with np.errstate(over="ignore"):
                h1 = [int(mix64(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                h2 = [int(mix64(s ^ _C[5]).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                                "h1": h1, "h2": h2, "sig": [row.tobytes() for row in sig]})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(tidy(run), FEATURES)


def _regions(reps: DataFrame) -> DataFrame:
    """One short row per text and tree."""
    def run(it):
        for pdf in it:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), TREES, DEPTH)
            h = np.broadcast_to(np.arange(TREES, dtype=np.uint64) + np.uint64(1), (len(pdf), TREES)).copy()
            for i in range(LEAST):
                h = mix64(h * _C[i] + sig[:, :, i])
            yield pd.DataFrame({"region": h.view(np.int64).ravel(), "tree": np.tile(np.arange(TREES), len(pdf)),
                                "doc_id": np.repeat(pdf["doc_id"].to_numpy(), TREES)})

    return reps.select("doc_id", "sig").mapInPandas(run, "region long, tree int, doc_id long")


def _find(root, i):
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def region_candidates(ids, sizes, sketch, side, tree):
    """A forest of candidate pairs of one region or block pair (``side`` tells two blocks apart)."""
    m = len(ids)
    order = np.lexsort([sketch[:, tree * DEPTH + d] for d in reversed(range(DEPTH))])
    ids, sizes, sketch, side = ids[order], sizes[order], sketch[order], side[order]
    two = side.min() != side.max()
    out = []
    root = list(range(m))
    for i in np.flatnonzero(_near(sketch[:-1], sketch[1:], sizes[:-1], sizes[1:])):  # longest common prefixes first
        if not two or side[i] != side[i + 1]:
            out.append((ids[i], ids[i + 1]))
            root[_find(root, i + 1)] = _find(root, i)
    roots = np.array([_find(root, i) for i in range(m)])
    for i in range(m - 1):  # then ascend to the whole region
        js = np.arange(i + 1, m)
        js = js[(roots[js] != roots[i]) & ((side[js] != side[i]) if two else True)]
        if len(js):
            for j in js[_near(sketch[js], sketch[i], sizes[js], sizes[i])]:
                if roots[j] != roots[i]:
                    out.append((ids[i], ids[j]))
                    roots[roots == roots[j]] = roots[i]
    return out


def _near(a, b, na, nb):
    return ((a == b).sum(axis=1) >= np.ceil(PASS * SIGS)) & (10 * np.minimum(na, nb) >= 8 * np.maximum(na, nb))


def _candidates(members: DataFrame) -> DataFrame:
    """``members``: region, tree, n (its texts), doc_id, n_shingles, sketch.  Regions are
    read one after another from sorted partitions; most hold two or three texts."""
    own = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")) \
        .select("region", "lo", "hi", "tree", "own", "doc_id", "n_shingles", "sketch") \
        .repartition("region", "lo", "hi").sortWithinPartitions("region", "lo", "hi", "doc_id")

    def pairs(pdf, edge):
        ids, sizes = pdf["doc_id"].to_numpy(), pdf["n_shingles"].to_numpy()
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), SIGS)
        side, tree = pdf["own"].to_numpy(), pdf["tree"].to_numpy()
        whole = pdf["lo"].to_numpy() == pdf["hi"].to_numpy()
        size = np.diff(edge)
        two = edge[:-1][(size == 2) & whole[edge[:-1]]]
        ok = two[_near(sketch[two], sketch[two + 1], sizes[two], sizes[two + 1])]
        out = [(ids[ok], ids[ok + 1])]
        for lo, n in zip(edge[:-1], size, strict=True):
            if n > 2 or n == 2 and not whole[lo]:
                at = slice(lo, lo + n)
                one = np.zeros(n, int) if whole[lo] else side[at]
                found = region_candidates(ids[at], sizes[at], sketch[at], one, int(tree[lo]))
                if found:
                    out.append(tuple(np.array(found).T))
        a, b = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(it):
        rest = None
        for pdf in it:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key = pdf[["region", "lo", "hi"]].to_numpy()
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            rest = pdf.iloc[edge[-1]:]  # may go on in the next batch
            if len(edge) > 1:
                yield pairs(pdf.iloc[:edge[-1]], edge)
        if rest is not None and len(rest):
            yield pairs(rest, np.array([0, len(rest)]))

    return dealt.mapInPandas(run, "a long, b long").distinct()


def _low_bytes(reps: DataFrame) -> DataFrame:
    """The one-byte sketch: the lowest byte of each minimum."""
    def run(it):
        for pdf in it:
            if len(pdf):
                sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), SIGS, 4)[:, :, 0]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": pdf["n_shingles"],
                                    "sketch": [r.tobytes() for r in sig]})

    return reps.select("doc_id", "n_shingles", "sig").mapInPandas(
        run, "doc_id long, n_shingles long, sketch binary")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Each pair with ``linked``: 100 * intersection >= percent * union on full sets."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a") \
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")

    def run(it):
        for pdf in it:
            for lo in range(0, len(pdf), 200):
                part = pdf.iloc[lo:lo + 200]
                names = {}
                for t in [*part["ta"], *part["tb"]]:
                    names.setdefault(t, len(names))
                sets = shingle_sets(list(names), width)
                ok = []
                for x, y in zip(part["ta"], part["tb"], strict=True):
                    x, y = sets[names[x]], sets[names[y]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
                yield pd.DataFrame({"a": part["a"], "b": part["b"], "linked": ok})

    return both.select("a", "b", "ta", "tb").mapInPandas(tidy(run), "a long, b long, linked boolean")


def _between(parts: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components that candidates had joined.

    ``parts``: doc_id, cc (of candidates), comp (confirmed); every cc holds several comps."""
    sizes = parts.groupBy("cc", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cc").agg(F.max(F.struct("n", F.col("comp").alias("main"))).alias("m"), F.sum("n").alias("n")) \
        .select("cc", "m.main", F.ceil(F.col("m.n") / BLOCK).cast("int").alias("nm"),
                F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("nr"))
    own = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.when(F.col("is_main"), F.col("nm")).otherwise(F.col("nr"))).cast("int")
    at = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    me = F.col("own")
    rest = F.concat(F.transform(count("nm"), lambda y: at(0, me, y)),
                    F.transform(count("nr"), lambda y: at(1, F.least(me, y), F.greatest(me, y))))
    dealt = parts.join(main, "cc").withColumn("is_main", F.col("comp") == F.col("main")).withColumn("own", own) \
        .withColumn("at", F.explode(F.when(F.col("is_main"), F.transform(count("nr"), lambda x: at(0, x, me))).otherwise(rest))) \
        .select("cc", "at", "doc_id", "comp").join(texts.hint("merge"), "doc_id")

    def run(pdf):
        ids, comp = pdf["doc_id"].to_numpy(), pdf["comp"].to_numpy()
        sets = shingle_sets(pdf["text"].tolist(), width)
        n = np.array([len(s) for s in sets])
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(n) - n
        have = np.zeros(len(names), bool)
        _, roots = np.unique(comp, return_inverse=True)
        out = []
        for i in np.argsort(n, kind="stable"):
            if (roots == roots[i]).all():
                continue
            mine = codes[first[i]:first[i] + n[i]]
            have[mine] = True
            common = np.add.reduceat(have[codes], first).astype(np.int64)
            have[mine] = False
            for j in np.flatnonzero((roots != roots[i]) & (100 * common >= percent * (n + n[i] - common))):
                if roots[j] != roots[i]:
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    roots[roots == roots[j]] = roots[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("cc", "at").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text",
                    key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``percent`` may be 80 to 100: trees and sketch thresholds are dimensioned for 80."""
    if not 80 <= percent <= 100:
        raise ValueError("signatures are dimensioned for similarities of 80 % or more")
    feats = cut_lineage(features(docs, width, text, key), "minhash_features")
    classes = cut_lineage(feats.filter("doc_id is not null").groupBy("h1", "h2")
                          .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"),
                               F.max("n_shingles").alias("size")), "set_classes")
    chosen = classes.filter("size > 0").groupBy(F.col("rep").alias("doc_id")).agg(F.min(F.struct("h1", "h2")).alias("h"))
    reps = feats.join(chosen.select("doc_id", "h.h1", "h.h2"), ["doc_id", "h1", "h2"], "left_semi") \
        .dropDuplicates(["doc_id"])
    reps = cut_lineage(reps, "class_reps")
    spots = cut_lineage(_regions(reps), "regions")
    shared = spots.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut_lineage(spots.join(shared, "region").join(_low_bytes(reps), "doc_id"), "region_members")

    first = cut_lineage(_candidates(members), "candidates")
    # The texts of candidates.  Their ids are not bounded, so they are never broadcast.
    named = first.select(F.col("a").alias("doc_id")).union(first.select("b")).distinct()
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    texts = cut_lineage(texts.join(named.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "candidate_texts")
    tested = cut_lineage(_confirm(first, texts, width, percent), "confirmed")
    links = tested.filter("linked").select("a", "b")
    comp = cut_lineage(components(links).withColumnRenamed("id", "doc_id"), "components")

    if not tested.filter("not linked").isEmpty():
        # Components that candidates joined, though none confirmed that they are linked.
        stars = comp.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        parts = components(stars.unionByName(tested.filter("not linked").select("a", "b"))).withColumnsRenamed({"id": "doc_id", "component_id": "cc"}) \
            .join(comp.withColumnRenamed("component_id", "comp"), "doc_id", "left") \
            .withColumn("comp", F.coalesce("comp", "doc_id"))
        parts = cut_lineage(parts, "candidate_parts")
        open_ = parts.groupBy("cc").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("cc")
        more = cut_lineage(_between(parts.join(open_, "cc", "left_semi"), texts, width, percent), "more_links")
        if not more.isEmpty():
            comp = cut_lineage(components(stars.unionByName(more)).withColumnRenamed("id", "doc_id"), "components")

    # From representatives to every member of their class.
    by_class = classes.join(comp.withColumnRenamed("doc_id", "rep"), "rep", "left") \
        .select("h1", "h2", "copies", F.when(F.col("size") > 0, F.coalesce("component_id", "rep")).alias("component_id"))
    total = feats.count()
    out = join_by_hot_key(feats.select("doc_id", "n_shingles", "h1", "h2"), by_class, ["h1", "h2"], "copies", total)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
