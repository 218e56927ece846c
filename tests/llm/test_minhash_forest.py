import re
from collections import defaultdict

import numpy as np
import pytest

from swarmsift.llm import minhash_forest as M
from swarmsift.llm import queries
from swarmsift.llm.components import components

from .conftest import DOCS


def shingles(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def smallest(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(texts, width=4):
    sets = {d: shingles(t, width) for d, t in texts.items()}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = defaultdict(int)
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    return sets, smallest(links, texts)


def check(rows, texts):
    sets, comp = brute(texts)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for d in texts:
        assert got[d].n_shingles == len(sets[d])
        assert got[d].component_id == comp[d], d
        assert got[d].kept == (comp[d] == d)
    return comp


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])  # equal at sf0.1 too, which takes minutes
def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    comp = check(queries.op4_minhash(spark, sf).collect(), texts)
    assert len(set(comp.values())) < len(comp)


def near_copies(n_groups, size, words, edits, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for _ in range(size):
            w = list(base)
            for i in rng.integers(0, words, rng.integers(0, edits)):
                w[i] = f"x{rng.integers(0, 1 << 30)}"
            out.append(" ".join(w))
    return out


def test_links_near_the_threshold(spark):
    """Groups in which many pairs lie just above and below the threshold."""
    texts = dict(enumerate(near_copies(40, 12, 120, 8) + near_copies(1, 200, 300, 14, 1)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(M.near_duplicates(docs, width=4).collect(), texts)


def test_large_regions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 25)
    texts = dict(enumerate(near_copies(2, 120, 200, 9, 3)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(M.near_duplicates(docs, width=4).collect(), texts)


def test_edges(spark, write_tables):
    long = "a b c d e f " * 20_000
    texts = ["", None, "one", "ONE", "one two", "\t \n", "é x", "É x", "a b c", long, long + "tail", "one two three four",
             "One\x0btwo three  four", "one two three"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    sf = write_tables(documents=(rows, DOCS))
    check(queries.op4_minhash(spark, sf).collect(), dict(enumerate(texts)))


def test_nulls_repeats_empty(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (1, "a b c d e"), (None, None)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, True), (-1, -1, True), (1, 1, True), (3, 1, False), (3, 1, False)]
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    n = 400
    edges = [(i, i + 1) for i in range(0, 150)] + [(200, i) for i in range(201, 260)] \
        + [tuple(map(int, rng.integers(260, n, 2))) for _ in range(90)]
    rng.shuffle(edges)
    edges = [tuple(map(int, e)) for e in edges]
    want = smallest(edges, range(n))
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_rounds_have_tasks_for_their_edges(spark, monkeypatch):
    """A few hundred edges are not written as a file for each shuffle partition; stars need no round."""
    from swarmsift.llm import components as C

    files, write = {}, C.cut_lineage

    def counted(df, name="t"):
        out = write(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(C, "cut_lineage", counted)
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
        assert {r.component_id for r in components(chain).collect()} == {0}
        assert files["small_star"] and max(files["large_star"] + files["small_star"]) <= C.LEAST_TASKS
        files.clear()
        stars = spark.createDataFrame([(i // 10 * 10, i) for i in range(300)], "a long, b long")
        assert components(stars).count() == 300 and "large_star" not in files
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_similarities_below_the_dimensioned_ones_are_refused(spark):
    with pytest.raises(ValueError):
        M.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=60)
