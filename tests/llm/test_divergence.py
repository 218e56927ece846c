from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swarmsift.llm import divergence as D

from .conftest import DOCS

ids = st.lists(st.integers(0, 400), unique=True, max_size=120).map(sorted)


@given(ids, ids, st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_gallop_finds_what_both_hold(a, b, run):
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    at_a, at_b = D.gallop(a, b, run)
    both = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[at_a].tolist() == both == b[at_b].tolist()


@given(st.integers(0, 10**14), st.integers(0, 10**15))
@settings(max_examples=200, deadline=None)
def test_price_is_exact(n, more):
    d = n + 1 + more
    assert int(D.price(np.array([n]), d)[0]) == 1 + 10**9 * (n + 1) // d


@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9)), st.dictionaries(st.integers(0, 60), st.integers(1, 9)))
@settings(max_examples=100, deadline=None)
def test_merge_equals_every_term_priced(a, b):
    terms, side = 80, []
    for x in (a, b):
        side.append((np.array(sorted(x), np.int64), np.array([x[k] for k in sorted(x)], np.int64), sum(x.values()) + terms))

    def f(x, xd, y, yd):
        p, q = (1 + 10**9 * (n + 1) // d for n, d in ((x, xd), (y, yd)))
        return int(Fraction((p - q) ** 2, q))
    one = sum(f(a.get(t, 0), side[0][2], b.get(t, 0), side[1][2]) for t in range(terms))
    two = sum(f(b.get(t, 0), side[1][2], a.get(t, 0), side[0][2]) for t in range(terms))
    assert D.merge_pair(*side, terms) == (one, two)


def brute(rows, least=3, top=200):
    """The contract read plainly, in Python integers."""
    from collections import Counter, defaultdict
    import re
    docs = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+",
             "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for _, t, la, s, _ in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for la, s, ts in docs:
        df[la].update(set(ts))
        n[la, s].update(ts)
    out = set()
    for la in df:
        kept = [t for t, c in df[la].items() if c >= least]
        mine = [s for x, s in n if x == la]
        size = {s: sum(n[la, s][t] for t in kept) + len(kept) for s in mine}
        p = {s: {t: 1 + 10**9 * (n[la, s][t] + 1) // size[s] for t in kept} for s in mine}
        whole = sum(size[s] - len(kept) for s in mine) + len(kept)
        q = {t: 1 + 10**9 * (sum(n[la, s][t] for s in mine) + 1) // whole for t in kept}
        for a in mine:
            pair = [(sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept), b) for b in mine if b != a]
            term = [((p[a][t] - q[t]) ** 2 // q[t], t) for t in kept if n[la, a][t] and p[a][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(la, a, part, item, v, i) for i, (v, item) in enumerate(items, 1) if part == "pair" or i <= top}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = ["Zeta", "eta", "ünder", "日本", "x", "don't", "e9e", "𝒳y", " glue", "A-B_c"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 12), p=np.arange(10, 0, -1) / 55)), rng.choice(["en", "de", ""]),
             f"s{rng.integers(0, 11) if i % 3 else 0}", 1) for i in range(160)]
    rows += [(None, None, None, None, None), (1, "", "xx", "lonely", 0), (1, "zeta zeta", "en", None, 0), (1, "zeta zeta", "en", None, 0),
             (2, "word\x00zeta퟿ " * 3, "en", "s1", 0), (3, "1 2 3 ...", "empty", "a", 0), (4, "--", "empty", "b", 0)]
    return [(r[0], r[1], None if r[2] is None else str(r[2]), r[3], r[4]) for r in rows]


def test_equals_brute_force_with_edges(spark, texts):
    """Nulls, a lang without kept terms, one with a single source, repeated rows, ties, a hot source."""
    docs = spark.createDataFrame(texts, DOCS)
    found = got(D.audit(docs))
    assert found == brute(texts)
    assert ("empty", "a", "pair", "b", 0, 1) in found and not [r for r in found if r[0] == "xx"]


def test_small_blocks_tiles_pieces_and_flushes_change_nothing(spark, texts, monkeypatch):
    for name, value in (("BLOCK_BITS", 1), ("TILE", 2), ("PIECE", 5), ("FLUSH", 7)):
        monkeypatch.setattr(D, name, value)
    assert got(D.audit(spark.createDataFrame(texts, DOCS), top_terms=3)) == brute(texts, top=3)
    docs = spark.createDataFrame(texts, DOCS).repartition(13)
    assert got(D.audit(docs, top_terms=3)) == brute(texts, top=3)


def test_pieces_keep_words_whole(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 4)
    text = "Lorem ipsum--dolor sit" * 30
    whole = [t for part in D.split_terms(text.encode()) for t in part]
    assert whole == text.lower().replace("-", " ").encode().split()


def test_empty_table_and_clashing_columns(spark):
    empty = D.audit(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    docs = spark.createDataFrame([(i, "a b", "en", f"s{i % 2}", 3, 9, 9, "z") for i in range(6)],
                                 DOCS + ", value long, rank long, term string")
    assert {r[:4] for r in got(D.audit(docs))} == {("en", "s0", "pair", "s1"), ("en", "s1", "pair", "s0")}


@pytest.mark.parametrize("a,b", list(permutations([[], [1, 5], [0, 1, 2, 5, 9]], 2)))
def test_gallop_ends(a, b):
    x, _ = D.gallop(np.array(a, np.int64), np.array(b, np.int64))
    assert len(x) == len(set(a) & set(b))
