"""Source divergence audit by pair-task sparse merges.

Each language keeps the terms that at least ``MIN_DOCS`` of its documents hold.  Every group
(language, source) and the language itself give each kept term a smoothed price
p = 1 + floor(10^9 (count + 1) / (N + V)); the divergence of p from q at a term is
floor((p - q)^2 / q).  Part ``pair`` sums it over all kept terms against every other source
of the language, part ``term`` lists the terms that a group has more of than its language.

1. Tasks count terms per group over whole documents and hand on one row per group and term.
2. Kept terms get ids; 2^BLOCK_BITS ids make a block, so that a group's sorted
   (term id, count) array is bounded per block, however large the vocabulary.
3. Groups of a language are numbered and cut into tiles of ``TILE``.  The arrays of two
   tiles are co-grouped per block; each unordered pair of groups is merged by galloping
   intersection, which prices overlaps, one-sided and absent terms both ways.  An array is
   sent once per tile of its language, not once per pair.
4. Block sums are added up.

Prices use long division in steps, exact for N + V below 9 * 10^15; sums of divergences
stay below 2^63 while a language keeps under 10^9 terms.

Defined results: null text, lang or source is ''; a group without kept terms has value 0
against groups without them and no row of part ``term``; a lang with one source has no
``pair`` rows; repeated rows count as documents of their own; ties rank by item in UTF-8
order; very long texts are read in pieces; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut_lineage

MIN_DOCS, TOP_TERMS = 3, 200
BLOCK_BITS = 14          # term ids per block
TILE = 8                 # groups per tile
FLUSH = 600_000          # (group, term) entries that a task holds before it hands them on
PIECE = 1 << 20          # bytes of a text split at a time
SCALE_STEP, SCALE_STEPS = 1000, 3  # 10^9 in three steps

# Bytes of a term stay (A-Z in lower case), all others become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_terms(text: bytes):
    """Lists of the terms of a text, at most about PIECE bytes at a time."""
    text = text.translate(TERM_BYTES)
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + PIECE)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def _count(it):
    """(lang, source, term, n, df) of what a task has read; the empty term marks the group itself."""
    held: dict = {}
    entries = 0

    def rows():
        every = ((*g, t, n[t], d) for g, (n, df) in held.items() for t, d in chain([(b"", 0)], df.items()))
        while part := list(islice(every, 50_000)):
            yield pd.DataFrame(part, columns=["lang", "source", "term", "n", "df"])

    for pdf in batches(it, 2000, 4_000_000, "text"):
        for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"], strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(df), set()
            for terms in split_terms(text):
                n.update(terms)
                seen.update(terms)
            df.update(seen)
            entries += len(df) - before
            if entries >= FLUSH:
                yield from rows()
                held, entries = {}, 0
    if held:
        yield from rows()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents per group; a row with the empty term for every group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang, "lang"), (source, "source"))],
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInPandas(_count, "lang string, source string, term binary, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def price_column(n: Column, d: Column) -> Column:
    """1 + floor(10^9 (n + 1) / d) in long arithmetic."""
    left, out = n + 1, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        whole = left * SCALE_STEP
        left = whole % d
        out = out * SCALE_STEP + _div(whole, d)
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(n: np.ndarray, d: int) -> np.ndarray:
    """As price_column, over an array of counts."""
    left, out = np.asarray(n, np.int64) + 1, np.zeros(np.shape(n), np.int64)
    for _ in range(SCALE_STEPS):
        whole = left * SCALE_STEP
        out = out * SCALE_STEP + whole // d
        left = whole % d
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray, run: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in short, in long) of the values that both sorted arrays hold.

    Runs of the shorter array are looked up together: from where the last one ended, the
    step into the longer array doubles until it passes the run's last value, and only the
    stretch between is searched."""
    at_short, at_long, lo = [], [], 0
    for start in range(0, len(short), run):
        part = short[start:start + run]
        step = len(part)
        while lo + step < len(long) and long[lo + step] < part[-1]:
            step *= 2
        stretch = long[lo:lo + step + 1]
        if not len(stretch):
            break
        where = np.searchsorted(stretch, part)
        hit = stretch[np.minimum(where, len(stretch) - 1)] == part
        at_short.append(np.flatnonzero(hit) + start)
        at_long.append(where[hit] + lo)
        lo += int(where[-1])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *at_short]), np.concatenate([none, *at_long])


def divergence(p, q) -> int:
    """Sum of floor((p - q)^2 / q)."""
    apart = p - q
    return int(np.sum(apart * apart // q))


def merge_pair(a: tuple, b: tuple, terms: int) -> tuple[int, int]:
    """Divergence of a from b and of b from a over the ``terms`` kept terms of a block.

    A side is (sorted term ids, counts, N + V)."""
    (ai, an, ad), (bi, bn, bd) = a, b
    pa, pb = price(an, ad), price(bn, bd)
    pa0, pb0 = price(np.zeros(1, np.int64), ad), price(np.zeros(1, np.int64), bd)
    if len(ai) <= len(bi):
        at_a, at_b = gallop(ai, bi)
    else:
        at_b, at_a = gallop(bi, ai)
    only_a, only_b = np.delete(pa, at_a), np.delete(pb, at_b)
    absent = terms - len(ai) - len(bi) + len(at_a)
    one = divergence(pa[at_a], pb[at_b]) + divergence(only_a, pb0) + divergence(pa0, only_b) + absent * divergence(pa0, pb0)
    two = divergence(pb[at_b], pa[at_a]) + divergence(pb0, only_a) + divergence(only_b, pa0) + absent * divergence(pb0, pa0)
    return one, two


def _sides(pdf: pd.DataFrame) -> list:
    none = np.empty(0, np.int64)
    return [(num, source, (none if ids is None else np.asarray(ids, np.int64), none if ns is None else np.asarray(ns, np.int64), int(d)), int(v))
            for num, source, ids, ns, d, v in zip(pdf["num"], pdf["source"], pdf["ids"], pdf["ns"], pdf["d"], pdf["v"], strict=True)]


def _pair_task(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """All unordered pairs between two tiles in one block."""
    out = []
    right_sides = _sides(right)
    for num, source, a, terms in _sides(left):
        for other, item, b, _ in right_sides:
            if num < other:
                one, two = merge_pair(a, b, terms)
                out += [(key[0], source, item, one), (key[0], item, source, two)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = cut_lineage(term_counts(docs, text, lang, source), "term_counts")
    groups = counts.filter("term = X''").select("lang", "source")
    counts = counts.filter("term <> X''")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")) \
        .filter(F.col("df") >= min_docs).select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("id"))
    kept = cut_lineage(kept.withColumn("block", F.shiftright("id", BLOCK_BITS)), "kept_terms")
    entries = cut_lineage(counts.join(kept, ["lang", "term"]).select(
        "lang", "source", "block", "id", "n", "lang_n", F.col("term").cast("string").alias("term")), "term_entries")

    # One row per group: its place in its language, N + V of its own and of its language.
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    num = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    stats = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0) \
        .select("lang", "source", num.alias("num"), (F.col("total") + F.col("terms")).alias("d"),
                (F.col("lang_total") + F.col("terms")).alias("lang_d"))
    tiles = F.floor(F.max("num").over(Window.partitionBy("lang")) / TILE).cast("int")
    stats = cut_lineage(stats.withColumn("last", tiles).withColumn("tile", F.floor(F.col("num") / TILE).cast("int")), "groups")

    # Every group meets every block of its language; one without terms there has no array.
    blocks = kept.groupBy("lang", "block").agg(F.count("*").alias("v"))
    sided = stats.join(blocks, "lang", "left").withColumn("block", F.coalesce("block", F.lit(-1))) \
        .withColumn("v", F.coalesce("v", F.lit(0))).withColumn("d", F.greatest("d", F.lit(1)))
    sorted_terms = F.sort_array(F.collect_list(F.struct("id", "n")))
    arrays = entries.groupBy("lang", "source", "block").agg(sorted_terms.alias("a")) \
        .select("lang", "source", "block", F.col("a.id").alias("ids"), F.col("a.n").alias("ns"))
    arrays = cut_lineage(sided.join(arrays, ["lang", "source", "block"], "left"), "group_arrays")
    key = ["lang", "block", "low", "high"]
    cols = [*key, "num", "source", "ids", "ns", "d", "v"]
    left = arrays.withColumn("low", F.col("tile")).withColumn("high", F.explode(F.sequence("tile", "last"))).select(cols)
    right = arrays.withColumn("high", F.col("tile")).withColumn("low", F.explode(F.sequence(F.lit(0), "tile"))).select(cols)
    priced = left.groupBy(*key).cogroup(right.groupBy(*key)) \
        .applyInPandas(_pair_task, "lang string, source string, item string, value long")
    pairs = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    p, q = F.col("p"), F.col("q")
    terms = entries.join(sided.select("lang", "source", "block", "d", "lang_d"), ["lang", "source", "block"]) \
        .select("lang", "source", F.col("term").alias("item"), price_column(F.col("n"), F.col("d")).alias("p"),
                price_column(F.col("lang_n"), F.col("lang_d")).alias("q")).filter("p > q") \
        .select("lang", "source", "item", _div((p - q) * (p - q), q).alias("value")) \
        .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms.withColumn("part", F.lit("term")))
