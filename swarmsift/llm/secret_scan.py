"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Base kinds are regular expressions over the whole text, leftmost and
non-overlapping per kind.  On top of them the method looks at every long mixed
token, hashes the values of all candidates and counts over the whole corpus in
how many repositories and by how many owners each value occurs:

* ``example``: a value that at least ``example_owners`` owners or at least
  ``example_repos`` repositories carry, that is a widely copied sample key,
  also where a single owner copied it;
* ``live``: a value with a single owner and at most ``live_repos``
  repositories, that is owner-specific;
* ``shared``: all values between.

Base spans always stay; a mixed token outside every base span becomes a span
of kind ``owned`` only if its value is live.

Positions are code points, end exclusive.  They come from the lengths of the
matches and of the gaps between them, added up in blocks (no fold appends to an
array of all matches), so the text itself is never exploded,
shuffled or copied: one pass reads it, writes the spans of each row to a small
table, and the counts and joins work on that table.  Values occurring so often
that one task could not take them (more than 1/200 of all candidates; there
can be at most 200 of these) are matched by a broadcast, the rest by hash.

Defined results: null or empty text: no spans; null owner: an owner of its
own; null repository: a repository of its own for each owner; repeated rows are
one repository and each keep a result row; very long texts and texts of many
matches are read whole; spans that start alike are ordered by kind; extra
columns, whatever their names, are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, let, running, with_row_id

# The base patterns and least lengths of the contract.
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # maximal runs, so the same as [0-9a-f]+ of 24 or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "owned")
MIXED = "[A-Za-z0-9+/_=-]{20,}"
FAR = 1 << 40  # past every position in a text
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:bigint,keep:boolean>>"


def _matches(text: Column, pattern: str, kind: int, keep, value) -> Column:
    """Spans of all matches of ``pattern``; ``keep`` and ``value`` map a matched string."""
    def spans(pairs: Column) -> Column:
        both = F.transform(pairs, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("bigint"))

        def span(x: Column, before: Column) -> Column:
            start = before + F.length(x["gap"])
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end"),
                            F.xxhash64(value(x["hit"])).alias("value"), keep(x["hit"]).alias("keep"))
        return F.filter(F.zip_with(pairs, running(both, lambda p, q: p + q), span), lambda s: s["keep"])

    def pairs(hits: Column) -> Column:
        return F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                lambda hits: F.when(F.size(hits) > 0, let(pairs(hits), spans)).otherwise(F.array().cast(SPAN)))
    return found.cast(SPAN)


def _secret_of(hit: Column) -> Column:
    return F.regexp_extract(hit, "^" + ASSIGN, 2)


def _mixed(hit: Column) -> Column:
    """Looks random: letters and digits, many different characters."""
    return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(hit, ""))) >= 12)


def base_spans(text: Column) -> Column:
    return F.concat(
        _matches(text, ASSIGN, 0, lambda h: F.length(_secret_of(h)) >= ASSIGN_LEAST, _secret_of),
        _matches(text, ACCESS, 1, lambda h: F.length(h) >= ACCESS_LEAST, lambda h: h),
        _matches(text, HEX, 2, lambda h: F.lit(True), lambda h: h))


def _apart(spans: Column) -> Column:
    """Of spans sorted by start and kind: the base ones, and the mixed ones that meet no base span.
    Bases that start before a span or with it are judged by their greatest end, later ones by the next start."""
    ends = F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0))
    starts = F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 3, FAR - s["start"]).otherwise(0))
    last, following = (running(x, lambda p, q: F.greatest(p, q)) for x in (ends, starts))
    both = F.arrays_zip(spans.alias("s"), last.alias("last"), F.reverse(following).alias("next"))
    met = lambda x: (x["last"] > x["s"]["start"]) | (FAR - x["next"] < x["s"]["end"])
    return F.transform(F.filter(both, lambda x: (x["s"]["kind"] < 3) | ~met(x)), lambda x: x["s"])


def ownership(cands: DataFrame) -> DataFrame:
    """Per value: ``repos``, ``owners`` and ``times`` over the whole corpus.
    Rows of one value and owner are summed before values meet."""
    by_repo = cands.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(
        F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.sum("n").alias("times"))


def scan(df: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id",
         carry: tuple[str, ...] = ("doc_id",), example_owners: int = 3, example_repos: int = 20,
         live_repos: int = 5) -> DataFrame:
    """``carry`` columns, ``spans`` array<struct<start, kind, end, value, keep,
    status>> sorted by start and kind, one row per input row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)],
                     F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                     F.col(repo).cast("string").alias("repo"),
                     base_spans(body).alias("base"),
                     _matches(body, MIXED, 3, _mixed, lambda h: h).alias("mixed"))
    rows = cut_lineage(with_row_id(rows.select(
        *[f"c{i}" for i in range(len(carry))], "owner", "repo",
        let(F.array_sort(F.concat("base", "mixed")), _apart).alias("found")), "row"), "secret_spans")

    cands = rows.select("row", "owner", "repo", F.explode("found").alias("s")) \
        .select("row", "owner", "repo", "s", F.col("s.value").alias("value"))
    freq = cut_lineage(ownership(cands).withColumn(
        "status", F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), "example")
        .when((F.col("owners") == 1) & (F.col("repos") <= live_repos), "live").otherwise("shared")), "secret_freq")
    total = freq.agg(F.sum("times")).first()[0] or 0
    heavy = freq.filter(F.col("times") * 200 > total)  # 200 rows at most
    marked = cands.select("row", "s", "value").join(
        F.broadcast(heavy.select("value", F.col("status").alias("hot"))), "value", "left")
    hot = marked.filter("hot is not null").select("row", "s", F.col("hot").alias("status"))
    cold = marked.filter("hot is null").select("row", "s", "value").join(
        freq.filter(F.col("times") * 200 <= total).select("value", "status"), "value")
    judged = hot.unionByName(cold.select("row", "s", "status")) \
        .filter("s.kind < 3 or status = 'live'") \
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
            "s.start", "s.kind", "s.end", "s.value", "s.keep", "status"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:bigint,keep:boolean,status:string>>")
    return rows.join(judged, "row", "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.coalesce("spans", empty).alias("spans"))


def span_list(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _equals(k: int):
    return lambda kind: kind == k


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        key, *[F.size(F.filter(F.col("spans.kind"), _equals(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
        n(lambda s: s["status"] == "live").alias("n_live"),
        n(lambda s: s["status"] == "example").alias("n_example"))


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each union of overlapping spans replaced by ``mark``."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("pos"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["pos"], F.concat(
            F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int")), F.lit(mark))) \
            .otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos"))

    done = F.aggregate(spans, zero, step)
    tail = F.substring(text, (done["pos"] + 1).cast("int"), F.length(text).cast("int"))
    return F.when(F.size(spans) > 0, F.concat(done["out"], tail)).otherwise(text)
