"""Test fixtures derived from the given parquet tables.

Each fixture is a list of ``(output_name, sql_expression_template)`` over one
base table, rendered for Spark (``selectExpr``) and for DuckDB (the oracle),
so both sides are built from the same text.  All randomness is the
hash-uniform of :mod:`swarmsift.functions.rng`, keyed by table keys, so a
fixture does not depend on partitioning.  Fixtures grow with the tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from . import sqlgen as g

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Fixed dirt tokens injected into the string view of lineitem: every
# literal edge case of the tolerant cast.
DIRT_TOKENS = ["'inf'", "' inf'", "'+inf'", "'-Infinity'", "'NaN'", "'nan'", "''",
               "'abc'", "'-5'", "'0'", "'1e3'", "NULL"]
DIRT_RATE = 0.03

# Flow-style names over lineitem columns (numeric features of DL).
DL_NUMERIC = [
    ("Flow Duration", "l_extendedprice"),
    ("Tot Fwd Pkts", "l_quantity"),
    ("Tot Bwd Pkts", "l_linenumber"),
    ("Fwd Header Len", "l_tax"),
    ("Flow Byts/s", "l_discount"),
    ("Flow Pkts/s", "l_partkey % 7"),
    ("Flow IAT Min", "l_suppkey - 50"),
    ("Pkt Len Min", "l_linenumber - 1"),
    ("Pkt Len Max", "l_orderkey % 13"),
    ("Pkt Len Mean", "l_partkey % 50"),
    ("Dst Port", "l_suppkey"),
    ("Fwd IAT Min", "l_partkey % 1000"),
    ("Idle Std", "l_orderkey % 97"),
]
DL_DROPPED = [
    ("Protocol", "l_linestatus"),
    ("Timestamp", "CAST(CAST(l_shipdate AS DATE) AS {S})"),
    ("Flow ID", "CAST(l_orderkey AS {S})"),
    ("Src Port", "CAST(l_partkey AS {S})"),
]
# Columns absent from each of the two CSV files of the union test.
DL_ONLY_A = ["Idle Std", "Src Port"]   # missing from file B
DL_ONLY_B = ["Fwd IAT Min", "Timestamp"]  # missing from file A


def _lkey() -> tuple:
    return tuple(LINEITEM_KEY)


def dirty_lineitem_exprs(dialect: str, stage: int = 2) -> list:
    """Stage 1 computes each hash once (``__u_*``); stage 2 builds the dirty
    strings from them, which keeps generated code small."""
    S = g.s(dialect)
    if stage == 1:
        out = [(k, k) for k in LINEITEM_KEY] + [(c, c) for c in (
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            "l_linestatus", "l_shipdate")]
        out.append(("__u_hdr", g.u_chunk(dialect, 7, "dl.meta", 0, *_lkey())))
        out.append(("__u_file", g.u_chunk(dialect, 7, "dl.meta", 1, *_lkey())))
        for i, (name, _) in enumerate(DL_NUMERIC):
            out.append((f"__u_{i}", g.u_chunk(dialect, 7, f"dl.dirt{i // 4}", i % 4, *_lkey())))
        return out
    label = ("CASE WHEN __u_hdr < 0.004 THEN 'Label' WHEN __u_hdr < 0.008 THEN NULL "
             "WHEN l_returnflag = 'N' THEN 'Benign' WHEN l_returnflag = 'R' THEN 'DoS' ELSE 'Bot' END")
    out = [("Label", label)]
    for i, (name, base) in enumerate(DL_NUMERIC):
        ud = f"__u_{i}"
        tok = "CASE CAST(floor(" + ud + f" / {DIRT_RATE} * {len(DIRT_TOKENS)}) AS INT) " + " ".join(
            f"WHEN {j} THEN {t}" for j, t in enumerate(DIRT_TOKENS)) + " ELSE NULL END"
        out.append((name, f"CASE WHEN {ud} < {DIRT_RATE} THEN {tok} ELSE CAST({base} AS {S}) END"))
    for name, base in DL_DROPPED:
        out.append((name, base.format(S=S)))
    out.append(("__file", "CASE WHEN __u_file < 0.5 THEN 'a' ELSE 'b' END"))
    return out


def d_exprs(dialect: str) -> list:
    """Documents ⋈ labels → numeric text features + binary Target."""
    t = "text"
    n = f"greatest(length({t}), 1)"
    out = [
        ("doc_id", "doc_id"),
        ("n_chars", f"CAST(length({t}) AS BIGINT)"),
        ("n_words", f"CAST(length({t}) - length(replace({t}, ' ', '')) + 1 AS BIGINT)"),
        ("n_lines", f"CAST(length({t}) - length(replace({t}, chr(10), '')) + 1 AS BIGINT)"),
        ("upper_ratio", f"(length({t}) - length({g.regex_strip(dialect, t, '[A-Z]')})) / {n}"),
        ("digit_ratio", f"(length({t}) - length({g.regex_strip(dialect, t, '[0-9]')})) / {n}"),
        ("punct_ratio", f"(length({t}) - length({g.regex_strip(dialect, t, '[.,;:!?]')})) / {n}"),
        ("symbol_ratio", f"length({g.regex_strip(dialect, t, '[A-Za-z0-9 .,;:!?]')}) / {n}"),
    ]
    for j in range(1, 5):
        out.append((f"noise_{j}", g.u(dialect, 11, f"d.noise{j}", "doc_id")))
    out.append(("Target", "CASE WHEN quality = 1 THEN 'Benign' ELSE 'Attack' END"))
    return out


D_FEATURES = ["n_chars", "n_words", "n_lines", "upper_ratio", "digit_ratio", "punct_ratio",
              "symbol_ratio", "noise_1", "noise_2", "noise_3", "noise_4"]


def e_exprs(dialect: str) -> list:
    out = [("vec_id", "vec_id")]
    for j in range(64):
        out.append((f"f{j:02d}", f"CAST({g.elem(dialect, 'embedding', str(j + 1))} AS DOUBLE)"))
    out.append(("Target", f"CAST(label AS {g.s(dialect)})"))
    return out


E_FEATURES = [f"f{j:02d}" for j in range(64)]


def f_exprs(dialect: str) -> list:
    return [(k, k) for k in LINEITEM_KEY] + [
        ("l_quantity", "l_quantity"),
        ("l_extendedprice", "l_extendedprice"),
        ("l_discount", "l_discount"),
        ("l_tax", "l_tax"),
        ("amt", "l_quantity * l_extendedprice"),
        ("days", f"CAST({g.days_since(dialect, 'l_shipdate', '1992-01-01')} AS DOUBLE)"),
        ("Target", "CASE WHEN l_returnflag = 'N' THEN 'Benign' ELSE 'Attack' END"),
    ]


F_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "amt", "days"]


# Columns that decide the planted label of the wide table: Attack when two of the three
# conditions hold, turned over for a hashed share of the rows.
W_PLANTED = ["l_quantity", "p_size", "c_acctbal"]
W_FLIPPED = 0.04
_W_HELD = "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END + CASE WHEN p_size > 25 THEN 1 ELSE 0 END + CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END"


def w_exprs(dialect: str) -> list:
    """The wide flow table over lineitem joined with orders, part, supplier, customer, their
    nations and four groupings (see :func:`wide_source`): key, 66 features, Target."""
    def n(x):
        return f"CAST({x} AS DOUBLE)"

    def day(x):
        return n(g.days_since(dialect, x, "1992-01-01"))
    out = [(k, k) for k in LINEITEM_KEY]
    out += [(c, n(c)) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    out += [
        ("line_no", n("l_linenumber")),
        ("unit_price", "l_extendedprice / l_quantity"),
        ("disc_price", "l_extendedprice * (1 - l_discount)"),
        ("charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"),
        ("ship_day", day("l_shipdate")), ("ship_year", n("year(l_shipdate)")),
        ("ship_month", n("month(l_shipdate)")), ("ship_dom", n("day(l_shipdate)")),
        ("o_totalprice", n("o_totalprice")), ("order_day", day("o_orderdate")),
        ("order_year", n("year(o_orderdate)")), ("order_month", n("month(o_orderdate)")),
        ("order_priority", n("ascii(o_orderpriority)")), ("order_status", n("ascii(o_orderstatus)")),
        ("days_to_ship", f"{day('l_shipdate')} - {day('o_orderdate')}"),
        ("p_size", n("p_size")), ("p_retailprice", n("p_retailprice")),
        ("p_brand_no", "CAST(substr(p_brand, 7) AS DOUBLE)"),
        ("p_type_len", n("length(p_type)")), ("p_name_len", n("length(p_name)")),
        ("s_acctbal", n("s_acctbal")), ("s_nation", n("s_nationkey")), ("s_region", n("s_regionkey")),
        ("c_acctbal", n("c_acctbal")), ("c_nation", n("c_nationkey")), ("c_region", n("c_regionkey")),
        ("c_segment_len", n("length(c_mktsegment)")),
        ("price_share", "l_extendedprice / greatest(o_totalprice, 1.0)"),
        ("price_over_retail", "l_extendedprice / greatest(p_retailprice, 1.0)"),
        ("same_nation", "CASE WHEN s_nationkey = c_nationkey THEN 1.0 ELSE 0.0 END"),
        ("same_region", "CASE WHEN s_regionkey = c_regionkey THEN 1.0 ELSE 0.0 END"),
        ("discount_less_tax", "l_discount - l_tax"), ("price_times_tax", "l_extendedprice * l_tax"),
    ]
    for by in ("order", "part", "supp", "cust"):
        out += [(f"{by}_lines", n(f"{by}_lines")), (f"{by}_discount", n(f"{by}_discount")), (f"{by}_price", n(f"{by}_price")),
                (f"{by}_tax", n(f"{by}_tax"))]
    for j in range(16):
        out.append((f"hashed_{j:02d}", g.u_chunk(dialect, 17, f"w.{j // 4}", j % 4, *LINEITEM_KEY)))
    out.append(("Target", f"CASE WHEN (({_W_HELD}) >= 2) <> ({g.u(dialect, 17, 'w.flip', *LINEITEM_KEY)} < {W_FLIPPED}) THEN 'Attack' ELSE 'Benign' END"))
    return out


W_FEATURES = [name for name, _ in w_exprs("spark") if name not in (*LINEITEM_KEY, "Target")]

# Groupings whose counts and extremes become features: prefix, key.
W_GROUPS = [("order", "l_orderkey"), ("part", "l_partkey"), ("supp", "l_suppkey"), ("cust", "o_custkey")]


def wide_source() -> str:
    """SQL of the joined rows, the same for both engines; values are exact (counts, extremes)."""
    groups = " ".join(
        f"JOIN (SELECT {key} AS {by}_key, count(*) AS {by}_lines, max(l_discount) AS {by}_discount, max(l_extendedprice) AS {by}_price, "
        f"min(l_tax) AS {by}_tax FROM {'lineitem' if by != 'cust' else 'lineitem JOIN orders ON l_orderkey = o_orderkey'} "
        f"GROUP BY {key}) g_{by} ON {key} = {by}_key" for by, key in W_GROUPS)
    return ("SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey "
            "JOIN (SELECT s_suppkey, s_acctbal, s_nationkey, n_regionkey AS s_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) s "
            "ON l_suppkey = s_suppkey "
            "JOIN (SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey, n_regionkey AS c_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) c "
            "ON o_custkey = c_custkey " + groups)


def p_exprs(dialect: str) -> list:
    """Population table over the 64 embedding dimensions, one member per
    embeddings row: bit = component > 0; objective and trials hashed from
    the row key."""
    mask = g.transform(dialect, "embedding", "x", "CASE WHEN x > 0 THEN 1 ELSE 0 END")
    return [
        ("member", "CAST(vec_id AS INT)"),
        ("mask", mask),
        ("obj", f"round({g.u(dialect, 5, 'p.obj', 'vec_id')}, 6)"),
        ("trials", g.randint(dialect, 5, "p.trials", "6", "vec_id")),
    ]


# ---------------------------------------------------------------- rendering

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _render(spark, df: DataFrame, exprs: list) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {g.qi(n, 'spark')}" for n, e in exprs])


def sql_select(exprs: list, source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {g.qi(n, 'duckdb')}" for n, e in exprs) + f" FROM {source}"


def _below(digits: str, rate: float) -> str:
    """Whether the uniform of eight hex digits is below ``rate``, without making the number."""
    least = math.ceil(rate * 2 ** 32 - 0.5)  # (n + 0.5) / 2^32 is exact
    return f"{digits} < '{least:08x}'"


def dirty_lineitem(spark, sf_dir) -> DataFrame:
    """The rows of :func:`dirty_lineitem_sql`.  Each digest is made once a row; a number is made
    of its digits only for the rows that get a token."""
    keys = ", ".join(f"CAST({k} AS STRING)" for k in LINEITEM_KEY)
    tags = ["dl.meta"] + [f"dl.dirt{i}" for i in range(-(-len(DL_NUMERIC) // 4))]
    rows = read(spark, sf_dir, "lineitem").select("*", *[
        F.expr(f"md5(concat_ws(':', '7', '{t}', {keys}))").alias(f"__{t}") for t in tags])

    def digits(tag, chunk):
        return f"substring(`__{tag}`, {1 + 8 * chunk}, 8)"
    header = digits("dl.meta", 0)
    out = [("Label", f"CASE WHEN {_below(header, 0.004)} THEN 'Label' WHEN {_below(header, 0.008)} THEN NULL "
                     "WHEN l_returnflag = 'N' THEN 'Benign' WHEN l_returnflag = 'R' THEN 'DoS' ELSE 'Bot' END")]
    # One lambda for all values: as thirteen expressions they were one method too long for the JVM to compile.
    number = "((CAST(conv(d, 16, 10) AS DOUBLE) + 0.5) / 4294967296.0)"
    token = f"get(array({', '.join(DIRT_TOKENS)}), CAST(floor({number} / {DIRT_RATE} * {len(DIRT_TOKENS)}) AS INT))"
    drawn = ", ".join(digits(f"dl.dirt{i // 4}", i % 4) for i in range(len(DL_NUMERIC)))
    plain = ", ".join(f"CAST({base} AS STRING)" for _, base in DL_NUMERIC)
    rows = rows.select("*", F.expr(
        f"zip_with(array({drawn}), array({plain}), (d, x) -> CASE WHEN {_below('d', DIRT_RATE)} THEN {token} ELSE x END)").alias("__values"))
    out += [(name, f"get(__values, {i})") for i, (name, _) in enumerate(DL_NUMERIC)]
    out += [(name, base.format(S="STRING")) for name, base in DL_DROPPED]
    out.append(("__file", f"CASE WHEN {_below(digits('dl.meta', 1), 0.5)} THEN 'a' ELSE 'b' END"))
    return _render(spark, rows, out)


def dirty_lineitem_sql() -> str:
    inner = sql_select(dirty_lineitem_exprs("duckdb", 1), "lineitem")
    return sql_select(dirty_lineitem_exprs("duckdb", 2), f"({inner})")


def doc_features(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return _render(spark, docs.join(labels, "doc_id"), d_exprs("spark"))


def doc_features_sql() -> str:
    return sql_select(d_exprs("duckdb"),
                      "(SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l USING (doc_id))")


# Features of one dimension's columns alone, made before its rows meet those of lineitem.
W_EARLY = {"orders": ["order_priority", "order_status"], "part": ["p_brand_no", "p_type_len", "p_name_len"], "customer": ["c_segment_len"]}

# Most suppliers that are sent to every task (some 80 bytes each); beyond, they are joined by shuffle.
W_SUPPLIERS = 500_000


def wide_table(spark, sf_dir) -> DataFrame:
    """The rows of :func:`wide_table_sql`.

    What belongs to one part or order (its groupings and its customer too) is put together where
    its key already is: groupings of parts and customers are windows over the rows that meet the
    part or customer there, not aggregates dealt out on their own.  A row of lineitem is dealt
    twice, by part and by order, and only with the columns it has by then; suppliers come last.
    Features of several tables are made after the last join."""
    exprs = dict(w_exprs("spark"))
    lines, orders, part, supplier, customer, nation = (
        read(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier", "customer", "nation"))
    lines = lines.select(*LINEITEM_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    keys = dict(W_GROUPS)

    def group(by):
        return lines.groupBy(F.col(keys[by]).alias(f"{by}_key")).agg(
            F.count("*").alias(f"{by}_lines"), F.max("l_discount").alias(f"{by}_discount"),
            F.max("l_extendedprice").alias(f"{by}_price"), F.min("l_tax").alias(f"{by}_tax"))

    def early(table):
        return [F.expr(exprs[name]).alias(name) for name in W_EARLY[table]]

    def with_region(df, by):
        regions = nation.select("n_nationkey", F.col("n_regionkey").alias(f"{by}_regionkey"))
        return df.join(regions, F.col(f"{by}_nationkey") == F.col("n_nationkey")).drop("n_nationkey")

    supplier = with_region(supplier.select("s_suppkey", "s_acctbal", "s_nationkey"), "s")
    few = supplier.count()
    supplier = supplier.join(group("supp"), F.col("s_suppkey") == F.col("supp_key")).drop("supp_key")

    def with_supplier(df):
        return df.join(maybe_broadcast(supplier, few, W_SUPPLIERS), F.col("l_suppkey") == F.col("s_suppkey"))

    # A customer's lines are those of the orders: counts add up, extremes are those of the extremes.
    orders = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", *early("orders")) \
        .join(group("order"), F.col("o_orderkey") == F.col("order_key")).drop("order_key").filter("o_custkey is not null")
    of_cust = Window.partitionBy("o_custkey")
    orders = orders.withColumns({"cust_lines": F.sum("order_lines").over(of_cust), "cust_discount": F.max("order_discount").over(of_cust),
                                 "cust_price": F.max("order_price").over(of_cust), "cust_tax": F.min("order_tax").over(of_cust)})
    customer = with_region(customer.select("c_custkey", "c_acctbal", "c_nationkey", *early("customer")), "c")
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    part = part.select("p_partkey", "p_size", "p_retailprice", *early("part"))
    of_part = Window.partitionBy("l_partkey")
    rows = lines.filter("l_partkey is not null").withColumns({
        "part_lines": F.count("*").over(of_part), "part_discount": F.max("l_discount").over(of_part),
        "part_price": F.max("l_extendedprice").over(of_part), "part_tax": F.min("l_tax").over(of_part)}) \
        .join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    if few > W_SUPPLIERS:
        rows = with_supplier(rows)
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    if few <= W_SUPPLIERS:  # sent to every task: no row is dealt with its columns
        rows = with_supplier(rows)
    made = {name for names in W_EARLY.values() for name in names}
    return _render(spark, _hashed(rows), [(name, name if name in made or name.startswith("hashed_") else e) for name, e in exprs.items()
                                          if name != "Target"] + [("Target", _target())])


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with the hashed features of :func:`w_exprs` and ``__flip``, the digits that turn a
    label over.  Each digest is made once a row; one lambda makes numbers of the digits, as sixteen
    expressions were one method too long for the JVM to compile."""
    key = ", ".join(f"CAST({k} AS STRING)" for k in LINEITEM_KEY)
    rows = rows.select("*", *[F.expr(f"md5(concat_ws(':', '17', '{tag}', {key}))").alias(f"__{tag}")
                              for tag in ("w.0", "w.1", "w.2", "w.3", "w.flip")])
    digits = ", ".join(f"substring(`__w.{j // 4}`, {1 + 8 * (j % 4)}, 8)" for j in range(16))
    rows = rows.select("*", F.expr(f"transform(array({digits}), d -> ((CAST(conv(d, 16, 10) AS DOUBLE) + 0.5) / 4294967296.0))").alias("__hashed"),
                       F.expr("substring(`__w.flip`, 1, 8)").alias("__flip"))
    return rows.select("*", *[F.expr(f"get(__hashed, {j})").alias(f"hashed_{j:02d}") for j in range(16)])


def _target() -> str:
    """The label of :func:`w_exprs`, from the digits ``__flip``."""
    return f"CASE WHEN (({_W_HELD}) >= 2) <> ({_below('__flip', W_FLIPPED)}) THEN 'Attack' ELSE 'Benign' END"


def wide_table_sql() -> str:
    return sql_select(w_exprs("duckdb"), f"({wide_source()})")


def embed_features_sql() -> str:
    return sql_select(e_exprs("duckdb"), "embeddings")


def flow_lineitem_sql() -> str:
    return sql_select(f_exprs("duckdb"), "lineitem")


def population(spark, sf_dir) -> DataFrame:
    return _render(spark, read(spark, sf_dir, "embeddings"), p_exprs("spark"))


def population_sql() -> str:
    return sql_select(p_exprs("duckdb"), "embeddings")
