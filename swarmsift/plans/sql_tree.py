"""DuckDB text of the prepared documents table and of a depth-1 batched
tree over a hash-generated population — the oracle for tree, metrics and
fitness keys.  Written independently of the Spark code path, following the
same definitions (rank-⌈p·n⌉ cuts, "x ≤ cut" bins, entropy gain rounded to
9 decimals, first-wins order feature → bin, most frequent class)."""

from __future__ import annotations

from ..sources import fixtures as X
from ..sources import sqlgen as g

FEATS = X.D_FEATURES
N = len(FEATS)
POP = 8
P_INIT = 0.3
SEED = 13
LAM = 0.01
MAX_BINS = 32


def _q(c):
    return g.qi(c, "duckdb")


def impute(c):
    x = f"TRY_CAST({_q(c)} AS DOUBLE)"
    return (f"CASE WHEN NOT (isnan({x}) OR {x} IS NULL OR {x} = CAST('inf' AS DOUBLE) "
            f"OR {x} = CAST('-inf' AS DOUBLE)) THEN {x} ELSE 0.0 END")


def _cuts(source, cols, nb):
    from .queries_model import sql_cuts
    return sql_cuts(source, cols, nb)


def base_ctes() -> str:
    split = g.u("duckdb", 13, "split", "doc_id")
    imp = ", ".join(f"{impute(c)} AS {_q(c)}" for c in FEATS)
    bins = ", ".join(
        f"CAST(len(list_filter((SELECT list(value ORDER BY split_idx) FROM cuts WHERE \"column\" = '{c}')"
        f"[2:-2], lambda s: s < {_q(c)})) AS INTEGER)" for c in FEATS)
    return f"""d AS ({X.doc_features_sql()}),
b AS (SELECT doc_id, "Target", {split} < 0.8 AS is_train, {imp} FROM d),
tr AS (SELECT * FROM b WHERE is_train),
lab AS (SELECT "Target" AS label, CAST(row_number() OVER (ORDER BY count(*) DESC, "Target") - 1 AS INTEGER) AS label_idx
        FROM tr WHERE "Target" IS NOT NULL GROUP BY "Target"),
cuts AS {_cuts('tr', FEATS, MAX_BINS)},
rows AS (SELECT b.doc_id, b.is_train, coalesce(lab.label_idx, (SELECT count(*) FROM lab)) AS label, [{bins}] AS bins
         FROM b LEFT JOIN lab ON b."Target" = lab.label)"""


def pop_ctes(pop=POP, p=P_INIT, seed=SEED, tag="init", gen=0) -> str:
    bit = (f"CASE WHEN {g.u('duckdb', seed, tag, str(gen), 'member', 'j')} < {p} THEN 1 ELSE 0 END")
    fix = f"CAST(floor({g.u('duckdb', seed, tag + '.fix', str(gen), 'member')} * {N}) AS INTEGER)"
    return f"""pm AS (SELECT CAST(range AS INTEGER) AS member FROM range({pop})),
pr AS (SELECT member, list_transform(range({N}), lambda j: {bit}) AS raw FROM pm),
pop AS (SELECT member, CASE WHEN list_sum(raw) = 0
          THEN list_transform(range({N}), lambda i: CASE WHEN i = {fix} THEN 1 ELSE raw[i + 1] END)
          ELSE raw END AS mask FROM pr),
cands AS (SELECT member, CAST(row_number() OVER (ORDER BY member) - 1 AS INTEGER) AS cand, mask,
                 list_filter(list_transform(range({N}), lambda i: CASE WHEN mask[i + 1] = 1 THEN CAST(i AS INTEGER) END),
                             lambda x: x IS NOT NULL) AS feats FROM pop)"""


def _h(a, b):
    """Entropy (log2) of two class counts, Spark's operation order."""
    a, b = f"({a})", f"({b})"
    n = f"({a} + {b})"
    t = lambda c: f"(CASE WHEN {c} > 0 THEN -({c} / {n}) * log2({c} / {n}) ELSE 0.0 END)"
    return f"(CASE WHEN {n} > 0 THEN {t(a)} + {t(b)} ELSE 0.0 END)"


GAIN = (f"round({_h('t0', 't1')} - ((l0 + l1) / (t0 + t1)) * {_h('l0', 'l1')} "
        f"- (((t0 + t1) - (l0 + l1)) / (t0 + t1)) * {_h('t0 - l0', 't1 - l1')}, 9)")


def tree_ctes() -> str:
    return f"""cf AS (SELECT cand, CAST(unnest(feats) AS INTEGER) AS f FROM cands),
hist AS (SELECT c.cand, 1 AS node, c.f, r.bins[c.f + 1] AS b,
                count(*) FILTER (WHERE r.label = 0) AS c0, count(*) FILTER (WHERE r.label = 1) AS c1
         FROM rows r JOIN cf c ON TRUE WHERE r.is_train GROUP BY 1, 2, 3, 4),
cum AS (SELECT *, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1,
               sum(c0) OVER (PARTITION BY cand, node, f) AS t0, sum(c1) OVER (PARTITION BY cand, node, f) AS t1
        FROM hist WINDOW w AS (PARTITION BY cand, node, f ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sc AS (SELECT *, (l0 + l1) >= 1 AND ((t0 + t1) - (l0 + l1)) >= 1 AS valid, {GAIN} AS gain FROM cum),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand, node ORDER BY valid DESC, gain DESC, f, b) AS rk
         FROM sc) WHERE rk = 1),
model AS (SELECT cand, t0 + t1 AS n, valid AND gain > 0 AS is_split, f, b, gain,
                 CASE WHEN t1 > t0 THEN 1 ELSE 0 END AS root_pred,
                 CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS left_pred,
                 CASE WHEN (t1 - l1) > (t0 - l0) THEN 1 ELSE 0 END AS right_pred,
                 t0, t1, l0, l1 FROM best),
pred AS (SELECT m.cand, CAST(r.label AS DOUBLE) AS label,
                CAST(CASE WHEN NOT m.is_split THEN m.root_pred WHEN r.bins[m.f + 1] > m.b THEN m.right_pred
                          ELSE m.left_pred END AS DOUBLE) AS prediction
         FROM rows r JOIN model m ON TRUE WHERE NOT r.is_train),
""" + score_ctes()


def score_ctes() -> str:
    """Metrics per candidate from pred (cand, label, prediction)."""
    return """conf AS (SELECT cand, label, prediction, count(*) AS count FROM pred GROUP BY 1, 2, 3),
act AS (SELECT cand, label AS cls, sum(count) AS support, sum(CASE WHEN label = prediction THEN count ELSE 0 END) AS tp
        FROM conf GROUP BY 1, 2),
prd AS (SELECT cand, prediction AS cls, sum(count) AS npred FROM conf GROUP BY 1, 2),
per AS (SELECT a.cand, a.cls, a.support, a.tp, coalesce(p.npred, 0) AS npred,
               CASE WHEN coalesce(p.npred, 0) > 0 THEN a.tp / p.npred ELSE 0.0 END AS prec,
               CASE WHEN a.support > 0 THEN a.tp / a.support ELSE 0.0 END AS rec
        FROM act a LEFT JOIN prd p ON a.cand = p.cand AND a.cls = p.cls),
per2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1c FROM per),
met AS (SELECT cand, sum(tp) / sum(support) AS accuracy, sum(f1c * support) / sum(support) AS f1,
               sum(prec * support) / sum(support) AS "weightedPrecision",
               sum(rec * support) / sum(support) AS "weightedRecall", avg(f1c) AS macro_f1
        FROM per2 GROUP BY cand)"""


def with_all() -> str:
    return "WITH " + base_ctes() + ",\n" + pop_ctes() + ",\n" + tree_ctes() + "\n"


ALL_FEATURES = f"cands AS (SELECT 0 AS member, 0 AS cand, list_transform(range({N}), lambda i: CAST(i AS INTEGER)) AS feats)"


def grow_ctes(depth: int) -> str:
    """Trees of any depth, level by level: nodes (cand, node, depth, n, f, b, gain, pred) and
    pred (cand, label, prediction) of the test rows."""
    out = ["at_0 AS MATERIALIZED (SELECT c.cand, c.feats, r.is_train, r.label, r.bins, 1 AS node, TRUE AS live FROM rows r JOIN cands c ON TRUE)"]
    for i in range(depth):
        out.append(f"""hist_{i} AS (SELECT cand, node, f, bins[f + 1] AS b, count(*) FILTER (WHERE label = 0) AS c0,
    count(*) FILTER (WHERE label = 1) AS c1
  FROM (SELECT cand, node, CAST(unnest(feats) AS INTEGER) AS f, bins, label FROM at_{i} WHERE is_train AND live) GROUP BY 1, 2, 3, 4),
cum_{i} AS (SELECT *, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1,
    sum(c0) OVER (PARTITION BY cand, node, f) AS t0, sum(c1) OVER (PARTITION BY cand, node, f) AS t1
  FROM hist_{i} WINDOW w AS (PARTITION BY cand, node, f ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gain_{i} AS (SELECT *, (l0 + l1) >= 1 AND ((t0 + t1) - (l0 + l1)) >= 1 AS valid, {GAIN} AS gain FROM cum_{i}),
best_{i} AS MATERIALIZED (SELECT *, valid AND gain > 0 AS is_split FROM (SELECT *, row_number() OVER (
    PARTITION BY cand, node ORDER BY valid DESC, gain DESC, f, b) AS rk FROM gain_{i}) WHERE rk = 1),
at_{i + 1} AS MATERIALIZED (SELECT a.cand, a.feats, a.is_train, a.label, a.bins, coalesce(m.is_split, FALSE) AS live,
    CASE WHEN m.is_split THEN 2 * a.node + CASE WHEN a.bins[m.f + 1] > m.b THEN 1 ELSE 0 END ELSE a.node END AS node
  FROM at_{i} a LEFT JOIN best_{i} m ON a.live AND a.cand = m.cand AND a.node = m.node)""")
    level = " UNION ALL ".join(f"""SELECT cand, node, {i} AS depth, t0 + t1 AS n, CASE WHEN is_split THEN f END AS f,
    CASE WHEN is_split THEN b END AS b, CASE WHEN is_split THEN gain END AS gain, CASE WHEN t1 > t0 THEN 1 ELSE 0 END AS pred FROM best_{i}"""
                               for i in range(depth))
    last = depth - 1
    out.append(f"""nodes AS MATERIALIZED ({level}
  UNION ALL SELECT cand, 2 * node, {depth}, l0 + l1, NULL, NULL, NULL, CASE WHEN l1 > l0 THEN 1 ELSE 0 END FROM best_{last} WHERE is_split
  UNION ALL SELECT cand, 2 * node + 1, {depth}, (t0 - l0) + (t1 - l1), NULL, NULL, NULL,
    CASE WHEN (t1 - l1) > (t0 - l0) THEN 1 ELSE 0 END FROM best_{last} WHERE is_split),
pred AS (SELECT a.cand, CAST(a.label AS DOUBLE) AS label, CAST(n.pred AS DOUBLE) AS prediction
  FROM at_{depth} a JOIN nodes n ON a.cand = n.cand AND a.node = n.node WHERE NOT a.is_train)""")
    return ",\n".join(out)


def with_depth(depth: int, cands: str | None = None) -> str:
    """All CTEs up to metrics for trees of ``depth`` over the hashed population (or ``cands``)."""
    return "WITH " + ",\n".join([base_ctes(), cands or pop_ctes(), grow_ctes(depth), score_ctes()]) + "\n"
