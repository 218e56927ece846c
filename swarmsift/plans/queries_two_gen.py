"""Whole searches over two generations with exact oracles.

The four searches of :mod:`select` run on the documents fixture with the closed-form score, in
which masks are compared exactly, and return the state after the second generation.  The oracle
scores all 2^11 masks once and follows the generations in SQL: proposals, greedy rules,
pheromone, budgets and bests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.search import abc as ABC
from ..operators.search import aco as ACO
from ..operators.search import fpa as FPA
from ..operators.search import pso as PSO
from ..session import scratch_path
from ..sources import sqlgen as g
from . import select as SEL
from . import sql_search as S
from . import sql_tree as ST
from .queries_model import d_tree
from .registry import register
from .state import Generations

N, SEED = ST.N, 13
#: Place of each feature in the order that repair goes by (a parameter).
ORDER = [(7 * i + 3) % N for i in range(N)]
LAM = 0.01

ABC_PRM = ABC.ABCParams(num_bees=6, max_iters=2, limit=2, lam=LAM, seed=SEED)
ACO_PRM = ACO.ACOParams(num_ants=6, iters=2, alpha=1.0, beta=0.5, rho=0.25, q=1.0, seed=SEED, max_evals=10, patience=5,
                        heuristic=True)
FPA_PRM = FPA.FPAParams(pop_size=6, iters=2, seed=SEED, elitism=1, patience=5, max_evals=13, init_k=4)
PSO_PRM = PSO.PSOParams(swarm_size=3, iters=2, w=0.7, c1=1.4, c2=1.4, vmax=4.0, seed=SEED, restarts=2)
K_MIN, K_MAX, PSO_LAM, PSO_CAP, PSO_BIG = 2, 4, 0.03, 3, 0.10


def U(tag, *keys):
    return g.u("duckdb", SEED, tag, *[str(k) for k in keys])


def bits(expr: str) -> str:
    return f"list_transform(range({N}), lambda i: CAST({expr} AS INTEGER))"


def code(mask: str) -> str:
    return f"CAST(list_sum(list_transform(range({N}), lambda i: CAST({mask}[i + 1] AS BIGINT) << i)) AS BIGINT)"


# ------------------------------------------------------------------ all masks, scored

SCORES = "WITH " + ST.base_ctes() + f""",
packed AS MATERIALIZED (SELECT label, CAST(list_sum(list_transform(range({N}), lambda i: CAST(bins[i + 1] // 8 AS BIGINT) << (2 * i))) AS BIGINT) AS cells,
  count(*) AS n FROM rows WHERE is_train GROUP BY ALL),
every AS (SELECT r.range AS code, CAST(bit_count(r.range) AS INTEGER) AS k,
  CAST(list_sum(list_transform(range({N}), lambda i: ((r.range >> i) & 1) * (CAST(3 AS BIGINT) << (2 * i)))) AS BIGINT) AS chosen
  FROM range({1 << N}) r),
cell AS (SELECT code, k, label, cells & chosen AS cell, sum(n) AS n FROM packed, every GROUP BY ALL),
given AS (SELECT code, k, label, n, -n * log2(n / sum(n) OVER (PARTITION BY code, cell)) AS bits FROM cell),
per AS (SELECT code, k, label, sum(n) AS n, sum(bits) AS bits FROM given GROUP BY ALL),
own AS (SELECT code, k, bits, -n * log2(n / sum(n) OVER (PARTITION BY code)) AS alone FROM per),
score AS MATERIALIZED (SELECT code, k, CASE WHEN k = 0 OR sum(alone) <= 0 THEN 0.0 ELSE round(1 - sum(bits) / sum(alone), 6) + 0.0 END AS f1
  FROM own GROUP BY code, k),
"""


def penalised() -> str:
    return f"CASE WHEN k = 0 THEN -1.0 ELSE f1 - CAST({LAM} AS DOUBLE) * k / CAST({N} AS DOUBLE) END"


def hardcap() -> str:
    return f"f1 - CAST({PSO_LAM} AS DOUBLE) * k - CAST({PSO_BIG} AS DOUBLE) * greatest(k - {PSO_CAP}, 0)"


def scored(source: str, mask: str = "mask", objective: str | None = None, obj: str = "obj", k: str = "k") -> str:
    """``source`` with the objective and the size of its masks."""
    return (f"(SELECT s.*, v.obj AS {obj}, v.k AS {k} FROM {source} s JOIN (SELECT code, k, {objective or penalised()} AS obj "
            f"FROM score) v ON v.code = {code('s.' + mask)})")


def better(new: str, old: str, new_k: str, old_k: str) -> str:
    return f"(({new} > {old}) OR (abs({new} - {old}) < 1e-12 AND {new_k} < {old_k}))"


def repaired(k_min: int, k_max: int) -> str:
    return S.repair_sql(k_min, k_max, N)


ORDER_CTE = f"O AS (SELECT {ORDER} AS o)"


def sized(source: str) -> str:
    return f"(SELECT *, CAST(list_sum(mask) AS INTEGER) AS k FROM {source})"


def _state(spark, folder, algo, data, prm, iters, **more):
    return Generations(spark, f"{folder}/{algo}", {"algo": algo, "features": list(data.features), **{
        k: v for k, v in SEL.asdict(prm).items() if k != iters}, **more}).latest(2)


# ------------------------------------------------------------------ bees

def _abc_sql() -> str:
    b = ABC_PRM.num_bees
    out = [SCORES + f"p_0 AS MATERIALIZED (SELECT member, member AS idx, mask, obj, k, 0 AS trials FROM "
           + scored(S.masks_sql(f"(SELECT CAST(range AS INTEGER) AS member FROM range({b}))", 0.3, "abc.init", ("0",), N)) + ")"]
    for t in (1, 2):
        emp = (str(t), "'emp'", "idx")
        onl = (str(t), "'onl'", "onlooker")
        out.append(f"""q_{t} AS MATERIALIZED (SELECT a.*, a.mask AS x, b.mask AS y FROM p_{t - 1} a JOIN p_{t - 1} b
  ON b.idx = (a.idx + 1 + CAST(floor({U('abc.emp.k', t, "'emp'", 'a.idx')} * {b - 1}) AS INTEGER)) % {b})""")
        out.append(S._nb_ctes(f"q_{t}", emp, f"e_{t}", N))
        out.append(f"""e_{t} AS MATERIALIZED (SELECT member, idx, CASE WHEN acc THEN cand ELSE mask END AS mask, CASE WHEN acc THEN cand_obj ELSE obj END AS obj,
  CASE WHEN acc THEN cand_k ELSE k END AS k, CASE WHEN acc THEN 0 ELSE trials + 1 END AS trials
  FROM (SELECT *, {better('cand_obj', 'obj', 'cand_k', 'k')} AS acc FROM {scored(f'Ce_{t}', 'cand', obj='cand_obj', k='cand_k')}))""")
        out.append(f"""sh_{t} AS (SELECT idx, obj - (SELECT min(obj) FROM e_{t}) + 1e-9 AS s FROM e_{t}),
hi_{t} AS (SELECT idx, sum(s / (SELECT sum(s) FROM sh_{t})) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM sh_{t}),
pk_{t} AS MATERIALIZED (SELECT onlooker, coalesce(min(h.idx), 0) AS idx FROM
  (SELECT CAST(range AS INTEGER) AS onlooker, {U('abc.onl.r', t, 'range')} AS r FROM range({b})) o
  LEFT JOIN hi_{t} h ON h.hi >= o.r GROUP BY onlooker),
oq_{t} AS (SELECT pk.onlooker, pk.idx, a.mask AS x, b.mask AS y FROM pk_{t} pk JOIN e_{t} a ON a.idx = pk.idx JOIN e_{t} b
  ON b.idx = (pk.idx + 1 + CAST(floor({U('abc.onl.k', t, "'onl'", 'pk.onlooker')} * {b - 1}) AS INTEGER)) % {b})""")
        out.append(S._nb_ctes(f"oq_{t}", onl, f"o_{t}", N))
        out.append(f"""bw_{t} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY idx) AS hits, row_number() OVER (
    PARTITION BY idx ORDER BY cand_obj DESC, cand_k, onlooker) AS rk FROM {scored(f'Co_{t}', 'cand', obj='cand_obj', k='cand_k')}),
a_{t} AS (SELECT e.*, w.cand, w.cand_obj, w.cand_k, w.hits,
  w.cand IS NOT NULL AND {better('w.cand_obj', 'e.obj', 'w.cand_k', 'e.k')} AS acc FROM e_{t} e LEFT JOIN bw_{t} w ON w.idx = e.idx AND w.rk = 1),
l_{t} AS MATERIALIZED (SELECT member, idx, CASE WHEN acc THEN cand ELSE mask END AS mask, CASE WHEN acc THEN cand_obj ELSE obj END AS obj,
  CASE WHEN acc THEN cand_k ELSE k END AS k, CASE WHEN acc THEN 0 ELSE trials + coalesce(hits, 0) END AS trials FROM a_{t}),
fresh_{t} AS {S.masks_sql(f'l_{t}', ABC_PRM.scout_p, 'abc.scout', (str(t),), N)},
p_{t} AS MATERIALIZED (SELECT l.member, l.idx, CASE WHEN l.trials >= {ABC_PRM.limit} THEN f.mask ELSE l.mask END AS mask,
  CASE WHEN l.trials >= {ABC_PRM.limit} THEN f.obj ELSE l.obj END AS obj, CASE WHEN l.trials >= {ABC_PRM.limit} THEN f.k ELSE l.k END AS k,
  CASE WHEN l.trials >= {ABC_PRM.limit} THEN 0 ELSE l.trials END AS trials
  FROM l_{t} l JOIN {scored(f'fresh_{t}')} f ON f.member = l.member)""")
    return ",\n".join(out) + f""",
seen AS (SELECT {b} * 5 + (SELECT count(*) FROM l_1 WHERE trials >= {ABC_PRM.limit}) + (SELECT count(*) FROM l_2 WHERE trials >= {ABC_PRM.limit}) AS evaluations),
best AS (SELECT mask, obj FROM (SELECT 0 AS t, member, mask, obj FROM p_0 UNION ALL SELECT 1, member, mask, obj FROM p_1
  UNION ALL SELECT 2, member, mask, obj FROM p_2) ORDER BY obj DESC, t, member LIMIT 1)
SELECT p.member, p.mask, p.obj, p.k, p.trials, best.mask AS best_mask, best.obj AS best_obj, CAST(evaluations AS INTEGER) AS evaluations
FROM p_2 p, best, seen"""


def _with_best(df, res: dict):
    best = F.array(*[F.lit(int(x)) for x in res["best_mask"]])
    return df.withColumn("best_mask", best).withColumn("best_obj", F.lit(float(res["best_obj"]))) \
        .withColumn("evaluations", F.lit(int(res["evaluations"])))


@register("abc_two_gen", _abc_sql())
def q_abc_two_gen(spark, sf):
    """The bees after two generations, scouts included, with the best mask met."""
    data, folder = d_tree(spark, sf)[0], scratch_path(spark, "abc_two_gen")
    res = SEL.select_abc(data, ABC_PRM, evaluator="entropy", resume=folder)
    _, pop, _ = _state(spark, folder, "abc", data, ABC_PRM, "max_iters", max_depth=4, evaluator="entropy")
    return _with_best(pop.select("member", "mask", "obj", "k", "trials"), res)


# ------------------------------------------------------------------ ants

def _aco_sql() -> str:
    prm = ACO_PRM
    p0 = min(1.0, K_MAX / N)
    ants = [prm.num_ants, min(prm.num_ants, max(1, prm.max_evals - 1 - prm.num_ants))]
    out = [SCORES + f"""fcell AS (SELECT feature_idx, bin, label, count(*) AS n FROM (SELECT unnest(bins) AS bin, label,
  unnest(list_transform(range({N}), lambda i: CAST(i AS INTEGER))) AS feature_idx FROM rows WHERE is_train) GROUP BY ALL),
fgiven AS (SELECT feature_idx, label, n, -n * log2(n / sum(n) OVER (PARTITION BY feature_idx, bin)) AS bits FROM fcell),
fper AS (SELECT feature_idx, label, sum(n) AS n, sum(bits) AS bits FROM fgiven GROUP BY ALL),
fown AS (SELECT feature_idx, n, bits, -n * log2(n / sum(n) OVER (PARTITION BY feature_idx)) AS alone FROM fper),
ph_0 AS MATERIALIZED (SELECT feature_idx, CAST(1.0 AS DOUBLE) AS tau, round((sum(alone) - sum(bits)) / sum(n), 6) + 0.0 AS eta FROM fown GROUP BY 1),
{ORDER_CTE},
first AS (SELECT list(j) AS js FROM (SELECT range AS j FROM range({N}) ORDER BY {U('aco.start', 'range')}, range LIMIT {max(1, K_MIN)})),
a_0 AS MATERIALIZED (SELECT 0 AS t, * FROM {scored(f'(SELECT member, {repaired(K_MIN, K_MAX)} AS mask FROM '
    + sized(f"(SELECT 0 AS member, {bits('list_contains(js, i)')} AS mask FROM first)") + ', O)')})"""]
    for t in (1, 2):
        draw = (f"(SELECT CAST(r.range AS INTEGER) AS member, {bits(f'{U("aco.ant", t - 1, "r.range", "i")} < pr_{t}.p[i + 1]')} AS mask "
                f"FROM range({ants[t - 1]}) r, pr_{t})")
        every = " UNION ALL ".join(f"SELECT * FROM a_{i}" for i in range(t + 1))
        out.append(f"""sc_{t} AS (SELECT feature_idx, greatest(pow(tau, {prm.alpha}) * pow(eta, {prm.beta}), 1e-12) AS s FROM ph_{t - 1}),
pr_{t} AS MATERIALIZED (SELECT list(least(greatest(CAST({p0!r} AS DOUBLE) * (s / (SELECT max(s) FROM sc_{t})), 1e-6), 1 - 1e-6) ORDER BY feature_idx) AS p FROM sc_{t}),
a_{t} AS MATERIALIZED (SELECT {t} AS t, * FROM {scored(f'(SELECT member, {repaired(K_MIN, K_MAX)} AS mask FROM {sized(draw)}, O)')}),
b_{t} AS MATERIALIZED (SELECT mask AS bm, obj AS bo FROM ({every}) ORDER BY obj DESC, t, member LIMIT 1),
dep_{t} AS (SELECT CAST(i - 1 AS INTEGER) AS feature_idx, sum({prm.q} * obj * bit) AS dep
  FROM (SELECT obj, unnest(mask) AS bit, unnest(range(1, {N + 1})) AS i FROM a_{t} WHERE obj > 0) GROUP BY i),
ph_{t} AS MATERIALIZED (SELECT ph.feature_idx, least(greatest(ph.tau * {1 - prm.rho} + coalesce(d.dep, 0.0)
  + (CASE WHEN bo > 0 THEN 0.5 * {prm.q} * bo ELSE 0.0 END) * bm[ph.feature_idx + 1], 1e-6), 1e6) AS tau, ph.eta
  FROM ph_{t - 1} ph LEFT JOIN dep_{t} d USING (feature_idx), b_{t})""")
    return ",\n".join(out) + f"""
SELECT feature_idx, round(tau, 9) AS tau, eta, bm AS best_mask, bo AS best_obj, CAST({1 + sum(ants)} AS INTEGER) AS evaluations FROM ph_2, b_2"""


@register("aco_two_gen", _aco_sql())
def q_aco_two_gen(spark, sf):
    """Pheromone after two generations of ants that weigh the information gain; the second ends with the budget."""
    data, folder = d_tree(spark, sf)[0], scratch_path(spark, "aco_two_gen")
    res = SEL.select_aco(data, ACO_PRM, lam=LAM, ordv=ORDER, k_min=K_MIN, k_max=K_MAX, evaluator="entropy", resume=folder)
    _, pher, _ = _state(spark, folder, "aco", data, ACO_PRM, "iters", max_depth=6, lam=LAM, ordv=ORDER, k_min=K_MIN,
                        k_max=K_MAX, init_mask=None, evaluator="entropy")
    return _with_best(pher.select("feature_idx", F.round("tau", 9).alias("tau"), "eta"), res)


# ------------------------------------------------------------------ flowers

def _fpa_sql() -> str:
    prm, p = FPA_PRM, FPA_PRM.pop_size
    early = U("fpa.init", "member", "j") + " < " + U("fpa.init", "member", "i")
    tied = U("fpa.init", "member", "j") + " = " + U("fpa.init", "member", "i") + " AND j < i"
    start = (f"(SELECT member, {bits(f'len(list_filter(range({N}), lambda j: {early} OR ({tied}))) < {prm.init_k}')} AS mask "
             f"FROM (SELECT CAST(range AS INTEGER) AS member FROM range({p})))")
    out = [SCORES + f"""{ORDER_CTE},
p_0 AS MATERIALIZED (SELECT * FROM {scored(f'(SELECT member, {repaired(K_MIN, K_MAX)} AS mask FROM {sized(start)}, O)')})"""]
    left = prm.max_evals - p
    for t in (1, 2):
        keys = (t - 1, "slot")
        step = (f"(({g.gauss('duckdb', SEED, 'fpa.levy.u', str(t - 1), 'slot')} / (pow(abs({g.gauss('duckdb', SEED, 'fpa.levy.v', str(t - 1), 'slot')}), "
                f"{1.0 / prm.levy_beta!r}) + 1e-12)) * {prm.step_scale})")
        z = "(CAST(gb[i + 1] - x[i + 1] AS DOUBLE) * step)"
        sig = f"(CASE WHEN {z} >= 35 THEN 1.0 WHEN {z} <= -35 THEN 0.0 ELSE 1.0 / (1.0 + exp(-{z})) END)"
        moved = (f"CASE WHEN copied THEN x WHEN is_glob THEN {bits(f'CASE WHEN {U("fpa.flip", *keys, "i")} < abs({sig} - 0.5) * 2.0 THEN 1 - x[i + 1] ELSE x[i + 1] END')} "
                 f"ELSE {bits(f'CASE WHEN {U("fpa.loc", *keys, "i")} < 0.5 THEN ma[i + 1] ELSE mb[i + 1] END')} END")
        every = " UNION ALL ".join(f"SELECT {i} AS t, member, mask, obj, k FROM p_{i}" for i in range(t))
        out.append(f"""g_{t} AS MATERIALIZED (SELECT mask AS gb FROM ({every}) ORDER BY obj DESC, t, member LIMIT 1),
s_{t} AS (SELECT slot, slot - {prm.elitism} >= {left} AS copied, {U('fpa.glob', *keys)} < {prm.p_global} AS is_glob,
  CASE WHEN slot - {prm.elitism} >= {left} THEN slot % {p} ELSE CAST(floor({U('fpa.parent', *keys)} * {p}) AS INTEGER) END AS parent,
  CAST(floor({U('fpa.a', *keys)} * {p}) AS INTEGER) AS a, CAST(floor({U('fpa.b', *keys)} * {p - 1}) AS INTEGER) AS off
  FROM (SELECT CAST(range AS INTEGER) AS slot FROM range({prm.elitism}, {p}))),
j_{t} AS MATERIALIZED (SELECT s.*, x.mask AS x, x.obj AS parent_obj, x.k AS parent_k, m.mask AS ma, n.mask AS mb, gb, {step} AS step
  FROM s_{t} s JOIN p_{t - 1} x ON x.member = s.parent JOIN p_{t - 1} m ON m.member = s.a JOIN p_{t - 1} n ON n.member = (s.a + 1 + s.off) % {p}, g_{t}),
c_{t} AS MATERIALIZED (SELECT * FROM {scored(f"(SELECT slot, copied, x, parent_obj, parent_k, CASE WHEN copied THEN mask ELSE {repaired(K_MIN, K_MAX)} END AS mask FROM "
    + sized(f"(SELECT *, {moved} AS mask FROM j_{t})") + ", O)")}),
p_{t} AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY obj DESC, member) - 1 AS INTEGER) AS member, mask, obj, k
    FROM (SELECT * FROM p_{t - 1} ORDER BY obj DESC, member LIMIT {prm.elitism})
  UNION ALL SELECT slot, CASE WHEN won THEN mask ELSE x END, CASE WHEN won THEN obj ELSE parent_obj END, CASE WHEN won THEN k ELSE parent_k END
    FROM (SELECT *, NOT copied AND obj > parent_obj AS won FROM c_{t}))""")
        left -= min(max(left, 0), p - prm.elitism)
    return ",\n".join(out) + f""",
best AS (SELECT mask, obj FROM ({" UNION ALL ".join(f"SELECT {i} AS t, * FROM p_{i}" for i in range(3))}) ORDER BY obj DESC, t, member LIMIT 1)
SELECT p.*, best.mask AS best_mask, best.obj AS best_obj, CAST({prm.max_evals - left} AS INTEGER) AS evaluations FROM p_2 p, best"""


@register("fpa_two_gen_budget", _fpa_sql())
def q_fpa_two_gen_budget(spark, sf):
    """The flowers after two generations; the budget ends within the second, whose other slots copy members."""
    data, folder = d_tree(spark, sf)[0], scratch_path(spark, "fpa_two_gen")
    res = SEL.select_fpa(data, FPA_PRM, lam=LAM, ordv=ORDER, k_min=K_MIN, k_max=K_MAX, evaluator="entropy", resume=folder)
    _, pop, _ = _state(spark, folder, "fpa", data, FPA_PRM, "iters", max_depth=12, lam=LAM, ordv=ORDER, k_min=K_MIN,
                       k_max=K_MAX, init_mask=None, evaluator="entropy")
    return _with_best(pop.select("member", "mask", "obj", "k"), res)


# ------------------------------------------------------------------ particles

def _pso_sql(greedy: bool) -> str:
    prm = PSO_PRM
    cap = S.cap_sql(PSO_CAP, N)
    start = f"(SELECT * FROM (SELECT CAST(range AS INTEGER) AS member FROM range({prm.swarm_size})), (SELECT CAST(range AS INTEGER) AS restart FROM range({prm.restarts})))"
    bit = f"CASE WHEN {U('pso.init', 'restart', 'member', 'i')} < 0.3 THEN 1 ELSE 0 END"
    fix = f"CAST(floor({U('pso.init.fix', 'restart', 'member')} * {N}) AS INTEGER)"
    first = (f"(SELECT restart, member, vel, CASE WHEN list_sum(raw) = 0 THEN {bits(f'CASE WHEN i = {fix} THEN 1 ELSE raw[i + 1] END')} ELSE raw END AS mask "
             f"FROM (SELECT *, {bits(bit)} AS raw, list_transform(range({N}), lambda i: {U('pso.vel', 'restart', 'member', 'i')} * 2.0 - 1.0) AS vel FROM {start}))")
    out = [SCORES + f"""{ORDER_CTE},
w_0 AS MATERIALIZED (SELECT *, mask AS pbest, obj AS pbest_obj, k AS pbest_k FROM
  {scored(f'(SELECT restart, member, vel, {cap} AS mask FROM {sized(first)}, O)', objective=hardcap())})"""]
    move = "acc" if greedy else "TRUE"
    pb = "(acc AND pb)" if greedy else "pb"
    for t in (1, 2):
        keys = ("restart", t, "member", "i")
        vel = (f"list_transform(range({N}), lambda i: least(greatest({prm.w} * vel[i + 1] + {prm.c1} * {U('pso.r1', *keys)} * (pbest[i + 1] - mask[i + 1]) "
               f"+ {prm.c2} * {U('pso.r2', *keys)} * (gb[i + 1] - mask[i + 1]), -{prm.vmax}), {prm.vmax}))")
        v = "vel[i + 1]"
        sig = f"(CASE WHEN {v} >= 0 THEN 1.0 / (1.0 + exp(-{v})) ELSE exp({v}) / (1.0 + exp({v})) END)"
        fix = f"CAST(floor({U('pso.bit.fix', 'restart', t, 'member')} * {N}) AS INTEGER)"
        filled = f"CASE WHEN list_sum(raw) = 0 THEN {bits(f'CASE WHEN i = {fix} THEN 1 ELSE raw[i + 1] END')} ELSE raw END"
        out.append(f"""gb_{t} AS MATERIALIZED (SELECT restart, pbest AS gb FROM (SELECT *, row_number() OVER (PARTITION BY restart
  ORDER BY pbest_obj DESC, pbest_k, member) AS rk FROM w_{t - 1}) WHERE rk = 1),
v_{t} AS MATERIALIZED (SELECT w.* EXCLUDE (vel), {vel} AS vel FROM w_{t - 1} w JOIN gb_{t} USING (restart)),
r_{t} AS MATERIALIZED (SELECT *, {bits(f'CASE WHEN {U("pso.bit", *keys)} < {sig} THEN 1 ELSE 0 END')} AS raw FROM v_{t}),
d_{t} AS MATERIALIZED (SELECT restart, member, {cap} AS cand FROM {sized(f'(SELECT restart, member, {filled} AS mask FROM r_{t})')}, O),
x_{t} AS MATERIALIZED (SELECT v.*, c.cand, c.cand_obj, c.cand_k, {better('cand_obj', 'obj', 'cand_k', 'k')} AS acc,
  {better('cand_obj', 'pbest_obj', 'cand_k', 'pbest_k')} AS pb
  FROM v_{t} v JOIN {scored(f'd_{t}', 'cand', hardcap(), 'cand_obj', 'cand_k')} c USING (restart, member)),
w_{t} AS MATERIALIZED (SELECT restart, member, vel, CASE WHEN {move} THEN cand ELSE mask END AS mask, CASE WHEN {move} THEN cand_obj ELSE obj END AS obj,
  CASE WHEN {move} THEN cand_k ELSE k END AS k, CASE WHEN {pb} THEN cand ELSE pbest END AS pbest,
  CASE WHEN {pb} THEN cand_obj ELSE pbest_obj END AS pbest_obj, CASE WHEN {pb} THEN cand_k ELSE pbest_k END AS pbest_k FROM x_{t})""")
    return ",\n".join(out) + f""",
best AS (SELECT pbest, pbest_obj FROM (SELECT *, row_number() OVER (PARTITION BY restart ORDER BY pbest_obj DESC, pbest_k, member) AS rk FROM w_2)
  WHERE rk = 1 ORDER BY pbest_obj DESC, restart LIMIT 1)
SELECT w.restart, w.member, list_transform(w.vel, lambda x: round(x, 9)) AS vel, w.mask, w.obj, w.k, w.pbest, w.pbest_obj, w.pbest_k, best.pbest AS best_mask, best.pbest_obj AS best_obj,
  CAST({prm.swarm_size * prm.restarts * 3} AS INTEGER) AS evaluations FROM w_2 w, best"""


def _pso_two_gen(spark, sf, greedy: bool):
    prm = PSO.PSOParams(**{**SEL.asdict(PSO_PRM), "greedy": greedy})
    data, folder = d_tree(spark, sf)[0], scratch_path(spark, "pso_two_gen")
    res = SEL.select_pso(data, prm, lam=PSO_LAM, rank_ordv=ORDER, k_cap=PSO_CAP, big_penalty=PSO_BIG, evaluator="entropy", resume=folder)
    _, sw, _ = _state(spark, folder, "pso", data, prm, "iters", max_depth=2, lam=PSO_LAM, rank_ordv=ORDER, k_cap=PSO_CAP,
                      big_penalty=PSO_BIG, legacy_objective=False, evaluator="entropy")
    vel = F.transform("vel", lambda x: F.round(x, 9)).alias("vel")
    return _with_best(sw.select("restart", "member", vel, "mask", "obj", "k", "pbest", "pbest_obj", "pbest_k"), res)


@register("pso_two_gen", _pso_sql(False))
def q_pso_two_gen(spark, sf):
    """Two restarts of particles that always move; their bests stay behind."""
    return _pso_two_gen(spark, sf, greedy=False)


@register("pso_two_gen_greedy", _pso_sql(True))
def q_pso_two_gen_greedy(spark, sf):
    """The same particles under the move-only-if-better rule."""
    return _pso_two_gen(spark, sf, greedy=True)
