"""DuckDB oracles for search-step keys over the population fixture."""

from __future__ import annotations

from ..sources import fixtures as X
from ..sources import sqlgen as g
from .queries_search import E_PRIORITY
from .registry import _SQL

N = 64
SEED = 13
GEN = 1
P_CTE = f"WITH P0 AS ({X.population_sql()}), P AS (SELECT *, CAST(list_sum(mask) AS INTEGER) AS k FROM P0)"


def U(tag, *keys):
    return g.u("duckdb", SEED, tag, *keys)


def masks_sql(source: str, p: float, tag: str, gen_keys: tuple, n: int = N) -> str:
    """Bernoulli(p) bits per member with the at-least-one-bit fix."""
    bit = f"CASE WHEN {U(tag, *gen_keys, 'member', 'j')} < {p} THEN 1 ELSE 0 END"
    fix = f"CAST(floor({U(tag + '.fix', *gen_keys, 'member')} * {n}) AS INTEGER)"
    return (f"(SELECT member, CASE WHEN list_sum(raw) = 0 THEN list_transform(range({n}), "
            f"lambda i: CASE WHEN i = {fix} THEN 1 ELSE raw[i + 1] END) ELSE raw END AS mask "
            f"FROM (SELECT member, list_transform(range({n}), lambda j: {bit}) AS raw FROM {source}))")


def add(key, sql):
    _SQL[key] = sql


FE = ("fe AS (SELECT DISTINCT CAST(i - 1 AS INTEGER) AS feature_idx, printf('f%02d', i - 1) AS name "
      "FROM (SELECT unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), "
      "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(E_PRIORITY))
      + ") AS t(name, prio))")

add("random_masks",
    "SELECT * FROM " + masks_sql("(SELECT CAST(vec_id AS INTEGER) AS member FROM embeddings)", 0.3, "init", ("'0'",)))
add("selected_features",
    P_CTE + " SELECT member, CAST(i - 1 AS INTEGER) AS feature_idx, printf('f%02d', i - 1) AS name "
    "FROM (SELECT member, unnest(mask) AS bit, unnest(range(1, 65)) AS i FROM P) WHERE bit = 1")
add("penalised_objective",
    P_CTE + f" SELECT member, k, CASE WHEN k = 0 THEN -1.0 ELSE obj - 0.01 * k / {float(N)} END AS objective FROM P")
add("hardcap_objective",
    P_CTE + " SELECT member, k, obj - 0.03 * k - 0.1 * greatest(k - 9, 0) AS objective FROM P")
add("priority_order",
    "WITH " + FE + " SELECT fe.feature_idx, fe.name, pr.prio, CAST(row_number() OVER "
    "(ORDER BY pr.prio IS NULL, coalesce(pr.prio, 10000), fe.feature_idx) - 1 AS INTEGER) AS ord "
    "FROM fe LEFT JOIN pr USING (name)")
add("warm_mask",
    "WITH " + FE + " SELECT list(CAST(pr.prio IS NOT NULL AS INTEGER) ORDER BY fe.feature_idx) AS mask "
    "FROM fe LEFT JOIN pr USING (name)")
add("best_member", P_CTE + " SELECT member, mask, obj, k FROM P ORDER BY obj DESC, member ASC LIMIT 1")
add("greedy_accept",
    P_CTE + f" SELECT member, (round({U('p.new', 'member')}, 6) > obj) OR "
    f"(abs(round({U('p.new', 'member')}, 6) - obj) < 1e-12 AND ({N} - k) < k) AS accept FROM P")
add("fpa_elites", P_CTE + " SELECT member, mask, obj, k FROM P ORDER BY obj DESC, member ASC LIMIT 3")
add("fpa_levy",
    P_CTE + f" SELECT member, ({g.gauss('duckdb', SEED, 'fpa.levy.u', f'{GEN}', 'member')} / "
    f"(pow(abs({g.gauss('duckdb', SEED, 'fpa.levy.v', f'{GEN}', 'member')}), {1.0 / 1.5!r}) + 1e-12)) * 0.25 "
    "AS step FROM P")
_PHER = (P_CTE + ", ph AS (SELECT CAST(i - 1 AS INTEGER) AS feature_idx, 1.0 + sum(obj * bit) AS tau, 1.0 AS eta "
         "FROM (SELECT obj, unnest(mask) AS bit, unnest(range(1, 65)) AS i FROM P) GROUP BY i), "
         "sc AS (SELECT feature_idx, greatest(pow(tau, 1.0) * pow(eta, 0.0), 1e-12) AS score FROM ph)")
add("aco_probabilities",
    _PHER + " SELECT feature_idx, least(greatest(score / (SELECT max(score) FROM sc), 1e-6), 1 - 1e-6) AS p FROM sc")
add("abc_scouts",
    P_CTE + ", F AS " + masks_sql("P", 0.2, "abc.scout", (f"'{GEN}'",))
    + " SELECT P.member, CASE WHEN P.trials >= 5 THEN F.mask ELSE P.mask END AS mask, "
    "CASE WHEN P.trials >= 5 THEN 0 ELSE P.trials END AS trials, P.trials >= 5 AS scout "
    "FROM P JOIN F USING (member)")
add("pso_start",
    P_CTE + ", M AS " + masks_sql("P", 0.3, "pso.init", ("'0'",))
    + f" SELECT 0 AS restart, member, mask, list_transform(range({N}), "
    f"lambda j: {U('pso.vel', chr(39) + '0' + chr(39), 'member', 'j')} * 2.0 - 1.0) AS vel FROM M")

# ---------------------------------------------------------------- second batch
G = f"'{GEN}'"
PD = P_CTE + ", PD AS (SELECT *, CAST(row_number() OVER (ORDER BY member) - 1 AS INTEGER) AS idx, " \
    "count(*) OVER () AS np FROM P)"
BEST = "(SELECT mask FROM P ORDER BY obj DESC, member ASC LIMIT 1)"

add("fpa_local",
    PD + ", J AS (SELECT a.member, a.mask AS ma, b.mask AS mb FROM PD a JOIN PD b ON (b.idx + 1) % b.np = a.idx) "
    f"SELECT member, list_transform(range({N}), lambda i: CASE WHEN {U('fpa.loc', G, 'member', 'i')} < 0.5 "
    "THEN ma[i + 1] ELSE mb[i + 1] END) AS cand FROM J")

_STEP = (f"(({g.gauss('duckdb', SEED, 'fpa.levy.u', G, 'member')} / "
         f"(pow(abs({g.gauss('duckdb', SEED, 'fpa.levy.v', G, 'member')}), {1.0 / 1.5!r}) + 1e-12)) * 0.25)")
_Z = "(CAST(gb[i + 1] - mask[i + 1] AS DOUBLE) * step)"
_SIG = f"(CASE WHEN {_Z} >= 35 THEN 1.0 WHEN {_Z} <= -35 THEN 0.0 ELSE 1.0 / (1.0 + exp(-{_Z})) END)"
add("fpa_global",
    P_CTE + f", S AS (SELECT member, mask, {_STEP} AS step, {BEST} AS gb FROM P) "
    f"SELECT member, list_transform(range({N}), lambda i: CASE WHEN {U('fpa.flip', G, 'member', 'i')} "
    f"< abs({_SIG} - 0.5) * 2.0 THEN 1 - mask[i + 1] ELSE mask[i + 1] END) AS cand FROM S")

add("aco_ants",
    _PHER + ", pr AS (SELECT list(least(greatest(score / (SELECT max(score) FROM sc), 1e-6), 1 - 1e-6) "
    "ORDER BY feature_idx) AS p FROM sc) "
    f"SELECT CAST(a.range AS INTEGER) AS member, list_transform(range({N}), lambda j: CASE WHEN "
    f"{U('aco.ant', G, 'a.range', 'j')} < pr.p[j + 1] THEN 1 ELSE 0 END) AS mask FROM range(10) a, pr")

add("aco_update",
    _PHER + ", b AS (SELECT mask AS bm, obj AS bo FROM P ORDER BY obj DESC, member ASC LIMIT 1), "
    "dep AS (SELECT CAST(i - 1 AS INTEGER) AS feature_idx, sum(1.0 * obj * bit) AS dep "
    "FROM (SELECT obj, unnest(mask) AS bit, unnest(range(1, 65)) AS i FROM P WHERE obj > 0) GROUP BY i) "
    "SELECT ph.feature_idx, least(greatest(ph.tau * 0.75 + coalesce(dep.dep, 0.0) + "
    "(CASE WHEN b.bo > 0 THEN 0.5 * 1.0 * b.bo ELSE 0.0 END) * b.bm[ph.feature_idx + 1], 1e-6), 1e6) AS tau, ph.eta "
    "FROM ph LEFT JOIN dep USING (feature_idx), b")

_K = (G, "'emp'", "idx")
_J = f"CAST(floor({U('abc.nb.j', *_K)} * {N}) AS INTEGER)"
_K2 = f"CAST(floor({U('abc.nb.k', *_K)} * {N}) AS INTEGER)"
_FIX = f"CAST(floor({U('abc.nb.fix', *_K)} * {N}) AS INTEGER)"
add("abc_neighbors",
    PD + ", Q AS (SELECT a.member, a.idx, a.mask AS x, b.mask AS y FROM PD a JOIN PD b ON b.idx = "
    f"CAST((a.idx + 1 + CAST(floor({U('abc.emp.k', G, chr(39) + 'emp' + chr(39), 'a.idx')} * (a.np - 1)) AS INTEGER)) "
    "% a.np AS INTEGER)), "
    f"V1 AS (SELECT member, idx, list_transform(range({N}), lambda i: CASE WHEN i = {_J} THEN "
    f"(CASE WHEN {U('abc.nb.c', *_K)} < 0.5 THEN y[i + 1] ELSE 1 - x[i + 1] END) ELSE x[i + 1] END) AS v FROM Q), "
    f"V2 AS (SELECT member, idx, CASE WHEN {U('abc.nb.p', *_K)} < 0.1 THEN list_transform(range({N}), "
    f"lambda i: CASE WHEN i = {_K2} THEN 1 - v[i + 1] ELSE v[i + 1] END) ELSE v END AS v FROM V1) "
    f"SELECT member, CASE WHEN list_sum(v) = 0 THEN list_transform(range({N}), lambda i: CASE WHEN i = {_FIX} "
    "THEN 1 ELSE v[i + 1] END) ELSE v END AS cand FROM V2")

# ---------------------------------------------------------------- third batch
PO = (FE + ", po AS (SELECT fe.feature_idx, CAST(row_number() OVER (ORDER BY pr.prio IS NULL, "
      "coalesce(pr.prio, 10000), fe.feature_idx) - 1 AS INTEGER) AS ord FROM fe LEFT JOIN pr USING (name)), "
      "O AS (SELECT list(ord ORDER BY feature_idx) AS o FROM po)")


def _rank(bit, n=N):
    return (f"len(list_filter(range({n}), lambda j: mask[j + 1] = {bit} AND o[j + 1] < o[i + 1]))")


def repair_sql(kmin, kmax, n=N):
    tmin = max(1, kmin)
    return (f"CASE WHEN k > {kmax} THEN list_transform(range({n}), lambda i: CAST(mask[i + 1] = 1 AND "
            f"{_rank(1, n)} < {kmax} AS INTEGER)) WHEN k < {tmin} THEN list_transform(range({n}), lambda i: "
            f"CAST(mask[i + 1] = 1 OR {_rank(0, n)} < ({tmin} - k) AS INTEGER)) ELSE mask END")


def cap_sql(cap, n=N):
    return (f"CASE WHEN k = 0 THEN list_transform(range({n}), lambda i: CAST({_rank(0, n)} < {cap} AS INTEGER)) "
            f"WHEN k > {cap} THEN list_transform(range({n}), lambda i: CAST(mask[i + 1] = 1 AND {_rank(1, n)} < {cap} "
            "AS INTEGER)) ELSE mask END")


add("repair_by_priority",
    P_CTE + ", " + PO + f" SELECT member, {repair_sql(5, 9)} AS mask FROM P, O")
add("repair_by_importance",
    P_CTE + ", imp AS (SELECT CAST(i - 1 AS INTEGER) AS feature_idx, avg(abs(v)) AS importance FROM "
    "(SELECT unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i), "
    "rk AS (SELECT feature_idx, CAST(row_number() OVER (ORDER BY importance DESC, feature_idx) - 1 AS INTEGER) AS ord "
    "FROM imp), O AS (SELECT list(ord ORDER BY feature_idx) AS o FROM rk) "
    f"SELECT member, {cap_sql(9)} AS mask FROM P, O")

add("abc_roulette",
    PD + ", st AS (SELECT min(obj) AS mn FROM PD), sh AS (SELECT idx, obj - st.mn + 1e-9 AS s FROM PD, st), "
    "tot AS (SELECT sum(s) AS t, count(*) AS n FROM sh), "
    "pb AS (SELECT idx, CASE WHEN tot.t = 0 THEN 1.0 / tot.n ELSE s / tot.t END AS prob FROM sh, tot), "
    "cum AS (SELECT idx, prob, sum(prob) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi "
    "FROM pb), cl AS (SELECT idx, coalesce(lag(hi) OVER (ORDER BY idx), 0.0) AS lo, hi FROM cum), "
    f"ons AS (SELECT CAST(range AS INTEGER) AS onlooker, {U('abc.onl.r', G, 'range')} AS r FROM range((SELECT n FROM tot))) "
    "SELECT onlooker, coalesce(min(cl.idx), 0) AS idx FROM ons LEFT JOIN cl ON ons.r > cl.lo AND ons.r <= cl.hi "
    "GROUP BY onlooker")

_SW = (P_CTE + ", M AS " + masks_sql("P", 0.3, "pso.init", ("'0'",))
       + f", SW AS (SELECT 0 AS restart, M.member, M.mask, P.mask AS pbest, P.obj AS pbest_obj, P.k AS pbest_k, "
       f"round({U('pso.pos', 'M.member')}, 6) AS obj, CAST(list_sum(M.mask) AS INTEGER) AS k, list_transform(range({N}), "
       f"lambda j: {U('pso.vel', chr(39) + '0' + chr(39), 'M.member', 'j')} * 2.0 - 1.0) AS vel "
       "FROM M JOIN P USING (member)), "
       "GB AS (SELECT pbest AS gb FROM SW ORDER BY pbest_obj DESC, pbest_k ASC, member ASC LIMIT 1), "
       f"VEL AS (SELECT SW.member, list_transform(range({N}), lambda d: least(greatest(0.7 * vel[d + 1] "
       f"+ 1.4 * {U('pso.r1', 'restart', G, 'member', 'd')} * (pbest[d + 1] - mask[d + 1]) "
       f"+ 1.4 * {U('pso.r2', 'restart', G, 'member', 'd')} * (gb[d + 1] - mask[d + 1]), -4.0), 4.0)) AS vel, "
       "restart FROM SW, GB)")
add("pso_velocity", _SW + " SELECT member, vel FROM VEL")
_V = "vel[d + 1]"
_SIGV = f"(CASE WHEN {_V} >= 0 THEN 1.0 / (1.0 + exp(-{_V})) ELSE exp({_V}) / (1.0 + exp({_V})) END)"
add("pso_binarize",
    _SW + f", RAW AS (SELECT member, restart, list_transform(range({N}), lambda d: CASE WHEN "
    f"{U('pso.bit', 'restart', G, 'member', 'd')} < {_SIGV} THEN 1 ELSE 0 END) AS raw "
    "FROM VEL) "
    f"SELECT member, CASE WHEN list_sum(raw) = 0 THEN list_transform(range({N}), lambda i: CASE WHEN i = "
    f"CAST(floor({U('pso.bit.fix', 'restart', G, 'member')} * {N}) AS INTEGER) THEN 1 ELSE raw[i + 1] END) "
    "ELSE raw END AS cand FROM RAW")

# ---------------------------------------------------------------- fourth batch
_NB_SELECT = _SQL["abc_neighbors"]
add("abc_employed",
    _NB_SELECT.replace(" SELECT member, CASE WHEN list_sum(v) = 0", ", NB AS (SELECT member, CASE WHEN list_sum(v) = 0", 1)
    .replace("ELSE v END AS cand FROM V2", "ELSE v END AS cand FROM V2)", 1)
    + f", SC AS (SELECT NB.member, NB.cand, round({U('abc.emp.obj', G, 'NB.member')}, 6) AS cand_obj, "
    "CAST(list_sum(NB.cand) AS INTEGER) AS cand_k FROM NB), "
    "AC AS (SELECT PD.member, PD.idx, PD.mask, PD.obj, PD.k, PD.trials, SC.cand, SC.cand_obj, SC.cand_k, "
    "(SC.cand_obj > PD.obj) OR (abs(SC.cand_obj - PD.obj) < 1e-12 AND SC.cand_k < PD.k) AS acc "
    "FROM PD JOIN SC USING (member)) "
    "SELECT member, idx, CASE WHEN acc THEN cand ELSE mask END AS mask, CASE WHEN acc THEN cand_obj ELSE obj END AS obj, "
    "CASE WHEN acc THEN cand_k ELSE k END AS k, CASE WHEN acc THEN 0 ELSE trials + 1 END AS trials FROM AC")

_US = lambda tag, *k: U(tag, *k)
add("aco_start",
    "WITH J AS (SELECT CAST(range AS INTEGER) AS j, " + _US("aco.start", "range") + " AS u FROM range(64)), "
    "S AS (SELECT list(j) AS js FROM (SELECT j FROM J ORDER BY u, j LIMIT 5)), "
    f"P AS (SELECT 0 AS member, list_transform(range({N}), lambda i: CAST(list_contains(js, i) AS INTEGER)) AS mask FROM S), "
    "P2 AS (SELECT *, CAST(list_sum(mask) AS INTEGER) AS k FROM P), " + PO
    + f" SELECT member, {repair_sql(5, 10)} AS mask FROM P2, O")

_UI = _US("fpa.init", "member", "i")
_UJ = _US("fpa.init", "member", "j")
add("fpa_start",
    P_CTE + f", M AS (SELECT member, list_transform(range({N}), lambda i: CAST(len(list_filter(range({N}), "
    f"lambda j: {_UJ} < {_UI} OR ({_UJ} = {_UI} AND j < i))) < 9 AS INTEGER)) AS mask FROM P), "
    "M2 AS (SELECT *, CAST(list_sum(mask) AS INTEGER) AS k FROM M), " + PO
    + f" SELECT member, {repair_sql(5, 9)} AS mask FROM M2, O")

_PSO_AC = (
    _SQL["pso_binarize"].replace(" SELECT member, CASE WHEN list_sum(raw) = 0", ", CD AS (SELECT member, CASE WHEN list_sum(raw) = 0", 1)
    + ")"
    + f", SC AS (SELECT CD.member, CD.cand, round({U('pso.obj', G, 'CD.member')}, 6) AS cand_obj, "
    "CAST(list_sum(CD.cand) AS INTEGER) AS cand_k FROM CD), "
    "AC AS (SELECT SW.*, SC.cand, SC.cand_obj, SC.cand_k, "
    "(cand_obj > obj) OR (abs(cand_obj - obj) < 1e-12 AND cand_k < k) AS better, "
    "(cand_obj > pbest_obj) OR (abs(cand_obj - pbest_obj) < 1e-12 AND cand_k < pbest_k) AS pb FROM SW JOIN SC USING (member)) ")


def _pso_new(move: str, best: str) -> str:
    pick = ", ".join(f"CASE WHEN {when} THEN {new} ELSE {old} END AS {old}" for when, new, old in (
        (move, "cand", "mask"), (move, "cand_obj", "obj"), (move, "cand_k", "k"),
        (best, "cand", "pbest"), (best, "cand_obj", "pbest_obj"), (best, "cand_k", "pbest_k")))
    return _PSO_AC + f"SELECT member, {pick} FROM AC"


add("pso_best_update", _pso_new("TRUE", "pb"))
add("pso_greedy_update", _pso_new("better", "better AND pb"))

# ---------------------------------------------------------------- onlooker phase


def _nb_ctes(src: str, keys: tuple, sfx: str, n: int = N) -> str:
    """ABC neighbour move over ``src`` (columns x, y + keys) as CTEs."""
    j = f"CAST(floor({U('abc.nb.j', *keys)} * {n}) AS INTEGER)"
    k2 = f"CAST(floor({U('abc.nb.k', *keys)} * {n}) AS INTEGER)"
    fix = f"CAST(floor({U('abc.nb.fix', *keys)} * {n}) AS INTEGER)"
    return (f"A{sfx} AS (SELECT *, list_transform(range({n}), lambda i: CASE WHEN i = {j} THEN "
            f"(CASE WHEN {U('abc.nb.c', *keys)} < 0.5 THEN y[i + 1] ELSE 1 - x[i + 1] END) ELSE x[i + 1] END) AS v1 "
            f"FROM {src}), "
            f"B{sfx} AS (SELECT *, CASE WHEN {U('abc.nb.p', *keys)} < 0.1 THEN list_transform(range({n}), "
            f"lambda i: CASE WHEN i = {k2} THEN 1 - v1[i + 1] ELSE v1[i + 1] END) ELSE v1 END AS v2 FROM A{sfx}), "
            f"C{sfx} AS (SELECT *, CASE WHEN list_sum(v2) = 0 THEN list_transform(range({n}), lambda i: CASE WHEN "
            f"i = {fix} THEN 1 ELSE v2[i + 1] END) ELSE v2 END AS cand FROM B{sfx})")


_ROUL = _SQL["abc_roulette"].replace(" SELECT onlooker, coalesce(min(cl.idx), 0) AS idx",
                                     ", PK AS (SELECT onlooker, coalesce(min(cl.idx), 0) AS idx", 1) + ")"
_OK = (G, "'onl'", "onlooker")
add("abc_onlooker",
    _ROUL + ", OC AS (SELECT PK.onlooker, PK.idx, a.mask AS x, b.mask AS y FROM PK JOIN PD a ON a.idx = PK.idx "
    f"JOIN PD b ON b.idx = CAST((PK.idx + 1 + CAST(floor({U('abc.onl.k', G, chr(39) + 'onl' + chr(39), 'PK.onlooker')} "
    "* (a.np - 1)) AS INTEGER)) % a.np AS INTEGER)), "
    + _nb_ctes("OC", _OK, "o")
    + f", SC AS (SELECT onlooker, idx, cand, round({U('abc.onl.obj', G, 'onlooker')}, 6) AS cand_obj, "
    "CAST(list_sum(cand) AS INTEGER) AS cand_k FROM Co), "
    "BW AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY cand_obj DESC, cand_k ASC, onlooker ASC) AS rk, "
    "count(*) OVER (PARTITION BY idx) AS hits FROM SC) WHERE rk = 1), "
    "AC AS (SELECT PD.*, BW.cand, BW.cand_obj, BW.cand_k, BW.hits, BW.cand IS NOT NULL AND ((BW.cand_obj > PD.obj) OR "
    "(abs(BW.cand_obj - PD.obj) < 1e-12 AND BW.cand_k < PD.k)) AS acc FROM PD LEFT JOIN BW USING (idx)) "
    "SELECT member, idx, CASE WHEN acc THEN cand ELSE mask END AS mask, CASE WHEN acc THEN cand_obj ELSE obj END AS obj, "
    "CASE WHEN acc THEN cand_k ELSE k END AS k, CASE WHEN acc THEN 0 ELSE trials + coalesce(hits, 0) END AS trials FROM AC")

# ---------------------------------------------------------------- FPA generation
_SK = (G, "slot")
_STEP_S = (f"(({g.gauss('duckdb', SEED, 'fpa.levy.u', *_SK)} / "
           f"(pow(abs({g.gauss('duckdb', SEED, 'fpa.levy.v', *_SK)}), {1.0 / 1.5!r}) + 1e-12)) * 0.25)")
_ZS = "(CAST(gb[i + 1] - x[i + 1] AS DOUBLE) * step)"
_SIGS = f"(CASE WHEN {_ZS} >= 35 THEN 1.0 WHEN {_ZS} <= -35 THEN 0.0 ELSE 1.0 / (1.0 + exp(-{_ZS})) END)"
add("fpa_generation",
    PD + ", GB AS (SELECT mask AS gb FROM P ORDER BY obj DESC, member ASC LIMIT 1), "
    "NP AS (SELECT count(*) AS np FROM P), "
    f"S2 AS (SELECT CAST(range AS INTEGER) AS slot, CAST(floor({U('fpa.parent', G, 'range')} * np) AS INTEGER) AS parent, "
    f"{U('fpa.glob', G, 'range')} < 0.8 AS is_glob, CAST(floor({U('fpa.a', G, 'range')} * np) AS INTEGER) AS a, np "
    "FROM range(1, (SELECT np FROM NP)), NP), "
    f"S3 AS (SELECT *, CAST((a + 1 + CAST(floor({U('fpa.b', *_SK)} * (np - 1)) AS INTEGER)) % np AS INTEGER) AS b FROM S2), "
    "J AS (SELECT S3.slot, S3.is_glob, pp.mask AS x, pp.obj AS parent_obj, pp.k AS parent_k, pa.mask AS ma, pb.mask AS mb, "
    f"{_STEP_S} AS step, GB.gb FROM S3 JOIN PD pp ON pp.idx = S3.parent JOIN PD pa ON pa.idx = S3.a "
    "JOIN PD pb ON pb.idx = S3.b, GB), "
    f"CD AS (SELECT slot, x, parent_obj, parent_k, CASE WHEN is_glob THEN list_transform(range({N}), lambda i: CASE WHEN "
    f"{U('fpa.flip', G, 'slot', 'i')} < abs({_SIGS} - 0.5) * 2.0 THEN 1 - x[i + 1] ELSE x[i + 1] END) "
    f"ELSE list_transform(range({N}), lambda i: CASE WHEN {U('fpa.loc', G, 'slot', 'i')} < 0.5 THEN ma[i + 1] "
    "ELSE mb[i + 1] END) END AS mask FROM J), "
    "CD2 AS (SELECT *, CAST(list_sum(mask) AS INTEGER) AS k FROM CD), " + PO + ", "
    f"RP AS (SELECT slot, x, parent_obj, parent_k, {repair_sql(5, 9)} AS mask FROM CD2, O), "
    f"SC AS (SELECT *, round({U('fpa.obj', G, 'slot')}, 6) AS obj, CAST(list_sum(mask) AS INTEGER) AS kk FROM RP), "
    "OFF AS (SELECT slot AS member, CASE WHEN obj > parent_obj THEN mask ELSE x END AS mask, "
    "CASE WHEN obj > parent_obj THEN obj ELSE parent_obj END AS obj, "
    "CASE WHEN obj > parent_obj THEN kk ELSE parent_k END AS k FROM SC), "
    "EL AS (SELECT 0 AS member, mask, obj, k FROM P ORDER BY obj DESC, member ASC LIMIT 1) "
    "SELECT * FROM EL UNION ALL SELECT * FROM OFF")

add("selected_features_text",
    P_CTE + ", B AS (SELECT mask FROM P ORDER BY obj DESC, member ASC LIMIT 1) "
    "SELECT printf('f%02d', i - 1) AS name FROM (SELECT unnest(mask) AS bit, unnest(range(1, 65)) AS i FROM B) WHERE bit = 1")

# Slots from half the population on are past the budget: they copy member slot mod np and are never scored better.
_PARENT = f"CAST(floor({U('fpa.parent', G, 'range')} * np) AS INTEGER) AS parent"
add("fpa_generation_budget",
    _SQL["fpa_generation"].replace(
        _PARENT, "CAST(CASE WHEN range - 1 >= np // 2 THEN range % np ELSE " + _PARENT.removesuffix(" AS parent") + " END AS INTEGER) AS parent")
    .replace("WHEN obj > parent_obj", "WHEN slot - 1 < (SELECT np FROM NP) // 2 AND obj > parent_obj"))
