"""ANSI SQL for the registered queries, written from the definitions.

The SQL takes the long way wherever the Spark code takes a short one: posterior variances are
double sums over cells, priors write out every unoccupied cell, trees come from the cycle
property, leave-outs and knock-outs are fitted from scratch, paths are walked step by step.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np

from arborinfo.functions.rng import mix64
from arborinfo.workloads.queries import PATH_ENDS, SEED, SUBSET, SWEEP
from arborinfo.workloads.stand_ins import (
    COMPONENTS, FEATURES, LETTERS, MANY, PEPTIDE_RESIDUES, RESIDUES, SCORED, VARIABLES,
)
from arborinfo.workloads.stand_ins import POINTS as POINT_COUNT

ORACLE: dict[str, str] = {}


def rnd(x: str, digits: int = 10) -> str:
    # Adding zero turns a negative zero into zero.
    return f"(round({x}, {digits}) + 0.0)"


def digamma(x: str) -> str:
    x = f"({x})"
    y = f"({x} + 10.0)"
    shift = " + ".join(f"1.0/({x} + {k}.0)" for k in range(10))
    series = f"1.0/12/({y}*{y}) - 1.0/120/pow({y},4) + 1.0/252/pow({y},6) - 1.0/240/pow({y},8) + 1.0/132/pow({y},10)"
    return f"(ln({y}) - 0.5/{y} - ({series}) - ({shift}))"


def trigamma(x: str) -> str:
    x = f"({x})"
    y = f"({x} + 10.0)"
    shift = " + ".join(f"1.0/(({x} + {k}.0)*({x} + {k}.0))" for k in range(10))
    series = f"1.0/{y} + 0.5/({y}*{y}) + 1.0/6/pow({y},3) - 1.0/30/pow({y},5) + 1.0/42/pow({y},7) - 1.0/30/pow({y},9)"
    return f"({series} + ({shift}))"


def bessel_power(order: int, x: str, terms: int = 90) -> str:
    """I_order(x) by its power series, nested from the innermost term."""
    q = f"({x}*{x}/4.0)"
    text = "1.0"
    for k in range(terms, 0, -1):
        text = f"(1.0 + {q}/{float(k * (k + order))}*{text})"
    return text if order == 0 else f"({x}/2.0*{text})"


WIDE = (
    "wide AS (SELECT "
    + ", ".join(f"CAST({v} AS VARCHAR) AS {v}" for v in VARIABLES)
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
PAIRS = "pc AS (" + " UNION ALL ".join(
    f"SELECT '{u}' AS u, '{v}' AS v, {u} AS xu, {v} AS xv, count(*) AS n FROM wide GROUP BY {u}, {v}"
    for u, v in combinations(VARIABLES, 2)
) + ")"
NODES = "nc AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS var, {v} AS state, count(*) AS n FROM wide GROUP BY {v}" for v in VARIABLES
) + ")"
PLUGIN = (
    "np AS (SELECT var, sum(n)::BIGINT AS n_obs, count(*) AS k,"
    " -sum(n/total*ln(n/total)) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY var) AS total FROM nc)"
    " GROUP BY var), "
    "pe AS (SELECT u, v, -sum(n/total*ln(n/total)) AS s_uv FROM"
    " (SELECT *, sum(n) OVER (PARTITION BY u, v) AS total FROM pc) GROUP BY u, v), "
    "edges AS (SELECT u, v, a.s AS s_u, b.s AS s_v, s_uv, a.s + b.s - s_uv AS i, a.n_obs FROM pe"
    " JOIN np a ON a.var = u JOIN np b ON b.var = v)"
)


def spanning(edges: str = "edges", name: str = "mst", by: str | None = None) -> str:
    """An edge is kept unless heavier edges connect its ends."""
    g = f"{by}, " if by else ""
    same = f" AND r.{by} = h.{by}" if by else ""
    own = f" AND r.{by} = e.{by}" if by else ""
    return (
        f"{name}_rank AS (SELECT *, row_number() OVER ({f'PARTITION BY {by} ' if by else ''}"
        f"ORDER BY i DESC, u, v) AS rk FROM {edges}), "
        f"{name}_both AS (SELECT {g}u AS a, v AS b, rk FROM {name}_rank UNION ALL"
        f" SELECT {g}v, u, rk FROM {name}_rank), "
        f"{name}_reach AS (SELECT {g}rk, u AS x FROM {name}_rank UNION"
        f" SELECT {'r.' + by + ', ' if by else ''}r.rk, h.b FROM {name}_reach r JOIN {name}_both h"
        f" ON h.a = r.x AND h.rk < r.rk{same}), "
        f"{name} AS (SELECT e.* FROM {name}_rank e WHERE NOT EXISTS (SELECT 1 FROM {name}_reach r"
        f" WHERE r.rk = e.rk AND r.x = e.v{own}))"
    )


def moments(cells: str, by: str, name: str) -> str:
    """Posterior mean, mean square and deviation of cells (by, a), with the double sum."""
    first = by.split(",")[0].strip()
    on = " AND ".join(f"p.{c.strip()} = q.{c.strip()}" for c in by.split(","))
    key = ", ".join(f"p.{c.strip()}" for c in by.split(","))
    return (
        f"{name}_t AS (SELECT {by}, a, row_number() OVER (PARTITION BY {by} ORDER BY a) AS id,"
        f" sum(a) OVER (PARTITION BY {by}) AS t FROM {cells}), "
        f"{name}_c AS (SELECT *, {digamma('t + 1')} AS pt1, {digamma('t + 2')} AS pt2, {trigamma('t + 2')} AS tt2,"
        f" {digamma('a + 1')} AS pa1, {digamma('a + 2')} AS pa2, {trigamma('a + 2')} AS ta2 FROM {name}_t), "
        f"{name}_d AS (SELECT {by}, max(pt1) - sum(a*pa1)/max(t) AS m,"
        f" sum(a*(a+1)*((pa2-pt2)*(pa2-pt2) + ta2 - tt2)) AS dg, max(t) AS t FROM {name}_c GROUP BY {by}), "
        f"{name}_o AS (SELECT {key}, sum(p.a*q.a*((p.pa1-p.pt2)*(q.pa1-q.pt2) - p.tt2)) AS od"
        f" FROM {name}_c p JOIN {name}_c q ON {on} AND p.id <> q.id GROUP BY {key}), "
        f"{name} AS (SELECT p.*, (dg + coalesce(od, 0))/(t*(t+1)) AS m2,"
        f" sqrt(greatest((dg + coalesce(od, 0))/(t*(t+1)) - m*m, 0)) AS sd"
        f" FROM {name}_d p LEFT JOIN {name}_o q ON {on})"
    ).replace("{first}", first)


def prior_cells(prior: str) -> str:
    """Parameters of nodes and of pairs, unoccupied cells of a pair written out."""
    pc = {"haldane": "0.0", "percs": "1.0/{k}", "jeffreys": "0.5", "laplace": "1.0"}[prior]
    return (
        f"na AS (SELECT nc.var, n + {pc.format(k='k')} AS a FROM nc JOIN np ON np.var = nc.var), "
        "grid AS (SELECT e.u, e.v, x.state AS xu, y.state AS xv, p.k*q.k AS kk FROM pe e"
        " JOIN nc x ON x.var = e.u JOIN nc y ON y.var = e.v"
        " JOIN np p ON p.var = e.u JOIN np q ON q.var = e.v), "
        f"ea0 AS (SELECT g.u, g.v, coalesce(n, 0) + {pc.format(k='kk')} AS a FROM grid g"
        " LEFT JOIN pc ON pc.u = g.u AND pc.v = g.v AND pc.xu = g.xu AND pc.xv = g.xv), "
        "ea AS (SELECT * FROM ea0 WHERE a > 0), "
        + moments("na", "var", "nm") + ", " + moments("ea", "u, v", "em")
        + ", pi AS (SELECT e.u, e.v, e.m AS s_uv_pm, e.sd AS s_uv_se, a.m + b.m - e.m AS i_pm,"
        " sqrt(a.sd*a.sd + b.sd*b.sd + e.sd*e.sd) AS i_se FROM em e JOIN nm a ON a.var = e.u"
        " JOIN nm b ON b.var = e.v)"
    )


def items(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join([WIDE, PAIRS, NODES, PLUGIN, *ctes]) + " " + select


MST = spanning()
HALDANE = prior_cells("haldane")
TREE = "tree AS (SELECT u, v, i, i_pm, i_se FROM mst JOIN pi USING (u, v))"
ENDS = (
    "ends AS (SELECT u AS x, v AS y, i, i_pm FROM tree UNION ALL SELECT v, u, i, i_pm FROM tree)"
)
# Walks from every node, never back.
WALK = (
    "dir AS (SELECT u, v FROM mst UNION ALL SELECT v, u FROM mst), "
    "walk AS (SELECT u, v, 1 AS d, v AS first, u AS last FROM dir UNION ALL"
    " SELECT w.u, e.v, w.d + 1, w.first, w.v FROM walk w JOIN dir e ON e.u = w.v AND e.v <> w.last)"
)
TRANSFER = (
    "bw AS (SELECT * FROM pc UNION ALL SELECT v, u, xv, xu, n FROM pc), "
    "trans AS (SELECT b.u, b.v, xu, xv, n/sum(n) OVER (PARTITION BY b.u, b.v, xu) AS p FROM bw b)"
)
PROB = "pr AS (SELECT var, state, n/sum(n) OVER (PARTITION BY var) AS p FROM nc)"

ORACLE["node_entropy_plugin"] = items(select=f"SELECT var, n_obs, k, {rnd('s')} AS s FROM np")
for _p in ("haldane", "laplace", "jeffreys", "percs"):
    ORACLE[f"node_entropy_posterior_{_p}"] = items(
        prior_cells(_p), select=f"SELECT var, {rnd('m', 9)} AS s_pm, {rnd('sd', 6)} AS s_se FROM nm"
    )
    ORACLE[f"pair_information_posterior_{_p}"] = items(
        prior_cells(_p),
        select=f"SELECT u, v, {rnd('s_uv_pm', 9)} AS s_uv_pm, {rnd('s_uv_se', 6)} AS s_uv_se,"
        f" {rnd('i_pm', 9)} AS i_pm, {rnd('i_se', 6)} AS i_se FROM pi",
    )
ORACLE["entropy_mean_square"] = items(HALDANE, select=f"SELECT var, {rnd('m2', 8)} AS s_sq FROM nm")

ORACLE["special_functions"] = (
    "WITH c AS (SELECT CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax,"
    " count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " GROUP BY l_discount, l_tax), "
    "b AS (SELECT *, 10.0::DOUBLE + n % 30 AS k FROM c) "
    f"SELECT l_discount, l_tax, {rnd(digamma('n'), 9)} AS psi, {rnd(trigamma('n'), 9)} AS psi1,"
    f" {rnd('lgamma(n)', 6)} AS lg, {rnd('ln(' + bessel_power(0, 'k') + ')', 8)} AS li0,"
    f" {rnd(bessel_power(1, 'k') + '/' + bessel_power(0, 'k'), 8)} AS ratio FROM b"
)

BETA = (
    "bx AS (SELECT g.u, g.v, g.xu, g.xv, coalesce(pc.n, 0) AS n, x.n AS nx, y.n AS ny, t.n_obs AS t,"
    " 2.5*y.n/t.n_obs AS q FROM (SELECT e.u, e.v, x.state AS xu, y.state AS xv FROM pe e"
    " JOIN nc x ON x.var = e.u JOIN nc y ON y.var = e.v) g"
    " LEFT JOIN pc USING (u, v, xu, xv) JOIN nc x ON x.var = g.u AND x.state = g.xu"
    " JOIN nc y ON y.var = g.v AND y.state = g.xv JOIN np t ON t.var = g.u)"
)
ORACLE["pair_information_fixed_beta"] = items(
    BETA,
    f"h AS (SELECT u, v, xu, nx, t, {digamma('nx + 3.5')} - sum((q + n)/(2.5 + nx)*{digamma('q + n + 1')}) AS h"
    " FROM bx GROUP BY u, v, xu, nx, t)",
    select="SELECT h.u, h.v, " + rnd("max(np.s) - sum(nx/t*h)", 9)
    + " AS i_beta FROM h JOIN np ON np.var = h.v GROUP BY h.u, h.v",
)
ORACLE["pair_log_likelihood_fixed_beta"] = items(
    BETA,
    "h AS (SELECT u, v, xu, lgamma(2.5) - lgamma(nx + 2.5) + sum(lgamma(n + q) - lgamma(q)) AS h"
    " FROM bx GROUP BY u, v, xu, nx)",
    select=f"SELECT u, v, {rnd('sum(h)', 4)} AS log_likelihood FROM h GROUP BY u, v",
)

# A plain sum over a fixed fine grid of ln b, state by state.
_A = "(n + b)"
ORACLE["node_entropy_nsb"] = items(
    "kk AS (SELECT var, sum(n) AS t, CASE WHEN var = 'l_discount' THEN 20 ELSE count(*) END AS k, count(*) AS seen"
    " FROM nc GROUP BY var), "
    "cells AS (SELECT var, n::DOUBLE AS n, 1.0 AS m FROM nc UNION ALL SELECT var, 0.0, (k - seen)::DOUBLE FROM kk WHERE k > seen), "
    "grid AS (SELECT exp(-20.0 + 0.02*unnest(range(2001))) AS b), "
    f"sums AS (SELECT var, b, sum(m*(lgamma({_A}) - lgamma(b))) AS l, sum(m*{_A}) AS a, sum(m*{_A}*{digamma('n + b + 1')}) AS ap,"
    f" sum(m*{_A}*pow({digamma('n + b + 1')}, 2)) AS app, sum(m*{_A}*({_A} + 1)*{trigamma('n + b + 1')}) AS att"
    " FROM cells, grid GROUP BY var, b), "
    f"ev AS (SELECT *, l + lgamma(k*b) - lgamma(t + k*b) + ln(b) + ln(greatest(k*{trigamma('k*b + 1')} - {trigamma('b + 1')}, 1e-300))"
    f" AS e, {digamma('a + 1')} - ap/a AS mean, (app/a - pow(ap/a, 2))/(a + 1) + att/(a*(a + 1)) - {trigamma('a + 1')} AS var2"
    " FROM sums JOIN kk USING (var)), "
    "wt AS (SELECT *, exp(e - max(e) OVER (PARTITION BY var)) AS w FROM ev), "
    "mm AS (SELECT var, sum(w*mean)/sum(w) AS s, sum(w*(var2 + mean*mean))/sum(w) AS sq FROM wt GROUP BY var)",
    select=f"SELECT var, {rnd('s', 8)} AS s_nsb, {rnd('sqrt(greatest(sq - s*s, 0))', 8)} AS s_nsb_se FROM mm",
)

GAPS = (
    "e AS (SELECT user_id, event_type AS state, row_number() OVER w AS pos,"
    " lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT DISTINCT user_id, state FROM e), "
    "ind AS (SELECT s.user_id, s.state, e.pos, (e.state = s.state) AS now, (e.before = s.state) AS was"
    " FROM s JOIN e USING (user_id)), "
    "f AS (SELECT user_id, state, pos, pos - lag(pos) OVER (PARTITION BY user_id, state ORDER BY pos) AS gap"
    " FROM ind WHERE was IS NOT NULL AND now <> was), "
    "gaps AS (SELECT user_id, state, avg(gap) AS gap FROM f GROUP BY user_id, state)"
)
ORACLE["dwell_gaps"] = f"WITH {GAPS} SELECT user_id, state, {rnd('gap', 8)} AS gap FROM gaps"
ORACLE["block_jackknife"] = (
    f"WITH {GAPS}, c AS (SELECT user_id, state, count(*) AS n FROM e GROUP BY user_id, state), "
    "cells AS (SELECT c.user_id, o.state AS gone, CASE WHEN c.state <> o.state THEN c.n"
    " WHEN c.n - g.gap > 0 THEN c.n - g.gap ELSE 1 END::DOUBLE AS a FROM c JOIN c o USING (user_id)"
    " LEFT JOIN gaps g ON g.user_id = o.user_id AND g.state = o.state), "
    + moments("cells", "user_id, gone", "mo")
    + f" SELECT user_id, {rnd('sqrt(greatest(avg(m2) - avg(m)*avg(m), 0))', 6)} AS s_se FROM mo GROUP BY user_id"
)

ORACLE["pair_counts"] = items(select="SELECT u, v, xu, xv, n FROM pc")
ORACLE["pair_counts_many"] = (
    "WITH v AS (SELECT l_linestatus AS a00, l_returnflag AS b01, l_linenumber AS c02, nullif(l_linenumber, 3) AS d03,"
    " -l_linenumber AS e04, CAST(l_quantity AS INTEGER) AS f05, o_orderstatus AS g06, o_orderpriority AS h07,"
    " nullif(o_orderstatus, 'F') AS i08, month(l_shipdate) AS j09, month(o_orderdate) AS k10,"
    " CAST(year(o_orderdate) AS BIGINT) * 31536000 AS l11, CAST(year(l_shipdate) AS BIGINT) * -4000000000 AS m12,"
    " CAST(l_suppkey % 9 AS BIGINT) - 4 AS n13, l_linenumber % 2 = 0 AS o14"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey), w AS (SELECT "
    + ", ".join(f"coalesce(CAST({v} AS VARCHAR), 'null') AS {v}" for v in MANY)
    + " FROM v) " + " UNION ALL ".join(
        f"SELECT '{u}' AS u, '{v}' AS v, {u} AS xu, {v} AS xv, count(*) AS n FROM w GROUP BY 3, 4"
        for u, v in combinations(MANY, 2)
    )
)
ORACLE["pair_probabilities"] = items(
    select=f"SELECT u, v, xu, xv, {rnd('n/sum(n) OVER (PARTITION BY u, v)')} AS p FROM pc"
)
ORACLE["pair_information"] = items(
    select=f"SELECT u, v, n_obs, {rnd('s_u')} AS s_u, {rnd('s_v')} AS s_v, {rnd('s_uv')} AS s_uv, {rnd('i')} AS i FROM edges"
)


def discrete(rows: str, names: list[str]) -> str:
    """nc, pc, np, pe and edges of the columns ``names`` of ``rows``."""
    counts = "nc AS (" + " UNION ALL ".join(
        f"SELECT '{v}' AS var, CAST({v} AS VARCHAR) AS state, count(*) AS n FROM {rows} GROUP BY 2" for v in names
    ) + ")"
    joint = "pc AS (" + " UNION ALL ".join(
        f"SELECT '{u}' AS u, '{v}' AS v, CAST({u} AS VARCHAR) AS xu, CAST({v} AS VARCHAR) AS xv, count(*) AS n"
        f" FROM {rows} GROUP BY 3, 4" for u, v in combinations(names, 2)
    ) + ")"
    return f"{counts}, {joint}, {PLUGIN}"


ORDER_ROWS = (
    "w AS (SELECT c_nationkey AS nation, strpos('12345', left(o_orderpriority, 1)) - 1 AS priority,"
    " strpos('ABFHM', left(c_mktsegment, 1)) - 1 AS segment, strpos('FOP', left(o_orderstatus, 1)) - 1 AS status"
    " FROM orders JOIN customer ON o_custkey = c_custkey)"
)
ORACLE["pair_information_long_states"] = (
    f"WITH {ORDER_ROWS}, {discrete('w', ['nation', 'priority', 'segment', 'status'])}"
    f" SELECT u, v, n_obs, {rnd('i')} AS i FROM edges"
)
ORACLE["pair_counts_encoded"] = (
    "WITH e AS (SELECT dayofweek(ts) + 1 AS day, event_type, hour(ts) AS hour FROM events), "
    + ", ".join(
        f"d_{c} AS (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) - 1 AS s FROM e GROUP BY {c})"
        for c in ("day", "event_type", "hour")
    )
    + ", w AS (SELECT d_day.s AS day, d_event_type.s AS event_type, d_hour.s AS hour FROM e"
    " JOIN d_day USING (day) JOIN d_event_type USING (event_type) JOIN d_hour USING (hour)), "
    + discrete("w", ["day", "event_type", "hour"]) + " SELECT u, v, xu, xv, n FROM pc"
)
ORACLE["streamed_pair_counts"] = "WITH " + discrete(
    "lineitem", ["l_discount", "l_linenumber", "l_linestatus", "l_returnflag"]
) + " SELECT u, v, xu, xv, n FROM pc"

ORACLE["tree_edges"] = items(MST, select=f"SELECT u, v, {rnd('i')} AS i FROM mst")
ORACLE["tree_edges_by_components"] = ORACLE["tree_edges"]
ORACLE["tree_edge_posterior"] = items(
    MST, HALDANE, TREE,
    select=f"SELECT u, v, {rnd('i')} AS i, {rnd('i_pm', 9)} AS i_pm, {rnd('i_se', 6)} AS i_se FROM tree",
)


def summary(s: str, i: str, digits: int) -> str:
    return (
        f"SELECT {rnd('a.s', digits)} AS sum_entropy, {rnd('b.i', digits)} AS sum_mi,"
        f" {rnd('a.s - b.i', digits)} AS entropy FROM ({s}) a, ({i}) b"
    )


POSTERIOR_SUMMARY = summary("SELECT sum(m) AS s FROM nm", "SELECT sum(i_pm) AS i FROM tree", 8)
ORACLE["tree_summary"] = items(MST, HALDANE, TREE, select=POSTERIOR_SUMMARY)
ORACLE["change_prior"] = items(MST, prior_cells("laplace"), TREE, select=POSTERIOR_SUMMARY)
ORACLE["tree_summary_plugin"] = items(
    MST, select=summary("SELECT sum(s) AS s FROM np", "SELECT sum(i) AS i FROM mst", 10)
)
ORACLE["node_entropies"] = items(HALDANE, select=f"SELECT var, {rnd('m', 9)} AS entropy FROM nm")
ORACLE["node_information"] = items(
    MST, HALDANE, TREE, ENDS, select=f"SELECT x AS var, {rnd('sum(i_pm)', 9)} AS sum_mi FROM ends GROUP BY x"
)
ORACLE["node_contributions"] = items(
    MST, HALDANE, TREE, ENDS,
    select=f"SELECT x AS var, {rnd('max(m) - sum(i_pm)/2', 9)} AS contribution FROM ends JOIN nm ON var = x GROUP BY x",
)
ORACLE["edge_information"] = items(
    MST, HALDANE, TREE, select=f"SELECT u, v, {rnd('i_pm', 9)} AS mi FROM tree"
)
ORACLE["tree_neighbours"] = items(
    MST, HALDANE, TREE, ENDS,
    select=f"SELECT y AS v, {rnd('i')} AS i, {rnd('i_pm', 9)} AS i_pm FROM ends WHERE x = 'l_linenumber'",
)
ORACLE["tree_paths"] = items(MST, WALK, select="SELECT u, v, d, first, last FROM walk")
ORACLE["tree_trim"] = items(
    MST,
    WALK,
    "used AS (SELECT DISTINCT least(w.u, w.first) AS a, greatest(w.u, w.first) AS b FROM walk w"
    f" WHERE w.u IN {tuple(SUBSET)} AND w.v IN {tuple(SUBSET)}"
    " UNION SELECT least(p.v, q.first), greatest(p.v, q.first) FROM walk p JOIN walk q ON q.u = p.v"
    f" AND q.first <> p.last WHERE p.u IN {tuple(SUBSET)} AND q.v IN {tuple(SUBSET)})",
    select=f"SELECT u, v, {rnd('i')} AS i FROM mst JOIN used ON u = a AND v = b",
)
ORACLE["tree_leaf_paths"] = items(
    MST, WALK,
    "leaf AS (SELECT u AS leaf FROM dir GROUP BY u HAVING count(*) = 1 AND u <> 'l_discount'), "
    "up AS (SELECT v AS child, last AS parent, d FROM walk WHERE u = 'l_discount'), "
    "climb AS (SELECT leaf, child, parent, d FROM leaf JOIN up ON child = leaf UNION ALL"
    " SELECT c.leaf, up.child, up.parent, up.d FROM climb c JOIN up ON up.child = c.parent)",
    select="SELECT leaf, d AS step, parent, child FROM climb",
)
_SUB = tuple(sorted(SUBSET + ["l_returnflag"]))
ORACLE["refit_to_subset"] = items(
    f"sel AS (SELECT * FROM edges WHERE u IN {_SUB} AND v IN {_SUB})",
    spanning("sel"), select=f"SELECT u, v, {rnd('i')} AS i FROM mst",
)

# Walk the tree while carrying the law of the walker's state given the start.
IMPLIED = (
    f"{TRANSFER}, "
    "tt AS (SELECT t.* FROM trans t JOIN dir d ON d.u = t.u AND d.v = t.v), "
    "c1 AS (SELECT w.u, w.v, t.xu, t.xv, t.p, w.last FROM walk w JOIN tt t ON t.u = w.u AND t.v = w.v WHERE d = 1)"
)


def implied_steps(longest: int) -> str:
    out = []
    for d in range(2, longest + 1):
        out.append(
            f"c{d} AS (SELECT c.u, t.v, c.xu, t.xv, sum(c.p*t.p) AS p, c.v AS last FROM c{d - 1} c"
            f" JOIN tt t ON t.u = c.v AND t.xu = c.xv AND t.v <> c.last GROUP BY c.u, t.v, c.xu, t.xv, c.v)"
        )
    union = " UNION ALL ".join(f"SELECT u, v, xu, xv, p FROM c{d}" for d in range(1, longest + 1))
    return ", ".join(out + [f"cond AS ({union})", PROB,
        "ij AS (SELECT c.u, c.v, xu, xv, c.p*pr.p AS p FROM cond c JOIN pr ON var = u AND state = xu WHERE c.u < c.v)"])


STEPS = implied_steps(len(VARIABLES) - 1)
INFO = "FROM {j} JOIN np a ON a.var = u JOIN np b ON b.var = v GROUP BY u, v"
ICL = (
    "icl AS (SELECT u, v, max(a.s) + max(b.s) + sum(CASE WHEN p > 0 THEN p*ln(p) ELSE 0 END) AS i "
    + INFO.format(j="ij") + ")"
)
ORACLE["transfer_matrix"] = items(
    MST, WALK, IMPLIED, select=f"SELECT u, v, xu, xv, {rnd('p')} AS p FROM tt"
)
ORACLE["transfer_matrix_fixed_state"] = items(
    select="SELECT state AS xu, '0.02' AS xv, 1.0::DOUBLE AS p FROM nc WHERE var = 'l_discount'"
)
ORACLE["path_joint"] = items(
    MST, WALK, IMPLIED, STEPS,
    select=f"SELECT xu, xv, {rnd('p')} AS p FROM ij WHERE u = '{PATH_ENDS[0]}' AND v = '{PATH_ENDS[1]}'",
)
ORACLE["implied_information"] = items(
    MST, WALK, IMPLIED, STEPS, ICL, select=f"SELECT u, v, {rnd('i')} AS i_cl FROM icl"
)
_EMP = "SELECT u, v, i FROM edges UNION ALL SELECT v, u, i FROM edges"
_CL = "SELECT u, v, i FROM icl UNION ALL SELECT v, u, i FROM icl"
_DIAG = "SELECT var AS u, var AS v, s AS i FROM np"
ORACLE["information_matrix_empirical"] = items(
    select=f"SELECT u, v, {rnd('i')} AS value FROM ({_EMP} UNION ALL {_DIAG})"
)
ORACLE["information_matrix_chow_liu"] = items(
    MST, WALK, IMPLIED, STEPS, ICL, select=f"SELECT u, v, {rnd('i')} AS value FROM ({_CL} UNION ALL {_DIAG})"
)
ORACLE["information_matrix_hybrid"] = items(
    MST, WALK, IMPLIED, STEPS, ICL,
    select=f"SELECT u, v, {rnd('i')} AS value FROM (SELECT u, v, i FROM edges UNION ALL"
    f" SELECT v, u, i FROM icl UNION ALL {_DIAG})",
)
ORACLE["information_matrix_pivot"] = items(
    select="SELECT u, " + ", ".join(
        f"{rnd(chr(109) + 'ax(CASE WHEN v = ' + chr(39) + v + chr(39) + ' THEN i END)')} AS {v}" for v in VARIABLES
    ) + f" FROM ({_EMP}) GROUP BY u"
)

# Directed edges away from the first variable, parents first; scoring and sampling use columns.
UP = "up AS (SELECT v AS child, last AS parent, d FROM walk WHERE u = 'l_discount')"
_STATE = lambda c, a: "CASE " + " ".join(f"WHEN {c} = '{v}' THEN {a}.{v}" for v in VARIABLES) + " END"
ORACLE["log_probability"] = items(
    MST, WALK, TRANSFER, PROB, UP,
    "rows AS (SELECT *, row_number() OVER () AS id FROM wide), "
    "terms AS (SELECT r.id, ln(t.p) AS l FROM rows r JOIN up ON true JOIN trans t ON t.u = up.parent"
    f" AND t.v = up.child AND t.xu = {_STATE('up.parent', 'r')} AND t.xv = {_STATE('up.child', 'r')}"
    " UNION ALL SELECT r.id, ln(p) FROM rows r JOIN pr ON var = 'l_discount' AND state = r.l_discount), "
    "scored AS (SELECT id, sum(l) AS l FROM terms GROUP BY id)",
    select=f"SELECT o_orderpriority, count(*) AS n, {rnd('avg(l)', 8)} AS log_p FROM rows"
    " JOIN scored USING (id) GROUP BY o_orderpriority",
)

ORACLE["log_probability_with_nulls"] = ORACLE["log_probability"].replace(
    "CAST(l_linenumber AS VARCHAR) AS l_linenumber",
    "coalesce(CAST(nullif(l_linenumber, 3) AS VARCHAR), 'null') AS l_linenumber",
).replace(
    "SELECT o_orderpriority, count(*)", "SELECT l_linenumber, count(*)"
).removesuffix("GROUP BY o_orderpriority") + "GROUP BY l_linenumber"


_WORD = "18446744073709551615::UHUGEINT"


def mixed(x: str) -> str:
    """The finalizer of the keyed generator on a 64-bit value, in 128-bit arithmetic; fixed values."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        # The lambda keeps the value from being written twice.
        x = f"list_transform([{x}], lambda y: xor(y, y >> {shift}) * {factor}::UHUGEINT & {_WORD})[1]"
    return f"list_transform([{x}], lambda y: xor(y, y >> 31))[1]"


def draw(var: str) -> str:
    """A number in (0, 1] for ``id`` and a variable, as the samples draw it."""
    base = lambda v: int(mix64(mix64(np.array([SEED], np.uint64)) ^ mix64(np.array([zlib.crc32(v.encode()) + 1], np.uint64)))[0])
    keys = " ".join(f"WHEN '{v}' THEN {base(v)}::UHUGEINT" for v in VARIABLES)
    start = f"(xor(id::UHUGEINT, CASE {var} {keys} END) + {0x9E3779B97F4A7C15}::UHUGEINT) & {_WORD}"
    return f"(({mixed(start)} >> 11)::DOUBLE + 1) / {float(2**53)}"


# Level by level: each sample holds (id, var, state) rows, a child's state follows its parent's.
_LEVELS = len(VARIABLES) - 1
_SAMPLE = (
    "cum AS (SELECT t.u, t.v, xu, xv, sum(p) OVER (PARTITION BY t.u, t.v, xu ORDER BY xv) AS hi,"
    " row_number() OVER (PARTITION BY t.u, t.v, xu ORDER BY xv) AS nr FROM trans t"
    " JOIN up ON up.parent = t.u AND up.child = t.v), "
    "cut AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY u, v, xu ORDER BY nr), -1.0) AS lo,"
    " nr = max(nr) OVER (PARTITION BY u, v, xu) AS top FROM cum), "
    "rc AS (SELECT state, sum(p) OVER (ORDER BY state) AS hi FROM pr WHERE var = 'l_discount'), "
    "rl AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY state), -1.0) AS lo,"
    " row_number() OVER (ORDER BY state DESC) = 1 AS top FROM rc), "
    "ids AS (SELECT o_orderkey AS id FROM orders), "
    "d0a AS (SELECT id, " + draw("'l_discount'") + " AS z FROM ids), "
    "d0 AS (SELECT id, 'l_discount' AS var, state FROM d0a JOIN rl ON z >= lo AND (z < hi OR top))"
)
for _d in range(1, _LEVELS + 1):
    _SAMPLE += (
        f", d{_d}a AS (SELECT s.id, s.var, s.state, up.child, {draw('up.child')} AS z FROM d{_d - 1} s"
        f" JOIN up ON up.parent = s.var), "
        f"d{_d} AS (SELECT id, child AS var, xv AS state FROM d{_d}a JOIN cut ON cut.u = d{_d}a.var"
        f" AND cut.v = child AND cut.xu = d{_d}a.state AND z >= lo AND (z < hi OR top))"
    )
ORACLE["tree_sample"] = items(
    MST, WALK, TRANSFER, PROB, UP, _SAMPLE,
    "drawn AS (" + " UNION ALL ".join(f"SELECT * FROM d{d}" for d in range(_LEVELS + 1)) + ")",
    select="SELECT id, " + ", ".join(f"max(CASE WHEN var = '{v}' THEN state END) AS {v}" for v in VARIABLES)
    + " FROM drawn GROUP BY id",
)
ORACLE["reweighted_joints"] = items(
    MST, WALK, TRANSFER, UP,
    select=f"SELECT t.u, t.v, xu, xv, {rnd('p/k')} AS p FROM trans t JOIN up ON parent = t.u AND child = t.v"
    " JOIN np ON np.var = t.u",
)

# Leaving a variable out: one graph per left-out variable, each with its own tree.
LEFT = (
    "lo_edges AS (SELECT x.var AS node, e.u, e.v, e.i FROM np x JOIN edges e ON e.u <> x.var AND e.v <> x.var)"
)
LEFT_TREES = (
    f"{LEFT}, {spanning('lo_edges', 'lo', 'node')}, "
    "lo_ends AS (SELECT node, u AS x, i FROM lo UNION ALL SELECT node, v, i FROM lo), "
    "lo_c AS (SELECT node, x AS var, max(s) - sum(i)/2 AS c FROM lo_ends JOIN np ON np.var = x GROUP BY node, x), "
    "lo_s AS (SELECT x.var AS node, (SELECT sum(s) FROM np y WHERE y.var <> x.var)"
    " - (SELECT sum(i) FROM lo WHERE lo.node = x.var) AS s FROM np x)"
)
ORACLE["leave_one_out_entropies"] = items(
    LEFT_TREES, select=f"SELECT node, {rnd('s')} AS entropy FROM lo_s"
)
ORACLE["leave_one_out_contributions"] = items(
    LEFT_TREES, select=f"SELECT node, var, {rnd('c')} AS contribution FROM lo_c"
)
ORACLE["contribution_spread"] = items(
    LEFT_TREES, select=f"SELECT var, {rnd('stddev_samp(c)', 9)} AS s_contribution_se FROM lo_c GROUP BY var"
)
ERRORS = (
    "err AS (SELECT (SELECT sum(s - m) FROM np JOIN nm USING (var)) - (SELECT sum(i - i_pm) FROM tree) AS bias,"
    " (SELECT sum(sd*sd) FROM nm) + (SELECT sum(i_se*i_se) FROM tree) AS cv,"
    " (SELECT var_pop(s) FROM lo_s) AS sv)"
)
ORACLE["tree_errors"] = items(
    MST, HALDANE, TREE, LEFT_TREES, ERRORS,
    select=f"SELECT {rnd('bias', 8)} AS mle_bias, {rnd('cv', 8)} AS counts_variance,"
    f" {rnd('sv', 8)} AS structural_variance, {rnd('sqrt(sv + cv + bias*bias)', 6)} AS rmse FROM err",
)
_Z = 1.959963984540054
ORACLE["tree_entropy_interval"] = items(
    MST, HALDANE, TREE, LEFT_TREES, ERRORS,
    "fin AS (SELECT (SELECT sum(m) FROM nm) - (SELECT sum(i_pm) FROM tree) AS s, sqrt(sv + cv + bias*bias) AS e FROM err)",
    select=f"SELECT {rnd('s', 8)} AS entropy, {rnd('e', 6)} AS entropy_se, {rnd(f's - {_Z}*e', 6)} AS lo,"
    f" {rnd(f's + {_Z}*e', 6)} AS hi FROM fin",
)
ORACLE["saved_tree_summary"] = ORACLE["tree_entropy_interval"]

# Knocking an edge out: its weight becomes zero and the tree is fitted again, per edge.
_KO_STEPS = []
for _d in range(2, len(VARIABLES)):
    _KO_STEPS.append(
        f"k{_d} AS (SELECT c.ko, c.u, t.v, c.xu, t.xv, sum(c.p*t.p) AS p, c.v AS last FROM k{_d - 1} c"
        f" JOIN ktt t ON t.ko = c.ko AND t.u = c.v AND t.xu = c.xv AND t.v <> c.last"
        f" GROUP BY c.ko, c.u, t.v, c.xu, t.xv, c.v)"
    )
KNOCK = (
    "ko_edges AS (SELECT m.u || '-' || m.v AS ko, e.u, e.v,"
    " CASE WHEN e.u = m.u AND e.v = m.v THEN 0.0 ELSE e.i END AS i FROM mst m JOIN edges e ON true), "
    f"{spanning('ko_edges', 'kt', 'ko')}, "
    "kdir AS (SELECT ko, u, v FROM kt UNION ALL SELECT ko, v, u FROM kt), "
    "ktt AS (SELECT d.ko, t.* FROM kdir d JOIN trans t ON t.u = d.u AND t.v = d.v), "
    "k1 AS (SELECT t.ko, t.u, t.v, t.xu, t.xv, t.p, t.u AS last FROM ktt t JOIN mst m"
    " ON t.ko = m.u || '-' || m.v AND t.u = m.u), "
    + ", ".join(_KO_STEPS)
    + ", kall AS (" + " UNION ALL ".join(f"SELECT ko, u, v, xu, xv, p FROM k{d}" for d in range(1, len(VARIABLES)))
    + "), kj AS (SELECT k.u, k.v, xu, xv, k.p*pr.p AS p FROM kall k JOIN mst m ON k.ko = m.u || '-' || m.v"
    " AND k.u = m.u AND k.v = m.v JOIN pr ON var = k.u AND state = xu)"
)
ORACLE["edge_knockout"] = items(
    MST, TRANSFER, PROB, KNOCK, select=f"SELECT u, v, xu, xv, {rnd('p')} AS p FROM kj"
)
ORACLE["implied_information_with_knockouts"] = items(
    MST, WALK, IMPLIED, STEPS, ICL, KNOCK,
    "kcl AS (SELECT u, v, max(a.s) + max(b.s) + sum(CASE WHEN p > 0 THEN p*ln(p) ELSE 0 END) AS i "
    + INFO.format(j="kj") + ")",
    select=f"SELECT u, v, {rnd('i')} AS i_cl FROM (SELECT * FROM kcl UNION ALL"
    " SELECT icl.* FROM icl ANTI JOIN mst ON icl.u = mst.u AND icl.v = mst.v)",
)

# -- score arrays ------------------------------------------------------------------------------

_SCORES = lambda r: f"list_transform(range({LETTERS}), lambda j: embedding[({LETTERS * r} + j) % len(embedding) + 1])"
_ARG = lambda r: f"list_position({_SCORES(r)}, list_max({_SCORES(r)})) - 1"
ORACLE["score_states"] = " UNION ALL ".join(
    f"SELECT vec_id AS frame, '{r}' AS var, CAST({_ARG(r)} AS INTEGER) AS state FROM embeddings" for r in range(SCORED)
)
_LETTERS = [f"r{r}" for r in range(SCORED)]
ORACLE["score_tree"] = (
    "WITH RECURSIVE w AS (SELECT " + ", ".join(f"{_ARG(r)} AS r{r}" for r in range(SCORED)) + " FROM embeddings), "
    + discrete("w", _LETTERS) + ", " + spanning()
    + f" SELECT substr(u, 2) AS u, substr(v, 2) AS v, {rnd('i')} AS i FROM mst"
)

# -- angles ------------------------------------------------------------------------------------

ANGLES = (
    "f AS (SELECT unnest(range(" + str(RESIDUES * FEATURES) + ")) AS j), "
    "ang AS (SELECT vec_id AS frame, label, CAST(j // " + str(FEATURES) + " AS INTEGER) AS residue,"
    " CAST(j % " + str(FEATURES) + " AS INTEGER) AS feature,"
    " atan2(embedding[2*j + 2]::DOUBLE, embedding[2*j + 1]::DOUBLE) AS x FROM embeddings, f)"
)
MEANS = (
    "mn AS (SELECT residue, label, feature, count(*) AS n, atan2(sum(sin(x)), sum(cos(x))) AS mu,"
    " 12.0 + label + 0.5*feature AS kappa FROM ang GROUP BY residue, label, feature), "
    f"nrm AS (SELECT *, ln(2*pi()) + ln({bessel_power(0, 'kappa')}) AS z FROM mn)"
)
ESTEP = (
    "ld AS (SELECT a.residue, a.frame, m.label AS comp, sum(kappa*cos(x - mu) - z) AS l,"
    " ln(max(n)/(SELECT count(*) FROM embeddings)) AS lw FROM ang a JOIN nrm m"
    " ON m.residue = a.residue AND m.feature = a.feature GROUP BY a.residue, a.frame, m.label), "
    "tp AS (SELECT *, max(l + lw) OVER (PARTITION BY residue, frame) AS top FROM ld), "
    "rs AS (SELECT residue, frame, comp, exp(l + lw - top)/sum(exp(l + lw - top)) OVER"
    " (PARTITION BY residue, frame) AS r, top, l, lw FROM tp)"
)
ORACLE["circular_mean"] = (
    f"WITH {ANGLES}, {MEANS} SELECT residue, label, feature, n, {rnd('mu', 8)} AS mu FROM mn"
)
ORACLE["wrapped_angles"] = (
    f"WITH {ANGLES}, y AS (SELECT *, x*5 - 2*pi()*floor(x*5/(2*pi())) AS t FROM ang) SELECT residue, frame, feature, "
    + rnd("CASE WHEN feature % 4 = 3 THEN 0.0 WHEN t > pi() THEN t - 2*pi() ELSE t END", 8) + " AS wrapped, "
    + rnd("CASE WHEN feature % 4 = 3 THEN 0.0 ELSE least(greatest(x*300, 10), 600) END", 6) + " AS clamped FROM y"
)
FITTED = f"WITH RECURSIVE {ANGLES}, {MEANS}, {ESTEP}"
ORACLE["component_log_density"] = f"{FITTED} SELECT residue, frame, comp, {rnd('l', 4)} AS log_density FROM ld"
ORACLE["mixture_responsibilities"] = f"{FITTED} SELECT residue, frame, comp, {rnd('r', 7)} AS r FROM rs"
ORACLE["mixture_log_likelihood"] = (
    f"{FITTED}, fr AS (SELECT residue, frame, max(top) + ln(sum(exp(l + lw - top))) AS ll FROM tp"
    f" GROUP BY residue, frame) SELECT residue, {rnd('avg(ll)', 6)} AS ll FROM fr GROUP BY residue"
)
SUMS = (
    "sm AS (SELECT a.residue, comp, feature, sum(r) AS w, sum(r*cos(x)) AS c, sum(r*sin(x)) AS s FROM rs"
    " JOIN ang a ON a.residue = rs.residue AND a.frame = rs.frame GROUP BY a.residue, comp, feature)"
)
ORACLE["expectation_step"] = (
    f"{FITTED}, {SUMS} SELECT residue, comp, feature, {rnd('w', 6)} AS w, {rnd('c', 6)} AS c, {rnd('s', 6)} AS s FROM sm"
)
ORACLE["expected_log_likelihood"] = (
    f"{FITTED}, el AS (SELECT residue, sum(r*l) AS e FROM rs GROUP BY residue), mx AS (SELECT residue,"
    " sum(w*ln(w)) AS m FROM (SELECT DISTINCT residue, comp, exp(lw) AS w FROM rs) GROUP BY residue)"
    f" SELECT residue, {rnd('e + m', 5)} AS ell FROM el JOIN mx USING (residue)"
)


def _tail(order: int, terms: int = 15) -> str:
    out, c, mu = ["1.0"], 1.0, 4.0 * order * order
    for k in range(1, terms):
        c *= -(mu - (2 * k - 1) ** 2) / (8.0 * k)
        out.append(f"{c!r}/pow(k, {k})")
    return "(" + " + ".join(out) + ")"


_NEWTON = "q0 AS (SELECT *, least(sqrt(c*c + s*s)/w, 1.0) AS rr FROM sm), " + (
    "q1 AS (SELECT *, least(greatest(rr*(2 - rr*rr)/(1 - rr*rr), 10), 600) AS k FROM q0)"
)
for _i in range(2, 7):
    _NEWTON += (
        f", a{_i} AS (SELECT *, {_tail(1)}/{_tail(0)} AS av FROM q{_i - 1})"
        f", q{_i} AS (SELECT residue, comp, feature, w, c, s, rr,"
        f" least(greatest(k - (av - rr)/(1 - av*av - av/k), 10), 600) AS k FROM a{_i})"
    )
ORACLE["maximization_step"] = (
    f"{FITTED}, {SUMS}, {_NEWTON} SELECT residue, comp, feature,"
    f" {rnd('ln(w/max(w) OVER (PARTITION BY residue))', 6)} AS logw, {rnd('atan2(s, c)', 6)} AS mu,"
    f" {rnd('k', 3)} AS kappa FROM q6"
)
ORACLE["mixture_divergence"] = (
    f"WITH {ANGLES}, {MEANS}, b AS (SELECT *, {bessel_power(1, 'kappa')}/{bessel_power(0, 'kappa')} AS ar FROM nrm) "
    "SELECT p.residue, p.label AS comp, "
    + rnd("sum(q.z - p.z + p.ar*(p.kappa - q.kappa*cos(p.mu - q.mu)))", 6)
    + " AS kl FROM b p JOIN b q ON q.residue = p.residue AND q.feature = p.feature AND q.label = 0"
    " GROUP BY p.residue, p.label"
)

# -- clustering --------------------------------------------------------------------------------

OVERLAP = (
    "ov AS (SELECT a.residue, a.comp AS i, b.comp AS j, sum(sqrt(a.r*b.r)) AS c FROM rs a JOIN rs b"
    " ON b.residue = a.residue AND b.frame = a.frame GROUP BY a.residue, a.comp, b.comp), "
    "di AS (SELECT o.residue, o.i, o.j, CASE WHEN o.i = o.j THEN 0.0 ELSE 1 - o.c/sqrt(x.c*y.c) END AS d FROM ov o"
    " JOIN ov x ON x.residue = o.residue AND x.i = o.i AND x.j = o.i"
    " JOIN ov y ON y.residue = o.residue AND y.i = o.j AND y.j = o.j), "
    "wt AS (SELECT residue, i, c/(SELECT count(*) FROM embeddings) AS w FROM ov WHERE i = j)"
)


def clustering(eps: str, min_mass: float, weights: str = "wt") -> str:
    """Membership ``me`` (key, residue, comp, state, is_noise, w) for every row of ``eps``.

    ``eps`` selects (key, residue, eps); ``weights`` names a table (residue, i, w) or, with a
    key, of the weights of each clustering.
    """
    keyed = "w.key = {0}.key AND " if weights != "wt" else ""
    return (
        f"eg AS ({eps}), "
        "ne AS (SELECT g.key, d.* FROM di d JOIN eg g ON g.residue = d.residue AND d.d <= g.eps), "
        f"ms AS (SELECT n.key, n.residue, n.i, sum(w) AS m FROM ne n JOIN {weights} w ON {keyed.format('n')}w.residue = n.residue"
        " AND w.i = n.j GROUP BY n.key, n.residue, n.i), "
        f"co AS (SELECT key, residue, i FROM ms WHERE m >= {min_mass}), "
        "cn AS (SELECT n.key, n.residue, n.i, n.j FROM ne n JOIN co a ON a.key = n.key AND a.residue = n.residue AND a.i = n.i"
        " JOIN co b ON b.key = n.key AND b.residue = n.residue AND b.i = n.j), "
        "re AS (SELECT key, residue, i, i AS x FROM co UNION SELECT r.key, r.residue, r.i, c.j FROM re r JOIN cn c"
        " ON c.key = r.key AND c.residue = r.residue AND c.i = r.x), "
        "pt AS (SELECT key, residue, i, min(x) AS part FROM re GROUP BY key, residue, i), "
        "bo AS (SELECT n.key, n.residue, n.i, p.part, row_number() OVER (PARTITION BY n.key, n.residue, n.i ORDER BY n.d, n.j) AS nr"
        " FROM ne n JOIN pt p ON p.key = n.key AND p.residue = n.residue AND p.i = n.j"
        " ANTI JOIN co ON co.key = n.key AND co.residue = n.residue AND co.i = n.i), "
        "mp AS (SELECT key, residue, i, part FROM pt UNION ALL SELECT key, residue, i, part FROM bo WHERE nr = 1), "
        f"al AS (SELECT g.key, w.residue, w.i, w.w, mp.part FROM {weights} w JOIN eg g ON {keyed.format('g')}w.residue = g.residue"
        " LEFT JOIN mp ON mp.key = g.key AND mp.residue = w.residue AND mp.i = w.i), "
        "ps AS (SELECT key, residue, part, row_number() OVER (PARTITION BY key, residue ORDER BY sum(w) DESC, part) - 1 AS st"
        " FROM al WHERE part IS NOT NULL GROUP BY key, residue, part), "
        f"me AS (SELECT al.key, al.residue, al.i AS comp, CAST(coalesce(st, {COMPONENTS} - 1) AS INTEGER) AS state,"
        " al.part IS NULL AS is_noise, al.w FROM al LEFT JOIN ps ON ps.key = al.key AND ps.residue = al.residue"
        " AND ps.part = al.part)"
    )


STATE_P = (
    "sp AS (SELECT key, residue, state, sum(w) AS p FROM me GROUP BY key, residue, state HAVING sum(w) > 0), "
    "sc AS (SELECT key, residue, p*(SELECT count(*) FROM embeddings) AS a FROM sp), "
    "se AS (SELECT key, residue, -sum(p*ln(p)) AS s FROM sp GROUP BY key, residue), "
    + moments("sc", "key, residue", "cm")
)
RES = "(SELECT DISTINCT residue FROM wt)"
ONE = clustering(f"SELECT 0 AS key, residue, 0.96 AS eps FROM {RES}", 0.16)
CLUSTERED = f"{FITTED}, {OVERLAP}"
ORACLE["component_distances"] = f"{CLUSTERED} SELECT residue, i, j, {rnd('d', 7)} AS d FROM di"
ORACLE["neighbourhood_size"] = (
    f"{CLUSTERED} SELECT residue, i, count(*) AS n FROM di WHERE d <= 0.96 GROUP BY residue, i"
)
ORACLE["eps_of_spread"] = (
    f"{CLUSTERED} SELECT residue, {rnd('1 - stddev_pop(d)', 7)} AS eps FROM di WHERE i <= j GROUP BY residue"
)
ORACLE["density_states"] = f"{CLUSTERED}, {ONE} SELECT residue, comp, state, is_noise FROM me"
ORACLE["clustering_summary"] = (
    f"{CLUSTERED}, {ONE}, {STATE_P} SELECT se.residue, {rnd('s', 6)} AS s, {rnd('m', 6)} AS s_pm, {rnd('sd', 5)} AS s_se"
    " FROM se JOIN cm USING (key, residue)"
)
ASSIGNED = (
    "sr AS (SELECT r.residue, r.frame, m.state, sum(r.r) AS p FROM rs r JOIN me m ON m.residue = r.residue"
    " AND m.comp = r.comp GROUP BY r.residue, r.frame, m.state), "
    "st AS (SELECT residue, frame, state FROM (SELECT *, row_number() OVER (PARTITION BY residue, frame"
    " ORDER BY p DESC, state) AS nr FROM sr) WHERE nr = 1)"
)
ORACLE["assigned_states"] = f"{CLUSTERED}, {ONE}, {ASSIGNED} SELECT residue, frame, state FROM st"
ORACLE["assigned_state_summary"] = (
    f"{CLUSTERED}, {ONE}, {ASSIGNED}, ac AS (SELECT residue, state, count(*)::DOUBLE AS a FROM st GROUP BY residue, state), "
    + moments("ac", "residue", "am")
    + ", sh AS (SELECT residue, count(*) AS n_states, -sum(a/t*ln(a/t)) AS s FROM"
    " (SELECT *, sum(a) OVER (PARTITION BY residue) AS t FROM ac) GROUP BY residue)"
    f" SELECT sh.residue, n_states, {rnd('s', 8)} AS s, {rnd('sd', 6)} AS s_se FROM sh JOIN am USING (residue)"
)
_GRID = " UNION ALL ".join(f"SELECT {i} AS key, {e!r} AS eps" for i, e in enumerate(SWEEP))
ORACLE["eps_sweep"] = (
    f"{CLUSTERED}, gr AS ({_GRID}), {clustering(f'SELECT key, residue, eps FROM gr, {RES}', 0.01)}, {STATE_P} SELECT se.residue, {rnd('eps::DOUBLE', 2)} AS eps,"
    f" {rnd('s', 6)} AS s, {rnd('m', 6)} AS s_pm, {rnd('sd', 5)} AS s_se"
    " FROM se JOIN cm USING (key, residue) JOIN gr USING (key)"
)
ORACLE["density_matrices"] = (
    f"{CLUSTERED}, {ONE}, "
    "dn AS (SELECT *, dense_rank() OVER (PARTITION BY residue ORDER BY state) - 1 AS nr FROM me), "
    "sr AS (SELECT r.residue, r.frame, CAST(m.nr AS INTEGER) AS nr, sum(r.r) AS p FROM rs r JOIN dn m"
    " ON m.residue = r.residue AND m.comp = r.comp GROUP BY r.residue, r.frame, m.nr), "
    "dm AS (SELECT a.residue, a.nr AS i, b.nr AS j, sum(sqrt(a.p*b.p)) AS x FROM sr a JOIN sr b"
    " ON b.residue = a.residue AND b.frame = a.frame GROUP BY a.residue, a.nr, b.nr)"
    f" SELECT residue, i, j, {rnd('x/sum(CASE WHEN i = j THEN x END) OVER (PARTITION BY residue)', 7)} AS x FROM dm"
)

SPREAD = "sd AS (SELECT residue, 1 - 0.1*stddev_pop(d) AS eps FROM di WHERE i <= j GROUP BY residue)"
REPLICATES = (
    f" SELECT residue, {rnd('avg(m)', 6)} AS s_mean, {rnd('sqrt(greatest(avg(m2) - avg(m)*avg(m), 0))', 5)} AS s_se"
    " FROM cm GROUP BY residue"
)


def keyed_draw(end: str) -> str:
    key = f"'{SEED}|' || CAST(key AS VARCHAR) || '|{end}'"
    return f"(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT)::DOUBLE / {float(16 ** 13)})"


ORACLE["eps_resampling"] = (
    f"{CLUSTERED}, {SPREAD}, kz AS (SELECT key, sqrt(-2*ln(1 - {keyed_draw('a')}))*cos(2*pi()*{keyed_draw('b')}) AS z"
    " FROM (SELECT unnest(range(100)) AS key)), "
    + clustering("SELECT key, residue, eps + z*(1 - eps)*(1 - eps) AS eps FROM kz, sd", 0.01)
    + f", {STATE_P}{REPLICATES}"
)
ORACLE["component_jackknife"] = (
    f"{CLUSTERED}, {SPREAD}, "
    "rt AS (SELECT a.residue, a.frame, a.comp AS key, sum(b.r) AS rest FROM rs a JOIN rs b"
    " ON b.residue = a.residue AND b.frame = a.frame AND b.comp <> a.comp GROUP BY a.residue, a.frame, a.comp), "
    "lf AS (SELECT a.residue, a.key, b.comp AS i, sum(CASE WHEN a.key <> b.comp AND rest > 0"
    " THEN b.r/rest ELSE 0 END)/(SELECT count(*) FROM embeddings) AS w FROM rt a JOIN rs b"
    " ON b.residue = a.residue AND b.frame = a.frame GROUP BY a.residue, a.key, b.comp), "
    + clustering("SELECT DISTINCT lf.key, lf.residue, eps FROM lf JOIN sd ON sd.residue = lf.residue", 0.01, "lf")
    + f", {STATE_P}{REPLICATES}"
)

# -- geometry ----------------------------------------------------------------------------------

POINTS = (
    f"g AS (SELECT unnest(range({POINT_COUNT})) AS pos), "
    "pts AS (SELECT vec_id AS frame, CAST(pos AS INTEGER) AS pos, "
    + ", ".join(f"embedding[(3*pos + {k}) % len(embedding) + 1]::DOUBLE AS {c}" for k, c in enumerate("xyz"))
    + " FROM embeddings, g)"
)


def sub(a: str, b: str) -> tuple[str, str, str]:
    return tuple(f"({a}_{k} - {b}_{k})" for k in "xyz")


def cross(u, v) -> tuple[str, str, str]:
    return (
        f"({u[1]}*{v[2]} - {u[2]}*{v[1]})", f"({u[2]}*{v[0]} - {u[0]}*{v[2]})",
        f"({u[0]}*{v[1]} - {u[1]}*{v[0]})",
    )


def dot(u, v) -> str:
    return "(" + " + ".join(f"{a}*{b}" for a, b in zip(u, v)) + ")"


def norm(u) -> str:
    return f"sqrt({dot(u, u)})"


def internals(source: str, name: str) -> str:
    """length, angle and dihedral of rows with points a, b, c, d"""
    u, v, w = sub("b", "a"), sub("c", "b"), sub("d", "c")
    n1, n2 = cross(u, v), cross(v, w)
    return (
        f"{name} AS (SELECT *, {norm(w)} AS length, atan2({norm(cross(v, w))}, {dot(v, w)} + 0.0) AS angle,"
        f" atan2({dot(u, n2)}*{norm(v)} + 0.0, {dot(n1, n2)} + 0.0) AS dihedral FROM {source})"
    )


_LAGS = ", ".join(
    f"lag({k}, {n}) OVER (PARTITION BY frame ORDER BY pos) AS {c}_{k}" for n, c in ((3, "a"), (2, "b"), (1, "c")) for k in "xyz"
)
QUADS = (
    f"qa AS (SELECT frame, pos, {_LAGS}, x AS d_x, y AS d_y, z AS d_z FROM pts), "
    f"qd AS (SELECT * FROM qa WHERE a_x IS NOT NULL), {internals('qd', 'ic')}"
)
ORACLE["chain_internal_coordinates"] = (
    f"WITH {POINTS}, {QUADS} SELECT frame, pos, {rnd('length', 7)} AS length, {rnd('angle', 7)} AS angle,"
    f" {rnd('dihedral', 7)} AS dihedral FROM ic"
)
ORACLE["placed_points"] = (
    f"WITH {POINTS} SELECT frame, pos, {rnd('x', 6)} AS x, {rnd('y', 6)} AS y, {rnd('z', 6)} AS z FROM pts WHERE pos >= 3"
)
ORACLE["rebuilt_chain_distances"] = (
    f"WITH {POINTS} SELECT b.frame, b.pos, {rnd('sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2) + pow(b.z-a.z,2))', 6)} AS distance"
    " FROM pts a JOIN pts b ON b.frame = a.frame AND b.pos = a.pos + 4"
)
ORACLE["strided_alpha_carbons"] = (
    f"WITH {POINTS} SELECT frame, pos // 5 AS residue, {rnd('x', 6)} AS x, {rnd('y', 6)} AS y, {rnd('z', 6)} AS z"
    " FROM pts WHERE pos % 5 = 1 AND frame % 5 = 0"
)
ORACLE["residue_numbers"] = (
    "WITH ch AS (SELECT n_regionkey AS chain, row_number() OVER (ORDER BY min(n_nationkey)) - 1 AS c FROM nation GROUP BY n_regionkey)"
    " SELECT n_nationkey AS resseq, n_regionkey AS chain,"
    " CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS residue,"
    " upper(left(n_name, 3)) || n_nationkey || '_' || chr(CAST(65 + c AS INTEGER)) AS label FROM nation JOIN ch ON chain = n_regionkey"
)
ORACLE["slot_coordinates"] = (
    f"WITH {POINTS} SELECT frame, pos // 5 AS residue, 'A' AS aa, pos % 5 AS slot, {rnd('x', 6)} AS x,"
    f" {rnd('y', 6)} AS y, {rnd('z', 6)} AS z FROM pts"
)


def _alanine() -> str:
    """Quads of the alanines; point numbers are residue * 5 + slot, -1 the origin."""
    rows = []
    for r in range(PEPTIDE_RESIDUES):
        at = lambda s, r=r: r * 5 + s
        before = [at(s) - 5 if r else -1 for s in range(3)]
        rows.append((r, 0, *before, at(0)))
        rows.append((r, 1, before[1], before[2], at(0), at(1)))
        rows.append((r, 2, before[2], at(0), at(1), at(2)))
        rows.append((r, 3, at(0), at(1), at(2), at(3)))
        if r:
            rows.append((r, 4, at(2) - 5, at(0), at(1), at(4)))
        else:
            rows.append((r, 4, at(0) + 5, at(2), at(1), at(4)))
    values = ", ".join(str(t) for t in rows)
    joins, cols = "", []
    for k in "abcd":
        joins += f" LEFT JOIN pts {k} ON {k}.frame = f.frame AND {k}.pos = t.p{k}"
        cols += [f"coalesce({k}.{c}, 0.0) AS {k}_{c}" for c in "xyz"]
    return (
        f"t(residue, slot, pa, pb, pc, pd) AS (VALUES {values}), "
        f"f AS (SELECT DISTINCT frame FROM pts), "
        f"aq AS (SELECT f.frame, t.residue, t.slot, {', '.join(cols)} FROM f JOIN t ON true{joins}), "
        f"{internals('aq', 'ai0')}, "
        "ai AS (SELECT frame, residue, slot, length, CASE WHEN residue = 0 AND slot = 0 THEN 1.0 ELSE angle END AS angle,"
        " dihedral FROM ai0)"
    )


PEPTIDE = f"WITH {POINTS}, {_alanine()}"
ORACLE["residue_internal_coordinates"] = (
    f"{PEPTIDE} SELECT frame, residue, slot, {rnd('length', 6)} AS length, {rnd('angle', 6)} AS angle,"
    f" {rnd('dihedral', 6)} AS dihedral FROM ai"
)
ORACLE["angle_features"] = (
    f"{PEPTIDE}, mv AS (SELECT frame, CASE WHEN slot = 0 THEN (residue + {PEPTIDE_RESIDUES - 1}) % {PEPTIDE_RESIDUES} ELSE residue END AS residue, slot, angle, dihedral FROM ai), "
    f"fx AS (SELECT unnest(range(28)) AS feature), rx AS (SELECT unnest(range({PEPTIDE_RESIDUES})) AS residue) "
    "SELECT CAST(rx.residue AS INTEGER) AS residue, f.frame, CAST(feature AS INTEGER) AS feature, "
    + rnd("coalesce(CASE WHEN feature < 14 THEN mv.angle ELSE mv.dihedral END, 0.0)", 6)
    + " AS x FROM f JOIN rx ON true JOIN fx ON true LEFT JOIN mv ON mv.frame = f.frame AND mv.residue = rx.residue AND mv.slot = feature % 14"
)
ORACLE["folded_frames"] = (
    f"WITH {POINTS} SELECT a.frame, a.pos // 5 AS residue, a.pos % 5 AS slot,"
    f" {rnd('sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2) + pow(b.z-a.z,2))', 6)} AS distance"
    " FROM pts a JOIN pts b ON b.frame = a.frame AND b.pos = a.pos // 5 * 5 + 1"
)
ORACLE["mean_bond_lengths"] = (
    f"{PEPTIDE} SELECT residue, slot, count(*) AS n, {rnd('avg(length)', 6)} AS length FROM ai GROUP BY residue, slot"
)
_E1, _V2 = sub("c", "b"), sub("b", "a")
_E3 = cross(_E1, _V2)
_E2 = cross(_E3, _E1)
_P = ("(x - a_x)", "(y - a_y)", "(z - a_z)")
# The reference frame of (0,0,0), (0,1,0), (1,1,0) has the axes x, y and z.
ORACLE["rigid_alignment"] = (
    f"WITH {POINTS}, " + "fr AS (SELECT frame, " + ", ".join(
        f"max(CASE WHEN pos = {i} THEN {k} END) AS {c}_{k}" for i, c in enumerate("abc") for k in "xyz"
    ) + " FROM pts GROUP BY frame) SELECT frame, pos, "
    + ", ".join(
        f"{rnd(f'{dot(_P, e)}/{norm(e)}', 6)} AS {k}"
        for k, e in (("x", _E1), ("y", _E2), ("z", _E3))
    ) + " FROM pts JOIN fr USING (frame)"
)

# -- drawing -----------------------------------------------------------------------------------

DRAWN = (
    "parts AS (SELECT unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), "
    "pv(var, id) AS (VALUES " + ", ".join(f"('{v}', {i + 1})" for i, v in enumerate(VARIABLES)) + "), "
    "em_p AS (SELECT var, id, " + ", ".join(
        f"(SELECT sum(e) / (SELECT count(*) FROM embeddings) FROM parts WHERE i % {3 * len(VARIABLES)} = 3*(id - 1) + {j}) AS {k}"
        for j, k in enumerate("xyz")
    ) + " FROM pv)"
)
ORACLE["drawing_nodes"] = items(
    HALDANE, DRAWN,
    select=f"SELECT id, var, {rnd('m', 8)} AS entropy, {rnd('exp(-m)', 8)} AS bfactor, {rnd('cbrt(m)', 8)} AS vdw"
    " FROM em_p JOIN nm USING (var)",
)
_ANCHORS = ((0.96, 0.94, 0.78), (0.82, 0.70, 0.40), (0.55, 0.38, 0.24), (0.20, 0.12, 0.10))
_T = "(3*least(greatest(i_pm/0.002, 0), 1))"


def _channel(k: int) -> str:
    parts = [
        f"WHEN {_T} <= {j + 1} THEN {_ANCHORS[j][k]} + ({_ANCHORS[j + 1][k]} - {_ANCHORS[j][k]})*({_T} - {j})" for j in range(3)
    ]
    return "CASE " + " ".join(parts) + " END"


ORACLE["drawing_edges"] = items(
    MST, HALDANE, TREE, DRAWN,
    "dd AS (SELECT a.id AS u_id, b.id AS v_id, i_pm, sqrt(pow(a.x-b.x,2) + pow(a.y-b.y,2) + pow(a.z-b.z,2)) AS d"
    " FROM tree JOIN em_p a ON a.var = u JOIN em_p b ON b.var = v)",
    select=f"SELECT u_id, v_id, {rnd('i_pm', 8)} AS mi,"
    + rnd("greatest(CASE WHEN i_pm > 0.0003 THEN sqrt(i_pm/(pi()*0.1*d)) ELSE 0 END, 0.02)", 7) + " AS radius, "
    + ", ".join(f"{rnd(_channel(k), 6)} AS {c}" for k, c in enumerate("rgb")) + " FROM dd",
)
