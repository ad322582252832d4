"""Registered queries and their SQL: composed releases, and neighbours that differ by a set of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from privspan.operators import composition, row_sets
from privspan.sources.tables import table

from .registry import M, nodes_sql, phi_sql, q_sql, query, rounded

# Every customer of a nation releases once; the noise grows with the number of customers, the sensitivity with a name's length.

_GRID = composition.Grid(512, 7.0)
_EPS = [0.1, 0.5, 1.0]
_STEP, _HALF = repr(_GRID.step), _GRID.size // 2


def _normal_between(low: str, high: str) -> str:
    return f"(CASE WHEN {low} > 0 THEN {phi_sql(f'-({low})')}-{phi_sql(f'-({high})')} ELSE {phi_sql(high)}-{phi_sql(low)} END)"


def _wave(f: str, j: str) -> str:
    return f"2*pi()*(({f}*({j}-{_HALF})) % {_GRID.size})/{_GRID.size}"


_MOMENTS = ", ".join(f"sum(rep*ln(greatest({{m}}{i}, 1e-300))) AS m{i}" for i in range(len(composition.POWERS)))
_SUMS = ", ".join(f"sum(ab*exp({k}*x)) AS u{i}, sum(be*exp(-{k}*x)) AS d{i}" for i, k in enumerate(composition.POWERS))
_BEYOND = "exp(least(0, " + ", ".join(f"m{i}-{k * _GRID.reach}" for i, k in enumerate(composition.POWERS)) + "))"

_COMPOSED = f"""WITH cn AS (SELECT c_nationkey AS nation, count(*) AS nn FROM customer GROUP BY 1),
rl AS (SELECT nation, mu, count(*) AS rep FROM (SELECT c_nationkey AS nation, length(c_mktsegment)/(9*sqrt(nn)) AS mu FROM customer JOIN cn ON c_nationkey = nation) GROUP BY 1, 2),
gr AS (SELECT j, (j-{_HALF})*{_STEP}::DOUBLE AS x FROM range(0,{_GRID.size}) t(j)),
zz AS (SELECT *, (x-mu*mu/2)/mu AS pa, (x+{_STEP}-mu*mu/2)/mu AS pb, (x+mu*mu/2)/mu AS qa, (x+{_STEP}+mu*mu/2)/mu AS qb FROM rl, gr),
ce AS (SELECT nation, mu, rep, j, x, pa, CASE WHEN j < {_GRID.size - 1} THEN {_normal_between('pa', 'pb')} END AS p, CASE WHEN j < {_GRID.size - 1} THEN {_normal_between('qa', 'qb')} END AS q FROM zz),
sp AS (SELECT *, least(p, greatest(0, (p-q*exp(x))/(1-exp(-{_STEP}::DOUBLE)))) AS rt, p-rt AS lt, CASE WHEN p > 0 THEN (1-exp(-{_STEP}::DOUBLE))*lt*rt/(lt+rt*exp(-{_STEP}::DOUBLE)) WHEN p <= 0 THEN 0 END AS ov FROM ce),
bs AS (SELECT *, coalesce(lt, 0)+coalesce(lag(rt) OVER w, 0) AS base, greatest(coalesce(ov, lag(ov) OVER w), coalesce(lag(ov) OVER w, ov)) AS most FROM sp WINDOW w AS (PARTITION BY nation, mu ORDER BY j)),
sl AS (SELECT *, lead(most) OVER w-most AS s FROM bs WINDOW w AS (PARTITION BY nation, mu ORDER BY j)),
ms AS (SELECT nation, mu, rep, j, x, pa, most, base+CASE WHEN j = 0 THEN {phi_sql('pa')} ELSE 0 END AS ab, base-coalesce(s, 0)/(exp({_STEP}::DOUBLE)-1)+coalesce(lag(s) OVER w, 0)/(1-exp(-{_STEP}::DOUBLE)) AS raw, greatest(raw, 0) AS be
  FROM sl WINDOW w AS (PARTITION BY nation, mu ORDER BY j)),
lo AS (SELECT nation, mu, rep, sum(greatest(-raw, 0))+max(most) FILTER (j = {_GRID.size - 1}) AS given, {phi_sql(f'-(max(pa))')} AS endless, {_SUMS} FROM ms GROUP BY nation, mu, rep),
sk AS (SELECT nation, 0 AS side, sum(rep*given) AS lost, {_MOMENTS.format(m='d')}, sum(rep) AS n FROM lo GROUP BY nation UNION ALL SELECT nation, 1, sum(rep*endless), {_MOMENTS.format(m='u')}, sum(rep) FROM lo GROUP BY nation),
fr AS (SELECT f, j, cos({_wave('f', 'j')}) AS co, -sin({_wave('f', 'j')}) AS si FROM range(0,{_HALF + 1}) a(f), range(0,{_GRID.size}) b(j)),
tr AS (SELECT nation, mu, rep, f, sum(ab*co) AS ur, sum(ab*si) AS ui, sum(be*co) AS dr, sum(be*si) AS di FROM ms JOIN fr USING (j) GROUP BY nation, mu, rep, f),
st AS (SELECT nation, f, 1 AS side, sum(rep*ln(greatest(sqrt(ur*ur+ui*ui), 1e-300))) AS l, sum(rep*atan2(ui, ur)) AS a FROM tr GROUP BY nation, f
  UNION ALL SELECT nation, f, 0, sum(rep*ln(greatest(sqrt(dr*dr+di*di), 1e-300))), sum(rep*atan2(di, dr)) FROM tr GROUP BY nation, f),
wt AS (SELECT eps, f, sum((1-exp(least(eps-x, 0)))*co)*CASE WHEN f IN (0, {_HALF}) THEN 1 ELSE 2 END/{_GRID.size} AS wr, sum((1-exp(least(eps-x, 0)))*si)*CASE WHEN f IN (0, {_HALF}) THEN 1 ELSE 2 END/{_GRID.size} AS wi
  FROM gr JOIN fr USING (j), (VALUES {', '.join(f'({e}::DOUBLE)' for e in _EPS)}) t(eps) GROUP BY eps, f),
dl AS (SELECT nation, side, eps, sum(exp(least(l, 300))*(cos(a)*wr+sin(a)*wi)) AS d FROM st JOIN wt USING (f) GROUP BY nation, side, eps),
en AS (SELECT nation, eps, side, n, lost+{_BEYOND} AS slack, d FROM dl JOIN sk USING (nation, side))
SELECT nation, eps, round(max(least(1, greatest(0, d-slack))) FILTER (side = 0), 7) + 0 AS low, round(max(least(1, greatest(0, d+slack))) FILTER (side = 1), 7) + 0 AS high, max(n)::BIGINT AS n FROM en GROUP BY nation, eps"""


def _releases(spark, d):
    c = table(spark, d, "customer")
    sizes = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("nn"))
    mu = F.length("c_mktsegment") / (9 * F.sqrt("nn"))
    return c.join(sizes, c.c_nationkey == sizes.nation).select("nation", mu.alias("mu"))


@query(_COMPOSED)
def composed_releases(spark, d):
    """Bounds of delta of all releases of each nation together, over a coarse grid that SQL can fold too."""
    out = composition.enclosure(composition.state(_releases(spark, d), "nation", "mu", _GRID), _GRID, _EPS)
    return rounded(out, 7, "low", "high")


# All orders of a customer are a set. With two columns the two shares are the roots of a quadratic; a tail of two weighted chi
# squares is an integral over the one of the smaller weight.

_TAIL = f"""CASE WHEN t <= 0 THEN 1 WHEN w1 = 0 THEN 0 ELSE {q_sql(5, 'most/2')} END"""


@query(f"""WITH {M.replace('SELECT o_orderkey', 'SELECT o_custkey, o_orderkey')}, {nodes_sql()},
a AS (SELECT sum(x1*x1)+1 AS g11, sum(x1*y) AS g12, sum(y*y)+1 AS g22, g11*g22-g12*g12 AS det FROM m),
s AS (SELECT o_custkey AS custkey, count(*) AS n, sum(x1*x1) AS s11, sum(x1*y) AS s12, sum(y*y) AS s22 FROM m GROUP BY 1),
k AS (SELECT custkey, n, (g22*s11-2*g12*s12+g11*s22)/det AS tr, greatest(0, s11*s22-s12*s12)/det AS dt, tr/2+sqrt(greatest(0, tr*tr/4-dt)) AS k1, CASE WHEN k1 > 0 THEN dt/k1 ELSE 0 END AS k2, -5*(ln(1-k1)+ln(1-k2)) AS shift FROM s, a),
v AS (SELECT custkey, unnest([0, 1, 2, 3]) AS tail FROM k),
w AS (SELECT custkey, tail, CASE WHEN tail < 2 THEN 0.01 ELSE -0.01 END::DOUBLE+shift AS t, CASE WHEN tail%2 = 0 THEN k1/(1-k1)/2 ELSE k1/2 END AS w1, CASE WHEN tail%2 = 0 THEN k2/(1-k2)/2 ELSE k2/2 END AS w2,
  CASE WHEN w2*100 <= t THEN 100 ELSE greatest(t, 0)/w2 END AS most FROM k JOIN v USING (custkey)),
p AS (SELECT custkey, tail, t, w1, w2, most, (i+0.5+nx/2)*most/8 AS x, nw*most/16 AS part FROM w, nodes, range(0,8) r(i)),
u AS (SELECT custkey, tail, {_TAIL}+sum(CASE WHEN t > 0 AND w1 > 0 THEN part*pow(x, 4)*exp(-x/2)/768*{q_sql(5, '(greatest(t-w2*x, 0)/(2*w1))')} ELSE 0 END) AS p FROM p GROUP BY custkey, tail, t, w1, most),
d AS (SELECT custkey, max(p) FILTER (tail = 0) AS p0, max(p) FILTER (tail = 1) AS p1, max(p) FILTER (tail = 2) AS p2, max(p) FILTER (tail = 3) AS p3 FROM u GROUP BY custkey)
SELECT custkey, n, round(k1, 10) AS share, round(-ln(1-k1)-ln(1-k2), 10) AS log_det, round(least(1, greatest(0, p0-exp(0.01::DOUBLE)*p1)), 8) + 0 AS delta, round(least(1, greatest(0, (1-p3)-exp(0.01::DOUBLE)*(1-p2))), 8) + 0 AS back FROM k JOIN d USING (custkey)""")
def rp_spectrum_row_sets(spark, d):
    """Ten projections of two columns, without all orders of any customer, both directions; one is added to both diagonals."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    rows = joined.select(F.col("o_custkey").alias("custkey"), (F.col("c_acctbal") / 1000).alias("x1"), (F.col("o_totalprice") / 100000).alias("y"))
    out = row_sets.set_spectra(rows, "custkey", ["x1", "y"], 10, 0.01, 1.0, 1.0)
    return rounded(out.select("custkey", "n", F.round(F.col("shares")[0], 10).alias("share"), F.round("log_det", 10).alias("log_det"), "delta", "back"), 8, "delta", "back")
