"""What the query modules share: the registry, the stand-in matrix, and parts of SQL.

The stand-in matrix is orders joined with customers: features c_acctbal / 1000 and a constant,
target o_totalprice / 100000, key o_orderkey. Floats are rounded so that both sides agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privspan.functions.special import ERF_P, ERF_Q, ERFC_P, ERFC_Q, SQRT_PI, TAIL_P, TAIL_Q
from privspan.operators import linear, rng
from privspan.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FEATURES, TARGET, KEY = ["x1", "x2"], "y", "row_id"
ALL = [*FEATURES, TARGET]
TEST_KEY = "test-key"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def matrix(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(F.col("o_orderkey").alias(KEY), (F.col("c_acctbal") / 1000).alias("x1"), F.lit(1.0).alias("x2"), (F.col("o_totalprice") / 100000).alias("y"))


def fitted(spark: SparkSession, d: str) -> tuple[DataFrame, linear.Fit]:
    m = matrix(spark, d)
    return m, linear.fit(m, FEATURES, TARGET)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    # Adding zero turns a rounded minus zero into zero.
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


M = """m AS (SELECT o_orderkey AS row_id, c_acctbal / 1000 AS x1, 1.0::DOUBLE AS x2, o_totalprice / 100000 AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
FIT = f"""{M},
g AS (SELECT count(*) AS n, sum(x1*x1) AS g11, sum(x1*x2) AS g12, sum(x2*x2) AS g22, sum(x1*y) AS h1, sum(x2*y) AS h2, sum(y*y) AS yy FROM m),
s AS (SELECT *, g11*g22-g12*g12 AS det, (g22*h1-g12*h2)/(g11*g22-g12*g12) AS b1, (g11*h2-g12*h1)/(g11*g22-g12*g12) AS b2,
  g22/(g11*g22-g12*g12) AS i11, -g12/(g11*g22-g12*g12) AS i12, g11/(g11*g22-g12*g12) AS i22 FROM g),
rw AS (SELECT row_id, x1, x2, y, y-b1*x1-b2*x2 AS w, x1*x1*i11+2*x1*x2*i12+x2*x2*i22 AS p, b1, b2, i11, i12, i22, n FROM m, s),
rs AS (SELECT sum(w*w) AS rss FROM rw),
r AS (SELECT rw.*, rss, p + w*w/rss AS q FROM rw, rs)"""


def erf_sql(x: str) -> str:
    """erf by its series of positive terms, summed from the inside; 1 in size beyond 6."""
    series = f"list_reduce(list_transform(range(150, 0, -1), lambda k: (2*k+1)::DOUBLE), lambda acc, k: 1.0::DOUBLE + 2*({x})*({x})/k*acc, 1.0::DOUBLE)"
    return f"(CASE WHEN abs({x}) > 6 THEN sign({x})::DOUBLE ELSE 1.1283791670955126*({x})*exp(-({x})*({x}))*{series} END)"


def phi_sql(x: str) -> str:
    return f"(0.5*(1+{erf_sql(f'({x})/1.4142135623730951')}))"


def q_sql(n: int, x: str) -> str:
    """Q(n, x) for whole n."""
    return f"(exp(-({x}))*list_reduce(list_transform(range({n - 1}, 0, -1), lambda k: k::DOUBLE), lambda acc, k: 1.0::DOUBLE + ({x})/k*acc, 1.0::DOUBLE))" if n > 1 else f"exp(-({x}))"


def u_sql(stream: str, *counters: str, key: str = TEST_KEY) -> str:
    name = " || '|' || ".join([f"'{key}|{stream}'", *[f"({c})::VARCHAR" for c in counters]])
    return f"((('0x' || substr(md5({name}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def z_sql(stream: str, *counters: str, key: str = TEST_KEY) -> str:
    return f"(sqrt(-2*ln({u_sql(stream + '.u', *counters, key=key)}))*cos({u_sql(stream + '.v', *counters, key=key)}*2*pi()))"


def scalars(spark, d, values: dict[str, float], digits: int) -> DataFrame:
    """One row of numbers found from the table, kept with its row count."""
    return rounded(matrix(spark, d).agg(F.count("*").alias("n"), *[F.max(F.lit(float(v))).alias(k) for k, v in values.items()]), digits, *values)




def erfc_sql(x: str) -> str:
    """erfc of a name x >= 0 by rational approximations: its relative error stays small in the tail."""
    poly = lambda cs, v: "(" + "(" * (len(cs) - 1) + f"{cs[0]!r}::DOUBLE" + "".join(f")*({v})+{c!r}::DOUBLE" for c in cs[1:]) + ")"
    z = f"1/({x}*{x})"
    inner = f"1-{x}*{poly(ERF_P, f'{x}*{x}')}/{poly(ERF_Q, f'{x}*{x}')}"
    middle = f"exp(-{x}*{x})*{poly(ERFC_P, x)}/{poly(ERFC_Q, x)}"
    tail = f"exp(-{x}*{x})/{x}*({1 / SQRT_PI!r}-({z})*{poly(TAIL_P, z)}/{poly(TAIL_Q, z)})"
    return f"(CASE WHEN {x} <= 0.46875 THEN {inner} WHEN {x} <= 4 THEN {middle} WHEN {x} < 27 THEN {tail} ELSE 0 END)"


# Calibration: bisection by recursion.


def bisect_sql(name: str, derive: str, target: str, low: float, high: str | float, tol: float, increasing: bool = True, carry: str = "", source: str = "") -> str:
    """A recursive CTE for calibrate's bisect. derive: select items over mid (and carried columns) that end in `val`."""
    steps = 0
    width = (float(high) if not isinstance(high, str) else 100.0) - low
    while width > tol:
        width, steps = width / 2, steps + 1
    keep = f"{carry}, " if carry else ""
    go = f"(val < {target}) = {str(increasing).upper()}"
    return f"""{name}_steps AS (SELECT {keep}{low!r}::DOUBLE AS lo, ({high})::DOUBLE AS hi, 0 AS step {source} UNION ALL
  SELECT {keep}CASE WHEN go THEN mid ELSE lo END, CASE WHEN go THEN hi ELSE mid END, step + 1
  FROM (SELECT *, {go} AS go FROM (SELECT *, (lo+hi)/2 AS mid, {derive} FROM {name}_steps WHERE step < {steps}))),
{name} AS (SELECT {keep}(lo+hi)/2 AS found FROM {name}_steps WHERE step = {steps})"""


def projection_sql(p: str, eps: float | str, r: int, name: str = "val", tag: str = "") -> str:
    """Select items that end in the spectrum of r (even) projections at leverage p."""
    t = f"t{tag}"
    return f"1/(1-({p})) AS rho{tag}, 2*({eps}+ln(rho{tag})*{r // 2})/(rho{tag}-1) AS {t}, {q_sql(r // 2, f'({t}/2)')}-exp({eps})*{q_sql(r // 2, f'(rho{tag}*{t}/2)')} AS {name}"


# Quadrature.


def kernel_sql(p: str, q: str, d: int, r: str | float, eps: str | float, right: bool) -> tuple[str, str, str, str]:
    """lambda1, lambda2, lambda3 and c of the least-squares spectrum, as numeric.left_kernel and right_kernel."""
    s = f"({q}-{p})"
    if right:
        return f"(2*{p}-{p}*{p}-{q})/(1-{q})", f"-{s}/(1-{q})", f"sqrt({r}*{p}*{s})*(1-{p})/(1-{q})", f"{eps}+{(d + 1) / 2}*ln(1-{p})-{d / 2}*ln(1-{q})-{r}*{p}/2*{s}/(1-{q})"
    return f"({q}-2*{p}+{p}*{p})/((1-{p})*(1-{p}))", f"{s}/(1-{p})", f"-sqrt({r}*{p}*{s})*sqrt(1-{q})/((1-{p})*(1-{p}))", f"{eps}+{d / 2}*ln(1-{q})-{(d + 1) / 2}*ln(1-{p})-{r}*{p}/2*{s}/((1-{p})*(1-{p}))"


def nodes_sql(nodes: int = 32) -> str:
    x, w = np.polynomial.legendre.leggauss(nodes)
    return "nodes AS (SELECT * FROM (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in zip(x.tolist(), w.tolist())) + ") t(nx, nw))"


def spectrum_sql(d: int, right: bool, r: str, eps: str, source: str, keys: str, value: str) -> str:
    """CTEs that end in {value}_d (keys, value): the spectrum of each row of source (keys, p, q) over explicit nodes; d = 2 or 3."""
    l1, l2, l3, c = kernel_sql("p", "q", d, r, eps, right)
    nu = (d - 1) / 2
    tails = ("exp(-z)", "exp(-(1-l2)*z)") if d == 3 else (erfc_sql("y1"), erfc_sql("y2"))
    grown = f"exp(least(a,700)-{nu}*ln(1-l2))"
    f = f"(q1-CASE WHEN q2 > 0 THEN {grown}*q2 ELSE 0 END)" if right else f"CASE WHEN a < 0 THEN (1-q1)-{grown}*(1-q2) ELSE 0 END"
    n = f"{value}_"
    return f"""{n}c AS (SELECT {keys}, {l1} AS l1, {l2} AS l2, {l3} AS l3, {c} AS c, l3*l3-2*l1*c AS disc, sqrt(greatest(disc,0)) AS root,
  CASE WHEN disc < 0 THEN 12 ELSE least(12, greatest(-12, (l3-root)/l1)) END AS e1, CASE WHEN disc < 0 THEN 12 ELSE least(12, greatest(-12, (l3+root)/l1)) END AS e2 FROM {source}),
{n}b AS (SELECT *, unnest([[-12::DOUBLE, least(e1,e2)], [least(e1,e2), greatest(e1,e2)], [greatest(e1,e2), 12::DOUBLE]]) AS pc FROM {n}c),
{n}h AS (SELECT *, pc[1] + (i+0.5)*(pc[2]-pc[1])/8 AS md, (pc[2]-pc[1])/16 AS half FROM {n}b, range(0,8) t(i) WHERE pc[2] > pc[1]),
{n}n AS (SELECT *, md+half*nx AS x, c+l1*x*x/2-l3*x AS a, greatest(0, -a/l2) AS z, sqrt(z) AS y1, sqrt((1-l2)*z) AS y2, {tails[0]} AS q1, {tails[1]} AS q2 FROM {n}h, nodes),
{n}d AS (SELECT {keys}, least(1, greatest(0, sum(nw*half*exp(-x*x/2)/sqrt(2*pi())*({f})))) AS {value} FROM {n}n GROUP BY {keys})"""


def noise_sql(name: str, p: str, q: str, r: int, eps: str, delta: str, low: float, high: float, bits: list[int], both: bool, source: str = "(SELECT 1 AS one)") -> str:
    """CTEs that end in {name} (found): calibrate's bisection of a noise level over least-squares spectra with d = 2.

    The spectrum falls with the noise, so each level compares 2^bits points at once. p and q are of
    mid, of columns of the one row of source, and q of p.
    """
    out, last, width = [], f"{name}_0 AS (SELECT {low!r}::DOUBLE AS lo FROM {source})", f"{high - low!r}::DOUBLE"
    out.append(last)
    for level, n in enumerate(bits):
        g, cells = f"{name}_g{level}", 1 << n
        out.append(f"{g} AS (SELECT *, {p} AS p, {q} AS q FROM (SELECT *, lo+({width})*k/{cells} AS mid FROM {name}_{level}, range(1,{cells}) t(k), {source}))")
        sides = [(False, f"{name}l{level}"), *([(True, f"{name}r{level}")] if both else [])]
        out += [spectrum_sql(2, side, str(r), eps, g, "k, lo", v) for side, v in sides]
        worst = f"greatest({sides[0][1]}, {sides[1][1]})" if both else sides[0][1]
        joined = f"{sides[0][1]}_d" + (f" JOIN {sides[1][1]}_d USING (k, lo)" if both else "")
        out.append(f"{name}_{level + 1} AS (SELECT max(lo)+({width})/{cells}*count(*) FILTER (WHERE NOT {worst} < {delta}) AS lo FROM {joined})")
        width = f"{width}/{cells}"
    out.append(f"{name} AS (SELECT lo+({width})/2 AS found FROM {name}_{len(bits)})")
    return ",\n".join(out)


# Samplers: keyed draws that DuckDB repeats.


def mix_sql(start: str, *words: str, name: str) -> str:
    """Select items that end in `name`: rng.mix32 of start, then of each word put in by exclusive or."""
    items, now = [], start
    for i, word in enumerate([None, *words]):
        x = now if word is None else f"xor({now}, ({word})::UBIGINT)"
        p = f"{name}_{i}"
        items += [f"{x} AS {p}a", f"xor({p}a, {p}a >> 16)*2146121005 & 4294967295 AS {p}b", f"xor({p}b, {p}b >> 15)*2221713035 & 4294967295 AS {p}c", f"xor({p}c, {p}c >> 16) AS {p}d"]
        now = f"{p}d"
    return ", ".join([*items, f"{now} AS {name}"])


def grid_sql(draws: int, r: int, key: str, table: str = "m", row: str = "row_id", stream: str = "row", tag: str = "") -> str:
    """CTEs that end in el{tag}: rows of the table with draw, k and g, the normal of rng.grid_normals."""
    u, v, a, b = (f"{w}::UBIGINT" for w in rng.words(key, stream))
    word = lambda x, shift: f"(({x})::BIGINT >> {shift}) & 4294967295"
    return f"""hr{tag} AS (SELECT *, {mix_sql(u, word(row, 0), word(row, 32), name='h1')}, {mix_sql(v, word(row, 0), word(row, 32), name='h2')} FROM {table}),
hc{tag} AS (SELECT draw, k, {mix_sql(a, 'draw', 'k', name='d1')}, {mix_sql(b, 'draw', 'k', name='d2')} FROM range(0,{draws}) a(draw), range(0,{r}) b(k)),
el{tag} AS (SELECT hr{tag}.* EXCLUDE (h1, h2), draw, k, {normal_sql('h1', 'h2', 'd1', 'd2')} AS g FROM hr{tag}, hc{tag})"""


def normal_sql(h1: str, h2: str, d1: str, d2: str) -> str:
    """Select items that end in rng.grid_normals of the words of a row and of a pair of draw and k; the caller names the last."""
    items = f"xor({h1}, {d1}) AS ca, xor({h2}, {d2}) AS cb, {mix_sql('ca', 'cb', name='f1')}, {mix_sql(f'xor(cb, {rng.ANGLE}::UBIGINT)', 'ca', name='f2')}"
    return f"{items}, sqrt(-2*ln(((f1*1048576+(f1_0d & 1048575))::DOUBLE+0.5)/4503599627370496.0::DOUBLE))*cos((f2::DOUBLE+0.5)/4294967296*2*pi())"


def project_sql(r: int, draws: int, noise: float | str = 0.0, key: str = TEST_KEY, table: str = "m", columns=("x1", "x2", "y"), row: str = "row_id", tag: str = "") -> str:
    """CTEs that end in pr{tag}: mechanisms.project. noise is a number or a scalar subquery."""
    add = lambda j: f" + {noise}*max({z_sql('noise', 'draw', 'k', str(j), key=key)})" if noise else ""
    sums = ", ".join(f"sum(g*{c}){add(j)} AS {c}" for j, c in enumerate(columns))
    return f"{grid_sql(draws, r, key, table, row, tag=tag)}, pr{tag} AS (SELECT draw, k, {sums} FROM el{tag} GROUP BY draw, k)"


def rounded_projection(sketch: DataFrame) -> DataFrame:
    return rounded(sketch.select("draw", "k", *ALL), 6, *ALL)


PR = "SELECT draw::INT AS draw, k::INT AS k, round(x1, 6) + 0 AS x1, round(x2, 6) + 0 AS x2, round(y, 6) + 0 AS y FROM pr"


SK = "sg AS (SELECT draw, sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x2*x2) AS c, sum(x1*y) AS u, sum(x2*y) AS v FROM pr GROUP BY draw)"


def draws_sql(r: int, draws: int, sigma: str = "0", rho: float = 0.0, source: str = "g") -> str:
    """CTEs that end in dr (draw, beta_0, beta_1): mechanisms.asymptotic_least_squares over the sums in `source`."""
    z = ", ".join(f"{z_sql('beta', 'id', str(j))} AS z{j}" for j in range(2))
    return f"""sd AS (SELECT ({sigma})::DOUBLE AS sd), re AS (SELECT g11+sd*sd AS a, g12 AS b, g22+sd*sd AS c, h1, h2, yy+sd*sd+{rho * rho} AS e, a*c-b*b AS det,
  (c*h1-b*h2)/det AS b1, (a*h2-b*h1)/det AS b2, e-h1*b1-h2*b2 AS rest, rest/{r}*c/det AS c11, -rest/{r}*b/det AS c12, rest/{r}*a/det AS c22 FROM {source}, sd),
zs AS (SELECT id, {z} FROM range(0,{draws}) t(id)),
dr AS (SELECT id AS draw, b1+sqrt(c11)*z0 AS beta_0, b2+c12/sqrt(c11)*z0+sqrt(c22-c12*c12/c11)*z1 AS beta_1 FROM zs, re)"""


def boot_sql(source: str, confidence: float, resamples: int, name: str = "bb", tag: str = "") -> str:
    """CTEs, one of them recursive, that end in {name} (four bounds) of accuracy.bootstrap_bounds over source (i from 0, v)."""
    at = lambda q, f: f"ms[{f}(round({q}*{resamples - 1}, 9))::INT+1]"
    alpha = 1 - confidence
    a, b = (f"{w}::UBIGINT" for w in rng.words(TEST_KEY, "boot")[:2])
    # Word by word in selects of their own, as an alias that is used twice is planned twice.
    node = f"(SELECT *, {mix_sql(a, 'rep', name='wa0')}, {mix_sql(b, 'rep', name='wb0')} FROM {name}t WHERE size > 1)"
    for i, word in enumerate(["level", "lo & 4294967295", "lo >> 32"]):
        both = ", ".join(mix_sql(f"xor({w}{i}, ({word})::UBIGINT)", name=f"{w}{i + 1}") for w in ("wa", "wb"))
        node = f"(SELECT *, {both} FROM {node})"
    # The number of k whose distribution function is below u, as resampling.binomial.
    wide = "(12*sqrt(m*p*(1-p))+12)"
    return f"""{name}n AS (SELECT count(*) AS n, avg(v) AS mid FROM {source}),
{name}t AS (SELECT rep, 0::BIGINT AS lo, n AS size, n AS m, 0::BIGINT AS level FROM {name}n, range(0,{resamples}) a(rep) UNION ALL
  SELECT rep, CASE WHEN side = 0 THEN lo ELSE lo+size//2 END, CASE WHEN side = 0 THEN size//2 ELSE size-size//2 END, CASE WHEN side = 0 THEN ml ELSE m-ml END, level+1
  FROM (SELECT rep, lo, size, m, level, least(m, min(k)+count(*) FILTER (WHERE cdf < u)) AS ml
    FROM (SELECT *, sum(q) OVER (PARTITION BY rep, lo ORDER BY k) AS cdf
      FROM (SELECT *, exp(lgamma(m+1)-lgamma(k+1)-lgamma(m-k+1)+k*ln(p)+(m-k)*ln(1-p)) AS q
        FROM (SELECT *, unnest(range(greatest(0, floor(m*p-{wide})::BIGINT), least(m, ceil(m*p+{wide})::BIGINT)+1)) AS k
          FROM (SELECT rep, lo, size, m, level, (size//2)/size::DOUBLE AS p, ((wa3*1048576+(wb3 & 1048575))::DOUBLE+0.5)/4503599627370496.0::DOUBLE AS u FROM {node}))))
    GROUP BY rep, lo, size, m, level), range(0,2) s(side)),
{name}s AS (SELECT list(m ORDER BY m) AS ms FROM (SELECT rep, sum(t.m*v)/sum(t.m) AS m FROM {name}t t JOIN {source} x ON t.lo = x.i WHERE t.size = 1 GROUP BY rep)),
{name} AS (SELECT 2*mid-{at(confidence, 'ceil')} AS lb_one_sided, 2*mid-{at(1 - alpha / 2, 'ceil')} AS lb_two_sided,
  2*mid-{at(alpha, 'floor')} AS ub_one_sided, 2*mid-{at(alpha / 2, 'floor')} AS ub_two_sided FROM {name}s, {name}n)"""


BOUNDS = ["lb_one_sided", "lb_two_sided", "ub_one_sided", "ub_two_sided"]
BOUNDS_SQL = ", ".join(f"round({b}, 6) + 0 AS {b}" for b in BOUNDS)
