"""Registered queries and their SQL: calibration, private projections and least squares, spectra over grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from privspan.operators import accuracy, asymptotic, calibrate, linear, mechanisms, quadrature, relational, rng, spectra
from privspan.sources.tables import table

from .registry import (
    ALL, BOUNDS, BOUNDS_SQL, FEATURES, FIT, KEY, PR, SK, TARGET, TEST_KEY, M, bisect_sql, boot_sql, draws_sql, fitted, matrix, nodes_sql, phi_sql, project_sql, projection_sql, q_sql, query,
    noise_sql, rounded, rounded_projection, spectrum_sql, u_sql, z_sql,
)

# Noise levels.


def _gauss_sql(eps: str, c: str, name: str = "val") -> str:
    return f"greatest(0, {phi_sql(f'{c}/2-({eps})/{c}')}-exp({eps})*{phi_sql(f'-{c}/2-({eps})/{c}')}) AS {name}"


@query(f"""WITH RECURSIVE src AS (SELECT n_nationkey, 0.1::DOUBLE + n_nationkey/10.0::DOUBLE AS eps, 1/(1000::DOUBLE*count(*)) AS delta FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
{bisect_sql('c', _gauss_sql('eps', 'mid'), 'delta', 1e-6, 100.0, 100.0 / 2**39.5, carry='n_nationkey, eps, delta', source='FROM src')} SELECT n_nationkey, round(found, 9) AS c FROM c""")
def minimal_c_rows(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", (0.1 + F.col("n_nationkey") / 10).alias("eps"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((1 / (1000 * F.count("*"))).alias("delta"))
    return rounded(n.join(c, "n_nationkey").select("n_nationkey", spectra.minimal_c("eps", "delta").alias("c")), 9, "c")


_RHO_STEP = "2*(0.1+ln(mid)*5)/(mid-1) AS t, " + q_sql(5, "t/2") + "-exp(0.1::DOUBLE)*" + q_sql(5, "mid*t/2") + " AS val"


@query(f"""WITH RECURSIVE src AS (SELECT c_nationkey AS nation, 1/(10::DOUBLE*count(*)) AS delta FROM customer GROUP BY 1),
{bisect_sql('rho', _RHO_STEP, 'delta', 1 + 1e-6, 2.0, 1 / 2**39.5, carry='nation, delta', source='FROM src')} SELECT nation, round(found, 8) AS rho FROM rho""")
def rho_for_delta(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg((1 / (10 * F.count("*"))).alias("delta"))
    return rounded(c.select("nation", spectra.ratio_for_delta("delta", 0.1, 10).alias("rho")), 8, "rho")


# Projections: the noise is none if the largest leverage needs none.


def _bar_sql(eps: float, delta: float, r: int) -> str:
    return bisect_sql("bar", projection_sql("mid", f"{eps!r}::DOUBLE", r), f"{delta!r}::DOUBLE", 1e-6, 1 - 1e-6, 1e-9)


def _top_sql(eps: float, delta: float, r: int) -> str:
    """CTEs after FIT that end in nz (sigma), of the relative projection mechanism."""
    return f"""top AS (SELECT max(q) AS p, max(sqrt(x1*x1+x2*x2+y*y)) AS l FROM r), {_bar_sql(eps, delta, r)},
nz AS (SELECT CASE WHEN val <= {delta!r}::DOUBLE THEN 0 ELSE l/sqrt(found) END AS sigma FROM (SELECT *, {projection_sql('p', f'{eps!r}::DOUBLE', r)} FROM top), bar)"""


def _projection_noise(m, eps: float, delta: float, r: int) -> float:
    _, g = linear.gram_matrix(m, ALL)
    top = m.agg(F.max(linear.quadratic(ALL, linear.inverse(g))).alias("p"), F.max(linear.row_norm(ALL)).alias("l")).first()
    return 0.0 if calibrate.projection_delta(eps, top.p, r) <= delta else calibrate.projection_sigma(top.l, eps, delta, r)


_NOISE = "(SELECT sigma FROM nz)"


@query(f"WITH RECURSIVE {FIT}, {_top_sql(1.0, 1e-6, 10)}, {project_sql(10, 1, _NOISE)} {PR}")
def rp_optimal(spark, d):
    """Noise for eps = 1, delta = 1e-6 only if the largest leverage needs it."""
    m = matrix(spark, d)
    return rounded_projection(mechanisms.project(m, KEY, ALL, 10, 1, TEST_KEY, _projection_noise(m, 1.0, 1e-6, 10)))


@query(f"WITH RECURSIVE {FIT}, {_top_sql(1e-4, 1e-7, 10)}, {project_sql(10, 1, _NOISE)} {PR}")
def rp_optimal_strict(spark, d):
    """At an eps and delta so small that noise is needed."""
    m = matrix(spark, d)
    return rounded_projection(mechanisms.project(m, KEY, ALL, 10, 1, TEST_KEY, _projection_noise(m, 1e-4, 1e-7, 10)))


@query(f"WITH RECURSIVE {M}, {_bar_sql(1.0, 1e-6, 10)}, nz AS (SELECT 20/sqrt(found) AS sigma FROM bar), {project_sql(10, 1, _NOISE)} {PR}")
def rp_public_bound(spark, d):
    """Rows are known to be no longer than 20: the noise does not depend on the table."""
    return rounded_projection(mechanisms.project(matrix(spark, d), KEY, ALL, 10, 1, TEST_KEY, calibrate.projection_sigma(20.0, 1.0, 1e-6, 10)))


def _added_sql(r: int, bound: float | None = None) -> str:
    square = f"{bound * bound!r}::DOUBLE" if bound else "max(x1*x1+x2*x2+y*y)"
    return f"nz AS (SELECT sqrt({square}*4*(sqrt(2*{r}*ln(4/1e-6))+ln(4/1e-6))/1.0) AS sigma FROM {'(SELECT 1)' if bound else 'm'})"


@query(f"WITH {M}, {_added_sql(5)}, {project_sql(5, 1, _NOISE)} {PR}")
def rp_added_rows(spark, d):
    m = matrix(spark, d)
    c = linear.added_rows_constant(m, ALL, 5, 1.0, 1e-6).first().c
    return rounded_projection(mechanisms.project(m, KEY, ALL, 5, 1, TEST_KEY, c))


@query(f"WITH {M}, {_added_sql(5, 20.0)}, {project_sql(5, 1, _NOISE)} {PR}")
def rp_added_rows_public(spark, d):
    m = matrix(spark, d)
    c = linear.added_rows_constant(m, ALL, 5, 1.0, 1e-6, 20.0).first().c
    return rounded_projection(mechanisms.project(m, KEY, ALL, 5, 1, TEST_KEY, c))


_REST = "least(sqrt(sum(x1*x1)-max(x1*x1)), sqrt(sum(x2*x2)-max(x2*x2)), sqrt(sum(y*y)-max(y*y)))"


def _information_sql(r: int, bits: str) -> str:
    return f"nz AS (SELECT sqrt(greatest({r}/(pow(2, 2*({bits}))-1)-c*c, 0)) AS sigma FROM (SELECT {_REST} AS c FROM m))"


@query(f"WITH {M}, {_information_sql(5, '0.1::DOUBLE')}, {project_sql(5, 1, _NOISE)} {PR}")
def rp_information(spark, d):
    m = matrix(spark, d)
    sigma = mechanisms.information_noise(linear.least_column_rest(m, ALL).first().c, 5, 0.1)
    return rounded_projection(mechanisms.project(m, KEY, ALL, 5, 1, TEST_KEY, sigma))


# The least eigenvalue of the Gram matrix of three columns, by the angle of its characteristic polynomial.
_EIGEN = """g3 AS (SELECT sum(x1*x1) AS a, sum(x2*x2) AS b, sum(y*y) AS c, sum(x1*x2) AS d, sum(x1*y) AS e, sum(x2*y) AS f, (a+b+c)/3 AS q,
  sqrt(((a-q)*(a-q)+(b-q)*(b-q)+(c-q)*(c-q)+2*(d*d+e*e+f*f))/6) AS s,
  ((a-q)*((b-q)*(c-q)-f*f)-d*(d*(c-q)-f*e)+e*(d*f-(b-q)*e))/(2*s*s*s) AS h, q+2*s*cos(acos(greatest(-1, least(1, h)))/3+2*pi()/3) AS least_value FROM m)"""


@query(f"""WITH RECURSIVE {M}, {_EIGEN}, {_bar_sql(0.5, 5e-7, 10)}, un AS (SELECT {u_sql('ptr', '0')}-0.5 AS u), lp AS (SELECT -sign(u)*ln(1-2*abs(u)) AS unit FROM un),
nz AS (SELECT sqrt(greatest(400/found-greatest(least_value+800*unit-800*ln(1/1e-6), 0), 0)) AS sigma FROM g3, bar, lp), {project_sql(10, 1, _NOISE)} {PR}""")
def rp_tested(spark, d):
    """Propose, test, release with a public bound of 20 on rows."""
    m = matrix(spark, d)
    _, g = linear.gram_matrix(m, ALL)
    unit = m.agg(F.count("*")).select(rng.laplace(TEST_KEY, "ptr", 1.0, F.lit(0))).first()[0]
    sigma = calibrate.tested_projection_sigma(float(np.linalg.eigvalsh(g).min()), 20.0, 1.0, 1e-6, 10, unit)
    return rounded_projection(mechanisms.project(m, KEY, ALL, 10, 1, TEST_KEY, sigma))


_CELL = "(id//4)::BIGINT", "(id%4)::BIGINT"


@query(f"""WITH {M}, g3 AS (SELECT sum(x1*x1) AS a, sum(x2*x2) AS b, sum(y*y) AS c, sum(x1*x2) AS d, sum(x1*y) AS e, sum(x2*y) AS f,
  sqrt(a) AS l11, d/l11 AS l21, e/l11 AS l31, sqrt(b-l21*l21) AS l22, (f-l31*l21)/l22 AS l32, sqrt(c-l31*l31-l32*l32) AS l33 FROM m),
zs AS (SELECT id//4 AS draw, id%4 AS k, {', '.join(f"{z_sql('cell', *_CELL, str(j))} AS z{j}" for j in range(3))} FROM range(0,12) t(id)),
pr AS (SELECT draw, k, l11*z0 AS x1, l21*z0+l22*z1 AS x2, l31*z0+l32*z1+l33*z2 AS y FROM zs, g3) {PR}""")
def rp_by_distribution(spark, d):
    return rounded_projection(mechanisms.project_by_distribution(matrix(spark, d), ALL, 4, 3, TEST_KEY))


@query(f"WITH {M} SELECT i::INT AS i, j::INT AS j, round(v, 4) AS value FROM (SELECT unnest([0,0,0,1,1,2]) AS i, unnest([0,1,2,1,2,2]) AS j, unnest([sum(x1*x1),sum(x1*x2),sum(x1*y),sum(x2*x2),sum(x2*y),sum(y*y)]) AS v FROM m)")
def rp_row_covariance(spark, d):
    """Covariance of each column of the projected table; its mean is zero."""
    g = linear.gram(matrix(spark, d), ALL)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g_{i}_{j}").alias("value")) for i in range(3) for j in range(i, 3)])
    return rounded(g.select(F.explode(cells).alias("c")).select("c.*"), 4, "value")


@query(f"WITH {M}, {project_sql(300, 1)} {PR}")
def rp_project_wide(spark, d):
    """300 projections at once."""
    return rounded_projection(mechanisms.project(matrix(spark, d), KEY, ALL, 300, 1, TEST_KEY))


# Least squares by sketch and solve, with the noise of each mechanism.

_SOLVED = "SELECT draw::INT AS draw, round((c*u-b*v)/(a*c-b*b), 6) + 0 AS b1, round((a*v-b*u)/(a*c-b*b), 6) + 0 AS b2 FROM sg"


def _solved(m, noise: float, r: int = 8, draws: int = 3):
    solved = mechanisms.sketch_least_squares(m, KEY, FEATURES, TARGET, r, draws, TEST_KEY, noise)
    return rounded(solved.select("draw", F.element_at("beta", 1).alias("b1"), F.element_at("beta", 2).alias("b2")), 6, "b1", "b2")


@query(f"WITH {M}, {_added_sql(8)}, {project_sql(8, 3, _NOISE)}, {SK} {_SOLVED}")
def alt19_ls(spark, d):
    m = matrix(spark, d)
    return _solved(m, linear.added_rows_constant(m, ALL, 8, 1.0, 1e-6).first().c)


_BITS = "pow(2*(1-1e-6)/(exp(1.0::DOUBLE)+1), 2)*log2(exp(1.0::DOUBLE))/2"


@query(f"WITH {M}, {_information_sql(8, _BITS)}, {project_sql(8, 3, _NOISE)}, {SK} {_SOLVED}")
def isit18_ls(spark, d):
    m = matrix(spark, d)
    return _solved(m, mechanisms.information_noise(linear.least_column_rest(m, ALL).first().c, 8, calibrate.information_eps(1.0, 1e-6)))


@query(f"WITH RECURSIVE {FIT}, {_top_sql(1e-4, 1e-7, 8)}, {project_sql(8, 3, _NOISE)}, {SK} {_SOLVED}")
def ls_from_projection(spark, d):
    m = matrix(spark, d)
    return _solved(m, _projection_noise(m, 1e-4, 1e-7, 8))


@query(f"WITH RECURSIVE {M}, {_bar_sql(1.0, 1e-6, 8)}, nz AS (SELECT 20/sqrt(found) AS sigma FROM bar), {project_sql(8, 3, _NOISE)}, {SK} {_SOLVED}")
def ls_from_projection_public(spark, d):
    return _solved(matrix(spark, d), calibrate.projection_sigma(20.0, 1.0, 1e-6, 8))


def _ls_sigma_sql(l: str, r: int, eps: float, delta: float, source: str = "(SELECT 1 AS one)", high: float = 100.0) -> str:
    x = f"(({l})*({l})/(mid*mid))"
    p = f"least(greatest(least({x}, 1-1e-8), 1e-12), 1-1e-8-1e-9)"
    return nodes_sql(64) + ", " + noise_sql("ls", p, f"least(greatest(least(2*{x}, 1-1e-8), {p}+1e-12), 1-1e-8)", r, f"{eps!r}::DOUBLE", f"{delta!r}::DOUBLE", 1e-3, high, [9, 9, 9], True, source)


def _top_ls_sql(r: int, eps: float, delta: float, high: float = 100.0) -> str:
    """CTEs after FIT that end in nz (sigma): none if the largest leverages satisfy eps and delta."""
    return f"""top AS (SELECT max(p) AS tp, max(q) AS tq, max(sqrt(x1*x1+x2*x2+y*y)) AS l FROM r), {_ls_sigma_sql('l', r, eps, delta, 'top', high)},
own AS (SELECT tp AS p, tq AS q, 1 AS one FROM top), {spectrum_sql(2, False, str(r), f'{eps!r}::DOUBLE', 'own', 'one', 'wl')}, {spectrum_sql(2, True, str(r), f'{eps!r}::DOUBLE', 'own', 'one', 'wr')},
nz AS (SELECT CASE WHEN greatest(wl, wr) <= {delta!r}::DOUBLE THEN 0 ELSE found END AS sigma FROM ls, wl_d, wr_d)"""


def _ls_noise(m, f, r: int, eps: float, delta: float, high: float = 100.0, tol: float = 1e-6) -> float:
    top = f.rows(m).agg(F.max("p").alias("p"), F.max("q").alias("q"), F.max(linear.row_norm(ALL)).alias("l")).first()
    if calibrate.least_squares_delta(top.p, top.q, 2, r, eps) <= delta:
        return 0.0
    return calibrate.least_squares_sigma(top.l, 2, r, eps, delta, high=high, tol=tol)


_DRAWS = "SELECT draw, round(beta_0, 7) + 0 AS beta_0, round(beta_1, 7) + 0 AS beta_1 FROM dr"
_G = FIT.replace(FIT[: FIT.index("g AS (")], "")  # the CTEs of FIT after m


@query(f"WITH RECURSIVE {FIT}, {_top_ls_sql(20, 1.0, 1e-6)}, {draws_sql(20, 100, 'SELECT sigma FROM nz')} {_DRAWS}")
def optimal_ls_draws(spark, d):
    """No noise if the largest leverages already satisfy eps = 1 at delta = 1e-6, else the least noise that does."""
    m, f = fitted(spark, d)
    return rounded(mechanisms.asymptotic_least_squares(m, f, 20, 100, TEST_KEY, _ls_noise(m, f, 20, 1.0, 1e-6)), 7, "beta_0", "beta_1")


@query(f"WITH RECURSIVE {FIT}, {_top_ls_sql(20, 0.01, 1e-3, 1e5)}, {draws_sql(20, 100, 'SELECT sigma FROM nz')} {_DRAWS}")
def optimal_ls_draws_strict(spark, d):
    """At an eps and delta so small that noise is needed."""
    m, f = fitted(spark, d)
    return rounded(mechanisms.asymptotic_least_squares(m, f, 20, 100, TEST_KEY, _ls_noise(m, f, 20, 0.01, 1e-3, 1e5, 1e-3)), 7, "beta_0", "beta_1")


@query(f"WITH RECURSIVE {FIT}, {_ls_sigma_sql('20', 20, 1.0, 1e-6)}, {draws_sql(20, 100, 'SELECT found FROM ls')} {_DRAWS}")
def optimal_ls_public(spark, d):
    """Rows are known to be no longer than 20: noise in any case."""
    m, f = fitted(spark, d)
    return rounded(mechanisms.asymptotic_least_squares(m, f, 20, 100, TEST_KEY, calibrate.least_squares_sigma(20.0, 2, 20, 1.0, 1e-6)), 7, "beta_0", "beta_1")


@query(f"WITH RECURSIVE {FIT}, {_top_ls_sql(8, 0.01, 1e-3, 1e5)}, {project_sql(8, 3, _NOISE)}, {SK} {_SOLVED}")
def als_mech(spark, d):
    """Sketch and solve with the noise of the least-squares spectrum, if it is needed."""
    m, f = fitted(spark, d)
    return _solved(m, _ls_noise(m, f, 8, 0.01, 1e-3, 1e5, 1e-3))


@query(f"WITH RECURSIVE {M}, {_ls_sigma_sql('20', 8, 1.0, 1e-6)}, nz AS (SELECT found AS sigma FROM ls), {project_sql(8, 3, _NOISE)}, {SK} {_SOLVED}")
def als_mech_public(spark, d):
    return _solved(matrix(spark, d), calibrate.least_squares_sigma(20.0, 2, 8, 1.0, 1e-6))


_SHRUNK = "(0.8*400/(mid*mid*0.8+400))"
_BOUNDED = noise_sql("ls", f"least(greatest({_SHRUNK}, 1e-12), 1-1e-8-1e-9)", f"least(greatest(least(2*{_SHRUNK}, 1-1e-8), {_SHRUNK}+1e-12), 1-1e-8)", 20, "1.0::DOUBLE", "1e-6::DOUBLE", 1e-3, 100.0, [9, 8], False)


@query(f"WITH RECURSIVE {FIT}, {nodes_sql(64)}, {_BOUNDED}, {draws_sql(20, 100, 'SELECT found FROM ls')} {_DRAWS}")
def bounded_leverage_ls_draws(spark, d):
    """Rows no longer than 20 whose leverages are known to be at most 0.8; the noise goes below the table as it is."""
    m, f = fitted(spark, d)
    sigma = calibrate.bounded_leverage_sigma(20.0, 0.8, 2, 20, 1.0, 1e-6)
    return rounded(mechanisms.asymptotic_least_squares(m, f, 20, 100, TEST_KEY, sigma), 7, "beta_0", "beta_1")


_FIXED = noise_sql("ls", "least(greatest(1/(mid*mid+1), 1e-12), 1-1e-8-1e-9)", "least(greatest(1/(mid*mid+1)+1/101.0::DOUBLE, 1/(mid*mid+1)+1e-12), 1-1e-8)", 20, "5.0::DOUBLE", "1e-6::DOUBLE", 1e-3, 1000.0, [10, 10], False)
_UNIT = M.replace("m AS (", "m0 AS (") + ", m AS (SELECT row_id, " + ", ".join(f"{c}/(SELECT sqrt(sum({c}*{c})) FROM m0) AS {c}" for c in ALL) + " FROM m0)"


@query(f"WITH RECURSIVE {_UNIT}, {_G}, {nodes_sql(64)}, {_FIXED}, {draws_sql(20, 100, 'SELECT found FROM ls', 10.0)} {_DRAWS}")
def fixed_residual_ls_draws(spark, d):
    m = linear.normalize_features(matrix(spark, d), ALL)
    f = linear.fit(m, FEATURES, TARGET)
    sigma = calibrate.fixed_residual_sigma(1.0, 10.0, 2, 20, 5.0, 1e-6)
    return rounded(mechanisms.asymptotic_least_squares(m, f, 20, 100, TEST_KEY, sigma, 10.0), 7, "beta_0", "beta_1")


_OUTPUT = ", ".join(f"{z_sql('output', 'id', str(j))} AS z{j}" for j in range(2))


@query(f"""WITH RECURSIVE {FIT}, sn AS (SELECT max(abs(w)*sqrt(pow(i11*x1+i12*x2,2)+pow(i12*x1+i22*x2,2))/(1-p)) AS s, max(b1) AS b1, max(b2) AS b2 FROM r),
{bisect_sql('gc', _gauss_sql('1.0::DOUBLE', 'mid'), '1e-6::DOUBLE', 1e-6, 100.0, 1e-12)}, zs AS (SELECT id, {_OUTPUT} FROM range(0,100) t(id)),
dr AS (SELECT id AS draw, b1+s/found*z0 AS beta_0, b2+s/found*z1 AS beta_1 FROM zs, sn, gc) {_DRAWS}""")
def gaussian_ls_calibrated(spark, d):
    m, f = fitted(spark, d)
    s = linear.sensitivity(m, f, KEY).first().sensitivity
    return rounded(mechanisms.output_noise(m, f, calibrate.gaussian_sigma(s, 1.0, 1e-6), 100, TEST_KEY), 7, "beta_0", "beta_1")


# Accuracy.

_RATIOS = "er AS (SELECT draw, sqrt(pow(beta_0-b1,2)+pow(beta_1-b2,2))/sqrt(b1*b1+b2*b2) AS relative_error, sqrt(b1*b1+b2*b2)/sqrt(beta_0*beta_0+beta_1*beta_1) AS size_ratio FROM dr, s)"


@query(f"WITH {FIT}, {draws_sql(20, 100)}, {_RATIOS} SELECT draw, round(relative_error, 7) AS relative_error, round(size_ratio, 7) AS size_ratio FROM er")
def ls_error_ratio(spark, d):
    m, f = fitted(spark, d)
    return rounded(accuracy.error_ratios(mechanisms.asymptotic_least_squares(m, f, 20, 100, TEST_KEY), f.beta), 7, "relative_error", "size_ratio")


def _both_bounds(values, names: list[str], confidence: float, resamples: int):
    parts = [accuracy.bootstrap_bounds(values, "draw", n, confidence, resamples, TEST_KEY).withColumn("measure", F.lit(n)) for n in names]
    return rounded(relational.union_sources(parts), 6, *BOUNDS)


@query(f"""WITH RECURSIVE {FIT}, {draws_sql(20, 100)}, {_RATIOS}, ev AS (SELECT draw AS i, relative_error AS v FROM er), sv AS (SELECT draw AS i, size_ratio AS v FROM er), {boot_sql('ev', 0.95, 50, 'eb')}, {boot_sql('sv', 0.95, 50, 'sb')}
SELECT 'relative_error' AS measure, {BOUNDS_SQL} FROM eb UNION ALL SELECT 'size_ratio', {BOUNDS_SQL} FROM sb""")
def ls_accuracy_bounds(spark, d):
    """Error and length of private coefficients, with bootstrap bounds of their means."""
    m, f = fitted(spark, d)
    ratios = accuracy.error_ratios(mechanisms.asymptotic_least_squares(m, f, 20, 100, TEST_KEY), f.beta)
    return _both_bounds(ratios, ["relative_error", "size_ratio"], 0.95, 50)


_DISTANCES = "t AS (SELECT sqrt(sum((x2-x1)*(x2-x1))) AS d10, sqrt(sum((y-x1)*(y-x1))) AS d20, sqrt(sum((y-x2)*(y-x2))) AS d21 FROM m), vs AS (SELECT draw AS i, (sqrt(sum((x2-x1)*(x2-x1))/6)/max(d10)+sqrt(sum((y-x1)*(y-x1))/6)/max(d20)+sqrt(sum((y-x2)*(y-x2))/6)/max(d21))/3 AS v FROM pr, t GROUP BY draw)"


@query(f"WITH RECURSIVE {M}, {project_sql(6, 40)}, {_DISTANCES}, {boot_sql('vs', 0.95, 30)} SELECT {BOUNDS_SQL} FROM bb")
def rp_distance_bounds(spark, d):
    m = matrix(spark, d)
    ratios = accuracy.distance_ratios(m, mechanisms.project(m, KEY, ALL, 6, 40, TEST_KEY), ALL, 6)
    return rounded(accuracy.bootstrap_bounds(ratios, "draw", "ratio", 0.95, 30, TEST_KEY), 6, *BOUNDS)


_PRODUCTS = f"""ex AS (SELECT unnest([{', '.join(f'sum({a}*{b})' for a in ALL for b in ALL)}]) AS x, unnest(range(0,9)) AS c FROM m),
ap AS (SELECT draw, unnest([{', '.join(f'sum({a}*{b})/6' for a in ALL for b in ALL)}]) AS z, unnest(range(0,9)) AS c FROM pr GROUP BY draw),
vs AS (SELECT draw AS i, covar_samp(x, z)/(stddev_pop(x)*stddev_pop(z)) AS v FROM ap JOIN ex USING (c) GROUP BY draw)"""


@query(f"WITH RECURSIVE {M}, {project_sql(6, 40)}, {_PRODUCTS}, {boot_sql('vs', 0.95, 30)} SELECT {BOUNDS_SQL} FROM bb")
def rp_product_bounds(spark, d):
    m = matrix(spark, d)
    found = accuracy.product_correlation(m, mechanisms.project(m, KEY, ALL, 6, 40, TEST_KEY), ALL, 6)
    return rounded(accuracy.bootstrap_bounds(found, "draw", "correlation", 0.95, 30, TEST_KEY), 6, *BOUNDS)


def _error_sql(r: int) -> str:
    sk = SK.replace("sg AS", f"sg{r} AS").replace("FROM pr ", f"FROM pr{r} ")
    return f"{project_sql(r, 4, tag=str(r))}, {sk}, e{r} AS (SELECT {r}::INT AS r, avg(pow((c*u-b*v)/(a*c-b*b)-b1,2)+pow((a*v-b*u)/(a*c-b*b)-b2,2)) AS error FROM (SELECT sg{r}.*, s.b1, s.b2 FROM sg{r}, s))"


@query(f"WITH {FIT}, {_error_sql(4)}, {_error_sql(8)} SELECT r, round(error, 7) AS error FROM e4 UNION ALL SELECT r, round(error, 7) FROM e8")
def experimental_accuracy_by_r(spark, d):
    m, f = fitted(spark, d)
    parts = [accuracy.squared_errors(mechanisms.sketch_least_squares(m, KEY, FEATURES, TARGET, r, 4, TEST_KEY), f.beta).agg(F.avg("error").alias("error")).select(F.lit(r).alias("r"), "error") for r in (4, 8)]
    return rounded(relational.union_sources(parts), 7, "error")


@query(f"""WITH {FIT}, zs AS (SELECT id, {', '.join(f"{z_sql('beta', 'id', str(j))} AS z{j}" for j in range(2))} FROM range(0,100) t(id)), rs2 AS (SELECT max(rss)::DOUBLE AS rss, max(i11) AS i11, max(i12) AS i12, max(i22) AS i22 FROM r),
dv AS (SELECT k::INT AS r, sqrt(rss/k*i11)*z0 AS e0, (rss/k*i12)/sqrt(rss/k*i11)*z0+sqrt(rss/k*i22-pow(rss/k*i12,2)/(rss/k*i11))*z1 AS e1 FROM zs, rs2, (VALUES (10),(100),(300)) t(k))
SELECT r, round(avg(e0*e0+e1*e1), 8) AS error FROM dv GROUP BY r""")
def asymptotic_accuracy_by_r(spark, d):
    """Mean squared error of draws from the limiting distribution, for each r of a list."""
    m, f = fitted(spark, d)
    return rounded(accuracy.asymptotic_errors(m, f, [10, 100, 300], 100, TEST_KEY), 8, "error")


# Spectra over grids, of given tables and of large r.

_TL = "(2*(0.001+ln(1/(1-p))*150)/(1/(1-p)-1))"


@query(f"WITH {FIT} SELECT row_id, round({q_sql(150, _TL + '/2')}-exp(0.001)*{q_sql(150, _TL + '/2/(1-p)')}, 8) + 0 AS delta FROM r")
def rp_spectrum_r300(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, spectra.projection(0.001, "p", 300).alias("delta")), 8, "delta")


@query(f"""WITH {FIT}, k AS (SELECT row_id, x1, x2, g11+25 AS a, g12 AS b, g22+25 AS c, a*c-b*b AS whole, (x1*x1*c-2*x1*x2*b+x2*x2*a)/whole AS p FROM m, s)
SELECT row_id, round(p, 10) AS p, round(greatest(0, {q_sql(15, '(2*(0.001+ln(1/(1-p))*15)/(1/(1-p)-1))/2')}-exp(0.001)*{q_sql(15, '(2*(0.001+ln(1/(1-p))*15)/(1/(1-p)-1))/2/(1-p)')}), 8) + 0 AS delta FROM k""")
def rp_spectrum_regularised(spark, d):
    """Leverages after 5 times the identity below the table."""
    m = matrix(spark, d)
    _, g = linear.gram_matrix(m, FEATURES)
    rows = m.withColumn("p", linear.quadratic(FEATURES, linear.inverse(g + 25.0 * np.eye(2))))
    return rounded(rows.select(KEY, "p", spectra.projection(0.001, "p", 30).alias("delta")), 8, "delta").withColumn("p", F.round("p", 10))


@query(f"WITH {FIT}, {nodes_sql()}, {spectrum_sql(2, False, '300', '0.001', 'r', 'row_id', 'lf')}, {spectrum_sql(2, True, '300', '0.001', 'r', 'row_id', 'rt')} SELECT row_id, round(greatest(lf, rt), 9) + 0 AS delta FROM lf_d JOIN rt_d USING (row_id)")
def delta_pq_all_rows(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, quadrature.worse("p", "q", 2, 300, 0.001).alias("delta")), 9, "delta")


@query(f"WITH {FIT}, {nodes_sql()}, rg AS (SELECT row_id, p, q, eps FROM r, (VALUES (0.001::DOUBLE),(0.01),(0.1)) t(eps)), {spectrum_sql(3, False, '20', 'eps', 'rg', 'row_id, eps', 'lf')} SELECT row_id, eps, round(lf, 7) + 0 AS delta FROM lf_d")
def ls_eps_grid(spark, d):
    m, f = fitted(spark, d)
    rows = spectra.sweep(f.rows(m), eps=[0.001, 0.01, 0.1])
    return rounded(rows.select(KEY, "eps", quadrature.left("p", "q", 3, 20, "eps").alias("delta")), 7, "delta")


@query(f"WITH {FIT}, {nodes_sql()}, rg AS (SELECT row_id, p, q, rr FROM r, (VALUES (10.0::DOUBLE),(100.0),(1000.0)) t(rr)), {spectrum_sql(3, False, 'rr', '0.01', 'rg', 'row_id, rr', 'lf')} SELECT row_id, rr AS r, round(lf, 7) + 0 AS delta FROM lf_d")
def ls_r_grid(spark, d):
    m, f = fitted(spark, d)
    rows = spectra.sweep(f.rows(m), r=[10, 100, 1000])
    return rounded(rows.select(KEY, "r", quadrature.left("p", "q", 3, "r", 0.01).alias("delta")), 7, "delta")


def _log_sql(p: str, q: str) -> str:
    return f"WITH {nodes_sql()}, sp AS (SELECT DISTINCT p_size FROM part), rg AS (SELECT p_size, {p} AS p, {q} AS q FROM sp), {spectrum_sql(3, False, '20', '0.1', 'rg', 'p_size', 'lf')} SELECT p_size, round(ln(lf), 6) AS log_delta FROM lf_d"


@query(_log_sql("1/101.0::DOUBLE", "1/101.0::DOUBLE+1/(1+pow(4+p_size, 2))"))
def log_delta_by_residual(spark, d):
    """ln delta for rows of length 1, sigma = 10 and a residual of 4 + size."""
    sizes = table(spark, d, "part").select("p_size").distinct()
    rho = F.col("p_size") + 4.0
    rows = sizes.select("p_size", F.lit(1 / 101.0).alias("p"), (F.lit(1 / 101.0) + 1 / (1 + rho * rho)).alias("q"))
    return rows.select("p_size", F.round(F.ln(quadrature.left("p", "q", 3, 20, 0.1)), 6).alias("log_delta"))


@query(_log_sql("1/(1+pow(2+p_size/4.0, 2))", "1/(1+pow(2+p_size/4.0, 2))+1/101.0::DOUBLE"))
def log_delta_by_noise(spark, d):
    """ln delta for rows of length 1, a residual of 10 and sigma = 2 + size / 4."""
    sizes = table(spark, d, "part").select("p_size").distinct()
    sigma = 2 + F.col("p_size") / 4
    rows = sizes.select("p_size", (1 / (1 + sigma * sigma)).alias("p")).withColumn("q", F.col("p") + 1 / 101.0)
    return rows.select("p_size", F.round(F.ln(quadrature.left("p", "q", 3, 20, 0.1)), 6).alias("log_delta"))


_SEQ = "sqrt((2*(eps/10)-ln(1-p))/p)", "sqrt(greatest((-ln(1-p)-2*(eps/10))/p, 0))"


@query(f"""WITH {FIT}, e AS (SELECT row_id, p, eps, {_SEQ[0]} AS up, {_SEQ[1]} AS dn FROM r, (VALUES (0.0001::DOUBLE),(0.001),(0.01)) t(eps))
SELECT row_id, eps, round(least(1, 10*greatest(0, 2*(1-{phi_sql('up*sqrt(1-p)')})-exp(eps/10)*2*(1-{phi_sql('up')}), CASE WHEN -ln(1-p) > eps/5 THEN (2*{phi_sql('dn')}-1)-exp(eps/10)*(2*{phi_sql('dn*sqrt(1-p)')}-1) ELSE 0 END)), 7) + 0 AS delta FROM e""")
def delta_rp_sequential_grid(spark, d):
    m, f = fitted(spark, d)
    rows = spectra.sweep(f.rows(m), eps=[0.0001, 0.001, 0.01])
    return rounded(rows.select(KEY, "eps", spectra.sequential("eps", "p", 10).alias("delta")), 7, "delta")


@query(f"""WITH k AS (SELECT p_partkey, 0.5::DOUBLE + p_size/50.0 AS s1, 1.0::DOUBLE AS s2, p_retailprice/2000 AS mu FROM part WHERE p_size <> 25),
t AS (SELECT *, greatest(s1, s2) AS a, least(s1, s2) AS b, a/b AS g, mu/(b*(g*g-1)) AS m, m*m+(2*0.1+2*ln(g)+mu*mu/(a*a))/(1-1/(g*g)) AS up, m*m+(2*ln(g)-2*0.1+mu*mu/(a*a))/(1-1/(g*g)) AS dn, sqrt(greatest(up,0)) AS ru, sqrt(greatest(dn,0)) AS rd FROM k)
SELECT p_partkey, round(greatest(0, {phi_sql('g*m-ru/g')}+{phi_sql('-g*m-ru/g')}-exp(0.1)*({phi_sql('m-ru')}+{phi_sql('-m-ru')}), CASE WHEN dn > 0 THEN {phi_sql('rd-m')}-{phi_sql('-rd-m')}-exp(0.1)*({phi_sql('rd/g-g*m')}-{phi_sql('-rd/g-g*m')}) ELSE 0 END), 8) + 0 AS delta FROM t""")
def delta_1d_general(spark, d):
    """The worse direction between two normals of other means and widths."""
    p = table(spark, d, "part").where("p_size <> 25").select("p_partkey", (F.lit(0.5) + F.col("p_size") / 50.0).alias("s1"), (F.col("p_retailprice") / 2000).alias("mu"))
    return rounded(p.select("p_partkey", spectra.two_gaussians(0.1, "s1", 1.0, "mu").alias("delta")), 8, "delta")


_MOMENTS = """SELECT avg(a1)-avg(b1) AS m1, avg(a2)-avg(b2) AS m2, covar_samp(a1,a1)+covar_samp(b1,b1) AS v11, covar_samp(a1,a2)+covar_samp(b1,b2) AS v12, covar_samp(a2,a2)+covar_samp(b2,b2) AS v22 FROM
(SELECT CASE WHEN l_returnflag = 'A' THEN l_quantity/10 END AS a1, CASE WHEN l_returnflag = 'A' THEN l_extendedprice/1e4 END AS a2, CASE WHEN l_returnflag = 'R' THEN l_quantity/10 END AS b1, CASE WHEN l_returnflag = 'R' THEN l_extendedprice/1e4 END AS b2 FROM lineitem)"""


@query(f"""WITH v AS ({_MOMENTS}), l AS (SELECT sqrt((m1*m1*v22-2*m1*m2*v12+m2*m2*v11)/(v11*v22-v12*v12)) AS len FROM v), e AS (SELECT eps, sqrt(400)*len AS c FROM l, (VALUES (0.01::DOUBLE),(0.1),(1.0)) t(eps))
SELECT eps, round(greatest(0, {phi_sql('c/2-eps/c')}-exp(eps)*{phi_sql('-c/2-eps/c')}), 8) + 0 AS delta FROM e""")
def delta_same_covariance(spark, d):
    """400 releases of the mean of two groups of lines whose covariances are pooled."""
    columns = ["l_quantity", "l_extendedprice"]
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("l_quantity"), (F.col("l_extendedprice") / 1e4).alias("l_extendedprice"))
    cells = [F.covar_samp(a, b) for a in columns for b in columns]
    found = {r[0]: np.array(r[1:], float) for r in li.where("l_returnflag in ('A', 'R')").groupBy("l_returnflag").agg(*[F.avg(c) for c in columns], *cells).collect()}
    covariance, shift = (found["A"][2:] + found["R"][2:]).reshape(2, 2), found["A"][:2] - found["R"][:2]
    rows = spectra.sweep(li.agg(F.count("*").alias("n")), eps=[0.01, 0.1, 1.0])
    return rounded(rows.select("eps", spectra.same_covariance("eps", covariance, shift, 400.0).alias("delta")), 8, "delta")


@query(f"""WITH t AS (SELECT c_nationkey AS nation, 10 + sqrt(count(*)) AS sigma FROM customer GROUP BY 1), k AS (SELECT nation, sqrt(100)/sigma AS c FROM t)
SELECT nation, round(greatest(0, {phi_sql('c/2-1/c')}-exp(1.0::DOUBLE)*{phi_sql('-c/2-1/c')}), 9) AS delta, TRUE AS fft_agrees FROM k""")
def fft_composition(spark, d):
    """100 releases at the noise of each nation: the closed form, and whether folding the discretised loss agrees to 1e-6."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg((10 + F.sqrt(F.count("*"))).alias("sigma"))

    @F.pandas_udf("double")
    def folded(sigma: pd.Series) -> pd.Series:
        return pd.Series([calibrate.fft_delta(1.0, s, 100) for s in sigma])

    rows = c.select("nation", spectra.mean_shift(1.0, "sigma", 1.0, 100.0).alias("delta"), folded("sigma").alias("f"))
    return rounded(rows.select("nation", "delta", (F.abs(F.col("delta") - F.col("f")) < 1e-6).alias("fft_agrees")), 9, "delta")


# The asymptotic mechanism, row by row. Values that grow without bound as a residual goes to zero are given by their first digits.


def mantissa(x):
    return F.coalesce(F.round(x / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x)))), 5), F.lit(0.0))


def mantissa_sql(x: str) -> str:
    return f"CASE WHEN ({x}) = 0 THEN 0 ELSE round(({x})/pow(10.0::DOUBLE, floor(log10(abs({x})))), 5) END"


@query(f"""WITH {FIT}, k AS (SELECT *, rss-w*w/(1-p) AS rest FROM r) SELECT row_id, {mantissa_sql('rss/(rest-rss)')} AS ratio, round(rest/1e4*(i11+pow(i11*x1+i12*x2,2)/(1-p)), 9) AS c_0_0, round(rest/1e4*(i12+(i11*x1+i12*x2)*(i12*x1+i22*x2)/(1-p)), 9) + 0 AS c_0_1,
round(rest/1e4*(i22+pow(i12*x1+i22*x2,2)/(1-p)), 9) AS c_1_1 FROM k WHERE abs(w) > 0.01""")
def neighbor_covariance(spark, d):
    """Ratio of the constants, and covariance of the output without each row (residuals near zero, whose ratio explodes, left out)."""
    m, f = fitted(spark, d)
    _, other = asymptotic.covariances(f)
    cells = {f"c_{i}_{j}": other[i][j] / 1e4 for i in range(2) for j in range(i, 2)}
    rows = f.rows(m).where(F.abs("w") > 0.01)
    return rounded(rows.select(KEY, mantissa(asymptotic.ratio(f)).alias("ratio"), *[v.alias(k) for k, v in cells.items()]), 9, *cells)


_A = "0.5*(2*ln(1-w*w/((1-p)*rss))-ln(1-p)+20*w*w/(rss*(1-p)-w*w)-20*pow(w,4)*(1-p)/(w*w*rss*(1-p*p)-pow(w,4)-rss*rss*p*(1-p)*(1-p)))"


@query(f"""WITH {FIT}, k AS (SELECT *, rss-w*w/(1-p) AS rest, 1/rest AS c1, (rest-rss)/(rss*rest) AS c2 FROM r) SELECT row_id, {mantissa_sql(_A)} AS a, round(c1*x1*x1+c2*g11, 8) + 0 AS q_0_0, round(c1*x1*x2+c2*g12, 8) + 0 AS q_0_1, round(c1*x2*x2+c2*g22, 8) + 0 AS q_1_1 FROM k, g""")
def asymptotic_threshold(spark, d):
    """The constant and the quadratic form of the log ratio of outputs with and without each row, at r = 20."""
    m, f = fitted(spark, d)
    q = asymptotic.quadratic_form(f)
    cells = {"q_0_0": q[0][0], "q_0_1": q[0][1], "q_1_1": q[1][1]}
    return rounded(f.rows(m).select(KEY, mantissa(asymptotic.threshold(f, 20)).alias("a"), *[v.alias(k) for k, v in cells.items()]), 8, *cells)


@query(f"""WITH {FIT}, k AS (SELECT *, rss/((rss-w*w/(1-p))-rss) AS c, i11*x1+i12*x2 AS v1, i12*x1+i22*x2 AS v2 FROM r WHERE abs(w) > 0.01)
SELECT row_id, {mantissa_sql('-sqrt(20)*w*c/(1+c*p)*v1')} AS m_0, {mantissa_sql('-sqrt(20)*w*c/(1+c*p)*v2')} AS m_1, {mantissa_sql('-sqrt(20)*w*(1+c)/((1-p)*(1+c*p))*v1')} AS n_0, {mantissa_sql('-sqrt(20)*w*(1+c)/((1-p)*(1+c*p))*v2')} AS n_1 FROM k""")
def asymptotic_means(spark, d):
    m, f = fitted(spark, d)
    own, other = asymptotic.means(f, 20)
    cells = {"m_0": own[0], "m_1": own[1], "n_0": other[0], "n_1": other[1]}
    return f.rows(m).where(F.abs("w") > 0.01).select(KEY, *[mantissa(v).alias(k) for k, v in cells.items()])


@query(f"""WITH {M}, g AS (SELECT sum(x1*x1) AS g, sum(x1*y) AS h, sum(y*y) AS yy FROM m), s AS (SELECT *, h/g AS b, yy-h*h/g AS rss FROM g),
r AS (SELECT row_id, x1, y-b*x1 AS w, x1*x1/g AS p, rss, g FROM m, s),
k AS (SELECT *, rss-w*w/(1-p) AS rest, rss/(rest-rss) AS c, x1*x1/rest+(rest-rss)/(rss*rest)*g AS qq, {_A.replace('2*ln', 'ln')} AS a FROM r WHERE abs(w) > 0.01),
e AS (SELECT *, 2*(a-eps)/qq AS pt FROM k, (VALUES (0.0001::DOUBLE),(0.001),(0.01)) t(eps)),
n AS (SELECT *, sqrt(greatest(pt,0)) AS pp, -sqrt(20)*w*c/(1+c*p)*x1/g AS mu, sqrt(rss/g) AS sg, -sqrt(20)*w*(1+c)/((1-p)*(1+c*p))*x1/g AS nu, sqrt(rest/(g-x1*x1)) AS ng FROM e),
ni AS (SELECT *, {phi_sql('(pp-mu)/sg')}-{phi_sql('(-pp-mu)/sg')} AS i1, {phi_sql('(pp-nu)/ng')}-{phi_sql('(-pp-nu)/ng')} AS i2 FROM n)
SELECT row_id, eps, round(CASE WHEN pt > 0 THEN least(1, greatest(0, CASE WHEN qq > 0 THEN i1-exp(eps)*i2 ELSE 1-i1-exp(eps)*(1-i2) END)) ELSE 0 END, 7) + 0 AS delta FROM ni""")
def ls_spectrum_1d(spark, d):
    """One feature: the least-squares spectrum in closed form over a grid of eps."""
    m = matrix(spark, d)
    f = linear.fit(m, ["x1"], TARGET)
    rows = spectra.sweep(f.rows(m).where(F.abs("w") > 0.01), eps=[0.0001, 0.001, 0.01])
    return rounded(asymptotic.spectrum_1d(rows, f, 20, "eps").select(KEY, "eps", "delta"), 7, "delta")


@query(f"""WITH {FIT}, o AS (SELECT x1 AS o1, x2 AS o2, y AS oy FROM r ORDER BY r.q DESC, row_id LIMIT 1),
h AS (SELECT g11-o1*o1 AS a, g12-o1*o2 AS b, g22-o2*o2 AS c, h1-o1*oy AS u, h2-o2*oy AS v FROM g, o), k AS (SELECT (c*u-b*v)/(a*c-b*b) AS n1, (a*v-b*u)/(a*c-b*b) AS n2 FROM h)
SELECT row_id, round(y-n1*x1-n2*x2, 7) + 0 AS w FROM m, k""")
def neighbor_residuals(spark, d):
    """Residuals of all rows for the table without its most exposed one."""
    m, f = fitted(spark, d)
    top = linear.largest_leverage(m, f, KEY).first()[KEY]
    row = linear.row_of(m, KEY, top, ALL)
    other = f.without(row[:-1], row[-1])
    return rounded(m.select(KEY, other.residual().alias("w")), 7, "w")


@query(f"""WITH {FIT}, o AS (SELECT row_id AS oid FROM r ORDER BY r.q DESC, row_id LIMIT 1), z AS (SELECT CASE WHEN row_id = oid THEN 0 ELSE x1 END AS x1, CASE WHEN row_id = oid THEN 0 ELSE x2 END AS x2, CASE WHEN row_id = oid THEN 0 ELSE y END AS y FROM m, o)
SELECT count(*) AS n, round(sum(x1*x1),4) AS g_0_0, round(sum(x1*x2),4) AS g_0_1, round(sum(x1*y),4) AS g_0_2, round(sum(x2*x2),4) AS g_1_1, round(sum(x2*y),4) AS g_1_2, round(sum(y*y),4) AS g_2_2 FROM z""")
def neighbor_gram(spark, d):
    """The neighbour that has the most exposed row zeroed."""
    m, f = fitted(spark, d)
    top = linear.largest_leverage(m, f, KEY).first()[KEY]
    g = linear.gram(linear.neighbor_matrix(m, KEY, top, ALL), ALL)
    return rounded(g, 4, *[c for c in g.columns if c != "n"])


@query(f"WITH {FIT} SELECT row_id, round(p, 10) AS p, round(q, 10) AS q, round(q-p, 10) + 0 AS residual_share FROM r ORDER BY r.p DESC, row_id LIMIT 1")
def largest_leverage_of_features(spark, d):
    m, f = fitted(spark, d)
    return rounded(linear.largest_leverage(m, f, KEY, augmented=False), 10, "p", "q", "residual_share")
