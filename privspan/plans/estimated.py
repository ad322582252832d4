"""Registered queries and their SQL: black-box estimates from labelled samples, kernels in many dimensions, derivatives, files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from privspan.functions.special import INV_A, INV_B, INV_C, INV_D
from privspan.operators import accuracy, blackbox, kernels, linear, mechanisms, quadratic_forms, quadrature, relational
from privspan.sources.tables import new_folder, read_matrix, read_range, stored, table, write_batches, write_matrix
from privspan.streaming.histogram import HistogramState, combined

from .registry import (
    ALL, BOUNDS, BOUNDS_SQL, FEATURES, FIT, KEY, SK, TARGET, TEST_KEY, M, boot_sql, draws_sql, fitted, kernel_sql, matrix, nodes_sql, phi_sql, project_sql, query, rounded, u_sql, z_sql,
)

# Labelled samples of a table (y = 1, some replaced by sentinels) and of its neighbour without one row (y = 0).

_C = "c AS (SELECT c_custkey AS row_id, c_acctbal/1000 AS x1, 1.0::DOUBLE AS x2 FROM customer), c0 AS (SELECT row_id, CASE WHEN row_id = {out} THEN 0 ELSE x1 END AS x1, CASE WHEN row_id = {out} THEN 0 ELSE x2 END AS x2 FROM c)"

_ALL_C = "c AS (SELECT c_custkey AS row_id, c_acctbal/1000 AS x1, 1.0::DOUBLE AS x2 FROM customer)"


def customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias(KEY), (F.col("c_acctbal") / 1000).alias("x1"), F.lit(1.0).alias("x2"))


def _dummy(eps: float, key: str = TEST_KEY) -> str:
    return f"{u_sql('dummy', 'draw', key=key)} < 1-exp(-{eps}::DOUBLE)"


def samples_sql(columns: list[str], r: int, eps: float, draws: int, noise: float = 0.0, out: int = 1, key: str = TEST_KEY, tag: str = "") -> str:
    """CTEs after c and c0 that end in sm (sample_id, y, x, dummy): mechanisms.labelled_samples."""
    parts = [project_sql(r, draws, noise, f"{key}.{y}", t, columns, tag=f"{tag}{y}") for y, t in ((1, "c"), (0, "c0"))]
    x = f"flatten(list([{', '.join(columns)}] ORDER BY k))"
    return f"""{', '.join(parts)}, sm{tag} AS (SELECT draw*2+1 AS sample_id, 1.0::DOUBLE AS y, {x} AS x, {_dummy(eps, key)} AS dummy FROM pr{tag}1 GROUP BY draw
  UNION ALL SELECT draw*2, 0.0, {x}, FALSE FROM pr{tag}0 GROUP BY draw)"""


def estimate_sql(eps: float, d: int, tag: str = "", gamma: float = 0.01) -> str:
    """CTEs over sm that end in es: blackbox.estimate, samples 0 and 1 of four for training."""
    t = tag
    c = f"(pow(1+2/sqrt(2-sqrt(3)), {d})-1)"
    return f"""sz{t} AS (SELECT count(*) FILTER (sample_id%4 < 2) AS n1, count(*) FILTER (sample_id%4 >= 2) AS n2, count(*) FILTER (sample_id%4 < 2 AND NOT dummy) AS k1, count(*) FILTER (sample_id%4 >= 2 AND NOT dummy) AS k2,
  ceil(sqrt(k1))::BIGINT AS ro, least(10*(ro+CASE WHEN ro%2 = 0 THEN 1 ELSE 0 END), k1) AS kk FROM sm{t}),
rk{t} AS (SELECT a.sample_id, a.y AS own, b.y, row_number() OVER (PARTITION BY a.sample_id ORDER BY list_distance(a.x, b.x), b.sample_id) AS place FROM sm{t} a, sm{t} b WHERE a.sample_id%4 >= 2 AND NOT a.dummy AND b.sample_id%4 < 2 AND NOT b.dummy),
pd{t} AS (SELECT sample_id, max(own) AS own, round_even(avg(y), 0) AS guess FROM rk{t}, sz{t} WHERE place <= kk GROUP BY sample_id),
ac{t} AS (SELECT (count(*) FILTER (own = guess)+max(n2-k2))/(count(*)+max(n2-k2)) AS accuracy, max(n1) AS n1, max(n2) AS n2 FROM pd{t}, sz{t}),
es{t} AS (SELECT greatest(0, 1-2*exp({eps}::DOUBLE)*(1-accuracy)) AS estimated_delta, accuracy, 2*exp({eps}::DOUBLE)*(12*{c}*sqrt(ln(4/{gamma})/(2*n1))+sqrt(ln(4/{gamma})/(2*n2))) AS radius, n1, n2 FROM ac{t})"""


_ES = "SELECT round(estimated_delta, 7) + 0 AS estimated_delta, round(accuracy, 7) AS accuracy, round(greatest(0, estimated_delta-radius), 7) + 0 AS low, round(least(1, estimated_delta+radius), 7) AS high, 0.01::DOUBLE AS gamma, n1::INT AS training_size, n2::INT AS validation_size FROM es"


def _halves(samples, eps: float):
    return rounded(blackbox.estimate_halves(samples, eps), 7, "estimated_delta", "accuracy", "low", "high")


def _flat(samples, d: int):
    # A sentinel is far beyond the samples' digits; it is told by a flag.
    dummy = (F.element_at("x", 1) >= relational.SENTINEL_FROM).alias("dummy")
    cells = [F.when(F.col("dummy"), 0.0).otherwise(F.round(F.element_at("x", i + 1), 6) + F.lit(0.0)).alias(f"x_{i}") for i in range(d)]
    return samples.select("sample_id", "y", "x", dummy).select("sample_id", "y", "dummy", *cells)


def _flat_sql(d: int) -> str:
    return "SELECT sample_id, y, dummy, " + ", ".join(f"CASE WHEN dummy THEN 0 ELSE round(x[{i + 1}], 6) + 0 END AS x_{i}" for i in range(d)) + " FROM sm"


def _labelled(name: str, columns: list[str], r: int, draws: int, noise: float, doc: str):
    def run(spark, d):
        return _flat(mechanisms.labelled_samples(customers(spark, d), KEY, columns, 1, 0.1, draws, TEST_KEY, r, noise), r * len(columns))

    run.__name__, run.__doc__ = name, doc
    return query(f"WITH {_C.format(out=1)}, {samples_sql(columns, r, 0.1, draws, noise)} {_flat_sql(r * len(columns))}")(run)


rlc_labelled_samples = _labelled("rlc_labelled_samples", ["x1", "x2"], 1, 60, 0.0, "Random linear combinations of all columns.")
rlc_noisy_samples = _labelled("rlc_noisy_samples", ["x1", "x2"], 1, 60, 2.5, "The same with noise.")
rp_labelled_samples = _labelled("rp_labelled_samples", ["x1", "x2"], 3, 60, 0.0, "Three projections a sample.")
rp_noisy_samples = _labelled("rp_noisy_samples", ["x1", "x2"], 3, 60, 2.5, "The same with noise.")


@query(f"WITH {_C.format(out=1)}, {samples_sql(['x1'], 1, 0.1, 400)}, {estimate_sql(0.1, 1)} {_ES}")
def estimator_pipeline(spark, d):
    """Labelled projections of the customers' balances and of the neighbour without customer 1, through nearest neighbours."""
    samples = mechanisms.labelled_samples(customers(spark, d), KEY, ["x1"], 1, 0.1, 400, TEST_KEY)
    return _halves(samples, 0.1)


@query(f"WITH {_C.format(out=1)}, {samples_sql(['x1', 'x2'], 2, 0.1, 200, 2.5)}, {estimate_sql(0.1, 4)} {_ES}")
def rp_noisy_estimator(spark, d):
    samples = mechanisms.labelled_samples(customers(spark, d), KEY, ["x1", "x2"], 1, 0.1, 200, TEST_KEY, 2, 2.5)
    return _halves(samples, 0.1)


def _folder(spark) -> str:
    return new_folder(spark, "matrix")


@query(f"WITH {_C.format(out=1)}, {samples_sql(['x1'], 1, 0.1, 300)}, {estimate_sql(0.1, 1)} {_ES}")
def estimator_from_batches(spark, d):
    """Samples stored by label and batch, and the estimate from the batches read back."""
    folder = _folder(spark)
    samples = stored(mechanisms.labelled_samples(customers(spark, d), KEY, ["x1"], 1, 0.1, 300, TEST_KEY), "samples")
    write_batches(samples, folder, "sample_id", 100, "y")
    return _halves(spark.read.parquet(folder).select("sample_id", "x", F.col("y").cast("double").alias("y")), 0.1)


_OUTS = (1, 2, 3, 4)
_REPORT = ", ".join(f"o{o} AS (SELECT row_id, CASE WHEN row_id = {o} THEN 0 ELSE x1 END AS x1, x2 FROM c), " + samples_sql(["x1"], 1, 0.1, 100, key=f"{TEST_KEY}-{o}", tag=f"_{o}_").replace(" FROM c0)", f" FROM o{o})") + ", " + estimate_sql(0.1, 1, f"_{o}_") for o in _OUTS)
_REPORT = f"c AS (SELECT c_custkey AS row_id, c_acctbal/1000 AS x1, 1.0::DOUBLE AS x2 FROM customer), {_REPORT}"
_DELTAS = " UNION ALL ".join(f"SELECT {o}::BIGINT AS left_out, estimated_delta, accuracy FROM es_{o}_" for o in _OUTS)


def _report(spark, d):
    parts = [mechanisms.labelled_samples(customers(spark, d), KEY, ["x1"], o, 0.1, 100, f"{TEST_KEY}-{o}").withColumn("left_out", F.lit(o).cast("long")) for o in _OUTS]
    return blackbox.estimate_halves_of(relational.union_sources(parts), "left_out", _OUTS, 0.1).select("left_out", "estimated_delta", "accuracy")


@query(f"WITH {_REPORT} SELECT left_out, round(estimated_delta, 7) + 0 AS estimated_delta, round(accuracy, 7) AS accuracy FROM ({_DELTAS})")
def estimator_report(spark, d):
    """One estimate for each of several neighbours."""
    return rounded(_report(spark, d), 7, "estimated_delta", "accuracy")


@query(f"WITH RECURSIVE {_REPORT}, vs AS (SELECT left_out-1 AS i, accuracy AS v FROM ({_DELTAS})), {boot_sql('vs', 0.9, 20)} SELECT {BOUNDS_SQL} FROM bb")
def estimator_bounds(spark, d):
    """Bootstrap bounds of the accuracy over these neighbours."""
    values = _report(spark, d).select((F.col("left_out") - 1).alias("i"), "accuracy")
    return rounded(accuracy.bootstrap_bounds(values, "i", "accuracy", 0.9, 20, TEST_KEY), 6, *BOUNDS)


# Sketches of many rows, and many draws.


@query(f"WITH {_ALL_C}, {project_sql(1200, 2, columns=('x1', 'x2'), table='c')} SELECT draw::INT AS draw, k::INT AS k, round(x1, 6) + 0 AS x1, round(x2, 6) + 0 AS x2 FROM pr")
def rp_project_r1200(spark, d):
    """1,200 projections of the customers, twice."""
    return rounded(mechanisms.project(customers(spark, d), KEY, ["x1", "x2"], 1200, 2, TEST_KEY).select("draw", "k", "x1", "x2"), 6, "x1", "x2")


@query(f"WITH s AS (SELECT s_suppkey AS row_id, s_acctbal/1000 AS x FROM supplier), {project_sql(1, 20000, columns=('x',), table='s')} SELECT draw::INT AS draw, k::INT AS k, round(x, 6) + 0 AS x FROM pr")
def rlc_many_draws(spark, d):
    """20,000 random linear combinations of the suppliers' balances."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias(KEY), (F.col("s_acctbal") / 1000).alias("x"))
    return rounded(mechanisms.project(s, KEY, ["x"], 1, 20_000, TEST_KEY).select("draw", "k", "x"), 6, "x")


# A histogram from batches, one of which comes twice, and from two states that are put together.


@query("WITH t AS (SELECT event_type AS x, (value > 100)::INT AS y FROM events) SELECT x, round(count(*) FILTER (y=0)/(SELECT count(*) FROM t), 9) AS p0, round(count(*) FILTER (y=1)/(SELECT count(*) FROM t), 9) AS p1 FROM t GROUP BY x")
def ede_histogram_batches(spark, d):
    """The joint histogram of all events from stored counts of four batches in two states; the second batch is delivered twice."""
    e = table(spark, d, "events").select((F.col("value") > 100).cast("int").alias("y"), "event_type", F.pmod("event_id", F.lit(4)).alias("batch"))
    states = [HistogramState(spark, _folder(spark)) for _ in range(2)]
    for batch in (0, 1, 2, 3, 1):
        states[batch // 2].update(e.where(F.col("batch") == batch), batch, "y", "event_type")
    found = rounded(combined(states), 9, "p0", "p1")
    if spark.sparkContext.getCheckpointDir():  # the result no longer needs the states then
        found = found.checkpoint()
        for s in states:
            s.drop()
    return found


# Every customer whose key is divisible by 50 as a neighbour, in one plan.


def each_sql(columns: list[str], r: int, eps: float, draws: int, gamma: float = 0.01) -> str:
    """CTEs after c that end in es (left_out and estimates): mechanisms.neighbor_samples and blackbox.estimate_each."""
    d = r * len(columns)
    own = ", ".join(f"p.{c}-e.g*e.{c}" for c in columns)
    c = f"(pow(1+2/sqrt(2-sqrt(3)), {d})-1)"
    return f"""{project_sql(r, draws, 0.0, f'{TEST_KEY}.1', 'c', columns, tag='1')}, {project_sql(r, draws, 0.0, f'{TEST_KEY}.0', 'c', columns, tag='0')},
sm AS (SELECT o.row_id AS left_out, draw*2+1 AS sample_id, 1.0::DOUBLE AS y, x, dummy FROM (SELECT draw, flatten(list([{', '.join(columns)}] ORDER BY k)) AS x, {_dummy(eps)} AS dummy FROM pr1 GROUP BY draw), (SELECT row_id FROM c WHERE row_id % 50 = 0) o
  UNION ALL SELECT e.row_id, e.draw*2, 0.0, flatten(list([{own}] ORDER BY e.k)), FALSE FROM el0 e JOIN pr0 p ON e.draw = p.draw AND e.k = p.k WHERE e.row_id % 50 = 0 GROUP BY e.row_id, e.draw),
sz AS (SELECT left_out, count(*) FILTER (sample_id%4 < 2) AS n1, count(*) FILTER (sample_id%4 >= 2) AS n2, count(*) FILTER (sample_id%4 < 2 AND NOT dummy) AS k1, count(*) FILTER (sample_id%4 >= 2 AND NOT dummy) AS k2,
  ceil(sqrt(k1))::BIGINT AS ro, least(10*(ro+CASE WHEN ro%2 = 0 THEN 1 ELSE 0 END), k1) AS kk FROM sm GROUP BY left_out),
rk AS (SELECT a.left_out, a.sample_id, a.y AS own, b.y, row_number() OVER (PARTITION BY a.left_out, a.sample_id ORDER BY list_distance(a.x, b.x), b.sample_id) AS place
  FROM sm a JOIN sm b ON a.left_out = b.left_out WHERE a.sample_id%4 >= 2 AND NOT a.dummy AND b.sample_id%4 < 2 AND NOT b.dummy),
pd AS (SELECT left_out, sample_id, max(own) AS own, round_even(avg(y), 0) AS guess FROM rk JOIN sz USING (left_out) WHERE place <= kk GROUP BY left_out, sample_id),
ac AS (SELECT left_out, (count(*) FILTER (own = guess)+max(n2-k2))/(count(*)+max(n2-k2)) AS accuracy, max(n1) AS n1, max(n2) AS n2 FROM pd JOIN sz USING (left_out) GROUP BY left_out),
es AS (SELECT left_out, greatest(0, 1-2*exp({eps}::DOUBLE)*(1-accuracy)) AS estimated_delta, accuracy, 2*exp({eps}::DOUBLE)*(12*{c}*sqrt(ln(4/{gamma})/(2*n1))+sqrt(ln(4/{gamma})/(2*n2))) AS radius, n1, n2 FROM ac)"""


_EACH = """SELECT left_out, round(estimated_delta, 7) + 0 AS estimated_delta, round(accuracy, 7) AS accuracy, round(greatest(0, estimated_delta-radius), 7) + 0 AS low, round(least(1, estimated_delta+radius), 7) AS high,
  n1::BIGINT AS training_size, n2::BIGINT AS validation_size FROM es"""


def _each(spark, d, columns: list[str], r: int, draws: int):
    table_samples, neighbors = mechanisms.neighbor_samples(customers(spark, d), KEY, columns, F.col(KEY) % 50 == 0, 0.1, draws, TEST_KEY, r)
    return blackbox.estimate_each(table_samples, neighbors, 0.1)


@query(f"WITH {_ALL_C}, {each_sql(['x1'], 1, 0.1, 100)} {_EACH}")
def neighbor_report(spark, d):
    """One estimate for each of the neighbours, from one sketch of the table and what each row adds to it."""
    return rounded(_each(spark, d, ["x1"], 1, 100), 7, "estimated_delta", "accuracy", "low", "high")


@query(f"WITH {_ALL_C}, {each_sql(['x1', 'x2'], 2, 0.1, 60)} {_EACH}")
def neighbor_report_of_projections(spark, d):
    """The same of two columns and two projections a sample."""
    return rounded(_each(spark, d, ["x1", "x2"], 2, 60), 7, "estimated_delta", "accuracy", "low", "high")


# The same of least squares. The row left out is that with the largest augmented leverage.

_OUT = "o AS (SELECT row_id AS oid, x1 AS o1, x2 AS o2, y AS oy FROM r ORDER BY r.q DESC, row_id LIMIT 1), m0 AS (SELECT row_id, CASE WHEN row_id = oid THEN 0 ELSE x1 END AS x1, CASE WHEN row_id = oid THEN 0 ELSE x2 END AS x2, CASE WHEN row_id = oid THEN 0 ELSE y END AS y FROM m, o)"
_TAGGED = lambda y: SK.replace("sg AS", f"sg{y} AS").replace("FROM pr ", f"FROM pr{y} ")
_LS = f"""{_OUT}, {project_sql(8, 40, key=TEST_KEY + '.1', tag='1')}, {project_sql(8, 40, key=TEST_KEY + '.0', table='m0', tag='0')}, {_TAGGED(1)}, {_TAGGED(0)},
sm AS (SELECT draw*2+1 AS sample_id, 1.0::DOUBLE AS y, [(c*u-b*v)/(a*c-b*b), (a*v-b*u)/(a*c-b*b)] AS x, {_dummy(0.1)} AS dummy FROM sg1 UNION ALL SELECT draw*2, 0.0, [(c*u-b*v)/(a*c-b*b), (a*v-b*u)/(a*c-b*b)], FALSE FROM sg0)"""


def _least_squares(spark, d):
    m, f = fitted(spark, d)
    top = linear.largest_leverage(m, f, KEY).first()[KEY]
    return mechanisms.labelled_least_squares(m, KEY, FEATURES, TARGET, top, 0.1, 40, TEST_KEY, 8)


@query(f"WITH {FIT}, {_LS} {_flat_sql(2)}")
def ls_labelled_samples(spark, d):
    return _flat(_least_squares(spark, d), 2)


@query(f"WITH {FIT}, {_LS}, {estimate_sql(0.1, 2)} {_ES}")
def ls_estimator(spark, d):
    return _halves(_least_squares(spark, d), 0.1)


def _drawn(y: int, source: str) -> str:
    inner = draws_sql(20, 200, source=source).replace(f"'{TEST_KEY}|", f"'{TEST_KEY}.{y}|")
    for n in ("sd", "re", "zs", "dr"):
        inner = inner.replace(f"{n} AS (", f"{n}{y} AS (").replace(f"FROM {source}, sd)", f"FROM {source}, sd{y})").replace("FROM zs, re)", f"FROM zs{y}, re{y})")
    return inner


_ASY = f"""{_OUT}, gn AS (SELECT g11-o1*o1 AS g11, g12-o1*o2 AS g12, g22-o2*o2 AS g22, h1-o1*oy AS h1, h2-o2*oy AS h2, yy-oy*oy AS yy FROM g, o), {_drawn(1, 'g')}, {_drawn(0, 'gn')},
sm AS (SELECT draw*2+1 AS sample_id, 1.0::DOUBLE AS y, [beta_0, beta_1] AS x, {_dummy(0.1)} AS dummy FROM dr1 UNION ALL SELECT draw*2, 0.0, [beta_0, beta_1], FALSE FROM dr0)"""


def _asymptotic(spark, d):
    m, f = fitted(spark, d)
    top = linear.largest_leverage(m, f, KEY).first()[KEY]
    row = linear.row_of(m, KEY, top, ALL)
    return mechanisms.labelled_asymptotic(m, f, f.without(row[:-1], row[-1]), 0.1, 200, TEST_KEY, 20)


@query(f"WITH {FIT}, {_ASY} {_flat_sql(2)}")
def asymptotic_labelled_samples(spark, d):
    return _flat(_asymptotic(spark, d), 2)


@query(f"WITH {FIT}, {_ASY}, {estimate_sql(0.1, 2)} {_ES}")
def asymptotic_estimator(spark, d):
    return _halves(_asymptotic(spark, d), 0.1)


@query()
def mlp_accuracy(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("y"))
    return blackbox.network_accuracy(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), 64)


# Kernels of two normal distributions fitted to two groups of lines.

_PAIR = ["l_quantity", "l_extendedprice"]


def _two_tables(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("l_quantity"), (F.col("l_extendedprice") / 1e4).alias("l_extendedprice"))
    return li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'")


# Root of the first covariance, inverse of the second, and the eigenvalues and axes of 1 - root inverse root, two by two.
_KERNEL = """mo AS (SELECT avg(x) FILTER (f='A')-avg(x) FILTER (f='R') AS s1, avg(y) FILTER (f='A')-avg(y) FILTER (f='R') AS s2,
  covar_samp(x,x) FILTER (f='A') AS a11, covar_samp(x,y) FILTER (f='A') AS a12, covar_samp(y,y) FILTER (f='A') AS a22, covar_samp(x,x) FILTER (f='R') AS b11, covar_samp(x,y) FILTER (f='R') AS b12, covar_samp(y,y) FILTER (f='R') AS b22
  FROM (SELECT l_returnflag AS f, l_quantity/10 AS x, l_extendedprice/1e4 AS y FROM lineitem)),
ke AS (SELECT a11*a22-a12*a12 AS da, b11*b22-b12*b12 AS db, sqrt(a11+a22+2*sqrt(da)) AS t, (a11+sqrt(da))/t AS r11, a12/t AS r12, (a22+sqrt(da))/t AS r22, b22/db AS i11, -b12/db AS i12, b11/db AS i22,
  r11*i11+r12*i12 AS p11, r11*i12+r12*i22 AS p12, r12*i11+r22*i12 AS p21, r12*i12+r22*i22 AS p22, 1-p11*r11-p12*r12 AS k11, -p11*r12-p12*r22 AS k12, 1-p21*r12-p22*r22 AS k22,
  sqrt(pow((k11-k22)/2, 2)+k12*k12) AS h, (k11+k22)/2-h AS a0, (k11+k22)/2+h AS a1, p11*s1+p12*s2 AS v1, p21*s1+p22*s2 AS v2,
  sqrt(k12*k12+pow(a0-k11,2)) AS n0, sqrt(k12*k12+pow(a1-k11,2)) AS n1, abs(k12*v1+(a0-k11)*v2)/n0 AS b0, abs(k12*v1+(a1-k11)*v2)/n1 AS b1,
  0.5*(ln(da)-ln(db))-0.5*(s1*s1*i11+2*s1*s2*i12+s2*s2*i22)+0.001 AS c FROM mo)"""


@query(f"""WITH {_KERNEL}, zs AS (SELECT {z_sql('mc', 'o_orderkey', '0')} AS z0, {z_sql('mc', 'o_orderkey', '1')} AS z1 FROM orders),
vs AS (SELECT greatest(0, 1-exp(a0*z0*z0/2+b0*z0+a1*z1*z1/2+b1*z1+c)) AS v FROM zs, ke) SELECT round(avg(v), 10) AS delta, round(stddev_samp(v)/sqrt(count(*)), 10) AS stderr FROM vs""")
def ndis_mc(spark, d):
    a, b, c = kernels.between(*_two_tables(spark, d), _PAIR)
    return rounded(kernels.estimate(table(spark, d, "orders"), "o_orderkey", a, b, c + 0.001, TEST_KEY, "monte_carlo"), 10, "delta", "stderr")


def _poly(cs, x: str) -> str:
    out = f"{cs[0]!r}::DOUBLE"
    for v in cs[1:]:
        out = f"({out})*{x}+{v!r}::DOUBLE"
    return f"({out})"


def quantile_sql(u: str, name: str) -> str:
    """Select items that end in the normal quantile of the name u."""
    return f"""sqrt(-2*ln({u})) AS {name}_l, sqrt(-2*ln(1-{u})) AS {name}_h, {u}-0.5 AS {name}_q, {name}_q*{name}_q AS {name}_s,
  CASE WHEN {u} < 0.02425 THEN {_poly(INV_C, f'{name}_l')}/{_poly(INV_D, f'{name}_l')} WHEN {u} > 1-0.02425 THEN -{_poly(INV_C, f'{name}_h')}/{_poly(INV_D, f'{name}_h')} ELSE {name}_q*{_poly(INV_A, f'{name}_s')}/{_poly(INV_B, f'{name}_s')} END AS {name}_0,
  ({phi_sql(f'{name}_0')}-{u})*sqrt(2*pi())*exp({name}_0*{name}_0/2) AS {name}_e, {name}_0-{name}_e/(1+{name}_0*{name}_e/2) AS {name}"""


#: Select items that end in v, the mean over the inner coordinate of weight a and slope b, from kz.
INNER_SQL = f"""b*b-2*a*kz AS disc, sqrt(greatest(disc,0)) AS root, least((-b-root)/a, (-b+root)/a) AS lo, greatest((-b-root)/a, (-b+root)/a) AS hi, sqrt(1-a) AS sc, b/(1-a) AS md, exp(kz+b*b/(2*(1-a)))/sc AS front,
  CASE WHEN disc > 0 THEN {phi_sql('hi')}-{phi_sql('lo')} ELSE 0 END AS inner1, CASE WHEN disc > 0 THEN {phi_sql('sc*(hi-md)')}-{phi_sql('sc*(lo-md)')} ELSE 0 END AS inner2, CASE WHEN a > 0 THEN inner1-front*inner2 ELSE (1-inner1)-front*(1-inner2) END AS v"""
_SHIFT = "(i*" + repr(kernels._steps(1)[0]) + "::DOUBLE + " + u_sql("shift", "shift", "0") + ")"


@query(f"""WITH {_KERNEL}, od AS (SELECT CASE WHEN abs(a0) >= abs(a1) THEN a0 ELSE a1 END AS a, CASE WHEN abs(a0) >= abs(a1) THEN b0 ELSE b1 END AS b, CASE WHEN abs(a0) >= abs(a1) THEN a1 ELSE a0 END AS oa, CASE WHEN abs(a0) >= abs(a1) THEN b1 ELSE b0 END AS ob, c FROM ke),
us AS (SELECT shift, {_SHIFT} AS w, w-floor(w) AS u FROM (SELECT o_orderkey AS i FROM orders), range(0,4) t(shift)), zs AS (SELECT shift, {quantile_sql('u', 'z')} FROM us),
kd AS (SELECT shift, a, b, oa*z*z/2+ob*z+c AS kz, {INNER_SQL} FROM zs, od),
sm AS (SELECT shift, avg(least(1, greatest(0, v))) AS m FROM kd GROUP BY shift) SELECT round(avg(m), 9) AS delta, round(stddev_samp(m)/sqrt(count(*)), 9) AS stderr FROM sm""")
def ndis_lattice(spark, d):
    a, b, c = kernels.between(*_two_tables(spark, d), _PAIR)
    return rounded(kernels.estimate(table(spark, d, "orders"), "o_orderkey", a, b, c + 0.001, TEST_KEY, "lattice", 4), 9, "delta", "stderr")


# The radial form of the least-squares spectrum of the most exposed row, at d = 3, r = 20 and eps = 0.01.


def _radial(spark, d, left: bool):
    from privspan.functions.numeric import left_kernel, right_kernel

    m, f = fitted(spark, d)
    top = linear.largest_leverage(m, f, KEY).first()
    return [float(x) for x in (left_kernel if left else right_kernel)(top.p, top.q, 3, 20, 0.01)[:4]]


def _radial_sql(right: bool) -> str:
    l1, l2, l3, c = kernel_sql("p", "q", 3, "20", "0.01", right)
    return f"tp AS (SELECT r.p AS p, r.q AS q FROM r ORDER BY r.q DESC, row_id LIMIT 1), kr AS (SELECT {l1} AS l1, {l2} AS l2, {l3} AS l3, {c} AS c FROM tp)"


_PART = "CASE WHEN t{s} < 0 THEN 1-exp(t{s}) ELSE 0 END"


@query(f"""WITH {FIT}, {_radial_sql(False)}, zs AS (SELECT {', '.join(f"{z_sql('radial', 'o_orderkey', str(j))} AS z{j}" for j in range(3))} FROM orders),
vs AS (SELECT z0*z0*l1/2+c+z1*z1*l2/2+z2*z2*l2/2 AS t, t-l3*z0 AS t0, t+l3*z0 AS t1, ({_PART.format(s=0)}+{_PART.format(s=1)})/2 AS v FROM zs, kr) SELECT round(avg(v), 10) + 0 AS delta, round(stddev_samp(v)/sqrt(count(*)), 10) + 0 AS stderr FROM vs""")
def radial_monte_carlo(spark, d):
    out = kernels.radial_monte_carlo(table(spark, d, "orders"), "o_orderkey", *_radial(spark, d, True), 3, TEST_KEY)
    return rounded(out, 10, "delta", "stderr")


def _shift_sql(d: int, j: int) -> str:
    return f"(i*{kernels._steps(d)[j]!r}::DOUBLE + {u_sql('radial.shift', 'i%16', str(j))})"


@query(f"""WITH {FIT}, {_radial_sql(False)}, us AS (SELECT i, {', '.join(f"{_shift_sql(3, j)} AS w{j}, w{j}-floor(w{j}) AS u{j}" for j in range(3))} FROM (SELECT o_orderkey AS i FROM orders)),
zs AS (SELECT i%16 AS batch, {', '.join(quantile_sql(f'u{j}', f'z{j}') for j in range(3))} FROM us),
vs AS (SELECT batch, z0*z0*l1/2+c+z1*z1*l2/2+z2*z2*l2/2 AS t, t-l3*z0 AS t0, t+l3*z0 AS t1, ({_PART.format(s=0)}+{_PART.format(s=1)})/2 AS v FROM zs, kr), ms AS (SELECT batch, avg(v) AS m FROM vs GROUP BY batch)
SELECT round(avg(m), 9) + 0 AS delta, round(stddev_samp(m)/sqrt(count(*)), 9) + 0 AS stderr FROM ms""")
def radial_lattice(spark, d):
    out = kernels.radial_lattice(table(spark, d, "orders"), "o_orderkey", *_radial(spark, d, True), 3, TEST_KEY)
    return rounded(out, 9, "delta", "stderr")


_REDUCED = "(exp(-{z})-exp(least({a},700)-ln(1-l2))*exp(-(1-l2)*{z}))"


@query(f"""WITH {FIT}, {_radial_sql(True)}, us AS (SELECT i, {_shift_sql(1, 0)} AS w, w-floor(w) AS u FROM (SELECT o_orderkey AS i FROM orders)), zs AS (SELECT i%16 AS batch, {quantile_sql('u', 'x')} FROM us),
vs AS (SELECT batch, c+l1*x*x/2-l3*x AS a0, c+l1*x*x/2+l3*x AS a1, greatest(0, -a0/l2) AS y0, greatest(0, -a1/l2) AS y1, greatest(0, ({_REDUCED.format(z='y0', a='a0')}+{_REDUCED.format(z='y1', a='a1')})/2) AS v FROM zs, kr), ms AS (SELECT batch, avg(v) AS m FROM vs GROUP BY batch)
SELECT round(avg(m), 9) + 0 AS delta, round(stddev_samp(m)/sqrt(count(*)), 9) + 0 AS stderr FROM ms""")
def radial_reduced(spark, d):
    out = kernels.radial_reduced(table(spark, d, "orders"), "o_orderkey", *_radial(spark, d, False), 3, TEST_KEY)
    return rounded(out, 9, "delta", "stderr")


# The first coordinate by panels that are narrow where its square is near the branch point, the other between two roots.


@query(f"""WITH {nodes_sql()}, sx AS (SELECT s_suppkey, s_acctbal/1000 AS x, greatest(0, 6*x/6.16) AS a2 FROM supplier),
nd AS (SELECT *, (14*pow((i+1)/16.0::DOUBLE, 4)+14*pow(i/16.0::DOUBLE, 4))/2+(14*pow((i+1)/16.0::DOUBLE, 4)-14*pow(i/16.0::DOUBLE, 4))/2*nx AS t, (14*pow((i+1)/16.0::DOUBLE, 4)-14*pow(i/16.0::DOUBLE, 4))/2*nw AS part FROM nodes, range(0, 16) r(i)),
ab AS (SELECT s_suppkey, sg*sqrt(a2+t*t) AS a, part*t/sqrt(a2+t*t)*exp(-(a-0.5)*(a-0.5)/4)/sqrt(4*pi()) AS f, sqrt(6.16*t*t+6*greatest(0, -x)) AS root, 0.15*(a-0.5)-1 AS mb, sqrt(0.955::DOUBLE) AS sb FROM sx, nd, (VALUES (1), (-1)) v(sg)),
ou AS (SELECT s_suppkey, sum(f*(1-{phi_sql('(((0.4*a+root)/3-mb)/sb)')}+{phi_sql('(((0.4*a-root)/3-mb)/sb)')})) AS p FROM ab GROUP BY s_suppkey)
SELECT s_suppkey, round(p+{phi_sql('((sqrt(a2)-0.5)/sqrt(2))')}-{phi_sql('((-sqrt(a2)-0.5)/sqrt(2))')}, 8) + 0 AS p FROM ou JOIN sx USING (s_suppkey)""")
def quadratic_form_cdf(spark, d):
    """P(form <= balance / 1000) of a fixed indefinite form of two normals, for every supplier."""
    one = lambda *values: F.array(*[F.lit(v) for v in values])
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), one(0.5, -1.0).alias("m"), one(2.0, 0.3, 0.3, 1.0).alias("c"), one(1.0, 0.2, 0.2, -1.5).alias("f"))
    return rounded(s.select("s_suppkey", quadratic_forms.distribution("x", "m", "c", "f", 2)["below"].alias("p")), 8, "p")


# Slopes of the left spectrum in p at a fixed share s = q - p, with derivatives of the kernel written out.

_SLOPE = f"""WITH {FIT}, {nodes_sql()}, kc AS (SELECT row_id, (s-p+p*p)/((1-p)*(1-p)) AS l1, s/(1-p) AS l2, -sqrt(20*p*s)*sqrt(1-p-s)/((1-p)*(1-p)) AS l3, 0.01+1.5*ln(1-p-s)-2*ln(1-p)-10*p*s/((1-p)*(1-p)) AS c,
  ((2*p-1)*(1-p)+2*(s-p+p*p))/pow(1-p,3) AS d1, s/((1-p)*(1-p)) AS d2, l3*(1/(2*p)-1/(2*(1-p-s))+2/(1-p)) AS d3, -1.5/(1-p-s)+2/(1-p)-10*s*(1+p)/pow(1-p,3) AS dc, l3*l3-2*l1*c AS disc, sqrt(greatest(disc,0)) AS root,
  CASE WHEN disc < 0 THEN 12 ELSE least(12, greatest(-12, (l3-root)/l1)) END AS e1, CASE WHEN disc < 0 THEN 12 ELSE least(12, greatest(-12, (l3+root)/l1)) END AS e2 FROM (SELECT row_id, p, q-p AS s FROM r)),
kb AS (SELECT *, unnest([[-12::DOUBLE, least(e1,e2)], [least(e1,e2), greatest(e1,e2)], [greatest(e1,e2), 12::DOUBLE]]) AS pc FROM kc),
kh AS (SELECT *, pc[1] + (i+0.5)*(pc[2]-pc[1])/8 AS md, (pc[2]-pc[1])/16 AS half FROM kb, range(0,8) t(i) WHERE pc[2] > pc[1]),
kn AS (SELECT *, md+half*nx AS x, c+l1*x*x/2-l3*x AS a, dc+d1*x*x/2-d3*x AS da, greatest(-a/l2, 1e-300) AS z FROM kh, nodes)
SELECT row_id, round(sum(CASE WHEN a < 0 THEN nw*half*exp(-x*x/2)/sqrt(2*pi())*(z*exp(-z)*d2/(1-l2)-exp(a)/(1-l2)*(da+d2/(1-l2))*(1-exp(-(1-l2)*z))) ELSE 0 END), {{digits}}) + 0 AS slope FROM kn GROUP BY row_id"""


@query(_SLOPE.format(digits=6))
def fprime_p(spark, d):
    m, f = fitted(spark, d)
    rows = f.rows(m).withColumn("share", F.col("q") - F.col("p"))
    return rounded(rows.select(KEY, quadrature.left_slope("p", "share", 3, 20, 0.01).alias("slope")), 6, "slope")


@query(_SLOPE.format(digits=6).replace(" AS slope FROM kn", " AS slope, TRUE AS probability_agrees FROM kn"))
def fprime_u(spark, d):
    """The same, and whether the integral over probabilities agrees to 0.001 of the slope's scale."""
    m, f = fitted(spark, d)
    rows = f.rows(m).withColumn("share", F.col("q") - F.col("p"))
    rows = rows.select(KEY, quadrature.left_slope("p", "share", 3, 20, 0.01).alias("slope"), quadrature.left_slope("p", "share", 3, 20, 0.01, by_probability=True).alias("_u"))
    agrees = F.abs(F.col("slope") - F.col("_u")) < 1e-3 * (1 + F.abs("slope"))
    return rounded(rows.select(KEY, "slope", agrees.alias("probability_agrees")), 6, "slope")


# Files, and the feature preparation as a whole.


@query(f"WITH {M} SELECT round(x1, 9) + 0 AS x1, x2, round(y, 9) + 0 AS y FROM m")
def matrix_round_trip(spark, d):
    """The matrix written as text and read back."""
    folder = _folder(spark)
    write_matrix(matrix(spark, d), folder, ALL)
    return rounded(read_matrix(spark, folder, ALL), 9, "x1", "y")


@query("SELECT event_id, event_id // 1000 AS batch_id, event_type, value FROM events WHERE event_id BETWEEN 1500 AND 4499")
def stored_batch_range(spark, d):
    """Events stored by type and batch; a range of ids opens its own batches only."""
    folder = _folder(spark)
    write_batches(table(spark, d, "events").select("event_id", "event_type", "value"), folder, "event_id", 1000, "event_type")
    rows = read_range(spark.read.parquet(folder), "event_id", 1000, 1500, 3000)
    return rows.select("event_id", F.col("batch_id").cast("long").alias("batch_id"), "event_type", "value")


@query("""WITH po AS (SELECT c_nationkey AS fips, sum(c_acctbal) AS poverty, count(*)::DOUBLE AS people FROM customer GROUP BY 1),
inc AS (SELECT n_nationkey AS fips, (1000 + 10*n_regionkey)::DOUBLE AS income FROM nation), hi AS (SELECT s_nationkey AS fips, count(*) FILTER (s_acctbal > 0)::DOUBLE AS insured FROM supplier GROUP BY 1),
rt AS (SELECT c_nationkey AS fips, CASE WHEN c_nationkey % 6 <> 0 THEN avg(length(c_mktsegment)) END AS incidence, CASE c_nationkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'rising' WHEN 2 THEN 'falling' ELSE 'stable' END AS trend FROM customer GROUP BY 1),
mt AS (SELECT s_nationkey AS fips, round(avg(s_acctbal), 4) AS mortality FROM supplier WHERE s_nationkey % 7 <> 0 GROUP BY 1),
j AS (SELECT * FROM po JOIN inc USING (fips) JOIN hi USING (fips) JOIN rt USING (fips) JOIN mt USING (fips))
SELECT fips, round(poverty/people*100000, 3) AS poverty_pc, round(insured/people*100000, 6) AS insured_pc, income, round(coalesce(incidence, (SELECT median(incidence) FROM j)), 9) AS incidence, people,
  CASE WHEN trend = 'falling' THEN 1.0 ELSE 0.0 END::DOUBLE AS falling, CASE WHEN trend = 'rising' THEN 1.0 ELSE 0.0 END::DOUBLE AS rising, round(poverty, 3) AS poverty, insured, 1.0::DOUBLE AS constant, mortality FROM j""")
def county_features(spark, d):
    """The whole preparation, with nations as counties: five tables joined, cleaned, filled, and turned to features."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    poverty = c.groupBy(F.col("c_nationkey").alias("fips")).agg(F.sum("c_acctbal").alias("poverty"), F.count("*").cast("double").alias("people"))
    income = table(spark, d, "nation").select(F.col("n_nationkey").alias("fips"), (1000 + 10 * F.col("n_regionkey")).cast("string").alias("income"))
    insured = s.groupBy(F.col("s_nationkey").alias("fips")).agg(F.count(F.when(F.col("s_acctbal") > 0, 1)).alias("insured"))
    trend = F.element_at(F.array(F.lit("*"), F.lit("rising"), F.lit("falling"), F.lit("stable")), (F.col("fips") % 4 + 1).cast("int"))
    rates = c.groupBy(F.col("c_nationkey").alias("fips")).agg(F.avg(F.length("c_mktsegment")).cast("string").alias("incidence"))
    rates = rates.select("fips", F.when(F.col("fips") % 6 == 0, "*").otherwise(F.col("incidence")).alias("incidence"), trend.alias("trend"))
    deaths = s.groupBy(F.col("s_nationkey").alias("fips")).agg(F.round(F.avg("s_acctbal"), 4).cast("string").alias("mortality"))
    deaths = deaths.select("fips", F.when(F.col("fips") % 7 == 0, "*").otherwise(F.col("mortality")).alias("mortality"))
    out = relational.county_features([poverty, income, insured, rates, deaths], "fips", "people", "incidence", "trend", ["poverty", "insured"], ["income"], "mortality")
    return out.withColumns({"poverty_pc": F.round("poverty_pc", 3), "insured_pc": F.round("insured_pc", 6), "incidence": F.round("incidence", 9), "poverty": F.round("poverty", 3)})
