"""Registered queries and their SQL: sources, linear algebra, spectra, quadrature, samplers, black box and kernels.

Further ones are in calibrated.py, estimated.py, forms.py and releases.py, which this module brings in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from privspan.functions import gx2
from privspan.operators import accuracy, blackbox, calibrate, kernels, linear, mechanisms, quadrature, relational, rng, spectra
from privspan.sources.tables import complete_rows, keyed_counties, table

from .registry import ALL, BOUNDS, BOUNDS_SQL, FEATURES, FIT, KEY, PR, QUERIES, SK, SQL, TARGET, TEST_KEY, M, boot_sql, erf_sql, fitted, matrix, nodes_sql, phi_sql, project_sql, q_sql, query, rounded, rounded_projection, scalars, u_sql, z_sql

# Sources, projections, joins.


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def scan_project_filter(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT lpad(n_regionkey::VARCHAR, 2, '0') || lpad(c_nationkey::VARCHAR, 3, '0') AS fips, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def fips_key(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return keyed_counties(joined.select("n_regionkey", "c_nationkey", "c_custkey"), "n_regionkey", "c_nationkey")


@query("""SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS kind FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier""")
def union_sources(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return relational.union_sources([c, s])


@query("""SELECT user_id, (count(*) FILTER (event_type='view') + count(*) FILTER (event_type='click'))::BIGINT AS looks,
  (count(*) FILTER (event_type='signup') + count(*) FILTER (event_type='purchase'))::BIGINT AS deeds, count(*)::BIGINT AS every FROM events GROUP BY user_id""")
def row_sum_counters(spark, d):
    kinds = ["view", "click", "signup", "purchase", "error"]
    e = table(spark, d, "events").groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in kinds])
    return e.select("user_id", relational.row_sum(["view", "click"], "looks"), relational.row_sum(["signup", "purchase"], "deeds"), relational.row_sum(kinds, "every"))


@query("""SELECT value, 1.0::DOUBLE AS constant, CASE WHEN event_type <> 'error' THEN user_id::DOUBLE END AS target FROM events WHERE event_type <> 'error' AND value IS NOT NULL""")
def drop_null_rows(spark, d):
    e = table(spark, d, "events").withColumn("target", F.when(F.col("event_type") != "error", F.col("user_id").cast("double")))
    return complete_rows(e, "value", "target")


@query("""SELECT n_nationkey, n_name, r_name, customers, suppliers FROM nation JOIN region ON n_regionkey = r_regionkey
JOIN (SELECT c_nationkey, count(*)::BIGINT AS customers FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
JOIN (SELECT s_nationkey, count(*)::BIGINT AS suppliers FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def inner_join_chain(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    base = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return relational.join_chain([base, c, s], "n_nationkey")



@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)
SELECT c_custkey, coalesce(v, (SELECT median(v) FROM t)) AS v FROM t""")
def coerce_median_fill(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 17 == 0, "*").otherwise(F.col("c_acctbal").cast("string")).alias("v"))
    return relational.fill_median(relational.coerce(t, ["v"]), ["v"])


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS falling, CASE o_orderstatus WHEN 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS rising FROM orders""")
def indicator_columns(spark, d):
    return relational.indicators(table(spark, d, "orders"), "o_orderstatus", {"falling": "F", "rising": "O"}).select("o_orderkey", "falling", "rising")


@query("""SELECT c_nationkey, round(sum(c_acctbal) / count(*) * 100000, 2) AS balance_pc FROM customer GROUP BY 1""")
def per_capita(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("balance"), F.count("*").alias("people"))
    return relational.per_capita(c, ["balance"], "people").select("c_nationkey", F.round("balance_pc", 2).alias("balance_pc"))


@query("SELECT event_id, event_id // 1000 AS batch_id, value FROM events WHERE event_id BETWEEN 2500 AND 7499")
def batch_range_read(spark, d):
    from privspan.sources.tables import read_range

    e = table(spark, d, "events").withColumn("batch_id", F.expr("event_id div 1000"))
    return read_range(e, "event_id", 1000, 2500, 5000).select("event_id", "batch_id", "value")


@query("SELECT count(*)::BIGINT AS cardinality FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount < 0.02)")
def intersect_cardinality(spark, d):
    li = table(spark, d, "lineitem")
    return relational.common_values(li.where("l_quantity > 45").select("l_partkey"), li.where("l_discount < 0.02").select("l_partkey"))


@query("SELECT vec_id FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) < 0.3")
def prune_by_inf_norm(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return relational.within_norm(e, "x", 0.3).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0")
def filter_dummy(spark, d):
    x = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda _: F.lit(relational.SENTINEL))).otherwise(F.col("embedding").cast("array<double>"))
    return relational.without_dummies(table(spark, d, "embeddings").select("vec_id", x.alias("x")), "x").select("vec_id")


@query("SELECT vec_id AS sample_id, 1.0::DOUBLE AS y FROM embeddings WHERE label >= 5 UNION ALL SELECT vec_id, 0.0 FROM embeddings WHERE label < 5")
def stack_samples(spark, d):
    e = table(spark, d, "embeddings")
    one = lambda rows, y: rows.select(F.col("vec_id").alias("sample_id"), F.lit(y).alias("y"))
    return relational.union_sources([one(e.where("label >= 5"), 1.0), one(e.where("label < 5"), 0.0)])


@query("SELECT l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY 1, 2, 3")
def external_sort(spark, d):
    return relational.sorted_rows(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity")


@query("SELECT c_custkey, (c_custkey % 4)::VARCHAR || ',' || c_nationkey::VARCHAR AS text, CASE WHEN c_custkey % 4 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS third, 3.0::DOUBLE * pow(2, c_nationkey) AS power, 1.5::DOUBLE * (c_nationkey + 1) * 2 AS multiple FROM customer")
def sequences_and_vectors(spark, d):
    c = table(spark, d, "customer")
    vector = relational.standard_vector(4, (F.col("c_custkey") % 4).cast("int"))
    return c.select("c_custkey", relational.joined_text([F.col("c_custkey") % 4, F.col("c_nationkey")]).alias("text"), F.element_at(vector, 3).alias("third"), relational.geometric(2.0, 3.0, 25, F.col("c_nationkey")).alias("power"), relational.multiples(2.0, 1.5, F.col("c_nationkey")).alias("multiple"))


# Linear algebra.


@query(f"WITH {M} SELECT row_id, round(x1/(SELECT sqrt(sum(x1*x1)) FROM m), 10) + 0 AS x1, round(x2/(SELECT sqrt(sum(x2*x2)) FROM m), 10) + 0 AS x2, round(y/(SELECT sqrt(sum(y*y)) FROM m), 10) + 0 AS y FROM m")
def normalize_by_features(spark, d):
    return rounded(linear.normalize_features(matrix(spark, d), ALL), 10, *ALL)


@query(f"WITH {M} SELECT row_id, round(x1/sqrt(x1*x1+x2*x2), 10) + 0 AS x1, round(x2/sqrt(x1*x1+x2*x2), 10) + 0 AS x2, sign(y)::DOUBLE AS y FROM m")
def normalize_by_sample(spark, d):
    return rounded(linear.normalize_rows(matrix(spark, d), FEATURES, TARGET), 10, "x1", "x2")


@query(f"WITH {M} SELECT count(*) AS n, round(sum(x1*x1),4) AS g_0_0, round(sum(x1*x2),4) AS g_0_1, round(sum(x1*y),4) AS g_0_2, round(sum(x2*x2),4) AS g_1_1, round(sum(x2*y),4) AS g_1_2, round(sum(y*y),4) AS g_2_2 FROM m")
def gram_matrix(spark, d):
    g = linear.gram(matrix(spark, d), ALL)
    return rounded(g, 4, *[c for c in g.columns if c != "n"])


@query("SELECT label, round(sum(embedding[1]::DOUBLE*embedding[2]::DOUBLE), 6) + 0 AS g_0_1, round(sum(embedding[64]::DOUBLE*embedding[64]::DOUBLE), 6) + 0 AS g_63_63 FROM embeddings GROUP BY label")
def gram_embeddings_by_label(spark, d):
    x = lambda i: F.element_at("embedding", i).cast("double")
    e = table(spark, d, "embeddings").groupBy("label").agg(F.sum(x(1) * x(2)).alias("g_0_1"), F.sum(x(64) * x(64)).alias("g_63_63"))
    return rounded(e, 6, "g_0_1", "g_63_63")


@query("WITH e AS (SELECT embedding FROM embeddings) SELECT i::INT AS i, round(sum(embedding[i+1]::DOUBLE*embedding[i+1]::DOUBLE), 6) AS diagonal FROM e, range(0,64) t(i) GROUP BY i")
def gram_embeddings_diagonal(spark, d):
    g = linear.gram_of_arrays(table(spark, d, "embeddings"), "embedding", 64)
    rows = table(spark, d, "embeddings").limit(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(g[i, i])).alias("diagonal")) for i in range(64)])).alias("s"))
    return rounded(rows.select("s.*"), 6, "diagonal")


@query(f"WITH {FIT} SELECT max(n) AS n, round(max(b1), 8) + 0 AS b1, round(max(b2), 8) + 0 AS b2 FROM r")
def ols_xopt(spark, d):
    _, f = fitted(spark, d)
    return scalars(spark, d, {"b1": f.beta[0], "b2": f.beta[1]}, 8)


@query(f"WITH {FIT} SELECT row_id, round(w, 6) + 0 AS w FROM r")
def residuals(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, "w"), 6, "w")


@query(f"WITH {FIT} SELECT row_id, round(p, 10) AS p FROM r")
def leverage_scores(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, "p"), 10, "p")


@query(f"WITH {FIT} SELECT row_id, round(q, 10) AS q FROM r")
def augmented_leverage(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, "q"), 10, "q")


@query(f"WITH {FIT} SELECT row_id, round(p, 10) AS p, round(q, 10) AS q, round(q-p, 10) + 0 AS residual_share FROM r ORDER BY r.q DESC, row_id LIMIT 1")
def largest_leverage(spark, d):
    m, f = fitted(spark, d)
    return rounded(linear.largest_leverage(m, f, KEY), 10, "p", "q", "residual_share")


@query(f"WITH {M} SELECT round(max(sqrt(x1*x1+x2*x2+y*y)), 9) AS largest_l2 FROM m")
def largest_l2(spark, d):
    return rounded(linear.largest_norm(matrix(spark, d), ALL), 9, "largest_l2")


@query(f"WITH {FIT} SELECT row_id, round(abs(w)*sqrt(pow(i11*x1+i12*x2,2)+pow(i12*x1+i22*x2,2))/(1-p), 10) AS sensitivity FROM r ORDER BY abs(w)*sqrt(pow(i11*x1+i12*x2,2)+pow(i12*x1+i22*x2,2))/(1-p) DESC, row_id LIMIT 1")
def ls_sensitivity(spark, d):
    m, f = fitted(spark, d)
    return rounded(linear.sensitivity(m, f, KEY), 10, "sensitivity")


@query(f"WITH {M} SELECT round(least(sqrt(sum(x1*x1)-max(x1*x1)), sqrt(sum(x2*x2)-max(x2*x2)), sqrt(sum(y*y)-max(y*y))), 7) AS c FROM m")
def isit18_constant(spark, d):
    return rounded(linear.least_column_rest(matrix(spark, d), ALL), 7, "c")


@query(f"WITH {M} SELECT round(sqrt(max(x1*x1+x2*x2+y*y)*4*(sqrt(2*300*ln(4/1e-6))+ln(4/1e-6))/1.0), 7) AS c FROM m")
def alt19_constant(spark, d):
    return rounded(linear.added_rows_constant(matrix(spark, d), ALL, 300, 1.0, 1e-6), 7, "c")


@query(f"WITH {FIT} SELECT row_id, round(b1-w/(1-p)*(i11*x1+i12*x2), 7) + 0 AS b1, round(b2-w/(1-p)*(i12*x1+i22*x2), 7) + 0 AS b2 FROM r")
def neighbor_xopt(spark, d):
    m, f = fitted(spark, d)
    b1, b2 = f.neighbor_beta()
    return rounded(f.rows(m).select(KEY, b1.alias("b1"), b2.alias("b2")), 7, "b1", "b2")


@query(f"WITH {FIT} SELECT row_id, round(rss-w*w/(1-p), 4) AS rss FROM r")
def neighbor_residual_norm(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, f.neighbor_rss().alias("rss")), 4, "rss")


@query(f"WITH {FIT} SELECT row_id, round(-ln(1-p)+2*ln(1-w*w/((1-p)*rss)), 9) + 0 AS log_ratio FROM r")
def logdet_ratio(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, f.log_det_ratio().alias("log_ratio")), 9, "log_ratio")


@query(f"WITH {FIT} SELECT row_id, round(1/(rss-w*w/(1-p)), 9) AS c1, round((-w*w/(1-p))/(rss*(rss-w*w/(1-p))), 12) + 0 AS c2 FROM r")
def asymptotic_constants(spark, d):
    m, f = fitted(spark, d)
    rest = f.neighbor_rss()
    return f.rows(m).select(KEY, F.round(1 / rest, 9).alias("c1"), (F.round((rest - f.rss) / (f.rss * rest), 12) + 0.0).alias("c2"))


@query(f"WITH {FIT} SELECT k::INT AS r, round((max(i11)+max(i22))*max(rss)/k, 9) AS error FROM r, (VALUES (10),(100),(300)) t(k) GROUP BY k")
def theoretical_accuracy(spark, d):
    m, f = fitted(spark, d)
    return rounded(linear.asymptotic_error(m, f, [10, 100, 300]), 9, "error")


@query(f"""WITH {FIT}, ev AS (SELECT (g11+g22)/2 - sqrt(pow((g11-g22)/2, 2) + g12*g12) AS lam FROM s), lv AS (SELECT max(p) AS own FROM r),
k AS (SELECT k FROM ev, range(1, (ceil(lam/400))::BIGINT) t(k))
SELECT round(greatest((SELECT own FROM lv), coalesce((SELECT max(pow(1.1, -k)*CASE WHEN lam-k*400 > 400 THEN 400/(lam-k*400) ELSE 1 END) FROM k, ev), 0), (SELECT pow(1.1, -ceil(lam/400)) FROM ev)), 9) AS bound""")
def smooth_leverage_bound(spark, d):
    m, f = fitted(spark, d)
    return rounded(linear.smooth_leverage_bound(m, f, 20.0, 1.1), 9, "bound")


# Spectra.

_RHO = "1/(1-p)"
_T = f"(2*(0.001+ln({_RHO})*15)/({_RHO}-1))"


@query(f"WITH {FIT} SELECT row_id, round(p, 10) AS p, round({q_sql(15, _T + '/2')}-exp(0.001)*{q_sql(15, _T + '/2/(1-p)')}, 8) + 0 AS delta FROM r ORDER BY r.p DESC, row_id LIMIT 10")
def rp_spectrum_top10(spark, d):
    m, f = fitted(spark, d)
    top = f.rows(m).select(KEY, "p").orderBy(F.desc("p"), KEY).limit(10)
    return rounded(top.withColumn("delta", spectra.projection(0.001, "p", 30)), 8, "delta").withColumn("p", F.round("p", 10))


@query(f"WITH {FIT} SELECT row_id, round({q_sql(15, _T + '/2')}-exp(0.001)*{q_sql(15, _T + '/2/(1-p)')}, 8) + 0 AS delta FROM r")
def rp_spectrum_all_rows(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, spectra.projection(0.001, "p", 30).alias("delta")), 8, "delta")


# Variances 1 and 1-p: both directions, with g = 1/sqrt(1-p); r below is the crossing point.
def _kd_sql(eps: str) -> str:
    up = f"sqrt((2*({eps})-ln(1-p))/p)"
    down = f"sqrt(greatest((-ln(1-p)-2*({eps}))/p, 0))"
    first = f"(2*(1-{phi_sql(up + '*sqrt(1-p)')})-exp({eps})*2*(1-{phi_sql(up)}))"
    second = f"((2*{phi_sql(down)}-1)-exp({eps})*(2*{phi_sql(down + '*sqrt(1-p)')}-1))"
    return f"greatest(0, {first}, CASE WHEN -ln(1-p) > 2*({eps}) THEN {second} ELSE 0 END)"


@query(f"WITH {FIT} SELECT row_id, round({_kd_sql('0.00001')}, 8) + 0 AS delta FROM r")
def delta_kd_rlc_all_rows(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, spectra.leverage_combination(0.00001, "p").alias("delta")), 8, "delta")


@query(f"WITH {FIT}, e AS (SELECT r.*, eps FROM r, (VALUES (0.0001::DOUBLE),(0.001),(0.01)) t(eps)) SELECT row_id, eps, round({_kd_sql('eps')}, 8) + 0 AS delta FROM e")
def delta_kd_rlc_eps_grid(spark, d):
    m, f = fitted(spark, d)
    rows = spectra.sweep(f.rows(m), eps=[0.0001, 0.001, 0.01])
    return rounded(rows.select(KEY, "eps", spectra.leverage_combination("eps", "p").alias("delta")), 8, "delta")


@query(f"WITH {FIT} SELECT row_id, eps, round({_kd_sql('eps')}, 8) + 0 AS delta FROM r, (VALUES (0.0001::DOUBLE),(0.001),(0.01)) t(eps)")
def delta_kd_rlc_eps_grid_all_rows(spark, d):
    m, f = fitted(spark, d)
    rows = spectra.sweep(f.rows(m), eps=[0.0001, 0.001, 0.01])
    return rounded(rows.select(KEY, "eps", spectra.leverage_combination("eps", "p").alias("delta")), 8, "delta")


@query(f"WITH {FIT} SELECT row_id, round(least(1, 10*{_kd_sql('0.00001')}), 7) + 0 AS delta FROM r")
def delta_rp_sequential(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, spectra.sequential(0.0001, "p", 10).alias("delta")), 7, "delta")


_IX = "(SELECT (sum(y*y)+1)/(sum(CASE WHEN row_id % 100 = 0 THEN 0 ELSE y*y END)+1) AS rho FROM m)"


@query(f"WITH {M}, i AS {_IX}, t AS (SELECT rho, 2*(0.01+ln(rho)*5)/(rho-1) AS t FROM i) SELECT round(rho, 9) AS rho, round({q_sql(5, 't/2')}-exp(0.01)*{q_sql(5, 'rho*t/2')}, 8) + 0 AS delta FROM t")
def rp_spectrum_index_set(spark, d):
    m = matrix(spark, d)
    kept = F.when(F.col(KEY) % 100 == 0, 0.0).otherwise(F.col("y") * F.col("y"))
    one = m.agg(((F.sum(F.col("y") * F.col("y")) + 1) / (F.sum(kept) + 1)).alias("rho"))
    return one.select(F.round("rho", 9).alias("rho"), (F.round(spectra.projection_by_ratio(0.01, "rho", 10), 8) + 0.0).alias("delta"))


@query(f"WITH t AS (SELECT p_partkey, p_size/100.0 AS t FROM part), u AS (SELECT p_partkey, 1/(t*t) AS rho, 2*(1-ln(t)*10)/(1/(t*t)-1) AS s FROM t) SELECT p_partkey, round({q_sql(5, 's/2')}-exp(1.0::DOUBLE)*{q_sql(5, 'rho*s/2')}, 8) + 0 AS delta FROM u")
def isotropic_scaling(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("t"))
    return p.select("p_partkey", (F.round(spectra.isotropic_scaling(1.0, "t", 10), 8) + 0.0).alias("delta"))


_MS = "SELECT c_custkey, 1 + abs(c_acctbal)/1000 AS sigma FROM customer"


@query(f"WITH t AS ({_MS}) SELECT c_custkey, round(greatest(0, {phi_sql('0.5/sigma*2-0.5*sigma/2')}-exp(0.5)*{phi_sql('-0.5/sigma*2-0.5*sigma/2')}), 9) + 0 AS delta FROM t")
def delta_mean_shift(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (1 + F.abs("c_acctbal") / 1000).alias("sigma"))
    return c.select("c_custkey", (F.round(spectra.mean_shift(0.5, "sigma", 2.0, 1.0), 9) + 0.0).alias("delta"))


@query(f"WITH t AS ({_MS}), v AS (SELECT c_custkey, 1/sigma AS c FROM t) SELECT c_custkey, round(greatest(0, {phi_sql('c/2-0.1/c')}-exp(0.1)*{phi_sql('-c/2-0.1/c')}), 9) + 0 AS delta FROM v")
def gaussian_mechanism_delta(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (1 / (1 + F.abs("c_acctbal") / 1000)).alias("c"))
    return c.select("c_custkey", (F.round(spectra.gaussian_mechanism(0.1, "c"), 9) + 0.0).alias("delta"))


_TV = """WITH t AS (SELECT p_partkey, 1.1::DOUBLE + p_size/25.0 AS s1, 1.0::DOUBLE AS s2, p_retailprice/2000 AS mu FROM part),
v AS (SELECT *, s1/s2 AS g, mu/(s2*(s1*s1/(s2*s2)-1)) AS m FROM t),
k AS (SELECT *, m*m+(2*0.1+2*ln(g)+mu*mu/(s1*s1))/(1-1/(g*g)) AS up, m*m+(2*ln(g)-2*0.1+mu*mu/(s1*s1))/(1-1/(g*g)) AS dn FROM v)"""


@query(f"{_TV}, l AS (SELECT *, sqrt(greatest(up,0)) AS r FROM k) SELECT p_partkey, round(greatest(0, {phi_sql('g*m-r/g')}+{phi_sql('-g*m-r/g')}-exp(0.1)*({phi_sql('m-r')}+{phi_sql('-m-r')})), 9) + 0 AS delta FROM l")
def delta_1d_two_variance(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.lit(1.1) + F.col("p_size") / 25.0).alias("s1"), (F.col("p_retailprice") / 2000).alias("mu"))
    return p.select("p_partkey", (F.round(spectra.two_variance(0.1, "s1", 1.0, "mu"), 9) + 0.0).alias("delta"))


@query(f"{_TV}, l AS (SELECT *, sqrt(greatest(dn,0)) AS r FROM k) SELECT p_partkey, CASE WHEN dn > 0 THEN round(greatest(0, {phi_sql('r-m')}-{phi_sql('-r-m')}-exp(0.1)*({phi_sql('r/g-g*m')}-{phi_sql('-r/g-g*m')})), 9) + 0 ELSE 0 END AS delta FROM l")
def delta_1d_two_variance_reverse(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.lit(1.1) + F.col("p_size") / 25.0).alias("s1"), (F.col("p_retailprice") / 2000).alias("mu"))
    return p.select("p_partkey", (F.round(spectra.two_variance_reverse(0.1, "s1", 1.0, "mu"), 9) + 0.0).alias("delta"))


_ZM = "WITH t AS (SELECT p_partkey, 1.1::DOUBLE + p_size/25.0 AS g FROM part), k AS (SELECT *, sqrt((2*0.1+2*ln(g))/(1-1/(g*g))) AS ru, sqrt(greatest((2*ln(g)-2*0.1)/(1-1/(g*g)),0)) AS rd FROM t)"


@query(f"{_ZM} SELECT p_partkey, round(greatest(0, 2*{phi_sql('-ru/g')}-exp(0.1)*2*{phi_sql('-ru')}), 9) + 0 AS delta FROM k")
def delta_zero_mean_variance(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.lit(1.1) + F.col("p_size") / 25.0).alias("g"))
    return p.select("p_partkey", (F.round(spectra.zero_mean(0.1, "g", 1.0), 9) + 0.0).alias("delta"))


@query(f"{_ZM} SELECT p_partkey, round(greatest(0, 2*{phi_sql('rd')}-1-exp(0.1)*(2*{phi_sql('rd/g')}-1)), 9) + 0 AS delta FROM k")
def delta_zero_mean_variance_reverse(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.lit(1.1) + F.col("p_size") / 25.0).alias("g"))
    return p.select("p_partkey", (F.round(spectra.zero_mean_reverse(0.1, "g", 1.0), 9) + 0.0).alias("delta"))


@query(f"""WITH n AS (SELECT o_orderpriority AS a, sqrt(sum(o_totalprice*o_totalprice)) AS x FROM orders GROUP BY 1),
b AS (SELECT p.a, q.a AS b, greatest(p.x,q.x)/least(p.x,q.x) AS g FROM n p JOIN n q ON p.a < q.a),
k AS (SELECT *, sqrt((2*0.01+2*ln(g))/(1-1/(g*g))) AS ru, sqrt(greatest((2*ln(g)-2*0.01)/(1-1/(g*g)),0)) AS rd FROM b)
SELECT a, b, round(greatest(0, 2*{phi_sql('-ru/g')}-exp(0.01)*2*{phi_sql('-ru')}, 2*{phi_sql('rd')}-1-exp(0.01)*(2*{phi_sql('rd/g')}-1)), 7) + 0 AS delta FROM k""")
def delta_1d_rlc(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("a")).agg(F.sqrt(F.sum(F.col("o_totalprice") * F.col("o_totalprice"))).alias("x"))
    pairs = n.join(n.select(F.col("a").alias("b"), F.col("x").alias("z")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", (F.round(spectra.linear_combination(0.01, "x", "z"), 7) + 0.0).alias("delta"))


def _legacy_sql(eps: float, r: int) -> str:
    a = f"(0.5*ln(1-p)*{r})"
    e1, e2 = f"sqrt(greatest(({eps}-{a})/({r}*p),0))", f"sqrt(greatest(({eps}-{a})*(1-p)/({r}*p),0))"
    e3, e4 = f"sqrt(greatest((-{eps}-{a})/({r}*p),0))", f"sqrt(greatest(({eps}+{a})*(p-1)/({r}*p),0))"
    return f"least(1, greatest(0, 1-exp({eps})+exp({eps})*{erf_sql(e1)}-{erf_sql(e2)}, CASE WHEN -{eps}-{a} >= 0 THEN {erf_sql(e3)}-exp({eps})*{erf_sql(e4)} ELSE 0 END))"


@query(f"WITH {FIT} SELECT row_id, round({_legacy_sql(0.0001, 3)}, 8) + 0 AS delta FROM r")
def legacy_rp_erf(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, spectra.projection_legacy(0.0001, "p", 3).alias("delta")), 8, "delta")


@query(f"WITH {FIT} SELECT row_id, round(coalesce((SELECT max(2.0*pow(0.9, k)*sqrt(greatest(4-1/(pow(1.5, k)*p), 0))) FROM range(0, 264) t(k)), 0), 9) AS bound FROM r")
def f_smooth(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, spectra.f_smooth(4.0, 1.5, 0.9, 2.0, "p").alias("bound")), 9, "bound")


@query("SELECT label, round(greatest(0, 1-2*exp(0.01)*(1-greatest(avg((vec_id % 3 = 0)::INT), avg((vec_id % 3 <> 0)::INT)))), 9) + 0 AS delta FROM embeddings GROUP BY label")
def accuracy_to_delta(spark, d):
    e = table(spark, d, "embeddings").groupBy("label").agg(F.greatest(F.avg((F.col("vec_id") % 3 == 0).cast("int")), F.avg((F.col("vec_id") % 3 != 0).cast("int"))).alias("acc"))
    return e.select("label", (F.round(spectra.accuracy_to_delta("acc", 0.01), 9) + 0.0).alias("delta"))


# Quadrature: d = 3, so nu = 1 and Q(1, z) = e^-z.


def _pq_sql(kernel: str, f: str, limit: str = "true") -> str:
    return f"""WITH {FIT}, {nodes_sql()}, k AS (SELECT row_id, {kernel} FROM r WHERE {limit}),
c AS (SELECT *, sqrt(greatest(l3*l3-2*l1*c,0)) AS root, l3*l3-2*l1*c AS disc FROM k),
e AS (SELECT *, CASE WHEN disc < 0 THEN 12 ELSE least(12, greatest(-12, (l3-root)/l1)) END AS e1, CASE WHEN disc < 0 THEN 12 ELSE least(12, greatest(-12, (l3+root)/l1)) END AS e2 FROM c),
b AS (SELECT *, unnest([[-12::DOUBLE, least(e1,e2)], [least(e1,e2), greatest(e1,e2)], [greatest(e1,e2), 12::DOUBLE]]) AS pc FROM e),
h AS (SELECT *, pc[1] + (i+0.5)*(pc[2]-pc[1])/8 AS mid, (pc[2]-pc[1])/16 AS half FROM b, range(0,8) t(i) WHERE pc[2] > pc[1]),
n AS (SELECT *, mid+half*nx AS x FROM h, nodes), a AS (SELECT *, c+l1*x*x/2-l3*x AS a FROM n)
SELECT row_id, round(least(1, greatest(0, sum(nw*half*exp(-x*x/2)/sqrt(2*pi())*({f})))), 7) + 0 AS delta FROM a GROUP BY row_id"""


_LEFT = "(q-2*p+p*p)/((1-p)*(1-p)) AS l1, (q-p)/(1-p) AS l2, -sqrt(20*p*(q-p))*sqrt(1-q)/((1-p)*(1-p)) AS l3, 0.01+1.5*ln(1-q)-2*ln(1-p)-10*p*(q-p)/((1-p)*(1-p)) AS c"
_RIGHT = "(2*p-p*p-q)/(1-q) AS l1, -(q-p)/(1-q) AS l2, sqrt(20*p*(q-p))*(1-p)/(1-q) AS l3, 0.01+2*ln(1-p)-1.5*ln(1-q)-10*p*(q-p)/(1-q) AS c"
_F_LEFT = "CASE WHEN a < 0 THEN (1-exp(a/l2))-exp(a)/(1-l2)*(1-exp((1-l2)*a/l2)) ELSE 0 END"
_F_RIGHT = "exp(least(a,700)*0)*(CASE WHEN a > 0 THEN exp(a/l2)-exp(a)/(1-l2)*exp((1-l2)*a/l2) ELSE 1-exp(a)/(1-l2) END)"


@query(_pq_sql(_LEFT, _F_LEFT))
def delta_pq_left(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, quadrature.left("p", "q", 3, 20, 0.01).alias("delta")), 7, "delta")


@query(_pq_sql(_RIGHT, _F_RIGHT))
def delta_pq_right(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, quadrature.right("p", "q", 3, 20, 0.01).alias("delta")), 7, "delta")


@query(_pq_sql(_LEFT, _F_LEFT, "true"))
def delta_pq_left_all_rows(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, quadrature.left("p", "q", 3, 20, 0.01).alias("delta")), 7, "delta")


@query(_pq_sql(_RIGHT, _F_RIGHT, "true"))
def delta_pq_right_all_rows(spark, d):
    m, f = fitted(spark, d)
    return rounded(f.rows(m).select(KEY, quadrature.right("p", "q", 3, 20, 0.01).alias("delta")), 7, "delta")


# Samplers.


@query(f"WITH {M}, {project_sql(3, 2)} {PR}")
def rp_project(spark, d):
    return rounded_projection(mechanisms.project(matrix(spark, d), KEY, ALL, 3, 2, TEST_KEY))


@query(f"WITH {M}, {project_sql(3, 2, 2.5)} {PR}")
def rp_project_noise(spark, d):
    return rounded_projection(mechanisms.project(matrix(spark, d), KEY, ALL, 3, 2, TEST_KEY, 2.5))


@query(f"WITH {M}, {project_sql(8, 3)}, {SK} SELECT draw::INT AS draw, round((c*u-b*v)/(a*c-b*b), 7) + 0 AS b1, round((a*v-b*u)/(a*c-b*b), 7) + 0 AS b2 FROM sg")
def sketch_ls(spark, d):
    solved = mechanisms.sketch_least_squares(matrix(spark, d), KEY, FEATURES, TARGET, 8, 3, TEST_KEY)
    return rounded(solved.select("draw", F.element_at("beta", 1).alias("b1"), F.element_at("beta", 2).alias("b2")), 7, "b1", "b2")


@query(f"""WITH {FIT}, l AS (SELECT max(b1) AS b1, max(b2) AS b2, sqrt(max(rss)/20*max(i11)) AS l11, max(rss)/20*max(i12)/sqrt(max(rss)/20*max(i11)) AS l21, max(rss)/20*max(i22) AS c22 FROM r),
z AS (SELECT id, {z_sql('beta', 'id', '0')} AS z0, {z_sql('beta', 'id', '1')} AS z1 FROM range(0,100) t(id))
SELECT id AS draw, round(b1+l11*z0, 7) + 0 AS beta_0, round(b2+l21*z0+sqrt(c22-l21*l21)*z1, 7) + 0 AS beta_1 FROM z, l""")
def asymptotic_ls_draws(spark, d):
    m, f = fitted(spark, d)
    return rounded(mechanisms.asymptotic_least_squares(m, f, 20, 100, TEST_KEY), 7, "beta_0", "beta_1")


@query(f"""WITH {FIT}, l AS (SELECT max(b1) AS b1, max(b2) AS b2 FROM r), z AS (SELECT id, {z_sql('output', 'id', '0')} AS z0, {z_sql('output', 'id', '1')} AS z1 FROM range(0,100) t(id))
SELECT id AS draw, round(b1+0.5*z0, 7) + 0 AS beta_0, round(b2+0.5*z1, 7) + 0 AS beta_1 FROM z, l""")
def gaussian_ls_draws(spark, d):
    m, f = fitted(spark, d)
    return rounded(mechanisms.output_noise(m, f, 0.5, 100, TEST_KEY), 7, "beta_0", "beta_1")


# Accuracy.


@query(f"WITH {M}, {project_sql(6, 4)}, t AS (SELECT sqrt(sum((x2-x1)*(x2-x1))) AS d10, sqrt(sum((y-x1)*(y-x1))) AS d20, sqrt(sum((y-x2)*(y-x2))) AS d21 FROM m) SELECT draw::INT AS draw, round((sqrt(sum((x2-x1)*(x2-x1))/6)/max(d10)+sqrt(sum((y-x1)*(y-x1))/6)/max(d20)+sqrt(sum((y-x2)*(y-x2))/6)/max(d21))/3, 7) AS ratio FROM pr, t GROUP BY draw")
def rp_pairwise_distance_acc(spark, d):
    m = matrix(spark, d)
    return rounded(accuracy.distance_ratios(m, mechanisms.project(m, KEY, ALL, 6, 4, TEST_KEY), ALL, 6), 7, "ratio")



@query(f"WITH {M}, {project_sql(6, 4)}, ex AS (SELECT unnest([{', '.join(f'sum({a}*{b})' for a in ALL for b in ALL)}]) AS x, unnest(range(0,9)) AS c FROM m), ap AS (SELECT draw, unnest([{', '.join(f'sum({a}*{b})/6' for a in ALL for b in ALL)}]) AS z, unnest(range(0,9)) AS c FROM pr GROUP BY draw) SELECT draw::INT AS draw, round(covar_samp(x, z)/(stddev_pop(x)*stddev_pop(z)), 7) AS correlation FROM ap JOIN ex USING (c) GROUP BY draw")
def rp_dot_product_acc(spark, d):
    m = matrix(spark, d)
    return rounded(accuracy.product_correlation(m, mechanisms.project(m, KEY, ALL, 6, 4, TEST_KEY), ALL, 6), 7, "correlation")


@query(f"WITH RECURSIVE vs AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal AS v FROM customer), {boot_sql('vs', 0.9, 20)} SELECT {BOUNDS_SQL} FROM bb")
def bootstrap_bounds(spark, d):
    numbered = relational.numbered(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return rounded(accuracy.bootstrap_bounds(numbered, "i", "c_acctbal", 0.9, 20, TEST_KEY), 6, *BOUNDS)


# Black box.


@query("WITH t AS (SELECT event_type AS x, (value > 100)::INT AS y FROM events) SELECT x, round(count(*) FILTER (y=0)/(SELECT count(*) FROM t), 9) AS p0, round(count(*) FILTER (y=1)/(SELECT count(*) FROM t), 9) AS p1 FROM t GROUP BY x")
def ede_histogram(spark, d):
    e = table(spark, d, "events").select((F.col("value") > 100).cast("int").alias("y"), "event_type")
    return rounded(blackbox.joint_histogram(e, "y", "event_type"), 9, "p0", "p1")


@query("WITH t AS (SELECT floor(value/10) AS x, (event_type = 'purchase')::INT AS y FROM events), h AS (SELECT x, greatest(count(*) FILTER (y=0), count(*) FILTER (y=1)) AS best FROM t GROUP BY x) SELECT round(sum(best)/(SELECT count(*) FROM t), 9) AS accuracy FROM h")
def ede_accuracy(spark, d):
    e = table(spark, d, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), F.floor(F.col("value") / 10).alias("x"))
    return rounded(blackbox.histogram_accuracy(blackbox.joint_histogram(e, "y", "x")), 9, "accuracy")


@query("""WITH a AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
r AS (SELECT t.vec_id AS test_id, n.label % 2 AS y, row_number() OVER (PARTITION BY t.vec_id ORDER BY round(list_distance(t.v, n.v), 9), n.vec_id) AS k FROM a t JOIN a n ON t.vec_id % 5 = 0 AND n.vec_id % 5 <> 0)
SELECT test_id, round_even(avg(y), 0)::DOUBLE AS predicted FROM r WHERE k <= 7 GROUP BY test_id""")
def knn_kd(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("y"))
    train = e.where("vec_id % 5 <> 0").withColumnRenamed("vec_id", "train_id")
    return blackbox.vote(blackbox.nearest(train, e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("test_id"), "x"), 7))


@query("""WITH r AS (SELECT t.event_id AS test_id, (n.event_type = 'view')::INT AS y, row_number() OVER (PARTITION BY t.event_id ORDER BY abs(t.value - n.value), n.event_id) AS k
FROM events t JOIN events n ON t.event_id % 50 = 0 AND n.event_id % 50 <> 0)
SELECT test_id, round_even(avg(y), 0)::DOUBLE AS predicted FROM r WHERE k <= 11 GROUP BY test_id""")
def knn_1d(spark, d):
    e = table(spark, d, "events")
    train = e.where("event_id % 50 <> 0").select(F.col("event_id").alias("train_id"), F.col("value").alias("v"), (F.col("event_type") == "view").cast("double").alias("y"))
    return blackbox.nearest_on_line(train, e.where("event_id % 50 = 0").select(F.col("event_id").alias("test_id"), F.col("value").alias("v")), 11)


@query("SELECT count(*) AS n, round(2*exp(1.0::DOUBLE)*(12*(pow(1+2/sqrt(2-sqrt(3)), 2)-1)*sqrt(ln(400)/(2*count(*)))+sqrt(ln(400)/(2*count(*)))), 7) AS bound FROM events")
def tight_bound(spark, d):
    n = table(spark, d, "events").count()
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.round(F.max(F.lit(calibrate.tight_bound(0.01, n, n, 2, 1.0))), 7).alias("bound"))


# Kernels and accounting.

@query("SELECT vec_id, (list_position(list_transform(embedding[1:8], lambda x: abs(x)), list_max(list_transform(embedding[1:8], lambda x: abs(x)))) - 1)::INT AS inner_index FROM embeddings")
def innermost_index(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", 9, 8).alias("b"))
    return e.select("vec_id", kernels.innermost_column("a", "b").cast("int").alias("inner_index"))


from . import calibrated, estimated, forms, releases  # noqa: E402, F401  they register their queries
