"""Registered queries and their SQL: quadratic forms in every row, and spectra over scrambled Sobol points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from privspan.operators import kernels, quadratic_forms, sobol
from privspan.sources.tables import table

from .estimated import INNER_SQL, quantile_sql
from .registry import FIT, KEY, TEST_KEY, fitted, nodes_sql, phi_sql, query, rounded, spectrum_sql


@query(f"""WITH {FIT}, {nodes_sql()}, {spectrum_sql(3, False, '20', '0.01', 'r', 'row_id', 'lf')}, {spectrum_sql(3, True, '20', '0.01', 'r', 'row_id', 'rg')}
SELECT row_id, round(lf, 7) + 0 AS delta_left, round(rg, 7) + 0 AS delta_right, true AS close FROM lf_d JOIN rg_d USING (row_id)""")
def delta_pq_forms(spark, d):
    """Both least-squares spectra of every record as differences of distribution functions of quadratic forms."""
    m, f = fitted(spark, d)
    out = f.rows(m).select(KEY, quadratic_forms.least_squares("p", "q", 3, 20, 0.01).alias("s"))
    return rounded(out.select(KEY, F.col("s.left").alias("delta_left"), F.col("s.right").alias("delta_right"), (F.col("s.error") < 1e-7).alias("close")), 7, "delta_left", "delta_right")


# Of v' form v <= 2 the second coordinate lies between two roots; the first is the sine of an angle.

_A = repr(float(np.sqrt(4 / 1.84)))


@query(f"""WITH {nodes_sql()}, v AS (SELECT vec_id, 5*embedding[1]::DOUBLE AS m1, 5*embedding[2]::DOUBLE AS m2, 1+label/10.0::DOUBLE AS c FROM embeddings),
n AS (SELECT *, {_A}*sin(nx*pi()/2) AS a, sqrt(greatest(0, 4-1.84*a*a)) AS root, m2+0.3/c*(a-m1) AS mb, sqrt(1-0.09/c) AS sb, nw*pi()/2*{_A}*cos(nx*pi()/2)*exp(-(a-m1)*(a-m1)/(2*c))/sqrt(2*pi()*c) AS part FROM v, nodes)
SELECT vec_id, round(sum(part*({phi_sql('((-0.4*a+root-mb)/sb)')}-{phi_sql('((-0.4*a-root-mb)/sb)')})), 9) + 0 AS below FROM n GROUP BY vec_id""")
def quadratic_form_rows(spark, d):
    """P(v' form v <= 2), v normal around the first two components of each vector, with its label's covariance."""
    v = table(spark, d, "embeddings")
    e = [F.get("embedding", i).cast("double") * 5 for i in (0, 1)]
    c = 1 + F.col("label").cast("double") / 10
    rows = v.select("vec_id", F.array(*e).alias("mean"), F.array(c, F.lit(0.3), F.lit(0.3), F.lit(1.0)).alias("cov"), F.array(*[F.lit(x) for x in (1.0, 0.2, 0.2, 0.5)]).alias("form"))
    return rounded(rows.select("vec_id", quadratic_forms.distribution(2.0, "mean", "cov", "form", 2)["below"].alias("below")), 9, "below")


# Twelve components of vectors with an even label against those with an odd one, as independent normals.

_D, _SCRAMBLES = 12, 8


def _word_sql(*counters: str) -> str:
    name = " || '|' || ".join([f"'{TEST_KEY}|sobol'", *[f"({c})::VARCHAR" for c in counters]])
    return f"('0x' || substr(md5({name}), 1, 8))::BIGINT"


_DIRECTIONS = ", ".join(f"({j}, {k}, {v}::BIGINT)" for j, numbers in enumerate(sobol.direction_numbers(_D - 1)) for k, v in enumerate(numbers))


@query(f"""WITH mo AS (SELECT j, avg(v) FILTER (g = 0) AS m1, avg(v) FILTER (g = 1) AS m2, var_samp(v) FILTER (g = 0) AS v1, var_samp(v) FILTER (g = 1) AS v2 FROM (SELECT label%2 AS g, j, embedding[j]::DOUBLE AS v FROM embeddings, range(1, {_D + 1}) t(j)) GROUP BY j),
ke AS (SELECT *, row_number() OVER (ORDER BY abs(a) DESC, abs(b) DESC, j)-2 AS dim FROM (SELECT j, 1-v1/v2 AS a, sqrt(v1)*(m2-m1)/v2 AS b, ln(v1/v2)/2-(m2-m1)*(m2-m1)/(2*v2) AS c FROM mo)),
dn AS (SELECT * FROM (VALUES {_DIRECTIONS}) t(dim, k, v)),
rw AS (SELECT scramble, dim, p, (1::BIGINT << (31-p)) | ({_word_sql('scramble', 'dim', 'p')} & ~((1::BIGINT << (32-p))-1)) AS mask FROM range(0, {_SCRAMBLES}) s(scramble), range(0, {_D - 1}) t(dim), range(0, 32) q(p)),
sv AS (SELECT scramble, dim, k, sum((bit_count(mask & v) % 2)::BIGINT << (31-p))::BIGINT AS v FROM rw JOIN dn USING (dim) GROUP BY scramble, dim, k),
ad AS (SELECT scramble, dim, {_word_sql('scramble', 'dim', '32')} AS added FROM range(0, {_SCRAMBLES}) s(scramble), range(0, {_D - 1}) t(dim)),
nn AS (SELECT ceil(log2(count(*)))::INT AS bits FROM embeddings),
pt AS (SELECT i, scramble, dim, bit_xor(CASE WHEN (i >> k) & 1 = 1 THEN v ELSE 0 END) AS x FROM (SELECT unnest(range(0, 1::BIGINT << bits)) AS i, bits FROM nn), sv WHERE k < bits GROUP BY i, scramble, dim),
us AS (SELECT i, scramble, dim, (xor(x, added)+0.5)/4294967296.0::DOUBLE AS u FROM pt JOIN ad USING (scramble, dim)),
zs AS (SELECT i, scramble, dim, {quantile_sql('u', 'z')} FROM us),
cz AS (SELECT i, scramble, sum(a*z*z/2+b*z) AS part FROM zs JOIN ke USING (dim) GROUP BY i, scramble),
cc AS (SELECT sum(c)+0.001 AS c FROM ke), od AS (SELECT a, b FROM ke WHERE dim = -1),
kd AS (SELECT scramble, a, b, part+c AS kz, {INNER_SQL} FROM cz, cc, od),
sm AS (SELECT scramble, avg(least(1, greatest(0, v))) AS m FROM kd GROUP BY scramble) SELECT round(avg(m), 9) + 0 AS delta, round(stddev_samp(m)/sqrt(count(*)), 9) + 0 AS stderr FROM sm""")
def ndis_sobol(spark, d):
    """delta and its standard error at eps = 0.001: as many points as vectors, made a power of two, for each of eight scrambles."""
    e = table(spark, d, "embeddings").select((F.col("label") % 2).alias("g"), *[F.get("embedding", j).cast("double").alias(f"e{j}") for j in range(_D)])
    sums = [f(F.when(F.col("g") == g, F.col(f"e{j}"))) for j in range(_D) for g in (0, 1) for f in (F.avg, F.var_samp)]
    m1, v1, m2, v2 = np.array(e.agg(*sums).first(), float).reshape(_D, 4).T
    a, b, c = 1 - v1 / v2, np.sqrt(v1) * (m2 - m1) / v2, (np.log(v1 / v2) / 2 - (m2 - m1) ** 2 / (2 * v2)).sum()
    return rounded(kernels.estimate(e, "g", a, b, float(c) + 0.001, TEST_KEY, "sobol", _SCRAMBLES), 9, "delta", "stderr")
