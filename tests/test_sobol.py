"""Scrambled Sobol points: a net, uniform, repeatable, and closer than the lattice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from privspan.operators import kernels, sobol


def test_polynomials_are_primitive():
    # Their numbers by degree are those of Euler's function of 2^s - 1, over s.
    found = sobol.primitive_polynomials(36)
    assert [sum(p.bit_length() - 1 == s for p in found) for s in range(1, 7)] == [1, 1, 2, 2, 6, 6]
    assert found[:4] == [0b11, 0b111, 0b1011, 0b1101] and 0b11111 not in found


@pytest.mark.parametrize("dimensions", [1, 2, 13, 40])
def test_direction_numbers_are_triangular(dimensions):
    for numbers in sobol.direction_numbers(dimensions):
        assert len(numbers) == 32
        assert all(v >> (31 - k) & 1 and v & ((1 << (31 - k)) - 1) == 0 for k, v in enumerate(numbers))


def test_every_coordinate_and_the_first_two_fill_all_cells(spark):
    df = sobol.points(spark, 256, 20, 3, "k").toPandas()
    assert len(df) == 768
    for _, part in df.groupby("scramble"):
        for j in range(20):
            assert sorted((part[f"u{j}"] * 256).astype(int)) == list(range(256))
        for bits in range(9):
            cells = (part.u0 * 2**bits).astype(int) * 2 ** (8 - bits) + (part.u1 * 2 ** (8 - bits)).astype(int)
            assert cells.nunique() == 256
    # Scrambles differ, another run and another partitioning don't.
    assert df[df.scramble == 0].u0.tolist() != df[df.scramble == 1].u0.tolist()
    again = sobol.points(spark, 256, 20, 3, "k").repartition(7).toPandas()
    assert again.sort_values(["scramble", "i"]).reset_index(drop=True).equals(df.sort_values(["scramble", "i"]).reset_index(drop=True))


def test_scrambled_points_are_unbiased(spark):
    """One point of each of many scrambles is uniform."""
    u = sobol.points(spark, 2, 2, 400, "k").where("i = 1").toPandas()
    for j in (0, 1):
        assert abs(u[f"u{j}"].mean() - 0.5) < 0.06 and abs(u[f"u{j}"].var() - 1 / 12) < 0.02


@pytest.mark.parametrize("count", [0, 3, 100, 1 << 33, -4])
def test_only_powers_of_two(spark, count):
    with pytest.raises(ValueError, match="power of two"):
        sobol.points(spark, count, 2, 2, "k")


def test_twelve_coordinates_beat_the_lattice_and_agree_with_draws(spark):
    g = np.random.default_rng(5)
    a, b, c = g.normal(size=12) * 0.2, g.normal(size=12) * 0.3, -0.1
    draws = spark.range(1 << 12)
    exact = kernels.estimate(spark.range(1 << 15), "id", a, b, c, "k", "sobol", 8).first()
    found = {m: kernels.estimate(draws, "id", a, b, c, "k", m, 8).first() for m in ("sobol", "lattice", "monte_carlo")}
    assert found["sobol"].stderr < found["lattice"].stderr < found["monte_carlo"].stderr
    for row in found.values():
        assert abs(row.delta - exact.delta) < 5 * row.stderr + 1e-9


def test_few_draws_and_coordinates(spark):
    empty = kernels.estimate(spark.range(0), "id", [0.1, 0.2], [0.3, 0.1], 0.0, "k", "sobol", 2).first()
    assert 0 < empty.delta < 1  # without draws there is one point for each scramble
    one = kernels.estimate(spark.range(5), "id", [0.1], [0.3], 0.0, "k", "sobol").first()
    assert one.stderr == 0 and one.delta > 0
    with pytest.raises(ValueError, match="unknown method"):
        kernels.estimate(spark.range(5), "id", [0.1, 0.1], [0.3, 0.1], 0.0, "k", "halton")
    assert sobol.points(spark, 1, 1, 1, "k").select(F.count("*")).first()[0] == 1
