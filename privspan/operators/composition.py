"""Composition of different Gaussian releases by convolving their discretised privacy losses, enclosed from both sides.

A release of sensitivity mu (in units of its noise) has the loss N(mu^2/2, mu^2). Each cell of a grid of losses keeps its
mass under both hypotheses if it is put on the cell's two ends: that spreads the likelihood ratio, so no true spectrum is above
(`above`). The chord of a cell is over the convex spectrum by no more than its end tangents allow; taking that off at the
grid points gives a spectrum that is nowhere above the true one (`below`). Both errors are of second order in the step.

The state of a group is a mergeable sum: logarithms and angles of the discrete transforms, logarithms of moments that bound
what leaves the grid, and mass that was given up. It is summed in any order and over any batches; delta for any eps is a
product with the transform of that eps, so no task needs the whole state of a group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privspan.functions.numeric import normal_cdf

#: Exponents of the moments that bound the mass beyond the grid.
POWERS = (1.0, 2.0, 4.0, 8.0, 16.0)
#: Frequencies in a row of the state.
BLOCK = 1024
#: What rounding of transforms and sums may add.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Grid:
    """size losses (a power of two, at least 8) from -reach on, reach itself left out."""

    size: int
    reach: float

    def __post_init__(self):
        if self.size < 8 or self.size & (self.size - 1) or not self.reach > 0:
            raise ValueError("size has to be a power of two of at least 8, reach above zero")

    @property
    def step(self) -> float:
        return 2 * self.reach / self.size

    @property
    def losses(self) -> np.ndarray:
        return (np.arange(self.size) - self.size // 2) * self.step


def masses(mu: float, grid: Grid) -> dict[str, tuple[np.ndarray, float]]:
    """`above` and `below`: masses at the grid's losses, and a mass that is missing (above) or too much (below)."""
    x, step = grid.losses, grid.step
    down, up = np.exp(-step), np.expm1(step)

    def cells(mean):
        z = (x - mean) / mu
        return np.where(z[:-1] > 0, normal_cdf(-z[:-1]) - normal_cdf(-z[1:]), normal_cdf(z[1:]) - normal_cdf(z[:-1]))

    half = mu * mu / 2
    p, q = cells(half), cells(-half)
    right = np.clip((p - q * np.exp(x[:-1])) / -np.expm1(-step), 0, p)
    left = p - right
    both = np.zeros(grid.size)
    both[:-1] += left
    both[1:] += right
    above = both.copy()
    above[0] += float(normal_cdf((x[0] - half) / mu))
    endless = float(normal_cdf((half - x[-1]) / mu))
    with np.errstate(invalid="ignore", divide="ignore"):
        over = np.where(p > 0, (1 - down) * left * right / (left + right * down), 0.0)
    # The excess of either cell beside a point, and the change of its slope there in units of mass.
    most = np.maximum(np.concatenate([over[:1], over]), np.concatenate([over, over[-1:]]))
    slope = np.diff(most)
    below = both - np.concatenate([slope / up, [0.0]]) + np.concatenate([[0.0], slope / -np.expm1(-step)])
    given = float(np.maximum(-below, 0).sum() + most[-1])
    return {"above": (above, endless), "below": (np.maximum(below, 0), given)}


def _spectrum(values: np.ndarray) -> np.ndarray:
    return np.fft.rfft(np.fft.ifftshift(values))


def _logs(mu: float, grid: Grid) -> dict[str, tuple[np.ndarray, np.ndarray, float, np.ndarray]]:
    out = {}
    for side, (mass, lost) in masses(mu, grid).items():
        t = _spectrum(mass)
        sign = 1 if side == "above" else -1
        moments = np.array([np.log(max(float((mass * np.exp(np.minimum(sign * k * grid.losses, 700))).sum()), 1e-300)) for k in POWERS])
        out[side] = np.log(np.maximum(np.abs(t), 1e-300)), np.angle(t), lost, moments
    return out


STATE = "side string, block int, logs array<double>, angles array<double>, lost double, moments array<double>, n long, unknown long"


def state(releases: DataFrame, group: str, mu: str, grid: Grid) -> DataFrame:
    """The group's state as rows (side, block): to be stored by batch, and merged by `merged`.

    A release of mu = 0 tells nothing. One whose mu is null, negative or not finite is counted in `unknown`. Groups may be
    null; equal releases are counted first, so a group's work is that of its different releases, shared among all tasks.
    """
    # A group passes through Python as text, which keeps nulls and long numbers as they are.
    kind = releases.schema[group].dataType
    counted = releases.select(F.col(group).cast("string").alias("_group"), F.col(mu).cast("double").alias("_mu")).groupBy("_group", "_mu").count()
    names = ["_group", *[c.split()[0] for c in STATE.split(", ")]]
    half = grid.size // 2 + 1

    def rows(group, sums, n, unknown):
        out = []
        for side, (logs, angles, lost, moments) in sums.items():
            for b in range(0, half, BLOCK):
                out.append((group, side, b // BLOCK, logs[b : b + BLOCK].tolist(), angles[b : b + BLOCK].tolist(), float(lost), moments.tolist(), n, unknown))
        return pd.DataFrame(out, columns=names)

    def partial(frames):
        now, sums, n, unknown = None, None, 0, 0
        # Partitions come sorted by group, so one state is held at a time.
        for frame in frames:
            for value, mu_, count in frame.itertuples(index=False):
                value = None if pd.isna(value) else value
                if sums is None or value != now:
                    if sums is not None:
                        yield rows(now, sums, n, unknown)
                    now, n, unknown = value, 0, 0
                    sums = {side: (np.zeros(half), np.zeros(half), 0.0, np.zeros(len(POWERS))) for side in ("above", "below")}
                n += count
                if not (np.isfinite(mu_) and mu_ >= 0):
                    unknown += count
                elif mu_ > 0:
                    one = _logs(mu_, grid)
                    sums = {side: tuple(a + count * b for a, b in zip(s, one[side])) for side, s in sums.items()}
        if sums is not None:
            yield rows(now, sums, n, unknown)

    parts = counted.sortWithinPartitions("_group").mapInPandas(partial, f"_group string, {STATE}")
    return merged(parts.select(F.col("_group").cast(kind).alias(group), *names[1:]))


def merged(states: DataFrame) -> DataFrame:
    """Sums of states, of parts or of batches; each task adds up the rows of one block, one after the other."""
    group = states.columns[0]
    names = states.columns[1:]
    zero = lambda c: F.array_repeat(F.lit(0.0), F.size(c))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    rows = states.groupBy(group, "side", "block").agg(
        *[F.collect_list(c).alias(c) for c in ("logs", "angles", "moments")], F.sum("lost").alias("lost"), F.sum("n").alias("n"), F.sum("unknown").alias("unknown"))
    sums = {c: F.aggregate(c, zero(F.col(c)[0]), add) for c in ("logs", "angles", "moments")}
    return rows.withColumns(sums).select(group, *names)


@lru_cache(maxsize=64)
def _weights(size: int, reach: float, eps: float) -> np.ndarray:
    """Transform of (1 - e^(eps - loss))+, with the frequencies that rfft leaves out counted twice."""
    grid = Grid(size, reach)
    t = _spectrum(-np.expm1(np.minimum(eps - grid.losses, 0.0))) / size
    t[1:-1] *= 2
    return t


def enclosure(states: DataFrame, grid: Grid, eps: list[float]) -> DataFrame:
    """group, eps, low, high, n: delta is within [low, high]; [0, 1] where a release is unknown."""
    group = states.columns[0]
    size, reach = grid.size, grid.reach

    @F.pandas_udf("array<double>")
    def product(block: pd.Series, logs: pd.Series, angles: pd.Series) -> pd.Series:
        out = []
        for b, l, a in zip(block, logs, angles):
            # A modulus beyond this has more given up than there is, so that low is zero.
            t = np.exp(np.minimum(l, 300) + 1j * a)
            out.append([float((t * np.conj(_weights(size, reach, e)[b * BLOCK : b * BLOCK + len(t)])).sum().real) for e in eps])
        return pd.Series(out)

    parts = states.withColumn("parts", product("block", "logs", "angles"))
    beyond = F.least(*[F.col("moments")[i] - k * reach for i, k in enumerate(POWERS)])
    sides = parts.groupBy(group, "side").agg(
        F.first("lost").alias("lost"), F.first(beyond).alias("beyond"), F.first("n").alias("n"), F.first("unknown").alias("unknown"),
        *[F.sum(F.col("parts")[i]).alias(f"_d{i}") for i in range(len(eps))])
    slack = F.col("lost") + F.exp(F.least(F.col("beyond"), F.lit(0.0))) + ROUNDING
    rows = sides.select(group, "side", "n", "unknown", slack.alias("slack"), F.explode(F.array(*[F.struct(F.lit(float(e)).alias("eps"), F.col(f"_d{i}").alias("d")) for i, e in enumerate(eps)])).alias("v"))
    low = F.max(F.when(F.col("side") == "below", F.col("v.d") - F.col("slack")))
    high = F.max(F.when(F.col("side") == "above", F.col("v.d") + F.col("slack")))
    known = F.max("unknown") == 0
    return rows.groupBy(group, F.col("v.eps").alias("eps")).agg(
        F.when(known, F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("low"),
        F.when(known, F.least(F.greatest(high, F.lit(0.0)), F.lit(1.0))).otherwise(1.0).alias("high"), F.max("n").alias("n"))
