"""Bootstrap resamples without drawing rows: how often each row comes, by recursive binomial splitting.

The n draws of a resample are shared between the halves of the row numbers 0 .. n-1 by one binomial
draw, then between their halves, and so on to single rows. This is an exact multinomial, and a row's
count hangs on its path alone: it is computed where the row lies, and nothing is joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rng

#: Rows of a part whose share of the draws the driver finds beforehand, and parts at most.
PART, MOST_PARTS = 1 << 16, 1 << 12
#: Cells of a table of probabilities at once, and deviations from the mean beyond which nothing is left in doubles.
CELLS, WIDE = 1 << 20, 12.0


def _stirling_error(k: np.ndarray) -> np.ndarray:
    """log k! less Stirling's formula for it, k >= 1."""
    exact = np.array([math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)])
    x = 1 / np.maximum(k, 16.0) ** 2
    series = (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x * (1 / 1680 - x / 1188)))) / np.maximum(k, 16.0)
    return np.where(k < 16, exact[np.clip(k, 1, 15).astype(int) - 1], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x for x > 0, without cancellation near the mean."""
    v = (x - mean) / (x + mean)
    near = np.zeros_like(v)
    for j in range(12, 0, -1):
        near = near * v * v + 1 / (2 * j + 1)
    near = (x - mean) * v + 2 * x * near * v**3
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(v) < 0.1, near, x * np.log(x / mean) + mean - x)


def _probabilities(k: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(Binomial(m, p) = k), 0 outside of 0 .. m, with full relative precision for any m (saddle-point form)."""
    a, b = np.clip(k, 1, np.maximum(m - 1, 1)).astype(float), np.maximum(m - np.clip(k, 1, np.maximum(m - 1, 1)), 1).astype(float)
    log = _stirling_error(m) - _stirling_error(a) - _stirling_error(b) - _deviance(a, m * p) - _deviance(b, m * (1 - p)) + 0.5 * np.log(m / (2 * math.pi * a * b))
    log = np.where(k == 0, m * np.log1p(-p), np.where(k == m, m * np.log(p), log))
    return np.where((k < 0) | (k > m), 0.0, np.exp(log))


def binomial(u: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each element the number of k whose distribution function is below u: a binomial draw from a uniform one."""
    out = np.zeros(m.shape, np.int64)
    live = np.flatnonzero((m > 0) & (p > 0))
    sd = np.sqrt(m * p * (1 - p))
    low = np.maximum(np.floor(m * p - WIDE * sd - WIDE), 0).astype(np.int64)
    width = np.minimum(m, np.ceil(m * p + WIDE * sd + WIDE).astype(np.int64)) - low + 1
    live = live[np.argsort(width[live], kind="stable")]
    while len(live):
        # As many of the widest as fit; the narrow ones come together in the end.
        wide = int(width[live[-1]])
        own, live = live[-max(CELLS // wide, 1) :], live[: -max(CELLS // wide, 1)]
        q = _probabilities(low[own, None] + np.arange(wide), m[own, None], p[own, None])
        # Each tail is added up from its own end, as sums near one lose what is beyond.
        upper = u[own] > 0.5
        found = np.empty(len(own), np.int64)
        found[~upper] = (np.cumsum(q[~upper], axis=1) < u[own][~upper, None]).sum(1)
        beyond = np.cumsum(q[upper, :0:-1], axis=1)[:, ::-1]
        found[upper] = (beyond > 1 - u[own][upper, None]).sum(1)
        out[own] = np.minimum(low[own] + found, m[own])
    return out


def _uniforms(key: str, level: int, start: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """52 bits for each node (level, first row number) and resample."""
    low, high = (start & 0xFFFFFFFF).astype(np.uint32)[:, None], (start >> 32).astype(np.uint32)[:, None]
    a, b = (rng.absorbed(w, reps[None].astype(np.uint32), np.uint32(level), low, high) for w in rng.words(key, "boot")[:2])
    return (a * float(1 << 20) + (b & np.uint32((1 << 20) - 1)) + 0.5) / 2.0**52


class Nodes:
    """Nodes of one level: first row number, number of rows, and draws in each resample."""

    def __init__(self, start: np.ndarray, size: np.ndarray, draws: np.ndarray, level: int):
        self.start, self.size, self.draws, self.level = start, size, draws, level

    @classmethod
    def root(cls, n: int, resamples: int) -> Nodes:
        return cls(np.zeros(1, np.int64), np.array([n]), np.full((1, resamples), n), 0)

    def halves(self, key: str, node: np.ndarray, right: np.ndarray) -> Nodes:
        """The right or left halves of some nodes; a node of one row is its own right half."""
        used, back = np.unique(node, return_inverse=True)
        start, size, draws = self.start[used], self.size[used], self.draws[used]
        half = size // 2
        u = _uniforms(key, self.level, start, np.arange(draws.shape[1]))
        share = np.repeat(half / size, draws.shape[1])
        left = binomial(u.ravel(), draws.ravel(), share).reshape(draws.shape)
        start, size, half, draws, left = start[back], size[back], half[back], draws[back], left[back]
        return Nodes(start + half * right, np.where(right, size - half, half), np.where(right[:, None], draws - left, left), self.level + 1)


def parts(key: str, n: int, resamples: int) -> Nodes:
    """Nodes of at most PART rows, or MOST_PARTS of them, in the order of rows."""
    nodes = Nodes.root(n, resamples)
    while nodes.size.max() > PART and len(nodes.size) < MOST_PARTS:
        both = np.repeat(np.arange(len(nodes.size)), 2)
        nodes = nodes.halves(key, both, np.tile([False, True], len(nodes.size)))
    return nodes


def counts(key: str, top: Nodes, i: np.ndarray) -> np.ndarray:
    """(rows, resamples): how often each row number comes in each resample."""
    at = np.searchsorted(top.start, i, "right") - 1
    used, at = np.unique(at, return_inverse=True)
    nodes = Nodes(top.start[used], top.size[used], top.draws[used], top.level)
    while nodes.size.max() > 1:
        right = i - nodes.start[at] >= nodes.size[at] // 2
        child, at = np.unique(2 * at + right, return_inverse=True)
        nodes = nodes.halves(key, child // 2, child % 2 == 1)
    return nodes.draws[at]


def resampled_means(df: DataFrame, key_column: str, value: str, n: int, resamples: int, key: str) -> DataFrame:
    """rep, m, n: mean of each resample's values that are not null, and its number of draws; a task gives one row a resample."""
    top = parts(key, n, resamples)

    def run(batches):
        total = np.zeros((3, resamples))
        for batch in batches:
            step = max(CELLS // resamples, 1)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                c = counts(key, top, part.column(0).to_numpy(zero_copy_only=False))
                v = part.column(1).fill_null(0.0).to_numpy(zero_copy_only=False)
                known = part.column(1).is_valid().to_numpy(zero_copy_only=False)
                total += np.stack([(c * v[:, None]).sum(0), c[known].sum(0), c.sum(0)])
        yield pa.RecordBatch.from_pydict({"rep": pa.array(np.arange(resamples)), "s": total[0], "c": total[1], "n": pa.array(total[2].astype(np.int64))})

    rows = df.select(F.col(key_column).cast("long"), F.col(value).cast("double"))
    sums = rows.mapInArrow(run, "rep long, s double, c double, n long").groupBy("rep").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    return sums.select("rep", F.try_divide("s", "c").alias("m"), "n")
