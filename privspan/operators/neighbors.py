"""Nearest neighbours by a partition of space.

A bounded sample of the training points gives a k-d tree, whose leaves are cells. A test point meets
its own cell first; its k-th distance there then tells which other cells, by their boxes, can
hold anything nearer, and it meets only these. No plan has a cross join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points of a training block and of a test block; training points that share a cell and a salt.
BLOCK, TESTS, SALTED = 4096, 1024, 1 << 16
#: Training points whose coordinates reach the driver, and leaves of the tree.
SAMPLE, MOST_CELLS = 1 << 16, 4096


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: node i parts at cut[i] of coordinate dim[i], into nodes 2i + 1 (at most) and 2i + 2 (over)."""

    dim: np.ndarray
    cut: np.ndarray
    depth: int

    @classmethod
    def of(cls, sample: np.ndarray, cells: int) -> Tree:
        """Each node parts the coordinate of the widest range at a value near its middle; equal points stay together."""
        depth = max(cells - 1, 0).bit_length()
        dim, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        held = {0: sample}
        for i in range(len(dim)):
            x = held.pop(i, sample[:0])
            j = int(np.ptp(x, axis=0).argmax()) if len(x) else 0
            if len(x) > 1 and np.ptp(x[:, j]) > 0:
                values = np.sort(x[:, j])
                middle = values[(len(values) - 1) // 2]
                dim[i], cut[i] = j, middle if middle < values[-1] else values[values < middle][-1]
            over = x[:, dim[i]] > cut[i] if len(x) else np.zeros(0, bool)
            held[2 * i + 1], held[2 * i + 2] = x[~over], x[over]
        return cls(dim, cut, depth)

    def cell(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.dim[node]] > self.cut[node])
        return node - len(self.dim)


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c)))


class Meeting:
    """Blocks of training points and of test points that meet: `own` in a test point's cell, `others` in the cells near it."""

    def __init__(self, train: DataFrame, test: DataFrame, k: int):
        self.k = k
        self.train = _usable(train.select(F.col("train_id").cast("long").alias("train_id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")))
        self.test = _usable(test.select(F.col("test_id").cast("long").alias("test_id"), F.col("x").cast("array<double>").alias("x")))
        self.n = self.train.count()
        if not self.n:
            return
        sample = self.train.orderBy(F.xxhash64("train_id"), "train_id").limit(SAMPLE).select("x").collect()
        self.d = len(sample[0].x)
        self.tree = Tree.of(np.array([r.x for r in sample]), min(math.ceil(self.n / BLOCK), MOST_CELLS))
        self._measure()
        salts = self.salts
        blocks = self._blocks()
        tests = self._own_blocks()
        every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        self.own = tests.select("cell", "tests", "at", "m", every).join(blocks, ["cell", "salt"])
        first = _ranked(met(self.own, k), k)
        reach = first.groupBy("test_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        reach = self.test.join(reach, "test_id", "left").select("test_id", "x", F.when(F.col("n") >= k, F.col("far")).alias("far"))
        self.others = self._near_blocks(reach, salts).select("cell", "tests", "at", "m", every).join(blocks, ["cell", "salt"])
        self.first = first

    def _measure(self) -> None:
        """Count and box of each cell: cells x d numbers reach the driver."""
        tree, d = self.tree, self.d

        def run(batches):
            cells = 1 << tree.depth
            n, low, high = np.zeros(cells, np.int64), np.full((cells, d), np.inf), np.full((cells, d), -np.inf)
            for batch in batches:
                x = _points(batch.column(0))
                cell = tree.cell(x)
                n += np.bincount(cell, minlength=cells)
                np.minimum.at(low, cell, x)
                np.maximum.at(high, cell, x)
            here = np.flatnonzero(n)
            j = np.tile(np.arange(d), len(here))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.repeat(here, d), pa.int64()), "j": pa.array(j, pa.int64()), "n": pa.array(np.repeat(n[here], d)), "low": pa.array(low[here].ravel()), "high": pa.array(high[here].ravel())})

        found = self.train.select("x").mapInArrow(run, "cell long, j long, n long, low double, high double")
        cells = 1 << tree.depth
        self.count, self.low, self.high = np.zeros(cells, np.int64), np.full((cells, d), np.inf), np.full((cells, d), np.inf)
        for r in found.groupBy("cell", "j").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
            self.count[r.cell], self.low[r.cell, r.j], self.high[r.cell, r.j] = r.n, r.low, r.high
        self.salts = np.maximum(-(-self.count // SALTED), 1)

    def _blocks(self) -> DataFrame:
        """cell, salt, ids, points, ys, n: training points, at most k of those that are equal within a cell and salt.

        A cell of very many points is dealt by salts, so that no task holds it.
        """
        tree, salts, k = self.tree, self.salts, self.k

        def place(batches):
            for batch in batches:
                cell = tree.cell(_points(batch.column(1)))
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                salt = (mixed % salts[cell].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(salt)], ["train_id", "x", "y", "cell", "salt"])

        placed = self.train.where("train_id is not null").mapInArrow(place, "train_id long, x array<double>, y double, cell int, salt int")
        dealt = placed.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "x", "train_id")

        def pack(batches):
            last, seen = None, 0
            for batch in batches:
                x = _points(batch.column(1))
                ids, y, cell, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
                if not len(ids):
                    continue
                # The place of each point among its equals, which come one after another, perhaps from the batch before.
                where = np.concatenate([cell[:, None], salt[:, None], x], axis=1)
                new = np.r_[last is None or (where[0] != last).any(), (where[1:] != where[:-1]).any(1)]
                starts = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                place = np.arange(len(new)) - starts + np.where(starts == 0, 0 if new[0] else seen, 0)
                last, seen = where[-1], int(place[-1]) + 1
                keep = np.flatnonzero(place < k)
                group = np.flatnonzero(np.r_[True, (cell[keep][1:] != cell[keep][:-1]) | (salt[keep][1:] != salt[keep][:-1])]) if len(keep) else np.zeros(0, np.int64)
                for a, b in zip(group, np.r_[group[1:], len(keep)]):
                    for s in range(a, b, BLOCK):
                        own = keep[s : min(s + BLOCK, b)]
                        yield _row(cell=pa.array([cell[own[0]]], pa.int32()), salt=pa.array([salt[own[0]]], pa.int32()), ids=_bytes(ids[own], np.int64), points=_bytes(x[own], np.float64), ys=_bytes(y[own], np.float64), n=pa.array([len(own)], pa.int64()))

        return dealt.mapInArrow(pack, "cell int, salt int, ids binary, points binary, ys binary, n long")

    def _own_blocks(self) -> DataFrame:
        """cell, salts, tests, at, m: test points packed by their own cell."""
        tree, salts = self.tree, self.salts

        def place(batches):
            for batch in batches:
                cell = tree.cell(_points(batch.column(1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.arange(len(cell), dtype=np.int32) % 64)], ["test_id", "x", "cell", "part"])

        # Dealt by parts of a cell too, as a third of all test points may share one.
        placed = self.test.mapInArrow(place, "test_id long, x array<double>, cell int, part int").repartition("cell", "part").sortWithinPartitions("cell", "part")

        def pack(batches):
            for batch in batches:
                yield from _packed(batch.column(0).to_numpy(zero_copy_only=False), _points(batch.column(1)), batch.column(2).to_numpy(), salts)

        return placed.mapInArrow(pack, _TESTS)

    def _near_blocks(self, reach: DataFrame, salts: np.ndarray) -> DataFrame:
        """The same for all other cells whose box is no farther than the k-th distance; with fewer than k so far, for all."""
        tree, low, high, count = self.tree, self.low, self.high, self.count

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, TESTS):
                    part = batch.slice(at, TESTS)
                    x, far = _points(part.column(1)), part.column(2).fill_null(np.inf).to_numpy(zero_copy_only=False)
                    apart = np.zeros((len(x), len(low)))
                    for j in range(x.shape[1]):
                        apart += np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0) ** 2
                    # Some room, as distances are rounded.
                    ask = (apart <= (far * far * (1 + 1e-9) + 1e-300)[:, None]) & (count > 0)
                    ask[np.arange(len(x)), tree.cell(x)] = False
                    cell, row = np.nonzero(ask.T)
                    yield from _packed(part.column(0).to_numpy(zero_copy_only=False)[row], x[row], cell, salts)

        return reach.mapInArrow(run, _TESTS)


_TESTS = "cell int, salts int, tests binary, at binary, m long"


def _bytes(x: np.ndarray, kind) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())


def _row(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _packed(ids: np.ndarray, x: np.ndarray, cell: np.ndarray, salts: np.ndarray):
    """Rows of test blocks, for points in the order of their cells."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.r_[starts[1:], len(cell)]):
        for s in range(a, b, TESTS):
            own = slice(s, min(s + TESTS, b))
            yield _row(cell=pa.array([cell[s]], pa.int32()), salts=pa.array([salts[cell[s]]], pa.int32()), tests=_bytes(ids[own], np.int64), at=_bytes(x[own], np.float64), m=pa.array([len(ids[own])], pa.int64()))


def met(blocks: DataFrame, k: int) -> DataFrame:
    """test_id, train_id, y, distance: the k nearest of each block to each test point that meets it."""

    def run(batches):
        for batch in batches:
            for tests, at, ids, points, ys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tests, ids, ys = np.frombuffer(tests, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(ys, np.float64)
                q, p = np.frombuffer(at).reshape(len(tests), -1), np.frombuffer(points).reshape(len(ids), -1)
                if q.shape[1] <= 8:
                    d = np.zeros((len(q), len(p)))
                    for j in range(q.shape[1]):
                        d += (q[:, j, None] - p[None, :, j]) ** 2
                else:
                    d = np.maximum((q * q).sum(1)[:, None] - 2 * q @ p.T + (p * p).sum(1), 0)
                order = np.argsort(ids, kind="stable")
                near = order[np.argsort(d[:, order], axis=1, kind="stable")[:, :k]]
                rows = np.repeat(np.arange(len(q)), near.shape[1])
                # What was found by products is measured by differences, as products lose small distances.
                far = np.sqrt(((q[rows] - p[near.ravel()]) ** 2).sum(1))
                yield pa.RecordBatch.from_pydict({"test_id": pa.array(tests[rows]), "train_id": pa.array(ids[near.ravel()]), "y": pa.array(ys[near.ravel()], from_pandas=True), "distance": pa.array(far)})

    return blocks.select("tests", "at", "ids", "points", "ys").mapInArrow(run, "test_id long, train_id long, y double, distance double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("test_id").orderBy("distance", "train_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def nearest(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """test_id, train_id, y, distance: the k training points nearest to each test point, ties by train_id.

    train: train_id, x (array), y; test: test_id (unique), x. All points have the same length.
    Points that are null or hold a null or NaN are left out, as are training points without an id;
    a null label stays null. Of equal training points only those k with the smallest ids of each salt
    are compared, so that any share of them may be equal. Fewer than k training points give all
    of them, none give no rows.
    """
    meeting = Meeting(train, test, k)
    if not meeting.n:
        return test.limit(0).select(F.col("test_id").cast("long").alias("test_id"), F.lit(0).cast("long").alias("train_id"), F.lit(0.0).alias("y"), F.lit(0.0).alias("distance"))
    return _ranked(meeting.first.unionByName(met(meeting.others, k)), k)


def pairs_met(train: DataFrame, test: DataFrame, k: int) -> int:
    """How many distances nearest() computes."""
    meeting = Meeting(train, test, k)
    if not meeting.n:
        return 0
    return meeting.own.unionByName(meeting.others).agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0))).first()[0]
