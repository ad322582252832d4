"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random on 16 dimensions, twice eight, and each half is decoded to
the nearest point of the lattice E8: the two points are a cell. A vector goes to its own cell
and to the cells around it that lie nearest, in several tables with projections of their own.
Vectors that meet in a cell are compared by blocks of exact cosine products in double precision.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import connected_components, materialize

TABLES, HALVES, PROBES = 10, 2, 2
#: Length of a unit vector in the lattice's measure. Vectors at a cosine of 0.9 then share a cell
#: of one table with a probability of 0.38, so one of all tables with 0.99.
SCALE = 4.2
COSINE = 0.9
#: Vectors of one side of a block.
BLOCK = 256
SEED = 8


@lru_cache(maxsize=1)
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two units of either sign, or halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum: round, and turn the worst coordinate if the sum is odd."""
    near = np.rint(x)
    off, row = x - near, np.arange(len(x))
    worst = np.abs(off).argmax(1)
    odd = near.sum(1) % 2 != 0
    near[row[odd], worst[odd]] += np.where(off[row[odd], worst[odd]] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cells(x: np.ndarray) -> list[np.ndarray]:
    """The nearest lattice point of each row and its PROBES neighbours that come next."""
    home = nearest_e8(x)
    rest = x - home
    # |rest - root|^2 orders as -2 rest.root, as all roots are equally long.
    near = np.argsort(-(rest @ _roots().T), axis=1, kind="stable")[:, :PROBES]
    return [home, *(home + _roots()[near[:, i]] for i in range(PROBES))]


def cell_keys(unit: np.ndarray) -> np.ndarray:
    """Keys of each row: TABLES x (1 + HALVES x PROBES). A probe leaves its cell in one half."""
    n, d = unit.shape
    rng, out = np.random.default_rng(SEED), []
    mixers = np.random.default_rng(SEED + 1).integers(1, 1 << 62, (TABLES, HALVES, 8), dtype=np.int64) | 1
    for t in range(TABLES):
        axes = rng.normal(size=(d, 8 * HALVES))
        if d >= 8 * HALVES:
            axes = np.linalg.qr(axes)[0]
        else:
            axes /= np.sqrt(d)
        x = unit @ axes * (SCALE * np.sqrt(d / 64))
        hashed = []
        for h in range(HALVES):
            points = [(2 * c).astype(np.int64) for c in _cells(x[:, 8 * h : 8 * h + 8])]
            with np.errstate(over="ignore"):
                hashed.append([(p * mixers[t, h]).sum(1) for p in points])
        with np.errstate(over="ignore"):
            home = sum(h[0] for h in hashed) + np.int64(t) * mixers[0, 0, 0]
            out.append(home)
            out += [home - h[0] + h[i] for h in hashed for i in range(1, PROBES + 1)]
    return np.stack(out, axis=1)


def prepared(table: DataFrame) -> DataFrame:
    """vec_id, cls (a 128-bit digest of the values), unit (packed doubles): the last two null if it can't be compared."""

    def run(batches):
        for batch in batches:
            cls, unit = [], []
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(values if values is not None and None not in values else [], np.float64)
                top = np.abs(x).max() if len(x) else 0.0
                if key is None or not np.isfinite(top) or top == 0:
                    cls.append(None)
                    unit.append(None)
                else:
                    cls.append(xxhash.xxh3_128_hexdigest(x.tobytes()))
                    x = x / top
                    unit.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "cls": pa.array(cls, pa.string()), "unit": pa.array(unit, pa.binary())})

    return table.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, cls string, unit binary")


def _keyed(classes: DataFrame) -> DataFrame:
    """cls, keys (all of a class, packed); classes of equal length meet, others never."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                units = [np.frombuffer(u) for u in part.column(1).to_pylist()]
                keys: list = [None] * len(units)
                for d in {len(u) for u in units}:
                    rows = [i for i, u in enumerate(units) if len(u) == d]
                    for i, k in zip(rows, cell_keys(np.stack([units[i] for i in rows])) ^ np.int64(d - 64)):
                        keys[i] = k
                yield pa.RecordBatch.from_pydict({"cls": part.column(0), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return classes.select("cls", "unit").mapInArrow(run, "cls string, keys array<long>")


def _links(blocks: DataFrame) -> DataFrame:
    """cls, n (links of its vectors first met here), other: for each class linked in a block.

    blocks is partitioned and sorted by key, i, j. A pair counts in the smallest key that its
    two classes share. other is the first class that links reach within the block.
    """

    def compare(rows: list[tuple]) -> tuple[list, list, list]:
        key, i, j = rows[0][:3]
        cls, own = np.array([r[4] for r in rows]), np.array([r[3] for r in rows])
        size = np.array([r[5] for r in rows])
        unit = [np.frombuffer(r[6]) for r in rows]
        if len({len(u) for u in unit}) > 1 or len(rows) < 2:
            return [], [], []
        unit, keys = np.stack(unit), np.array([r[7] for r in rows])
        left, right = (np.where(own == i)[0], np.where(own == j)[0]) if i != j else (np.arange(len(rows)),) * 2
        a, b = np.nonzero(unit[left] @ unit[right].T >= COSINE)
        a, b = left[a], right[b]
        a, b = (a[a < b], b[a < b]) if i == j else (a, b)
        n, first = np.zeros(len(rows), np.int64), np.zeros(len(a), np.int64)
        for s in range(0, len(a), 20_000):
            x, y = (keys[z[s : s + 20_000]].reshape(-1, TABLES, 1 + HALVES * PROBES) for z in (a, b))
            shared = (x[:, :, :, None] == y[:, :, None]).any(3)
            first[s : s + 20_000] = np.where(shared, x, np.iinfo(np.int64).max).min((1, 2))
        here = first == key
        np.add.at(n, a[here], size[b[here]])
        np.add.at(n, b[here], size[a[here]])
        root, before = np.arange(len(rows)), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            root = root[root]
        hit = np.unique(np.concatenate([a, b]))
        return cls[hit].tolist(), n[hit].tolist(), cls[root[hit]].tolist()

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    for o, x in zip(out, compare(held)):
                        o += x
                    held = []
                held.append(row)
            yield _batch(out)
        if held:
            yield _batch(compare(held))

    def _batch(out):
        return pa.RecordBatch.from_pydict({"cls": pa.array(out[0], pa.string()), "n": pa.array(out[1], pa.int64()), "other": pa.array(out[2], pa.string())})

    return blocks.mapInArrow(run, "cls string, n long, other string")


def linked_vectors(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of the table.

    Vectors are linked at a cosine of at least COSINE, whatever their other columns say. Vectors
    that are null, empty, zero, of another length, or hold a null or non-finite value link with
    nothing, nor do rows without a vec_id. Equal vectors are one class whose members are linked
    with each other; n_links counts rows. Cells of more than BLOCK classes are compared block by
    block in many tasks; nothing is emitted by pairs.
    """
    rows = materialize(prepared(table), "vectors")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.min("unit").alias("unit"))
    classes = materialize(classes, "vector-classes")
    keyed = materialize(_keyed(classes), "cells")
    keys = keyed.select("cls", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = materialize(keys.groupBy("key").agg(F.count("*").alias("in_cell")).where("in_cell > 1"), "cell-sizes")
    met = keys.join(sizes, "key").withColumn("blocks", F.ceil(F.col("in_cell") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("cls", "key"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls")
    met = met.join(classes.select("cls", "size", "unit"), "cls").join(keyed, "cls").select("key", "i", "j", "own", "cls", "size", "unit", "keys")
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = materialize(_links(met.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")), "vector-links")
    roots = materialize(connected_components(found.select(F.col("cls").alias("a"), F.col("other").alias("b"))), "vector-roots")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    named = classes.select("cls", "least", "size").join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "cls")), "vector-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("cls", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    whole = rows.select("vec_id", "cls").join(materialize(named, "vector-components"), "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_embedding_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
