"""Removal of every byte string of LENGTH bytes that also starts elsewhere.

Each string of LENGTH bytes has an anchor: of its runs of GRAM bytes the one with the smallest
hash, the last of equal ones. Equal strings have equal anchors at equal places, so only the
surroundings of one anchor need comparing, and they are aligned. Surroundings that are equal as
a whole are counted and need no more. The others are fragments of a collection whose
Burrows-Wheeler transform and common prefixes are built column by column from the right: a
round inserts one symbol of every fragment, with which the order of the suffixes and the
lengths of common prefixes are updated in one sequential pass from file to file. A string is
repeated where a common prefix reaches LENGTH.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize

LENGTH, GRAM = 200, 32
#: A fragment: so many bytes before its anchor's start, and LENGTH from there on.
BEFORE = LENGTH - GRAM
WIDTH = BEFORE + LENGTH
#: Fragments of one anchor that one collection takes (some 150 MB); more are divided among several.
MOST_OF_ANCHOR = 1 << 16
#: Fragments of one collection, and bytes that are hashed at once: their arrays stay in a core's cache.
COLLECTION, STRIDE = 1 << 16, 1 << 16
ABSENT = 256

_rng = np.random.default_rng(LENGTH)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << 22) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, STRIDE + LENGTH), _powers(pow(_BASE, -1, 1 << 64), STRIDE + LENGTH)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and hash of the anchors of all strings of LENGTH bytes; a string lies within one text."""
    data, sizes = b"".join(texts), np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    places, hashes = [], []
    for start in range(0, len(data) - LENGTH + 1, STRIDE):
        part = np.frombuffer(data, np.uint8, min(STRIDE + LENGTH - 1, len(data) - start), start)
        n = len(part)
        with np.errstate(over="ignore"):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[part] * _UP[:n], dtype=np.uint64)])
            h = (run[GRAM:] - run[:-GRAM]) * _DOWN[: n - GRAM + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        least = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        span, width = 1, LENGTH - GRAM + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        own = owner[start : start + n]
        at = (_LOW - (least[own[: n - LENGTH + 1] == own[LENGTH - 1 :]] & _LOW)).astype(np.int64)
        if len(at):
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            places.append(at + start)
            hashes.append(h[at].view(np.int64))
    if not places:
        return (np.zeros(0, np.int64),) * 3
    place, first = np.unique(np.concatenate(places), return_index=True)
    return owner[place].astype(np.int64), place - begins[owner[place]], np.concatenate(hashes)[first]


def _whole(text: bytes | None) -> bytes:
    return text or b""


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, z: whole texts as compressed bytes, for a shuffle by document."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [_whole(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_key": pa.array(keys), "z": pa.array(list(map(pack, texts)), pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_key long, z binary")


def _occurrences(docs: DataFrame) -> DataFrame:
    """anchor, around (a hash of its fragment), doc_id, text_key, place."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [_whole(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                row, place, anchor = anchors(texts)
                around = []
                for i, p in zip(row.tolist(), place.tolist()):
                    data = texts[i]
                    # Where the text ends within a fragment is part of it.
                    around.append(digest(data[p - BEFORE if p > BEFORE else 0 : p + LENGTH], min(p, BEFORE) << 10 | min(len(data) - p, LENGTH)))
                keys = np.array([digest(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array(anchor), "around": pa.array(np.array(around, np.uint64).view(np.int64)),
                        "doc_id": part.column(0).take(pa.array(row)), "text_key": pa.array(keys[row]), "place": pa.array(place),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"anchor long, around long, doc_id {kind}, text_key long, place long")


def repeated_windows(fragments: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """By fragment and d: whether the string that starts d bytes before the anchor is in another
    fragment too, and whether it is not the first of its equals. fragments: bytes, anchor's place.

    Between rounds the order of suffixes and their common prefixes are in files, as are the symbols.
    """
    n = len(fragments)
    again, later = np.zeros((n, BEFORE + 1), bool), np.zeros((n, BEFORE + 1), bool)
    symbols = np.full((n, WIDTH), ABSENT, np.uint16)
    for row, (data, at) in zip(symbols, fragments, strict=True):
        row[BEFORE - at : BEFORE - at + len(data)] = np.frombuffer(data, np.uint8)
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as orders, tempfile.TemporaryFile() as prefixes:
        np.ascontiguousarray(symbols[:, ::-1].T).tofile(columns)
        del symbols
        columns.seek(0)
        np.arange(n, dtype=np.int32).tofile(orders)
        np.zeros(n, np.uint16).tofile(prefixes)
        for column in range(WIDTH - 1, -1, -1):
            orders.seek(0)
            prefixes.seek(0)
            order, common = np.fromfile(orders, np.int32, n), np.fromfile(prefixes, np.uint16, n)
            symbol = np.fromfile(columns, np.uint16, n)[order]
            moved = np.argsort(symbol, kind="stable")
            symbol = symbol[moved]
            joined = np.nonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != ABSENT))[0] + 1
            new = np.zeros(n, np.uint16)
            if len(joined):
                spans = np.stack([moved[joined - 1] + 1, moved[joined] + 1], axis=1).ravel()
                new[joined] = np.minimum.reduceat(np.append(common, np.uint16(0)), spans)[::2] + 1
            order = order[moved]
            orders.seek(0)
            prefixes.seek(0)
            order.tofile(orders)
            new.tofile(prefixes)
            if column <= BEFORE:
                hit = np.nonzero(new >= LENGTH)[0]
                again[order[hit], BEFORE - column] = True
                again[order[hit - 1], BEFORE - column] = True
                later[order[hit], BEFORE - column] = True
    return again, later


def _compared(fragments: DataFrame) -> DataFrame:
    """For each fragment with repeats lo and hi, counted from its anchor; of divided anchors also strings.

    All strings of a fragment hold its anchor, so what they cover is one span. fragments is
    partitioned and sorted by anchor and part. Where an anchor's fragments are divided, a string
    of theirs can be repeated in another part: a row gives d and the hash of each string found
    alone in its collection, or of the first of its equals.
    """

    def flush(held):
        again, later = repeated_windows([(r[4], r[5]) for r in held])
        rows = np.nonzero(again.any(1))[0]
        first, last = again[rows].argmax(1), BEFORE - again[rows][:, ::-1].argmax(1)
        out = {n: [held[i][k] for i in rows.tolist()] for n, k in (("anchor", 0), ("around", 2))}
        yield _found(**out, lo=(-last).astype(np.int32), hi=(LENGTH - first).astype(np.int32))
        anchor, around, ds, strings, alone = [], [], [], [], []
        for r, found, after in zip(held, again, later):
            if r[3] > 1:
                data, at = r[4], r[5]
                for d in np.nonzero(~after[: at + 1])[0].tolist():
                    if at - d + LENGTH <= len(data):
                        anchor.append(r[0])
                        around.append(r[2])
                        ds.append(d)
                        strings.append(xxhash.xxh3_64_intdigest(data[at - d : at - d + LENGTH]))
                        alone.append(not found[d])
        for s in range(0, len(ds), 50_000):
            yield _found(
                anchor[s : s + 50_000], around[s : s + 50_000], d=np.array(ds[s : s + 50_000], np.int32),
                string=np.array(strings[s : s + 50_000], np.uint64).view(np.int64), alone=np.array(alone[s : s + 50_000]),
            )

    def _found(anchor, around, **columns):
        n = len(anchor)
        fields = {"lo": pa.int32(), "hi": pa.int32(), "d": pa.int32(), "string": pa.int64(), "alone": pa.bool_()}
        rest = {k: pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in fields.items()}
        return pa.RecordBatch.from_pydict({"anchor": pa.array(anchor, pa.int64()), "around": pa.array(around, pa.int64()), **rest})

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= COLLECTION and held[-1][:2] != row[:2]:
                    yield from flush(held)
                    held = []
                held.append(row)
        if held:
            yield from flush(held)

    return fragments.select("anchor", "part", "around", "parts", "bytes", "at").mapInArrow(
        run, "anchor long, around long, lo int, hi int, d int, string long, alone boolean"
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, spans (lo, hi): the bytes of each document that repeated strings cover.

    Spans can overlap and can go beyond the text's ends; copies with one id give each place once.
    """
    whole = [F.lit(-BEFORE).alias("lo"), F.lit(LENGTH).alias("hi")]
    seen = materialize(_occurrences(docs), "anchors")
    often = seen.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("around") != F.max("around")).alias("mixed")).where("n > 1")
    met = materialize(seen.join(often.select("anchor", "mixed"), "anchor"), "met")
    place = F.struct("doc_id", "text_key", "place")
    kinds = met.where("mixed").groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    kinds = materialize(kinds, "kinds")
    parts = kinds.groupBy("anchor").agg(F.ceil(F.count("*") / MOST_OF_ANCHOR).cast("int").alias("parts"), F.min("n").alias("fewest")).where("fewest = 1")
    asked = kinds.join(materialize(parts, "parts"), "anchor").withColumn("part", F.pmod("around", "parts").cast("int"))
    asked = asked.groupBy("one.doc_id", "one.text_key").agg(F.collect_list(F.struct("one.place", "anchor", "around", "part", "parts")).alias("asked"))
    packed = _packed(docs)
    asked = packed.join(asked.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("z", "asked")

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                asked = part.column(1)
                bounds = asked.offsets.to_numpy()
                flat = asked.values.flatten()
                places = flat[0].to_pylist()
                data, at = [], []
                for i, z in enumerate(part.column(0).to_pylist()):
                    text = unpack(z)
                    for p in places[bounds[i] : bounds[i + 1]]:
                        data.append(text[p - BEFORE if p > BEFORE else 0 : p + LENGTH])
                        at.append(min(p, BEFORE))
                own = slice(bounds[0], bounds[-1])
                rest = {n: flat[k][own] for k, n in ((1, "anchor"), (2, "around"), (3, "part"), (4, "parts"))}
                yield pa.RecordBatch.from_pydict({**rest, "bytes": pa.array(data, pa.binary()), "at": pa.array(at, pa.int32())})

    fragments = asked.mapInArrow(cut, "anchor long, around long, part int, parts int, bytes binary, at int")
    shuffled = fragments.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "anchor", "part")
    found = materialize(_compared(shuffled.sortWithinPartitions("anchor", "part", "around")), "found")
    strings = found.where("d is not null")
    # At one anchor a place has one fragment, so rows that agree in all three are different places.
    twice = strings.groupBy("anchor", "d", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    across = strings.where("alone").join(twice, ["anchor", "d", "string"]).select("anchor", "around", (-F.col("d")).alias("lo"), (LENGTH - F.col("d")).alias("hi"))
    partly = found.where("lo is not null").select("anchor", "around", "lo", "hi").unionByName(across)
    partly = partly.groupBy("anchor", "around").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    covers = kinds.join(partly, ["anchor", "around"], "left").select("anchor", "around", *[F.when(F.col("n") > 1, w).otherwise(F.col(x)).cast("int").alias(x) for w, x in zip(whole, ("lo", "hi"))])
    covers = materialize(covers.where("lo is not null"), "covers")
    mixed = met.where("mixed").join(covers, ["anchor", "around"]).select("doc_id", "text_key", "place", "lo", "hi")
    every = met.where("not mixed").select("doc_id", "text_key", "place", *whole).unionByName(mixed)
    span = F.struct((F.col("place") + F.col("lo")).alias("lo"), (F.col("place") + F.col("hi")).alias("hi"))
    return every.groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("spans"))


def _merged(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs that the spans cover within 0 .. n."""
    order = np.argsort(lo, kind="stable")
    lo, hi = np.maximum(lo[order], 0), np.minimum(np.maximum.accumulate(hi[order]), n)
    new = np.nonzero(lo[1:] > hi[:-1])[0] + 1
    return lo[np.concatenate([[0], new])].tolist(), hi[np.concatenate([new - 1, [len(lo) - 1]])].tolist()


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left): a row for each row of docs.

    Texts are UTF-8 bytes, null ones empty; strings never cross documents, but may overlap and
    may repeat within one. Strings are judged on the input, not on what is left. Texts of fewer
    than LENGTH bytes stay whole. Rows that repeat a doc_id and its text are each other's copies.
    A text of one repeated byte has an anchor at each byte, and goes through like any other.
    An empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    spans = materialize(repeated_spans(docs), "spans")
    spans = spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    rows = _packed(docs).join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            spans = batch.column(2)
            bounds, (los, his) = spans.offsets.to_numpy(), (x.to_numpy(zero_copy_only=False) for x in spans.values.flatten())
            out = []
            for i, z in enumerate(batch.column(1).to_pylist()):
                left = data = unpack(z)
                starts: list[int] = []
                if bounds[i + 1] > bounds[i]:
                    starts, ends = _merged(los[bounds[i] : bounds[i + 1]], his[bounds[i] : bounds[i + 1]], len(data))
                    left = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)]))
                out.append((len(data), len(data) - len(left), len(starts), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            n, removed, count, digest, left = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(left, pa.binary()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = rows.select("doc_id", "z", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if keep_text else done.drop("kept")


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
