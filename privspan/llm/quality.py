"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of counts: pairs of adjoining character classes, and terms that say how
it is laid out (repeated words and lines, letters in capitals, marks, word lengths). Counts are
damped, weighted by inverse document frequency and projected on the leading singular vectors of
a bounded sample of labelled documents. That projection and the sample's own vectors are
broadcast; every document is compared with all of them by blocked cosine products, and its
nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ._shared import held_out

#: Labelled documents that the model keeps at most, chosen by a hash of their ids.
MOST_LABELLED = 6000
DIMENSIONS = 48
NEIGHBOURS = 15
#: A neighbour's weight is its similarity to this power.
SHARPNESS = 8
THRESHOLD = 0.3
#: Documents of one block of cosine products.
BLOCK = 256

CLASSES = np.full(256, 39, np.uint8)
for _i in range(26):
    CLASSES[[97 + _i]] = _i
CLASSES[65:91] = 26
CLASSES[48:58] = 27
CLASSES[[9, 11, 12, 13, 32]] = 28
CLASSES[10] = 29
for _i, _marks in enumerate((b".", b",", b"!?", b"'\"", b"()[]{}", b"#$%&*", b"|<>/\\", b"-_=+~^", b":;@`")):
    CLASSES[list(_marks)] = 30 + _i
WIDTH = 40
PAIRS = WIDTH * WIDTH
LAYOUT = 9
FEATURES = PAIRS + LAYOUT
#: A layout term counts this many times as much as a share of the class pairs.
LAYOUT_WEIGHT = 2.0


def _layout(data: bytes) -> list[float]:
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    again = sum(map(bytes.__eq__, words, words[1:]))
    letters = max(len(data), 1)
    return [
        again / n,
        1 - len(set(words)) / n if n > 20 else 0.0,
        1 - len(set(lines)) / m,
        min(len(data) / n, 60) / 60,
        min(n / m, 200) / 200,
        min(n, 30) / 30,
        data.count(b" | ") / n,
        sum(map(data.count, (b"!", b"#", b"$", b"%", b"&", b"*"))) / letters,
        1.0,
    ]


def count_features(texts: list[bytes]) -> np.ndarray:
    """One row a text: counts of class pairs, then the layout terms. An empty text has no pairs."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for k, data in enumerate(texts):
        if len(data) > 1:
            c = CLASSES[np.frombuffer(data, np.uint8)].astype(np.intp)
            out[k, :PAIRS] = np.bincount(c[:-1] * WIDTH + c[1:], minlength=PAIRS)
        out[k, PAIRS:] = _layout(data)
    return out


def _damped(counts: np.ndarray) -> np.ndarray:
    x = counts.copy()
    pairs = x[:, :PAIRS]
    pairs /= np.maximum(pairs.sum(1, keepdims=True), 1)
    np.sqrt(pairs, out=pairs)
    return x


#: Rows that fit() projects at once.
FITTED = 512


@dataclass
class Model:
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = (_damped(counts) * self.weights) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The neighbours' weighted vote: 0 to 1; the labels' mean where nothing was learned."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, best, 1).astype(np.float64), 0) ** SHARPNESS + 1e-12
        return np.clip((w * self.labels[best]).sum(1) / w.sum(1), 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Latent axes and vectors of the sample; with no rows every score is 0.5."""
    if not len(labels):
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    blocks = [counts[at : at + FITTED] for at in range(0, len(counts), FITTED)]
    seen = sum((b[:, :PAIRS] > 0).sum(0) for b in blocks)
    weights = np.ones(FEATURES, np.float32)
    weights[PAIRS:] = LAYOUT_WEIGHT
    weights[:PAIRS] = np.log((1 + len(counts)) / (1 + seen)) + 1
    # The driver holds the counts already: no second copy, and no rows of the Gram matrix for pairs that no text has.
    used = np.nonzero(np.concatenate([seen > 0, np.ones(LAYOUT, bool)]))[0]
    gram = np.zeros((len(used), len(used)))
    for b in blocks:
        x = (_damped(b) * weights)[:, used]
        gram += x.T @ x
    values, axes = np.linalg.eigh(gram)
    best = np.argsort(-values)[:DIMENSIONS]
    keep = np.zeros((FEATURES, len(best)), np.float32)
    keep[used] = axes[:, best]
    model = Model(weights, keep, np.zeros((0, keep.shape[1]), np.float32), labels.astype(np.float64), float(labels.mean()))
    model.vectors = np.concatenate([model.project(b) for b in blocks])
    return model


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of at most `most` labelled documents that aren't held out.

    They are the first by a hash of doc_id and label, which runs over all labelled rows; the
    driver gets their counts, a bounded table, and never their texts.
    """
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("_label")).where(~held_out())
    present = docs.select("doc_id").where("doc_id is not null").distinct()
    chosen = marked.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(most)

    def count(batches):
        for batch in batches:
            x = count_features(_texts(batch.column(2))).astype(np.float32)
            rows = [zlib.compress(r.tobytes(), 1) for r in x]  # nearly all are zeros
            yield pa.RecordBatch.from_pydict(
                {"key": batch.column(0), "label": batch.column(1), "counts": pa.array(rows, pa.binary())}
            )

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # An id that repeats brings one row.
    found = found.groupBy(F.xxhash64("doc_id").alias("key")).agg(F.min(F.struct(F.col("_label").alias("label"), "text")).alias("row"))
    rows = found.select("key", "row.label", "row.text").mapInArrow(count, "key long, label int, counts binary").toArrow()
    # The counts are read where they lie and copied once, into their places in the order of the keys.
    keys = rows["key"].to_numpy()
    place, at = np.empty(len(keys), np.int64), 0
    order = np.argsort(keys, kind="stable")
    place[order] = np.arange(len(keys))
    x = np.zeros((len(keys), FEATURES), np.float32)
    for chunk in rows["counts"].chunks:  # to_pylist() would hold them all again
        for value in chunk:
            x[place[at]] = np.frombuffer(zlib.decompress(value.as_buffer()), np.float32)
            at += 1
    return x, rows["label"].to_numpy()[order].astype(np.int64)


def _scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """rows, whose last column is a text, with score in its place."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, most)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                score = model.value.score(count_features(_texts(part.columns[-1])))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score, pa.float64())], names=[*part.schema.names[:-1], "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1]]).add("score", DoubleType()))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of each row of docs, in one pass without a shuffle.

    Whole texts are scored, null and empty ones too; doc_id, lang, source and the labels are no
    inputs. Without usable labels every score is 0.5. Repeated rows stay and score alike. Of
    neighbours equally near, which vote is up to their order in the sample, the same for every
    document and run. Texts of any length are read whole; an empty table gives no rows.
    """
    return _scored(docs.select("doc_id", "text"), docs, labels, most)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """The documents that score at least the threshold; the columns stay as they are."""
    # The row travels as one column, so that no column of docs can clash with the score.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return _scored(rows, docs, labels, most).where(F.col("score") >= threshold).select("row.*")


def op3_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
