"""Language of words and documents by a linear-chain conditional random field.

Each word is scored for each language by its beginnings and endings, its n-grams and itself as
an entry of the lexicon, all as hashed features with learned weights. Learned transitions say how
likely a text changes its language from one word to the next. Forward-backward gives the
probability of each language at each word, also in text that switches between languages; a
document has the language with the largest share, its words counted by their letters.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import held_out

#: Documents of the training sample, shared evenly among the languages and chosen by a hash of their
#: ids, those that each language has at least (all, if it has fewer), and windows taken from each.
MOST_DOCUMENTS, LEAST_DOCUMENTS = 1500, 15
WINDOWS, WINDOW_WORDS = 8, 40
BUCKETS = 1 << 17
EPOCHS, BATCH, RATE, DECAY = 3, 128, 0.3, 1e-6
#: Words of one block of sequences, and words whose scores a worker remembers; with more than
#: FEW_LANGUAGES, fewer in proportion, so that the memory stays.
BLOCK_WORDS, REMEMBERED, FEW_LANGUAGES = 200_000, 400_000, 16

#: Letters of a run that enter the chain as one word; longer runs are cut into pieces.
LONGEST = 40

#: Letters, each with the marks that combine with it; numbers such as one half are none.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*+").findall


def pieces(words: list[str]) -> list[str]:
    """The words, with each of over LONGEST letters as consecutive pieces.

    A piece begins with `<` if it begins its word and with `=` if not, and ends with `>` if it
    ends it. Adjoining pieces share two letters, so each n-gram of the word is in one of them,
    and the last is long enough for all endings.
    """
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out: list[str] = []
    for word in words:
        if len(word) <= LONGEST:
            out.append(word)
        else:
            data = f"<{word}>"
            starts = range(0, len(data) - 4, LONGEST)
            out += [("=" if i else "") + data[i : None if i == starts[-1] else i + LONGEST + 2] for i in starts]
    return out


def letters_of(piece: str) -> int:
    """Letters of a word or piece, those shared with the piece before it left out."""
    if piece[0] not in "<=":
        return len(piece)
    return len(piece) - (1 if piece[0] == "<" else 3) - (piece[-1] == ">")


def features(word: str) -> list[int]:
    """Buckets of a word's affixes, n-grams and lexicon entry; a piece has those affixes that its word has there."""
    crc, data = zlib.crc32, word.removeprefix("=") if word[0] in "<=" else f"<{word}>"
    n = len(data)
    names = [f"p{data[:k]}" for k in range(2, min(n, 5) + 1)] if data[0] == "<" else []
    names += [f"s{data[-k:]}" for k in range(2, min(n, 5) + 1)] if data[-1] == ">" else []
    names += [f"g{data[i:i + 3]}" for i in range(n - 2)] + [f"c{x}" for x in set(word) if x > "\x7f"]
    names.append(f"w{word}")
    return [crc(x.encode("utf-8", "replace")) % BUCKETS for x in names]


def forward_backward(emit: np.ndarray, counts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward probabilities up to a factor each row. emit: exp scores, step by step; counts:
    sequences at each step, longest first."""
    at = np.concatenate([[0], np.cumsum(counts)])
    ahead, behind, last = np.empty_like(emit), np.ones_like(emit), None
    for t, n in enumerate(counts):
        e = emit[at[t] : at[t] + n]
        f = e.copy() if last is None else (last[:n] @ move) * e
        f /= f.sum(1, keepdims=True)
        ahead[at[t] : at[t] + n] = last = f
    for t in range(len(counts) - 2, -1, -1):
        m = counts[t + 1]
        now = (behind[at[t + 1] : at[t + 1] + m] * emit[at[t + 1] : at[t + 1] + m]) @ move.T
        behind[at[t] : at[t] + m] = now / now.sum(1, keepdims=True)
    return ahead, behind


def chain(emit: np.ndarray, counts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Posteriors of each step."""
    post, behind = forward_backward(emit, counts, move)
    post *= behind
    post /= post.sum(1, keepdims=True)
    return post


def by_steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences laid end to end, longest first: positions in order of steps, and sequences a step."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    steps = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    return np.lexsort((np.repeat(np.arange(len(lengths)), lengths), steps)), counts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    move: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [features(w) for w in words]
        flat = np.fromiter((x for f in found for x in f), np.int64, sum(map(len, found)))
        starts = np.cumsum([0, *map(len, found)][:-1])
        return np.add.reduceat(self.weights[flat], starts, axis=0) if len(found) else np.zeros((0, len(self.languages)))


def slopes(rows: list[tuple[list[str], list[int]]], feats: dict[str, list[int]], weights: np.ndarray, tran: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that the rows (words, labels; longest first) touch, and the slopes of the negative log
    likelihood of the labels by those buckets' weights and by the transitions: expected less seen."""
    k = weights.shape[1]
    lengths = np.array([len(words) for words, _ in rows])
    index, counts = by_steps(lengths)
    words = [w for row, _ in rows for w in row]
    labels = np.array([y for _, row in rows for y in row])
    flat = np.fromiter((x for w in words for x in feats[w]), np.int64)
    sizes = np.array([len(feats[w]) for w in words])
    scores = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
    emit = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(tran)
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    ahead[index], behind[index] = forward_backward(emit[index], counts, move)
    slope = ahead * behind
    slope /= slope.sum(1, keepdims=True)
    slope[np.arange(len(labels)), labels] -= 1
    touched, place = np.unique(flat, return_inverse=True)
    by_weight = np.empty((len(touched), k))
    for c in range(k):
        by_weight[:, c] = np.bincount(place, np.repeat(slope[:, c], sizes), len(touched))
    # Moves from one word to the next; the ends of sequences are no moves.
    here = np.ones(len(labels), bool)
    here[np.cumsum(lengths) - 1] = False
    i = np.where(here)[0]
    a, b = ahead[i], emit[i + 1] * behind[i + 1]
    a /= ((a @ move) * b).sum(1, keepdims=True)
    by_move = (a.T @ b) * move - np.bincount(labels[i] * k + labels[i + 1], minlength=k * k).reshape(k, k)
    return touched, by_weight, by_move


def train(windows: list[tuple[str, list[str]]]) -> Model | None:
    """AdaGrad on the likelihood of word labels; every third sequence is spliced from two languages."""
    windows = [w for w in windows if w[1]]
    if not windows:
        return None
    languages = sorted({lang for lang, _ in windows})
    number = {x: i for i, x in enumerate(languages)}
    windows = [(number[x], words) for x, words in windows]
    rng, k = np.random.default_rng(7), len(languages)
    feats = {w: features(w) for _, words in windows for w in words}
    weights, squares = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1e-2)
    tran, tran_sq = np.zeros((k, k)), np.full((k, k), 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = []
            for j, i in enumerate(order[at : at + BATCH]):
                y, words = windows[i]
                labels = [y] * len(words)
                if j % 3 == 0:
                    z, more = windows[rng.integers(len(windows))]
                    cut, upto = rng.integers(len(words) + 1), rng.integers(len(more) + 1)
                    words, labels = words[:cut] + more[:upto] + words[cut:], labels[:cut] + [z] * upto + labels[cut:]
                rows.append((words, labels))
            rows.sort(key=lambda r: -len(r[0]))
            touched, g, move = slopes(rows, feats, weights, tran)
            g += DECAY * weights[touched]
            squares[touched] += g * g
            weights[touched] -= RATE * g / np.sqrt(squares[touched])
            tran_sq += move * move
            tran -= RATE * move / np.sqrt(tran_sq)
    return Model(languages, weights.astype(np.float32), np.exp(tran))


def sample(docs: DataFrame, most: int = MOST_DOCUMENTS) -> list[tuple[str, list[str]]]:
    """Windows of words from about `most` documents with a language that aren't held out.

    Every language with such a document is in it: they share `most` evenly, those with few
    documents leave theirs to the others, and LEAST_DOCUMENTS of each are taken in any case. The driver gets a row
    of each language and WINDOWS x WINDOW_WORDS words of each document, evenly spread over its text.
    """
    known = docs.where("lang is not null and doc_id is not null").where(~held_out())
    hashed = F.xxhash64("doc_id")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    left, quota = most, {}
    for at, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        quota[lang] = min(sizes[lang], max(left // (len(sizes) - at), LEAST_DOCUMENTS))
        left = max(left - quota[lang], 0)
    # Hashes up to a bound hold about twice the share; of these few, the smallest are taken.
    bounds = [(x, n, min((1 << 63) - 1, int((2 * n + 50) / sizes[x] * (1 << 64)) - (1 << 63))) for x, n in quota.items()]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, quota long, bound long"))
    few = known.select("doc_id", "lang").join(bounds, "lang").where(hashed <= F.col("bound")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))
    chosen = few.withColumn("place", place).where("place <= quota").select("doc_id", "lang")

    def cut(batches):
        for batch in batches:
            keys, langs, parts = [], [], []
            for key, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = pieces(WORDS((text or "").lower()))
                n = min(WINDOWS, -(-len(words) // WINDOW_WORDS))
                for i in range(n):
                    start = i * max(len(words) - WINDOW_WORDS, 0) // max(n - 1, 1)
                    keys.append(key)
                    langs.append(lang)
                    parts.append(" ".join(words[start : start + WINDOW_WORDS]))
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(keys, pa.int64()), "lang": pa.array(langs, pa.string()), "words": pa.array(parts, pa.string())}
            )

    found = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy(hashed.alias("key"), "lang").agg(F.min("text").alias("text"))
    rows = found.mapInArrow(cut, "key long, lang string, words string").toArrow().to_pylist()
    return [(r["lang"], r["words"].split(" ")) for r in sorted(rows, key=lambda r: (r["key"], r["lang"], r["words"]))]


class _Scores:
    """Emissions of remembered words; rows of a table that grows."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.at) > REMEMBERED * FEW_LANGUAGES // max(FEW_LANGUAGES, self.table.shape[1]):
            self.at.clear()
        new = list({w for words in texts for w in words if w not in self.at})
        n = len(self.at)
        if n + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:n], np.zeros((n + 2 * len(new), self.table.shape[1]), np.float32)])
        scores = self.model.emissions(new)
        self.table[n : n + len(new)] = np.exp(scores - scores.max(1, keepdims=True)) if new else 0
        self.at.update(zip(new, range(n, n + len(new))))
        return [np.fromiter(map(self.at.__getitem__, words), np.int64, len(words)) for words in texts]


def label_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switches: one row for each row of docs, without a shuffle.

    lang_pred is the language with the largest share of the letters (the first by name of equal
    ones), score that share, n_words its runs of letters, n_switches how often the likeliest language changes
    between adjoining words or pieces of them. A text that is null or has no letter, or any text if nothing was learned, is `und` with
    score 0. Whole texts of any length are labelled; repeated rows stay; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)
    held: list[_Scores] = []

    def block(texts: list[list[str]], runs: list[int], out: list) -> None:
        own = model.value
        if not held:
            held.append(_Scores(own))
        order = sorted((i for i, words in enumerate(texts) if words), key=lambda i: -len(texts[i]))
        if not order:
            return
        rows = held[0].rows([texts[i] for i in order])
        lengths = np.array([len(texts[i]) for i in order])
        index, counts = by_steps(lengths)
        emit = held[0].table[np.concatenate(rows)].astype(np.float64)
        post = np.empty_like(emit)
        post[index] = chain(np.maximum(emit[index], 1e-30), counts, own.move)
        letters = np.fromiter((letters_of(w) for i in order for w in texts[i]), np.float64, lengths.sum())
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        share = np.add.reduceat(post * letters[:, None], starts, axis=0) / np.add.reduceat(letters, starts)[:, None]
        best = post.argmax(1)
        change = np.concatenate([[0], best[1:] != best[:-1]])
        change[starts] = 0
        change = np.add.reduceat(change, starts)
        for i, s, n in zip(order, share, change):
            j = int(s.argmax())
            out[i] = (own.languages[j], min(1.0, float(s[j])), runs[i], int(n))

    def run(batches):
        for batch in batches:
            out = [("und", 0.0, 0, 0)] * batch.num_rows
            if model.value is not None:
                texts: list[list[str]] = []
                runs: list[int] = []
                first = held_words = 0
                for i, text in enumerate(batch.column(1).to_pylist()):
                    words = WORDS((text or "").lower())
                    runs.append(len(words))
                    texts.append(pieces(words))
                    held_words += len(texts[-1])
                    if held_words * max(FEW_LANGUAGES, len(model.value.languages)) >= BLOCK_WORDS * FEW_LANGUAGES or i == batch.num_rows - 1:
                        part = out[first : i + 1]
                        block(texts, runs, part)
                        out[first : i + 1], first, texts, runs, held_words = part, i + 1, [], [], 0
            lang, score, words, switches = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                    "n_words": pa.array(words, pa.int64()), "n_switches": pa.array(switches, pa.int64()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, n_words long, n_switches long"
    )


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = label_documents(docs, train(sample(docs)))
    return labelled.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
