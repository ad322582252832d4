"""Token ids in binary files, compressed document by document with one zstandard dictionary.

A folder holds a dictionary, trained on serialized id arrays, shards, and a list of the shards. A
shard holds a frame for each document, in ascending order of ids, then an offset index: any one
document is read by its own few bytes. Frames carry two bytes an id (four for larger vocabularies),
little-endian; every shard names the hash of the dictionary that its frames need.

    shard = MAGIC, hash of the dictionary (32 bytes), frames, index, place of the index (8), MAGIC
    index = Arrow stream of doc_id, offset, n_bytes, n_tokens; one row a document; metadata: width
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, shared_folder

MAGIC = b"TOKFILE1"
END_ID = 0
LEVEL = 3
#: The dictionary learns from this many windows of texts at most, each of so many characters.
WINDOWS, WINDOW = 2000, 4000
DICTIONARY_BYTES = 112_640
#: A task begins another shard when one has grown to either, so that what it holds of an index is bounded.
SHARD_BYTES, SHARD_DOCUMENTS = 1 << 28, 1 << 20
#: Pieces of text whose ids a worker remembers, twice over, and rows that it encodes at once.
REMEMBERED, AT_ONCE = 400_000, 256


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """A file system and the path in it, of a path or a URI, on whatever machine this runs."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if "://" in folder:
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.LocalFileSystem(), folder


def _read_whole(folder: str, name: str) -> bytes:
    fs, path = _place(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def _write_whole(folder: str, name: str, data: bytes) -> None:
    fs, path = _place(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}") as f:
        f.write(data)


# Encoding.

#: White space before what is none begins a new token whatever stands before, and tokens hold white space only at their
#: start or nothing else: texts may be cut there. Texts with any other blank or invisible character are not cut.
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_OTHER_BLANK = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
#: A text without these, and with none of its blanks at an end, is cut before every space and new line.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\0")
_WORD = re.compile(r" [^ \t\n\r]+")
#: A new line, a word of Latin letters and punctuation other than an apostrophe: a token run each, whatever stands around them.
_PLAIN = re.compile(r"(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


class Encoder:
    """Ids of texts by the tokenizers library, packed little-endian; strings of special tokens are ordinary text.

    A byte-level tokenizer without a normalizer sees each piece of text once. Pieces that are not
    remembered are encoded together, and the lengths of their tokens tell where each ends; a plain
    word goes to the library's model as it is, since nothing can divide it before. The pieces seen
    last stay when others are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        split = made.get("pre_tokenizer") or {}
        self.by_pieces = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not made.get("normalizer")
        self.length = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.length[i] = len(token)
        self.packed = [i.to_bytes(self.type.itemsize, "little") for i in range(len(self.length))]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(printable))}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, piece: str) -> bytes:
        """Ids of a piece that is one run of the tokenizer's pattern."""
        found = self.known.get(piece) or self.older.get(piece)
        if found is None:
            run = piece.encode().decode("latin-1").translate(self.alphabet)
            found = b"".join([self.packed[t.id] for t in self.library.model.tokenize(run)])
        self.known[piece] = found
        return found

    def _learn(self, pieces: set[str]) -> None:
        words, rest = [], []
        for p in pieces:
            found = self.older.get(p)
            if found is not None:
                self.known[p] = found
            elif plain := _PLAIN.fullmatch(p):
                self.known[p] = b"".join([self._run(run) for run in plain.groups() if run])
            else:
                (words if _WORD.fullmatch(p) else rest).append(p)
        if words:
            ids = np.frombuffer(self._whole(["".join(words)])[0], self.type)
            ends = (np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(w.encode()) for w in words])) + 1).tolist()
            self.known.update(zip(words, (ids[a:b].tobytes() for a, b in zip([0, *ends], ends))))
        self.known.update(zip(rest, self._whole(rest)))

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if _OTHER_BLANK.search(text):
            return [text]
        if any(r in text for r in _RUNS) or text[:1] in " \n" or text[-1:] in " \n":
            return _PIECE.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_pieces:
            return self._whole(texts)
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        pieces = [self._pieces(t) for t in texts]
        self._learn(set().union(*(own for own in pieces if len(own) != 1)).difference(self.known))
        single = iter(self._whole([own[0] for own in pieces if len(own) == 1]))
        return [next(single) if len(own) == 1 else b"".join(map(self.known.__getitem__, own)) for own in pieces]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(column: pa.Array) -> list[str]:
    """Null is empty; bytes that are no UTF-8 become replacement characters."""
    return [(b or b"").decode("utf-8", "replace") for b in column.to_pylist()]


def _encoded(batches: Iterator[pa.RecordBatch], column: int, tokenizer: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            yield part, encoder(tokenizer).encode(_texts(part.column(column)))


# Dictionary and shards.


def trained_dictionary(docs: DataFrame, tokenizer: str, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the ids of at most WINDOWS windows of WINDOW characters; empty if there is too little to learn from.

    Texts are chosen by the smallest hashes, and the place of a window by the hash too: the same
    table gives the same dictionary. It decides how small files get, never what they hold.
    """
    rows = docs.select("text", F.xxhash64("text").alias("h")).where(F.length("text") > 0)
    chosen = F.broadcast(rows.select("h").distinct().orderBy("h").limit(WINDOWS))
    at = F.pmod("h", F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    windows = rows.join(chosen, "h").groupBy("h").agg(F.min(F.substring("text", at, F.lit(WINDOW))).alias("w"))

    def run(batches):
        for _, ids in _encoded(batches, 0, tokenizer):
            yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary())})

    samples = sorted(bytes(r.ids) for r in windows.select(F.col("w").cast("binary").alias("w")).mapInArrow(run, "ids binary").collect() if len(r.ids) >= 16)
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    size = min(size, sum(map(len, samples)) // 8)
    return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()


class _ShardWriter:
    def __init__(self, folder: str, name: str, dictionary: bytes, width: int, id_type: pa.DataType):
        self.fs, path = _place(folder)
        self.name, self.width, self.id_type = name, width, id_type
        self.out = self.fs.open_output_stream(f"{path}/{name}")
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.at = len(MAGIC) + 32
        self.ids: list[pa.Array] = []
        self.offset: list[int] = []
        self.n_bytes: list[int] = []
        self.n_tokens: list[int] = []

    def add(self, ids: pa.Array, frames: list[bytes], n_tokens: list[int]) -> None:
        self.ids.append(ids)
        self.n_tokens += n_tokens
        for frame in frames:
            self.out.write(frame)
            self.offset.append(self.at)
            self.n_bytes.append(len(frame))
            self.at += len(frame)

    def full(self, documents: int) -> bool:
        return self.at >= SHARD_BYTES or len(self.offset) >= documents

    def close(self) -> tuple[str, int, int, int]:
        """name, documents, tokens, bytes."""
        schema = pa.schema([("doc_id", self.id_type), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())], {"width": str(self.width)})
        index = pa.RecordBatch.from_arrays([pa.concat_arrays(self.ids), *[pa.array(x, pa.int64()) for x in (self.offset, self.n_bytes, self.n_tokens)]], schema=schema)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, schema) as w:
            w.write_batch(index)
        self.out.write(sink.getvalue() + self.at.to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.name, len(self.offset), sum(self.n_tokens), self.at


class Shard:
    """A shard that is open: documents by their place in it, each read and decompressed by itself."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        fs, path = _place(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        head, tail = self.file.read_at(len(MAGIC) + 32, 0), self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if head[: len(MAGIC)] != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{name} is no whole shard")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        at = int.from_bytes(tail[:8], "little")
        with pa.ipc.open_stream(self.file.read_at(size - 8 - len(MAGIC) - at, at)) as r:
            self.index = r.read_next_batch()
        self.type = np.dtype(f"<u{self.index.schema.metadata[b'width'].decode()}")
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        self.offset, self.n_bytes, self.n_tokens = (self.index.column(i).to_numpy() for i in (1, 2, 3))

    def __len__(self) -> int:
        return len(self.offset)

    def ids(self, i: int) -> np.ndarray:
        """All ids of document i, with the end id."""
        return np.frombuffer(self.zstd.decompress(self.file.read_at(int(self.n_bytes[i]), int(self.offset[i]))), self.type)

    def run(self, a: int, b: int) -> list[np.ndarray]:
        """The same of documents a to b - 1, by one read."""
        if a >= b:
            return []
        first = int(self.offset[a])
        whole = memoryview(self.file.read_at(int(self.offset[b - 1] + self.n_bytes[b - 1]) - first, first))
        return [np.frombuffer(self.zstd.decompress(whole[o : o + n]), self.type) for o, n in zip((self.offset[a:b] - first).tolist(), self.n_bytes[a:b].tolist())]

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Entry:
    """A shard in the list of shards: start is the number of ids in the shards before it."""

    name: str
    documents: int
    tokens: int
    n_bytes: int
    start: int


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_documents: int = SHARD_DOCUMENTS) -> list[Entry]:
    """Writes the ids of every text of docs (doc_id, text) into a new folder that all executors reach; gives its shards.

    Documents come in ascending order of doc_id, null ids first, rows of one id by a hash of their
    text; equal rows come as often as they are there, and a third of all rows may share an id.
    Null is an empty text, which has the end id alone; other columns are ignored. An empty table
    gives a folder without shards. A task that is run again writes files of other names, and only
    those of the run that ended well are listed. The list has one entry a shard.
    """
    dictionary = trained_dictionary(docs, tokenizer)
    _write_whole(folder, "dictionary", dictionary)
    order = ["doc_id", "_h", "_row"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], code.type).tobytes()
        zstd = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(LEVEL)
        done, shard = [], None
        for batch, encoded in _encoded(batches, 1, tokenizer):
            if shard is None:
                shard = _ShardWriter(folder, f"shard-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}", dictionary, code.type.itemsize, batch.column(0).type)
            shard.add(batch.column(0), [zstd.compress(ids + end) for ids in encoded], [len(ids) // code.type.itemsize + 1 for ids in encoded])
            if shard.full(shard_documents):
                done, shard = [*done, shard.close()], None
        if shard is not None:
            done.append(shard.close())
        for i, (name, documents, tokens, n_bytes) in enumerate(done):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "i": pa.array([i], pa.int32()), "name": [name], "documents": pa.array([documents], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "n_bytes": pa.array([n_bytes], pa.int64())})

    written = sorted(rows.mapInArrow(run, "part int, i int, name string, documents long, tokens long, n_bytes long").collect())
    entries, start = [], 0
    for r in written:
        entries.append(Entry(r.name, r.documents, r.tokens, r.n_bytes, start))
        start += r.tokens
    listed = {"dictionary": hashlib.sha256(dictionary).hexdigest(), "doc_id": dict(docs.dtypes)["doc_id"], "shards": [vars(e) for e in entries]}
    _write_whole(folder, "shards.json", json.dumps(listed).encode())
    return entries


def _listed(folder: str) -> tuple[str, list[Entry], bytes]:
    listed, dictionary = json.loads(_read_whole(folder, "shards.json")), _read_whole(folder, "dictionary")
    if hashlib.sha256(dictionary).hexdigest() != listed["dictionary"]:
        raise ValueError("the folder's dictionary is not the one its shards were written with")
    return listed["doc_id"], [Entry(**e) for e in listed["shards"]], dictionary


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids of every document of a folder: ids packed as little-endian unsigned 32-bit integers, the end id too.

    One task a shard; documents are read by runs of AT_ONCE.
    """
    id_type, entries, dictionary = _listed(folder)
    schema = f"doc_id {id_type}, start long, ids binary"
    if not entries:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = Shard(folder, entries[k].name, dictionary)
                starts = entries[k].start + np.concatenate([[0], np.cumsum(shard.n_tokens)[:-1]])
                for a in range(0, len(shard), AT_ONCE):
                    b = min(a + AT_ONCE, len(shard))
                    ids = [x.astype("<u4").tobytes() for x in shard.run(a, b)]
                    yield pa.RecordBatch.from_arrays([shard.index.column(0).slice(a, b - a), pa.array(starts[a:b], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
                shard.close()

    return spark.range(0, len(entries), 1, len(entries)).mapInArrow(run, schema)


def document_ids(folder: str, doc_id) -> list[np.ndarray]:
    """The ids of each document of that id, by the indexes and the frames of these documents alone."""
    _, entries, dictionary = _listed(folder)
    found = []
    for e in entries:
        shard = Shard(folder, e.name, dictionary)
        found += [shard.ids(i) for i, x in enumerate(shard.index.column(0).to_pylist()) if x == doc_id]
        shard.close()
    return found


def delete_token_files(folder: str) -> None:
    fs, path = _place(folder)
    fs.delete_dir(path)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what was read back from the files, which are then deleted."""
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    read = read_token_files(spark, folder)
    digests = materialize(read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "token-digests")
    delete_token_files(folder)
    return digests
