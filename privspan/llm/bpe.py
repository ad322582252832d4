"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has exactly one encoding, so exactly one token can come last in
it. A PrefixTable stores that token for each prefix. It is the only token that ends there and may
follow the last token of the prefix before it, where two tokens may stand side by side if
merging their joined bytes gives the two back. Reading a prefix's encoding is a walk back over
the table; bytes can be appended exactly, and after an edit the table is recomputed only until
it agrees with what was there before.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: \s, \p{L} and \p{N} among the first 256 code points, and the white space of Unicode.
LATIN = {r"\s": r"\t-\r \x85\xa0", r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾"}
WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Pieces whose encoding a worker remembers before it starts afresh.
REMEMBERED = 400_000


class Vocabulary:
    """Tokens by rank, and which of them may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Every ending of a token, with the token that it is or -1: no token matches beyond an ending that isn't here.
        self.endings = {t[i:]: -1 for t in ranks for i in range(len(t))} | ranks
        self._side: dict[tuple[int, int], bool] = {}
        self._sole: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the adjacent pair of the lowest rank, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        known = self._side.get((a, b))
        if known is None:
            if len(self._side) > 2_000_000:
                self._side.clear()
            known = self._side[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def extend(self, data: bytes, last: list[int], end: int) -> int:
        """The last token of data[:end], if last holds those of all shorter prefixes."""
        token_of, side = self.endings.get, self._side.get
        for start in range(end - 1, -1, -1):
            token = token_of(data[start:end])
            if token is None:
                break
            if token >= 0:
                if not start:
                    if self.may_start(token):
                        return token
                else:
                    before = last[start - 1]
                    known = side((before, token))
                    if known or known is None and self.may_follow(before, token):
                        return token
        raise ValueError(f"no token ends at byte {end}; the vocabulary lacks a byte")

    def may_start(self, a: int) -> bool:
        known = self._sole.get(a)
        if known is None:
            known = self._sole[a] = self.merge(self.tokens[a]) == [a]
        return known


class PrefixTable:
    """The last token of every prefix of a growing or edited byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.extend(self.data, self.last, end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """data[start:stop] becomes new. Returns how many prefixes were computed again."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same = old[:start], 0
        for end in range(start + 1, len(self.data) + 1):
            token = self.vocabulary.extend(self.data, self.last, end)
            self.last.append(token)
            before = end - shift
            same = same + 1 if end > start + len(new) and old[before - 1] == token else 0
            if same >= self.vocabulary.longest:  # no later choice looks further back than this
                self.last += old[before:]
                return end - start
        return len(self.data) - start

    def encode(self, upto: int | None = None) -> list[int]:
        end, ids = len(self.data) if upto is None else upto, []
        while end:
            ids.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[ids[-1]])
        return ids[::-1]


class Encoder:
    """Texts to ids as the tiktoken library gives them: each match of the pattern by itself."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary.load(path)
        fast = pattern.replace(r"(?!\S)", f"(?![^{LATIN[r'\s']}])").replace(r"\s+", f"[{LATIN[r'\s']}]+")
        for k in LATIN:  # what is left stands within classes or alone
            fast = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(k, LATIN[k]), fast).replace(k, f"[{LATIN[k]}]")
        slow = pattern.replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s+", f"[{WHITE}]+").replace(r"\s", WHITE)
        self.fast, self.slow = re.compile(fast).findall, regex.compile(slow).findall
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.slow(text)
        return self.fast(text)

    def encode_piece(self, piece: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a piece that is a token is that token."""
        data = piece.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else PrefixTable(self.vocabulary, data).encode()
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        known, out = self.known, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, ids_sha256, decoded_sha256.

    One row for each row of docs, without a shuffle. Null and empty texts have no tokens. Texts of
    any length are encoded whole; the table of a piece takes a few words a byte. Repeated rows
    stay. The vocabulary file is read on the executors by its installed path.
    """

    def run(batches):
        code = encoder(path)
        for batch in batches:
            packed, decoded = [], []
            for text in batch.column(1).to_pylist():
                packed.append(code.encode(text or ""))
                decoded.append(hashlib.sha256(code.decode(packed[-1])).hexdigest())
            out = {
                "doc_id": batch.column(0),
                "ids": pa.array(packed if keep_ids else [None] * len(packed), pa.binary()),
                "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encode_texts(); bytes that are no UTF-8 become replacement characters."""

    def run(batches):
        code = encoder(path)
        for batch in batches:
            texts = [None if p is None else code.decode(p).decode("utf-8", "replace") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False).drop("ids")
