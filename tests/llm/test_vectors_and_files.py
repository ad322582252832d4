"""Whitening, Lloyd rounds and token files against plain versions of themselves."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import same_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from privspan.llm import licenses, lloyd, queries, token_files, whitening

JSON = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<double>, x string, n string, uid string, cluster string, w string"
OWN = ("own x", "own n", "own uid", "own cluster", "own w")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *OWN) for i, v in rows], VECTORS)


def odd_rows(d, seed=3):
    """Ordinary rows, a third of all rows equal, and every kind of row that can't be used."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 2, d).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (None, rng.normal(0, 2, d).tolist()), (61, [0.0] * d), (62, [-1e3] * d), (63, [0.25] + [1e2] * (d - 1))]
    bad = [(200, None), (201, []), (202, [1.0] * (d - 1)), (203, [1.0] * (d + 1)), (204, [None] * d), (205, [math.nan] * d), (206, [math.inf] + [0.0] * (d - 1)), (207, [1e30] + [0.0] * (d - 1))]
    return rows, bad


# Whitening.


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 70), st.integers(0, 34), st.integers(0, 2**32))
def test_cross_products_from_bit_planes(n, d, bits, seed):
    x = np.random.default_rng(seed).integers(-(1 << bits), 1 << bits, (n, d), endpoint=True)
    cross, total = whitening.cross_products(x)
    y = x.astype(object)
    assert (cross == y.T @ y).all() and (total == y.sum(0)).all()


def plain_whitening(rows, components=16):
    x = {k: np.array([math.floor(64 * c) + 1_000_000 for c in v], object) for k, v in enumerate(v for _, v in rows)}
    fit = [np.array(t, object) for t in {tuple(v) for v in x.values()}]
    n, total = len(fit), sum(fit)
    off = np.array([(n * f - total) for f in fit], float) / n
    v = off.T @ off / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    out = []
    for (key, _), own in zip(rows, x.values()):
        out.append((key, int(((n * own - total) ** 2).sum()), (np.array(n * own - total, float) / n) @ w / np.sqrt(e)))
    return n, e / np.trace(v), out


@pytest.mark.parametrize("d", [3, 20])
def test_whitening_equals_dense_algebra(spark, d):
    good, bad = odd_rows(d)
    got = whitening.whitened(vectors(spark, good + bad).repartition(3)).collect()
    n, share, want = plain_whitening(good)
    k = min(d, 16)
    assert len(got) == len(good) * k and {r.n for r in got} == {n} and n == 64
    by_key = {}
    for r in got:
        by_key.setdefault((r.vec_id, int(r.deviation)), {})[r.component] = r
    for key, deviation, w in want:
        own = by_key[key, deviation]
        sign = [1 if own[i + 1].whitened * w[i] >= 0 else -1 for i in range(k)]
        for i in range(k):
            assert own[i + 1].whitened == pytest.approx(sign[i] * w[i], rel=1e-6, abs=1e-6)
            assert own[i + 1].explained == pytest.approx(share[i], rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_without_variance_and_without_rows(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, odd_rows(4)[1][:2])).collect() == []
    same = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(same) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, None) for r in same)
    two = whitening.whitened(vectors(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 5.0])])).collect()
    assert [r.whitened is None for r in sorted(two)] == [False, True, True] * 2
    assert all(abs(r.whitened) == pytest.approx(1.0) and r.identity_error < 1e-12 for r in two if r.component == 1)


def test_deviation_beyond_a_long_is_exact(spark):
    rows = [(i, [float(1 << 30) * (i % 2), 0.5 * i]) for i in range(50)]
    got = {r.vec_id: r.deviation for r in whitening.whitened(vectors(spark, rows), components=1).collect()}
    _, _, want = plain_whitening(rows, 1)
    assert {k: int(v) for k, v in got.items()} == {k: v for k, v, _ in want} and max(v for _, v, _ in want) > 1 << 64


def test_op11_is_whole(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    got = queries.QUERIES["op11_whitening"](spark, small)
    assert dict(got.dtypes)["deviation"] == "bigint" and got.count() == 16 * table.count()
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9


# Lloyd.


def plain_lloyd(rows, d, k=16, rounds=3):
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows], np.int64).reshape(len(rows), d)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest() if rows[i][0] is not None else "", x[i].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        own = far.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (own == j).any():
                    c[j] = x[own == j].sum(0) // (own == j).sum()
    best = far.min(1)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return sorted(((rows[i][0] if rows[i][0] is not None else -1), int(own[i]), int(best[i]), int(best[own == own[i]].sum()), int(best.sum()), digest[own[i]]) for i in range(len(rows)))


@pytest.mark.parametrize(("d", "clusters"), [(64, 16), (64, 3), (20, 70), (5, 200)])
def test_lloyd_equals_the_plain_version(spark, d, clusters):
    good, bad = odd_rows(d)
    got = lloyd.clustered(vectors(spark, good + bad).repartition(3), dimensions=d, clusters=clusters).fillna({"vec_id": -1}).collect()
    assert sorted(tuple(r) for r in got) == plain_lloyd(good, d, clusters)


def test_lloyd_of_few_vectors(spark):
    assert lloyd.clustered(vectors(spark, []), dimensions=2).collect() == []
    assert lloyd.clustered(vectors(spark, odd_rows(2)[1]), dimensions=9).collect() == []
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert sorted(tuple(r) for r in lloyd.clustered(vectors(spark, rows), dimensions=2).collect()) == plain_lloyd(rows, 2)


def test_op12_equals_its_sql(spark, duck, small):
    same_rows(queries.QUERIES["op12_lloyd"](spark, small).toPandas(), duck.sql(queries.SQL["op12_lloyd"]).df())


# Token files.


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r\xa0　'sab1.é漢", max_size=40)), max_size=6))
def test_encoding_by_pieces_equals_the_library(library, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    code = token_files.encoder(JSON)
    assert code.by_pieces
    assert [np.frombuffer(x, code.type).tolist() for x in code.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_pieces_is_emptied(library, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    code = token_files.Encoder(JSON)
    for i in range(20):
        text = f"piece {i} of <|endoftext|> a longer text, number {i * i}\n\n  and more "
        assert np.frombuffer(code.encode([text])[0], code.type).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(code.known) < 30


ODD = [(5, "later words"), (2, "a b"), (2, "a b"), (2, "a b c"), (None, "null id"), (None, None), (3, None), (4, ""), (9, "wort " * 60_000), (6, "ß漢字 🙂 naïve\x00")]


def plain_files(library, rows):
    """ids of each row, in the order of the files but for ties."""
    return sorted(((-1 if k is None else k), [*library.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in rows)


def read_back(spark, folder):
    rows = token_files.read_token_files(spark, folder).fillna({"doc_id": -1}).collect()
    return sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)


def written(spark, rows, tmp_path, **options):
    docs = spark.createDataFrame([(k, t, *OWN[:4]) for k, t in rows], "doc_id long, text string, _h string, _row string, n_tokens string, start string")
    folder = f"file://{tmp_path}/files"
    return folder, token_files.write_token_files(docs.repartition(3), folder, JSON, **options)


def test_token_files_give_back_all_ids(spark, library, tmp_path):
    rows = ODD + [(1000 + i % 7, f"text {i % 50} of many, with number {i}") for i in range(600)] + [(77, "the same text in a third of all rows")] * 300
    folder, entries = written(spark, rows, tmp_path)
    got = read_back(spark, folder)
    assert sorted((k, ids) for _, k, ids in got) == plain_files(library, rows)
    assert [s for s, _, _ in got] == np.concatenate([[0], np.cumsum([len(ids) for _, _, ids in got])[:-1]]).tolist()
    keys = [k for _, k, _ in got]
    assert keys == sorted(keys) and sum(e.documents for e in entries) == len(rows)
    assert len(token_files._read_whole(folder, "dictionary")) > 0
    assert [x.tolist() for x in token_files.document_ids(folder, 9)] == [[*library.encode(ODD[8][1], add_special_tokens=False).ids, 0]]
    assert len(token_files.document_ids(folder, 77)) == 300 and token_files.document_ids(folder, 78) == []


def test_shards_are_rolled_over_and_lost_ones_ignored(spark, library, tmp_path):
    rows = [(i, f"document {i}") for i in range(1200)]
    folder, entries = written(spark, rows, tmp_path, shard_documents=100)
    (tmp_path / "files" / "shard-000000-0000-of-a-lost-task").write_bytes(b"half")
    got = read_back(spark, folder)
    assert len(entries) >= 5 and [(k, ids) for _, k, ids in got] == plain_files(library, rows)
    assert [s for s, _, _ in got] == np.concatenate([[0], np.cumsum([len(ids) for _, _, ids in got])[:-1]]).tolist()


def test_wrong_dictionaries_and_broken_shards_are_noticed(spark, tmp_path):
    folder, entries = written(spark, ODD, tmp_path)
    dictionary = token_files._read_whole(folder, "dictionary")
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Shard(folder, entries[0].name, dictionary + b"x")
    path = tmp_path / "files" / entries[0].name
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(ValueError, match="no whole shard"):
        token_files.Shard(folder, entries[0].name, dictionary)
    (tmp_path / "files" / "dictionary").write_bytes(b"other")
    with pytest.raises(ValueError, match="dictionary"):
        token_files.read_token_files(spark, folder)


def test_shared_dictionary_makes_short_documents_smaller(spark, tmp_path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"))
    with_one, without = f"{tmp_path}/with", f"{tmp_path}/without"
    a = token_files.write_token_files(docs, with_one, JSON)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(token_files, "trained_dictionary", lambda *_: b"")
        b = token_files.write_token_files(docs, without, JSON)
    assert sum(e.n_bytes for e in a) < 0.9 * sum(e.n_bytes for e in b)
    assert read_back(spark, with_one) == read_back(spark, without)
    assert token_files.trained_dictionary(docs, JSON) == token_files.trained_dictionary(docs.repartition(5), JSON)


def test_token_files_of_no_documents(spark, tmp_path):
    folder, entries = written(spark, [], tmp_path)
    assert entries == [] and read_back(spark, folder) == []
    token_files.delete_token_files(folder)
    assert not (tmp_path / "files").exists()


def test_op13_equals_the_library(spark, library, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for r in docs:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.QUERIES["op13_token_files"](spark, small)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


# Templates of licenses.


def test_templates_of_one_id_and_odd_templates(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta"))
    rows = [("X", one), ("X", two), ("X", two), ("short", "two words"), ("none", None), (None, one), ("empty", "")]
    templates = spark.createDataFrame(rows, "license_id string, text string")
    docs = spark.createDataFrame([(1, f"before {one} after"), (2, two), (3, "nothing of them at all here"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license_id, r.containment) for r in licenses.scan_licenses(docs, templates).collect())
    assert got == [(1, "X", 1.0), (2, "X", 1.0), (2, "X", 1.0)]
    assert licenses.scan_licenses(docs, templates.where("license_id <> 'X'")).count() == 0
