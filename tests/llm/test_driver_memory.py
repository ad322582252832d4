"""What reaches the driver or passes through a join stays small on large groups of near copies."""

import random
import uuid
from types import SimpleNamespace

from privspan.llm import _shared, quality, simhash
from privspan.llm._shared import connected_components


def test_rooted_edges_need_no_round(spark, monkeypatch):
    """A star's table is written once, where a round and another to see that nothing changes took three."""
    written = []
    monkeypatch.setattr(_shared, "uuid", SimpleNamespace(uuid4=lambda: written.append(0) or uuid.uuid4()))
    star = spark.createDataFrame([(1, x) for x in range(2, 40)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(star).collect()} == {(x, 1) for x in range(1, 40)}
    assert len(written) == 1


def test_near_copies_meet_few_firsts_once_linked(spark, monkeypatch):
    """Copies that their stars have joined aren't held against every first of their buckets."""
    g = random.Random(13)
    words = [f"w{i}" for i in range(5000)]
    base, rows = [g.choice(words) for _ in range(400)], []
    for i in range(120):
        copy = list(base)
        for _ in range(3):
            copy[g.randrange(400)] = g.choice(words)
        rows.append((i, " ".join(copy)))
    sizes, kept = {}, _shared.SharedTable.__init__

    def counted(self, df, name):
        kept(self, df, name)
        sizes[name] = self.df.count()

    monkeypatch.setattr(_shared.SharedTable, "__init__", counted)
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == len(rows)
    assert sizes["met"] > 20 * len(rows)
    assert sizes["mates"] <= 2 * len(rows) and sizes["near-firsts"] <= len(rows)


def test_unlinked_near_copies_are_one_family(spark, monkeypatch):
    """Near copies below the threshold share many buckets; they meet in one group, not once for each first of a bucket."""
    g = random.Random(17)
    words = [f"w{i}" for i in range(5000)]
    base, rows = [g.choice(words) for _ in range(400)], []
    for i in range(100):
        copy = list(base)
        for _ in range(9):
            copy[g.randrange(400)] = g.choice(words)
        rows.append((i, " ".join(copy)))
    sizes, kept = {}, _shared.SharedTable.__init__

    def counted(self, df, name):
        kept(self, df, name)
        sizes[name] = self.df.count()

    monkeypatch.setattr(_shared.SharedTable, "__init__", counted)
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i) for i, _ in rows}
    assert sizes["mates"] <= 3 * len(rows)


def test_counts_reach_the_driver_packed(spark, monkeypatch):
    """What the quality model's driver gets of a text is a small part of its counts, which arrive unchanged."""
    texts = [f"word {i} and another, " * (1 + i % 5) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    sent, whole = [], type(docs).toArrow

    def weighed(self):
        out = whole(self)
        sent.append(out.nbytes / out.num_rows)
        return out

    monkeypatch.setattr(type(docs), "toArrow", weighed)
    counts, _ = quality.sample(docs, labels)
    assert max(sent) < quality.FEATURES * 4 / 10
    want = {quality.count_features([t.encode()])[0].tobytes() for t in texts}
    assert len(counts) > 100 and {c.tobytes() for c in counts} <= want
