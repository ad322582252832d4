"""SimHash near-dedup with Golay-code fuzzy hashing.

The perfect binary Golay code maps every 23-bit word to one of 4096 codewords, at most three bits
away. Decoding a word and its 23 neighbours gives the indices of the codewords near it, one or
six. Two words that differ in two bits or fewer have a neighbour in common and so an index.

linked_fingerprints() is exact: of the three segments of a 64-bit fingerprint, two differing
bits leave at least one untouched; with that segment as it is, the indices of another make keys
under which linked fingerprints meet. similar_documents() is for a Jaccard similarity: a long
fingerprint of many segments, and keys of one codeword each with a few bits more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import connected_components, materialize, scratch

SEED = 42
#: Buckets up to this size compare all pairs; in larger ones, fingerprints meet at the words between them.
SMALL_BUCKET = 32
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator of the [23, 12] Golay code.
GENERATOR = 0b101011100011

#: Settings of similar_documents(): width of a sketch, and for up to CORPUS documents the keys of each
#: and the bits that a key has besides its codeword. A pair at a similarity of 0.8 shares a given key
#: with a probability of about 0.019, and 0.68 of that if one set contains the other, as its octave
#: differs in the other keys.
SKETCH, CORPUS, KEYS, EXTRA_BITS = 2048, 1 << 18, 266, 11
#: Longs of the fingerprint that bucket-mates compare, and the share of their bits that may differ
#: before shingles are compared; at a similarity of 0.8 it is 0.15.
SIGNATURE, LOOSE = 16, 0.2
#: One in so many keys tells families, whose members' signatures differ from their first's in up to this share of the bits.
FEW, KIN = 6, 0.3
#: Most rows of one side of a block of comparisons, and most bytes of its shingles (but for one text's).
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20


@dataclass(frozen=True)
class Keying:
    """Keys a document, bits of a key besides its codeword, and transforms whose bits hold all codewords."""

    keys: int
    extra: int
    transforms: int

    @staticmethod
    def of(documents: int) -> Keying:
        """Each doubling of the corpus halves the chance meetings of a key by one bit more, and needs a
        share of 1 / 0.85 more keys for the same links: that bit is equal with a probability of 0.85."""
        more = max(0, math.ceil(math.log2(max(documents, 1) / CORPUS)))
        keys, extra = math.ceil(KEYS * (1 / 0.85) ** more), EXTRA_BITS + more
        return Keying(keys, extra, math.ceil(keys * 23 / SKETCH))


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of 23-bit words, and for each syndrome the error of three bits at most."""
    part = np.zeros(23, np.int64)
    for i in range(23):
        x = 1 << i
        while x.bit_length() > 11:
            x ^= GENERATOR << (x.bit_length() - 12)
        part[i] = x
    syndrome = np.zeros(1, np.int64)
    for i in range(23):
        syndrome = np.concatenate([syndrome, syndrome ^ part[i]])
    error = np.zeros(2048, np.int64)
    bits = [1 << i for i in range(23)]
    for a in range(23):
        error[syndrome[bits[a]]] = bits[a]
        for b in range(a):
            error[syndrome[bits[a] | bits[b]]] = bits[a] | bits[b]
            for c in range(b):
                error[syndrome[bits[a] | bits[b] | bits[c]]] = bits[a] | bits[b] | bits[c]
    return syndrome.astype(np.int16), error


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index of the codeword that each 23-bit word decodes to."""
    syndrome, error = _golay()
    return (words ^ error[syndrome[words]]) >> 11


def golay_indices(words: np.ndarray) -> np.ndarray:
    """A row of 24 for each word: the sorted indices around it, repeats as -1."""
    around = np.concatenate([[0], 1 << np.arange(23)])
    found = np.sort(golay_index(words[:, None] ^ around), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def shingle_hashes(data: bytes, n: int) -> list[int]:
    """XXH64 of each run of n words, A-Z in lower case; fewer words are one run, no words none."""
    words, digest = data.lower().split(), xxhash.xxh64_intdigest
    if len(words) <= n:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(n)))]


def simhash(hashes: list[int]) -> int:
    """A bit is 1 if it is in over half of the hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64-bit fingerprint as a signed long): one row for each row, no shuffle.

    Whole texts count; null, empty and blank ones have fingerprint zero.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([simhash(shingle_hashes(t or b"", shingle)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64), pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp): about 16 keys for each fp; two that differ in at most two bits share one."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            a, b, c = ((fp >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in ((0, 23), (23, 23), (46, 18)))
            keys, rows = [], []
            for which, exact, other in ((0, a, b), (1, b, a), (2, c, a)):
                near = golay_indices(other)
                row, at = np.nonzero(near >= 0)
                keys.append(which << 40 | exact[row] << 12 | near[row, at])
                rows.append(row)
            key, row = np.concatenate(keys), np.concatenate(rows)
            for s in range(0, len(key), 100_000):
                part = fp[row[s : s + 100_000]].view(np.int64)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[s : s + 100_000]), "fp": pa.array(part)})

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def linked_fingerprints(fps: DataFrame, table=materialize) -> DataFrame:
    """(a, b): links among distinct fingerprints `fp` that differ in at most two bits, enough to reach all.

    Buckets of up to SMALL_BUCKET fingerprints compare their pairs. In a larger one each
    fingerprint goes to itself and its 64 neighbours: two differ in at most two bits if and only
    if they meet there, and those that meet are linked with the smallest. So a large group gives
    links in proportion to its size, and none is lost from what can be reached.
    """
    keys = table(_keys(fps), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = table(keys.join(sizes, "key"), "golay-met")
    few = met.where(F.col("n") <= SMALL_BUCKET)
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select(F.col("key").alias("k"), F.col("fp").alias("b")), (F.col("key") == F.col("k")) & (F.col("a") < F.col("b")) & (differ <= 2))
    many = met.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(x - (1 << 64) if x >= 1 << 63 else x) for x in (1 << i for i in range(64))])
    between = table(many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")), "between")
    least = between.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    stars = between.join(table(least, "least"), "mid").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.select("a", "b").unionByName(stars).distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of docs.

    Documents whose fingerprints differ in at most two bits are linked, equal ones too;
    component_id is the smallest doc_id reachable, itself included (null only if all are null).
    Empty texts have fingerprint zero and are linked like any other; an empty table gives no rows.
    """
    with scratch() as table:
        prints = table(fingerprints(docs, shingle), "fingerprints")
        classes = table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        roots = table(connected_components(linked_fingerprints(classes, table)), "fp-roots")
        named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        named = table(named, "named")
        parts = table(named.groupBy("root").agg(F.min("least").alias("component_id")), "parts")
        of_fp = table(named.join(parts, "root").select("fp", "component_id"), "fp-components")
        return materialize(prints.join(of_fp, "fp").select("doc_id", "fp", "component_id"), "fp-groups")


# Groups by similarity.


def _hadamard(x: np.ndarray) -> np.ndarray:
    rows, n, h = len(x), x.shape[1], 1
    while h < n:
        y = x.reshape(rows, n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(rows, n)
        h *= 2
    return x


def _long_fingerprints(sets: list[np.ndarray], transforms: int) -> np.ndarray:
    """Packed signs of random projections of the sketched shingle sets."""
    sketch = np.zeros((len(sets), SKETCH), np.float32)
    for k, s in enumerate(sets):
        if len(s):
            sign = 1.0 - 2.0 * (s >> np.uint64(63)).astype(np.float64)
            sketch[k] = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), sign, SKETCH)
    rng = np.random.default_rng(SEED)
    bits = []
    for _ in range(transforms):
        flip, mix = (rng.choice([-1.0, 1.0], SKETCH).astype(np.float32) for _ in range(2))
        bits.append(_hadamard(_hadamard(sketch * flip) * mix) > 0)
    return np.packbits(np.concatenate(bits, axis=1), axis=1)


def _similarity_keys(packed: np.ndarray, sizes: np.ndarray, by: Keying) -> np.ndarray:
    """The keys of each long fingerprint.

    A key is a codeword of its own bits, some bits as they are from anywhere, and the octave of the
    set's size, whose bounds differ from key to key.
    """
    bits = np.unpackbits(packed, axis=1)
    words = bits[:, : by.keys * 23].reshape(len(bits), by.keys, 23).astype(np.int64)
    index = golay_index(words @ (1 << np.arange(23)))
    others = np.random.default_rng(SEED).integers(0, bits.shape[1], (by.keys, by.extra))
    extra = bits[:, others].astype(np.int64) @ (1 << np.arange(by.extra))
    octave = np.floor(np.log2(np.maximum(sizes, 1))[:, None] + np.arange(by.keys) / by.keys).astype(np.int64)
    return ((np.arange(by.keys) << 6 | octave) << 12 | index) << by.extra | extra


def _shingle_set(data: bytes, n: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(data, n), np.uint64))


def _text_hash() -> F.Column:
    """With doc_id it names a row's text, also where an id repeats with another text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sketches(docs: DataFrame, shingle: int, by: Keying) -> DataFrame:
    """id, text_hash, same (a hash of the shingle set), n (its size), bits and their first longs for each row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [_shingle_set(t or b"", shingle) for t in part.column(2).cast(pa.binary()).to_pylist()]
                same = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                packed = _long_fingerprints(sets, by.transforms)
                sig = np.ascontiguousarray(packed[:, : 8 * SIGNATURE]).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column(0), "text_hash": part.column(1), "same": pa.array(same), "n": pa.array(list(map(len, sets)), pa.int64()),
                        "bits": pa.array([b.tobytes() for b in packed], pa.binary()), "sig": pa.array(list(sig), pa.list_(pa.int64())),
                    }
                )

    columns = docs.select(F.col("doc_id").cast("long").alias("id"), _text_hash().alias("text_hash"), "text")
    return columns.mapInArrow(run, "id long, text_hash long, same long, n long, bits binary, sig array<long>")


def _keyed(classes: DataFrame, by: Keying, *more: str) -> DataFrame:
    """key, same and more columns (long): by.keys rows for each class."""
    names = ["same", *more]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                keys = _similarity_keys(packed, part.column(0).to_numpy(zero_copy_only=False), by)
                of = {x: pa.array(np.repeat(part.column(x).to_numpy(zero_copy_only=False), by.keys)) for x in names}
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), **of})

    return classes.select("n", "bits", *names).mapInArrow(run, ", ".join(f"{x} long" for x in ["key", *names]))


def _shingles(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """same, shingles (packed): the sets of the classes in wanted (same, id, text_hash)."""

    def cut(batches):
        for batch in batches:
            sets = [_shingle_set(t or b"", shingle).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"same": batch.column(0), "shingles": pa.array(sets, pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), _text_hash().alias("text_hash"), "text")
    found = texts.join(wanted.select("same", "id", "text_hash"), ["id", "text_hash"]).select("same", "text")
    return found.mapInArrow(cut, "same long, shingles binary").dropDuplicates(["same"])


def _blocks(members: DataFrame, bytes_of: str, table, sets: DataFrame | None = None) -> DataFrame:
    """members (grp, same, main, ...) as rows of blocks (grp, i, j, own, ...), in which all pairs of a
    group can be compared but those within its main part. sets adds the shingles of each.

    A group's main and other members are each dealt out by hash to as many slots as their rows and
    bytes need; a block is two slots, or one with itself. Groups of up to BLOCK_ROWS others take
    rows in proportion to their size, however large their main part is.
    """
    slots = lambda on: F.greatest(F.ceil(F.count_if(on) / BLOCK_ROWS), F.ceil(F.sum(F.when(on, F.col(bytes_of)).otherwise(0)) / BLOCK_BYTES)).cast("int")
    sizes = table(members.groupBy("grp").agg(slots(F.col("main")).alias("mains"), slots(~F.col("main")).alias("others")), "block-sizes")
    rows = members.join(sizes, "grp")
    dealt = lambda n: F.pmod(F.xxhash64("same", "grp"), F.greatest(n, F.lit(1))).cast("int")
    rows = rows.withColumn("own", F.when(F.col("main"), F.col("others") + dealt(F.col("mains"))).otherwise(dealt(F.col("others"))))
    if sets is not None:
        rows = rows.join(sets, "same")
    with_all = F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1)
    with_others = F.sequence(F.lit(0), F.col("others") - 1)
    rows = rows.withColumn("other", F.explode(F.when(F.col("main"), with_others).otherwise(with_all)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")


def _linked(blocks: DataFrame, similarity: float | None) -> DataFrame:
    """(a, b): links among the members of each block, less than it has rows, so no pair ever is a row.

    Pairs of different roots are sifted by their signatures. With a similarity, shingle sets decide
    them, and pairs whose roots links have joined are left out. Without one, members are
    linked so that all those with a near one of another root can be reached from it.
    """

    def compare(rows: list[tuple]) -> tuple[list[int], list[int]]:
        i, j = rows[0][1:3]
        own, same, root = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        signs = np.unpackbits(np.array([r[6] for r in rows], np.int64).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        # The product of two signatures is their bits less twice those that differ.
        near = signs[left] @ signs[right].T >= 64 * SIGNATURE - 2 * int(LOOSE * 64 * SIGNATURE)
        near &= root[left][:, None] != root[right][None]
        if i == j:
            near = np.triu(near)
        if similarity is None:
            root = np.arange(len(rows))
        sets = [np.frombuffer(r[7], np.uint64) for r in rows] if similarity is not None else []
        a, b = [], []
        for x, row in zip(left.tolist(), near):
            ys = right[row]
            ys = ys[root[ys] != root[x]]
            if not len(ys):
                continue
            if sets:
                sizes = np.array([len(sets[y]) for y in ys.tolist()])
                every = np.concatenate([sets[y] for y in ys.tolist()])
                at = np.minimum(np.searchsorted(sets[x], every), len(sets[x]) - 1)
                both = np.add.reduceat(sets[x][at] == every, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
                ys = ys[both >= similarity * (len(sets[x]) + sizes - both)]
            for y in ys.tolist():
                if root[y] != root[x]:
                    root[root == root[y]] = root[x]
                    a.append(int(same[x]))
                    b.append(int(same[y]))
        return a, b

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            a, b = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    for out, found in zip((a, b), compare(held)):
                        out += found
                    held = []
                held.append(row)
            yield _pairs(a, b)
        if held:
            yield _pairs(*compare(held))

    def _pairs(a, b):
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    columns = ["grp", "i", "j", "own", "same", "root", "sig", *(["shingles"] if similarity is not None else [])]
    return blocks.select(columns).mapInArrow(run, "a long, b long")


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    """df with root, its class itself where no link was found."""
    found = df.drop("root").join(roots.withColumnRenamed("node", "same"), "same", "left")
    return found.withColumn("root", F.coalesce("root", "same"))


def _open_members(met: DataFrame, table) -> DataFrame:
    """Rows of met (grp, same, root, ...) in groups of several roots; main marks a group's most frequent root."""
    roots = met.groupBy("grp", "root").agg(F.count("*").alias("n"))
    most = roots.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("several")).where("several > 1")
    return met.join(table(most.select("grp", "most"), "most"), "grp").withColumn("main", F.col("root") == F.col("most")).drop("most")


def _class_links(docs: DataFrame, classes: DataFrame, by: Keying, shingle: int, similarity: float, table) -> DataFrame:
    """(a, b): links among classes of equal shingle sets, enough to reach all that are found.

    First, buckets of a few keys have a first member each, by one hash for all buckets. A class is
    compared with the first that it meets most often, if that is near, so that the copies of a large
    group become one root; if it is only somewhat near, both are of one family. All classes of a family
    make a group. Then, of the buckets of all keys, those within one family are done with. In the others,
    the classes of other families join the group of the largest one. If a group has several roots, its
    members name those whose signatures are near, and these are compared by their sets, in
    blocks. Two that share a bucket so have one root already or are compared, and a class is in a
    group once however many buckets it shares with it.
    """
    filled = classes.where("n > 0").select("same", "n", "bits")
    some = _keyed(filled, Keying(math.ceil(by.keys / FEW), by.extra, by.transforms))
    # A class is named by a hash, so the least of a bucket is chosen by one hash for all buckets.
    shared = some.groupBy("key").agg(F.count("*").alias("size"), F.min("same").alias("first")).where("size > 1")
    met = table(some.join(shared.select("key", "first"), "key").select("first", "same"), "met")
    classes = classes.select("same", "id", "text_hash", "sig", (F.col("n") * 8).alias("bytes"))

    def decided(members: DataFrame, name: str) -> DataFrame:
        """Links among members (grp, same, root, main) by their shingle sets."""
        with scratch() as own:
            members = own(members.join(classes, "same"), f"{name}-members")
            wanted = own(members.select("same", "id", "text_hash").distinct(), f"{name}-wanted")
            sets = own(_shingles(docs, wanted, shingle), f"{name}-shingles")
            return table(_linked(_blocks(members, "bytes", own, sets), similarity), f"{name}-links")

    often = met.where("same <> first").groupBy("first", "same").agg(F.count("*").alias("n"))
    often = often.groupBy("same").agg(F.max_by("first", F.struct("n", F.bitwise_not("first"))).alias("first"))
    sigs = classes.select("same", "sig")
    often = often.join(sigs, "same").join(sigs.select(F.col("same").alias("first"), F.col("sig").alias("first_sig")), "first")
    differ = sum((F.bit_count(F.element_at("sig", i).bitwiseXOR(F.element_at("first_sig", i))) for i in range(1, SIGNATURE + 1)), F.lit(0))
    often = table(often.select("first", "same", differ.alias("differ")).where(F.col("differ") <= int(KIN * 64 * SIGNATURE)), "near-firsts")
    stars = often.where(F.col("differ") <= int(LOOSE * 64 * SIGNATURE)).select(F.col("first").alias("grp"), "same")
    hubs = stars.select("grp").distinct().select("grp", F.col("grp").alias("same"), F.lit(False).alias("main"))
    links = decided(hubs.unionByName(stars.withColumn("main", F.lit(True))).withColumn("root", F.col("same")), "star")
    roots = table(connected_components(links), "star-roots")

    # A family is numbered so that the largest has the least number; two of one number make one group, which is as good.
    kin = table(connected_components(often.select(F.col("first").alias("a"), F.col("same").alias("b"))), "kin")
    number = -(F.shiftleft(F.count("*"), 32) + F.pmod("root", F.lit(1 << 32)))
    numbers = table(kin.groupBy("root").agg(number.alias("family")), "numbers")
    families = table(kin.join(numbers, "root").select(F.col("node").alias("same"), "family"), "families")
    alone = F.shiftrightunsigned("same", 1)
    keys = _keyed(filled.join(families, "same", "left").withColumn("family", F.coalesce("family", alone)), by, "family")
    several = keys.groupBy("key").agg(F.min("family").alias("grp"), F.max("family").alias("last")).where("grp < last").select("key", "grp")
    joined = table(keys.join(several, "key").where("family <> grp").select("grp", "same").distinct(), "joined")
    single = filled.select(alone.alias("grp"), "same").join(table(joined.where("grp >= 0").select("grp").distinct(), "singles"), "grp", "left_semi")
    mates = joined.unionByName(single).unionByName(families.select(F.col("family").alias("grp"), "same"))
    mates = table(mates.distinct(), "mates")
    several = table(_rooted(mates, roots), "mates-roots")
    members = _open_members(several, table).join(classes.select("same", "sig"), "same").withColumn("bytes", F.lit(8 * SIGNATURE))
    near_ones = table(_linked(_blocks(table(members, "open"), "bytes", table), None), "near")
    clusters = table(connected_components(near_ones), "clusters").select(F.col("root").alias("grp"), F.col("node").alias("same"))
    clusters = table(_rooted(clusters, roots), "cluster-roots")
    return links.unionByName(decided(_open_members(clusters, table), "cluster"))


def _grouped(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """id, text_hash, keep_id, keep_hash of each row of docs: the last two name the first row of its group."""
    docs = docs.where("doc_id is not null")
    by = Keying.of(docs.count())
    own = F.struct("id", "text_hash")
    with scratch() as table:
        with scratch() as wide:
            sketches = wide(_sketches(docs, shingle, by), "sketches")
            rows = table(sketches.select("id", "text_hash", "same"), "sets")
            classes = sketches.groupBy("same").agg(F.min(own).alias("own"), F.min_by(F.struct("n", "bits", "sig"), own).alias("x"))
            classes = table(classes.select("same", "own.*", "x.*"), "set-classes")
        roots = table(connected_components(_class_links(docs, classes, by, shingle, similarity, table)), "set-roots")
        named = table(_rooted(classes.select("same", "id", "text_hash"), roots), "named")
        parts = table(named.groupBy("root").agg(F.min(own).alias("keep")).select("root", F.col("keep.id").alias("keep_id"), F.col("keep.text_hash").alias("keep_hash")), "parts")
        of_set = table(named.join(parts, "root").select("same", "keep_id", "keep_hash"), "set-groups")
        return materialize(rows.join(of_set, "same").drop("same"), "groups")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: groups of documents whose shingle sets have at least the Jaccard similarity.

    component_id is the group's smallest doc_id. Equal sets are one class from the start. Links at the
    threshold are found with a probability of about 0.98 if one set contains the other and 0.99
    at equal sizes, closer ones with more; none below it is made. Texts without words (null,
    empty, blank) form one group; rows with a null doc_id are not grouped; rows that repeat come
    as often; texts of any length are read whole; an empty table gives no rows.
    """
    return _grouped(docs, shingle, similarity).select(F.col("id").alias("doc_id"), F.col("keep_id").alias("component_id"))


def first_of_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar_documents(); rows with a null doc_id stay. Columns as they are.

    The row with the smallest doc_id stays. Where an id repeats with another text, each text goes
    with its own group; where it repeats within the group, the text with the smaller hash stays,
    and of rows with one id and text the first by all its columns.
    """
    groups = _grouped(docs, shingle, similarity)
    kept = (F.col("id") == F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    twice = materialize(groups.where(kept).groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    gone = groups.where(~kept).select("id", "text_hash").distinct().unionByName(twice)
    # The row travels as one column, so that no column of docs can clash with these.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), _text_hash().alias("text_hash"))
    single = rows.join(materialize(gone, "gone"), ["id", "text_hash"], "left_anti").select("row.*")
    one = Window.partitionBy("id", "text_hash").orderBy(F.to_json("row"))
    again = rows.join(twice, ["id", "text_hash"]).withColumn("n", F.row_number().over(one)).where("n = 1")
    return single.unionByName(again.select("row.*"))


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = near_duplicate_groups(docs)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
