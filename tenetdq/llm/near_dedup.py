"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of word shingles; two are linked when the Jaccard similarity reaches ``threshold``.

1. One pass gives every document its word-sequence digest, set size, signature and band values.
   Documents with equal word sequences form a class and go on as one representative.
2. *Star candidates.* In each band bucket the smallest member is compared with every other member: one
   candidate per member, not per pair.
3. *Verification.* Candidates whose set sizes rule the threshold out go. Signatures are then compared
   batch by batch; with a uniform prior, the chance that the similarity reaches the threshold after m
   of n agreements is that of at most m successes in n + 1 trials, and a pair goes as soon as that is
   below ``miss``. Survivors are verified on the full sets, so no link is ever a guess.
4. *Rest.* Within a bucket, pairs inside one component need no test. Members outside the
   bucket's largest component are compared with all others, in blocks of at most ``BLOCK`` rows a side,
   by signatures and then on full sets inside Arrow tasks, which emit only links that join two
   components. So every pair that shares a bucket is either tested
   or already connected, no bucket is capped, and a big group of copies makes a linear number of rows.

With 25 bands of 5 hashes a pair at similarity 0.85 shares no bucket with a chance of 4e-7.

Texts are never copied: a row is named by its place in the table (file and row), and only the texts of pairs that survive the
signatures are read again, joined by place (broadcast where the places are measured few, shuffled otherwise).

Defined cases: a document without words has the empty set, links with nothing and is its own
component; null identifiers count as largest; repeated rows are one class; texts of any length are read whole; other columns are carried or
ignored, whatever their names; an empty table gives no rows. At other thresholds the bands miss more: 5e-5 of the pairs at 0.8.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenetdq.functions.lookup import attach
from tenetdq.llm.common import bounded_batches, own_cache, placed, settled
from tenetdq.llm.components import components

BANDS, BAND_ROWS = 25, 5
HASHES = BANDS * BAND_ROWS
BATCH = 25                     # signature entries compared at a time
MISS = 1e-6                    # chance at which a candidate is given up
BLOCK = 512
WORD_CACHE = 200_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                   0x85EBCA77C2B2AE63], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return x


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes; fewer words than ``size`` are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(own_cache("near_dedup", _WordHashes).__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    x = h[:n] * _STEPS[0]
    for k in range(1, size):
        x = _mixed(x + h[k:k + n] * _STEPS[k % len(_STEPS)])
    return np.unique(_mixed(x))


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        block = shingles[at:at + 512]
        np.minimum(best, (_A[:, None] * block + _B[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


@functools.cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For each batch, the fewest agreements so far that keep a pair."""
    def chance(m: int, n: int) -> float:
        return sum(comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return tuple(next(m for m in range(n + 1) if chance(m, n) >= miss) for n in range(BATCH, HASHES + 1, BATCH))


DESCRIBED = pa.schema([("doc_id", pa.int64()), ("file", pa.int64()), ("at", pa.int64()), ("ref", pa.int64()), ("key", pa.string()),
                       ("n_shingles", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _described(size: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            keys, sizes, sigs, bands = [], [], [], []
            for text in b.column("text").to_pylist():
                words = word_list(text)
                shingles = shingle_set(words, size)
                sizes.append(len(shingles))
                if not words:
                    keys.append(None)
                    sigs.append(None)
                    bands.append([])
                    continue
                keys.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                sig = signature(shingles)
                sigs.append(sig.tobytes())
                bands.append([xxhash.xxh3_64_intdigest(sig[k * BAND_ROWS:(k + 1) * BAND_ROWS].tobytes(), seed=k)
                              - (1 << 63) for k in range(BANDS)])
            refs = pa.array(range(base + seen, base + seen + len(keys)), pa.int64())
            seen += len(keys)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("file"), b.column("at"), refs, pa.array(keys, pa.string()),
                 pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                schema=DESCRIBED)

    return describe


def describe(rows: DataFrame, shingle: int) -> DataFrame:
    """The described documents (step 1) of rows with places, settled."""
    bounded_batches(rows.sparkSession)
    src = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "file", "at")
    return settled(src.mapInArrow(_described(shingle), "doc_id long, file long, at long, ref long, key string, "
                                  "n_shingles long, sig binary, bands array<long>"), "near-described")


def _texts(rows: DataFrame, described: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, text) of the rows named by ``refs``, settled."""
    wanted = settled(described.select("ref", "file", "at").join(refs.distinct(), "ref"), "near-wanted")
    read = rows.select("file", "at", F.col("row.text").cast("string").alias("text"))
    return settled(attach(read, wanted, ["file", "at"], how="inner").select("ref", "text"), "near-texts")


def _survivors(threshold: float):
    """Arrow function: keep the pairs that size and signatures don't rule out."""
    least = least_matches(threshold)
    cut = round(threshold * 100)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            alive = np.flatnonzero(100 * np.minimum(na, nb) >= cut * np.maximum(na, nb))
            sa = _signatures(b.column("sig_a").to_pylist())
            sb = _signatures(b.column("sig_b").to_pylist())
            hits = np.zeros(len(na), np.int64)
            for k, at in enumerate(range(0, HASHES, BATCH)):
                hits[alive] += (sa[alive, at:at + BATCH] == sb[alive, at:at + BATCH]).sum(axis=1)
                alive = alive[hits[alive] >= least[k]]
            yield b.select(["a", "b"]).take(pa.array(alive))

    return keep


def _signatures(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, HASHES)


def _verified(shingle: int, threshold: float):
    """Arrow function: keep the pairs whose full sets reach the threshold."""
    cut = round(threshold * 100)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = functools.lru_cache(256)(lambda text: shingle_set(word_list(text), shingle))
        for b in batches:
            yes = []
            for ta, tb in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
                sa, sb = cached(ta), cached(tb)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                yes.append(100 * both >= cut * (len(sa) + len(sb) - both))
            yield b.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return keep


def _block_survivors(threshold: float):
    """Group function: the rows of a block of outsiders and a block of members that have a partner
    which sizes and signatures don't rule out."""
    least = least_matches(threshold)
    cut = round(threshold * 100)

    def compare(group: pa.Table) -> pa.Table:
        keys, labels = group["ref"].to_numpy(), group["label"].to_numpy()
        n, out = group["n_shingles"].to_numpy(), group["outside"].to_numpy(zero_copy_only=False)
        sig = _signatures(group["sig"].to_pylist())
        a, b = np.flatnonzero(out), np.flatnonzero(~out)
        partnered = np.zeros(len(keys), bool)
        for i in a.tolist():
            alive = b[(labels[b] != labels[i]) & (keys[b] != keys[i])]
            alive = alive[100 * np.minimum(n[alive], n[i]) >= cut * np.maximum(n[alive], n[i])]
            hits = np.zeros(len(keys), np.int64)
            for k, at in enumerate(range(0, HASHES, BATCH)):
                hits[alive] += (sig[alive, at:at + BATCH] == sig[i, at:at + BATCH]).sum(axis=1)
                alive = alive[hits[alive] >= least[k]]
            partnered[alive] = True
            partnered[i] |= len(alive) > 0
        return group.select(["bucket", "block", "out_block", "ref", "label", "outside"]).filter(pa.array(partnered))

    return compare


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence blocks."""
    def indexed(sets):
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)

    (la, va), (lb, vb) = indexed(left), indexed(right)
    both = np.intersect1d(va, vb)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), 4096):
        part = both[at:at + 4096]
        tiles = []
        for rows, values, n in ((la, va, len(left)), (lb, vb, len(right))):
            place = np.searchsorted(part, values)
            place[place == len(part)] = 0
            hit = part[place] == values
            tile = np.zeros((n, len(part)), np.float32)
            tile[rows[hit], place[hit]] = 1
            tiles.append(tile)
        out += tiles[0] @ tiles[1].T
    return out.astype(np.int64)


def _block_links(shingle: int, threshold: float):
    """Group function: links on full sets between the two blocks that join components not joined yet."""
    cut = round(threshold * 100)

    def compare(group: pa.Table) -> pa.Table:
        keys, labels = group["ref"].to_pylist(), group["label"].to_pylist()
        sets = {}
        for key, text in zip(keys, group["text"].to_pylist(), strict=True):
            if key not in sets:
                sets[key] = shingle_set(word_list(text), shingle)
        out = group["outside"].to_pylist()
        a = [i for i, o in enumerate(out) if o]
        b = [i for i, o in enumerate(out) if not o]
        found: list[tuple[int, int]] = []
        if a and b:
            both = shared_counts([sets[keys[i]] for i in a], [sets[keys[i]] for i in b])
            na = np.array([len(sets[keys[i]]) for i in a])[:, None]
            nb = np.array([len(sets[keys[i]]) for i in b])[None, :]
            above: dict[int, int] = {}

            def root(x: int) -> int:
                while above.get(x, x) != x:
                    above[x] = above.get(above[x], above[x])
                    x = above[x]
                return x

            for i, j in np.argwhere(100 * both >= cut * (na + nb - both)).tolist():
                i, j = a[i], b[j]
                ri, rj = root(labels[i]), root(labels[j])
                if ri != rj:
                    above[max(ri, rj)] = min(ri, rj)
                    found.append((keys[i], keys[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([y for _, y in found], pa.int64())})

    return compare


def _links(pairs: DataFrame, reps: DataFrame, fetch, shingle: int, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) that are true links."""
    side = reps.select("ref", "n_shingles", "sig")
    left = side.select(F.col("ref").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sig_a"))
    right = side.select(F.col("ref").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sig_b"))
    pairs = settled(pairs.join(left, "a").join(right, "b")
                    .mapInArrow(_survivors(threshold), "a long, b long"), "near-survivors")
    texts = fetch(pairs.select(F.col("a").alias("ref")).unionByName(pairs.select(F.col("b").alias("ref"))))
    left = texts.select(F.col("ref").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("ref").alias("b"), F.col("text").alias("text_b"))
    return settled(pairs.join(left, "a").join(right, "b")
                   .mapInArrow(_verified(shingle, threshold), "a long, b long"), "near-links")


def class_components(rows: DataFrame, described: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Per class of equal word sequences: key, component_id and component_ref of the row that stays.

    A class is represented by its first row and named by that row's ref."""
    def fetch(refs: DataFrame) -> DataFrame:
        return _texts(rows, described, refs)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ref")).alias("first")
    reps = settled(
        described.where("key is not null").groupBy("key").agg(
            first, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
            F.first("bands").alias("bands")).select("key", "first", F.col("first.ref").alias("ref"),
                                                    "n_shingles", "sig", "bands"), "near-classes")
    members = reps.select(F.explode("bands").alias("bucket"), "ref")
    # settled, so that the join below has two plain sides and a hot bucket's rows can be split
    buckets = settled(members.groupBy("bucket").agg(F.min("ref").alias("center"), F.count("*").alias("m")).where("m > 1"),
                      "near-centers")
    shared = settled(members.join(buckets, "bucket"), "near-buckets")
    stars = shared.where("ref <> center").select(F.col("center").alias("a"), F.col("ref").alias("b")).distinct()
    links = _links(stars, reps, fetch, shingle, threshold)
    labels = components(links)

    # members outside the largest component of a bucket with three or more, against all others
    open_rows = shared.where("m > 2").join(labels.withColumnRenamed("node", "ref"), "ref", "left").select(
        "bucket", "ref", F.coalesce("label", "ref").alias("label"))
    sizes = open_rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "label")).getField("label").alias("main"), F.sum("n").alias("members"),
        F.count("*").alias("labels"), F.max("n").alias("most")).where("labels > 1")
    largest = settled(largest, "near-largest")
    mixed = settled(open_rows.join(largest, "bucket"), "near-mixed")
    if not mixed.isEmpty():
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        out_blocks = F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int")
        place = F.pmod(F.xxhash64("ref"), F.lit(1 << 30))
        inner = mixed.select("bucket", "ref", "label", F.lit(False).alias("outside"),
                             (place % blocks).cast("int").alias("block"),
                             F.explode(F.sequence(F.lit(0), out_blocks - 1)).alias("out_block"))
        outer = mixed.where("label <> main").select(
            "bucket", "ref", "label", F.lit(True).alias("outside"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), (place % out_blocks).cast("int").alias("out_block"))
        tiles = inner.unionByName(outer).join(reps.select("ref", "n_shingles", "sig"), "ref")
        tile = ["bucket", "block", "out_block"]
        partnered = settled(tiles.groupBy(*tile).applyInArrow(
            _block_survivors(threshold),
            "bucket long, block int, out_block int, ref long, label long, outside boolean"), "near-partnered")
        if not partnered.isEmpty():
            more = partnered.join(fetch(partnered.select("ref")), "ref").groupBy(*tile).applyInArrow(
                _block_links(shingle, threshold), "a long, b long")
            labels = components(links.unionByName(more))

    named = reps.select("key", "ref", "first").join(labels.withColumnRenamed("node", "ref"), "ref", "left").select(
        "key", "first", F.coalesce("label", "ref").alias("label"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    return named.join(heads, "label").select(
        "key", F.col("head.doc_id").alias("component_id"), F.col("head.ref").alias("component_ref"))


def near_dedup(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id is the component's smallest)."""
    rows = placed(docs)
    described = describe(rows, shingle)
    classes = class_components(rows, described, shingle, threshold)
    joined = described.select("doc_id", "n_shingles", "key").join(classes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and every row without words."""
    rows = placed(docs)
    described = describe(rows, shingle)
    heads = class_components(rows, described, shingle, threshold).select(F.col("component_ref").alias("ref")).distinct()
    # the places that go are the fewer ones in most tables
    gone = settled(described.where("key is not null").join(heads, "ref", "left_anti").select("file", "at"), "near-gone")
    return attach(rows, gone, ["file", "at"], how="left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
