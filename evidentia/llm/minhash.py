"""Near-duplicate detection by min-max hashing.

Every permutation of the shingle hashes gives two values of the signature, its minimum and its maximum, so ``PERMS``
evaluations give ``2 * PERMS`` values; bands of ``ROWS`` values are the bucket keys. At a similarity of 0.8 a pair
misses every band with a probability of (1 - 0.8^4)^26, about one in a million.

Documents with one set of shingles are one class, known by a digest of the whole set, before any bucket is built; its
copies never meet each other. In each bucket every class is compared with the bucket's hub, its smallest id, so a
bucket of n classes makes n - 1 pairs. Similarity is confirmed on the full sets: pairs are dealt by hub, a hub with
many partners by salts of ``SALT`` of them, and each task reads one hub's set and streams its partners' sets past it.
Then connected components are found. Classes that share a bucket and still lie in different components are compared
too, so a link that a hub doesn't show isn't lost: in tiles of bounded size, by matrix products of their sets, where a
pair is a number and never a row. No link, component or fingerprint reaches the driver.

Null or empty texts have no shingles: alone and kept. Texts shorter than a shingle are one shingle of their own. Rows are told
apart by a number of their own, as ids may be null or repeat: each is judged on its own text, and a component is named by
the smallest id in it, null only if it holds no other. An empty table gives no rows. Tables that a step leaves behind are
deleted when their last reader is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, named, numbered, table, unused

SHINGLE, PERCENT = 5, 80
PERMS, ROWS = 52, 4
SALT = 32
TILE, VOCABULARY = 384, 4096
SEED = 20240229
CACHE_WORDS = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``width``-word shingles."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: lower() takes A-Z alone, split() takes \x20 and \x09-\x0D
    if not ws:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    width = min(width, len(a))
    h = a[: len(a) - width + 1].copy()
    for j in range(1, width):
        h *= MIX
        h += a[j : len(a) - width + 1 + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def permutations(count: int = PERMS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


def min_max(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray, block: int = 2048) -> np.ndarray:
    """Minimum and maximum of each permutation, side by side."""
    low = high = None
    for at in range(0, len(hashes), block):
        v = hashes[at : at + block, None] * mul + add
        a, b = v.min(0), v.max(0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.stack([low, high], 1).ravel()


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (mul, add) = WordHashes(), permutations()
        bands = 2 * PERMS // ROWS
        for batch in batches:
            ids, docs, texts = batch.columns
            n, digests, keys = [], [], []
            for t in texts:
                h = shingles(t.as_py(), width, known)
                n.append(len(h))
                if not len(h):
                    digests.append(None)
                    keys.append(None)
                    continue
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sig = min_max(h, mul, add).reshape(bands, ROWS)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = (key ^ sig[:, r]) * MIX
                    key ^= key >> np.uint64(32)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, docs, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["did", "doc", "n_shingles", "digest", "keys"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingles(text.as_py(), width, known).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["did", "set"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = hub = None
        for batch in batches:
            left, right, sets = [], [], batch.column("set")
            for k, (a, b) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("did").to_pylist())):
                h = np.asarray(sets[k].values)
                if a == b:  # the hub's own row comes first of its group
                    at, hub = a, h
                    continue
                if a != at:
                    raise ValueError("a group without its hub")
                if not len(h) or 100 * min(len(h), len(hub)) < percent * max(len(h), len(hub)):
                    continue
                both = len(np.intersect1d(hub, h, assume_unique=True))
                if 100 * both >= percent * (len(h) + len(hub) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among ``pairs`` of ids, by their full ``sets`` (did, set)."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    there = pairs.join(salts, "a").select(F.col("b").alias("did"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    hubs = salts.select(F.col("a").alias("did"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    roles = sets.join(there.union(hubs).hint("merge"), "did").repartition("hub", "salt").withColumn("first", F.col("hub") != F.col("did"))
    return roles.sortWithinPartitions("hub", "salt", "first").select("hub", "did", "set").mapInArrow(_confirm(percent), "a long, b long").distinct()


def _tiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One tile: every left row against every right row of another component, by products of 0/1 matrices."""
        batch = pa.Table.from_batches(list(batches)).combine_chunks().to_batches()
        found: list[tuple[int, int]] = []
        if batch:
            b = batch[0]
            ids, comp, left = (np.asarray(b.column(c)) for c in ("did", "component", "lefts"))
            n = np.asarray(pc.list_value_length(b.column("set")), np.int64)
            values, at = np.asarray(b.column("set").flatten()), np.repeat(np.arange(len(ids)), n)
            _, word, times = np.unique(values, return_inverse=True, return_counts=True)
            keep = times[word] > 1  # shingles of one row alone are no overlap
            word, at = np.unique(word[keep], return_inverse=True)[1], at[keep]
            rows, cols = np.flatnonzero(left), np.arange(len(ids))
            both = np.zeros((len(rows), len(cols)), np.float32)
            order = np.argsort(word, kind="stable")
            word, at = word[order], at[order]
            for low in range(0, int(word[-1]) + 1 if len(word) else 0, VOCABULARY):
                a, z = np.searchsorted(word, (low, low + VOCABULARY))
                x = np.zeros((len(ids), VOCABULARY), np.float32)
                x[at[a:z], word[a:z] - low] = 1
                both += x[rows] @ x.T
            union = n[rows][:, None] + n[None, :] - both
            link = (100 * both >= percent * union) & (comp[rows][:, None] != comp[None, :]) & (both > 0)
            found = [(int(ids[rows[i]]), int(ids[j])) for i, j in zip(*np.nonzero(link))]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def unseen_links(shared: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one bucket that lie in different components of ``found``.

    Classes that share buckets of one hub are a group. Those that aren't in the hub's component, the rest, are compared with
    the whole group in tiles of about ``TILE`` by ``TILE`` sets: rows are copied to the tiles of their line, pairs are never rows.
    """
    # A hub may have any number of members, so what is dealt by hub is dealt by salts of it too.
    spread = lambda: F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    members = shared.select("hub", "did").distinct().join(found.withColumnRenamed("node", "did"), "did", "left").select("hub", "did", F.coalesce("component", "did").alias("component"), F.pmod(F.xxhash64("did"), F.lit(SALT)).cast("int").alias("salt"))
    own = members.where("hub = did").select("hub", F.col("component").alias("main"), spread())
    members = cut(members.join(own, ["hub", "salt"]).withColumn("left", F.col("component") != F.col("main")).drop("main"))
    sizes = members.groupBy("hub").agg(F.ceil(F.count_if("left") / TILE).cast("int").alias("nl"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("nr")).where("nl > 0")
    dealt = members.join(sizes.select("*", spread()), ["hub", "salt"])
    line = lambda n: F.pmod(F.xxhash64("did"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = dealt.where("left").select("hub", "did", "component", line("nl").alias("i"), every("nr").alias("j"), F.lit(True).alias("lefts"))
    rights = dealt.select("hub", "did", "component", every("nl").alias("i"), line("nr").alias("j"), F.lit(False).alias("lefts"))
    tiles = cut(lefts.union(rights).repartition("did").groupBy("hub", "i", "j", "did").agg(F.first("component").alias("component"), F.max("lefts").alias("lefts")))
    rows = sets.join(tiles.hint("merge"), "did")
    out = cut(rows.groupBy("hub", "i", "j").applyInArrow(lambda t: pa.Table.from_batches(_tiles(percent)(iter(t.to_batches()))), "a long, b long").distinct())
    forget(members, tiles)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): smallest id reachable, by neighbours' labels and pointer jumps."""
    both = cut(edges.union(edges.select("b", "a")).toDF("node", "next").distinct())
    labels = cut(both.groupBy("node").agg(F.min("next").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), F.col("component").alias("c")), "next").groupBy("node").agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        jumped = cut(step.join(labels.select(F.col("node").alias("component"), F.col("component").alias("c")), "component").select("node", "was", F.least("component", "c").alias("component")))
        forget(labels)
        labels = jumped
        if jumped.where("was != component").isEmpty():
            forget(both)
            return labels.select("node", "component")


def grouped(source: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(did, doc, n_shingles, component, least) for each row of ``source`` (did, doc, text), where ``did`` is a number of the row's
    own: the smallest ``did`` of its component and the smallest ``doc`` in it."""
    prints = cut(source.mapInArrow(_prints(width), "did long, doc long, n_shingles long, digest binary, keys array<long>"))
    classes = cut(prints.where("digest IS NOT NULL").groupBy("digest").agg(F.min("did").alias("did"), F.min("doc").alias("least"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n")))
    rows = classes.select("did", "n", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min(F.struct("did", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "hub")
    shared = cut(rows.join(buckets, "key").select("key", "did", "n", F.col("hub.did").alias("hub"), F.col("hub.n").alias("hub_n")))
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    star = cut(shared.where((F.col("hub") != F.col("did")) & alike(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("did").alias("b")).distinct())
    # Sets of what shares a bucket are made once; both joins below shuffle, as they would at any size.
    sets = cut(source.join(shared.select("did").distinct().hint("merge"), "did").select("did", "text").mapInArrow(_sets(width), "did long, set array<long>"))
    links = cut(confirm(star, sets, percent))
    found = components(links)
    # What a hub doesn't show.
    more = unseen_links(shared, found, sets, percent)
    if not more.isEmpty():
        found = components(links.union(more))
    forget(shared, star, sets, links, more)
    ends = classes.select("digest", "did", "least").join(found.withColumnRenamed("node", "did"), "did", "left")
    low = ends.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("low"))
    ends = ends.join(low, "component", "left").select("digest", F.coalesce("component", "did").alias("component"), F.coalesce("low", "least").alias("least"))
    out = prints.drop("keys").join(ends, "digest", "left")
    return out.select("did", "doc", "n_shingles", F.coalesce("component", "did").alias("component"), F.coalesce("least", "doc").alias("least"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc, n_shingles, component) for each row of ``docs``; ``doc`` must be a long."""
    rows = numbered(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), "did").select("did", "doc", "text")
    return grouped(rows, width, percent).select("doc", "n_shingles", F.col("least").alias("component"))


def deduplicate(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies, that of the smallest id (a null one first); of texts without words, repeated rows once."""
    row = unused("row", docs.columns)
    rows = numbered(docs, row)
    found = grouped(rows.select(F.col(row).alias("did"), F.col(doc).alias("doc"), F.col(text).alias("text")), width, percent)
    kept = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc", "did")).alias("first")).select(F.col("first.did").alias(row))
    bare = rows.join(found.where("n_shingles = 0").select(F.col("did").alias(row)), row, "left_semi").groupBy(doc, text).agg(F.min(row).alias(row))
    return rows.join(kept.union(bare.select(row)), row, "left_semi").select(*[named(c) for c in docs.columns])


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


QUERIES = {"op2_minhash": op2_minhash}
SQL: dict[str, str] = {}
