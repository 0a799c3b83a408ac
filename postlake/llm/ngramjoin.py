"""N-gram Jaccard join by PartEnum signatures, exact on word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import min_labels, shuffle_partitions, stored
from .words import mix, shingle_sets, slices

#: second-level partitions, of which a signature leaves one out
SECOND = 3
SUBSETS = np.array([[s in c for s in range(SECOND)] for c in combinations(range(SECOND), SECOND - 1)])
#: bits of a document's sketch, as words of 64; signatures that a task holds before it sends them on
SKETCH, HELD = 16, 2_000_000
#: sets of one signature that one task compares with as many others, about
BLOCK = 4096


def bands(most: int) -> np.ndarray:
    """Least sizes of bands of set sizes, each a quarter wider than the last; the last is beyond ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1], out[-1] * 5 // 4) + 1)
    return np.array(out)


def _parts(k: int) -> tuple[int, int]:
    """(first-level partitions, how many of them may be weak) for sets that differ in at most k features."""
    spare = (k // 2 + 1) // 12
    return k // 2 + 1 + spare, spare


def signatures(sets: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature): any two sets with Jaccard similarity of 0.8 or more share a signature.

    With sizes s <= t and union U, such sets have s >= 0.8 U and so differ in at most 0.2 U <= s / 4
    features. Sizes fall into bands; a set enters each band that the smaller set of a pair with it can be in.
    In a band whose sets have up to r features, with k = r // 4, hashing deals the feature domain to first-level
    partitions, each dealt on to three second-level ones. If there are k // 2 + 1 + e of the former, at most
    k // 2 can hold two differences or more, so at least e + 1 hold one at most; there, some two of the three
    second-level partitions hold none, and the signature of these two agrees. A signature is the band, the
    subset's number and the sum of the hashes of the features in it.

    A signature without features says nothing and isn't made. A partition where one lacks is weak, and both
    sets of a pair that agree there see it. A set with at most e weak ones has enough others. One with more
    is dealt again by another hash, until a deal is good; a pair is missed in a deal only if it is bad for
    both, and so the next deal finds it.
    """
    size = np.diff(ptr)
    out_set, out_sig = [], []
    if not len(sets):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = bands(int(size.max()))
    for d in np.flatnonzero(size):
        n = int(size[d])
        own = sets[ptr[d]:ptr[d + 1]]
        for band in range(int(np.searchsorted(low, -(-4 * n // 5), side="right")) - 1, int(np.searchsorted(low, n, side="right"))):
            k = int(low[band + 1] - 1) // 4
            sigs = _deal(own, k, band)
            out_set.append(np.full(len(sigs), d)), out_sig.append(sigs)
    return np.concatenate(out_set), np.concatenate(out_sig)


def _deal(own: np.ndarray, k: int, band: int) -> np.ndarray:
    if k == 0:  # only equal sets are similar enough
        return mix(mix(own, 1).sum(keepdims=True), band * 2 + 1)
    parts, spare = _parts(k)
    made, deal = [], 0
    while True:
        h = mix(own, 100 + deal)
        cell = ((h >> np.uint64(32)) * np.uint64(parts * SECOND) >> np.uint64(32)).astype(np.int64)
        value = mix(own, 1)
        total, count = np.zeros(parts * SECOND, np.uint64), np.bincount(cell, minlength=parts * SECOND)
        np.add.at(total, cell, value)
        sums = (total.reshape(parts, SECOND)[:, None, :] * SUBSETS.astype(np.uint64)).sum(axis=2, dtype=np.uint64)
        full = (count.reshape(parts, SECOND)[:, None, :] * SUBSETS).sum(axis=2) > 0
        name = np.arange(parts * len(SUBSETS), dtype=np.uint64) + np.uint64((band * 64 + deal) << 32)
        made.append(mix(sums.ravel() ^ mix(name, 9), 2)[full.ravel()])
        if (~full.all(axis=1)).sum() <= spare:
            return np.concatenate(made)
        deal += 1


def sketches(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A bit for each class of features: whether the set has an odd number of them. Bits that differ between
    two sets are no more than the features that do."""
    n, bits = len(ptr) - 1, SKETCH * 64
    at = np.repeat(np.arange(n), np.diff(ptr)) * bits + (mix(sets, 77) >> np.uint64(64 - 10)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1)


def _set_hash(sets: np.ndarray, ptr: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set, the sum of its features' hashes."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets, seed))])
    return mix(total[ptr[1:]] - total[ptr[:-1]], seed).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets, ptr = shingle_sets(part.column("text"))
            odd = pa.ListArray.from_arrays(pa.array(np.arange(len(ptr)) * SKETCH, pa.int32()), pa.array(sketches(sets, ptr).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "k1", "k2")), pa.array(np.diff(ptr)), pa.array(_set_hash(sets, ptr, 21)),
                                              pa.array(_set_hash(sets, ptr, 22)), odd], names=["id", "k1", "k2", "n", "h1", "h2", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets, ptr = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(sets.view(np.int64)))], names=["node", "features"])


def _signed(buckets: int):
    """Packed signatures of a task's texts: a row per bucket, with signatures and set hashes as bytes.

    Equal sets of a task are signed once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        done: set[int] = set()

        def flush() -> pa.RecordBatch:
            sig, owner = np.concatenate(sigs), np.concatenate(owners)
            sigs.clear(), owners.clear()
            bucket = (sig >> np.uint64(34)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            sig, owner, bucket = sig[order], owner[order], bucket[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[at[1:], len(bucket)].tolist()
            raw = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at.tolist(), ends)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), raw(sig), raw(owner)], names=["bucket", "sigs", "owners"])

        held = 0
        for batch in batches:
            for part in slices(batch):
                sets, ptr = shingle_sets(part.column("text"))
                h1 = _set_hash(sets, ptr, 21)
                new = [r for r, h in enumerate(h1.tolist()) if h not in done and not done.add(h)]
                size = np.diff(ptr)[new]
                at = np.repeat(ptr[new] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                who, sig = signatures(sets[at], np.concatenate([[0], np.cumsum(size)]))
                sigs.append(sig), owners.append(h1[new][who])
                held += len(sig)
                if held > HELD:
                    yield flush()
                    held = 0
        if held:
            yield flush()
    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Signatures that several sets have, from the packed rows of a bucket: (sig, pivot, other, size).

    A row per set but the pivot, which is the least; of a signature that just two sets have, sig is null and
    the pair occurs once.
    """
    cat = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind)
    sig, owner = cat("sigs", np.uint64), cat("owners", np.int64)
    order = np.argsort(sig, kind="stable")
    sig, owner = sig[order], owner[order]
    same = np.zeros(len(sig), bool)
    same[1:] = sig[1:] == sig[:-1]
    keep = same | np.r_[same[1:], False]
    sig, owner = sig[keep], owner[keep]
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
    sig, owner = sig[new], owner[new]
    first = np.r_[True, sig[1:] != sig[:-1]][:len(sig)]
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(sig)])
    pivot, many = np.repeat(owner[at], size), np.repeat(size, size)
    other = ~first
    two, more = other & (many == 2), other & (many > 2)
    pairs = np.unique(np.stack([pivot[two], owner[two]], axis=1), axis=0)
    cols = [np.r_[np.zeros(len(pairs), np.int64), sig[more].view(np.int64)], np.r_[pairs[:, 0], pivot[more]], np.r_[pairs[:, 1], owner[more]],
            np.r_[np.full(len(pairs), 2), many[more]]]
    null = np.r_[np.ones(len(pairs), bool), np.zeros(int(more.sum()), bool)]
    return pa.table({"sig": pa.array(cols[0], mask=null), "pivot": cols[1], "other": cols[2], "size": cols[3].astype(np.int64)})


def _near(rows: pa.Table) -> pa.Table:
    """Pairs of two blocks of sets of one signature, or within one, which may be similar enough, by size and
    sketch, across components. What is sent on are the pairs that pass.
    """
    node, label, n, block = (rows.column(c).to_numpy() for c in ("node", "label", "n", "block"))
    lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)  # bits of signed numbers would be those of their absolute values
    one, two = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(one), 256):
        for b in range(a if lo == hi else 0, len(two), 256):
            i, j = one[a:a + 256], two[b:b + 256]
            small, large = np.minimum(n[i, None], n[None, j]), np.maximum(n[i, None], n[None, j])
            ok = (label[i, None] != label[None, j]) & (5 * small >= 4 * large)
            x, y = np.nonzero(np.triu(ok, 1) if lo == hi and a == b else ok)
            differ = np.bitwise_count(sketch[i][x] ^ sketch[j][y]).sum(axis=1, dtype=np.int64)
            near = 9 * differ <= (small + large)[x, y]
            u, v = node[i][x[near]], node[j][y[near]]
            left.append(np.minimum(u, v)), right.append(np.maximum(u, v))
    return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, text): k1 and k2 hash id and text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"),
                       F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("k2"), F.col(text_col).alias("text"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    A document's set holds its distinct shingles of five words (A-Z lower-cased); with fewer words, the whole
    sequence is its one shingle. Documents link when the Jaccard similarity of their sets is 0.8 or
    more, and component_id is the smallest id that links lead to, the document's own included.

    1. Equal sets are a class; a class is a node, so copies cost one row each and are never paired.
    2. PartEnum signatures of all texts, packed per task and bucket, meet by bucket. Sets that share a signature
       form a star around one of them. Stars' pairs pass an exact bound by size and sketch, then the sets
       themselves are intersected.
    3. Links join nodes to components. Of a signature's sets that fell into several components, pairs across
       components are checked too (bound in pairs of blocks, then the sets), so no link between different sets is lost.

    Null and empty texts, or texts without words, have no shingles and link with nothing; their component is
    their own id. Rows with a null id take part in linking, and have a null component_id if they reach no
    id. Repeated rows are copies. An empty table gives no rows. Other columns are ignored.
    """
    linked = _linked(_rows(docs, id_col, text_col))
    # written, so that the join on the label of a hot component can be split
    smallest = stored(linked.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id")), "smallest")
    return (linked.join(smallest, "label", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group of linked ones: the smallest id (null last), of repeated rows any.

    Documents without shingles link with nothing, so all of them stay. Columns are the documents' own.
    """
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    linked = _linked(_rows(docs, id_col, text_col))
    first = linked.where("label is not null").groupBy("label").agg(F.min(place).alias("own")).select("own.k1", "own.k2", F.lit(True).alias("once"))
    bare = linked.where("label is null").select("k1", "k2", F.lit(False).alias("once")).distinct()
    keys = [F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))]
    rows = docs.select(keys[0].alias("_k1"), keys[1].alias("_k2"), F.struct("*").alias("_row"))
    kept = rows.join(first.union(bare).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "once"), ["_k1", "_k2"])
    nth = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1"))
    return kept.withColumn("_nth", nth).where("not once or _nth = 1").select("_row.*")


def _linked(rows: DataFrame) -> DataFrame:
    """(id, k1, k2, n, label) of each document: n shingles, and the label of its component; null without shingles."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    info = stored(rows.mapInArrow(_describe, f"id {kind}, k1 long, k2 long, n long, h1 long, h2 long, sketch array<long>"), "info")
    classes = stored(info.where("n > 0").groupBy("n", "h1", "h2")
                     .agg(F.min(F.struct("k1", "k2", "sketch")).alias("own"))
                     .select(F.monotonically_increasing_id().alias("node"), "n", "h1", "h2", "own.k1", "own.k2", "own.sketch"), "classes")

    buckets = shuffle_partitions(spark) * 8
    packed = rows.select("text").mapInArrow(_signed(buckets), "bucket int, sigs binary, owners binary")
    shared = stored(packed.groupBy("bucket").applyInArrow(_shared, "sig long, pivot long, other long, size long"), "shared")

    brief = classes.select("node", "n", "h1", "sketch")
    side = lambda name, h: brief.select(F.col("h1").alias(h), F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    stars = (shared.select("pivot", "other").distinct().join(side("a", "pivot"), "pivot").join(side("b", "other"), "other")
             .where((5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * differ <= F.col("na") + F.col("nb")))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = _verified(stored(stars, "stars"), classes, rows)
    label = _labels(links, classes)

    # of each distinct group of sets that share a signature and aren't all of one component, one signature
    members = shared.where("sig is not null").select("sig", F.col("other").alias("h1")).union(
        shared.where("sig is not null").select("sig", F.col("pivot").alias("h1")).distinct())
    placed = stored(members.join(label, "h1"), "members")
    groups = (placed.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"))
              .where("lo <> hi").groupBy("m", "x").agg(F.min("sig").alias("sig")))
    # a group is dealt to blocks, and a task gets two of them, so a hot signature's sets never meet in one task
    blocks = F.ceil(F.col("m") / BLOCK)
    open_ = (placed.join(groups.select("sig", "m"), "sig").join(brief.select("node", "n", "sketch"), "node")
             .withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .select("sig", "node", "label", "n", "sketch", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    across = open_.groupBy("sig", "lo", "hi").applyInArrow(_near, "a long, b long").distinct()
    more = _verified(stored(across, "across"), classes, rows)
    final = _labels(links.union(more), classes).join(classes.select("node", "n", "h2"), "node").select("n", "h1", "h2", "label")
    return stored(info.join(final, ["n", "h1", "h2"], "left").select("id", "k1", "k2", "n", "label"), "classed")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs of nodes (a, b) whose sets are similar enough; sets come from the texts again."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = need.join(classes.select("node", "k1", "k2", "n"), "node")
    texts = rows.select("k1", "k2", "text").join(wanted.select("k1", "k2", "node"), ["k1", "k2"])
    sets = stored(texts.select("node", "text").mapInArrow(_sets, "node long, features array<long>").dropDuplicates(["node"]), "sets")
    a, b = sets.select(F.col("node").alias("a"), F.col("features").alias("fa")), sets.select(F.col("node").alias("b"), F.col("features").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    return stored(pairs.join(a, "a").join(b, "b").where(100 * both >= 80 * (F.size("fa") + F.size("fb") - both)).select("a", "b"), "linked")


def _labels(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, h1, label) of all nodes; a node without links is its own label."""
    found = min_labels(links)
    return classes.select("node", "h1").join(found, "node", "left").select("node", "h1", F.coalesce("label", "node").alias("label"))
