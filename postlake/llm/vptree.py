"""Approximate nearest neighbours by cosine: a vantage-point tree per shard."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: vectors to a shard on average, to a leaf, queries to a block, and blocks that a task holds beside a tree
SHARD, LEAF, BLOCK, HELD = 8192, 128, 1024, 16
#: bytes of vectors to a shard on average, at most; values that are scored at once
SHARD_BYTES, SCORED = 64 << 20, 1 << 22
#: decimals of a unit vector's components that tell directions apart
DIRECTION = 9
#: distances are square roots of small differences; what rounding may add to them
SLACK = 1e-6


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as array<double>) of the vectors that take part: no null, no null or non-finite component, not zero."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNotNull() & F.col("id").isNotNull() & ~odd & F.exists(v, lambda x: x != 0))


class Tree:
    """Nodes over unit vectors: a vantage point and the least and greatest distance to each half, by median.

    Vectors of one direction are one point, with each distinct vector and its ids. Distances are Euclidean between
    unit vectors, which order as cosines do and satisfy the triangle inequality.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 5):
        _, first, which = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        raw = vectors[first]
        _, lead, point = np.unique(np.round(unit(raw), DIRECTION) + 0.0, axis=0, return_index=True, return_inverse=True)
        # distinct vectors in order of their points, and ids in order of their vectors
        by_point = np.argsort(point.ravel(), kind="stable")
        place = np.empty_like(by_point)
        place[by_point] = np.arange(len(by_point))
        self.raw, self.raw_ptr = raw[by_point], np.searchsorted(point.ravel()[by_point], np.arange(len(lead) + 1))
        own = place[which.ravel()]
        order = np.lexsort((ids, own))
        self.ids, self.ptr = ids[order], np.searchsorted(own[order], np.arange(len(raw) + 1))
        self.unit = unit(raw[lead])
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(lead)), leaf)
        del self.rng

    def _build(self, own: np.ndarray, leaf: int):
        if len(own) <= leaf:
            return own
        v = own[self.rng.integers(len(own))]
        d = np.sqrt(np.maximum(2 - 2 * (self.unit[own] @ self.unit[v]), 0))
        order = np.argsort(d, kind="stable")
        own, d, half = own[order], d[order], len(own) // 2
        return (v, d[0], d[half - 1], d[half], d[-1], self._build(own[:half], leaf), self._build(own[half:], leaf))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(points, distances) of the k + 1 nearest points found of each query, nearest first; -1 where there are fewer.

        A half is passed over if the triangle inequality puts all of it farther than ``factor`` times the
        distance of the worst point held. Queries go through a node together, each to its nearer half first.
        """
        held = np.full((len(queries), k + 1), np.inf)
        found = np.full((len(queries), k + 1), -1)
        q = unit(queries)

        def visit(node, live: np.ndarray) -> None:
            if not len(live):
                return
            if isinstance(node, np.ndarray):
                d = np.sqrt(np.maximum(2 - 2 * (q[live] @ self.unit[node].T), 0))
                both = np.concatenate([held[live], d], axis=1)
                which = np.concatenate([found[live], np.broadcast_to(node, d.shape)], axis=1)
                best = np.argsort(both, axis=1, kind="stable")[:, :k + 1]
                held[live], found[live] = np.take_along_axis(both, best, 1), np.take_along_axis(which, best, 1)
                return
            v, lo1, hi1, lo2, hi2, inner, outer = node
            d = np.sqrt(np.maximum(2 - 2 * (q[live] @ self.unit[v]), 0))
            gap1, gap2 = np.maximum(np.maximum(lo1 - d, d - hi1), 0), np.maximum(np.maximum(lo2 - d, d - hi2), 0)
            near = gap1 <= gap2

            def go(half, rows: np.ndarray, gap: np.ndarray) -> None:
                keep = ~(gap > factor * held[rows, -1] + SLACK)
                visit(half, rows[keep])

            go(inner, live[near], gap1[near])
            go(outer, live[near], gap2[near])
            go(outer, live[~near], gap2[~near])
            go(inner, live[~near], gap1[~near])

        visit(self.root, np.arange(len(queries)))
        return found, held


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow for very large or small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision and a fixed order of operations."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """A row (dim, shard, tree) per shard; every usable vector is in one tree.

    Shards are dealt by a hash of id and vector, so equal vectors and rows of one id spread over shards. The number of
    shards follows the number of vectors and their bytes. Vectors of different dimensions are in different shards.
    """
    rows = usable(vectors, id_col, vector_col)
    size = rows.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("values")).first()
    n = max(1, -(-size.n // shard), -(-8 * (size["values"] or 0) // SHARD_BYTES))

    def build(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(batch["id"].to_numpy(np.int64), np.stack(batch["vector"].to_numpy()).astype(float), leaf)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree)]})

    dealt = rows.select("id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("id", "vector"), F.lit(n)).alias("shard"))
    return stored(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, tree binary"), "trees")


HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _spread(ptr: np.ndarray, groups: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``groups``, member) of the members ptr[g] to ptr[g + 1] of each group, the first ``most`` of each."""
    size = np.diff(ptr)[groups]
    size = size if most is None else np.minimum(size, most)
    each = np.repeat(np.arange(len(groups)), size)
    return each, ptr[groups[each]] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)


def _ranked(tree: Tree, asked: pa.StructArray, k: int, factor: float) -> pa.Table:
    """(query_id, vec_id, score) of the best 2 k candidates of each query in one tree, its own id left out."""
    qid = asked.field("id").to_numpy()
    q = asked.field("vector").flatten().to_numpy().reshape(len(qid), -1)
    found, _ = tree.search(q, k, factor)
    vectors = np.diff(tree.raw_ptr)  # distinct vectors of a point
    load = np.where(found >= 0, vectors[found], 0).sum(axis=1).cumsum() * q.shape[1] // SCORED
    out = [HITS.empty_table()]
    for rows in np.split(np.arange(len(qid)), np.flatnonzero(np.diff(load)) + 1):
        at, col = np.nonzero(found[rows] >= 0)
        each, vector = _spread(tree.raw_ptr, found[rows][at, col])
        who = rows[at[each]]
        score = cosines(q[who], tree.raw[vector])
        # of each vector the first k + 1 ids: the query's own may be one
        each, member = _spread(tree.ptr, vector, k + 1)
        who, vec, score = who[each], tree.ids[member], score[each]
        ok = vec != qid[who]
        who, vec, score = who[ok], vec[ok], score[ok]
        order = np.lexsort((vec, -score, who))
        who, vec, score = who[order], vec[order], score[order]
        ok = np.arange(len(who)) - np.searchsorted(who, who) < 2 * k
        out.append(pa.table([qid[who[ok]], vec[ok], score[ok]], schema=HITS))
    return pa.concat_tables(out)


def search(index: DataFrame, queries: DataFrame, k: int = 5, factor: float = 0.25, id_col: str = "vec_id",
           vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query by cosine, the query's own id left out.

    Queries go in blocks to every shard of their dimension; a task holds one tree and about ``HELD`` blocks. Each
    shard gives its best ``k`` per query, and the best of these are ranked, ties to the smaller id. ``factor`` 1 is an exact search; a smaller one relaxes the
    triangle inequality's bound and passes over more of a tree. Unusable queries take no part. Of repeated
    query ids each usable row is searched, and equal results count once; repeated ids among the vectors
    count as one candidate by their best score.
    """
    rows = usable(queries, id_col, vector_col)
    blocks = max(1, -(-rows.count() // block))
    dealt = (rows.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id", "vector", F.lit(1)), F.lit(blocks)).alias("block"), F.struct("id", "vector").alias("query"))
             .groupBy("dim", "block").agg(F.sort_array(F.collect_list("query")).alias("queries")))

    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out = [HITS.empty_table()]
        for raw in trees.column("tree").to_pylist():
            tree = pickle.loads(raw)
            for r in range(asked.num_rows):
                out.append(_ranked(tree, asked.column("queries")[r].values, k, factor))
        return pa.concat_tables(out)

    parts = -(-blocks // HELD)
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))  # a row per dimension
    asked = (dealt.join(shards, "dim").withColumn("part", F.pmod("block", F.lit(parts)))
             .select("dim", "part", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard"), "queries"))
    trees = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    key = ["dim", "shard", "part"]
    hits = (trees.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
