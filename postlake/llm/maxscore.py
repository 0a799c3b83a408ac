"""Exact top-k by integer inner product: MaxScore over postings per dimension, in shards.

A term is a band of a dimension: a run of its postings in order of weight, with the greatest and least weight as bounds.
A vector is in one band of each dimension, so a query's score is at most the sum of the bounds of its bands.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

#: fixed value: components are scaled by this and rounded down
UNIT = 1024
#: bytes of weights to a shard at most and at least (where fewer shards than partitions would do) and of queries to a block, all on average;
#: blocks that a task holds beside a shard
SHARD_BYTES, LEAST_BYTES, BLOCK_BYTES, HELD = 16_000_000, 2_000_000, 500_000, 16
#: bands of a dimension, dimensions that give the first candidates, candidates and dimensions that are probed at a time
BANDS, SEEDS, PROBED, STEP = 32, 8, 2048, 8
LONG = 2**63 - 1
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_weights(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, weights as array<long>) of the vectors that take part; a weight beyond the range of long stands at its end."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNotNull() & F.col("id").isNotNull() & ~odd).select("id", F.transform(v, lambda x: F.floor(x * UNIT)).alias("weights"))


class Shard:
    """Postings of some vectors of one length: per dimension, the points in order of weight, cut into bands."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bands: int = BANDS):
        points, first, point = _points(weights)
        order = np.lexsort((ids, point))
        self.ids, self.ptr = ids[order], np.searchsorted(point[order], np.arange(len(first) + 1))
        self.weights = points.astype(np.min_scalar_type(-max(1, *(abs(int(x)) for x in (points.max(), points.min())))) if points.size else points.dtype)
        self.repeated = len(np.unique(ids)) < len(ids)
        n, dim = points.shape
        self.order = np.argsort(points, axis=0, kind="stable").astype(np.min_scalar_type(n))
        self.edges = np.unique(np.linspace(0, n, min(bands, n) + 1).astype(int))
        self.least = points[self.order[self.edges[:-1]], np.arange(dim)]
        self.most = points[self.order[self.edges[1:] - 1], np.arange(dim)]
        self.size = int(max((abs(int(points.max())), abs(int(points.min()))))) if points.size else 0

    def best(self, at: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best ``k`` ids at these points but ``own``; ties to the smaller id."""
        if len(at) > k + 1 and not self.repeated:
            keep = scores >= np.partition(scores, len(at) - k - 1)[len(at) - k - 1]
            at, scores = at[keep], scores[keep]
        size = np.minimum(np.diff(self.ptr)[at], k + 1)  # ids beyond are greater, with as many before them
        each = np.repeat(np.arange(len(at)), size)
        ids = self.ids[self.ptr[at[each]] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)]
        scores = scores[each]
        on = ids != own
        ids, scores = ids[on], scores[on]
        rank = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j])), int)
        ids, scores = ids[rank], scores[rank]
        if self.repeated and len(ids):
            once = np.sort(np.unique(ids, return_index=True)[1])
            ids, scores = ids[once], scores[once]
        return ids[:k], scores[:k]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the ``k`` greatest inner products, as ``best``.

        Scores of the best bands of a few dimensions give a first threshold. The terms whose bound is at least some level are
        essential: the level is the highest at which a vector in no essential term stays below the threshold. Vectors in essential
        postings are probed in the other dimensions while what remains could lift them to the threshold, which rises.
        """
        n, dim = self.weights.shape
        q = np.zeros(dim, np.int64)
        q[:min(dim, len(query))] = query[:dim]
        safe = max(map(abs, map(int, q)), default=0) * self.size * max(dim, 1) < 2**53
        q, weights = (q.astype(float), self.weights) if safe else (q.astype(object), self.weights.astype(object))
        least, most = (self.least, self.most) if safe else (self.least.astype(object), self.most.astype(object))
        bound = np.where(q > 0, most * q, least * q)  # a row per band, a column per dimension
        if not dim:
            return self.best(np.arange(n), np.zeros(n), own, k)
        # bands from the best to the worst of each dimension
        rank = np.where(q[None, :] > 0, np.arange(len(bound))[::-1, None], np.arange(len(bound))[:, None])
        bound = np.take_along_axis(bound, rank, 0)
        spread = bound[0] - bound[-1]
        dims = np.argsort(-spread, kind="stable") if safe else np.array(sorted(range(dim), key=lambda d: -spread[d]))
        rest = np.concatenate([np.cumsum(bound[0][dims][::-1])[::-1], [0]])  # the most that the dimensions from here on add
        seen = np.zeros(n, bool)

        def posted(bands: np.ndarray) -> np.ndarray:
            """Unseen points in the first ``bands[d]`` bands of each dimension."""
            hit = np.zeros(n, bool)
            for d in np.flatnonzero(bands):
                take = slice(self.edges[len(self.edges) - 1 - bands[d]], n) if q[d] > 0 else slice(0, self.edges[bands[d]])
                hit[self.order[take, d]] = True
            hit &= ~seen
            seen[hit] = True
            return np.flatnonzero(hit)

        def probe(at: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
            total = np.zeros(len(at)) if safe else np.zeros(len(at), object)
            for j in range(0, dim, STEP):
                some = dims[j:j + STEP]
                total = total + weights[at[:, None], some] @ q[some]
                keep = (total + rest[min(j + STEP, dim)] >= level).astype(bool)
                at, total = at[keep], total[keep]
            return at, total

        none = -np.inf
        seed = np.zeros(dim, int)
        seed[dims[:SEEDS]] = 1
        at, scores = probe(posted(seed), none)
        found, held = at, scores
        level = self._kth(found, held, own, k)
        essential = np.full(dim, len(bound))
        for line in np.sort(bound, axis=None)[::-1][::max(1, bound.size // 64)]:
            bands = (bound >= line).sum(axis=0)
            if (bands == len(bound)).any() or sum(bound[bands, np.arange(dim)]) < level:
                essential = bands
                break
        new = posted(essential)
        for j in range(0, len(new), PROBED):
            at, scores = probe(new[j:j + PROBED], level)
            if len(at):
                found, held = np.concatenate([found, at]), np.concatenate([held, scores])
                level = self._kth(found, held, own, k)
                on = (held >= level).astype(bool)
                found, held = found[on], held[on]
        return self.best(found, held, own, k)

    def _kth(self, at: np.ndarray, scores: np.ndarray, own: int, k: int):
        """The score to reach: the k-th best, or none while fewer are found."""
        held = self.best(at, scores, own, k)[1]
        return held[-1] if len(held) == k and k else -np.inf


def _points(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, a row of each, the distinct row of each row)."""
    if not weights.shape[1]:
        return weights[:1], np.zeros(min(1, len(weights)), int), np.zeros(len(weights), int)
    raw = np.ascontiguousarray(weights).view(np.dtype((np.void, weights.dtype.itemsize * weights.shape[1]))).ravel()
    _, first, point = np.unique(raw, return_index=True, return_inverse=True)
    return weights[first], first, point.ravel()


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row (dim, shard, postings) per shard; every vector that takes part is in one.

    Shards are dealt by a hash of id and vector, so that neither a repeated id nor a repeated vector fills one; their number
    follows the bytes of all vectors. Vectors of different lengths are in different shards.
    """
    rows = whole_weights(vectors, id_col, vector_col)
    size = rows.agg(F.sum(F.size("weights") * 8 + 8)).first()[0] or 0
    n = max(1, -(-size // shard_bytes), min(shuffle_partitions(vectors.sparkSession), size // LEAST_BYTES))

    def build(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        weights = np.array([list(w) for w in batch["weights"]], np.int64).reshape(len(batch), key[0])
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "postings": [pickle.dumps(Shard(batch["id"].to_numpy(np.int64), weights))]})

    # equal rows are one candidate
    dealt = rows.distinct().withColumns({"dim": F.size("weights"), "shard": F.pmod(F.xxhash64("id", "weights"), F.lit(n))})
    return stored(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, postings binary"), "postings")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest inner products of each query, its own id left out, ties to the smaller id.

    Components become floor(1024 x). Vectors that are null or hold a null or non-finite component take no part, nor do null ids;
    zero vectors do. A component that one of two vectors lacks counts as 0. Rows of a repeated id among the vectors are one
    candidate by its best score; of a repeated query id each row is searched, and the best scores count. A score
    beyond the range of long stands at its end. An empty index or no queries give no rows.

    Queries go in blocks to every shard; a task holds one shard and about ``HELD`` blocks, and gives the best ``k`` of each query.
    """
    rows = whole_weights(queries, id_col, vector_col).distinct()
    size = rows.agg(F.sum(F.size("weights") * 8 + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = (rows.select(F.pmod(F.xxhash64("id", "weights", F.lit(1)), F.lit(blocks)).alias("block"), F.struct("id", "weights").alias("query"))
             .groupBy("block").agg(F.collect_list("query").alias("queries")))

    def run(key: tuple, shards: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for raw in shards.column("postings").to_pylist():
            shard = pickle.loads(raw)
            for r in range(asked.num_rows):
                block = asked.column("queries")[r].values
                ids, lists = block.field("id").to_numpy(), block.field("weights")
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                for j, qid in enumerate(ids.tolist()):
                    vec, score = shard.search(flat[ends[j]:ends[j + 1]], qid, k)
                    out["query_id"] += [qid] * len(vec)
                    out["vec_id"] += vec.tolist()
                    out["score"] += [max(-LONG - 1, min(LONG, int(s))) for s in score.tolist()]
        return pa.table(out, schema=HITS)

    parts = -(-blocks // HELD)
    cells = index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))  # a row per shard
    asked = dealt.withColumn("part", F.pmod("block", F.lit(parts))).join(cells.withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), "part")
    shards = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    key = ["dim", "shard", "part"]
    hits = (shards.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
