"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import text_stats
from .words import Words, distinct, mix, slices

#: hash buckets of words, factors, and structure statistics that follow the buckets
BUCKETS, FACTORS, STATISTICS = 1 << 13, 8, 12
#: bytes of text that are scored at once
SCORED = 500_000


@dataclass
class Machine:
    """bias + w.x + half the sum over factors of (V'x)^2 - (V^2)'(x^2)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, at: np.ndarray, value: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Probabilities of rows given as sparse features ``at``, ``value`` in ranges ``ptr``; no range is empty.

        Pairwise terms use the identity sum of squares, so time is linear in the number of features.
        """
        sums = lambda x: np.add.reduceat(x, ptr[:-1], axis=0)
        vx = self.factors[at] * value[:, None]
        pairs = 0.5 * (sums(vx) ** 2 - sums(vx * vx)).sum(axis=1)
        z = self.bias + sums(self.weights[at] * value) + pairs
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def features(texts: pa.Array, chars: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (bucket, value, offsets): words as log counts of unit length, statistics, stated length.

    ``chars`` is a metadata column with a stated number of characters; null is taken as the text's own.
    """
    words = Words(texts)
    bucket = (mix(words.hashes(), 7) >> np.uint64(64 - 13)).astype(np.int64)
    ids, ptr, times = distinct(bucket, words.first)
    value = np.log1p(times.astype(float))
    row = np.repeat(np.arange(len(words.counts)), np.diff(ptr))
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(words.counts)))
    value = value / norm[row] if len(row) else value
    stats = text_stats(texts)
    n, a, b = np.maximum(stats["n_words"], 1), words.offsets[:-1], words.offsets[1:]

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[b] - total[a]) / np.maximum(stats["word_chars"], 1)

    d = words.data
    own = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
    own = own[b] - own[a]
    stated = own if chars is None else np.where(pc.is_valid(chars).to_numpy(zero_copy_only=False), chars.fill_null(0).to_numpy(zero_copy_only=False), own)
    dense = np.stack([
        np.ones(len(n)), np.log1p(stats["n_words"]) / 5, stats["word_chars"] / n / 10, stats["n_symbols"] / n, stats["n_dup_lines"] / n * 10,
        stats["n_repeat_words"] / n, share((d >= 65) & (d <= 90)) * 3, share(d == 33) * 5, share((d >= 48) & (d <= 57)) * 5,
        np.diff(ptr) / n, share((d == 44) | (d == 46)) * 5, np.log1p(np.maximum(stated, 0).astype(float)) / 8], axis=1)
    rows = len(n)
    sizes = np.diff(ptr) + STATISTICS
    out = np.concatenate([[0], np.cumsum(sizes)])
    at, val = np.empty(int(out[-1]), np.int64), np.empty(int(out[-1]))
    word_at = np.arange(len(ids)) + np.repeat(np.arange(rows) * STATISTICS, np.diff(ptr))
    at[word_at], val[word_at] = ids, value
    stat_at = out[1:, None] - STATISTICS + np.arange(STATISTICS)
    at[stat_at], val[stat_at] = BUCKETS + np.arange(STATISTICS), np.minimum(dense, 10)
    return at, val, out


def fit(at: np.ndarray, value: np.ndarray, ptr: np.ndarray, label: np.ndarray, steps: int = 600, rate: float = 0.1,
        decay: float = 1e-4, batch: int = 128, seed: int = 3) -> Machine:
    """Adagrad on the logistic loss: so many mini-batches, each pass over the rows in a fixed random order."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)))
    if len(label):
        share = min(max(float(label.mean()), 0.01), 0.99)
        m.bias = float(np.log(share / (1 - share)))
    g_b, g_w, g_v = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    done = 0
    while done < steps and len(label):
        order = rng.permutation(len(label))
        for k in range(0, len(order), batch):
            done += 1
            rows = order[k:k + batch]
            sizes = ptr[rows + 1] - ptr[rows]
            own = np.concatenate([[0], np.cumsum(sizes)])
            i = np.arange(int(own[-1])) + np.repeat(ptr[rows] - own[:-1], sizes)
            f, x = at[i], value[i]
            miss = m.scores(f, x, own) - label[rows]
            each = np.repeat(miss / len(rows), sizes)
            vx = m.factors[f] * x[:, None]
            total = np.repeat(np.add.reduceat(vx, own[:-1], axis=0), sizes, axis=0)
            seen, back = np.unique(f, return_inverse=True)
            dw = np.bincount(back, each * x, minlength=len(seen)) + decay * m.weights[seen]
            slope = (each * x)[:, None] * (total - vx)
            dv = np.stack([np.bincount(back, slope[:, j], minlength=len(seen)) for j in range(FACTORS)], axis=1) + decay * m.factors[seen]
            g_w[seen] += dw * dw
            g_v[seen] += dv * dv
            m.weights[seen] -= rate * dw / np.sqrt(g_w[seen])
            m.factors[seen] -= rate * 0.3 * dv / np.sqrt(g_v[seen])
            db = float(miss.mean())
            g_b += db * db
            m.bias -= rate * db / g_b ** 0.5
    return m


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            at, value, ptr = features(part.column("text"), part.column("chars"))
            split = lambda x, kind: pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), split(at, pa.int32()), split(value, pa.float32())],
                                             names=["id", "label", "at", "value"])


def _inputs(docs: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    chars = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), chars.alias("chars"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
          label_col: str = "quality", bound: int = 6000, folds: int = 5) -> Machine:
    """Fit on at most ``bound`` labelled documents, the first by hash of their id.

    Documents whose crc32 of the id as text is 0 modulo ``folds`` are held out. The bounded list of ids is
    broadcast, so the texts aren't shuffled; their sparse features are gathered on the driver.
    """
    key = F.crc32(F.col(id_col).cast("string"))
    ids = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (key % folds != 0))
           .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
           .orderBy(F.xxhash64("id"), "id").limit(bound))
    rows = (_inputs(docs, id_col, text_col, chars_col).join(F.broadcast(ids), "id")
            .groupBy("id").agg(F.max(F.struct("text", "chars")).alias("own"), F.max("label").cast("int").alias("label"))
            .select("id", "own.text", "own.chars", "label"))  # of repeated ids, one text
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(_extract, f"id {kind}, label int, at array<int>, value array<float>").toArrow()
    got = got.sort_by([("id", "ascending")])
    at, value = (np.concatenate([x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py():x.offsets[-1].as_py()] for x in got[c].chunks] or [np.zeros(0)]) for c in ("at", "value"))
    sizes = pc.list_value_length(got["at"]).to_numpy() if got.num_rows else np.zeros(0, np.int64)
    return fit(at.astype(np.int64), value.astype(float), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), got["label"].to_numpy().astype(float))


def with_score(docs: DataFrame, machine: Machine, text_col: str = "text", chars_col: str = "n_chars", out: str = "score") -> DataFrame:
    """The documents with all their columns, and the score of each whole text as ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SCORED):
                stated = part.column(chars_col).cast(pa.int64()) if chars_col in part.schema.names else None
                scores = shared.value.scores(*features(part.column(text_col), stated))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, out])

    rows = docs.drop(out)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
          threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 if score >= ``threshold``).

    Null and empty texts are scored by their statistics. A null id is held out, as nothing was learnt
    from it. Repeated rows are scored each. Other columns are ignored.
    """
    out = with_score(_inputs(docs, id_col, text_col, chars_col), machine, "text", "chars")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == 0, F.lit(True))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text", chars_col: str = "n_chars", threshold: float = 0.3) -> DataFrame:
    """The documents that score at least ``threshold``, with their own columns."""
    scored = with_score(docs, machine, text_col, chars_col, "_score")
    return scored.where(F.col("_score") >= threshold).drop("_score")
