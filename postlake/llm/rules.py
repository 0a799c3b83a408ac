"""Quality rules: counted base rules, then the log-likelihood ratio of hashed n-grams between a trusted
target and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, slices, span_hashes, windows

#: bits of a hashed n-gram, and bytes to an n-gram
BITS, GRAM = 18, 4
#: pseudo-counts of the target as a share of its n-grams
SHARE = 0.1
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STATS = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash bucket of the byte n-gram at each byte; 2 ** BITS where it would cross the end of its text."""
    code = np.zeros(len(data), np.uint32)
    for k in range(GRAM):
        code[:len(data) - k] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    code >>= np.uint32(32 - BITS)
    for k in range(1, GRAM):
        code[np.maximum(offsets[1:] - k, offsets[:-1])[np.diff(offsets) > 0]] = 1 << BITS
    return code


def _lines(words: Words) -> np.ndarray:
    """Number of lines of each text that have a word and equal an earlier line."""
    n, data, offsets = len(words.counts), words.data, words.offsets
    out = np.zeros(n, np.int64)
    if not len(words.start):
        return out
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.r_[offsets[:-1], breaks + 1])
    starts = starts[starts < len(data)]
    ends = np.minimum(np.r_[starts[1:], len(data)], len(data))
    ends = ends - ((data[ends - 1] == 10) & (ends > starts))
    has = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    raw = data.tobytes()
    seen: set = set()
    last = -1
    hashes = span_hashes(data, starts, ends)
    for d, h, a, b in zip(doc.tolist(), hashes.tolist(), starts.tolist(), ends.tolist()):
        if d != last:
            seen, last = set(), d
        line = raw[a:b] if b - a < 64 else (h, b - a)
        if line in seen:
            out[d] += 1
        seen.add(line)
    return out


def _repeats(words: Words) -> np.ndarray:
    """Number of words of each text that lie in a 3-word window found twice or more in it."""
    runs, ptr = windows(words.hashes(), words.first, 3, short=False)
    covered = np.zeros(len(words.start) + 3, bool)
    size = np.diff(ptr)
    for d in np.flatnonzero(size > 1).tolist():
        own = runs[ptr[d]:ptr[d + 1]]
        order = np.argsort(own, kind="stable")
        s = own[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = words.first[d] + np.flatnonzero(twice)
            for k in range(3):
                covered[at + k] = True
    total = np.concatenate([[0], np.cumsum(covered[:len(words.start)])])
    return total[words.first[1:]] - total[words.first[:-1]]


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of whole texts: n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words."""
    words = Words(texts)
    within = np.concatenate([[0], np.cumsum(((words.data & 0xC0) != 0x80) & ~np.isin(words.data, [9, 10, 11, 12, 13, 32]))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[words.data])])
    a, b = words.offsets[:-1], words.offsets[1:]
    return {"n_words": words.counts.astype(np.int64), "word_chars": within[b] - within[a], "n_symbols": symbols[b] - symbols[a],
            "n_dup_lines": _lines(words), "n_repeat_words": _repeats(words)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros((1 << BITS) + 1, np.int64), np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            code = grams(words.data, words.offsets)
            raw += np.bincount(code, minlength=len(raw))
            trusted = part.column("trusted").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            target += np.bincount(code[np.repeat(trusted, np.diff(words.offsets))], minlength=len(raw))
    at = np.flatnonzero(raw[:-1])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def gram_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> np.ndarray:
    """log(p_target / p_raw) of each hash bucket, over the n-grams of all documents.

    ``trusted`` has the ids of target documents. The target is smoothed towards the raw multinomial
    with ``share`` of its own n-grams as pseudo-counts, so a ratio means the same for every size of corpus: it is at
    least log(share / (1 + share)), that of n-grams which the target lacks. Counts
    are summed per task before the shuffle; the driver gets one row per bucket, 2 ** BITS at most.
    """
    ids = trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("trusted", F.lit(True)).hint("merge")  # target ids grow with the corpus: never broadcast
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left").select("text", "trusted"))
    got = (rows.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket")
           .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    ratio = np.zeros((1 << BITS) + 1)
    if raw.sum() and target.sum():
        p = raw / raw.sum()
        smooth = share * target.sum()
        seen = raw > 0
        ratio[:-1][seen] = np.log((target[seen] + smooth * p[seen]) / (target.sum() + smooth) / p[seen])
    return ratio


def apply_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                least_words: int = 50, most_repeat: int = 50, least_ratio: float = -0.45) -> DataFrame:
    """Base counts, base verdict, length-normalised ratio and final verdict of every whole text.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than
    ``least_words`` words, or more than ``most_repeat`` % of them in repeated 3-word windows), ratio (mean
    log-likelihood ratio of its n-grams, 0 without any) and kept: not base_failed and ratio at least
    ``least_ratio``. The threshold is the same for every document, and as pseudo-counts are a share of the target, a ratio
    means the same for every size of corpus.

    Null and empty texts have no words and fail the base rules. Null ids are no target. Repeated rows are
    judged each. Without target documents every ratio is 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    ratios = spark.sparkContext.broadcast(gram_ratios(docs, trusted, id_col, text_col).astype(np.float64))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                stats = text_stats(texts)
                words = Words(texts)
                bytes_ = np.diff(words.offsets)
                ratio, some = np.zeros(len(bytes_)), np.flatnonzero(bytes_)
                if len(some):
                    ratio[some] = np.add.reduceat(table[grams(words.data, words.offsets)], words.offsets[some])
                ratio /= np.maximum(bytes_ - GRAM + 1, 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, stats.values()), pa.array(ratio)], names=["id", *stats, "ratio"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = STATS.replace("id long", f"id {rows.schema['id'].dataType.simpleString()}") + ", ratio double"
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    return (rows.mapInArrow(judge, schema).withColumnRenamed("id", id_col)
            .withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= least_ratio)))
