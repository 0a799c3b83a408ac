"""Collocations: phrases of words that occur together more often than apart, per language.

Misra-Gries summaries per hash partition find the n-grams that may be frequent; a second pass counts
those exactly, by their words. Work is dealt in blocks of texts and in buckets of n-gram hashes, so no n-gram,
language or text decides what a task holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored
from .words import LOWER, mix, powers, span_hashes, text_bytes

#: fixed values: bytes that end a piece, and that part its words
PIECE_END, BLANK = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: words of the longest phrase; bytes of text to a block, of text to a bucket, and from which a text is cut at piece ends
LONGEST, BLOCK_BYTES, BUCKET_BYTES, CUT_BYTES = 4, 4_000_000, 32_000_000, 1_000_000
#: counters of a summary, as a multiple of mass / threshold; from 1 on, no frequent n-gram is lost
SPARE = 2
_ENDS = np.isin(np.arange(256), list(PIECE_END))
_PARTS = _ENDS | np.isin(np.arange(256), list(BLANK))
_END = re.compile("[%s]" % PIECE_END.decode())

BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("text", pa.string()), ("size", pa.int64())])
SUMMARY = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
KEPT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary())])
COUNTED = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def cut_text(text: str, most: int = CUT_BYTES) -> list[str]:
    """The text in runs of ``most`` characters or more that end with a piece; no phrase crosses a cut."""
    out, at = [], 0
    while (m := _END.search(text, at + most)) is not None:
        out.append(text[at:m.end()])
        at = m.end()
    return [*out, text[at:]]


def to_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (block, lang, text, size): texts in runs of about ``block_bytes``, long ones cut."""
    nth, held = 0, 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        if len(sizes) and sizes.max() > CUT_BYTES:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            pairs = [(lang, part) for lang, text in zip(langs, texts) for part in cut_text(text)]
            batch = pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["lang", "text"])
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        ends = held + np.cumsum(sizes)
        nths = nth + np.concatenate([[held], ends[:-1]]) // block_bytes
        block = (TaskContext.get().partitionId() << 32) + nths.astype(np.int64)
        if len(ends):
            nth, held = int(nth + ends[-1] // block_bytes), int(ends[-1] % block_bytes)
        yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("lang").cast(pa.string()), batch.column("text").cast(pa.string()),
                                          pa.array(sizes.astype(np.int64))], schema=BLOCKS)


class Grams:
    """The words of some texts as codes of a dictionary, and the runs of words inside their pieces."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, langs: pa.Array | pa.ChunkedArray):
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        inside = ~_PARTS[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        first = inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1]) if len(data) else inside
        start = np.flatnonzero(first)
        doc = np.searchsorted(offsets, start, side="right")
        # words of one text with no piece end between them have the same number
        self.piece = np.cumsum(_ENDS[data], dtype=np.int32)[start] + doc
        spell = data[inside]  # all words, one after the other
        at = np.concatenate([np.cumsum(inside, dtype=np.int32)[start] - 1, [len(spell)]]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(spell))).dictionary_encode()
        self.codes, self.words = words.indices.to_numpy(), words.dictionary
        own, ends = text_bytes(self.words)
        self.hashes = span_hashes(own, ends[:-1], ends[1:])[self.codes] if len(start) else np.zeros(0, np.uint64)
        langs = (langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs).dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy()[doc - 1] if len(start) else np.zeros(0, np.int32)
        names, ends = text_bytes(pc.binary_join_element_wise(self.langs.cast(pa.string()), "", "\n"))
        self.salt = span_hashes(names, ends[:-1], ends[1:])[self.lang] if len(start) else np.zeros(0, np.uint64)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, 64-bit hashes) of all runs of ``width`` words within a piece, by language and words."""
        n = max(len(self.codes) - width + 1, 0)
        at = np.flatnonzero(self.piece[:n] == self.piece[len(self.piece) - n:])
        total = self.salt[at].copy()
        for k, weight in enumerate(powers(width + 1)[1:]):
            total += self.hashes[at + k] * weight
        return at, mix(total, width)


def placed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit key of each hash as one number. Keys that meet only add up: none is lost."""
    return ((((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (hashes & np.uint64(2**32 - 1))


def packed(values: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress well where they are sorted or small."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def summaries(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each run of rows of a block and each bucket: its keys, sorted, and how often each occurs."""
    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        grams = Grams(table.column("text"), table.column("lang"))
        keys, times = np.unique(placed(np.concatenate([grams.runs(w)[1] for w in range(1, LONGEST + 1)]), buckets), return_counts=True)
        first = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        own = np.flatnonzero(np.diff(first))
        return pa.RecordBatch.from_arrays([
            pa.array(own.astype(np.int32)), pa.array(np.full(len(own), rows[0].column("block")[0].as_py(), np.int64)),
            pa.array([packed(keys[first[b]:first[b + 1]] & np.uint64(2**32 - 1)) for b in own], pa.binary()),
            pa.array([packed(times[first[b]:first[b + 1]]) for b in own], pa.binary())], schema=SUMMARY)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and b > a and held[0].column("block")[0].as_py() != block[a]:
                yield flush(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield flush(held)


class MisraGries:
    """A mergeable summary: at most ``capacity`` counters, each at most ``error`` below the true count.

    Summaries are added counter by counter; beyond the capacity, the largest count that doesn't fit is taken from all.
    Each unit taken so costs at least ``capacity`` + 1 units of mass, so the error stays under mass / capacity, and
    a key that occurs more often keeps a counter.
    """

    def __init__(self, capacity: int):
        self.capacity, self.error = max(1, capacity), 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._more: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._more.append((keys, counts))
        if sum(len(k) for k, _ in self._more) >= self.capacity:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self._more)])
        counts = np.concatenate([self.counts, *(c for _, c in self._more)])
        self._more = []
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[at], np.add.reduceat(counts[order], at)
        if len(keys) > self.capacity:
            over = len(keys) - self.capacity - 1
            least = int(np.partition(counts, over)[over])
            keys, counts = keys[counts > least], counts[counts > least] - least
            self.error += least
        self.keys, self.counts = keys, counts

    def frequent(self, threshold: int) -> np.ndarray:
        """Sorted keys that may occur ``threshold`` times or more; all that do are among them."""
        self.settle()
        return self.keys[self.counts + self.error >= threshold]


def count_phrases(docs: DataFrame, threshold: int = 30, text_col: str = "text", lang_col: str = "lang",
                  block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f), (lang, n)): phrases of one to four words that occur ``threshold`` times or more in
    a language, with their counts, and the number of all words of each language that has any.

    Texts are stored in blocks. A block's n-grams, counted, go to their hash bucket, where their summaries merge;
    the keys that may be frequent go back to the blocks that hold them, which count their n-grams by their words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    blocks = stored(rows.mapInArrow(lambda b: to_blocks(b, block_bytes), _ddl(BLOCKS)), "blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // bucket_bytes))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        # a bucket's rows are bounded: buckets follow the size of the texts, and a block gives a key at most once
        raw = [(k.as_py(), c.as_py()) for k, c in zip(table.column("keys"), table.column("counts"))]
        mass = sum(int(unpacked(c).sum(dtype=np.int64)) for _, c in raw)
        summary = MisraGries(SPARE * (mass // threshold + 1))
        for k, c in raw:
            summary.add(unpacked(k), unpacked(c).astype(np.int64))
        likely = summary.frequent(threshold)
        out: dict[str, list] = {"block": [], "bucket": [], "keys": []}
        if not len(likely):
            return KEPT.empty_table()
        for block, (k, _) in zip(table.column("block").to_pylist(), raw):
            own = unpacked(k)
            where = np.minimum(np.searchsorted(own, likely), len(own) - 1)
            both = likely[own[where] == likely]
            if len(both):
                out["block"].append(block)
                out["bucket"].append(key[0].as_py())
                out["keys"].append(packed(both))
        return pa.table(out, schema=KEPT)

    def count(texts: pa.Table, kept: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return COUNTED.empty_table()
        grams = Grams(texts.column("text"), texts.column("lang"))
        numbers = np.bincount(grams.lang, minlength=len(grams.langs))
        some = np.flatnonzero(numbers)
        out = [pa.table([grams.langs.take(pa.array(some)).cast(pa.string()), pa.array(np.zeros(len(some), np.int32)),
                         pa.array([""] * len(some), pa.string()), pa.array(numbers[some].astype(np.int64))], schema=COUNTED)]
        likely = np.concatenate([np.zeros(0, np.uint64), *((np.uint64(b) << np.uint64(32)) | unpacked(k).astype(np.uint64)
                                                           for b, k in zip(kept.column("bucket").to_pylist(), kept.column("keys").to_pylist()))])
        likely.sort()
        if not len(likely):
            return out[0]
        low = np.uint64(2**22 - 1)
        maybe = np.zeros(2**22, bool)
        maybe[likely & low] = True
        for width in range(1, LONGEST + 1):
            at, hashes = grams.runs(width)
            where = placed(hashes, buckets)
            near = np.flatnonzero(maybe[where & low])
            near = near[likely[np.minimum(np.searchsorted(likely, where[near]), len(likely) - 1)] == where[near]]
            if not len(near):
                continue
            near = near[np.argsort(hashes[near], kind="stable")]
            at, hashes = at[near], hashes[near]
            # runs of equal hash are counted together while their words and language agree, so a hash never joins two phrases
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]]) | np.concatenate([[True], grams.lang[at[1:]] != grams.lang[at[:-1]]])
            for k in range(width):
                new[1:] |= grams.codes[at[1:] + k] != grams.codes[at[:-1] + k]
            group = np.flatnonzero(new)
            one = at[group]
            spelt = [grams.words.take(pa.array(grams.codes[one + k])).cast(pa.string()) for k in range(width)]
            out.append(pa.table([grams.langs.take(pa.array(grams.lang[one])).cast(pa.string()), pa.array(np.full(len(one), width, np.int32)),
                                 pc.binary_join_element_wise(*spelt, " ") if width > 1 else spelt[0],
                                 pa.array(np.diff(np.append(group, len(at))).astype(np.int64))], schema=COUNTED))
        return pa.concat_tables(out)

    kept = (blocks.mapInArrow(lambda b: summaries(b, buckets), _ddl(SUMMARY))
            .groupBy("bucket").applyInArrow(merge, _ddl(KEPT)))
    counts = (blocks.select("block", "lang", "text").groupBy("block").cogroup(stored(kept, "frequent").groupBy("block"))
              .applyInArrow(count, _ddl(COUNTED)).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
              .where((F.col("words") == 0) | (F.col("f") >= threshold)))
    counts = stored(counts, "phrases")
    return counts.where("words > 0"), counts.where("words = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, threshold: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to four words.

    A-Z are lower-cased; a text splits into pieces at ``PIECE_END`` and these into words at blanks. Counts are of all
    contiguous occurrences within pieces, overlaps included: a of the phrase, l and r of its two parts, n of all words.
    The score of a cut is floor(2000000 a / (l + r)), and the lowest of a phrase's cuts counts (ties: after fewer words).
    Phrases that occur fewer than ``threshold`` times are left out, and those inside a longer one of at least 80%
    of their occurrences. Ties of score go to larger a, then to the smaller phrase in byte order.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count each time. Other columns don't
    matter. A table without frequent phrases gives no rows. A text of any length is cut at piece ends only.
    """
    counts, sizes = count_phrases(docs, threshold, text_col, lang_col)
    words = F.split("phrase", " ")
    span = lambda first, n: F.array_join(F.slice("_w", first, n), " ")
    phrases = counts.where("words >= 2").withColumn("_w", words)
    cuts = (phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .select("lang", "phrase", "words", F.col("f").alias("a"), "k", span(F.lit(1), F.col("k")).alias("_first"),
                    span(F.col("k") + 1, F.col("words") - F.col("k")).alias("_rest")))
    part = lambda key, out: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(out))
    scored = (cuts.join(part("_first", "l"), ["lang", "_first"]).join(part("_rest", "r"), ["lang", "_rest"])
              .withColumn("score", F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r)")))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = (phrases.where("words >= 3").select("lang", "f", F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(_w, s, m), ' '))))")).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("_longer")))
    whole = (best.join(inner, ["lang", "phrase"], "left").where("_longer is null or 5 * _longer < 4 * a")
             .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first within parts of a language, so that no task ranks more than ``top`` rows of each part
    some = whole.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return some.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
