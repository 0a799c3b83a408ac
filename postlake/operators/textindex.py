"""A stored full-text index (FTS1-FTS5): postings by term and block of documents, a dictionary, and trigrams of its terms.

A posting row holds a term's documents in one block, and its positions in them, as arrays. Rows lie in folders by a bucket of
the term's hash, sorted by term, so that a lookup reads one folder's matching row groups; a frequent word has a row per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import flatten_py, tokens
from .predicates import words_of

SCHEMAS = {"postings": "term string, block int, docs array<bigint>, pos array<array<int>>, field string, bucket int",
           "dictionary": "term string, n_docs bigint, n_occ bigint, n_blocks bigint, field string, bucket int",
           "trigrams": "term string, gram string, field string, bucket int", "settings": "blocks int, buckets int"}
#: what stands before and after a term in its trigrams
FIRST, LAST = "\x02", "\x03"
#: documents of a block on average, blocks of a slice and of a task, tokens that a Python worker packs at once
BLOCK_DOCS, SLICE_BLOCKS, TASK_BLOCKS, PACKED = 4096, 16, 8, 1_000_000


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def _pack(rows: pa.Table) -> pa.RecordBatch:
    """(term, block, docs, pos) of whole documents (block, doc_id, tokens), the rows of a document one after another."""
    doc, lists = rows.column("doc_id").combine_chunks(), rows.column("tokens").combine_chunks()
    size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
    words = flat.dictionary_encode()
    first = np.flatnonzero(_changes(doc))
    number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc)]))  # of the document of a row
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    key = words.indices.to_numpy().astype(np.int64) * len(first) + np.repeat(number, size)
    order = np.argsort(key, kind="stable") if len(first) == len(doc) else np.lexsort((place, key))
    key = key[order]
    entry = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    term, at = np.divmod(key[entry], max(len(first), 1))
    block = rows.column("block").to_numpy()[first][at]
    row = np.flatnonzero(np.r_[len(entry) > 0, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
    ends = pa.array(np.r_[row, len(entry)], pa.int32())
    places = pa.ListArray.from_arrays(pa.array(np.r_[entry, len(key)], pa.int32()), pa.array(place[order], pa.int32()))
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[row])), pa.array(block[row], pa.int32()), pa.ListArray.from_arrays(
        ends, doc.take(pa.array(first[at]))), pa.ListArray.from_arrays(ends, places)], ["term", "block", "docs", "pos"])


def _changes(ids: pa.Array) -> np.ndarray:
    """Whether an id differs from the one before; the first does."""
    null, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    return np.r_[True, (value[1:] != value[:-1]) | (null[1:] != null[:-1])][:len(ids)]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of up to PACKED tokens, or of one document; rows are sorted by document, and a document is in one pack."""
    held: list[pa.RecordBatch] = []
    n_held = 0
    for batch in batches:
        tokens_to = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = tokens_to[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(tokens_to, base + PACKED, side="right")))
            part = batch.slice(at, stop - at)
            if n_held >= PACKED or (held and n_held + tokens_to[stop - 1] - base > PACKED):
                joined = _changes(pa.concat_arrays([held[-1].column("doc_id")[-1:], part.column("doc_id")]))[1:]
                same = int(joined.argmax()) if joined.any() else part.num_rows  # rows of the document held last
                if same:
                    held.append(part.slice(0, same))
                if same < part.num_rows:
                    yield _pack(pa.Table.from_batches(held))
                    held, n_held = [], 0
                at += same
                if same:
                    continue
            held.append(part)
            n_held += int(tokens_to[stop - 1] - base)
            at = stop
    if held:
        yield _pack(pa.Table.from_batches(held))


def write_index(m: DataFrame, path: str, fields: dict[str, Column | str], blocks: int | None = None, buckets: int = 16, slices: int | None = None,
                doc_col: str = "doc_id") -> None:
    """Index the tokens of some text columns below ``path``: postings, dictionary, trigrams, and a row of settings.

    ``blocks``: parts that documents are dealt to by a hash, some thousand in each unless given. Texts are dealt by block, a task packs the
    words of its documents into rows of (term, block), and those cross a second exchange, dealt by a bucket of the term and a slice of the
    blocks, so a word in a third of all places spans ``slices`` tasks. Slices and tasks grow with the documents, so that a task's share doesn't.
    A null text has no tokens; a document id stands for one document.
    """
    spark = m.sparkSession
    if blocks is None:
        blocks = max(32, -(-m.count() // BLOCK_DOCS))
    slices = slices or max(4, blocks // SLICE_BLOCKS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = []
    for name, c in fields.items():
        texts = (m.select(F.col(doc_col).cast("long").alias("doc_id"), (F.col(c) if isinstance(c, str) else c).alias("text")).where("text is not null")
                 .withColumn("block", _bucket(F.col("doc_id"), blocks)))
        dealt = texts.repartition(max(tasks, blocks // TASK_BLOCKS), "block").sortWithinPartitions("block", "doc_id")
        parts.append(dealt.select("block", "doc_id", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("tokens"))
                     .mapInArrow(_packs, "term string, block int, docs array<bigint>, pos array<array<int>>").withColumn("field", F.lit(name)))
    packs = reduce(DataFrame.unionByName, parts).withColumns({"bucket": _bucket(F.col("term"), buckets), "slice": F.pmod("block", F.lit(slices))})
    deal = ["bucket", "slice"]  # not by the field: a literal leaves the grouping, and the rows would be dealt once more
    e = F.sort_array(F.arrays_zip("docs", "pos"))
    whole = (packs.repartition(max(tasks, buckets * slices), *deal).groupBy("field", *deal, "term", "block")
             .agg(F.flatten(F.collect_list("docs")).alias("docs"), F.flatten(F.collect_list("pos")).alias("pos"))
             .select("field", "bucket", "term", "block", e.alias("e")).select("field", "bucket", "term", "block", F.col("e.docs").alias("docs"), F.col("e.pos").alias("pos")))
    whole.sortWithinPartitions("field", "bucket", "term", "block").write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{path}/postings")
    n_occ = F.aggregate("pos", F.lit(0).cast("long"), lambda s, p: s + F.size(p))
    entries = (_read(spark, path, "postings").select("field", "bucket", "term", F.size("docs").alias("n"), n_occ.alias("o"))
               .groupBy("field", "bucket", "term").agg(F.sum("n").alias("n_docs"), F.sum("o").alias("n_occ"), F.count("*").alias("n_blocks")))
    entries.repartition("field", "bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{path}/dictionary")
    marked = F.concat(F.lit(FIRST), "term", F.lit(LAST))
    grams = (_read(spark, path, "dictionary").select("field", "term", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(marked) - 2), lambda k: F.substring(marked, k, F.lit(3))))).alias("gram"))
        .withColumn("bucket", _bucket(F.col("gram"), buckets)))
    grams.repartition("field", "bucket").sortWithinPartitions("gram", "term").write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{path}/trigrams")
    spark.createDataFrame([(blocks, buckets)], "blocks int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def required_trigrams(rx: str) -> set[str]:
    """Trigrams that every term matched by the regular expression has; none where the pattern isn't plain enough to tell.

    Runs of literal characters count, with anchors as the marks that stand around a term. Groups, classes, escapes of
    letters and optional characters end a run; a pattern with alternatives or flags requires nothing.
    """
    runs, run, depth, i = [], "", 0, 0
    if "|" in rx or "(?" in rx or "\\Q" in rx:
        return set()

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(rx):
        ch, width, literal = rx[i], 1, None
        if ch == "\\":
            if i + 1 == len(rx):
                return set()
            width = 2
            if rx[i + 1].isalnum():  # a class, a boundary, or a code that may take more characters
                if rx[i + 1] not in "dDwWsSbB":
                    return set()
            else:
                literal = rx[i + 1]
        elif ch == "[":
            end()
            close = rx.find("]", i + 2 + (rx[i + 1:i + 2] == "^"))
            if close < 0 or "[" in rx[i + 1:close] or "\\" in rx[i:close + 1]:
                return set()
            width = close + 1 - i
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "^" and i == 0:
            literal = FIRST
        elif ch == "$" and i == len(rx) - 1:
            literal = LAST
        elif ch in "*+?{":
            return set()  # nothing to repeat
        elif ch not in ".^$":
            literal = ch
        i += width
        follows = rx[i] if i < len(rx) else ""
        if follows in ("*", "?", "+", "{") and follows:
            close = rx.find("}", i) if follows == "{" else i
            if close < 0:
                return set()
            if follows == "+" and literal and not depth:
                run += literal
            i = close + 1
            while i < len(rx) and rx[i] in "?+":  # lazy or possessive
                i += 1
            end()
        elif literal is None or depth:
            end()
        else:
            run += literal
    end()
    return {r[k:k + 3] for r in runs for k in range(len(r) - 2)}


class TextIndex:
    """Reads an index of ``write_index``. Words are flattened as tokens are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.buckets = _read(spark, path, "settings").first()["buckets"]

    def _table(self, name: str, field: str) -> DataFrame:
        return _read(self.spark, self.path, name).where(F.col("field") == field)

    def dictionary(self, field: str | None = None) -> DataFrame:
        """FTS2: field, term, n_docs, n_occ, n_blocks, as stored."""
        d = _read(self.spark, self.path, "dictionary").drop("bucket")
        return d if field is None else d.where(F.col("field") == field)

    def _at(self, name: str, field: str, words: list[str], column: str = "term") -> DataFrame:
        """Rows of some terms (of a query, so few): their folders, and there by the term."""
        w = F.array(*[F.lit(x) for x in words])
        folders = [r[0] for r in self.spark.range(1).select(F.explode(F.transform(w, lambda x: _bucket(x, self.buckets)))).distinct().collect()]
        return self._table(name, field).where(F.col("bucket").isin(folders) & F.col(column).isin(words))

    def frequencies(self, terms: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Number of documents of each (field, flattened word) of a query."""
        out = {}
        for field in {f for f, _ in terms}:
            words = sorted({w for f, w in terms if f == field})
            out |= {(field, r["term"]): r["n_docs"] for r in self._at("dictionary", field, words).collect()}
        return {t: out.get(t, 0) for t in terms}

    def _rows(self, field: str, word: str) -> DataFrame:
        return self._at("postings", field, [word])

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "doc_id long")

    def _docs(self, field: str, word: str) -> DataFrame:
        return self._rows(field, word).select(F.explode("docs").alias("doc_id"))

    def match(self, terms: list[tuple[str, str]], op: str = "and", exclude: list[tuple[str, str]] | None = None) -> DataFrame:
        """FTS3: documents with all or any of the (field, word) terms, without those that have an excluded one.

        For all, blocks are met from the rarest term on, by the dictionary; a block that one term lacks is dropped, and document
        lists of a block are intersected as arrays. Positions aren't read.
        """
        if op not in ("and", "or"):
            raise ValueError("op is 'and' or 'or'")
        wanted = list(dict.fromkeys((f, flatten_py(w)) for f, w in terms))
        if op == "or":
            hits = reduce(DataFrame.union, [self._docs(*t) for t in wanted]).distinct() if wanted else self._none()
        else:
            found = self.frequencies(wanted)
            if not wanted or not all(found.values()):
                return self._none()
            both = None
            for t in sorted(wanted, key=lambda t: found[t]):
                rows = self._rows(*t).select("block", F.col("docs").alias("_d"))
                both = rows.withColumnRenamed("_d", "docs") if both is None else (
                    both.join(rows, "block").select("block", F.array_intersect("docs", "_d").alias("docs")).where(F.size("docs") > 0))
            hits = both.select(F.explode("docs").alias("doc_id"))
        for f, w in exclude or []:
            hits = hits.join(self._docs(f, flatten_py(w)), "doc_id", "left_anti")
        return hits

    def match_phrase(self, field: str, words: str) -> DataFrame:
        """FTS4: documents where the words stand one after the other.

        Blocks that hold all words are found without positions; positions are read of those only, from the rarest word on.
        """
        ws = words_of(words)
        found = self.frequencies([(field, w) for w in ws])
        if not ws or not all(found.values()):
            return self._none()
        shared = None
        for w in sorted(set(ws), key=lambda w: found[field, w]):
            rows = self._rows(field, w).select("block")
            shared = rows if shared is None else shared.join(rows, "block", "left_semi")
        hits = None
        for k, w in sorted(enumerate(ws), key=lambda kw: found[field, kw[1]]):
            rows = self._rows(field, w).join(shared, "block", "left_semi").select(F.explode(F.arrays_zip("docs", "pos")).alias("e"))
            step = rows.select(F.col("e.docs").alias("doc_id"), F.transform("e.pos", lambda p: p - k).alias("_s"))  # noqa: B023
            hits = step.withColumnRenamed("_s", "starts") if hits is None else (
                hits.join(step, "doc_id").select("doc_id", F.array_intersect("starts", "_s").alias("starts")).where(F.size("starts") > 0))
        return hits.select("doc_id")

    def terms_like(self, field: str, rx: str) -> DataFrame:
        """Terms that the regular expression finds: those with all trigrams it requires, each then tried; without
        any required, the whole dictionary of the field is tried."""
        grams = sorted(required_trigrams(rx))
        if grams:
            some = (self._at("trigrams", field, grams, "gram").groupBy("term").agg(F.count("*").alias("n"))
                    .where(F.col("n") == len(grams)).select("term"))
        else:
            some = self._table("dictionary", field).select("term")
        return some.where(F.col("term").rlike(rx))

    def match_regex(self, field: str, rx: str) -> DataFrame:
        """FTS5: documents with a term that the regular expression finds, and the number of such terms."""
        terms = self.terms_like(field, rx).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        rows = self._table("postings", field).select("bucket", "term", "docs").join(terms, ["bucket", "term"], "left_semi")
        return rows.select(F.explode("docs").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_terms"))

    def match_prefix(self, field: str, prefix: str) -> DataFrame:
        """FTS5 prefix form: terms of the stored dictionary that begin so, then their documents."""
        terms = self._table("dictionary", field).where(F.col("term").startswith(flatten_py(prefix.rstrip("*")))).select("bucket", "term")
        rows = self._table("postings", field).select("bucket", "term", "docs").join(terms, ["bucket", "term"], "left_semi")
        return rows.select(F.explode("docs").alias("doc_id")).distinct()
