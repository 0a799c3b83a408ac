"""How far the sources of a language differ in their use of words.

Exact counts come from Spark ML's CountVectorizer. Tasks count their documents beforehand and give out bags of distinct terms; the
vectorizer is fitted on those and gives a sparse vector of each, and these are summed by language and source, by the task and then over
tasks in rows of a range of indices. Pairs of
sources are compared in cells of a block of terms and two blocks of sources; terms that neither holds add a closed form.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored
from .words import LOWER as BYTES
from .words import slices, text_bytes

#: fixed values: what counts as a term, after A-Z are lower-cased, and its bytes
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_IN_TERM = np.ones(256, bool)
_IN_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: fixed values: what p is scaled by, and what is added to each count
SCALE, PRIOR = 1_000_000_000, 5
#: distinct terms of a vectorizer, terms and sources of a cell, on average
VOCABULARY, TERMS, SOURCES = 4_000_000, 4096, 256
#: sums that a task holds, different terms of groups that it counts before they go to bags, and terms of a bag
SUMMED, COUNTED, BAG = 2_000_000, 300_000, 20_000
#: indices of a row of sums, least number of bags for the terms that some task has met in enough documents
RUN, ENOUGH = 256, 64

CELL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("value", pa.int64())])


def term_lists(texts: pa.Array) -> pa.ListArray:
    """The terms of each text."""
    data, offsets = text_bytes(texts)
    data = BYTES[data]
    inside = _IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1]) if len(data) else inside
    start = np.flatnonzero(first)
    spell = data[inside]
    at = np.concatenate([np.flatnonzero(first[inside]), [len(spell)]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(spell)).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, offsets).astype(np.int32)), words)


def marked(langs: pa.Array, terms: pa.Array) -> pa.Array:
    """The terms, each behind its language and U+0000, which no term holds."""
    return pc.binary_join_element_wise(langs, terms, "\0")


def bag_rows(langs: pa.Array, sources: pa.Array, bags: pa.Array, weights: np.ndarray) -> pa.RecordBatch:
    """Bags of a language and source; of none, those that count documents."""
    none = pa.nulls(len(bags), bags.type)
    both = [none, bags] if not langs.null_count else [bags, none]
    return pa.RecordBatch.from_arrays([langs, sources, *both, pa.array(weights)], ["lang", "source", "terms", "bag", "weight"])


class Bags:
    """Counts of terms by (language, source), or by none, given out as bags of distinct terms with a weight: a term that occurs n times is in
    the bag of each power of two that n is made of, so bags give n exactly."""

    def __init__(self, enough: int | None = None):
        self.codes: dict[tuple, int] = {}
        self.held: list[pa.Table] = []
        self.n_held = self.n_merged = 0
        self.enough = enough  # counts from here on go as the next power of two, if no more need be known of them

    def add(self, groups: np.ndarray, terms: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(pa.table({"group": pa.array(groups), "term": terms, "n": pa.array(counts)}))
        self.n_held += len(terms)
        if self.n_held > 2 * self.n_merged + COUNTED // 2:
            self._merge()
            if self.n_held > COUNTED:
                yield from self.flush()

    def _merge(self) -> None:
        """Leaves one table, with a row per group and term, by group."""
        if self.n_held == self.n_merged:
            return
        rows = pa.concat_tables(self.held).combine_chunks()
        words = rows.column("term").combine_chunks().dictionary_encode()
        many = max(len(words.dictionary), 1)
        key = rows.column("group").to_numpy() * many + words.indices.to_numpy()
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
        group, code = np.divmod(key[first], many)
        n = np.add.reduceat(rows.column("n").to_numpy()[order], first) if len(first) else key
        self.held = [pa.table({"group": pa.array(group), "term": words.dictionary.take(pa.array(code)), "n": pa.array(n)})]
        self.n_held = self.n_merged = len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._merge()
        rows = self.held[0]
        self.held, self.n_held, self.n_merged = [], 0, 0
        group, n, terms = rows.column("group").to_numpy(), rows.column("n").to_numpy(), rows.column("term").combine_chunks()
        if self.enough is not None:
            n = np.where(n < self.enough, n, 1 << (self.enough - 1).bit_length())
        names = list(self.codes)
        for bit in range(int(n.max(initial=0)).bit_length()):
            on = np.flatnonzero(n >> bit & 1)
            first = np.flatnonzero(np.r_[len(on) > 0, group[on][1:] != group[on][:-1]])
            cuts = np.unique(np.r_[first, np.arange(0, len(on), BAG), len(on)])
            own = group[on][cuts[:-1]]
            bags = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), terms.take(pa.array(on)))
            yield bag_rows(*(pa.array([names[g][k] for g in own], pa.string()) for k in (0, 1)), bags, np.full(len(own), 1 << bit))


def term_arrays(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int | None = None) -> DataFrame:
    """What the tasks have counted, as bags of distinct terms: (terms, weight) counts the documents of a term, (lang, source, bag, weight)
    its occurrences, as sums of the weights of the bags that hold it. Each language and source has a bag, which may be empty.
    A task that counts ``min_docs`` documents of a term or more says so with one weight of that size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places = Bags(min_docs), Bags()
        held.codes = {(None, None): 0}
        for batch in batches:
            for part in slices(batch):
                lang, source = part.column("lang").cast(pa.string()), part.column("source").cast(pa.string())
                group = np.array([places.codes.setdefault(p, len(places.codes)) for p in zip(lang.to_pylist(), source.to_pylist())], np.int64)
                tongue = lang.dictionary_encode()
                lists = term_lists(part.column("text"))
                words = lists.flatten().dictionary_encode()
                code, many = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                key, n = np.unique(group[doc] * many + code, return_counts=True)
                own, at = np.divmod(key, many)
                langs = pa.array([p[0] for p in places.codes], pa.string())
                yield from places.add(own, marked(langs.take(pa.array(own)), words.dictionary.take(pa.array(at))), n)
                doc, at = np.divmod(np.unique(doc * many + code, return_counts=True)[0], many)  # with counts it sorts, which is faster
                key, n = np.unique(tongue.indices.to_numpy()[doc].astype(np.int64) * many + at, return_counts=True)
                own, at = np.divmod(key, many)
                yield from held.add(np.zeros(len(n), np.int64), marked(tongue.dictionary.take(pa.array(own)), words.dictionary.take(pa.array(at))), n)
        yield from held.flush()
        yield from places.flush()
        if places.codes:
            langs, sources = (pa.array([p[k] for p in places.codes], pa.string()) for k in (0, 1))
            yield bag_rows(langs, sources, pa.array([[]] * len(langs), pa.list_(pa.string())), np.ones(len(langs), np.int64))

    named = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "lang string, source string, terms array<string>, bag array<string>, weight long")


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of some (keys, counts), sorted, and the sum of each."""
    keys, counts = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


def summed(batches: Iterator[pa.RecordBatch], n_terms: int, run: int = 0) -> Iterator[pa.RecordBatch]:
    """(lang, source, index, count): sums of the sparse vectors of each group, each as often as its ``weight`` says (once without one), held
    by the task up to ``SUMMED`` entries. With ``run``, (lang, source, part, index, count) with lists: part k has the entries of a group
    whose index divided by ``run`` is k."""
    codes: dict[tuple, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(held)
        names = list(codes)
        for k in range(0, len(keys), 100_000):
            some, group = keys[k:k + 100_000], keys[k:k + 100_000] // n_terms
            columns, labels = [pa.array((some % n_terms).astype(np.int32)), pa.array(counts[k:k + 100_000])], ["index", "count"]
            if run:
                part = some % n_terms // run
                first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])])
                cuts = pa.array(np.r_[first, len(some)].astype(np.int32))
                columns = [pa.array(part[first].astype(np.int32)), *(pa.ListArray.from_arrays(cuts, c) for c in columns)]
                group, labels = group[first], ["part", *labels]
            yield pa.RecordBatch.from_arrays([*(pa.array([n[j] for n in names], pa.string()).take(pa.array(group)) for j in (0, 1)), *columns], ["lang", "source", *labels])

    for batch in batches:
        pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
        group = np.array([codes.setdefault(p, len(codes)) for p in pairs], np.int64)
        lists = batch.column("indices")
        size = np.diff(lists.offsets.to_numpy())
        index = lists.flatten().to_numpy().astype(np.int64)
        if len(index):
            weight = batch.column("weight").to_numpy() if "weight" in batch.schema.names else np.ones(len(size), np.int64)
            held = [*held, (np.repeat(group, size) * n_terms + index, batch.column("values").flatten().to_numpy().astype(np.int64) * np.repeat(weight, size))]
            held = [_merged(held)]
            if len(held[0][0]) > SUMMED:
                yield from flush()
                held = []
    if held:
        yield from flush()


def added(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, index, count) of rows of ``summed`` with lists, which come sorted by (lang, source, part): counts of an index are added.
    The task holds a batch and the rows of one part."""
    last: pa.Table | None = None

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple, int] = {}
        group = np.array([codes.setdefault(p, len(codes)) for p in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())], np.int64)
        lists = rows.column("index").combine_chunks()
        keys, counts = _merged([(np.repeat(group, np.diff(lists.offsets.to_numpy())) * n_terms + lists.flatten().to_numpy(), rows.column("count").combine_chunks().flatten().to_numpy())])
        for k in range(0, len(keys), 100_000):
            group, index = np.divmod(keys[k:k + 100_000], n_terms)
            yield pa.RecordBatch.from_arrays([*(pa.array([c[j] for c in codes], pa.string()).take(pa.array(group)) for j in (0, 1)),
                                              pa.array(index.astype(np.int32)), pa.array(counts[k:k + 100_000])], ["lang", "source", "index", "count"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([last, rows]) if last is not None else rows
        end = [rows.column(c)[-1] for c in ("lang", "source", "part")]
        same = pc.and_(pc.and_(pc.equal(rows.column("lang"), end[0]), pc.equal(rows.column("source"), end[1])), pc.equal(rows.column("part"), end[2]))
        done = rows.num_rows - pc.sum(same).as_py()
        if done:
            yield from out(rows.slice(0, done).combine_chunks())
        last = rows.slice(done)
    if last is not None:
        yield from out(last.combine_chunks())


def group_counts(terms: DataFrame, min_docs: int, vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, source, term, count) of the terms in at least ``min_docs`` documents of their language, for rows of ``term_arrays``.

    CountVectorizer keeps its vocabulary on the driver and sends it to all tasks. So that its size is bounded, terms are dealt by
    hash to as many vectorizers as ``vocabulary`` asks for, by the number of distinct terms; most corpora need one.
    Each takes the largest vocabulary there is, so only ``min_docs`` decides. Its vectors, sparse and exact, are summed by group.
    """
    spark = terms.sparkSession
    # a row of the vectorizer is a document to it; a term in min_docs of them is in enough, so all bags of that weight or more that hold it are
    # so many together
    held = terms.where("terms is not null")
    enough = (held.where(F.col("weight") >= min_docs).select(F.explode("terms").alias("t")).distinct()
              .groupBy(F.pmod(F.xxhash64("t"), F.lit(max(ENOUGH, shuffle_partitions(spark))))).agg(F.collect_list("t").alias("terms")))
    held = held.where(F.col("weight") < min_docs).select("terms", "weight").unionAll(enough.select("terms", F.lit(min_docs).cast("long")))
    docs = held.select("terms", F.explode(F.array_repeat(F.lit(0), F.col("weight").cast("int")))).select("terms")
    bags = terms.where("bag is not null").select("lang", "source", F.col("bag").alias("terms"), "weight")
    distinct = terms.where("terms is not null").select(F.explode("terms").alias("t")).agg(F.approx_count_distinct("t", 0.05)).first()[0]
    shards = -(-int(distinct * 1.2) // vocabulary) or 1
    out = []
    for shard in range(shards):
        own, bag = (x if shards == 1 else x.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(shards)) == shard)) for x in (docs, bags))  # noqa: B023
        # rows of one empty term, which no text holds: a vectorizer without any term can't be fitted
        some = own.unionAll(spark.range(min_docs).select(F.array(F.lit("")).alias("terms")))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=2**31 - 1).fit(some)
        words = model.vocabulary
        names = spark.createDataFrame(pa.table({"index": pa.array(range(len(words)), pa.int32()), "name": pa.array(words, pa.string())}))
        vector = model.transform(bag).select("lang", "source", "weight", F.unwrap_udt("vector").alias("v")).select("lang", "source", "weight", "v.indices", "v.values")
        parts = vector.mapInArrow(lambda b, n=len(words): summed(b, n, RUN), "lang string, source string, part int, index array<int>, count array<long>")
        sums = (parts.repartition(shuffle_partitions(spark), "lang", "source", "part").sortWithinPartitions("lang", "source", "part")
                .mapInArrow(lambda b, n=len(words): added(b, n), "lang string, source string, index int, count long"))
        out.append(stored(sums.join(names, "index").select("lang", "source", F.substring_index("name", "\0", -1).alias("term"), "count"), "terms"))
    return reduce(DataFrame.unionAll, out)


def scaled(count: Column, total: str, n_terms: str) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)), exactly; null where there is no term."""
    wide = lambda c: c.cast("decimal(19, 0)")
    top = F.lit(SCALE).cast("decimal(10, 0)") * (wide(count) + PRIOR)
    low = wide(F.col(total)) + PRIOR * wide(F.col(n_terms))
    return F.call_function("div", top, F.nullif(low, F.lit(0).cast("decimal(19, 0)"))) + 1


def _cell(key: tuple, rows: pa.Table, sides: pa.Table) -> pa.Table:
    """Sums over the cell's terms of how much farther two sources are than on a term that neither holds; in the
    cells of the first block of terms, what all terms would add if no source held them."""
    bucket, first, second = (k.as_py() for k in key[1:])
    held = {r["block"]: (r["sources"], np.array([p or 0 for p in r["bases"]], np.int64), r["v"]) for r in sides.to_pylist()}
    if first not in held or second not in held:
        return CELL.empty_table()
    n = 0
    if rows.num_rows:
        words = rows.column("term").combine_chunks().dictionary_encode()
        terms, n = words.indices.to_numpy(), len(words.dictionary)
    dense = []
    for block in (first, second):
        names, bases, _ = held[block]
        p = np.repeat(bases[:, None], n, axis=1)
        if n:
            at = pc.index_in(rows.column("source").combine_chunks(), pa.array(names, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
            p[at[at >= 0], terms[at >= 0]] = rows.column("p").to_numpy()[at >= 0]
        dense.append((names, bases, p))
    (a, base_a, p_a), (b, base_b, p_b) = dense
    idle = (held[first][2] if bucket == 0 else 0) - n
    out = []
    for k, name in enumerate(a):
        far = np.abs(p_b - p_a[k]).sum(axis=1) + idle * np.abs(base_b - base_a[k])
        on = np.arange(k + 1 if first == second else 0, len(b))
        out.append(pa.table([pa.array([key[0].as_py()] * len(on), pa.string()), pa.array([name] * len(on), pa.string()),
                             pa.array([b[j] for j in on], pa.string()), pa.array(far[on].astype(np.int64))], schema=CELL))
    return pa.concat_tables(out) if out else CELL.empty_table()


def audit_sources(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for each source of each language, part ``pair``: its distance to each other
    source, and part ``term``: the ``top`` terms that it holds and uses more than its language does.

    Terms are matches of ``TERM``; a language keeps those in at least ``min_docs`` of its documents. A group (a source of a
    language, or a language) gives each kept term p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V)): N counts its kept terms, V is
    the number of kept terms. The distance is the sum of differences of p over all kept terms (0 without any), the value of
    a term p less the language's. Ranks go by value, then by item in byte order. All arithmetic is exact.

    Null texts are empty, null languages and sources are ''. A source without terms takes part in pairs. Repeated rows count each
    time. Other columns don't matter. An empty table gives no rows. A term of any length counts.
    """
    spark = docs.sparkSession
    terms = stored(term_arrays(docs, text_col, lang_col, source_col, min_docs), "arrays")
    counts = group_counts(terms, min_docs)
    both = stored(counts.groupBy("lang", "term").agg(F.sum("count").alias("count")), "langs")
    langs = both.groupBy("lang").agg(F.sum("count").alias("_total"), F.count("*").alias("_v"))
    groups = (terms.where("bag is not null").select("lang", "source").distinct().join(langs.select("lang", "_v"), "lang", "left")
              .join(counts.groupBy("lang", "source").agg(F.sum("count").alias("_total")), ["lang", "source"], "left")
              .fillna(0, ["_total", "_v"]))
    groups = stored(groups.withColumn("_base", scaled(F.lit(0), "_total", "_v").cast("long")), "groups")
    own = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", scaled(F.col("count"), "_total", "_v").cast("long").alias("p"))
    own = stored(own, "shares")

    usual = both.join(langs, "lang").select("lang", "term", scaled(F.col("count"), "_total", "_v").cast("long").alias("q"))
    more = own.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    sizes = groups.groupBy("lang").agg(F.count("*").alias("n"), F.max("_v").alias("v")).agg(F.max("n"), F.max("v")).first()
    n_blocks, n_buckets = -(-(sizes[0] or 1) // SOURCES), max(-(-(sizes[1] or 1) // TERMS), min(shuffle_partitions(spark), -(-(sizes[1] or 1) // 64)))
    block = F.pmod(F.xxhash64("source"), F.lit(n_blocks))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    cell = lambda df: (df.withColumn("_y", F.explode(upto(n_blocks)))
                       .withColumns({"first": F.least("block", "_y"), "second": F.greatest("block", "_y")}).drop("_y"))
    rows = cell(own.withColumns({"block": block, "bucket": F.pmod(F.xxhash64("term"), F.lit(n_buckets))}))
    sides = (groups.withColumn("block", block).groupBy("lang", "block")
             .agg(F.collect_list("source").alias("sources"), F.collect_list(F.coalesce("_base", F.lit(0))).alias("bases"), F.max("_v").alias("v")))
    sides = cell(sides.withColumn("bucket", F.explode(upto(n_buckets))))
    key = ["lang", "bucket", "first", "second"]
    far = (rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(_cell, "lang string, source string, other string, value long")
           .groupBy("lang", "source", "other").agg(F.sum("value").alias("value")))
    far = stored(far, "pairs")
    pairs = far.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").unionAll(
        far.select("lang", "other", F.lit("pair"), "source", "value"))
    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (pairs.withColumn("rank", ranks).unionAll(more.withColumn("rank", ranks).where(F.col("rank") <= top))
            .select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))
