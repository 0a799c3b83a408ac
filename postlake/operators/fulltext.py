"""Full-text tables (FTS1-FTS5): postings, dictionary, term/phrase/regex match.

The postings table is the user-level form of an inverted index:
(doc_id, field, term, pos). Written partitioned by field it prunes by field;
matches are semi joins, phrases equi joins on (doc_id, pos - i).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import flatten_py, tokens
from ..session import scratch_path
from .predicates import words_of

#: bytes of a row group of tokens on their way to the index
TOKEN_BLOCK = 2 << 20
#: token rows that a task sorts, on average, and bytes of token files that a task reads
TASK_ROWS, TASK_BYTES = 2_000_000, 16 << 20


def build_postings(m: DataFrame, fields: dict[str, str] | list[str]) -> DataFrame:
    """FTS1: one row per token occurrence; ``fields`` maps field name -> column. ``last`` marks the last of a text."""
    if isinstance(fields, list):
        fields = {f: f for f in fields}
    parts = [m.select("doc_id", F.lit(name).alias("field"), tokens(col).alias("_t"))
             .select("doc_id", "field", F.size("_t").alias("_n"), F.posexplode("_t").alias("pos", "term"))
             for name, col in fields.items()]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("doc_id", "field", "term", F.col("pos").cast("bigint").alias("pos"), (F.col("pos") == F.col("_n") - 1).alias("last"))


@contextmanager
def _small_reads(spark: SparkSession, most: int) -> Iterator[None]:
    """Files are read in parts of up to ``most`` bytes by what runs inside; then the session's own setting holds again."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_postings(postings: DataFrame, path: str, num_partitions: int | None = None) -> None:
    """Store postings as the index table: partitioned by field, dealt by range of
    (field, term, doc_id) and sorted inside each file, so a term lookup reads only the row groups
    whose min/max cover it, and a stop word's postings are spread over many tasks. Tokens are written
    first, in row groups small enough to be read by many tasks, so that sampling the ranges doesn't split the texts a
    second time and a table of few files is dealt in parallel. Unless given, the number of ranges follows that of the tokens, so that
    a task sorts its own in memory. ``first`` marks the first place of a term in a document; all its places lie in one range."""
    spark = postings.sparkSession
    tokens_path = scratch_path(spark, "tokens")
    postings.write.option("parquet.block.size", TOKEN_BLOCK).parquet(tokens_path)
    words = spark.read.schema(postings.schema).parquet(tokens_path)
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // TASK_ROWS))
    place = F.row_number().over(Window.partitionBy("field", "term", "doc_id").orderBy("pos"))
    with _small_reads(spark, TASK_BYTES):
        (words.repartitionByRange(n, "field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id", "pos").withColumn("first", place == 1)
         .write.mode("overwrite").partitionBy("field").parquet(path))


def term_dictionary(postings: DataFrame, field: str | None = None) -> DataFrame:
    """FTS2: distinct terms with document and occurrence counts. Stored postings say where a term is first in its document, so one
    sum per term counts the documents, and a task holds its distinct terms alone; other postings are made distinct by document."""
    p = postings.where(F.col("field") == field) if field else postings
    n_docs = F.count_if(F.col("first") & F.col("doc_id").isNotNull()) if "first" in p.columns else F.count_distinct("doc_id")
    return p.groupBy("field", "term").agg(n_docs.alias("n_docs"), F.count("*").alias("n_occ"))


def _docs_with(postings: DataFrame, field: str, word: str) -> DataFrame:
    return postings.where((F.col("field") == field) & (F.col("term") == flatten_py(word))).select("doc_id").distinct()


def match_terms(postings: DataFrame, terms: list[tuple[str, str]], op: str = "and",
                exclude: list[tuple[str, str]] | None = None) -> DataFrame:
    """FTS3: documents with all (and) / any (or) of the (field, word) terms,
    minus documents with any excluded term."""
    sets = [_docs_with(postings, f, w) for f, w in terms]
    if op == "and":
        res = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets)
    elif op == "or":
        res = reduce(lambda a, b: a.unionByName(b), sets).distinct()
    else:
        raise ValueError("op is 'and' or 'or'")
    for f, w in exclude or []:
        res = res.join(_docs_with(postings, f, w), "doc_id", "left_anti")
    return res


def match_phrase(postings: DataFrame, field: str, words: str) -> DataFrame:
    """FTS4: documents where the words occur at consecutive positions."""
    ws = words_of(words)
    p = postings.where(F.col("field") == field)
    if not ws:
        return p.where(F.lit(False)).select("doc_id")
    hits = None
    for i, w in enumerate(ws):
        step = p.where(F.col("term") == w).select("doc_id", (F.col("pos") - i).alias("start"))
        hits = step if hits is None else hits.join(step, ["doc_id", "start"], "inner")
    return hits.select("doc_id").distinct()


def match_regex(postings: DataFrame, field: str, rx: str) -> DataFrame:
    """FTS5: expand the regex over the dictionary, then documents with any match
    (semi join of postings on the matching terms)."""
    p = postings.where(F.col("field") == field)
    terms = p.select("term").distinct().where(F.col("term").rlike(rx))
    return p.join(terms, "term", "left_semi").groupBy("doc_id").agg(F.count_distinct("term").alias("n_terms"))


def match_prefix(postings: DataFrame, field: str, prefix: str) -> DataFrame:
    """FTS5 prefix form: StartsWith on the term (pushed to a Parquet postings scan)."""
    p = postings.where((F.col("field") == field) & F.col("term").startswith(flatten_py(prefix.rstrip("*"))))
    return p.select("doc_id").distinct()
