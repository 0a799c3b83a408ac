"""Duplicates (DUP1-DUP4, WIN1).

"First copy" is the lowest doc_id. The first copy per key is found with a
partial aggregation (map-side combine, so a hot key costs one row per task) and
joined back; AQE's skew-join handling splits a hot key on the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import ranked


def dup_key(msgid: str = "msgid", path: str = "path"):
    return F.coalesce(F.col(msgid), F.col(path))


def flag_duplicates(res: DataFrame, key=None, out: str = "is_dup") -> DataFrame:
    """DUP1: mark every row but the lowest doc_id of its message id as a duplicate."""
    key = key if key is not None else dup_key()
    k = res.withColumn("_dk", key)
    first = k.groupBy("_dk").agg(F.min("doc_id").alias("_first"))
    return (k.join(first, "_dk", "inner")
            .withColumn(out, F.col("doc_id") != F.col("_first")).drop("_dk", "_first"))


def skip_duplicates(res: DataFrame, key=None) -> DataFrame:
    """DUP2: keep the first copy of each message id."""
    return flag_duplicates(res, key).where(~F.col("is_dup")).drop("is_dup")


def dup_ordinal(res: DataFrame, key=None, out: str = "dup_rank") -> DataFrame:
    """WIN1: ordinal of a copy within its message id (1 = first), skew-safe."""
    key = key if key is not None else dup_key()
    return ranked(res.withColumn("_dk", key), [F.col("doc_id")], ["_dk"], out).drop("_dk")


def find_dups(m: DataFrame, content: str = "body_text") -> DataFrame:
    """DUP3: copies share (msgid, size) and then the content hash; first kept, rest marked.

    The hash is computed only for rows of candidate groups (a semi join on the
    groups with more than one row).
    """
    cand = m.groupBy("msgid", "size").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    c = m.join(cand, ["msgid", "size"], "left_semi").withColumn("_h", F.sha2(F.col(content), 256))
    first = c.groupBy("msgid", "size", "_h").agg(F.min("doc_id").alias("_first"))
    return (c.join(first, ["msgid", "size", "_h"], "inner")
            .select("doc_id", "msgid", "size", (F.col("doc_id") != F.col("_first")).alias("is_dup"),
                    F.col("_first").alias("first_doc_id")))


def delete_dups(m: DataFrame, content: str = "body_text") -> DataFrame:
    """DUP4: drop all copies but the first."""
    dups = find_dups(m, content).where("is_dup").select("doc_id")
    return m.join(dups, "doc_id", "left_anti")
