"""Sorting, limits and set operations (ORD1-ORD4, SET1-SET5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import subject_normalize
from ..schema import field_column


def sort_by(res: DataFrame, field: str = "date", desc: bool = False) -> DataFrame:
    """ORD1: by a field (name or shortcut), doc_id breaks ties."""
    try:
        c = F.col(field_column(field))
    except KeyError:
        c = F.col(field)
    return res.orderBy(c.desc() if desc else c.asc(), F.col("doc_id").asc())


def limit(res: DataFrame, n: int) -> DataFrame:
    """ORD2: n <= 0 means all."""
    return res if n <= 0 else res.limit(n)


def top_k(res: DataFrame, n: int, field: str = "date", desc: bool = True) -> DataFrame:
    """ORD3: ORD1 + ORD2 (planned as TakeOrderedAndProject: per-task top n, then merge)."""
    return limit(sort_by(res, field, desc), n)


def collation_key(subject: Column | str) -> Column:
    """ORD4: case-blind subject without Re:/Fwd: prefixes."""
    s = F.col(subject) if isinstance(subject, str) else subject
    return F.lower(subject_normalize(s))


def collated_sort(res: DataFrame, subject: str = "subject") -> DataFrame:
    return res.orderBy(collation_key(subject), F.col("doc_id"))


def union_docs(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """SET1: each doc once."""
    return a.unionByName(b).dropDuplicates([key])


def intersect_docs(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """SET2."""
    return a.join(b.select(key), key, "left_semi")


def except_docs(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """SET3."""
    return a.join(b.select(key), key, "left_anti")


def xor_docs(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """SET4: symmetric difference."""
    return except_docs(a, b, key).unionByName(except_docs(b, a, key))


def merge_refs(references: Column | str, in_reply_to: Column | str) -> Column:
    """SET5: References then In-Reply-To, no repeats, order kept."""
    r = F.col(references) if isinstance(references, str) else references
    i = F.col(in_reply_to) if isinstance(in_reply_to, str) else in_reply_to
    return F.array_distinct(F.concat(F.coalesce(r, F.array().cast("array<string>")),
                                     F.coalesce(i, F.array().cast("array<string>"))))
