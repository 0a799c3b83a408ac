"""User-function surface (UDF1-UDF9): Arrow-batched pandas UDFs and
per-partition functions; no driver loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def user_predicate(fn: Callable[[pd.Series], pd.Series]) -> Callable[..., Column]:
    """UDF1: a vectorised Python predicate usable as a search/hide/mark selection."""
    return F.pandas_udf(fn, T.BooleanType())


def user_column(fn: Callable[..., pd.Series], return_type: T.DataType | str) -> Callable[..., Column]:
    """UDF2/UDF3: a vectorised Python column (custom header column, tabulate key)."""
    return F.pandas_udf(fn, return_type)


def contact_rewriter(fn: Callable[[str], str | None]) -> Callable[..., Column]:
    """UDF4: per-address rewrite; None drops the contact (use with process_contacts)."""
    @F.pandas_udf(T.StringType())
    def rewrite(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))
    return rewrite


def rewrite_chain(c: Column, *fns: Callable[[Column], Column]) -> Column:
    """UDF5: body rewrite chain as a fold of Column functions."""
    return reduce(lambda acc, f: f(acc), fns, c)


def for_each_message(m: DataFrame, fn: Callable[[dict], dict | None], schema: T.StructType | str,
                     expr: Column | None = None) -> DataFrame:
    """UDF6/UDF8: a Python function per message, run on the executors batch by
    batch (mapInPandas); rows for which it returns None are dropped."""
    src = m.where(expr) if expr is not None else m
    out_schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = [f.name for f in out_schema.fields]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for r in (fn(rec) for rec in pdf.to_dict("records")) if r is not None]
            yield pd.DataFrame(rows, columns=names)
    return src.mapInPandas(run, out_schema)


exec_per_match = for_each_message


def for_each_contact(c: DataFrame, proc: Callable[[dict], dict | None], schema: T.StructType | str) -> DataFrame:
    """UDF7: a function per contact (contacts from operators.contacts)."""
    return for_each_message(c, proc, schema)


@F.udtf(returnType="pos: int, token: string")
class TokenTable:
    """UDF9 on one row at a time, for a lateral join: message text -> (pos, token) rows. ``MessageTokens`` takes whole batches."""

    def eval(self, text: str | None):
        import regex
        if text is None:
            return
        pos = 0
        for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()):
            if t:
                yield pos, t
                pos += 1


#: bytes of text that a table function splits at once
SLICE_BYTES = 1_000_000


def _slices(rows: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of up to SLICE_BYTES of text, or of one row, so that memory follows the slice."""
    ends = np.cumsum(pc.binary_length(rows.column(column).cast(pa.string())).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < rows.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield rows.slice(at, stop - at)
        at = stop


def _owners(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(row, place in its list) of each element; null lists have none."""
    owner = pc.list_parent_indices(lists)
    at = owner.to_numpy(zero_copy_only=False)
    return owner, np.arange(len(at)) - np.searchsorted(at, at)


def _flat(rows: pa.RecordBatch, lists: str, fields: dict[str, pa.DataType]) -> pa.Table:
    """doc_id and some fields of each struct in a list column."""
    column = rows.column(lists)
    owner, _ = _owners(column)
    elements = column.flatten()
    return pa.table({"doc_id": rows.column("doc_id").take(owner).cast(pa.int64())} | {
        name: pc.struct_field(elements, name).cast(kind) for name, kind in fields.items()})


# UDF9: table functions over a table argument, e.g. MessageTokens(m.select("doc_id", "text").asTable()). Each call gets an Arrow batch of
# rows and returns one of any size; nothing is shuffled and no row is a Python object. Other columns of the table don't matter.

@F.arrow_udtf(returnType="doc_id: bigint, pos: int, token: string")
class MessageTokens:
    """(doc_id, text) -> a row per word: runs of letters and digits, lower-cased, numbered from 0. Null texts have none."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        for part in _slices(rows, "text"):
            yield self._words(part)

    def _words(self, rows: pa.RecordBatch) -> pa.Table:
        split = pc.split_pattern_regex(pc.utf8_lower(rows.column("text").cast(pa.string())), r"[^\p{L}\p{N}]+")
        owner, _ = _owners(split)
        words = split.flatten()
        some = pc.not_equal(words, "")  # before the first word, after the last
        owner, words = owner.filter(some), words.filter(some)
        at = owner.to_numpy(zero_copy_only=False)
        return pa.table({"doc_id": rows.column("doc_id").take(owner).cast(pa.int64()),
                         "pos": pa.array((np.arange(len(at)) - np.searchsorted(at, at)).astype(np.int32)), "token": words.cast(pa.string())})


@F.arrow_udtf(returnType="doc_id: bigint, type: string, name: string, email: string")
class MessageContacts:
    """(doc_id, contacts) -> a row per contact, in order."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        yield _flat(rows, "contacts", {"type": pa.string(), "name": pa.string(), "email": pa.string()})


@F.arrow_udtf(returnType="doc_id: bigint, index: int, mime_type: string, size: bigint, disposition: string, filename: string")
class MessageParts:
    """(doc_id, parts) -> a row per part, in order."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        yield _flat(rows, "parts", {"index": pa.int32(), "mime_type": pa.string(), "size": pa.int64(), "disposition": pa.string(), "filename": pa.string()})
