"""MIME parts as a table (PRT1-PRT10, AGG19-AGG21, FLT29, FN35).

A ``parts`` DataFrame has one row per part: doc_id, part_index, mime_type,
size, filename, disposition, cid (and text when parsed from files). Per-message
aggregates group by doc_id; a message's parts are bounded by its size cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.people import clean_filename
from .predicates import is_attachment

_ORDER = ["part_index", "cid", "filename", "size"]


def explode_parts(m: DataFrame, parts_col: str = "parts") -> DataFrame:
    """PRT1: one row per part from a messages table with a parts array."""
    return m.select("doc_id", F.explode(parts_col).alias("p")).select("doc_id", "p.*").withColumnRenamed("index", "part_index")


def with_attachment_flag(p: DataFrame) -> DataFrame:
    return p.withColumn("is_attachment", is_attachment("disposition", "mime_type"))


def list_parts(p: DataFrame) -> DataFrame:
    """PRT2 / PRT9: index, clean name, type, disposition, size."""
    return p.select("doc_id", "part_index", clean_filename("filename", "part_index", "mime_type").alias("name"),
                    "mime_type", "disposition", "size")


def select_by_index(p: DataFrame, indices: list[int]) -> DataFrame:
    """PRT3."""
    return p.where(F.col("part_index").isin(*indices))


def select_by_name(p: DataFrame, filename_rx: str) -> DataFrame:
    """PRT4: case-blind, anchored regex on the file name."""
    return p.where(F.coalesce(F.col("filename"), F.lit("")).rlike(f"(?i)^(?:{filename_rx})$"))


def select_attachments(p: DataFrame, all_leaves: bool = False) -> DataFrame:
    """PRT5: attachments (FLT29), or every part."""
    return p if all_leaves else p.where(is_attachment("disposition", "mime_type"))


def part_by_cid(p: DataFrame, cid: str) -> DataFrame:
    """PRT6: equality on the content id (angle brackets ignored)."""
    return p.where(F.regexp_replace("cid", "^<|>$", "") == F.lit(cid.strip("<>")))


def mime_counts(p: DataFrame) -> DataFrame:
    """PRT7: parts and messages per MIME type."""
    return p.groupBy("mime_type").agg(F.count("*").alias("n_parts"), F.count_distinct("doc_id").alias("n_msgs"))


def _ordered(col: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in _ORDER], col.alias("_v")))),
                       lambda s: s["_v"])


def message_part_columns(p: DataFrame) -> DataFrame:
    """Per message: file names and MIME types in part order (feeds FLT11/FLT12)."""
    return p.groupBy("doc_id").agg(_ordered(F.col("filename")).alias("files"), _ordered(F.col("mime_type")).alias("mimes"))


def body_concat(p: DataFrame, text_col: str = "filename", sep: str = "\n") -> DataFrame:
    """AGG19: non-attachment text/plain parts concatenated in part order; the
    same for text/html."""
    na = p.where(~is_attachment("disposition", "mime_type"))
    return na.groupBy("doc_id").agg(
        F.array_join(_ordered(F.when(F.col("mime_type") == "text/plain", F.col(text_col))), sep).alias("body_text"),
        F.array_join(_ordered(F.when(F.col("mime_type") == "text/html", F.col(text_col))), sep).alias("body_html"))


def attachment_list(p: DataFrame) -> DataFrame:
    """AGG20: quoted attachment names joined with ', ' in part order."""
    a = p.where(is_attachment("disposition", "mime_type"))
    q = F.concat(F.lit("'"), clean_filename("filename", "part_index", "mime_type"), F.lit("'"))
    return a.groupBy("doc_id").agg(F.array_join(_ordered(q), ", ").alias("attachments"))


def message_flags_from_parts(p: DataFrame) -> DataFrame:
    """AGG21: attach / signed / encrypted when any part qualifies."""
    mt = F.lower("mime_type")
    return p.groupBy("doc_id").agg(
        F.bool_or(is_attachment("disposition", "mime_type")).alias("has_attach"),
        F.bool_or(mt.isin("application/pgp-signature", "application/pkcs7-signature", "multipart/signed")).alias("signed"),
        F.bool_or(mt.isin("application/pgp-encrypted", "application/pkcs7-mime", "multipart/encrypted")).alias("encrypted"))


def content_flags_from_parts(p: DataFrame) -> DataFrame:
    """AGG21 by disposition, as the parse sets the flags: a part counts as attached if it says so, or has another disposition and
    is an image, audio, application or text part but no body or signature. Signed and encrypted are multiparts of that type."""
    mt, disp = F.lower("mime_type"), F.lower("disposition")
    kind = mt.rlike("^(image|audio|application|text)/") & ~mt.isin("text/plain", "text/html") & ~F.endswith(mt, F.lit("/pgp-signature"))
    return p.groupBy("doc_id").agg(
        F.bool_or(F.coalesce((disp == "attachment") | (disp.isNotNull() & kind), F.lit(False))).alias("has_attach"),
        F.bool_or(mt == "multipart/signed").alias("signed"), F.bool_or(mt == "multipart/encrypted").alias("encrypted"))
