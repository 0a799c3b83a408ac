"""MIME part queries over line items as parts of orders (PRT1-PRT10, AGG19-21, FLT29, FN35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parts as PT
from ..sources import tables as T
from .catalog import query
from .sqlviews import PARTS_LINEITEM

_ATTACH = "coalesce((NOT mime_type IN ('text/plain', 'text/html')) OR lower(disposition) = 'attachment', false)"
_NAME = r"regexp_replace(filename, '[\p{Cc}/:;]', '-', 'g')"
_ORDER = "part_index, cid, filename, size"


def _parts(spark, sf):
    return T.parts_from_lineitem(spark, sf)


@query("parts_list", sql=f"""
SELECT doc_id, part_index, {_NAME} AS name, mime_type, disposition, size FROM {PARTS_LINEITEM} p""")
def parts_list(spark, sf):
    return PT.list_parts(_parts(spark, sf))


@query("parts_by_name", sql=f"""
SELECT 'name' AS how, doc_id, part_index, filename FROM {PARTS_LINEITEM} p
  WHERE regexp_matches(coalesce(filename, ''), '(?i)^(?:red.*|small gizmo)$')
UNION ALL SELECT 'index', doc_id, part_index, filename FROM {PARTS_LINEITEM} q WHERE part_index IN (6, 7)""")
def parts_by_name(spark, sf):
    p = _parts(spark, sf)
    a = PT.select_by_name(p, "red.*|Small Gizmo").select(F.lit("name").alias("how"), "doc_id", "part_index", "filename")
    b = PT.select_by_index(p, [6, 7]).select(F.lit("index").alias("how"), "doc_id", "part_index", "filename")
    return a.unionByName(b)


@query("parts_attach", sql=f"""
SELECT doc_id, part_index, mime_type, disposition FROM {PARTS_LINEITEM} p WHERE {_ATTACH}""")
def parts_attach(spark, sf):
    return PT.select_attachments(_parts(spark, sf)).select("doc_id", "part_index", "mime_type", "disposition")


@query("mime_counts", sql=f"""
SELECT mime_type, CAST(count(*) AS BIGINT) AS n_parts, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_msgs
FROM {PARTS_LINEITEM} p GROUP BY mime_type""")
def mime_counts(spark, sf):
    return PT.mime_counts(_parts(spark, sf))


@query("body_concat", sql=f"""
SELECT doc_id,
  coalesce(string_agg(filename, chr(10) ORDER BY {_ORDER}) FILTER (WHERE mime_type = 'text/plain'), '') AS body_text,
  coalesce(string_agg(filename, chr(10) ORDER BY {_ORDER}) FILTER (WHERE mime_type = 'text/html'), '') AS body_html
FROM {PARTS_LINEITEM} p WHERE NOT {_ATTACH} GROUP BY doc_id""")
def body_concat(spark, sf):
    return PT.body_concat(_parts(spark, sf))


@query("attach_list", sql=f"""
SELECT doc_id, string_agg('''' || {_NAME} || '''', ', ' ORDER BY {_ORDER}) AS attachments
FROM {PARTS_LINEITEM} p WHERE {_ATTACH} GROUP BY doc_id""")
def attach_list(spark, sf):
    return PT.attachment_list(_parts(spark, sf))


@query("part_cid", sql=f"""
SELECT doc_id, part_index, filename FROM {PARTS_LINEITEM} p WHERE cid = 'part42'""")
def part_cid(spark, sf):
    return PT.part_by_cid(_parts(spark, sf), "<part42>").select("doc_id", "part_index", "filename")


@query("part_flags", sql=f"""
SELECT doc_id, bool_or({_ATTACH}) AS has_attach, false AS signed, false AS encrypted
FROM {PARTS_LINEITEM} p GROUP BY doc_id""")
def part_flags(spark, sf):
    return PT.message_flags_from_parts(_parts(spark, sf))


# item 1 of an order stands for the multipart that holds the others, item 2 for its signature
_TYPED = f"""(SELECT doc_id, disposition, CASE WHEN part_index = 1 AND disposition = 'attachment' THEN 'multipart/signed'
  WHEN part_index = 1 AND disposition = 'inline' THEN 'multipart/encrypted' WHEN part_index = 2 THEN 'application/pgp-signature'
  WHEN part_index = 3 THEN 'image/' || subtype ELSE mime_type END AS mime_type, part_index FROM {PARTS_LINEITEM} p)"""


@query("part_content_flags", sql=f"""
SELECT doc_id, bool_or(coalesce(part_index > 1 AND disposition = 'attachment' OR disposition IS NOT NULL AND part_index <> 2
  AND regexp_matches(mime_type, '^(image|audio|application|text)/') AND mime_type NOT IN ('text/plain', 'text/html'), false)) AS has_attach,
  bool_or(mime_type = 'multipart/signed') AS signed, bool_or(mime_type = 'multipart/encrypted') AS encrypted FROM {_TYPED} t GROUP BY doc_id""")
def part_content_flags(spark, sf):
    p = _parts(spark, sf)
    first, disp = F.col("part_index") == 1, F.col("disposition")
    typed = (F.when(first & (disp == "attachment"), "multipart/signed").when(first & (disp == "inline"), "multipart/encrypted")
             .when(F.col("part_index") == 2, "application/pgp-signature").when(F.col("part_index") == 3, F.concat(F.lit("image/"), "subtype"))
             .otherwise(F.col("mime_type")))
    # a multipart isn't a part of its own: it has no disposition
    return PT.content_flags_from_parts(p.withColumns({"mime_type": typed, "disposition": F.when(~typed.startswith("multipart/"), disp)}))
