"""Header scalars and remaining operator queries (FN25, FN26, FN31, FN32,
SET5, PRJ2, FLT21, FLT28, MUT4, UDF5, UDF7, JN4 in threads, SNK7, SNK8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import people as P
from ..functions import udfs as U
from ..functions.text import remove_ctrl
from ..operators import changes as CH
from ..operators import contacts as C
from ..operators import ordering as O
from ..operators import predicates as Q
from ..operators import projection as PR
from ..operators import threads as TH
from ..sources import tables as T
from .catalog import query
from .sqlviews import CONV_MSGS, OCC_ORDERS, tokens_sql


@query("header_fields", sql=r"""
SELECT doc_id,
  source || '.lists.example.org' AS mailing_list,
  source || '@lists.example.org' AS list_post,
  CASE WHEN lang = 'fr' THEN sha256(text) || '@postlake' ELSE md5(text) END AS msgid,
  array_to_string(list_filter(list_transform(list_concat(string_split_regex(trim(lang || '  ' || source), '\s+'),
     string_split(trim(' x-' || lang || ' ,, y '), ',')), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags
FROM documents""")
def header_fields(spark, sf):
    d = T.read(spark, sf, "documents")
    list_id = F.concat(F.col("source"), F.lit(" <"), F.col("source"), F.lit(".lists.example.org>"))
    post = F.concat(F.lit("<mailto:"), F.col("source"), F.lit("@lists.example.org>"))
    mid = F.when(F.col("lang") != "fr", F.md5("text"))
    tags = P.tags_from_headers(F.concat(F.col("lang"), F.lit("  "), F.col("source")),
                               F.concat(F.lit(" x-"), F.col("lang"), F.lit(" ,, y ")))
    return d.select("doc_id", P.mailing_list(list_id).alias("mailing_list"), P.list_post(post).alias("list_post"),
                    P.msgid_or_hash(mid, "text").alias("msgid"), F.array_join(tags, "|").alias("tags"))


@query("merge_refs", sql=f"""
SELECT doc_id, array_to_string(list_distinct_ordered, ' ') AS refs FROM (
  SELECT doc_id, list_filter(list_concat(refs, CASE WHEN turn > 0 THEN [refs[-1], msgid] ELSE [msgid] END),
    lambda x, i: list_position(list_concat(refs, CASE WHEN turn > 0 THEN [refs[-1], msgid] ELSE [msgid] END), x) = i)
    AS list_distinct_ordered FROM {CONV_MSGS} m)""")
def merge_refs(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    irt = F.when(F.col("turn") > 0, F.array(F.element_at("refs", -1), F.col("msgid"))).otherwise(F.array("msgid"))
    return m.select("doc_id", F.array_join(O.merge_refs("refs", irt), " ").alias("refs"))


@query("headers_only", sql=f"""
SELECT doc_id, msgid, subject, "from" AS from_contacts, "to" AS to_contacts, 0 AS n_cc FROM {CONV_MSGS} m""")
def headers_only(spark, sf):
    h = PR.headers_only(T.msgs_from_conversations(spark, sf))
    name = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return h.select("doc_id", "msgid", "subject", name("from_contacts").alias("from_contacts"),
                    name("to_contacts").alias("to_contacts"), F.size("cc_contacts").alias("n_cc"))


@query("skip_unreadable", sql=f"""
SELECT doc_id FROM {CONV_MSGS} m WHERE list_contains(string_split(lower(body_text), ' '), 'the') AND turn < 4""")
def skip_unreadable(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    res = m.where(F.array_contains(F.split(F.lower("body_text"), " "), "the"))
    listing = m.where(F.col("turn") < 4).select("path")  # files still on disk
    return Q.skip_unreadable(res, listing).select("doc_id")


@query("by_docid", sql=f"SELECT doc_id, msgid FROM {CONV_MSGS} m WHERE doc_id IN (3001, 5000, 7002, 11003)")
def by_docid(spark, sf):
    return Q.by_docid(T.msgs_from_conversations(spark, sf), [3001, 5000, 7002, 11003]).select("doc_id", "msgid")


@query("mark_all_read", sql=f"""
SELECT doc_id, CAST(CASE WHEN ((flags & 64) <> 0 OR (flags & 16) = 0) AND "from" = 'user'
  THEN (flags | 16) & ~(64 | 2048) ELSE flags END AS INTEGER) AS flags FROM {CONV_MSGS} m""")
def mark_all_read(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return CH.mark_all_unread_read(m, F.col("from") == "user").select("doc_id", "flags")


@query("rewrite_chain", sql=r"""
SELECT doc_id, md5(lower(regexp_replace(text, '[\p{Cc} ]+', ' ', 'g'))) AS body_md5 FROM documents""")
def rewrite_chain(spark, sf):
    d = T.read(spark, sf, "documents")
    return d.select("doc_id", F.md5(U.rewrite_chain(F.col("text"), remove_ctrl, F.lower)).alias("body_md5"))


@query("for_each_contact", sql=f"""
SELECT upper(e) AS email, freq * 2 AS double_freq FROM (
  SELECT arg_max(email, {{'d': date, 'i': doc_id}}) AS e, CAST(count(*) AS BIGINT) AS freq FROM {OCC_ORDERS} o GROUP BY lower(email))
WHERE freq > 10""")
def for_each_contact(spark, sf):
    c = C.build_contacts(T.occ_from_orders(spark, sf))
    return U.for_each_contact(c, lambda r: {"email": r["email"].upper(), "double_freq": r["freq"] * 2} if r["freq"] > 10 else None,
                              "email string, double_freq bigint")


@query("thread_dups", sql="""
WITH d AS (SELECT doc_id, md5(text) AS msgid, min(doc_id) OVER (PARTITION BY md5(text)) AS first_doc FROM documents),
w AS (SELECT CAST(ceil(log2(count(*)) / 4.0) AS INTEGER) AS width FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS root_idx FROM d WHERE doc_id = first_doc),
s AS (SELECT doc_id, first_doc, row_number() OVER (PARTITION BY first_doc ORDER BY doc_id) - 1 AS sib FROM d WHERE doc_id <> first_doc)
SELECT d.doc_id,
  lpad(lower(hex(coalesce(r.root_idx, r2.root_idx))), w.width, '0')
    || CASE WHEN s.doc_id IS NULL THEN '' ELSE ':' || lpad(lower(hex(s.sib)), w.width, '0') END AS thread_path,
  s.doc_id IS NOT NULL AS duplicate,
  EXISTS (SELECT 1 FROM s s2 WHERE s2.first_doc = d.doc_id) AS has_child
FROM d CROSS JOIN w LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
LEFT JOIN r r2 ON r2.doc_id = s.first_doc""")
def thread_dups(spark, sf):
    d = T.msgs_from_documents(spark, sf).withColumn("refs", F.array().cast("array<string>"))
    th = TH.build_threads(d)
    return th.select("doc_id", "thread_path", "duplicate", "has_child")


@query("thread_info_struct", sql=f"""
SELECT doc_id, subject, CAST(turn AS BIGINT) AS level, turn = 0 AS is_root FROM {CONV_MSGS} m
WHERE list_contains({tokens_sql('body_text')}, 'und')""")
def thread_info_struct(spark, sf):
    from ..sinks import with_thread_info
    m = T.msgs_from_conversations(spark, sf)
    res = m.where(Q.has_term("body_text", "und")).select("doc_id", "subject")
    from .threadq import threads_table
    out = with_thread_info(res, threads_table(spark, sf, gaps=False))
    return out.select("doc_id", "subject", F.col("thread.thread_level").alias("level"), F.col("thread.root").alias("is_root"))


@query("export_parts", sql=f"""
SELECT msgid || '@conv.example' AS msgid, CAST(2 AS INTEGER) AS part_index, 'turn' || CAST(turn AS VARCHAR) || '.txt' AS filename,
  CAST(octet_length(encode(body_text)) AS BIGINT) AS size, md5(body_text) AS payload_md5
FROM {CONV_MSGS} m WHERE turn % 4 = 1""")
def export_parts(spark, sf):
    from ..session import scratch_path
    from ..sinks import export_parts as write_parts
    from ..sources import maildir as MD
    from .io import maildir_root
    files = MD.scan_maildir(spark, maildir_root(spark, sf))
    parts = MD.part_payloads(files).where(F.col("disposition") == "attachment")
    out = scratch_path(spark, "parts")
    write_parts(parts, out)
    back = spark.read.parquet(out)
    return back.select("msgid", "part_index", "filename", F.length("payload").cast("bigint").alias("size"),
                       F.md5("payload").alias("payload_md5"))
