"""Related messages, duplicates and lookup joins (JN1-JN8, DUP1-DUP4, WIN1,
FLT9-13, FLT24-28)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import contacts as C
from ..operators import dedupe
from ..operators import predicates as Q
from ..operators import related as R
from ..sources import tables as T
from .catalog import query
from .sqlviews import CONV_MSGS, DOC_MSGS, OCC_ORDERS, PARTS_LINEITEM, tokens_sql


@query("related_messages", sql=f"""
WITH m AS (SELECT *, coalesce(refs[1], msgid) AS thread_id FROM {CONV_MSGS} x)
SELECT doc_id, thread_id FROM m WHERE thread_id IN (
  SELECT thread_id FROM m WHERE list_contains({tokens_sql('body_text')}, 'und'))""")
def related_messages(spark, sf):
    m = T.msgs_from_conversations(spark, sf).withColumn("thread_id", R.thread_id())
    leaders = m.where(Q.has_term("body_text", "und"))
    return R.include_related(m, leaders).select("doc_id", "thread_id")


@query("dup_flag", sql="""
SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) AS is_dup,
  CAST(row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS BIGINT) AS dup_rank
FROM documents""")
def dup_flag(spark, sf):
    d = T.msgs_from_documents(spark, sf).select("doc_id", "msgid", "path")
    return dedupe.dup_ordinal(d).select("doc_id", (F.col("dup_rank") > 1).alias("is_dup"), "dup_rank")


@query("skip_dups", sql=f"""
SELECT doc_id FROM documents WHERE list_contains({tokens_sql('text')}, 'the')
QUALIFY doc_id = min(doc_id) OVER (PARTITION BY md5(text))""")
def skip_dups(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    return dedupe.skip_duplicates(d.where(Q.has_term("body_text", "the"))).select("doc_id")


_FIND_DUPS_SQL = f"""
WITH d AS (SELECT doc_id, msgid, size, body_text FROM {DOC_MSGS} x),
cand AS (SELECT msgid, size FROM d GROUP BY msgid, size HAVING count(*) > 1),
c AS (SELECT d.*, sha256(body_text) AS h FROM d JOIN cand USING (msgid, size))
SELECT doc_id, msgid, size, doc_id <> min(doc_id) OVER (PARTITION BY msgid, size, h) AS is_dup,
  min(doc_id) OVER (PARTITION BY msgid, size, h) AS first_doc_id FROM c"""


@query("find_dups", sql=_FIND_DUPS_SQL)
def find_dups(spark, sf):
    return dedupe.find_dups(T.msgs_from_documents(spark, sf))


@query("delete_dups", sql=f"""
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_FIND_DUPS_SQL}) WHERE is_dup)""")
def delete_dups(spark, sf):
    return dedupe.delete_dups(T.msgs_from_documents(spark, sf)).select("doc_id", "lang")


@query("attach_info", sql=f"""
SELECT r.doc_id, i.is_dup, r.lang FROM (SELECT doc_id, lang FROM documents WHERE list_contains({tokens_sql('text')}, 'de')) r
JOIN (SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) AS is_dup FROM documents) i USING (doc_id)""")
def attach_info(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    res = d.where(Q.has_term("body_text", "de")).select("doc_id", "lang")
    info = dedupe.flag_duplicates(d.select("doc_id", "msgid", "path")).select("doc_id", "is_dup")
    return R.attach_match_info(res, info)


_NAMES = {"src1.lists.example.org": "One", "src2.lists.example.org": "Two"}
_PATTERNS = [r"^(src1[0-4])\.lists"]


@query("list_shortname", sql=r"""
SELECT doc_id, coalesce(CASE list_id WHEN 'src1.lists.example.org' THEN 'One' WHEN 'src2.lists.example.org' THEN 'Two' END,
  CASE WHEN regexp_matches(list_id, '^(src1[0-4])\.lists') THEN regexp_extract(list_id, '^(src1[0-4])\.lists', 1) END,
  CASE WHEN instr(list_id, '.') > 0 THEN regexp_extract(list_id, '^([^.]*)\.', 1) END, list_id) AS short
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '.lists.example.org' ELSE source END AS list_id FROM documents)""")
def list_shortname(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    lid = F.when(F.col("doc_id") % 3 == 0, F.concat("mailing_list", F.lit(".lists.example.org"))).otherwise(F.col("mailing_list"))
    return d.select("doc_id", R.list_shortname(lid, _NAMES, _PATTERNS).alias("short"))


AS_OF = dt.datetime(1998, 8, 1)
_RANK_SQL = f"""row_number() OVER (ORDER BY personal DESC, (last_seen > TIMESTAMP '{AS_OF - dt.timedelta(days=15)}') DESC,
  freq DESC, lower(email), email)"""


@query("rank_addresses", sql=f"""
WITH c AS (SELECT arg_max(email, {{'d': date, 'i': doc_id}}) AS email, CAST(count(*) AS BIGINT) AS freq,
             max(date) AS last_seen, bool_or(personal) AS personal FROM {OCC_ORDERS} o GROUP BY lower(email)),
r AS (SELECT email, CAST({_RANK_SQL} AS BIGINT) AS rank FROM c)
SELECT o.doc_id, o.email, r.rank FROM {OCC_ORDERS} o LEFT JOIN r ON o.email = r.email WHERE o.o_orderpriority = '1-URGENT'""")
def rank_addresses(spark, sf):
    occ = T.occ_from_orders(spark, sf)
    ranked = C.rank_contacts(C.build_contacts(occ), AS_OF)
    addr = occ.where(F.col("o_orderpriority") == "1-URGENT").select("doc_id", "email")
    return R.rank_addresses(addr, ranked)


@query("copies_of", sql="""
SELECT doc_id, md5(text) AS msgid FROM documents
WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE lang = 'de' AND n_chars < 800)""")
def copies_of(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    wanted = d.where((F.col("lang") == "de") & (F.col("size") < 800)).select("msgid")
    return R.copies_of(d, wanted).select("doc_id", "msgid")


@query("personal_join", sql=f"""
SELECT o.doc_id, o.email,
  (lower(o.email) IN (SELECT lower(lower(replace(c_name, '#', '')) || '@' || lower(c_mktsegment) || '.example')
                      FROM customer WHERE c_acctbal > 9000)
   OR regexp_matches(o.email, '(?i)^(?:customer00000[0-9]@.*)$')) AS is_personal
FROM {OCC_ORDERS} o""")
def personal_join(spark, sf):
    occ = T.occ_from_orders(spark, sf).select("doc_id", "email")
    cust = T.read(spark, sf, "customer").where(F.col("c_acctbal") > 9000)
    addrs = cust.select(F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@"), F.lower("c_mktsegment"),
                                 F.lit(".example")).alias("address"))
    personal = addrs.unionByName(spark.createDataFrame([("/customer00000[0-9]@.*/",)], "address string"))
    return R.personal_join(occ, personal).select("doc_id", "email", "is_personal")


@query("by_msgid", sql=f"""
SELECT doc_id, msgid FROM {CONV_MSGS} m WHERE msgid IN ('3-1', '5-0', '7-2', '11-3', '2-0')""")
def by_msgid(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return Q.by_msgid(m, ["3-1", "5-0", "7-2", "11-3", "2-0"]).select("doc_id", "msgid")


@query("contact_match", sql=f"""
SELECT doc_id FROM {CONV_MSGS} m
WHERE (regexp_matches("from", '(?i)ass.*t') OR regexp_matches(from_email, '(?i)ass.*t')
       OR regexp_matches("to", '(?i)ass.*t') OR regexp_matches("to" || '@conv.example', '(?i)ass.*t'))
  AND regexp_matches(subject, '^Re: ')""")
def contact_match(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return m.where(Q.contact_matches("contacts", ("from", "to"), "ass.*t") & Q.field_matches("subject", "^Re: ")).select("doc_id")


@query("personal_msgs", sql=f"""
SELECT doc_id,
  (lower(from_email) = 'system@conv.example' OR lower("to" || '@conv.example') = 'system@conv.example'
   OR regexp_matches(from_email, '(?i)^(?:us.r@conv\\.example)$') OR regexp_matches("to" || '@conv.example', '(?i)^(?:us.r@conv\\.example)$')) AS personal,
  (lower(from_email) = 'system@conv.example' OR regexp_matches(from_email, '(?i)^(?:us.r@conv\\.example)$')) AS sent_by_me
FROM {CONV_MSGS} m""")
def personal_msgs(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    mine = ["SYSTEM@conv.example", r"/us.r@conv\.example/"]
    return m.select("doc_id", Q.is_personal_message("contacts", mine).alias("personal"),
                    Q.sent_by_me("contacts", mine).alias("sent_by_me"))


@query("tag_list_mime_file", sql=f"""
WITH msg AS (SELECT doc_id, list(filename) AS files, list(mime_type) AS mimes FROM {PARTS_LINEITEM} p GROUP BY doc_id)
SELECT 'tag_list' AS what, CAST(count(*) AS BIGINT) AS n FROM documents
  WHERE (lower(lang) = 'en' OR lower(source) = 'en') AND lower(source) = 'src3'
UNION ALL SELECT 'msgid', CAST(count(*) AS BIGINT) FROM {CONV_MSGS} m WHERE lower(msgid) = '7-2'
UNION ALL SELECT 'file_exact', CAST(count(*) AS BIGINT) FROM msg WHERE list_contains(files, 'red widget')
UNION ALL SELECT 'file_prefix', CAST(count(*) AS BIGINT) FROM msg WHERE len(list_filter(files, lambda f: starts_with(lower(f), 'sma'))) > 0
UNION ALL SELECT 'mime', CAST(count(*) AS BIGINT) FROM msg WHERE len(list_filter(mimes, lambda x: starts_with(lower(x), 'promo/'))) > 0
UNION ALL SELECT 'embedded', CAST(count(*) AS BIGINT) FROM msg
  WHERE list_contains({tokens_sql("array_to_string(files, ' ')")}, 'gizmo')""")
def tag_list_mime_file(spark, sf):
    from ..operators.parts import message_part_columns
    d = T.msgs_from_documents(spark, sf)
    m = T.msgs_from_conversations(spark, sf)
    msg = message_part_columns(T.parts_from_lineitem(spark, sf))
    rows = [
        ("tag_list", d.where(Q.has_tag("tags", "EN") & Q.list_is("mailing_list", "SRC3"))),
        ("msgid", m.where(Q.msgid_is("msgid", "7-2"))),
        ("file_exact", msg.where(Q.has_file("files", "Red Widget"))),
        ("file_prefix", msg.where(Q.has_file("files", "sma", "prefix"))),
        ("mime", msg.where(Q.has_mime("mimes", "promo/*"))),
        ("embedded", msg.where(Q.embedded(F.array_join("files", " "), "gizmo"))),
    ]
    out = None
    for name, df in rows:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("related_limit", sql=f"""
WITH m AS (SELECT *, coalesce(refs[1], msgid) AS thread_id FROM {CONV_MSGS} x),
leaders AS (SELECT * FROM m WHERE list_contains({tokens_sql('body_text')}, 'und') ORDER BY date DESC, doc_id LIMIT 10)
SELECT doc_id, thread_id FROM m WHERE thread_id IN (SELECT thread_id FROM leaders) ORDER BY date DESC, doc_id LIMIT 10""")
def related_limit(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return R.find_with_related(m, Q.has_term("body_text", "und"), 10).select("doc_id", "thread_id")
