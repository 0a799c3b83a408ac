"""Search queries: term, phrase, prefix, regex, flags, priority, ranges, boolean
algebra, folders, sorting (FLT*, FN13-21, FN24, SET*, ORD*, AGG3, SRC12)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import flags as FL
from ..functions import people as P
from ..functions.text import tokens
from ..operators import dedupe, ordering
from ..operators import predicates as Q
from ..sources import tables as T
from .catalog import query
from .sqlviews import CONV_MSGS, DOC_MSGS, EVENT_MSGS, tokens_sql

# Fixed "now" of the queries so results are reproducible.
AS_OF = dt.datetime(2024, 1, 4, 12, 0, 0)
EVENTS_AS_OF = dt.datetime(2024, 1, 20, 0, 0, 0)

_UNREAD_SQL = "((flags & 64) <> 0 OR (flags & 16) = 0)"


def _fmt(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _fmt_sql(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _bound_sql(t: int) -> str:
    return "TIMESTAMP '" + D.epoch_to_local(t, "UTC").strftime("%Y-%m-%d %H:%M:%S") + "'"


# --- 7.2 the minimum slice: unread, word, last 3 days, newest first, 20 rows ---
_FTD_LO = D.parse_date_bound("3d", True, AS_OF)
_FTD_HI = D.parse_date_bound("now", False, AS_OF)


@query("find_term_date", sql=f"""
SELECT doc_id, msgid, subject, {_fmt_sql('date')} AS date, flags FROM (
  SELECT * FROM {CONV_MSGS} m
  WHERE list_contains({tokens_sql('body_text')}, 'que')
    AND date >= {_bound_sql(_FTD_LO)} AND date <= {_bound_sql(_FTD_HI)}
    AND {_UNREAD_SQL}
  QUALIFY doc_id = min(doc_id) OVER (PARTITION BY coalesce(msgid, path)))
ORDER BY date DESC, doc_id LIMIT 20""")
def find_term_date(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    pred = Q.has_term("body_text", "que") & D.date_between("date", "3d", "now", AS_OF) & FL.is_unread("flags")
    res = dedupe.skip_duplicates(m.where(pred))
    return ordering.top_k(res, 20, "date", desc=True).select(
        "doc_id", "msgid", "subject", _fmt(F.col("date")).alias("date"), "flags")


def _contacts_sql(v: str) -> str:
    """Oracle twin of contact_term over the two contacts of a conversation message."""
    def one(name, email):
        return (f"(list_contains({tokens_sql(name)}, '{v}') OR lower({email}) = '{v}' "
                f"OR split_part(lower({email}), '@', 1) = '{v}' OR split_part(lower({email}), '@', 2) = '{v}')")
    return "(" + one('"from"', "from_email") + " OR " + one('"to"', "(\"to\" || '@conv.example')") + ")"


@query("term_default_fields", sql=f"""
SELECT doc_id, msgid FROM {CONV_MSGS} m
WHERE coalesce(list_contains({tokens_sql('"from"')}, 'der'), false)
   OR coalesce(list_contains({tokens_sql('"to"')}, 'der'), false)
   OR coalesce(list_contains({tokens_sql('subject')}, 'der'), false)
   OR coalesce(list_contains({tokens_sql('body_text')}, 'der'), false)
   OR {_contacts_sql('system')}""")
def term_default_fields(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    pred = Q.match_all() & (Q.has_term_default("der") | Q.contact("contacts", "system"))
    return m.where(pred).select("doc_id", "msgid")


@query("recip_contact", sql=f"""
SELECT doc_id FROM {CONV_MSGS} m WHERE "to" = 'assistant' AND "from" <> 'system'""")
def recip_contact(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return m.where(Q.recip("contacts", "Assistant") & ~Q.contact_term("contacts", ("from",), "system")).select("doc_id")


@query("phrase_match", sql=f"""
SELECT doc_id FROM documents
WHERE instr(' ' || array_to_string({tokens_sql('text')}, ' ') || ' ', ' of the ') > 0""")
def phrase_match(spark, sf):
    m = T.msgs_from_documents(spark, sf)
    return m.where(Q.phrase("body_text", "Of THE")).select("doc_id")


@query("prefix_match", sql=f"""
SELECT doc_id FROM documents
WHERE len(list_filter({tokens_sql('text')}, lambda t: starts_with(t, 'ther'))) > 0
   OR len(list_filter({tokens_sql('split_part(text, chr(10), 1)')}, lambda t: starts_with(t, 'mo'))) > 0""")
def prefix_match(spark, sf):
    m = T.msgs_from_documents(spark, sf)
    return m.where(Q.prefix("body_text", "ther*") | Q.prefix("subject", "Mo*")).select("doc_id")


@query("regex_terms", sql=f"""
SELECT doc_id, CAST(len(list_filter({tokens_sql('text')}, lambda t: regexp_matches(t, '^th[a-z]*ion$'))) AS BIGINT) AS n_hits
FROM documents
WHERE len(list_filter({tokens_sql('text')}, lambda t: regexp_matches(t, '^th[a-z]*ion$'))) > 0""")
def regex_terms(spark, sf):
    m = T.msgs_from_documents(spark, sf)
    rx = "^th[a-z]*ion$"
    return (m.where(Q.regex_terms("body_text", rx))
            .select("doc_id", F.size(F.filter(tokens("body_text"), lambda t: t.rlike(rx))).cast("bigint").alias("n_hits")))


_FLAGSTR_SQL = ("(CASE WHEN flags & 1 <> 0 THEN 'D' ELSE '' END || CASE WHEN flags & 2 <> 0 THEN 'F' ELSE '' END"
                " || CASE WHEN flags & 4 <> 0 THEN 'P' ELSE '' END || CASE WHEN flags & 8 <> 0 THEN 'R' ELSE '' END"
                " || CASE WHEN flags & 16 <> 0 THEN 'S' ELSE '' END || CASE WHEN flags & 32 <> 0 THEN 'T' ELSE '' END"
                " || CASE WHEN flags & 64 <> 0 THEN 'N' ELSE '' END)")
_FLAGNAMES_SQL = ("concat_ws(',', CASE WHEN flags & 1 <> 0 THEN 'draft' END, CASE WHEN flags & 2 <> 0 THEN 'flagged' END,"
                  " CASE WHEN flags & 4 <> 0 THEN 'passed' END, CASE WHEN flags & 8 <> 0 THEN 'replied' END,"
                  " CASE WHEN flags & 16 <> 0 THEN 'seen' END, CASE WHEN flags & 32 <> 0 THEN 'trashed' END,"
                  " CASE WHEN flags & 64 <> 0 THEN 'new' END)")


@query("flags_roundtrip", sql=f"""
SELECT event_type, flag_str, names, custom, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT event_type, {_FLAGSTR_SQL} AS flag_str, {_FLAGNAMES_SQL} AS names,
         regexp_replace({_FLAGSTR_SQL} || 'hello' || event_type, '[DFPRST]', '', 'g') AS custom
  FROM {EVENT_MSGS} e) GROUP BY ALL""")
def flags_roundtrip(spark, sf):
    e = T.msgs_from_events(spark, sf)
    # the letters are computed once and referenced by name (no nested re-expansion in codegen)
    s = e.select("event_type", "flags", FL.flags_to_string("flags").alias("flag_str"))
    checked = s.select("event_type", "flag_str", F.array_join(FL.flag_names("flags"), ",").alias("names"),
                       FL.custom_flags(F.concat("flag_str", F.lit("hello"), F.col("event_type"))).alias("custom"),
                       (FL.flags_from_string("flag_str") == F.col("flags")).alias("ok"))
    return (checked.where("ok").groupBy("event_type", "flag_str", "names", "custom")
            .agg(F.count("*").alias("n")))


@query("flags_delta", sql=f"""
SELECT doc_id, flags,
  CAST((flags | 16) & ~(64 | 2048) AS INTEGER) AS read_flags,
  CAST((flags | 2) & ~64 AS INTEGER) AS flag_flags,
  CAST(CASE WHEN path LIKE '%/new/%' THEN 64
       ELSE (CASE WHEN regexp_extract(path, '[:!;]2,([^/]*)$', 1) LIKE '%F%' THEN 2 ELSE 0 END)
          | (CASE WHEN regexp_extract(path, '[:!;]2,([^/]*)$', 1) LIKE '%S%' THEN 16 ELSE 0 END) END AS INTEGER) AS path_flags
FROM {CONV_MSGS} m""")
def flags_delta(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return m.select("doc_id", "flags", FL.flags_delta("flags", "+S-u-N").alias("read_flags"),
                    FL.flags_delta("flags", "+F-N").alias("flag_flags"),
                    FL.flags_from_path("path").alias("path_flags"))


@query("unread", sql=f"""
SELECT maildir, CAST(count(*) AS BIGINT) AS n_unread,
       CAST(count(*) FILTER (WHERE flags & 2 <> 0) AS BIGINT) AS n_unread_flagged
FROM {CONV_MSGS} m WHERE {_UNREAD_SQL} GROUP BY maildir""")
def unread(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return (m.where(Q.is_unread("flags")).groupBy("maildir")
            .agg(F.count("*").alias("n_unread"), F.count_if(Q.has_flag("flags", "flagged")).alias("n_unread_flagged")))


_PRIO_SQL = ("CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high' "
             "WHEN substring(o_orderpriority, 1, 1) = '5' THEN 'low' ELSE 'normal' END")


@query("prio_filter", sql=f"""
SELECT CAST(count(*) FILTER (WHERE substring({_PRIO_SQL}, 1, 1) = 'h') AS BIGINT) AS n_high,
       CAST(count(*) FILTER (WHERE NOT (substring({_PRIO_SQL}, 1, 1) = 'l')) AS BIGINT) AS n_not_low,
       CAST(count(*) AS BIGINT) AS n_all FROM orders""")
def prio_filter(spark, sf):
    o = T.read(spark, sf, "orders").select(P.prio_from_order_priority("o_orderpriority").alias("prio"))
    return o.agg(F.count_if(Q.prio_is("prio", "h")).alias("n_high"),
                 F.count_if(~Q.prio_is("prio", "low")).alias("n_not_low"),
                 F.count("*").alias("n_all"))


@query("prio_parse", sql="""
SELECT prio, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'normal' WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high'
              WHEN substring(o_orderpriority, 1, 1) IN ('4', '5') THEN 'low' ELSE 'normal' END AS prio
  FROM orders) GROUP BY prio""")
def prio_parse(spark, sf):
    o = T.read(spark, sf, "orders")
    precedence = F.when(F.col("o_orderkey") % 3 == 0, "fm-user")  # the first header decides, known or not
    prio = P.parse_prio(precedence, F.substring("o_orderpriority", 1, 1))
    return o.select(prio.alias("prio")).groupBy("prio").agg(F.count("*").alias("n"))


_DR_LO = D.parse_date_bound("20240105", True, EVENTS_AS_OF)
_DR_HI = D.parse_date_bound("2024-01-10", False, EVENTS_AS_OF)


@query("date_range", sql=f"""
SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events
WHERE ts >= {_bound_sql(_DR_LO)} AND ts <= {_bound_sql(_DR_HI)} GROUP BY event_type""")
def date_range(spark, sf):
    e = T.msgs_from_events(spark, sf)
    # reversed bounds are swapped, as in the reference
    return (e.where(D.date_between("date", "2024-01-10", "20240105", EVENTS_AS_OF))
            .groupBy("event_type").agg(F.count("*").alias("n")))


_DA_LO = D.parse_date_bound("5d", True, EVENTS_AS_OF)
_DA_HI = D.parse_date_bound("today", False, EVENTS_AS_OF)


@query("date_age", sql=f"""
SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events
WHERE ts >= {_bound_sql(_DA_LO)} AND ts <= {_bound_sql(_DA_HI)} GROUP BY user_id""")
def date_age(spark, sf):
    e = T.msgs_from_events(spark, sf)
    return e.where(D.date_between("date", "5d", "today", EVENTS_AS_OF)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("size_range", sql="""
SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM documents
WHERE n_chars BETWEEN 2048 AND 10240 GROUP BY lang""")
def size_range(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    return (d.where(D.size_between("size", "10k", "2kb")).groupBy("lang")
            .agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("total")))


def _doc_term_sql(w):
    return f"list_contains({tokens_sql('text')}, '{w}')"


@query("bool_xor", sql=f"""
SELECT doc_id FROM documents WHERE ({_doc_term_sql('the')}) <> ({_doc_term_sql('de')})""")
def bool_xor(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    return d.where(Q.xor(Q.has_term("body_text", "the"), Q.has_term("body_text", "de"))).select("doc_id")


@query("bool_not", sql=f"""
SELECT CAST(count(*) FILTER (WHERE NOT {_doc_term_sql('the')}) AS BIGINT) AS n_not,
       CAST(count(*) FILTER (WHERE {_doc_term_sql('und')} AND NOT {_doc_term_sql('der')}) AS BIGINT) AS n_and_not,
       CAST(count(*) FILTER (WHERE ({_doc_term_sql('la')} OR {_doc_term_sql('el')}) AND {_doc_term_sql('que')}) AS BIGINT) AS n_or_and
FROM documents""")
def bool_not(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    t = lambda w: Q.has_term("body_text", w)
    return d.agg(F.count_if(~t("the")).alias("n_not"),
                 F.count_if(Q.and_not(t("und"), t("der"))).alias("n_and_not"),
                 F.count_if((t("la") | t("el")) & t("que")).alias("n_or_and"))


@query("set_ops", sql=f"""
WITH a AS (SELECT doc_id FROM documents WHERE {_doc_term_sql('the')}),
     b AS (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 1000)
SELECT 'union' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)
UNION ALL SELECT 'intersect', CAST(count(*) AS BIGINT) FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b)
UNION ALL SELECT 'except', CAST(count(*) AS BIGINT) FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)
UNION ALL SELECT 'xor', CAST(count(*) AS BIGINT) FROM ((SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)
                                                     UNION ALL (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a))""")
def set_ops(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    # both predicates in one scan; the narrow result is checkpointed and feeds all four set operations
    from ..session import checkpointed
    sel = checkpointed(d.select("doc_id", Q.has_term("body_text", "the").alias("in_a"),
                                ((F.col("lang") == "en") & (F.col("size") > 1000)).alias("in_b")))
    a = sel.where("in_a").select("doc_id")
    b = sel.where("in_b").select("doc_id")
    parts = [("union", ordering.union_docs(a, b)), ("intersect", ordering.intersect_docs(a, b)),
             ("except", ordering.except_docs(a, b)), ("xor", ordering.xor_docs(a, b))]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("narrow_hide", sql=f"""
SELECT doc_id, "from", value FROM {EVENT_MSGS} e
WHERE (flags & 2) <> 0 AND lower(maildir) = '/error' AND NOT (value > 50) """)
def narrow_hide(spark, sf):
    e = T.msgs_from_events(spark, sf)
    sel = e.where(Q.narrow(Q.has_flag("flags", "F"), Q.maildir_is("maildir", "/Error")))
    return Q.hide(sel, F.col("value") > 50).select("doc_id", "from", "value")


@query("modified_after", sql="""
SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY event_type""")
def modified_after(spark, sf):
    e = T.msgs_from_events(spark, sf)
    return (e.where(Q.modified_after("mtime", dt.datetime(2024, 1, 25)))
            .groupBy("event_type").agg(F.count("*").alias("n")))


@query("folder_list", sql=f"""
SELECT maildir, CAST(row_number() OVER (ORDER BY lower(maildir), maildir) AS BIGINT) AS pos
FROM (SELECT DISTINCT maildir FROM {DOC_MSGS} d)""")
def folder_list(spark, sf):
    from ..operators.windows import ranked
    d = T.msgs_from_documents(spark, sf).select("maildir").distinct()
    return ranked(d, [F.lower("maildir"), F.col("maildir")], out="pos")


@query("folder_counts", sql=f"""
SELECT maildir, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE {_UNREAD_SQL}) AS BIGINT) AS unread
FROM {EVENT_MSGS} e GROUP BY maildir""")
def folder_counts(spark, sf):
    from ..operators.aggregates import folder_counts as fc
    return fc(T.msgs_from_events(spark, sf))


@query("sort_topk", sql=f"""
SELECT doc_id, size, subject FROM {CONV_MSGS} m ORDER BY size DESC, doc_id LIMIT 25""")
def sort_topk(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return ordering.top_k(m, 25, "z", desc=True).select("doc_id", "size", "subject")


@query("collated_sort", sql=f"""
SELECT doc_id, subject, CAST(row_number() OVER (ORDER BY lower(regexp_replace(subject, '(?i)^\\s*((re|fwd?)(\\[\\d+\\])?\\s*:\\s*)+', '')), doc_id) AS BIGINT) AS pos
FROM {CONV_MSGS} m""")
def collated_sort(spark, sf):
    from ..operators.windows import ranked
    m = T.msgs_from_conversations(spark, sf).select("doc_id", "subject")
    return ranked(m, [ordering.collation_key("subject"), F.col("doc_id")], out="pos")


@query("regex_values", sql=f"""
SELECT doc_id, regexp_matches(maildir, '^/src1') AS in_dir, regexp_matches(msgid, '[0-9]a[0-9]$') AS by_id, regexp_matches(mailing_list, '7$') AS on_list,
  len(list_filter(tags, lambda t: regexp_matches(t, '^f|9'))) > 0 AS tagged FROM {DOC_MSGS} m
WHERE regexp_matches(maildir, '^/src1') OR regexp_matches(msgid, '[0-9]a[0-9]$') OR regexp_matches(mailing_list, '7$') OR len(list_filter(tags, lambda t: regexp_matches(t, '^f|9'))) > 0""")
def regex_values(spark, sf):
    m = T.msgs_from_documents(spark, sf)
    found = {"in_dir": Q.regex_value("maildir", "^/SRC1"), "by_id": Q.regex_value("msgid", "[0-9]a[0-9]$"), "on_list": Q.regex_value("mailing_list", "7$"),
             "tagged": Q.regex_any("tags", "^f|9")}
    return m.withColumns(found).where("in_dir or by_id or on_list or tagged").select("doc_id", *found)
