"""Contact queries: build, query-time, rank, find, since, process, nicks and
text exports (AGG16-17, CON1-5, WIN2-3, FN28-30, SNK4-5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import people as P
from ..operators import contacts as C
from ..operators import predicates as Q
from ..sources import tables as T
from .catalog import query
from .sqlviews import CONV_MSGS, OCC_ORDERS, tokens_sql

AS_OF = dt.datetime(1998, 8, 1)
SINCE = dt.datetime(1998, 6, 1)
TODAY = dt.date(2024, 6, 1)


def _contacts_sql(occ: str) -> str:
    return f"""SELECT arg_max(email, {{'d': date, 'i': doc_id}}) AS email,
  arg_max(name, {{'d': date, 'i': doc_id}}) FILTER (WHERE coalesce(name, '') <> '') AS name,
  CAST(count(*) AS BIGINT) AS freq, max(date) AS last_seen, bool_or(personal) AS personal
FROM {occ} o GROUP BY lower(email)"""


def _contacts_out_sql(occ: str) -> str:
    return f"""SELECT email, name, freq, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, personal,
  CASE WHEN name IS NOT NULL THEN name || ' <' || email || '>' ELSE email END AS full_address
FROM ({_contacts_sql(occ)})"""


def _contacts_out(c):
    return c.select("email", "name", "freq", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
                    "personal", "full_address")


def _orders_contacts(spark, sf):
    return C.build_contacts(T.occ_from_orders(spark, sf))


@query("contacts_build", sql=_contacts_out_sql(OCC_ORDERS))
def contacts_build(spark, sf):
    return _contacts_out(_orders_contacts(spark, sf))


_CONV_OCC = f"""(SELECT doc_id, date, name, email, personal FROM (
  SELECT doc_id, date, "from" AS name, "from" || '@conv.example' AS email,
         ("from" || '@conv.example' = 'system@conv.example' OR "to" || '@conv.example' = 'system@conv.example') AS personal
  FROM {CONV_MSGS} m WHERE list_contains({tokens_sql('body_text')}, 'the')
  UNION ALL
  SELECT doc_id, date, "to", "to" || '@conv.example',
         ("from" || '@conv.example' = 'system@conv.example' OR "to" || '@conv.example' = 'system@conv.example')
  FROM {CONV_MSGS} m WHERE list_contains({tokens_sql('body_text')}, 'the')))"""


@query("contacts_query", sql=_contacts_out_sql(_CONV_OCC))
def contacts_query(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return _contacts_out(C.contacts_of(m, Q.has_term("body_text", "the"), personal=["System@conv.example"]))


_RANK_SQL = f"""row_number() OVER (ORDER BY personal DESC, (last_seen > TIMESTAMP '{AS_OF - dt.timedelta(days=15)}') DESC,
  freq DESC, lower(email), email)"""


@query("contacts_rank", sql=f"""
SELECT email, freq, CAST({_RANK_SQL} AS BIGINT) AS rank FROM ({_contacts_sql(OCC_ORDERS)})""")
def contacts_rank(spark, sf):
    return C.rank_contacts(_orders_contacts(spark, sf), AS_OF).select("email", "freq", "rank")


@query("contacts_find", sql=f"""
SELECT email, name, freq FROM ({_contacts_sql(OCC_ORDERS)})
WHERE (regexp_matches(email, '(?i)CUSTOMER00000[0-4]') OR regexp_matches(coalesce(name, ''), '(?i)CUSTOMER00000[0-4]'))
  AND last_seen >= TIMESTAMP '1997-01-01 00:00:00'""")
def contacts_find(spark, sf):
    c = C.find_contacts(_orders_contacts(spark, sf), "CUSTOMER00000[0-4]", after=dt.datetime(1997, 1, 1))
    return c.select("email", "name", "freq")


@query("contacts_since", sql=f"""
SELECT email, rank FROM (SELECT email, last_seen, CAST({_RANK_SQL} AS BIGINT) AS rank FROM ({_contacts_sql(OCC_ORDERS)}))
WHERE last_seen > TIMESTAMP '{SINCE}'""")
def contacts_since(spark, sf):
    return C.contacts_since(_orders_contacts(spark, sf), AS_OF, SINCE).select("email", "rank")


@query("contacts_process", sql=f"""
SELECT email, freq FROM (
  SELECT CASE WHEN regexp_matches(email, 'household') THEN NULL ELSE regexp_replace(email, '\\.example$', '.test') END AS email, freq
  FROM ({_contacts_sql(OCC_ORDERS)}))
WHERE email IS NOT NULL AND NOT regexp_matches(email, '(?i)no[t]?[-.]?repl(y|ies)')""")
def contacts_process(spark, sf):
    c = _orders_contacts(spark, sf)
    fn = F.when(F.col("email").rlike("household"), F.lit(None)).otherwise(F.regexp_replace("email", r"\.example$", ".test"))
    return C.process_contacts(C.process_contacts(c, fn)).select("email", "freq")


_PEOPLE_SQL = """(SELECT replace(c_name, '#', ' ') AS name, lower(replace(c_name, '#', '')) || '@example.com' AS email FROM customer
  UNION ALL SELECT replace(s_name, '#', ' . '), lower(replace(s_name, '#', '')) || '@example.org' FROM supplier)"""

_NICK_BASE_SQL = r"""regexp_replace(
  CASE WHEN (CASE WHEN instr(name, ' ') > 0 THEN regexp_extract(name, '^(.*) [^ ]*$', 1) ELSE name END) = ''
         OR (CASE WHEN instr(name, ' ') > 0 THEN regexp_extract(name, ' ([^ ]*)$', 1) ELSE '' END) = ''
       THEN (CASE WHEN instr(name, ' ') > 0 THEN regexp_extract(name, '^(.*) [^ ]*$', 1) ELSE name END)
       ELSE (CASE WHEN instr(name, ' ') > 0 THEN regexp_extract(name, '^(.*) [^ ]*$', 1) ELSE name END)
            || substring(regexp_extract(name, ' ([^ ]*)$', 1), 1, 1) END,
  '[!-/:-@\[-`{-~\s]', '', 'g')"""


def _people(spark, sf):
    c = T.read(spark, sf, "customer").select(F.regexp_replace("c_name", "#", " ").alias("name"),
                                            F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com")).alias("email"))
    s = T.read(spark, sf, "supplier").select(F.regexp_replace("s_name", "#", " . ").alias("name"),
                                            F.concat(F.lower(F.regexp_replace("s_name", "#", "")), F.lit("@example.org")).alias("email"))
    return c.unionByName(s)


@query("nicks", sql=f"""
SELECT email, CASE WHEN rn = 1 THEN nb ELSE nb || CAST(rn AS VARCHAR) END AS nick, simple FROM (
  SELECT email, nb, simple, row_number() OVER (PARTITION BY nb ORDER BY email) AS rn FROM (
    SELECT email, {_NICK_BASE_SQL} AS nb, regexp_replace(lower(name), '\\P{{L}}', '_', 'g') AS simple
    FROM {_PEOPLE_SQL} p WHERE coalesce(name, '') <> ''))""")
def nicks(spark, sf):
    n = C.nicks(_people(spark, sf))
    return n.select("email", "nick", P.simple_nick("name").alias("simple"))


_FORMATS = ["plain", "mutt-ab", "csv", "org-contact", "bbdb"]


@query("contacts_text", sql=f"""
WITH c AS ({_contacts_sql(OCC_ORDERS)})
SELECT 'plain' AS fmt, email, CASE WHEN coalesce(name, '') <> '' THEN name || ' ' ELSE '' END || email AS line FROM c
UNION ALL SELECT 'mutt-ab', email, email || chr(9) || coalesce(name, '') || chr(9) FROM c
UNION ALL SELECT 'csv', email, CASE WHEN coalesce(name, '') <> '' THEN '"' || replace(name, '"', '""') || '"' ELSE '' END
  || ',' || '"' || replace(email, '"', '""') || '"' FROM c
UNION ALL SELECT 'org-contact', email, '* ' || name || chr(10) || ':PROPERTIES:' || chr(10) || ':EMAIL: ' || email
  || chr(10) || ':END:' || chr(10) FROM c WHERE coalesce(name, '') <> ''
UNION ALL SELECT 'bbdb', email, '["' || CASE WHEN instr(coalesce(name, ''), ' ') > 0 THEN regexp_extract(name, '^(.*) [^ ]*$', 1) ELSE coalesce(name, '') END
  || '" "' || CASE WHEN instr(coalesce(name, ''), ' ') > 0 THEN regexp_extract(name, ' ([^ ]*)$', 1) ELSE '' END
  || '" nil nil nil nil ("' || email || '") ((creation-date . "{TODAY}") (time-stamp . "'
  || strftime(last_seen, '%Y-%m-%d') || '")) nil]' FROM c""")
def contacts_text(spark, sf):
    c = _orders_contacts(spark, sf)
    out = None
    for fmt in _FORMATS:
        one = C.contacts_text(c, fmt, TODAY).select(F.lit(fmt).alias("fmt"), "email", "line")
        out = one if out is None else out.unionByName(one)
    return out


@query("contacts_alias", sql=f"""
WITH n AS (SELECT email, name, CASE WHEN rn = 1 THEN nb ELSE nb || CAST(rn AS VARCHAR) END AS nick FROM (
  SELECT email, name, nb, row_number() OVER (PARTITION BY nb ORDER BY email) AS rn FROM (
    SELECT email, name, {_NICK_BASE_SQL} AS nb FROM {_PEOPLE_SQL} p WHERE coalesce(name, '') <> '')))
SELECT 'mutt-alias' AS fmt, email, 'alias ' || nick || ' ' || name || ' <' || email || '>' AS line FROM n
UNION ALL SELECT 'wl', email, email || ' "' || nick || '" "' || name || '"' FROM n""")
def contacts_alias(spark, sf):
    n = C.nicks(_people(spark, sf))
    a = C.contacts_text(n, "mutt-alias").select(F.lit("mutt-alias").alias("fmt"), "email", "line")
    w = C.contacts_text(n, "wl").select(F.lit("wl").alias("fmt"), "email", "line")
    return a.unionByName(w)


@query("contacts_quoted", sql=f"""
WITH c AS ({_contacts_sql(OCC_ORDERS)})
SELECT 'quoted' AS fmt, email, '"' || replace(CASE WHEN coalesce(name, '') <> '' THEN '"' || name || '" ' ELSE '' END || '<' || email || '>', '"', chr(92) || '"') || '"' AS line FROM c
UNION ALL SELECT 'org-contact-nick', email, '* "' || coalesce(nullif(name, ''), email) || '"' || chr(10) || ':PROPERTIES:' || chr(10) || ':EMAIL:' || email || chr(10)
  || ':NICK:' || regexp_replace(lower(coalesce(nullif(name, ''), email)), '\\P{{L}}', '_', 'g') || chr(10) || ':END:' FROM c""")
def contacts_quoted(spark, sf):
    c = _orders_contacts(spark, sf)
    each = [C.contacts_text(c, fmt).select(F.lit(fmt).alias("fmt"), "email", "line") for fmt in ("quoted", "org-contact-nick")]
    return each[0].unionByName(each[1])
