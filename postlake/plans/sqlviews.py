"""DuckDB twins of the message views in ``postlake.sources.tables``.

Used only by the oracle SQL: each is a parenthesised SELECT over the
pre-registered driver views, equal column for column to the Spark view.
"""

CONV_MSGS = """(SELECT c.conv_id*1000+c.turn AS doc_id, c.conv_id, c.turn,
  CASE WHEN ((c.conv_id+c.turn)%8) & 4 <> 0
       THEN '/mail' || CASE WHEN c.role='user' THEN '/inbox' ELSE '/sent' END || '/new/' || CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR)
       ELSE '/mail' || CASE WHEN c.role='user' THEN '/inbox' ELSE '/sent' END || '/cur/' || CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR)
            || ':2,' || CASE WHEN ((c.conv_id+c.turn)%8) & 2 <> 0 THEN 'F' ELSE '' END
            || CASE WHEN ((c.conv_id+c.turn)%8) & 1 <> 0 THEN 'S' ELSE '' END END AS path,
  CASE WHEN c.role='user' THEN '/inbox' ELSE '/sent' END AS maildir,
  CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR) AS msgid,
  list_transform(range(0, c.turn), lambda i: CAST(c.conv_id AS VARCHAR) || '-' || CAST(i AS VARCHAR)) AS refs,
  CASE WHEN c.turn = 0 THEN f.base ELSE 'Re: ' || f.base END AS subject,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c.conv_id*3600 + c.turn*60) AS date,
  c.role AS "from", CASE WHEN c.role='user' THEN 'assistant' ELSE 'user' END AS "to",
  c.role || '@conv.example' AS from_email,
  'normal' AS prio,
  CAST(((((c.conv_id+c.turn)%8) & 1) * 16) + (((c.conv_id+c.turn)%8) & 2) + ((((c.conv_id+c.turn)%8) & 4) * 16) AS INTEGER) AS flags,
  c.text AS body_text, CAST(length(c.text) AS BIGINT) AS size
FROM conversations c LEFT JOIN (SELECT conv_id, split_part(text, chr(10), 1) AS base FROM conversations WHERE turn = 0) f
  ON c.conv_id = f.conv_id)"""

CONV_MSGS_GAPS = f"(SELECT * FROM {CONV_MSGS} g WHERE (g.conv_id*7 + g.turn) % 5 <> 0)"

DOC_MSGS = """(SELECT doc_id,
  '/mail/' || source || '/cur/' || CAST(doc_id AS VARCHAR) || ':2,S' AS path,
  '/' || source AS maildir, md5(text) AS msgid, split_part(text, chr(10), 1) AS subject,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id*2220) AS date,
  source AS mailing_list, [lang, source] AS tags, text AS body_text, n_chars AS size,
  CAST(16 AS INTEGER) AS flags, lang, source
FROM documents)"""

EVENT_MSGS = """(SELECT event_id AS doc_id, ts AS date, ts AS mtime, 'user' || CAST(user_id AS VARCHAR) AS "from",
  user_id, event_type, value, props, '/' || event_type AS maildir,
  CAST(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 16 WHEN 'view' THEN 8
       WHEN 'signup' THEN 64 WHEN 'purchase' THEN 4 ELSE 0 END AS INTEGER) AS flags,
  CAST(length(props) AS BIGINT) * 100 + user_id AS size
FROM events)"""

OCC_ORDERS = """(SELECT o.o_orderkey AS doc_id, 'from' AS type, c.c_name AS name,
  lower(replace(c.c_name, '#', '')) || '@' || lower(c.c_mktsegment) || '.example' AS email,
  o.o_orderdate AS date, (o.o_orderstatus = 'F') AS personal, o.o_orderpriority
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

PARTS_LINEITEM = """(SELECT l.l_orderkey AS doc_id, l.l_linenumber AS part_index, lower(p.p_type) AS type,
  string_split(lower(p.p_name), ' ')[-1] AS subtype,
  CASE WHEN p.p_type = 'STANDARD' THEN 'text/plain' WHEN p.p_type = 'PROMO' THEN 'text/html'
       ELSE lower(p.p_type) || '/' || string_split(lower(p.p_name), ' ')[-1] END AS mime_type,
  CAST(p.p_size AS BIGINT) AS size, p.p_name AS filename,
  CASE WHEN l.l_returnflag = 'A' THEN 'attachment' WHEN l.l_returnflag = 'R' THEN 'inline' END AS disposition,
  'part' || CAST(l.l_partkey AS VARCHAR) AS cid
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

# SQL twin of functions.text.flatten (lower, accents stripped, æ ø đ folded).
def flatten_sql(x: str) -> str:
    return f"replace(replace(replace(strip_accents(lower({x})), 'æ', 'e'), 'ø', 'o'), 'đ', 'd')"


TOKEN_SPLIT_SQL = r"'[^\p{L}\p{N}]+'"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({flatten_sql(x)}, {TOKEN_SPLIT_SQL}), lambda t: t <> '')"
