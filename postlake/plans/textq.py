"""Text, projection and formatting queries (FN1-12, FN14, FN34, FN36-37,
PRJ1-PRJ6, SNK3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import people as P
from ..functions import text as X
from ..operators import projection as PR
from ..sources import tables as T
from .catalog import query
from .sqlviews import CONV_MSGS, flatten_sql

AS_OF = dt.datetime(2024, 1, 2, 12, 0, 0)


@query("flatten_text", sql=f"""
SELECT doc_id, md5({flatten_sql('text')}) AS flat_md5, CAST(length({flatten_sql('text')}) AS BIGINT) AS flat_len
FROM documents""")
def flatten_text(spark, sf):
    d = T.read(spark, sf, "documents")
    f = X.flatten("text")
    return d.select("doc_id", F.md5(f).alias("flat_md5"), F.length(f).cast("bigint").alias("flat_len"))


@query("clean_text", sql=r"""
SELECT doc_id,
  md5(trim(regexp_replace(text, '\p{Cc}', ' ', 'g'))) AS clean_md5,
  md5(regexp_replace(regexp_replace(text, '[\t\n\r\f\x0B]', ' ', 'g'), '\p{Cc}', '', 'g')) AS strip_md5,
  md5(regexp_replace(text, '[^\x20-\x7E]', '.', 'g')) AS ascii_md5
FROM documents""")
def clean_text(spark, sf):
    d = T.read(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.clean("text")).alias("clean_md5"),
                    F.md5(X.strip_ctrl("text")).alias("strip_md5"), F.md5(X.asciify("text")).alias("ascii_md5"))


@query("remove_ctrl", sql=r"""
SELECT doc_id, md5(regexp_replace(text, '[\p{Cc} ]+', ' ', 'g')) AS rc_md5,
  CAST(length(regexp_replace(text, '[\p{Cc} ]+', ' ', 'g')) AS BIGINT) AS rc_len
FROM conversations_docs""".replace("conversations_docs", "(SELECT conv_id*1000+turn AS doc_id, text FROM conversations)"))
def remove_ctrl(spark, sf):
    c = T.read(spark, sf, "conversations")
    rc = X.remove_ctrl("text")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.md5(rc).alias("rc_md5"),
                    F.length(rc).cast("bigint").alias("rc_len"))


@query("summarize_body", sql=r"""
SELECT conv_id*1000+turn AS doc_id,
  trim(regexp_replace(array_to_string(string_split(text, chr(10))[1:2], chr(10)), '[ \t\r\n]+', ' ', 'g')) AS summary
FROM conversations""")
def summarize_body(spark, sf):
    c = T.read(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), X.summarize("text", 2).alias("summary"))


@query("subject_norm", sql=f"""
SELECT doc_id, regexp_replace(subject, '{X.SUBJECT_PREFIX}', '') AS norm,
  regexp_replace('Fwd: RE[2]: ' || subject, '{X.SUBJECT_PREFIX}', '') AS norm2
FROM {CONV_MSGS} m""")
def subject_norm(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return m.select("doc_id", X.subject_normalize("subject").alias("norm"),
                    X.subject_normalize(F.concat(F.lit("Fwd: RE[2]: "), F.col("subject"))).alias("norm2"))


@query("subject_tail", sql=f"""
SELECT doc_id, CASE WHEN instr(s, ':') = 0 THEN s ELSE regexp_replace(s, '(?s)^.*: *', '') END AS tail
FROM (SELECT doc_id, 'Re: x: ' || subject AS s FROM {CONV_MSGS} m)""")
def subject_tail(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return m.select("doc_id", X.subject_tail(F.concat(F.lit("Re: x: "), F.col("subject"))).alias("tail"))


@query("line_count", sql="""
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines FROM documents""")
def line_count(spark, sf):
    d = T.read(spark, sf, "documents")
    return d.select("doc_id", X.line_count("text").alias("lines"))


_URL_SQL = X.URL_PATTERN.replace("'", "''")


@query("urls", sql=f"""
SELECT page_id AS doc_id, CAST(pos AS BIGINT) AS pos, url FROM (
  SELECT page_id, unnest(arr) AS url, generate_subscripts(arr, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, '{_URL_SQL}', 1) AS arr FROM pages))""")
def urls(spark, sf):
    p = T.read(spark, sf, "pages")
    return (p.select(F.col("page_id").alias("doc_id"), F.posexplode(X.urls(F.concat_ws(" ", "url", "html"))))
            .select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("url")))


_STRIP_SQL = r"""trim(regexp_replace(
  replace(replace(replace(replace(replace(
    regexp_replace(
      regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
                     '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'),
      '(?s)<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '"'), '&amp;', '&'),
  '[ \t\n\r\f]+', ' ', 'g'))"""


@query("html_body", sql=f"""
SELECT page_id AS doc_id, md5({_STRIP_SQL}) AS text_md5, CAST(length({_STRIP_SQL}) AS BIGINT) AS text_len,
  CAST(length({_STRIP_SQL}) > 0 AS BOOLEAN) AS from_html
FROM pages""")
def html_body(spark, sf):
    h = T.html_from_pages(spark, sf).withColumn("body_text", F.lit(None).cast("string"))
    b = PR.effective_body(F.col("body_text"), F.col("body_html"))
    return h.select("doc_id", F.md5(b).alias("text_md5"), F.length(b).cast("bigint").alias("text_len"),
                    (F.length(b) > 0).alias("from_html"))


@query("project_fields", sql=f"""
SELECT doc_id, date, "from", subject, size, maildir,
  CAST(len(list_filter(regexp_split_to_array({flatten_sql('body_text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS BIGINT) AS n_words
FROM {CONV_MSGS} m""")
def project_fields(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return PR.project(PR.with_custom_field(m, "n_words", F.size(X.tokens("body_text")).cast("bigint")), "d f s z maildir n_words", keep=["doc_id"])


@query("from_or_to", sql=f"""
SELECT doc_id, CASE WHEN lower(from_email) IN ('user@conv.example') THEN 'To ' || "to" ELSE "from" END AS from_or_to
FROM {CONV_MSGS} m""")
def from_or_to(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return m.select("doc_id", PR.from_or_to("contacts", ["user@conv.example"]).alias("from_or_to"))


def _size_disp_sql(x):
    def unit(div, label):
        t = f"CAST(floor(({x} * 10 + {div // 2}) / {div}) AS BIGINT)"
        return f"(CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '{label}')"
    return (f"(CASE WHEN {x} < 1000 THEN CAST({x} AS VARCHAR) || CASE WHEN {x} = 1 THEN ' byte' ELSE ' bytes' END "
            f"WHEN {x} < 1000000 THEN {unit(1000, ' kB')} WHEN {x} < 1000000000 THEN {unit(1000000, ' MB')} "
            f"ELSE {unit(1000000000, ' GB')} END)")


@query("format_lines", sql=f"""
SELECT doc_id,
  strftime(date, '%Y-%m-%d %H:%M:%S') || ' ' || "from" || ' ' || subject AS line,
  '"' || replace(replace(subject, '\\', '\\\\'), '"', '\\"') || '"' AS quoted,
  {_size_disp_sql('(size * 37)')} AS size_disp,
  CASE WHEN size * 997 >= 1000000 THEN CAST(CAST(floor((size * 997 * 10 + 500000) / 1000000) AS BIGINT) // 10 AS VARCHAR) || '.'
         || CAST(CAST(floor((size * 997 * 10 + 500000) / 1000000) AS BIGINT) % 10 AS VARCHAR) || 'M'
       WHEN size * 997 >= 1000 THEN CAST(CAST(floor((size * 997 * 10 + 500) / 1000) AS BIGINT) // 10 AS VARCHAR) || '.'
         || CAST(CAST(floor((size * 997 * 10 + 500) / 1000) AS BIGINT) % 10 AS VARCHAR) || 'K'
       ELSE CAST(size * 997 AS VARCHAR) END AS size_short,
  CASE WHEN CAST(date AS DATE) = DATE '{AS_OF.date()}' THEN strftime(date, '%H:%M:%S') ELSE strftime(date, '%Y-%m-%d') END AS human,
  "from" || ', ' || "to" AS people,
  array_to_string(list_transform(string_split(maildir || ',' || "from", ','), lambda x: trim(x)), '|') AS split_join
FROM {CONV_MSGS} m""")
def format_lines(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return m.select(
        "doc_id",
        PR.format_lines("d f s").alias("line"),
        X.quote("subject").alias("quoted"),
        D.size_display(F.col("size") * 37).alias("size_disp"),
        D.size_short(F.col("size") * 997).alias("size_short"),
        D.human_date("date", AS_OF).alias("human"),
        P.display_contacts("contacts").alias("people"),
        X.join_list(X.split_list(F.concat_ws(",", "maildir", "from"), ","), "|").alias("split_join"),
    )


# the first bytes of a text, cut where they fall: within a letter for some
_CUT = "(SELECT doc_id, left(text, 40) AS t, 7 + doc_id % 20 AS n FROM documents WHERE strlen(left(text, 40)) >= 27)"


@query("utf8ify", sql=f"""
SELECT doc_id, CASE WHEN list_contains(ends, n) THEN t[1:CAST(list_position(ends, n) AS INTEGER)] ELSE left(bytes, CAST(n AS INTEGER)) END AS s FROM (
  SELECT doc_id, t, n, list_transform(range(1, length(t) + 1), lambda k: CAST(strlen(left(t, CAST(k AS INTEGER))) AS BIGINT)) AS ends,
    array_to_string(list_transform(range(1, length(t) + 1), lambda k: CASE WHEN strlen(t[k]) = 1 THEN t[k] ELSE repeat('.', strlen(t[k])) END), '') AS bytes FROM {_CUT} c)""")
def utf8ify(spark, sf):
    t = F.encode(F.substring("text", 1, 40), "UTF-8")
    d = T.read(spark, sf, "documents").where(F.length(t) >= 27)
    return d.select("doc_id", X.utf8ify(F.substring(t, F.lit(1), (F.lit(7) + F.col("doc_id") % 20).cast("int"))).alias("s"))
