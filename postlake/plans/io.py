"""File ingest, streams, sinks and user functions (SRC1-4, SRC12, PRT8-10,
STR1-4, SNK1-8, UDF1-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs as U
from ..operators import contacts as C
from ..operators import predicates as Q
from ..operators.projection import full, header
from ..session import scratch_path
from ..sinks import link_manifest, write_contacts_csv, write_json, write_xml
from ..sources import incremental as INC
from ..sources import maildir as MD
from ..sources import tables as T
from ..sources.store import KeyedStore
from ..streaming import streams as S
from .catalog import query
from .sqlviews import CONV_MSGS, EVENT_MSGS, OCC_ORDERS, tokens_sql

_ROOTS: dict[tuple, str] = {}


def maildir_root(spark, sf, separator: str = ":") -> str:
    """A maildir written (once per session) from the conversations table into the
    shared checkpoint folder, plus one excluded folder holding a .noindex marker."""
    key = (sf, separator, spark.sparkContext.getCheckpointDir() or "", T.version(spark, sf, "conversations"))
    if key not in _ROOTS:
        root = scratch_path(spark, "maildir")
        msgs = T.rfc822_from_conversations(spark, sf, separator)
        MD.write_files(msgs.select("relpath", "content"), root)
        marker = msgs.limit(1).select(F.lit("/junk/.noindex").alias("relpath"), F.lit(b"").alias("content"))
        junk = msgs.limit(1).select(F.lit(f"/junk/cur/copy{separator}2,S").alias("relpath"), "content")
        MD.write_files(marker.unionByName(junk), root)
        _ROOTS[key] = root
    return _ROOTS[key]


_PARSE_SQL = f"""
SELECT msgid || '@conv.example' AS msgid, subject, "from" AS from_name, "to" AS to_name,
  array_to_string(list_transform(refs, lambda r: r || '@conv.example'), ' ') AS refs,
  strftime(date, '%Y-%m-%d %H:%M:%S') AS date,
  CAST(CASE WHEN flags & 64 <> 0 THEN 64 ELSE flags END | CASE WHEN turn % 4 = 1 THEN 512 ELSE 0 END AS INTEGER) AS flags, replace(maildir, '/sent', '/.Sent') AS maildir,
  CAST(CASE WHEN turn % 4 = 1 THEN 2 ELSE 1 END AS BIGINT) AS n_parts, md5(body_text) AS body_md5,
  "from" AS tags, 'normal' AS prio, "from" AS x_label
FROM {CONV_MSGS} m"""


def _parsed_out(m):
    return m.select("msgid", "subject", F.col("from").alias("from_name"), F.col("to").alias("to_name"),
                    F.array_join("refs", " ").alias("refs"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
                    "flags", "maildir", F.size("parts").cast("bigint").alias("n_parts"),
                    F.md5("body_text").alias("body_md5"), F.array_join("tags", ",").alias("tags"), "prio",
                    header("headers", "X-Label").alias("x_label"))


@query("scan_parse_maildir", sql=_PARSE_SQL)
def scan_parse_maildir(spark, sf):
    return _parsed_out(MD.index_maildir(spark, maildir_root(spark, sf)))


@query("scan_distributed", sql=_PARSE_SQL)
def scan_distributed(spark, sf):
    return _parsed_out(MD.index_maildir_distributed(spark, maildir_root(spark, sf)))


@query("parsed_parts", sql=f"""
SELECT msgid || '@conv.example' AS msgid, CAST(1 AS INTEGER) AS part_index, 'text/plain' AS mime_type,
  CAST(octet_length(encode(body_text)) AS BIGINT) AS size, NULL AS disposition, NULL AS filename, 'utf-8' AS charset,
  'charset=utf-8' AS params
FROM {CONV_MSGS} m
UNION ALL SELECT msgid || '@conv.example', CAST(2 AS INTEGER), 'text/plain', CAST(octet_length(encode(body_text)) AS BIGINT),
  'attachment', 'turn' || CAST(turn AS VARCHAR) || '.txt', 'utf-8', 'charset=utf-8' FROM {CONV_MSGS} m WHERE turn % 4 = 1""")
def parsed_parts(spark, sf):
    m = MD.index_maildir(spark, maildir_root(spark, sf))
    p = m.select("msgid", F.explode("parts").alias("p")).select("msgid", "p.*")
    params = F.array_join(F.transform(F.array_sort(F.map_entries("params")),
                                      lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return p.select("msgid", F.col("index").alias("part_index"), "mime_type", "size", "disposition", "filename", "charset",
                    params.alias("params"))


@query("stream_index", sql=f"""
SELECT msgid || '@conv.example' AS msgid, maildir,
  CAST(CASE WHEN flags & 64 <> 0 THEN 64 ELSE flags END | CASE WHEN turn % 4 = 1 THEN 512 ELSE 0 END AS INTEGER) AS flags
FROM {CONV_MSGS} m""")
def stream_index(spark, sf):
    return S.stream_index(spark, maildir_root(spark, sf, "!"), settle=0).select("msgid", "maildir", "flags")


@query("stream_index_standard", sql=_PARSE_SQL)
def stream_index_standard(spark, sf):
    """Names with ':', folders with a leading dot and a marked folder; later turns arrive between two runs of one stream."""
    root, store, ckpt = (scratch_path(spark, name) for name in ("stream-tree", "stream-store", "stream-ckpt"))
    first = T.rfc822_from_conversations(spark, sf).withColumn("later", F.contains("content", F.lit(b"\nReferences: ")))
    junk = first.limit(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("relpath"), c.alias("content")) for p, c in (
        ("/junk/.noindex", F.lit(b"")), ("/junk/cur/copy:2,S", F.col("content")))])).alias("f")).select("f.*")
    for part in (first.where("not later").select("relpath", "content").unionByName(junk), first.where("later").select("relpath", "content")):
        MD.write_files(part, root)
        m = S.stream_index(spark, root, store, ckpt, settle=0)
    return _parsed_out(m)


@query("refresh_store", sql=_PARSE_SQL)
def refresh_store(spark, sf):
    """A store kept up to date: the stream's part of it, then what came after by a lazy batch run, then a run with nothing new."""
    root, base = scratch_path(spark, "refresh-tree"), scratch_path(spark, "refresh-store")
    files = T.rfc822_from_conversations(spark, sf).withColumn("later", F.contains("content", F.lit(b"\nReferences: ")))
    MD.write_files(files.where("not later").select("relpath", "content"), root)
    S.stream_index(spark, root, base, settle=0)
    MD.write_files(files.where("later").select("relpath", "content"), root)
    for _ in range(2):
        INC.refresh_store(spark, root, KeyedStore(spark, base), settle=0)
    return _parsed_out(KeyedStore(spark, base).read())


@query("stream_dedupe", sql="""
SELECT DISTINCT CAST(user_id AS VARCHAR) || '-' || event_type AS msgid FROM events""")
def stream_dedupe(spark, sf):
    s = T.events_as_msgs(S.events_stream(spark, sf))
    s = s.withColumn("msgid", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")))
    d = S.stream_dedupe(s.select("msgid", F.col("date").cast("timestamp").alias("date")), "msgid", "date", "1 day")
    return S.collect_stream(spark, d, "stream-dedupe").select("msgid")


@query("stream_first_copies", sql="""
SELECT CAST(user_id AS VARCHAR) || '-' || event_type AS msgid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen
FROM events GROUP BY ALL""")
def stream_first_copies(spark, sf):
    """The events in four files by time, a batch each; most ids come again days later."""
    e = T.read(spark, sf, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("msgid"), F.col("ts").alias("date"))
    lo, hi = e.agg(F.min(F.unix_micros(F.col("date").cast("timestamp"))), F.max(F.unix_micros(F.col("date").cast("timestamp")))).first()
    at = F.floor((F.unix_micros(F.col("date").cast("timestamp")) - F.lit(lo)) * 4 / F.lit(hi - lo + 1))
    folder = scratch_path(spark, "stream-events")
    for k in range(4):
        e.where(at == k).coalesce(1).write.parquet(f"{folder}/part{k}")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return S.stream_first_copies(spark, s).select("msgid", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("stream_contacts", sql=f"""
SELECT lower(email) AS key, CAST(count(*) AS BIGINT) AS freq, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM {OCC_ORDERS} o GROUP BY lower(email)""")
def stream_contacts(spark, sf):
    orders = S.table_stream(spark, sf, "orders")
    cust = T.read(spark, sf, "customer")
    j = orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
    email = F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    occ = j.select(email.alias("email"), F.col("o_orderdate").alias("date"))
    c = S.stream_contacts(spark, occ)
    return c.select("key", "freq", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


_SAVED = {
    "errors": ("lower(maildir) = '/error'", lambda: Q.maildir_is("maildir", "/error")),
    "flagged": ("(flags & 2) <> 0", lambda: Q.has_flag("flags", "F")),
    "big": ("value > 50", lambda: F.col("value") > 50),
}


@query("stream_counts", sql=" UNION ALL ".join(
    f"SELECT '{k}' AS name, CAST(count(*) FILTER (WHERE {s}) AS BIGINT) AS total, "
    f"CAST(count(*) FILTER (WHERE ({s}) AND ((flags & 64) <> 0 OR (flags & 16) = 0)) AS BIGINT) AS unread FROM {EVENT_MSGS} e"
    for k, (s, _) in _SAVED.items()))
def stream_counts(spark, sf):
    s = T.events_as_msgs(S.events_stream(spark, sf))
    return S.stream_saved_counts(spark, s, {k: f() for k, (_, f) in _SAVED.items()})


_HDR_SQL = f"""SELECT doc_id, "from", "to", subject, size, msgid, path, maildir,
  strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM {CONV_MSGS} m"""


def _hdr(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return m.select("doc_id", "from", "to", "subject", "size", "msgid", "path", "maildir",
                    F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


@query("json_out", sql=_HDR_SQL)
def json_out(spark, sf):
    out = scratch_path(spark, "json-out")
    h = _hdr(spark, sf)
    write_json(h, out, fields=h.columns)
    return spark.read.schema(h.schema).json(out)


@query("xml_out", sql=_HDR_SQL)
def xml_out(spark, sf):
    out = scratch_path(spark, "xml-out")
    h = _hdr(spark, sf)
    write_xml(h, out)
    return (spark.read.format("xml").option("rowTag", "message").option("ignoreSurroundingSpaces", "false")
            .schema(h.schema).load(out))


@query("csv_out", sql=f"""
SELECT arg_max(name, {{'d': date, 'i': doc_id}}) AS name, arg_max(email, {{'d': date, 'i': doc_id}}) AS email
FROM {OCC_ORDERS} o GROUP BY lower(email)""")
def csv_out(spark, sf):
    out = scratch_path(spark, "csv-out")
    c = C.build_contacts(T.occ_from_orders(spark, sf))
    write_contacts_csv(c, out)
    return spark.read.schema("name string, email string").option("escape", '"').csv(out)


@query("manifest", sql=f"""
SELECT path, '/links/' || regexp_extract(path, '/(cur|new)/[^/]+$', 1) || '/' || md5(path) || '_'
  || regexp_extract(path, '/([^/]+)$', 1) AS link FROM {CONV_MSGS} m WHERE list_contains(string_split(lower(body_text), ' '), 'und')""")
def manifest(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    res = m.where(F.array_contains(F.split(F.lower("body_text"), " "), "und"))
    return link_manifest(res, "/links")


@query("udf_predicate", sql="SELECT doc_id FROM documents WHERE contains(text, ',') AND lang = 'en'")
def udf_predicate(spark, sf):
    has_q = U.user_predicate(lambda s: s.str.contains(",", regex=False))
    d = T.msgs_from_documents(spark, sf)
    return d.where(has_q("body_text") & (F.col("lang") == "en")).select("doc_id")


@query("udf_custom_field", sql="SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars_py FROM documents")
def udf_custom_field(spark, sf):
    n = U.user_column(lambda s: s.str.len().astype("int64"), "bigint")
    d = T.msgs_from_documents(spark, sf)
    return d.select("doc_id", n("body_text").alias("n_chars_py"))


@query("udf_tabulate", sql="""
SELECT value, CAST(count(*) AS BIGINT) AS freq FROM (SELECT CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END || '-' || lang AS value
FROM documents) GROUP BY value""")
def udf_tabulate(spark, sf):
    from ..operators.aggregates import tabulate
    key = U.user_column(lambda n, lang: (n < 1000).map({True: "short", False: "long"}) + "-" + lang, "string")
    d = T.msgs_from_documents(spark, sf)
    return tabulate(d, key("size", "lang"))


@query("per_partition", sql="""
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_newlines FROM documents WHERE lang = 'de'""")
def per_partition(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    return U.for_each_message(d.select("doc_id", "body_text", "lang"),
                              lambda r: {"doc_id": r["doc_id"], "n_newlines": r["body_text"].count("\n")},
                              "doc_id bigint, n_newlines bigint", F.col("lang") == "de")


@query("contact_rewrite", sql=f"""
SELECT email, freq FROM (
  SELECT CASE WHEN contains(e, 'household') THEN NULL ELSE upper(split_part(e, '@', 1)) || '@' || split_part(e, '@', 2) END AS email, freq
  FROM (SELECT arg_max(email, {{'d': date, 'i': doc_id}}) AS e, CAST(count(*) AS BIGINT) AS freq FROM {OCC_ORDERS} o GROUP BY lower(email)))
WHERE email IS NOT NULL""")
def contact_rewrite(spark, sf):
    def fn(e: str):
        if "household" in e:
            return None
        local, _, dom = e.partition("@")
        return local.upper() + "@" + dom
    c = C.build_contacts(T.occ_from_orders(spark, sf))
    return C.process_contacts(c, U.contact_rewriter(fn)("email")).select("email", "freq")


@query("token_udtf", sql="""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS t
FROM documents) WHERE t <> '' GROUP BY doc_id""")
def token_udtf(spark, sf):
    d = T.read(spark, sf, "documents")
    t = d.select("doc_id", "text").lateralJoin(U.TokenTable(F.col("text").outer()))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


@query("udtf_tokens", sql="""
SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id,
  list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents)""")
def udtf_tokens(spark, sf):
    return U.MessageTokens(T.read(spark, sf, "documents").select("doc_id", "text").asTable())


@query("udtf_contacts", sql=f"""
SELECT doc_id, 'from' AS type, "from" AS name, from_email AS email FROM {CONV_MSGS} m
UNION ALL SELECT doc_id, 'to', "to", "to" || '@conv.example' FROM {CONV_MSGS} m""")
def udtf_contacts(spark, sf):
    m = MD.index_maildir(spark, maildir_root(spark, sf))
    k = F.split(F.split("msgid", "@")[0], "-")
    return U.MessageContacts(m.select((k[0].cast("long") * 1000 + k[1].cast("long")).alias("doc_id"), "contacts").asTable())


@query("udtf_parts", sql=f"""
SELECT doc_id, CAST(1 AS INTEGER) AS index, 'text/plain' AS mime_type, CAST(octet_length(encode(body_text)) AS BIGINT) AS size,
  NULL AS disposition, NULL AS filename FROM {CONV_MSGS} m
UNION ALL SELECT doc_id, CAST(2 AS INTEGER), 'text/plain', CAST(octet_length(encode(body_text)) AS BIGINT), 'attachment',
  'turn' || CAST(turn AS VARCHAR) || '.txt' FROM {CONV_MSGS} m WHERE turn % 4 = 1""")
def udtf_parts(spark, sf):
    m = MD.index_maildir(spark, maildir_root(spark, sf))
    k = F.split(F.split("msgid", "@")[0], "-")
    return U.MessageParts(m.select((k[0].cast("long") * 1000 + k[1].cast("long")).alias("doc_id"), "parts").asTable())


_ID_OF = lambda: (F.split(F.split("msgid", "@")[0], "-")[0].cast("long") * 1000 + F.split(F.split("msgid", "@")[0], "-")[1].cast("long")).alias("doc_id")


@query("html_only_search", sql=f"""
SELECT doc_id, 'agent-' || "to" AS user_agent, list_contains({tokens_sql('body_text')}, 'der') AS in_body FROM {CONV_MSGS} m
WHERE list_contains({tokens_sql('body_text')}, 'der') OR list_contains({tokens_sql('"from"')}, 'assistant')""")
def html_only_search(spark, sf):
    """Mail without plain text: default fields, the body alone, and the full view (PRJ2)."""
    root = scratch_path(spark, "html-mail")
    MD.write_files(T.html_rfc822_from_conversations(spark, sf).select("relpath", "content"), root)
    m = MD.index_maildir(spark, root)
    hits = m.where(Q.has_term_default("Der", html="body_html") | Q.has_term("from", "assistant"))
    return full(hits).select(_ID_OF(), "user_agent", Q.has_term(Q.search_body("body_txt"), "der").alias("in_body"))


@query("embedded_search", sql=f"""
SELECT doc_id FROM {CONV_MSGS} m WHERE turn % 4 = 1 AND list_contains({tokens_sql('body_text')}, 'der')""")
def embedded_search(spark, sf):
    """Text of attachments (FLT13, PRT8), as the parse extracts it."""
    return MD.index_maildir(spark, maildir_root(spark, sf)).where(Q.embedded("embedded_text", "DER")).select(_ID_OF())
