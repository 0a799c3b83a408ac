"""Driver tables viewed as message archives (see FIXTURES.md §2).

Every view is a lazy DataFrame derived from the Parquet tables, so each query
that uses it scans only the columns it needs and scales with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FLAG_BITS

BASE_DATE = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def version(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Number, bytes and newest change of a table's files, from their metadata (no column is read): what is
    derived from a table holds as long as this is the same."""
    files = read(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time").cast("string")).first())


def _base_plus_seconds(secs: Column) -> Column:
    return F.lit(BASE_DATE).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


def _contact(ctype: str, name: Column, email: Column) -> Column:
    return F.struct(F.lit(ctype).alias("type"), name.alias("name"), email.alias("email"),
                    F.concat(name, F.lit(" <"), email, F.lit(">")).alias("full_address"))


def msgs_from_conversations(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """One message per conversation turn; turn t refers to turns 0..t-1."""
    c = read(spark, sf_dir, "conversations")
    if gaps:
        c = c.where(((F.col("conv_id") * 7 + F.col("turn")) % 5) != 0)
    # one row per conversation (an aggregate), so Catalyst drops this outer join
    # entirely from every query that does not use the subject
    first = (read(spark, sf_dir, "conversations").where(F.col("turn") == 0)
             .groupBy("conv_id").agg(F.min(F.substring_index("text", "\n", 1)).alias("_base")))
    m = c.join(first, "conv_id", "left")
    v = ((F.col("conv_id") + F.col("turn")) % 8).cast("int")
    flags = (v.bitwiseAND(1) * 16 + v.bitwiseAND(2) + v.bitwiseAND(4) * 16).cast("int")
    msgid = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    refs = F.when(F.col("turn") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("turn") - 1),
                                                  lambda i: F.concat(F.col("conv_id").cast("string"), F.lit("-"), i.cast("string")))
                  ).otherwise(F.array().cast("array<string>"))
    other = F.when(F.col("role") == "user", F.lit("assistant")).otherwise(F.lit("user"))
    maildir = F.when(F.col("role") == "user", F.lit("/inbox")).otherwise(F.lit("/sent"))
    is_new = v.bitwiseAND(4) != 0
    letters = F.concat(F.when(v.bitwiseAND(2) != 0, F.lit("F")).otherwise(F.lit("")),
                       F.when(v.bitwiseAND(1) != 0, F.lit("S")).otherwise(F.lit("")))
    path = F.when(is_new, F.concat(F.lit("/mail"), maildir, F.lit("/new/"), msgid)).otherwise(
        F.concat(F.lit("/mail"), maildir, F.lit("/cur/"), msgid, F.lit(":2,"), letters))
    subject = F.when(F.col("turn") == 0, F.col("_base")).otherwise(F.concat(F.lit("Re: "), F.col("_base")))
    date = _base_plus_seconds(F.col("conv_id") * 3600 + F.col("turn") * 60)
    email = F.concat(F.col("role"), F.lit("@conv.example"))
    other_email = F.concat(other, F.lit("@conv.example"))
    return m.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        "conv_id", "turn",
        path.alias("path"), maildir.alias("maildir"),
        msgid.alias("msgid"), refs.alias("refs"),
        subject.alias("subject"), date.alias("date"), date.alias("mtime"),
        F.col("role").alias("from"), other.alias("to"), F.lit(None).cast("string").alias("cc"),
        F.lit(None).cast("string").alias("bcc"),
        email.alias("from_email"),
        F.array(_contact("from", F.col("role"), email), _contact("to", other, other_email)).alias("contacts"),
        F.lit("normal").alias("prio"), flags.alias("flags"),
        F.array(F.col("role")).alias("tags"),
        F.col("text").alias("body_text"),
        F.length("text").cast("bigint").alias("size"),
    )


def msgs_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per document; exact copies share a msgid (md5 of the text)."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("/mail/"), F.col("source"), F.lit("/cur/"), F.col("doc_id").cast("string"), F.lit(":2,S")).alias("path"),
        F.concat(F.lit("/"), F.col("source")).alias("maildir"),
        F.md5(F.col("text")).alias("msgid"),
        F.substring_index("text", "\n", 1).alias("subject"),
        _base_plus_seconds(F.col("doc_id") * 2220).alias("date"),
        F.col("source").alias("mailing_list"),
        F.array(F.col("lang"), F.col("source")).alias("tags"),
        F.col("text").alias("body_text"),
        F.col("n_chars").alias("size"),
        F.lit(FLAG_BITS["S"]).alias("flags"),
        "lang", "source",
    )


# Fixed mapping of event types to flags for the events view.
EVENT_FLAGS = {"error": "F", "click": "S", "view": "R", "signup": "N", "purchase": "P"}


def msgs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per event; the type decides the flag, value feeds statistics."""
    return events_as_msgs(read(spark, sf_dir, "events"))


def events_as_msgs(e: DataFrame) -> DataFrame:
    """The events view over any events DataFrame (batch or stream)."""
    flags = F.coalesce(*[F.when(F.col("event_type") == et, F.lit(FLAG_BITS[l])) for et, l in EVENT_FLAGS.items()], F.lit(0))
    return e.select(
        F.col("event_id").alias("doc_id"),
        F.col("ts").alias("date"), F.col("ts").alias("mtime"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("from"),
        "user_id", "event_type", "value", "props",
        F.concat(F.lit("/"), F.col("event_type")).alias("maildir"),
        flags.cast("int").alias("flags"),
        (F.length("props").cast("bigint") * 100 + F.col("user_id")).alias("size"),
    )


def occ_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact occurrences: one 'from' address per order, the customer's."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    email = F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    return j.select(
        F.col("o_orderkey").alias("doc_id"),
        F.lit("from").alias("type"),
        F.col("c_name").alias("name"),
        email.alias("email"),
        F.col("o_orderdate").alias("date"),
        (F.col("o_orderstatus") == "F").alias("personal"),
        "o_orderpriority",
    )


def parts_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIME parts: one part per line item of an order; the part table names it."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_size")
    j = l.join(p, l.l_partkey == p.p_partkey, "inner")
    words = F.split(F.lower("p_name"), " ")
    return j.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("part_index"),
        F.lower("p_type").alias("type"),
        F.element_at(words, -1).alias("subtype"),
        F.when(F.col("p_type") == "STANDARD", F.lit("text/plain")).when(F.col("p_type") == "PROMO", F.lit("text/html"))
        .otherwise(F.concat(F.lower("p_type"), F.lit("/"), F.element_at(words, -1))).alias("mime_type"),
        F.col("p_size").cast("bigint").alias("size"),
        F.col("p_name").alias("filename"),
        F.when(F.col("l_returnflag") == "A", "attachment").when(F.col("l_returnflag") == "R", "inline").alias("disposition"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("cid"),
    )


def html_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"), F.col("html").alias("body_html"))


def rfc822_from_conversations(spark: SparkSession, sf_dir: str, separator: str = ":") -> DataFrame:
    """Conversation turns as RFC 822 message files (relpath, content): a
    maildir derived from the table, for the file-ingest path. Every fourth
    turn (turn % 4 == 1) is multipart with the text also attached."""
    m = msgs_from_conversations(spark, sf_dir)
    mid = lambda c: F.concat(F.lit("<"), c, F.lit("@conv.example>"))
    refs = F.array_join(F.transform("refs", lambda r: mid(r)), " ")
    date = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    subj = F.concat(F.lit("=?utf-8?b?"), F.replace(F.base64(F.encode(F.coalesce("subject", F.lit("")), "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("?="))
    hdr = F.concat(
        F.lit("Message-Id: "), mid(F.col("msgid")), F.lit("\n"),
        F.lit("Date: "), date, F.lit("\n"),
        F.lit("From: "), F.col("from"), F.lit(" <"), F.col("from_email"), F.lit(">\n"),
        F.lit("To: "), F.col("to"), F.lit(" <"), F.col("to"), F.lit("@conv.example>\n"),
        F.lit("Subject: "), subj, F.lit("\n"),
        F.when(F.col("turn") > 0, F.concat(F.lit("References: "), refs, F.lit("\nIn-Reply-To: "),
                                             mid(F.element_at("refs", -1)), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("X-Label: "), F.col("from"), F.lit("\nMIME-Version: 1.0\n"))
    boundary = F.concat(F.lit("b-"), F.col("msgid"))
    single = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.col("body_text"))
    fname = F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".txt"))
    multi = F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="'), boundary, F.lit('"\n\n--'), boundary,
        F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.col("body_text"),
        F.lit("\n--"), boundary, F.lit('\nContent-Type: text/plain; charset=utf-8\nContent-Disposition: attachment; filename="'),
        fname, F.lit('"\nContent-Transfer-Encoding: base64\n\n'), F.base64(F.encode("body_text", "UTF-8")),
        F.lit("\n--"), boundary, F.lit("--\n"))
    content = F.concat(hdr, F.when(F.col("turn") % 4 == 1, multi).otherwise(single))
    # ':' is the standard separator; Spark's own file readers can't hold it, for which '!' is the accepted variant
    relpath = F.replace(F.regexp_replace("path", "^/mail", ""), F.lit(":2,"), F.lit(f"{separator}2,"))
    if separator == ":":
        relpath = F.regexp_replace(relpath, "^/sent/", "/.Sent/")  # nor do they list folders with a leading dot
    return m.select("doc_id", relpath.alias("relpath"), F.encode(content, "UTF-8").alias("content"))


def html_rfc822_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as message files (relpath, content) without plain text: the body is HTML, with a style sheet, tags
    between paragraphs and escaped characters."""
    m = msgs_from_conversations(spark, sf_dir)
    text = F.col("body_text")
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "</p>\n<p class=\"x\">")):
        text = F.replace(text, F.lit(ch), F.lit(entity))
    content = F.concat(F.lit("Message-Id: <"), "msgid", F.lit("@conv.example>\nFrom: "), "from", F.lit(" <"), "from_email", F.lit(">\nUser-Agent: agent-"), "to",
                       F.lit("\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8; format=flowed\nContent-Transfer-Encoding: 8bit\n\n"
                             "<html><head><style>p.der { color: red }</style></head><body><p>"), text, F.lit("</p></body></html>\n"))
    return m.select("doc_id", F.regexp_replace("path", "^/mail", "").alias("relpath"), F.encode(content, "UTF-8").alias("content"))
