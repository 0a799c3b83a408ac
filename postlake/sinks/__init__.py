"""Result writers (SNK1-SNK8): Spark's own writers, one file set per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.projection import format_lines

HEADER_FIELDS = ["from", "to", "cc", "subject", "date", "size", "msgid", "path", "maildir"]


def headers_json(res: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """SNK1: one JSON object per message with the header fields; null fields
    are left out (to_json drops nulls)."""
    cols = [c for c in (fields or ["doc_id", *HEADER_FIELDS, "flags", "tags", "thread_path", "thread_level"]) if c in res.columns]
    return res.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("json"))


def write_json(res: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """SNK1."""
    cols = [c for c in (fields or ["doc_id", *HEADER_FIELDS, "flags", "tags"]) if c in res.columns]
    res.select(*[F.col(f"`{c}`") for c in cols]).write.mode("overwrite").json(path)


def write_xml(res: DataFrame, path: str) -> None:
    """SNK2: <messages><message>...</message></messages>."""
    cols = [c for c in ["doc_id", *HEADER_FIELDS] if c in res.columns]
    (res.select(*[F.col(f"`{c}`") for c in cols]).write.mode("overwrite").format("xml")
     .option("rowTag", "message").option("rootTag", "messages").save(path))


def write_lines(res: DataFrame, path: str, template: str) -> None:
    """SNK3: one formatted line per message."""
    res.select(format_lines(template).alias("value")).write.mode("overwrite").text(path)


def write_contacts_csv(c: DataFrame, path: str) -> None:
    """SNK4: name,email with RFC 4180 quoting (embedded quotes doubled)."""
    (c.select("name", "email").write.mode("overwrite").option("quote", '"').option("escape", '"')
     .option("quoteAll", "true").csv(path))


def write_contacts_text(lines: DataFrame, path: str) -> None:
    """SNK5: the ``line`` column of operators.contacts.contacts_text."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def link_manifest(res: DataFrame, link_dir: str) -> DataFrame:
    """SNK6: (source path, link target) in place of symlinks: the target lives in
    <link_dir>/cur or /new (as the source) and is named <hash>_<file name>."""
    base = F.regexp_extract("path", r"/([^/]+)$", 1)
    sub = F.regexp_extract("path", r"/(cur|new)/[^/]+$", 1)
    h = F.md5(F.col("path"))
    target = F.concat(F.lit(link_dir.rstrip("/")), F.lit("/"), sub, F.lit("/"), h, F.lit("_"), base)
    return res.select("path", target.alias("link"))


def export_parts(parts: DataFrame, path: str, payload: str = "payload") -> None:
    """SNK7: selected part payloads as Parquet (BINARY column), partitioned by message."""
    parts.write.mode("overwrite").parquet(path)


def with_thread_info(res: DataFrame, threads: DataFrame) -> DataFrame:
    """SNK8: thread info packed as one struct column of the output row."""
    info = threads.select("doc_id", F.struct(*[c for c in threads.columns if c != "doc_id"]).alias("thread"))
    return res.join(info.hint("merge"), "doc_id", "left")  # a row per message: not sent through the driver
