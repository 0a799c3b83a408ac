"""Projections (PRJ1-PRJ6) and the line formatter (SNK3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import flags_to_string
from ..functions.text import strip_html
from ..operators.predicates import is_personal
from ..schema import FIELD_SHORTCUTS, field_column


def project(m: DataFrame, fields: str | list[str], keep: list[str] | None = None) -> DataFrame:
    """PRJ1: select by field names or one-letter shortcuts ('d f s z' or ['date', 'from'])."""
    names = fields.split() if isinstance(fields, str) else list(fields)
    cols = list(keep or [])
    for n in names:
        try:
            cols.append(field_column(n))
        except KeyError:
            cols.append(n)
    return m.select(*[F.col(f"`{c}`") for c in cols])


def _envelope(m: DataFrame) -> list[Column]:
    base = [c for c in ("doc_id", "path", "maildir", "msgid", "subject", "date", "size", "flags", "prio", "tags") if c in m.columns]
    of_type = lambda t: F.filter("contacts", lambda c: c["type"] == t)
    return [F.col(c) for c in base] + [of_type(t).alias(f"{t}_contacts") for t in ("from", "to", "cc", "bcc")]


def headers_only(m: DataFrame) -> DataFrame:
    """PRJ2: header fields with contacts grouped per type; no bodies or parts."""
    return m.select(*_envelope(m))


def full(m: DataFrame) -> DataFrame:
    """PRJ2: ``headers_only`` with parts, both bodies, the user agent, and the content-type parameters of the part that the plain body is."""
    body = F.try_element_at(F.filter("parts", lambda p: (p["mime_type"] == "text/plain") & ~(F.coalesce(p["disposition"], F.lit("")) == "attachment")), F.lit(1))
    return m.select(*_envelope(m), "parts", user_agent("headers").alias("user_agent"), body["params"].alias("body_txt_params"),
                    F.col("body_text").alias("body_txt"), "body_html")


def with_custom_field(m: DataFrame, name: str, fn: Column) -> DataFrame:
    """PRJ3: a user column (Column expression, or a pandas_udf applied to columns)."""
    return m.withColumn(name, fn)


def from_or_to(contacts: Column | str, personal: list[str]) -> Column:
    """PRJ4: the sender, or 'To <recipients>' when the sender is me."""
    c = F.col(contacts) if isinstance(contacts, str) else contacts
    sender = F.filter(c, lambda x: x["type"] == "from")[0]
    to_names = F.array_join(F.transform(F.filter(c, lambda x: x["type"] == "to"),
                                        lambda x: F.coalesce(F.nullif(x["name"], F.lit("")), x["email"])), ", ")
    return F.when(is_personal(sender["email"], personal), F.concat(F.lit("To "), to_names)).otherwise(
        F.coalesce(F.nullif(sender["name"], F.lit("")), sender["email"]))


def header(m_headers: Column | str, name: str) -> Column:
    """PRJ5: an arbitrary header by (case-blind) name from the headers map."""
    h = F.col(m_headers) if isinstance(m_headers, str) else m_headers
    return h[F.lit(name.lower())]


def user_agent(m_headers: Column | str = "headers") -> Column:
    """PRJ5 example: User-Agent, else X-Mailer."""
    return F.coalesce(header(m_headers, "user-agent"), header(m_headers, "x-mailer"))


def effective_body(text: Column, html: Column, prefer_html: bool = False, ratio: float = 5.0) -> Column:
    """PRJ6: the plain text, or text made from HTML when the text is missing,
    when HTML is preferred, or when the HTML is ``ratio`` times longer."""
    t_len = F.coalesce(F.length(text), F.lit(0))
    use_html = html.isNotNull() & ((t_len == 0) | F.lit(prefer_html) | (F.length(html) > t_len * F.lit(ratio)))
    return F.when(use_html, strip_html(html)).otherwise(F.coalesce(text, F.lit("")))


def _display(letter: str) -> Column:
    name = FIELD_SHORTCUTS[letter]
    col = field_column(name)
    if name == "date":
        from ..functions.dates import format_date
        return format_date("date", "yyyy-MM-dd HH:mm:ss")
    if name == "flag":
        return flags_to_string(F.col("flags"))
    if name in ("refs", "tag", "file", "mime"):
        return F.array_join(F.col(col), ",")
    return F.col(f"`{col}`").cast("string")


def format_lines(template: str) -> Column:
    """SNK3: field shortcuts replaced by display values; other characters literal."""
    parts = [_display(ch) if ch in FIELD_SHORTCUTS else F.lit(ch) for ch in template]
    return F.concat(*parts)
