"""Header and contact scalars (FN24-FN35, FN38)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# Priority header values.
PRIO_HIGH = ("high", "1", "2")
PRIO_LOW = ("low", "list", "bulk", "4", "5")


def parse_prio(precedence: Column | str | None = None, x_priority: Column | str | None = None,
               importance: Column | str | None = None) -> Column:
    """FN24: 'high' / 'normal' / 'low' by the first of Precedence, X-Priority and Importance that a
    message has; its whole value counts, and other values are normal."""
    given = [_col(c) for c in (precedence, x_priority, importance) if c is not None]
    v = F.lower(F.trim(F.coalesce(*given)))
    return F.when(v.isin(*PRIO_HIGH), F.lit("high")).when(v.isin(*PRIO_LOW), F.lit("low")).otherwise(F.lit("normal"))


def prio_from_order_priority(c: Column | str) -> Column:
    """Driver tables: 1-URGENT, 2-HIGH -> high; 3, 4 -> normal; 5-LOW -> low."""
    n = F.substring(_col(c), 1, 1)
    return F.when(n.isin("1", "2"), "high").when(n == "5", "low").otherwise("normal")


def mailing_list(list_id: Column | str, feed_version: Column | str | None = None,
                 msgid: Column | str | None = None) -> Column:
    """FN25: text inside <...> of List-Id, else the whole trimmed value. Without a List-Id, messages of a feed
    reader (an X-Feed2Imap-Version header) have the part of their id before the first '-'."""
    v = F.when(F.trim(_col(list_id)) != "", _col(list_id))
    inner = F.regexp_extract(v, r"<([^>]*)>", 1)
    out = F.when(inner != "", inner).otherwise(F.trim(v))
    if feed_version is None or msgid is None:
        return out
    feed = F.when(_col(feed_version).isNotNull() & (F.instr(_col(msgid), "-") > 0), F.substring_index(_col(msgid), "-", 1))
    return F.coalesce(out, feed)


def list_post(value: Column | str) -> Column:
    """FN26: the mailto address of a List-Post header (null if none)."""
    m = F.regexp_extract(_col(value), r"<?mailto:([^>\s]+)>?", 1)
    return F.when(m != "", m)


def email_local(c: Column | str) -> Column:
    """FN27 local part."""
    return F.substring_index(_col(c), "@", 1)


def email_domain(c: Column | str) -> Column:
    """FN27 domain (empty when no '@')."""
    e = _col(c)
    return F.when(F.instr(e, "@") > 0, F.substring_index(e, "@", -1)).otherwise(F.lit(""))


def first_name(c: Column | str) -> Column:
    """FN28: everything before the last space (whole name if none)."""
    n = F.coalesce(_col(c), F.lit(""))
    return F.when(F.instr(n, " ") > 0, F.regexp_extract(n, r"^(.*) [^ ]*$", 1)).otherwise(n)


def last_name(c: Column | str) -> Column:
    """FN28: everything after the last space (empty if none)."""
    n = F.coalesce(_col(c), F.lit(""))
    return F.when(F.instr(n, " ") > 0, F.regexp_extract(n, r" ([^ ]*)$", 1)).otherwise(F.lit(""))


# ASCII punctuation and white space dropped from nicks.
NICK_DROP = r"""[!-/:-@\[-`{-~\s]"""


def nick_base(c: Column | str) -> Column:
    """FN29: first name + first letter of the last name, punctuation/space removed."""
    fn, ln = first_name(c), last_name(c)
    raw = F.when((fn == "") | (ln == ""), fn).otherwise(F.concat(fn, F.substring(ln, 1, 1)))
    return F.regexp_replace(raw, NICK_DROP, "")


def simple_nick(c: Column | str) -> Column:
    """FN30: lower case, every non-letter becomes '_'."""
    return F.regexp_replace(F.lower(_col(c)), r"\P{L}", "_")


def msgid_or_hash(msgid: Column | str, content: Column | str, max_len: int = 240) -> Column:
    """FN31: the Message-Id, or '<sha256 of content>@postlake' when absent or too long."""
    m = _col(msgid)
    fallback = F.concat(F.sha2(_col(content).cast("binary"), 256), F.lit("@postlake"))
    return F.when(m.isNotNull() & (F.length(m) > 0) & (F.octet_length(m) < max_len), m).otherwise(fallback)


def tags_from_headers(x_label: Column | str | None = None, x_keywords: Column | str | None = None,
                      keywords: Column | str | None = None) -> Column:
    """FN32: X-Label and Keywords (space separated), X-Keywords (comma separated)."""
    arrs = []
    for c, sep in ((x_label, r"\s+"), (x_keywords, ","), (keywords, r"\s+")):
        if c is None:
            continue
        arrs.append(F.coalesce(F.split(F.trim(_col(c)), sep), F.array().cast("array<string>")))
    allt = F.concat(*arrs) if len(arrs) > 1 else arrs[0]
    return F.filter(F.transform(allt, lambda t: F.trim(t)), lambda t: t != "")


def parse_retag(spec: str) -> tuple[list[str], list[str]]:
    """Driver-side: '+a,-b,c' -> (add, remove); a bare tag is added."""
    add, rem = [], []
    for item in spec.split(","):
        item = item.strip()
        if not item:
            continue
        if item.startswith("-"):
            rem.append(item[1:])
        else:
            add.append(item[1:] if item.startswith("+") else item)
    return add, rem


def retag(tags: Column | str, spec: str) -> Column:
    """FN33: add/remove tags; result distinct and sorted."""
    add, rem = parse_retag(spec)
    t = F.coalesce(_col(tags), F.array().cast("array<string>"))
    if add:
        t = F.array_union(t, F.array(*[F.lit(x) for x in add]))
    if rem:
        t = F.array_except(t, F.array(*[F.lit(x) for x in rem]))
    return F.array_sort(F.array_distinct(t))


def display_contacts(contacts: Column | str, ctype: str | None = None, sep: str = ", ") -> Column:
    """FN34: names (or e-mail when there is no name) joined."""
    c = _col(contacts)
    if ctype:
        c = F.filter(c, lambda x: x["type"] == ctype)
    return F.array_join(F.transform(c, lambda x: F.when(F.coalesce(x["name"], F.lit("")) != "", x["name"])
                                    .otherwise(x["email"])), sep)


def clean_filename(name: Column | str, index: Column | str, mime_type: Column | str | None = None,
                   subject: Column | str | None = None) -> Column:
    """FN35: controls, '/', ':' and ';' become '-'; default names when missing."""
    n = _col(name)
    cleaned = F.regexp_replace(n, r"[\p{Cc}/:;]", "-")
    idx = _col(index).cast("string")
    default = F.concat(idx, F.lit(".msgpart"))
    if mime_type is not None:
        mt = F.lower(_col(mime_type))
        default = F.when(mt == "text/calendar", F.concat(F.lit("vcal-"), idx, F.lit(".vcs")))
        if subject is not None:
            default = default.when(mt == "message/rfc822",
                                   F.concat(F.regexp_replace(_col(subject), r"[\p{Cc}/:;]", "-"), F.lit(".eml")))
        default = default.otherwise(F.concat(idx, F.lit(".msgpart")))
    return F.when(n.isNotNull() & (n != ""), cleaned).otherwise(default)


def thread_prefix_subject(subject: Column | str, thread_subject: Column | str) -> Column:
    """FN38: the subject only where it starts a (sub)thread subject."""
    return F.when(_col(thread_subject), _col(subject)).otherwise(F.lit(""))
