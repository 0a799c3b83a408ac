"""Search predicates as Column builders (FLT1-FLT29).

Each returns a boolean Column; combine them with ``&``, ``|``, ``~`` or the
helpers below. Leaves are null-safe (a missing field is "no match"), so
``~`` is the complement, as in the reference.
"""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import has_flag, is_unread  # noqa: F401  (re-exported)
from ..functions.text import flatten, flatten_py, strip_html, tokens


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _safe(pred: Column) -> Column:
    return F.coalesce(pred, F.lit(False))


def match_all() -> Column:
    """FLT1: the empty query."""
    return F.lit(True)


_B = r"[^\p{L}\p{N}]"


def words_of(text: str) -> list[str]:
    """The tokens of a search text, split as ``functions.text.tokens`` splits a message: at all but letters and digits."""
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", flatten_py(text)) if w]


def _tokens_in_a_row(text: Column | str, words: str, end: str) -> Column:
    ws = words_of(words)
    if not ws:
        return F.lit(False)
    return _safe(flatten(text).rlike(f"(^|{_B}){f'{_B}+'.join(ws)}{end}"))


def has_term(text: Column | str, word: str) -> Column:
    """FLT2: the word occurs as a token of the text (case and accent blind).

    Tokens are the letter/digit runs of the flattened text, so this is a boundary-anchored regex on the
    flattened text: one pass, no token array is built. A word that holds other characters, as
    ``foo_bar``, is its tokens in a row; one without tokens matches nothing."""
    return _tokens_in_a_row(text, word, f"({_B}|$)")


DEFAULT_FIELDS = ("to", "cc", "bcc", "from", "subject", "body_text")


def search_body(text: Column | str = "body_text", html: Column | str = "body_html") -> Column:
    """The body that searches read: the plain text, or the text of the HTML where a message has no plain text."""
    return F.coalesce(_col(text), strip_html(html))


def has_term_default(word: str, fields: tuple[str, ...] = DEFAULT_FIELDS, contacts: str | None = None,
                     html: Column | str | None = None) -> Column:
    """FLT3: the word in any default field (contacts, subject, body). With ``html``, the column of HTML bodies (parsed
    messages have it), a message without plain text is searched by its HTML."""
    preds = [has_term(search_body(f, html) if f == "body_text" and html is not None else f, word) for f in fields]
    if contacts:
        preds.append(contact_term(contacts, ("to", "cc", "bcc", "from"), word))
    return reduce(lambda a, b: a | b, preds)


def contact_term(contacts: Column | str, types: tuple[str, ...], x: str) -> Column:
    """FLT5: a contact of the given types whose name token, whole address,
    local part or domain equals the (flattened) value."""
    v = flatten_py(x)

    from ..functions.people import email_domain, email_local

    def one(c):
        email = flatten(F.coalesce(c["email"], F.lit("")))  # folded as the value is
        name_hit = F.array_contains(tokens(F.coalesce(c["name"], F.lit(""))), v)
        return c["type"].isin(*types) & (name_hit | (email == v) | (email_local(email) == v)
                                         | (email_domain(email) == v))
    return _safe(F.exists(_col(contacts), one))


def contact(contacts: Column | str, x: str) -> Column:
    """FLT4: any of from/to/cc/bcc."""
    return contact_term(contacts, ("from", "to", "cc", "bcc"), x)


def recip(contacts: Column | str, x: str) -> Column:
    """FLT4: any of to/cc/bcc."""
    return contact_term(contacts, ("to", "cc", "bcc"), x)


def phrase(text: Column | str, words: str) -> Column:
    """FLT6: the words occur consecutively as tokens."""
    return _tokens_in_a_row(text, words, f"({_B}|$)")


def prefix(text: Column | str, p: str) -> Column:
    """FLT7: some token starts with the prefix (trailing '*' only)."""
    if not flatten_py(p.rstrip("*")):
        raise ValueError("a prefix needs at least one character")
    return _tokens_in_a_row(text, p.rstrip("*"), "")


def regex_terms(text: Column | str, rx: str) -> Column:
    """FLT8: some token of the field matches the regex (unanchored)."""
    return _safe(F.exists(tokens(text), lambda t: t.rlike(rx)))


def regex_value(c: Column | str, rx: str) -> Column:
    """FLT8 on a field of one whole value (maildir, msgid, list): the flattened value holds a match of the flattened expression."""
    return _safe(flatten(c).rlike(flatten_py(rx)))


def regex_any(c: Column | str, rx: str) -> Column:
    """FLT8 on a field of several whole values (tags, refs, files, mimes): some flattened value holds a match."""
    return _safe(F.exists(_col(c), lambda v: flatten(v).rlike(flatten_py(rx))))


def value_is(c: Column | str, x: str) -> Column:
    """FLT9: whole-value match of a term field, flattened (maildir, msgid, list)."""
    return _safe(flatten(c) == F.lit(flatten_py(x)))


maildir_is = value_is
msgid_is = value_is
list_is = value_is


def has_tag(tags: Column | str, x: str) -> Column:
    """FLT10."""
    return _safe(F.exists(_col(tags), lambda t: flatten(t) == F.lit(flatten_py(x))))


def has_file(files: Column | str, x: str, mode: str = "exact") -> Column:
    """FLT11: part file name; mode exact | prefix | regex."""
    v = flatten_py(x)
    if mode == "prefix":
        return _safe(F.exists(_col(files), lambda f: flatten(f).startswith(v)))
    if mode == "regex":
        return _safe(F.exists(_col(files), lambda f: flatten(f).rlike(x)))
    return _safe(F.exists(_col(files), lambda f: flatten(f) == F.lit(v)))


def has_mime(mimes: Column | str, x: str) -> Column:
    """FLT12: MIME type of any part; 'image/*' style prefixes allowed."""
    v = x.lower()
    if v.endswith("*"):
        return _safe(F.exists(_col(mimes), lambda m: F.lower(m).startswith(v[:-1])))
    return _safe(F.exists(_col(mimes), lambda m: F.lower(m) == F.lit(v)))


def embedded(text: Column | str, word: str) -> Column:
    """FLT13: word in text extracted from attachments."""
    return has_term(text, word)


def prio_is(prio: Column | str, x: str) -> Column:
    """FLT16: the first letter decides (h, n, l)."""
    return _safe(F.substring(_col(prio), 1, 1) == F.lit(x[:1].lower()))


def xor(a: Column, b: Column) -> Column:
    """FLT19."""
    return _safe(a) != _safe(b)


def and_not(a: Column, b: Column) -> Column:
    """FLT19."""
    return _safe(a) & ~_safe(b)


def modified_after(mtime: Column | str, ts) -> Column:
    """FLT20."""
    from ..functions.dates import ntz_lit
    return _safe(_col(mtime) >= ntz_lit(ts))


def narrow(expr: Column, extra: Column) -> Column:
    """FLT22: (expr) AND (extra)."""
    return _safe(expr) & _safe(extra)


def hide(df: DataFrame, pred: Column) -> DataFrame:
    """FLT23: drop rows the display predicate hides."""
    return df.where(~_safe(pred))


def skip_unreadable(res: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """FLT21: keep matches whose file is in the current listing (semi join)."""
    return res.join(listing.select(key), key, "left_semi")


def contact_matches(contacts: Column | str, types: tuple[str, ...], rx: str) -> Column:
    """FLT24: regex (case-blind) on name or e-mail of contacts of the types."""
    r = f"(?i){rx}"
    return _safe(F.exists(_col(contacts), lambda c: c["type"].isin(*types)
                          & (F.coalesce(c["name"], F.lit("")).rlike(r) | F.coalesce(c["email"], F.lit("")).rlike(r))))


def field_matches(c: Column | str, rx: str) -> Column:
    """FLT25: regex selection on a text field (subject, list)."""
    return _safe(_col(c).rlike(rx))


def personal_regex(personal: list[str]) -> tuple[list[str], list[str]]:
    """Split a personal address list into plain addresses and /regex/ entries."""
    plain, rxs = [], []
    for p in personal:
        if len(p) > 2 and p.startswith("/") and p.endswith("/"):
            rxs.append(p[1:-1])
        else:
            plain.append(p.lower())
    return plain, rxs


def is_personal(email: Column | str, personal: list[str]) -> Column:
    """FLT27: case-blind equality with a plain address, or full case-blind regex match."""
    plain, rxs = personal_regex(personal)
    e = F.lower(_col(email))
    preds = []
    if plain:
        preds.append(e.isin(*plain))
    for rx in rxs:
        preds.append(_col(email).rlike(f"(?i)^(?:{rx})$"))
    return _safe(reduce(lambda a, b: a | b, preds)) if preds else F.lit(False)


def is_personal_message(contacts: Column | str, personal: list[str]) -> Column:
    """FLT26: any contact of the message is mine."""
    return _safe(F.exists(_col(contacts), lambda c: is_personal(c["email"], personal)))


def sent_by_me(contacts: Column | str, personal: list[str]) -> Column:
    """FLT26: the sender is mine."""
    return _safe(F.exists(_col(contacts), lambda c: (c["type"] == "from") & is_personal(c["email"], personal)))


def by_msgid(m: DataFrame, ids: list[str], max_hits: int | None = None) -> DataFrame:
    """FLT28: messages with one of the ids; the first ``max_hits`` by doc_id if the caller names a number."""
    hits = m.where(F.col("msgid").isin(*ids))
    return hits if max_hits is None else hits.orderBy("doc_id").limit(max_hits)


def by_docid(m: DataFrame, ids: list[int]) -> DataFrame:
    """FLT28."""
    return m.where(F.col("doc_id").isin(*ids))


def is_attachment(disposition: Column | str, mime_type: Column | str, is_leaf: Column | str | bool = True) -> Column:
    """FLT29: a leaf that is not text/plain or text/html, or has disposition attachment."""
    leaf = F.lit(is_leaf) if isinstance(is_leaf, bool) else _col(is_leaf)
    mt = F.lower(_col(mime_type))
    return _safe(leaf & ((~mt.isin("text/plain", "text/html")) | (F.lower(_col(disposition)) == "attachment")))
