"""Message data model: field table, shortcuts, flag table."""

from __future__ import annotations

from pyspark.sql import types as T

# Message flags (letter, name, kind) in the reference's order.
# The order decides the letter order of flags_to_string.
FLAG_TABLE = [
    ("D", "draft", "file"),
    ("F", "flagged", "file"),
    ("P", "passed", "file"),
    ("R", "replied", "file"),
    ("S", "seen", "file"),
    ("T", "trashed", "file"),
    ("N", "new", "dir"),
    ("z", "signed", "content"),
    ("x", "encrypted", "content"),
    ("a", "attach", "content"),
    ("l", "list", "content"),
    ("u", "unread", "pseudo"),
]

# Our own bit encoding: bit i for row i of FLAG_TABLE.
FLAG_BITS = {letter: 1 << i for i, (letter, _, _) in enumerate(FLAG_TABLE)}
FLAG_NAME_BITS = {name: 1 << i for i, (_, name, _) in enumerate(FLAG_TABLE)}
FILE_FLAG_LETTERS = "".join(l for l, _, kind in FLAG_TABLE if kind == "file")

# Field names and their one-letter shortcuts.
FIELD_SHORTCUTS = {
    "h": "bcc", "b": "body", "c": "cc", "d": "date", "e": "embed", "f": "from",
    "j": "file", "g": "flag", "m": "maildir", "v": "list", "y": "mime",
    "i": "msgid", "l": "path", "p": "prio", "r": "refs", "z": "size",
    "s": "subject", "x": "tag", "t": "to",
}

# Field name -> column of the messages table.
FIELD_COLUMNS = {
    "bcc": "bcc", "body": "body_text", "cc": "cc", "date": "date",
    "embed": "embedded_text", "from": "from", "file": "files", "flag": "flags",
    "maildir": "maildir", "list": "mailing_list", "mime": "mimes", "msgid": "msgid",
    "path": "path", "prio": "prio", "refs": "refs", "size": "size",
    "subject": "subject", "tag": "tags", "to": "to", "thread": "thread_id",
}

CONTACT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("full_address", T.StringType()),
])

def field_column(name_or_shortcut: str) -> str:
    """Column name for a field name or one-letter shortcut."""
    name = FIELD_SHORTCUTS.get(name_or_shortcut, name_or_shortcut)
    if name not in FIELD_COLUMNS:
        raise KeyError(f"unknown field {name_or_shortcut!r}")
    return FIELD_COLUMNS[name]
