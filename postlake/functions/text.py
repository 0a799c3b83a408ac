"""Text scalars (Column -> Column), all JVM-side built-ins.

Covers flatten/clean/ctrl stripping, tokens, subjects, summaries, URLs,
quoting and splitting.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to one ASCII letter instead of their
# decomposition (lower-case forms, applied after lower()).
SPECIAL_FOLDS = {"æ": "e", "ø": "o", "đ": "d"}

# Token boundary: anything that is not a letter or a digit.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _fold_maps() -> tuple[dict[str, str], dict[str, str]]:
    """Letters (after lower()) by what they fold to, from Unicode data: NFKD, marks dropped, lower case.
    First the folds to one character, then those to none or several; Hangul syllables stay whole."""
    one, more = {}, {}
    for cp in range(0xA0, 0x30000):
        ch = chr(cp)
        if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xE000 or unicodedata.category(ch)[0] == "M" or ch.lower() != ch:
            continue
        folded = SPECIAL_FOLDS.get(ch) or "".join(
            c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).lower()) if not unicodedata.combining(c))
        if folded != ch:
            (one if len(folded) == 1 else more)[ch] = folded
    return one, more


_ONE, _MORE = _fold_maps()
FOLD_FROM, FOLD_TO = "".join(_ONE), "".join(_ONE.values())
MORE_FROM, MORE_TO = "".join(_MORE), "\n".join(_MORE.values())


def _char_class(letters: str) -> str:
    """A regular expression for one of ``letters``, as ranges; plain ASCII fails at its first test."""
    ranges: list[list[int]] = []
    for cp in map(ord, letters):
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return r"[[^\x00-\x7F]&&[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]]"


MORE_CLASS = _char_class(MORE_FROM)


def flatten(c: Column | str) -> Column:
    """FN1: lower case, accents removed, æ->e ø->o đ->d, compatibility forms (ligatures, full-width
    letters, fractions) unfolded.

    One ``translate`` with the one-to-one folds, then each letter with a longer fold that the text
    has, if any, is replaced, then combining marks are removed."""
    c = F.col(c) if isinstance(c, str) else c
    unfold = lambda letter: F.element_at(F.split(F.lit(MORE_TO), "\n"), F.position(letter, F.lit(MORE_FROM)))
    one = F.transform(F.array(F.translate(F.lower(c), FOLD_FROM, FOLD_TO)), lambda t: F.aggregate(
        F.array_distinct(F.regexp_extract_all(t, F.lit(MORE_CLASS), F.lit(0))), t,
        lambda text, letter: F.replace(text, letter, unfold(letter))))
    return F.regexp_replace(F.get(one, 0), r"\p{M}+", "")


def flatten_py(s: str | None) -> str | None:
    """Driver-side twin of :func:`flatten` for literal query words (same steps)."""
    if s is None:
        return None
    folded = (_ONE.get(ch) or _MORE.get(ch, ch) for ch in s.lower())
    return "".join(ch for ch in "".join(folded) if not unicodedata.category(ch).startswith("M"))


def tokens(c: Column | str) -> Column:
    """Flattened word tokens of a text column (empty tokens dropped)."""
    return F.filter(F.split(flatten(c), TOKEN_SPLIT), lambda t: t != "")


def clean(c: Column | str) -> Column:
    """FN2: control characters become spaces, then trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"\p{Cc}", " "))


def remove_ctrl(c: Column | str) -> Column:
    """FN3: each run of control characters and spaces becomes one space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"[\p{Cc} ]+", " ")


def strip_ctrl(c: Column | str) -> Column:
    """FN4: white space becomes a space one for one; other controls dropped."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, r"[\t\n\r\f\x0B]", " "), r"\p{Cc}", "")


def asciify(c: Column | str) -> Column:
    """FN5: every non-printable-ASCII character becomes '.'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"[^\x20-\x7E]", ".")


def utf8ify(c: Column | str) -> Column:
    """FN5 on bytes: their text if they are UTF-8, else each byte that is neither printable ASCII nor white space as '.'."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(F.decode(c, "ISO-8859-1"), r"[^\x20-\x7E\t\n\x0B\f\r]", ".")
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(plain)


def split_list(c: Column | str, sep: str = ",", strip: bool = True) -> Column:
    """FN6: split on a literal separator, optionally trimming each item."""
    c = F.col(c) if isinstance(c, str) else c
    import re
    parts = F.split(c, re.escape(sep))
    return F.transform(parts, lambda x: F.trim(x)) if strip else parts


def join_list(c: Column | str, sep: str = ",") -> Column:
    """FN6: join a list column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c, sep)


def quote(c: Column | str) -> Column:
    """FN7: backslash-escape backslashes and double quotes, wrap in quotes."""
    c = F.col(c) if isinstance(c, str) else c
    esc = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"')
    return F.concat(F.lit('"'), esc, F.lit('"'))


def summarize(c: Column | str, max_lines: int) -> Column:
    """FN8: the first ``max_lines`` lines, white space runs collapsed, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    head = F.array_join(F.slice(F.split(c, "\n"), 1, max_lines), "\n")
    return F.trim(F.regexp_replace(head, r"[ \t\r\n]+", " "))


# Fixed value: reply/forward prefixes stripped from subjects (nested, with [n]).
SUBJECT_PREFIX = r"(?i)^\s*((re|fwd?)(\[\d+\])?\s*:\s*)+"


def subject_normalize(c: Column | str) -> Column:
    """FN9: subject without leading Re:/Fwd:/Re[2]: prefixes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, SUBJECT_PREFIX, "")


def subject_tail(c: Column | str) -> Column:
    """FN10: text after the last ':' and the spaces that follow it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.instr(c, ":") == 0, c).otherwise(F.regexp_replace(c, r"(?s)^.*: *", ""))


def line_count(c: Column | str) -> Column:
    """FN36: number of newline characters."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("bigint")


URL_PATTERN = r"((https?://|mailto:)[^\s<>\"'()]+)"


def urls(c: Column | str) -> Column:
    """FN37: array of http(s) and mailto URLs in order of appearance."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(c, F.lit(URL_PATTERN), 1)


def strip_html(c: Column | str) -> Column:
    """HTML to text: drop script/style blocks and tags, decode basic entities,
    collapse white space."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))
