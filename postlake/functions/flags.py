"""Flag bitsets: letters, names, deltas, paths (FN16-FN21, FN23, FLT14/15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FILE_FLAG_LETTERS, FLAG_BITS, FLAG_NAME_BITS, FLAG_TABLE


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def flag_bit(flag: str) -> int:
    """Bit for a flag letter or name (letters match case-blind when unambiguous)."""
    if flag in FLAG_BITS:
        return FLAG_BITS[flag]
    if flag.lower() in FLAG_NAME_BITS:
        return FLAG_NAME_BITS[flag.lower()]
    for letter, bit in FLAG_BITS.items():
        if letter.lower() == flag.lower():
            return bit
    raise KeyError(f"unknown flag {flag!r}")


def flags_mask(letters: str, kinds: tuple[str, ...] | None = None) -> int:
    """Driver-side: bits of the known letters in a string; unknown letters ignored."""
    out = 0
    for letter, _, kind in FLAG_TABLE:
        if letter in letters and (kinds is None or kind in kinds):
            out |= FLAG_BITS[letter]
    return out


def has_flag(flags: Column | str, flag: str) -> Column:
    """FLT14; ``unread`` is new or not seen, as no file holds it."""
    if flag.lower() == "unread":
        return is_unread(flags)
    return (_col(flags).bitwiseAND(F.lit(flag_bit(flag))) != 0)


def is_unread(flags: Column | str) -> Column:
    """FLT15: new, or not seen."""
    f = _col(flags)
    return (f.bitwiseAND(F.lit(FLAG_BITS["N"])) != 0) | (f.bitwiseAND(F.lit(FLAG_BITS["S"])) == 0)


def _table(kinds: tuple[str, ...] | None) -> Column:
    """The flag table as a literal array of (letter, bit) structs. Used through
    higher-order functions, so the input expression appears once in the tree
    (nesting these functions does not multiply generated code)."""
    return F.array(*[F.struct(F.lit(l).alias("l"), F.lit(FLAG_BITS[l]).alias("b"))
                     for l, _, kind in FLAG_TABLE if kinds is None or kind in kinds])


def flags_to_string(flags: Column | str, kinds: tuple[str, ...] | None = None) -> Column:
    """FN16: letters of the set bits in table order."""
    f = _col(flags)
    hits = F.filter(_table(kinds), lambda x: f.bitwiseAND(x["b"]) != 0)
    return F.array_join(F.transform(hits, lambda x: x["l"]), "")


def flags_from_string(s: Column | str, kinds: tuple[str, ...] | None = None) -> Column:
    """FN17: bitset of the flag letters in a string; unknown letters ignored."""
    s = _col(s)
    hits = F.filter(_table(kinds), lambda x: F.instr(s, x["l"]) > 0)
    return F.aggregate(hits, F.lit(0), lambda acc, x: acc.bitwiseOR(x["b"])).cast("int")


def parse_delta(spec: str) -> tuple[int, int]:
    """Driver-side: '+S-u-N' -> (bits to add, bits to remove)."""
    add = rem = 0
    sign = None
    for ch in spec:
        if ch in "+-":
            sign = ch
            continue
        if sign is None or ch not in FLAG_BITS:
            continue
        if sign == "+":
            add |= FLAG_BITS[ch]
        else:
            rem |= FLAG_BITS[ch]
    return add, rem


def flags_delta(flags: Column | str, spec: str) -> Column:
    """FN18: apply '+X-Y' to a bitset column."""
    add, rem = parse_delta(spec)
    return _col(flags).bitwiseOR(F.lit(add)).bitwiseAND(F.lit(~rem & 0x7FFFFFFF)).cast("int")


def custom_flags(s: Column | str) -> Column:
    """FN19: the letters of an info string that are not file flags."""
    return F.regexp_replace(_col(s), f"[{FILE_FLAG_LETTERS}]", "")


# maildir info part: separator ':' '!' or ';' then "2," then letters
INFO_RX = r"[:!;]2,([^/]*)$"


def flags_from_path(path: Column | str) -> Column:
    """FN20: 'new' directory -> N only; else file-flag letters after ':2,'."""
    p = _col(path)
    info = F.regexp_extract(p, INFO_RX, 1)
    return (F.when(p.rlike(r"/new/[^/]+$"), F.lit(FLAG_BITS["N"]))
            .otherwise(flags_from_string(info, ("file",)))).cast("int")


def flag_names(flags: Column | str) -> Column:
    """FN21: array of flag names, table order."""
    f = _col(flags)
    arr = F.array(*[F.when(f.bitwiseAND(F.lit(FLAG_BITS[l])) != 0, F.lit(name))
                    for l, name, _ in FLAG_TABLE if l != "u"])
    return F.filter(arr, lambda x: x.isNotNull())


def maildir_from_path(path: Column | str, root: str) -> Column:
    """FN22: folder of a message file relative to the root ('/' for the root)."""
    import re
    rx = "^" + re.escape(root.rstrip("/")) + r"(/.*)?/(cur|new)/[^/]+$"
    m = F.regexp_extract(_col(path), rx, 1)
    return F.when(m == "", F.lit("/")).otherwise(m)


def new_path(path: Column | str, flags: Column | str, new_maildir: Column | str | None = None,
             root: str | None = None) -> Column:
    """FN23: path after a flag change and/or move.

    N set -> <dir>/new/<base>; else <dir>/cur/<base><sep>2,<file flags><custom flags>.
    The separator and custom flag letters of the old name are kept.
    """
    p = _col(path)
    f = _col(flags)
    mdir = F.regexp_extract(p, r"^(.*)/(cur|new)/[^/]+$", 1)
    if new_maildir is not None:
        nm = F.lit(new_maildir) if isinstance(new_maildir, str) else new_maildir
        mdir = F.concat(F.lit((root or "").rstrip("/")), nm) if root is not None else nm
    base = F.regexp_extract(p, r"/([^/]+)$", 1)
    sep = F.regexp_extract(base, r"([:!;])2,[^/]*$", 1)
    stem = F.regexp_replace(base, r"[:!;]2,[^/]*$", "")
    custom = custom_flags(F.regexp_extract(base, r"[:!;]2,([^/]*)$", 1))
    sep = F.when(sep == "", F.lit(":")).otherwise(sep)
    is_new = f.bitwiseAND(F.lit(FLAG_BITS["N"])) != 0
    return F.when(is_new, F.concat(mdir, F.lit("/new/"), stem)).otherwise(
        F.concat(mdir, F.lit("/cur/"), stem, sep, F.lit("2,"), flags_to_string(f, ("file",)), custom))
