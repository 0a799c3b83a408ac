"""Bulk changes: table in, new table out, plus a change log (MUT1-MUT8, FN23, FN33).

Files are not touched; the change log (doc_id, path, new_path, op) says what
a file-level executor would rename or delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import flags_delta, is_unread, new_path
from ..functions.people import retag as retag_col

# Named marks -> (flag delta, target folder kind).
MARKS = {
    "refile": ("-N", "refile"),
    "trash": ("+T-N", "trash"),
    "move": ("-N", "move"),
    "flag": ("+F-u-N", None),
    "unflag": ("-F-N", None),
    "read": ("+S-u-N", None),
    "unread": ("-S+u-N", None),
    "untrash": ("-T", None),
    "delete": (None, None),
}


def _safe(sel: Column) -> Column:
    return F.coalesce(sel, F.lit(False))


def _log(before: DataFrame, after: DataFrame, op: str) -> DataFrame:
    return (before.select("doc_id", F.col("path").alias("old_path"))
            .join(after.select("doc_id", F.col("path").alias("new_path")), "doc_id")
            .where(F.col("old_path") != F.col("new_path")).withColumn("op", F.lit(op)))


def set_flags(m: DataFrame, sel: Column, spec: str) -> DataFrame:
    """MUT2: apply a flag delta to the selected messages; the path follows (cur/new)."""
    s = _safe(sel)
    nf = F.when(s, flags_delta("flags", spec)).otherwise(F.col("flags"))
    return m.withColumn("_nf", nf).withColumn(
        "path", F.when(s, new_path("path", "_nf")).otherwise(F.col("path"))).withColumn("flags", F.col("_nf")).drop("_nf")


def move(m: DataFrame, sel: Column, maildir: str, root: str = "/mail", spec: str | None = "-N") -> DataFrame:
    """MUT1: move the selected messages to a folder (and apply the move's flag delta)."""
    s = _safe(sel)
    nf = F.when(s, flags_delta("flags", spec) if spec else F.col("flags")).otherwise(F.col("flags"))
    return (m.withColumn("_nf", nf)
            .withColumn("path", F.when(s, new_path("path", "_nf", maildir, root)).otherwise(F.col("path")))
            .withColumn("maildir", F.when(s, F.lit(maildir)).otherwise(F.col("maildir")))
            .withColumn("flags", F.col("_nf")).drop("_nf"))


def delete(m: DataFrame, sel: Column) -> DataFrame:
    """MUT5."""
    return m.where(~_safe(sel))


def apply_mark(m: DataFrame, sel: Column, mark: str, target: str | None = None, root: str = "/mail") -> DataFrame:
    """MUT3: a named mark on the selected messages."""
    spec, kind = MARKS[mark]
    if mark == "delete":
        return delete(m, sel)
    if kind is not None:
        if target is None:
            raise ValueError(f"mark {mark!r} needs a target folder")
        return move(m, sel, target, root, spec)
    return set_flags(m, sel, spec)


def mark_all_unread_read(m: DataFrame, sel: Column | None = None) -> DataFrame:
    """MUT4: every unread (selected) message becomes read."""
    s = is_unread("flags") if sel is None else (_safe(sel) & is_unread("flags"))
    return set_flags(m, s, MARKS["read"][0])


def mark_read_everywhere(m: DataFrame, msgids: DataFrame, spec: str = "+S-u-N") -> DataFrame:
    """MUT6: every copy of the given message ids (semi-join flag, no driver list)."""
    hit = msgids.select("msgid").distinct().withColumn("_hit", F.lit(True))
    j = m.join(hit, "msgid", "left")
    return set_flags(j, F.col("_hit"), spec).drop("_hit")


def retag(m: DataFrame, sel: Column, spec: str) -> DataFrame:
    """MUT7."""
    return m.withColumn("tags", F.when(_safe(sel), retag_col("tags", spec)).otherwise(F.col("tags")))


def apply_marks(m: DataFrame, marks: DataFrame, root: str = "/mail") -> DataFrame:
    """MUT8: a marks table (doc_id, mark, target) executed in one pass (join + when chain)."""
    j = m.join(marks.select("doc_id", F.col("mark").alias("_mark"), F.col("target").alias("_target")), "doc_id", "left")
    flags = F.col("flags")
    path = F.col("path")
    maildir = F.col("maildir")
    nf_expr = flags
    for name, (spec, _kind) in MARKS.items():
        if spec:
            nf_expr = F.when(F.col("_mark") == name, flags_delta("flags", spec)).otherwise(nf_expr)
    j = j.withColumn("_nf", nf_expr)
    moves = [n for n, (_, k) in MARKS.items() if k is not None]
    is_move = F.col("_mark").isin(*moves)
    j = (j.withColumn("path", F.when(F.col("_mark").isNotNull() & (F.col("_mark") != "delete"),
                                     F.when(is_move, new_path(path, "_nf", F.col("_target"), root))
                                     .otherwise(new_path(path, "_nf"))).otherwise(path))
          .withColumn("maildir", F.when(is_move, F.col("_target")).otherwise(maildir))
          .withColumn("flags", F.col("_nf")))
    return j.where(F.coalesce(F.col("_mark"), F.lit("")) != "delete").drop("_nf", "_mark", "_target")


def change_log(before: DataFrame, after: DataFrame, op: str = "change") -> DataFrame:
    """(doc_id, old_path, new_path, op) for renamed files plus deletions."""
    renamed = _log(before, after, op)
    deleted = (before.join(after.select("doc_id"), "doc_id", "left_anti")
               .select("doc_id", F.col("path").alias("old_path"), F.lit(None).cast("string").alias("new_path"),
                       F.lit("delete").alias("op")))
    return renamed.unionByName(deleted)
