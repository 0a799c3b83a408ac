"""Bulk changes: named marks, moves and the change log."""

from pyspark.sql import functions as F

from postlake.functions.flags import flags_to_string
from postlake.operators import changes as CH
from postlake.schema import FLAG_BITS


def _bits(letters):
    return sum(FLAG_BITS[c] for c in letters)


def _msgs(spark):
    rows = [(1, "/m/inbox/new/a", "/inbox", _bits("N")),
            (2, "/m/inbox/cur/b:2,S", "/inbox", _bits("S")),
            (3, "/m/inbox/cur/c:2,FSx", "/inbox", _bits("FS"))]
    return spark.createDataFrame(rows, "doc_id bigint, path string, maildir string, flags int")


def _state(df):
    return {r["doc_id"]: (r["path"], r["f"], r["maildir"])
            for r in df.select("doc_id", "path", "maildir", flags_to_string("flags").alias("f")).collect()}


def test_read_mark_moves_new_to_cur(spark):
    out = _state(CH.apply_mark(_msgs(spark), F.col("doc_id") == 1, "read"))
    assert out[1] == ("/m/inbox/cur/a:2,S", "S", "/inbox")


def test_trash_moves_and_flags(spark):
    out = _state(CH.apply_mark(_msgs(spark), F.col("doc_id") == 3, "trash", "/trash", root="/m"))
    assert out[3] == ("/m/trash/cur/c:2,FSTx", "FST", "/trash")  # custom flag letter kept


def test_unread_and_delete(spark):
    m = _msgs(spark)
    out = _state(CH.apply_mark(m, F.col("doc_id") == 2, "unread"))
    assert out[2][1] == "u"  # the unread mark sets the pseudo flag; S is gone
    assert CH.apply_mark(m, F.col("doc_id") == 2, "delete").count() == 2


def test_apply_marks_table_and_log(spark):
    m = _msgs(spark)
    marks = spark.createDataFrame([(1, "flag", None), (2, "delete", None), (3, "move", "/archive")],
                                  "doc_id bigint, mark string, target string")
    after = CH.apply_marks(m, marks, root="/m")
    out = _state(after)
    assert set(out) == {1, 3}
    assert out[1] == ("/m/inbox/cur/a:2,F", "F", "/inbox")
    assert out[3] == ("/m/archive/cur/c:2,FSx", "FS", "/archive")
    log = {r["doc_id"]: r["op"] for r in CH.change_log(m, after, "marks").collect()}
    assert log == {1: "marks", 2: "delete", 3: "marks"}


def test_retag(spark):
    df = spark.createDataFrame([(1, ["b", "a"])], "doc_id bigint, tags array<string>")
    out = CH.retag(df, F.lit(True), "+c,-a,b").first()["tags"]
    assert out == ["b", "c"]
