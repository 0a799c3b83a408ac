"""File ingest: maildir written from the conversations table, scanned and parsed."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postlake.sources import incremental as INC
from postlake.sources import maildir as MD
from postlake.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver test data not present")
    r = tempfile.mkdtemp(prefix="postlake-md-")
    MD.write_files(T.rfc822_from_conversations(spark, SF).select("relpath", "content"), r)
    os.makedirs(f"{r}/hidden/cur")
    open(f"{r}/hidden/.noindex", "w").close()
    with open(f"{r}/hidden/cur/x!2,S", "wb") as fh:
        fh.write(b"Message-Id: <x@y>\nSubject: hidden\n\nbody\n")
    return r


def test_index_counts_and_fields(spark, root):
    n = spark.read.parquet(f"{SF}/conversations.parquet").count()
    m = MD.index_maildir(spark, root).cache()
    assert m.count() == n
    assert m.where(F.col("subject") == "hidden").count() == 0
    row = m.where(F.size("parts") == 2).first()
    assert row["flags"] & 512  # attach flag from content
    assert set(m.select("maildir").distinct().toPandas()["maildir"]) == {"/inbox", "/.Sent"}
    assert m.where(F.col("path").contains(":2,")).count() > 0
    assert m.where(F.col("msgid").isNull()).count() == 0


def test_cap_size_and_markers(spark, root):
    files = MD.scan_maildir(spark, root)
    assert MD.cap_size(files, 0).count() == 0
    paths = files.select("path").union(spark.createDataFrame([(f"{root}/hidden/cur/x!2,S",)], "path string"))
    assert files.where(F.col("path").contains("/hidden/")).count() == 0
    marks = MD.marker_dirs(paths)
    assert [r["dir"] for r in marks.collect()] == [f"{root}/hidden"]
    assert MD.marker_dirs(paths, full=True).count() == 1
    assert MD.exclude_dirs(paths, marks).count() == files.count()


def test_incremental_listing(spark, root):
    files = MD.scan_maildir(spark, root).select("path", "mtime")
    store = files.orderBy("path").limit(10)
    changed = INC.new_or_changed(files, store)
    assert changed.count() == files.count() - 10
    kept, removed = INC.cleanup_missing(store, files.orderBy("path").limit(5))
    assert kept.count() + removed.count() == 10


def test_distributed_walk_nested_and_noupdate(spark):
    r = tempfile.mkdtemp(prefix="postlake-walk-")
    msg = b"Message-Id: <w@x>\nSubject: s\n\nbody\n"
    for d in ("top/cur", "top/deep/sub/new", "frozen/cur", "skip/cur"):
        os.makedirs(f"{r}/{d}")
        with open(f"{r}/{d}/m1!2,S", "wb") as fh:
            fh.write(msg)
    open(f"{r}/frozen/.noupdate", "w").close()
    open(f"{r}/skip/.noindex", "w").close()
    dirs = lambda full: sorted(x["dir"][len(r):] for x in MD.list_folders(spark, r, full).collect())
    assert dirs(False) == ["/top", "/top/deep/sub"]
    assert dirs(True) == ["/frozen", "/top", "/top/deep/sub"]
    assert MD.index_maildir(spark, r, full=True).count() == 3


NESTED = b"""Message-Id: <outer@x>
Subject: outer
Precedence: fm-user
X-Priority: 1
Keywords: red green
X-Feed2Imap-Version: 1
Content-Type: multipart/mixed; boundary="b"

--b
Content-Type: text/plain

outer text
--b
Content-Type: message/rfc822

From: Ann <ann@x>
To: Bob <bob@x>
Subject: inner subject
Content-Type: text/plain

inner text
--b--
"""
SIGNED = b"""Message-Id: <feed-7@x>
X-Feed2Imap-Version: 1
References: <r1@x> <r2@x>
In-Reply-To: <r2@x> <r3@x>
Content-Type: multipart/signed; boundary="b"

--b
Content-Type: text/html

<p>hello</p>
--b
Content-Type: application/pgp-signature; name="s.asc"
Content-Disposition: inline

xx
--b--
"""


def _write(root, rel, data):
    os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
    with open(f"{root}/{rel}", "wb") as fh:
        fh.write(data)


def test_nested_and_signed_messages(spark):
    r = tempfile.mkdtemp(prefix="postlake-nest-")
    _write(r, ".Sent/cur/1:2,S", NESTED)
    _write(r, "cur/2:2,F", SIGNED)
    m = {x["msgid"]: x for x in MD.index_maildir(spark, r).collect()}
    outer, signed = m["outer@x"], m["feed-7@x"]
    assert outer["body_text"].strip() == "outer text" and outer["maildir"] == "/.Sent"
    assert outer["embedded_text"].split("\n")[:4] == ["Ann <ann@x>", "inner subject", "Bob <bob@x>", "inner text"]
    assert [p["mime_type"] for p in outer["parts"]] == ["text/plain", "message/rfc822"]
    assert outer["prio"] == "normal" and outer["tags"] == ["red", "green"] and outer["mailing_list"] is None
    assert signed["flags"] & 512 == 0 and signed["flags"] & 2 and signed["mailing_list"] == "feed"
    assert signed["refs"] == ["r1@x", "r2@x", "r3@x"] and signed["body_html"].startswith("<p>")


def test_update_store(spark):
    r, out = tempfile.mkdtemp(prefix="postlake-upd-"), tempfile.mkdtemp(prefix="postlake-upd-out-")
    for k in range(4):
        _write(r, f"cur/{k}:2,S", b"Message-Id: <m%d@x>\nSubject: s%d\n\nbody\n" % (k, k))
    counts = lambda df: tuple(df.first())
    assert counts(INC.update_store(spark, r, None, f"{out}/v1")) == (4, 4, 0)
    one = spark.read.parquet(f"{out}/v1")
    os.remove(f"{r}/cur/0:2,S")
    _write(r, "cur/1:2,S", b"Message-Id: <m1@x>\nSubject: changed\n\nbody\n")
    os.utime(f"{r}/cur/1:2,S", (2e9, 2e9))
    _write(r, ".New/new/9", b"Message-Id: <m9@x>\nSubject: s9\n\nbody\n")
    assert counts(INC.update_store(spark, r, one, f"{out}/v2")) == (4, 2, 1)
    two = spark.read.parquet(f"{out}/v2")
    assert {(x["msgid"], x["subject"]) for x in two.collect()} == {("m1@x", "changed"), ("m2@x", "s2"), ("m3@x", "s3"), ("m9@x", "s9")}
    assert counts(INC.update_store(spark, r, two, f"{out}/v3")) == (4, 0, 0)
    assert spark.read.parquet(f"{out}/v3").count() == 4
