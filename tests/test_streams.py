"""Streams: epoch store upserts across micro-batches; dedupe keeps one copy per id."""

import datetime as dt
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postlake.session import scratch_path
from postlake.sources import maildir as MD
from postlake.sources.store import KeyedStore
from postlake.streaming import streams as S
from postlake.streaming.source import MaildirStreamReader


def _two_batches(spark):
    d = tempfile.mkdtemp(prefix="postlake-stream-")
    b1 = [("a", 1, dt.datetime(2024, 1, 1, 0, 0)), ("b", 1, dt.datetime(2024, 1, 1, 0, 1))]
    b2 = [("a", 2, dt.datetime(2024, 1, 1, 0, 2)), ("c", 1, dt.datetime(2024, 1, 1, 0, 3))]
    schema = "key string, v int, ts timestamp"
    spark.createDataFrame(b1, schema).coalesce(1).write.parquet(f"{d}/part1")
    spark.createDataFrame(b2, schema).coalesce(1).write.parquet(f"{d}/part2")
    return d, schema


def test_epoch_store_latest_per_key(spark):
    d, schema = _two_batches(spark)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(d)
    store = S.EpochStore(spark, scratch_path(spark, "t-store"), key="key")
    S._run(s.writeStream.foreachBatch(lambda b, e: store.write(b, e)), "t-store", spark)
    assert len(store.epochs) == 2
    latest = {r["key"]: r["v"] for r in store.read_latest().collect()}
    assert latest == {"a": 2, "b": 1, "c": 1}


def test_stream_dedupe_one_per_key(spark):
    d, schema = _two_batches(spark)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(d)
    out = S.collect_stream(spark, S.stream_dedupe(s, "key", "ts", "1 day"), "t-dedupe")
    keys = sorted(r["key"] for r in out.collect())
    assert keys == ["a", "b", "c"]
    assert out.where(F.col("key") == "a").first()["v"] == 1  # the first copy wins


def _mail(root, rel, k):
    os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
    with open(f"{root}/{rel}", "wb") as fh:
        fh.write(b"Message-Id: <m%d@x>\n\nbody\n" % k)


def _files(base):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{base}/rows/_bucket=*/part-*")}


def test_stream_index_resumes(spark, monkeypatch):
    r, out = tempfile.mkdtemp(prefix="postlake-res-"), tempfile.mkdtemp(prefix="postlake-res-out-")
    read = []
    real = S.read_files
    monkeypatch.setattr(S, "read_files", lambda files: (read.append(sorted(x["path"][len(r):] for x in files.select("path").collect())), real(files))[1])
    names = ["cur/1:2,S", ".Work.Sub/new/2", "deep/er/cur/3:2,FS", "cur/4:2,"]
    for k, name in enumerate(names, 1):
        _mail(r, name, k)
        before = _files(f"{out}/store")
        got = S.stream_index(spark, r, store_path=f"{out}/store", checkpoint=f"{out}/ckpt", settle=0)
        assert sorted(x["msgid"] for x in got.collect()) == [f"m{j}@x" for j in range(1, k + 1)]
        after = _files(f"{out}/store")
        assert len(set(after) - set(before)) == 1 and len(set(before) - set(after)) <= 1  # one bucket is written
    assert read == [["/" + n] for n in names]  # each run reads the new file only
    S.stream_index(spark, r, store_path=f"{out}/store", checkpoint=f"{out}/ckpt", settle=0)
    assert _files(f"{out}/store") == after and read[4:] in ([], [[]])
    batch = MD.index_maildir(spark, r)
    key = lambda df: sorted((x["path"], x["msgid"], x["maildir"], x["flags"], x["size"]) for x in df.collect())
    assert key(batch) == key(KeyedStore(spark, f"{out}/store").read())


def test_stream_skips_marked_folders_and_names_a_missing_root(spark):
    r = tempfile.mkdtemp(prefix="postlake-mark-")
    for k, d in enumerate(("a/cur", "skip/cur", "skip/below/cur", "frozen/new", "half/cur")):
        _mail(r, f"{d}/{k}", k)
    for f in ("skip/.noindex", "frozen/.noupdate", "half/cur/.noindex"):
        open(f"{r}/{f}", "w").close()
    ids = lambda **o: sorted(x["msgid"] for x in S.stream_index(spark, r, settle=0, **o).collect())
    assert ids() == ["m0@x"] and ids(full=True) == ["m0@x", "m3@x"]
    with pytest.raises(Exception, match="not a folder"):
        S.stream_index(spark, f"{r}/misspelt", settle=0)


def test_stream_parts_cover_the_tree():
    r = tempfile.mkdtemp(prefix="postlake-parts-")
    for k in range(30):
        _mail(r, f"top/d{k % 3}/e{k}/cur/{k}", k)
    _mail(r, "cur/30", 30)
    for parts in (1, 4, 64):
        reader = MaildirStreamReader({"path": r, "settle": "0", "parts": str(parts)})
        end = reader.latestOffset()
        some = reader.partitions({"ns": 0}, end)
        paths = [p for part in some for b in reader.read(part) for p in b.column("path").to_pylist()]
        assert len(paths) == len(set(paths)) == 31 and len(some) <= 2 * parts
        assert [b for part in reader.partitions(end, end) for b in reader.read(part)] == []


def test_first_copies_stay_whatever_comes_later(spark):
    folder, out = tempfile.mkdtemp(prefix="postlake-first-"), tempfile.mkdtemp(prefix="postlake-first-out-")
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batches = [[("a", 1, day(0)), ("a", 2, day(-1)), ("b", 1, day(0)), (None, 1, day(0))], [("c", 1, day(50)), ("a", 3, day(50))], [("a", 4, day(-9)), ("b", 5, day(400)), ("d", 1, day(0))]]
    schema = "key string, v int, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{k}")
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
        got = S.stream_first_copies(spark, s, "key", "ts", f"{out}/store", f"{out}/ckpt")
    assert {(r["key"], r["v"]) for r in got.collect()} == {("a", 2), ("b", 1), ("c", 1), ("d", 1)}


def test_table_functions_on_batches(spark):
    from postlake.functions import udfs as U
    rows = [(k, t, [("from", "N", f"e{k}@x")] * (k % 3), [(1, "text/plain", k, None, "f")] if k % 2 else None) for k, t in enumerate(["One, two", None, "", "  ÉTÉ x1", "..."] * 40)]
    m = spark.createDataFrame(rows, "doc_id long, text string, contacts array<struct<type string, name string, email string>>, "
                                    "parts array<struct<index int, mime_type string, size long, disposition string, filename string>>").repartition(3)
    tokens = {tuple(r) for r in U.MessageTokens(m.select("doc_id", "text").asTable()).collect()}
    plain = {0: ["one", "two"], 3: ["été", "x1"]}
    assert tokens == {(k, p, w) for k in range(200) for p, w in enumerate(plain.get(k % 5, []))}
    contacts = U.MessageContacts(m.asTable()).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in contacts} == {k: k % 3 for k in range(200) if k % 3}
    parts = {tuple(r) for r in U.MessageParts(m.asTable()).collect()}
    assert parts == {(k, 1, "text/plain", k, None, "f") for k in range(200) if k % 2}
