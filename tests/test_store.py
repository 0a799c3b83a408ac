"""Stores updated in place, and archives with bad mail, markers and folders that vanish."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postlake.sources import incremental as INC
from postlake.sources import maildir as MD
from postlake.sources.store import KeyedStore


def _write(root, rel, data):
    os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
    with open(f"{root}/{rel}", "wb") as fh:
        fh.write(data)


def _mail(root, rel, k, subject="s"):
    _write(root, rel, b"Message-Id: <m%d@x>\nSubject: %s\n\nbody\n" % (k, subject.encode()))


def _files(base):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{base}/rows/_bucket=*/part-*")}


def _ids(store):
    return sorted(r["msgid"] for r in store.read().collect())


# the store

def test_upsert_writes_touched_buckets_only(spark):
    base = tempfile.mkdtemp(prefix="postlake-store-")
    store = KeyedStore(spark, f"{base}/t", key="k", buckets=16)
    assert store.read() is None and store.upsert(spark.createDataFrame([], "k string, v int")) == []
    rows = spark.createDataFrame([(f"key{i}", i) for i in range(200)], "k string, v int")
    assert len(store.upsert(rows)) == 16 and store.read().count() == 200
    before = _files(f"{base}/t")
    assert len(store.upsert(spark.createDataFrame([("key7", 700)], "k string, v int"))) == 1
    after = _files(f"{base}/t")
    assert len(set(before) - set(after)) == len(set(after) - set(before)) == 1
    got = {r["k"]: r["v"] for r in store.read().collect()}
    assert got == {f"key{i}": 700 if i == 7 else i for i in range(200)}
    again = KeyedStore(spark, f"{base}/t", key="k", buckets=99)  # the store's own number of buckets holds
    assert again.buckets == 16 and not again.dirty


def test_upsert_newest_removed_and_null_keys(spark):
    store = KeyedStore(spark, f"{tempfile.mkdtemp(prefix='postlake-store-')}/t", key="k", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, w int")
    store.upsert(frame([("a", 1, 1), ("a", 2, 5), ("a", 3, 2), ("b", 1, 1), (None, 9, 9)]), newest="w")
    assert {(r["k"], r["v"]) for r in store.read().collect()} == {("a", 2), ("b", 1)}
    store.upsert(frame([("c", 1, 1)]), removed=spark.createDataFrame([("a",), ("zz",), (None,)], "k string"))
    assert {(r["k"], r["v"]) for r in store.read().collect()} == {("b", 1), ("c", 1)}
    store.upsert(frame([]), removed=store.read().select("k"))
    assert store.read().count() == 0  # buckets without a row are empty, not old
    store.upsert(frame([("a", 8, 1)]))
    assert [tuple(r) for r in store.read().collect()] == [("a", 8, 1)]


# the index run on a store

def _refresh(spark, root, base, **options):
    return INC.refresh_store(spark, root, KeyedStore(spark, base), **({"settle": 0} | options)).first().asDict()


def test_refresh_reads_and_writes_what_changed(spark):
    r, base = tempfile.mkdtemp(prefix="postlake-ref-"), tempfile.mkdtemp(prefix="postlake-ref-out-") + "/store"
    for k in range(40):
        _mail(r, f"d{k % 4}/cur/{k}:2,S", k)
    assert _refresh(spark, r, base) == {"folders": 8, "listed": 8, "processed": 40, "updated": 40, "removed": 0}
    before = _files(base)
    none = _refresh(spark, r, base)
    assert (none["updated"], none["removed"]) == (0, 0) and none["listed"] == 4  # new/ is missing in each; cur isn't listed
    assert _files(base) == before
    _mail(r, "d1/cur/99:2,S", 99)
    one = _refresh(spark, r, base)
    assert (one["updated"], one["processed"]) == (1, 11) and len(set(_files(base)) - set(before)) == 1
    os.remove(f"{r}/d2/cur/2:2,S")
    assert _refresh(spark, r, base)["removed"] == 1
    for name in os.listdir(f"{r}/d3/cur"):
        os.remove(f"{r}/d3/cur/{name}")
    os.rmdir(f"{r}/d3/cur")
    assert _refresh(spark, r, base)["removed"] == 10
    left = sorted({f"m{k}@x" for k in range(40) if k % 4 != 3 and k != 2} | {"m99@x"})
    assert _ids(KeyedStore(spark, base)) == left
    # a change in place leaves the folder's stamp: found without lazy
    _mail(r, "d0/cur/0:2,S", 0, "other")
    os.utime(f"{r}/d0/cur/0:2,S", (2e9, 2e9))
    assert _refresh(spark, r, base)["updated"] == 0
    assert _refresh(spark, r, base, lazy=False)["updated"] == 1
    assert KeyedStore(spark, base).read().where("subject = 'other'").count() == 1


def test_refresh_after_half_an_update_lists_all(spark):
    r, base = tempfile.mkdtemp(prefix="postlake-half-"), tempfile.mkdtemp(prefix="postlake-half-out-") + "/store"
    for k in range(6):
        _mail(r, f"cur/{k}:2,S", k)
    _refresh(spark, r, base)
    for p in _files(base):  # a driver that died between dropping buckets and putting the new ones in place
        os.remove(p)
    KeyedStore(spark, base)._mark(True)
    _mail(r, "cur/6:2,S", 6)
    got = _refresh(spark, r, base)
    assert got["updated"] == 7 and _ids(KeyedStore(spark, base)) == [f"m{k}@x" for k in range(7)]


def test_young_stamps_are_not_relied_on(spark):
    r, base = tempfile.mkdtemp(prefix="postlake-young-"), tempfile.mkdtemp(prefix="postlake-young-out-") + "/store"
    _mail(r, "cur/1", 1)
    _refresh(spark, r, base, settle=3600)
    assert _refresh(spark, r, base, settle=3600)["listed"] == 2
    os.utime(f"{r}/cur", (1e9, 1e9))
    _refresh(spark, r, base, settle=3600)
    assert _refresh(spark, r, base, settle=3600)["listed"] == 1


@pytest.mark.parametrize("in_place", [True, False])
def test_markers_and_wrong_roots_remove_nothing(spark, in_place):
    r, out = tempfile.mkdtemp(prefix="postlake-keep-"), tempfile.mkdtemp(prefix="postlake-keep-out-")
    for k, d in enumerate(("a/cur", "b/cur", "b/below/new", "c/cur", "d/cur")):
        _mail(r, f"{d}/{k}", k)
    open(f"{r}/d/.noupdate", "w").close()
    step = [0]

    def run(root):
        if in_place:
            INC.refresh_store(spark, root, KeyedStore(spark, f"{out}/store"), settle=0)
            return _ids(KeyedStore(spark, f"{out}/store"))
        old = spark.read.parquet(f"{out}/v{step[0]}") if step[0] else None
        INC.update_store(spark, root, old, f"{out}/v{step[0] + 1}")
        step[0] += 1
        return sorted(x["msgid"] for x in spark.read.parquet(f"{out}/v{step[0]}").collect())

    assert run(r) == ["m0@x", "m1@x", "m2@x", "m3@x", "m4@x"]  # the first index is a full one
    open(f"{r}/b/.noupdate", "w").close()
    open(f"{r}/c/cur/.noindex", "w").close()
    os.remove(f"{r}/a/cur/0")
    _mail(r, "b/cur/7", 7)
    assert run(r) == ["m1@x", "m2@x", "m3@x", "m4@x"]  # only the file that is gone; nothing new from marked folders
    with pytest.raises(FileNotFoundError):
        run(f"{r}/misspelt")
    with pytest.raises(FileNotFoundError):
        MD.index_maildir(spark, f"{r}/misspelt")
    assert run(r) == ["m1@x", "m2@x", "m3@x", "m4@x"]


def test_size_cap_keeps_stored_messages(spark):
    r, out = tempfile.mkdtemp(prefix="postlake-cap-"), tempfile.mkdtemp(prefix="postlake-cap-out-")
    _mail(r, "cur/1", 1)
    INC.refresh_store(spark, r, KeyedStore(spark, f"{out}/s"), settle=0)
    got = INC.refresh_store(spark, r, KeyedStore(spark, f"{out}/s"), max_size=3, lazy=False).first()
    assert got["removed"] == 0 and _ids(KeyedStore(spark, f"{out}/s")) == ["m1@x"]


# mail as strangers send it

BAD = {
    "id8bit": b"Message-Id: <caf\xe9@x>\nSubject: id\n\nbody\n",
    "cid8bit": b"Message-Id: <cid@x>\nContent-Type: text/plain\nContent-Id: <\xff\xfe>\n\nbody\n",
    "idna": b"Message-Id: <idna@x>\nContent-Type: text/plain; charset=idna\n\nb\xc3\xb6dy\n",
    "nul": b"Message-Id: <nul@x>\nContent-Type: text/plain; charset=\"utf\x00-8\"\n\nbody\n",
    "surrogate": b"Message-Id: <sur@x>\nContent-Type: text/plain; charset=unicode_escape\n\n\\ud800 body\n",
    "hex": b"Message-Id: <hex@x>\nContent-Type: text/plain; charset=hex\n\nbody\n",
    "broken-list": b"Message-Id: <list@x>\nFrom: a@x\nTo: ok@x.org, Bob <bob@x.org> (, carol@x\nCc: dan@x.org\n\nbody\n",
    "comma": b"Message-Id: <comma@x>\nFrom: =?utf-8?q?A=2C_B?= <z@y>\nTo: \"Last, First\" <lf@y>\n\nbody\n",
    "name8bit": b"Message-Id: <n8@x>\nFrom: J\xf6rg <j@x>\nSubject: \xe9t\xe9 =?nonsense?q?x?= =?utf-8?b?!!!?=\n\nbody\n",
    "address8bit": b"Message-Id: <a8@x>\nFrom: Joe <j\xf6@x>\n\nbody\n",
    "rfc2231": b"Message-Id: <p@x>\nContent-Type: text/plain; charset=utf-8; name*=utf-8''na%C3%AFve.txt; x*0=one; x*1=two\n\nbody\n",
    "date": b"Message-Id: <old@x>\nDate: Mon, 01 Jan 0001 00:00:00 +1400\n\nbody\n",
    "future": b"Message-Id: <far@x>\nDate: Fri, 31 Dec 9999 23:59:59 -1200\n\nbody\n",
    "year": b"Message-Id: <y@x>\nDate: Fri, 31 Dec 8999 23:59:59 +0000\n\nbody\n",
    "base64": b"Message-Id: <b64@x>\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n=====\xff*\n",
    "uu": b"Message-Id: <uu@x>\nContent-Type: text/plain\nContent-Transfer-Encoding: x-uuencode\n\nbegin 644\n\xff\xff\n",
    "no-end": b"Message-Id: <end@x>\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nhalf",
    "no-boundary": b"Message-Id: <nb@x>\nContent-Type: multipart/mixed\n\n--b\n\nhalf",
    "deep": b"Message-Id: <deep@x>\n" + b"".join(b'Content-Type: multipart/mixed; boundary="b%d"\n\n--b%d\n' % (k, k) for k in range(1500)) + b"\nx\n",
    "empty": b"",
    "nothing": b"\x00\xff\n\n\n",
}


def test_bad_mail_does_not_end_a_job(spark):
    r = tempfile.mkdtemp(prefix="postlake-bad-")
    for name, raw in BAD.items():
        _write(r, f"cur/{name}", raw)
    os.symlink(f"{r}/cur/not-there", f"{r}/cur/dangling")
    m = {x["path"].rsplit("/", 1)[1]: x for x in MD.index_maildir(spark, r).collect()}
    assert set(m) == set(BAD)
    assert {k for k, x in m.items() if x["error"]} <= {"deep"} and all(x["msgid"] and x["size"] == len(BAD[k]) for k, x in m.items())
    assert m["cid8bit"]["parts"][0]["cid"] and m["idna"]["body_text"].startswith("b") and "body" in m["nul"]["body_text"]
    assert "body" in m["surrogate"]["body_text"] and "body" in m["hex"]["body_text"]
    mail = lambda k: {(c["type"], c["name"], c["email"]) for c in m[k]["contacts"]}
    assert {("from", None, "a@x"), ("cc", None, "dan@x.org"), ("to", None, "ok@x.org")} <= mail("broken-list")
    assert mail("comma") == {("from", "A, B", "z@y"), ("to", "Last, First", "lf@y")}
    assert {c["full_address"] for c in m["comma"]["contacts"]} == {'"A, B" <z@y>', '"Last, First" <lf@y>'}
    assert [c["email"] for c in m["name8bit"]["contacts"]] == ["j@x"] and m["name8bit"]["subject"]
    assert m["rfc2231"]["parts"][0]["params"] == {"charset": "utf-8", "name": "naïve.txt", "x": "onetwo"}
    assert m["year"]["date"].year == 8999 and m["nothing"]["contacts"] == []
    assert MD.part_payloads(MD.scan_maildir(spark, r)).select("path").distinct().count() >= len(BAD) - 1


def test_files_that_go_while_a_job_runs(spark):
    r = tempfile.mkdtemp(prefix="postlake-go-")
    for k in range(3):
        _mail(r, f"cur/{k}", k)
    files = MD.checkpoint_df(MD.list_maildir(spark, r))
    os.remove(f"{r}/cur/1")
    assert sorted(x["msgid"] for x in MD.parse_messages(MD.read_files(files), r).collect()) == ["m0@x", "m2@x"]


def test_walk_hands_on_what_is_left(spark, monkeypatch):
    r = tempfile.mkdtemp(prefix="postlake-wide-")
    for k in range(60):
        _mail(r, f"a{k % 5}/b{k % 7}/c{k}/cur/{k}", k)
    rows = list(MD.walk_from([r], set(), 10))
    assert sum(1 for x in rows if x[1] == "dir") and len({x[0] for x in rows}) == len(rows)
    whole = {x[0] for x in MD.walk_from([r], set()) if x[1] == "maildir"}
    assert len(whole) == 60 and {x["dir"] for x in MD.list_folders(spark, r).collect()} == whole
