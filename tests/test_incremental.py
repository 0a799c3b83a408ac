"""Incremental maintenance on literal listings and stores."""

import datetime as dt

from postlake.sources import incremental as INC

T0 = dt.datetime(2024, 1, 1)


def _df(spark, rows):
    return spark.createDataFrame(rows, "path string, mtime timestamp_ntz, v int")


def test_new_changed_upsert_cleanup(spark):
    store = _df(spark, [("/m/a/cur/1", T0, 1), ("/m/a/cur/2", T0, 1), ("/m/b/cur/3", T0, 1)])
    files = _df(spark, [("/m/a/cur/1", T0, 0), ("/m/a/cur/2", T0 + dt.timedelta(hours=1), 0),
                        ("/m/c/new/4", T0, 0)])
    todo = {r["path"] for r in INC.new_or_changed(files, store).collect()}
    assert todo == {"/m/a/cur/2", "/m/c/new/4"}
    batch = _df(spark, [("/m/a/cur/2", T0 + dt.timedelta(hours=1), 2), ("/m/a/cur/2", T0 + dt.timedelta(hours=2), 3),
                        ("/m/c/new/4", T0, 2)])
    up = {r["path"]: r["v"] for r in INC.upsert_messages(store, batch).collect()}
    assert up == {"/m/a/cur/1": 1, "/m/a/cur/2": 3, "/m/b/cur/3": 1, "/m/c/new/4": 2}  # newest wins
    kept, removed = INC.cleanup_missing(store, files)
    assert {r["path"] for r in removed.collect()} == {"/m/b/cur/3"}
    prog = INC.index_progress(files, store).first()
    assert (prog["processed"], prog["updated"], prog["removed"]) == (3, 2, 1)


def test_lazy_directories(spark):
    store = _df(spark, [("/m/a/cur/1", T0, 1), ("/m/b/cur/2", T0, 1)])
    files = _df(spark, [("/m/a/cur/1", T0, 0), ("/m/b/cur/2", T0 + dt.timedelta(minutes=5), 0), ("/m/c/cur/3", T0, 0)])
    dirs = {r["dir"] for r in INC.skip_unchanged_dirs(files, INC.dir_stamps(store)).collect()}
    assert dirs == {"/m/b", "/m/c"}
