"""Hot keys: a third of the rows under one key must give the same answers."""

import datetime as dt

from pyspark.sql import functions as F

from postlake.operators import dedupe
from postlake.operators.threads import build_threads

SCHEMA = "doc_id bigint, msgid string, path string, refs array<string>, date timestamp_ntz, subject string"


def test_hot_parent_threads(spark):
    base = dt.datetime(2020, 1, 1)
    rows = [(1, "root", "/p/1", [], base, "s")]
    # 300 direct replies to one root (the hot parent) and 300 other single-message threads
    rows += [(i, f"r{i}", f"/p/{i}", ["root"], base + dt.timedelta(minutes=i), "Re: s") for i in range(2, 302)]
    rows += [(i, f"x{i}", f"/p/{i}", [], base + dt.timedelta(minutes=i), f"t{i}") for i in range(302, 602)]
    m = spark.createDataFrame(rows, SCHEMA)
    th = build_threads(m).cache()
    kids = th.where("NOT root").select("thread_path").collect()
    assert len(kids) == 300
    # sibling segments are 0..299 in date order, all unique
    segs = sorted(int(r[0].split(":")[1], 16) for r in kids)
    assert segs == list(range(300))
    first = th.where("first").select("doc_id").collect()
    last = th.where("last").select("doc_id").collect()
    assert [r[0] for r in first] == [2] and [r[0] for r in last] == [301]
    assert th.where("root").count() == 301


def test_hot_duplicate_key(spark):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("doc_id"),
                               F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("msgid"),
                               F.lit(None).cast("string").alias("path"))
    f = dedupe.flag_duplicates(df)
    assert f.where("NOT is_dup").count() == 1 + (n - n // 3)
    o = dedupe.dup_ordinal(df).where(F.col("msgid") == "hot")
    assert sorted(r[0] for r in o.select("dup_rank").collect()) == list(range(1, n // 3 + 1))
