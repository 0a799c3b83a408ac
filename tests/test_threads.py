"""Thread paths: chains, loops with refused links, duplicates, empty roots, siblings."""

import datetime as dt

import pytest

from postlake.operators.threads import build_threads

SCHEMA = "doc_id bigint, msgid string, path string, refs array<string>, date timestamp_ntz, subject string"


def _rows(spark, cases):
    rows = []
    for i, (mid, day, refs) in enumerate(cases):
        date = dt.datetime(2020, 1, 1) + dt.timedelta(days=day) if day is not None else None
        rows.append((i + 1, mid, f"/p/{i + 1}", refs, date, f"s{i}"))
    return spark.createDataFrame(rows, SCHEMA)


def _paths(spark, cases, descending=False):
    m = _rows(spark, cases)
    th = build_threads(m, descending).join(m.select("doc_id", "msgid"), "doc_id")
    return {r["msgid"] if r["msgid"] else r["doc_id"]: r["thread_path"] for r in th.collect()}, th


def test_chain_ascending(spark):
    p, _ = _paths(spark, [("m1", 1, ["m2"]), ("m2", 2, ["m3"]), ("m3", 3, []), ("m4", 4, [])])
    assert p == {"m1": "0:0:0", "m2": "0:0", "m3": "0", "m4": "1"}


def test_chain_descending(spark):
    p, _ = _paths(spark, [("m1", 1, ["m2"]), ("m2", 2, ["m3"]), ("m3", 3, []), ("m4", 4, [])], descending=True)
    assert p == {"m4": "0:z", "m3": "1:z", "m2": "1:f:z", "m1": "1:f:f:z"}


def test_inconsistent_refs(spark):
    p, _ = _paths(spark, [("m1", 1, ["m2"]), ("m2", 2, ["m1"]), ("m3", 3, ["m3"]),
                          ("m4", 4, ["m3", "m5"]), ("m5", 5, ["m4", "m4"])])
    assert p == {"m2": "0", "m1": "0:0", "m3": "1", "m5": "1:0", "m4": "1:0:0"}


def test_duplicate(spark):
    m = spark.createDataFrame([(1, "m1", "/p/1", [], dt.datetime(2020, 1, 2), "a"),
                               (2, "m1", "/p/2", [], dt.datetime(2020, 1, 3), "a")], SCHEMA)
    th = {r["doc_id"]: (r["thread_path"], r["duplicate"]) for r in build_threads(m).collect()}
    assert th == {1: ("0", False), 2: ("0:0", True)}


def test_empty_root_two_children(spark):
    p, th = _paths(spark, [("x1", 1, ["m7"]), ("x2", 2, ["m7"])])
    assert p == {"x1": "0:0", "x2": "0:1"}
    assert all(r["orphan"] for r in th.collect())


def test_empty_root_one_child(spark):
    p, _ = _paths(spark, [("m1", 1, ["m7"])])
    assert p == {"m1": "0"}


def test_empty_inner_node(spark):
    p, _ = _paths(spark, [("m1", 1, ["m7", "m6"]), ("m2", 2, ["m7", "m6"])])
    assert p == {"m1": "0:0", "m2": "0:1"}


MIXED = [("m1", 5, []), ("m2", 1, []), ("m3", 3, ["m2"]), ("m4", 2, ["m2"]), ("m10", 6, ["m9"]), ("m11", 7, ["m9"])]


def test_mixed_ascending(spark):
    p, _ = _paths(spark, MIXED)
    assert p == {"m2": "0", "m4": "0:0", "m3": "0:1", "m1": "1", "m10": "2:0", "m11": "2:1"}


def test_mixed_descending(spark):
    p, _ = _paths(spark, MIXED, descending=True)
    assert p == {"m10": "0:f:z", "m11": "0:e:z", "m1": "1:z", "m2": "2:z", "m4": "2:f:z", "m3": "2:e:z"}


def test_refused_link_gives_way_to_the_next_proposal(spark):
    p, _ = _paths(spark, [("m1", 1, ["m2"]), ("m2", 2, ["m1"]), ("m3", 3, ["x", "m2"]), ("x", 4, [])])
    assert p == {"x": "0", "m2": "0:0", "m1": "0:0:0", "m3": "0:0:1"}


def test_two_loops_share_a_later_proposal(spark):
    # b -> a stands, a -> b is refused; then c proposes y as a's parent; d and e do the same apart
    p, _ = _paths(spark, [("b", 1, ["a"]), ("a", 2, ["b"]), ("c", 3, ["y", "a"]), ("y", 4, []),
                          ("e", 5, ["d"]), ("d", 6, ["e"])])
    assert p == {"y": "0", "a": "0:0", "b": "0:0:0", "c": "0:0:1", "d": "1", "e": "1:0"}


def test_long_chain_has_a_row_per_message_and_round(spark):
    """1 500 messages, each naming only the one before: levels, roots and dates come right at any depth."""
    from pyspark.sql import functions as F
    n = 1500
    ident = lambda c: F.concat(F.lit("m"), c.cast("string"))
    none = F.array().cast("array<string>")
    m = spark.range(n).select(F.col("id").alias("doc_id"), ident(F.col("id")).alias("msgid"), F.lit("/p").alias("path"),
                              F.when(F.col("id") > 0, F.array(ident(F.col("id") - 1))).otherwise(none).alias("refs"),
                              (F.lit(dt.datetime(2020, 1, 1)) + F.make_dt_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz").alias("date"),
                              F.lit("s").alias("subject"))
    rows = build_threads(m).select("doc_id", "thread_level", "thread_root", F.length("thread_path").alias("n"), "thread_date").collect()
    assert {(r["doc_id"], r["thread_level"], r["thread_root"]) for r in rows} == {(k, k, "m0") for k in range(n)}
    assert all(r["n"] == 4 * r["thread_level"] + 3 and r["thread_date"] == dt.datetime(2020, 1, 1) + dt.timedelta(minutes=n - 1) for r in rows)


def test_loops_and_placeholders_as_a_plain_walk(spark):
    """Parents of random references, loops among them, against links tried one by one in order, the latest of a loop refused."""
    import random

    from postlake.operators import threads as TH
    rng = random.Random(6)
    links = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(110)})
    rng.shuffle(links)
    proposals = [(f"n{a}", f"n{b}", k) for k, (a, b) in enumerate(links) if a != b]
    ids = spark.createDataFrame([(f"n{k}",) for k in range(60)], "id string")
    got = {r["id"]: (r["parent"], r["root"]) for r in TH.parents(ids, spark.createDataFrame(proposals, "child string, parent string, order int")).collect()}
    left = list(proposals)
    while True:
        own = {}
        for c, p, k in left:
            if c not in own:
                own[c] = (p, k)
        bad = set()
        for c in own:
            seen, at = [], c
            while at in own and at not in seen:
                seen.append(at)
                at = own[at][0]
            if at in seen:
                loop = seen[seen.index(at):]
                child = max(loop, key=lambda x: own[x][1])
                bad.add((child, *own[child]))
        if not bad:
            break
        left = [x for x in left if (x[0], x[1], x[2]) not in bad]

    def root(x):
        while x in own:
            x = own[x][0]
        return x

    assert got == {f"n{k}": (own.get(f"n{k}", (None,))[0], root(f"n{k}")) for k in range(60)}


def test_node_tables_are_joined_by_sorting(spark):
    """Tables of a row per node are small as files, and none goes through the driver to all tasks."""
    from postlake.operators import threads as TH
    from postlake.sinks import with_thread_info
    a, b = (TH._ckpt(spark.range(1000).selectExpr("id", f"id % {k} as v{k}")) for k in (3, 5))
    for j in (a.join(b.select("id", "v5"), "id"), a.where("v3 = 1").join(b.groupBy("id").count(), "id", "left"),
              with_thread_info(spark.range(10).withColumnRenamed("id", "doc_id"), spark.range(1000).selectExpr("id as doc_id", "id as level"))):
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
