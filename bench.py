"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion with the ``noop`` sink (the whole plan
executes, nothing is collected to the driver). ``ingest_msgs_per_sec`` is the
file-index rate (scan + MIME parse) over a maildir written from the
conversations table, and ``reindex_nochange_msgs_per_sec`` the rate of a
re-index that finds nothing changed: the reference's only published numbers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "find_term_date", "term_default_fields", "phrase_match", "regex_terms", "flags_delta", "date_range",
    "set_ops", "folder_counts", "sort_topk", "format_lines", "flatten_text", "html_body", "urls",
    "saved_counts", "tabulate_list", "stats_size", "per_year_month",
    "contacts_build", "contacts_rank", "nicks", "contacts_text",
    "related_messages", "dup_flag", "find_dups", "copies_of", "personal_join",
    "postings", "dictionary", "fts_and", "fts_phrase", "fts_regex",
    "thread_tree", "thread_summary",
    "parts_list", "body_concat", "attach_list", "mime_counts",
    "marks", "retag", "upsert", "lazy_dirs",
    "stream_counts", "udf_custom_field", "per_partition",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from postlake.plans.catalog import QUERIES, load_all
    from postlake.session import get_spark
    load_all()
    spark = get_spark("bench", cpus=cpus, shuffle_partitions=int(cpus) * 2)
    # JVM warm-up on the smallest data set (JIT of Spark itself, Python workers); every timed
    # query below still plans and compiles its own code
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.001"))
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for key in ("count_all", "contacts_build", "flags_delta", "per_month", "udf_custom_field"):
        QUERIES[key](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for key in only or HEADLINE:
        t0 = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    ingest = {}
    if not only:
        from postlake.plans.io import maildir_root
        from postlake.sources.maildir import index_maildir
        root = maildir_root(spark, sf_dir)
        n = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
        t0 = time.time()
        index_maildir(spark, root).write.format("noop").mode("overwrite").save()
        dt_ = time.time() - t0
        times["index_maildir"] = round(dt_, 3)
        # a store kept in place: a first run, and a lazy one that finds nothing changed
        from postlake.session import scratch_path
        from postlake.sources.incremental import refresh_store
        from postlake.sources.store import KeyedStore
        base = scratch_path(spark, "bench-store")
        t0 = time.time()
        refresh_store(spark, root, KeyedStore(spark, base), settle=0).collect()
        times["refresh_first"] = round(time.time() - t0, 3)
        t0 = time.time()
        todo = refresh_store(spark, root, KeyedStore(spark, base), settle=0).first()["updated"]
        dt2 = time.time() - t0
        times["reindex_nochange"] = round(dt2, 3)
        ingest = {"ingest_msgs": n, "ingest_msgs_per_sec": round(n / dt_, 1),
                  "reindex_nochange_msgs_per_sec": round(n / dt2, 1), "reindex_changed": todo}
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), **ingest}))


if __name__ == "__main__":
    main()
