"""Thread queries (JN3, JN4, THR1-THR12, WIN4-WIN6, AGG18, FN38) over the
conversation messages with gaps (removed turns become placeholders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.people import thread_prefix_subject
from ..operators import predicates as Q
from ..operators import threads as TH
from ..operators.aggregates import thread_summary as agg_thread_summary
from ..operators.components import thread_components as components
from ..sources import tables as T
from .catalog import query
from .sqlviews import CONV_MSGS, CONV_MSGS_GAPS


def _gap_msgs(spark, sf):
    return T.msgs_from_conversations(spark, sf, gaps=True)


_THREADS: dict[tuple, str] = {}


def threads_table(spark, sf, gaps: bool, descending: bool = False):
    """Thread info of the conversation messages, computed by Spark once per
    session and version of the table, and stored as a table in the shared folder; every thread
    query of the catalogue reads it (as a mail store keeps its thread fields)."""
    from ..session import scratch_path
    key = (sf, gaps, descending, spark.sparkContext.getCheckpointDir() or "", T.version(spark, sf, "conversations"))
    if key not in _THREADS:
        path = scratch_path(spark, "threads")
        TH.build_threads(T.msgs_from_conversations(spark, sf, gaps=gaps), descending).write.parquet(path)
        _THREADS[key] = path
    return spark.read.parquet(_THREADS[key])


# Oracle: with gaps each conversation is one chain of its present turns under
# the first present turn; the thread key is the date of the last present turn.
def _chain_sql(descending: bool = False) -> str:
    root_order = "conv_id DESC" if descending else "conv_id"
    return f"""
WITH g AS (SELECT * FROM {CONV_MSGS_GAPS} x),
c AS (SELECT conv_id, max(turn) AS t_max, CAST(count(*) AS BIGINT) AS n_present FROM g GROUP BY conv_id),
w AS (SELECT CAST(ceil(log2(sum(t_max + 1)) / 4.0) AS INTEGER) AS width FROM c),
r AS (SELECT conv_id, t_max, n_present, row_number() OVER (ORDER BY {root_order}) - 1 AS root_idx FROM c),
lv AS (SELECT doc_id, conv_id, turn, subject, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level FROM g),
seg AS (SELECT width, CASE WHEN width <= 1 THEN '0' ELSE lpad('0', width, '0') END AS zero,
               CASE WHEN width <= 1 THEN lower(hex((1 << (4 * width)) - 1)) ELSE lpad(lower(hex((1 << (4 * width)) - 1)), width, '0') END AS fullseg
        FROM w)
SELECT lv.doc_id, lv.conv_id, lv.level, r.n_present, r.t_max, r.root_idx, seg.width, seg.zero, seg.fullseg, lv.subject,
  CASE WHEN seg.width <= 1 THEN lower(hex(r.root_idx)) ELSE lpad(lower(hex(r.root_idx)), seg.width, '0') END AS root_seg
FROM lv JOIN r USING (conv_id), seg"""


@query("thread_tree", sql=f"""
SELECT doc_id, root_seg || repeat(':' || zero, CAST(level AS INTEGER)) AS thread_path, CAST(level AS BIGINT) AS thread_level,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + t_max * 60), '%Y-%m-%d %H:%M:%S') AS thread_date
FROM ({_chain_sql()})""")
def thread_tree(spark, sf):
    th = threads_table(spark, sf, gaps=True)
    return th.select("doc_id", "thread_path", "thread_level",
                     F.date_format("thread_date", "yyyy-MM-dd HH:mm:ss").alias("thread_date"))


@query("thread_order", sql=f"""
SELECT doc_id, root_seg || repeat(':' || fullseg, CAST(level AS INTEGER)) || ':z' AS thread_path
FROM ({_chain_sql(descending=True)})""")
def thread_order(spark, sf):
    th = threads_table(spark, sf, gaps=True, descending=True)
    return th.select("doc_id", "thread_path")


@query("thread_flags", sql=f"""
SELECT doc_id, level = 0 AS root, false AS orphan, level < n_present - 1 AS has_child,
  level > 0 AS first, level > 0 AS last, false AS duplicate,
  CASE WHEN level = 0 THEN '' ELSE repeat('  ', CAST(level - 1 AS INTEGER)) || '\\-> ' END AS prefix
FROM ({_chain_sql()})""")
def thread_flags(spark, sf):
    th = threads_table(spark, sf, gaps=True)
    return th.select("doc_id", "root", "orphan", "has_child", "first", "last", "duplicate",
                     TH.thread_prefix().alias("prefix"))


@query("thread_subject", sql=f"""
SELECT doc_id, level = 0 AS thread_subject, CASE WHEN level = 0 THEN subject ELSE '' END AS shown_subject
FROM ({_chain_sql()})""")
def thread_subject(spark, sf):
    m = _gap_msgs(spark, sf)
    th = threads_table(spark, sf, gaps=True).join(m.select("doc_id", "subject").hint("merge"), "doc_id")
    return th.select("doc_id", "thread_subject", thread_prefix_subject("subject", "thread_subject").alias("shown_subject"))


@query("thread_edges", sql=f"""
SELECT DISTINCT CAST(conv_id AS VARCHAR) || '-' || CAST(i + 1 AS VARCHAR) AS child,
  CAST(conv_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS parent
FROM (SELECT conv_id, unnest(range(0, turn)) AS i FROM {CONV_MSGS_GAPS} g)""")
def thread_edges(spark, sf):
    m = _gap_msgs(spark, sf).select("doc_id", F.col("msgid").alias("id"), "refs", "date")
    edges, _ = TH.parent_edges(m)
    return edges.select("child", "parent")


@query("thread_summary", sql=f"""
SELECT CAST(conv_id AS VARCHAR) || '-0' AS thread_id,
  strftime(max(date), '%Y-%m-%d %H:%M:%S') AS newest, CAST(count(*) AS BIGINT) AS n_msgs,
  arg_min(subject, {{'d': date, 'i': doc_id}}) AS first_subject
FROM {CONV_MSGS} m GROUP BY conv_id""")
def thread_summary(spark, sf):
    from ..operators.related import thread_id
    m = T.msgs_from_conversations(spark, sf).withColumn("thread_id", thread_id())
    s = agg_thread_summary(m)
    return s.select("thread_id", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"), "n_msgs", "first_subject")


def _full_threads(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return m, threads_table(spark, sf, gaps=False).join(m.select("doc_id", "conv_id", "turn", "msgid").hint("merge"), "doc_id")


@query("whole_thread", sql=f"SELECT doc_id FROM {CONV_MSGS} m WHERE conv_id = 5")
def whole_thread(spark, sf):
    _, th = _full_threads(spark, sf)
    anchor = th.where(F.col("msgid") == "5-2").select(F.split("thread_path", ":")[0].alias("s0"))
    # equi semi join on the first path segment (the anchor side is one row)
    return th.withColumn("s0", F.split("thread_path", ":")[0]).join(anchor, "s0", "left_semi").select("doc_id")


@query("subthread", sql=f"SELECT doc_id FROM {CONV_MSGS} m WHERE conv_id = 5 AND turn >= 2")
def subthread(spark, sf):
    _, th = _full_threads(spark, sf)
    anchor = th.where(F.col("msgid") == "5-2").select("thread_root", F.col("thread_path").alias("ap"))
    # equi join on the thread, then the path-prefix test inside that thread
    j = th.join(anchor, "thread_root", "inner")
    return j.where((F.col("thread_path") == F.col("ap")) | F.col("thread_path").startswith(F.concat(F.col("ap"), F.lit(":")))).select("doc_id")


@query("show_thread", sql=f"""
SELECT doc_id, CAST(turn AS BIGINT) AS thread_level FROM {CONV_MSGS} m WHERE conv_id = 7""")
def show_thread(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    out = TH.run_threaded(m, Q.msgid_is("msgid", "7-1"), related=True)
    return out.select("doc_id", "thread_level")


# first turns of every fourth conversation also refer to another conversation's first turn, so components span conversations
_LINKED_SQL = f"""(SELECT doc_id, msgid, list_concat(refs, CASE WHEN conv_id % 4 = 0 AND turn = 0 THEN [CAST(conv_id // 3 AS VARCHAR) || '-0'] ELSE [] END) AS refs
  FROM {CONV_MSGS_GAPS} x)"""


@query("thread_components", sql=f"""
WITH RECURSIVE l AS (SELECT msgid AS a, unnest(refs) AS b FROM {_LINKED_SQL} m),
ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.other = w.a),
least_ AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, coalesce(component, msgid) AS component FROM {_LINKED_SQL} m LEFT JOIN least_ ON node = msgid""")
def thread_components(spark, sf):
    m = _gap_msgs(spark, sf)
    more = F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), F.array(F.concat(F.floor(F.col("conv_id") / 3).cast("string"), F.lit("-0"))))
    linked = m.withColumn("refs", F.concat("refs", F.coalesce(more, F.array().cast("array<string>"))))
    return components(linked.select("doc_id", "msgid", "refs")).select("doc_id", "component")
