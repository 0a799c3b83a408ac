"""Bulk changes (MUT1-MUT8) and incremental maintenance (SRC5-SRC11) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as CH
from ..operators import predicates as Q
from ..sources import incremental as INC
from ..sources import tables as T
from .catalog import query
from .sqlviews import CONV_MSGS, tokens_sql


def _new_path_sql(mdir: str, flags: str) -> str:
    """Oracle twin of new_path for conversation paths (no custom flags)."""
    stem = "regexp_replace(regexp_extract(path, '/([^/]+)$', 1), '[:!;]2,[^/]*$', '')"
    letters = (f"CASE WHEN {flags} & 1 <> 0 THEN 'D' ELSE '' END || CASE WHEN {flags} & 2 <> 0 THEN 'F' ELSE '' END"
               f" || CASE WHEN {flags} & 4 <> 0 THEN 'P' ELSE '' END || CASE WHEN {flags} & 8 <> 0 THEN 'R' ELSE '' END"
               f" || CASE WHEN {flags} & 16 <> 0 THEN 'S' ELSE '' END || CASE WHEN {flags} & 32 <> 0 THEN 'T' ELSE '' END")
    return (f"CASE WHEN {flags} & 64 <> 0 THEN {mdir} || '/new/' || {stem} "
            f"ELSE {mdir} || '/cur/' || {stem} || ':2,' || {letters} END")


_OLD_MDIR = "regexp_extract(path, '^(.*)/(cur|new)/[^/]+$', 1)"


@query("move", sql=f"""
SELECT doc_id, path AS old_path, {_new_path_sql("'/mail/archive'", "(flags & ~64)")} AS new_path
FROM {CONV_MSGS} m WHERE "from" = 'system'""")
def move(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    after = CH.move(m, F.col("from") == "system", "/archive", root="/mail")
    log = CH.change_log(m, after, "move")
    return log.select("doc_id", "old_path", "new_path")


@query("set_flags", sql=f"""
SELECT doc_id, CAST(CASE WHEN h THEN (flags | 2) & ~(64 | 2048) ELSE flags END AS INTEGER) AS flags,
  CASE WHEN h THEN {_new_path_sql(_OLD_MDIR, "((flags | 2) & ~(64 | 2048))")} ELSE path END AS path
FROM (SELECT *, list_contains({tokens_sql('body_text')}, 'the') AS h FROM {CONV_MSGS} m)""")
def set_flags(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    return CH.set_flags(m, Q.has_term("body_text", "the"), "+F-u-N").select("doc_id", "flags", "path")


_MARK_OF = ["read", "unread", "trash", "flag", "delete"]


@query("marks", sql=f"""
WITH mk AS (SELECT doc_id, conv_id % 5 AS k, flags, path, maildir FROM {CONV_MSGS} m),
nf AS (SELECT *, CASE k WHEN 0 THEN (flags | 16) & ~(64 | 2048) WHEN 1 THEN (flags | 2048) & ~(16 | 64)
                      WHEN 2 THEN (flags | 32) & ~64 WHEN 3 THEN (flags | 2) & ~(2048 | 64) ELSE flags END AS f2 FROM mk)
SELECT doc_id, CAST(f2 AS INTEGER) AS flags,
  CASE WHEN k = 2 THEN '/trash' ELSE maildir END AS maildir,
  CASE WHEN k = 2 THEN {_new_path_sql("'/mail/trash'", "f2")} ELSE {_new_path_sql(_OLD_MDIR, "f2")} END AS path
FROM nf WHERE k <> 4""")
def marks(spark, sf):
    m = T.msgs_from_conversations(spark, sf)
    mk = F.array(*[F.lit(x) for x in _MARK_OF])[(F.col("conv_id") % 5).cast("int")]
    table = m.select("doc_id", mk.alias("mark"), F.when(mk == "trash", F.lit("/trash")).alias("target"))
    out = CH.apply_marks(m, table)
    return out.select("doc_id", "flags", "maildir", "path")


@query("mark_everywhere", sql="""
SELECT doc_id, CAST(CASE WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE lang = 'de' AND n_chars < 800)
  THEN 16 | 2 ELSE 16 END AS INTEGER) AS flags FROM documents""")
def mark_everywhere(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    ids = d.where((F.col("lang") == "de") & (F.col("size") < 800)).select("msgid")
    return CH.mark_read_everywhere(d, ids, "+F").select("doc_id", "flags")


@query("retag", sql=f"""
SELECT doc_id, CASE WHEN list_contains({tokens_sql('text')}, 'the')
  THEN array_to_string(list_sort(list_distinct(list_filter(list_concat([lang, source], ['hot', 'new']), lambda t: t <> 'src3'))), ',')
  ELSE array_to_string([lang, source], ',') END AS tags
FROM documents""")
def retag(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    out = CH.retag(d, Q.has_term("body_text", "the"), "+hot,-src3,new")
    return out.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("delete_rows", sql="""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE NOT (lang = 'fr' AND n_chars > 300) GROUP BY lang""")
def delete_rows(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    return CH.delete(d, (F.col("lang") == "fr") & (F.col("size") > 300)).groupBy("lang").agg(F.count("*").alias("n"))


# --- incremental maintenance: the store holds the documents that are not 'es';
# the current listing has every document but 'fr' (deleted files), and 'de'
# files were modified an hour after they were stored.

def _listing(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    mtime = F.col("date") + F.when(F.col("lang") == "de", F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 SECONDS"))
    return d.where(F.col("lang") != "fr").select("path", mtime.alias("mtime"), "doc_id", "lang", "size")


def _store(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    return d.where(F.col("lang") != "es").select("path", F.col("date").alias("mtime"), "doc_id", "lang", "size")


_LIST_SQL = """(SELECT '/mail/' || source || '/cur/' || CAST(doc_id AS VARCHAR) || ':2,S' AS path,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 2220 + CASE WHEN lang = 'de' THEN 3600 ELSE 0 END) AS mtime,
  doc_id, lang, n_chars AS size FROM documents WHERE lang <> 'fr')"""
_STORE_SQL = """(SELECT '/mail/' || source || '/cur/' || CAST(doc_id AS VARCHAR) || ':2,S' AS path,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 2220) AS mtime, doc_id, lang, n_chars AS size
  FROM documents WHERE lang <> 'es')"""


@query("new_or_changed", sql=f"""
SELECT f.path, f.lang FROM {_LIST_SQL} f LEFT JOIN {_STORE_SQL} s ON f.path = s.path
WHERE s.path IS NULL OR f.mtime > s.mtime""")
def new_or_changed(spark, sf):
    return INC.new_or_changed(_listing(spark, sf), _store(spark, sf)).select("path", "lang")


@query("upsert", sql=f"""
WITH b AS (SELECT f.* FROM {_LIST_SQL} f LEFT JOIN {_STORE_SQL} s ON f.path = s.path WHERE s.path IS NULL OR f.mtime > s.mtime)
SELECT path, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime, lang FROM (
  SELECT * FROM {_STORE_SQL} s WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT * FROM b)""")
def upsert(spark, sf):
    files, store = _listing(spark, sf), _store(spark, sf)
    batch = INC.new_or_changed(files, store)
    out = INC.upsert_messages(store, batch)
    return out.select("path", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"), "lang")


@query("cleanup", sql=f"""
SELECT path, s.path IN (SELECT path FROM {_LIST_SQL} f) AS kept FROM {_STORE_SQL} s""")
def cleanup(spark, sf):
    kept, removed = INC.cleanup_missing(_store(spark, sf), _listing(spark, sf))
    return kept.select("path", F.lit(True).alias("kept")).unionByName(removed.select("path", F.lit(False).alias("kept")))


@query("lazy_dirs", sql=f"""
WITH fd AS (SELECT regexp_extract(path, '^(.*)/(cur|new)/[^/]+$', 1) AS dir, path, mtime FROM {_LIST_SQL} f),
st AS (SELECT regexp_extract(path, '^(.*)/(cur|new)/[^/]+$', 1) AS dir, max(mtime) AS stamp FROM {_STORE_SQL} s GROUP BY 1),
stale AS (SELECT fd.dir FROM fd LEFT JOIN st USING (dir) GROUP BY fd.dir, st.stamp HAVING st.stamp IS NULL OR max(fd.mtime) > st.stamp)
SELECT dir, CAST(count(*) AS BIGINT) AS n_files FROM fd WHERE dir IN (SELECT dir FROM stale) GROUP BY dir""")
def lazy_dirs(spark, sf):
    files, store = _listing(spark, sf), _store(spark, sf)
    stamps = INC.dir_stamps(store)
    todo = INC.skip_unchanged_dirs(files, stamps)
    return todo.groupBy("dir").agg(F.count("*").alias("n_files"))


@query("index_progress", sql=f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM {_LIST_SQL} a) AS processed,
  (SELECT CAST(count(*) AS BIGINT) FROM {_LIST_SQL} f LEFT JOIN {_STORE_SQL} s ON f.path = s.path
   WHERE s.path IS NULL OR f.mtime > s.mtime) AS updated,
  (SELECT CAST(count(*) AS BIGINT) FROM {_STORE_SQL} s WHERE path NOT IN (SELECT path FROM {_LIST_SQL} f)) AS removed""")
def index_progress(spark, sf):
    return INC.index_progress(_listing(spark, sf), _store(spark, sf))


@query("store_info", sql="""
SELECT 'postlake-1' AS schema_version, '/mail' AS root, 'user@conv.example' AS personal_addresses,
  CAST(100000000 AS BIGINT) AS max_message_size, CAST(250000 AS BIGINT) AS batch_size,
  CAST(count(*) AS BIGINT) AS messages FROM conversations""")
def store_info(spark, sf):
    return INC.store_info(T.msgs_from_conversations(spark, sf), "/mail", ["user@conv.example"])


@query("remove_messages", sql=f"""
SELECT path FROM {_STORE_SQL} s WHERE path NOT IN (SELECT path FROM {_STORE_SQL} t WHERE lang = 'de' AND size > 1000)""")
def remove_messages(spark, sf):
    store = _store(spark, sf)
    keys = store.where((F.col("lang") == "de") & (F.col("size") > 1000)).select("path")
    return INC.remove_messages(store, keys).select("path")
