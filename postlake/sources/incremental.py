"""Incremental store maintenance (SRC5-SRC11): which files to (re)parse, upsert,
removal of vanished files, progress counters and store info."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .maildir import _ancestor_dirs, cap_size, list_message_dirs, local_root, parse_messages, read_files, walk_folders
from .store import KeyedStore

DIR_OF = r"^(.*)/(cur|new)/[^/]+$"


def new_or_changed(files: DataFrame, m: DataFrame) -> DataFrame:
    """SRC5: files unknown to the store, or modified after their stored stamp."""
    known = m.select("path", F.col("mtime").alias("_stored"))
    j = files.join(known, "path", "left")
    return j.where(F.col("_stored").isNull() | (F.col("mtime") > F.col("_stored"))).drop("_stored")


def skip_unchanged_dirs(files: DataFrame, dir_state: DataFrame) -> DataFrame:
    """SRC6: only files in directories whose newest file is newer than the
    directory's stamp (or with no stamp) are looked at."""
    d = files.withColumn("dir", F.regexp_extract("path", DIR_OF, 1))
    newest = d.groupBy("dir").agg(F.max("mtime").alias("_newest"))
    stale = (newest.join(dir_state.select("dir", F.col("mtime").alias("_stamp")), "dir", "left")
             .where(F.col("_stamp").isNull() | (F.col("_newest") > F.col("_stamp"))).select("dir"))
    return d.join(stale, "dir", "left_semi")


def dir_stamps(files: DataFrame) -> DataFrame:
    """Directory stamps to store after a run: newest mtime per directory."""
    return files.withColumn("dir", F.regexp_extract("path", DIR_OF, 1)).groupBy("dir").agg(F.max("mtime").alias("mtime"))


def upsert_messages(m: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """SRC7: insert or replace by key; within the batch the newest mtime wins.
    Write the result to a NEW location (never overwrite what is being read)."""
    latest = batch.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns if c != key]),
                                             F.col("mtime")).alias("_r")).select(key, "_r.*")
    return m.join(latest.select(key), key, "left_anti").unionByName(latest.select(*m.columns))


def remove_messages(m: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """SRC8: drop rows by key (path or doc_id)."""
    return m.join(keys.select(key), key, "left_anti")


def cleanup_missing(m: DataFrame, files: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """SRC9: (kept rows whose file still exists, removed rows)."""
    cur = files.select(key)
    return m.join(cur, key, "left_semi"), m.join(cur, key, "left_anti")


def observe_progress(batch: DataFrame, name: str = "index_progress") -> tuple[DataFrame, Observation]:
    """SRC10: processed/updated counters collected as the batch is written."""
    obs = Observation(name)
    return batch.observe(obs, F.count(F.lit(1)).alias("processed")), obs


def index_progress(files: DataFrame, m: DataFrame) -> DataFrame:
    """SRC10 as a table: processed (listed), updated (new or changed), removed. Listing and store meet once, in a
    full join on the path (unique in each)."""
    both = (files.select("path", "mtime", F.lit(1).alias("_listed"))
            .join(m.select("path", F.col("mtime").alias("_stored"), F.lit(1).alias("_known")), "path", "full_outer"))
    count = lambda what: F.count_if(what).cast("bigint")
    listed = F.col("_listed").isNotNull()
    return both.agg(count(listed).alias("processed"),
                    count(listed & (F.col("_stored").isNull() | (F.col("mtime") > F.col("_stored")))).alias("updated"),
                    count(~listed & F.col("_known").isNotNull()).alias("removed"))


FOLDER_OF = r"^(.*/(?:cur|new))/[^/]+$"


def _outside(rows: DataFrame, closed: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows whose path lies in no folder ``dir`` of ``closed`` nor below one."""
    below = rows.select(path_col, F.explode(_ancestor_dirs(path_col)).alias("dir")).join(closed.select("dir").distinct(), "dir", "left_semi")
    return rows.join(below.select(path_col).distinct(), path_col, "left_anti")


def _vanished(stored: DataFrame, files: DataFrame, walked: DataFrame, kept: DataFrame, root: str) -> DataFrame:
    """Stored rows below ``root`` whose file isn't listed, though their folder was listed or is gone (SRC9): nothing is
    known of folders that hold a marker, are below one, or can't be listed, and their messages stay."""
    own = stored.where(F.startswith(F.col("path"), F.lit(local_root(root).rstrip("/") + "/"))).select("path")
    closed = walked.where("kind in ('marked', 'failed')").select("dir").union(kept.select(F.col("folder").alias("dir")))
    return _outside(own.join(files.select("path"), "path", "left_anti"), closed)


def _counted(**parts: DataFrame) -> DataFrame:
    """One row of the sizes of some tables."""
    rows = [df.select(*[F.lit(int(c == name)).alias(c) for c in parts]) for name, df in parts.items()]
    tagged = reduce(DataFrame.union, rows)
    return tagged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts])


def _message_dirs(walked: DataFrame) -> DataFrame:
    """(folder, stamp) of the cur and new of each maildir."""
    both = F.array(*[F.struct(F.concat("dir", F.lit(f"/{k}")).alias("folder"), F.col(k).alias("stamp")) for k in ("cur", "new")])
    return walked.where("kind = 'maildir'").select(F.inline(both))


def update_store(spark: SparkSession, root: str, stored: DataFrame | None, target: str,
                 max_size: int | None = None, full: bool = False) -> DataFrame:
    """SRC1-SRC10 composed: the next version of a stored messages table, written to ``target`` (a new folder).

    Files are listed on the executors, only new or changed ones are read and parsed, messages whose file is
    gone are removed, and the rest is carried over as it is: also messages over ``max_size``, or in folders with a marker or that
    can't be listed. The first index is a full one (.noupdate doesn't count). A root that can't be listed is an error.
    Returns one row: processed, updated, removed.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    walked = walk_folders(spark, root, full or stored is None)
    listed = checkpointed(list_message_dirs(_message_dirs(walked).select("folder").repartition(n, "folder"), full or stored is None))
    files = listed.where("kind = 'file'")
    if stored is None:
        stored = parse_messages(read_files(files.limit(0)), root)
    todo = checkpointed(new_or_changed(cap_size(files, max_size).select("path", "mtime", "size"), stored))
    fresh = parse_messages(read_files(todo.repartition(n, "path")), root)
    removed = checkpointed(_vanished(stored, files, walked, listed.where("kind = 'kept'"), root))
    out = todo.select("path").union(removed.select("path"))
    stored.join(out, "path", "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns)).write.parquet(target)
    return _counted(processed=cap_size(files, max_size), updated=todo, removed=removed)


def refresh_store(spark: SparkSession, root: str, store: KeyedStore, max_size: int | None = None, full: bool = False,
                  lazy: bool = True, settle: float = 2.0) -> DataFrame:
    """SRC1-SRC10 on a store that is updated in place: as ``update_store``, but only the buckets of changed messages are written.

    Lazy (SRC6): a cur or new folder whose own modification time is the one that the last run saw isn't listed. A file that was
    changed in place, or couldn't be read then, is found by a run with ``lazy`` off. A stamp younger than ``settle`` seconds isn't
    relied on, since a file may still arrive within its resolution. After an update that ended half way, all folders are listed.
    Returns one row: folders (cur and new), listed, processed, updated, removed.
    """
    began = time.time_ns()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stamps = KeyedStore(spark, f"{store.base}/folders", key="folder", buckets=8)
    stored = store.read()
    full = full or stored is None
    walked = walk_folders(spark, root, full)
    here = _message_dirs(walked)
    known = stamps.read()
    if known is None:
        known = spark.createDataFrame([], "folder string, stamp long")
    sure = F.lit(lazy and not store.dirty and not stamps.dirty)
    state = checkpointed(here.withColumn("here", F.lit(True)).join(known.select("folder", F.col("stamp").alias("was")).withColumn("known", F.lit(True)), "folder", "full")
                         .select("folder", "stamp", F.coalesce("here", F.lit(False)).alias("here"),
                                 F.coalesce(sure & (F.col("stamp") == F.col("was")), F.lit(False)).alias("same")))
    n_here, n_due, n_gone = state.agg(F.count_if("here"), F.count_if(F.col("here") & ~F.col("same")), F.count_if(~F.col("here"))).first()
    if stored is not None and not n_due and not n_gone:
        return spark.createDataFrame([(n_here, 0, 0, 0, 0)], "folders long, listed long, processed long, updated long, removed long")
    closed = walked.where("kind in ('marked', 'failed')").select("dir")
    gone = _outside(state.where("not here"), closed, "folder")
    due = state.where("here and not same").select("folder", "stamp")
    listed = checkpointed(list_message_dirs(due.repartition(n, "folder"), full))
    files = listed.where("kind = 'file'")
    folder = F.regexp_extract("path", FOLDER_OF, 1)
    if stored is None:
        own = parse_messages(read_files(files.limit(0)), root).select("path", "mtime")
    else:
        # what is stored of the folders that were listed or are gone
        open_ = due.join(listed.where("kind = 'kept'").select("folder"), "folder", "left_anti").select("folder").union(gone.select("folder"))
        own = checkpointed(stored.select("path", "mtime", folder.alias("folder")).join(open_, "folder", "left_semi").select("path", "mtime"))
    wanted = cap_size(files, max_size)
    todo = checkpointed(new_or_changed(wanted.select("path", "mtime", "size"), own))
    removed = checkpointed(own.join(files, "path", "left_anti").select("path"))
    counts = _counted(folders=here, listed=due, processed=wanted, updated=todo, removed=removed).first()
    if counts["updated"] or counts["removed"] or stored is None:
        store.upsert(parse_messages(read_files(todo.repartition(n, "path")), root), keys=todo, removed=removed)
    if counts["listed"] or not gone.isEmpty():
        young = F.col("stamp") >= F.lit(began - int(settle * 1e9))
        stamps.upsert(due.select("folder", F.when(~young, F.col("stamp")).alias("stamp")), removed=gone)
    return spark.createDataFrame([tuple(counts)], ", ".join(f"{c} long" for c in counts.asDict()))


def store_info(m: DataFrame, root: str, personal: list[str] | None = None, max_size: int = 100_000_000,
               batch_size: int = 250_000, schema_version: str = "postlake-1") -> DataFrame:
    """SRC11: message count and settings as one row."""
    return m.agg(F.count("*").alias("messages")).select(
        F.lit(schema_version).alias("schema_version"), F.lit(root).alias("root"),
        F.lit(",".join(personal or [])).alias("personal_addresses"),
        F.lit(max_size).cast("bigint").alias("max_message_size"), F.lit(batch_size).cast("bigint").alias("batch_size"),
        F.col("messages"))
