"""Structured Streaming forms of the incremental operators (STR1-STR4).

Each stream takes the paths of its store and its checkpoint; a later run with the same paths
resumes where the last one stopped. Without them, a run gets new ones under ``spark.checkpoint.dir``.
The helpers here use ``trigger(availableNow=True)``. Stores are written with
``foreachBatch`` into versioned folders: a batch never overwrites the
version it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flags import is_unread
from ..session import checkpointed, scratch_path
from ..sources.incremental import new_or_changed
from ..sources.maildir import _fs_for, cap_size, parse_messages, read_files
from ..sources.store import KeyedStore
from .source import register

class EpochStore:
    """An append-only Parquet table in a shared folder: each micro-batch writes
    only its own rows under ``epoch=<n>``; readers take the newest row per key
    (a partial aggregation), so a batch never rewrites or reads the whole store.
    Writing an epoch is idempotent (a replayed batch overwrites its own folder)."""

    def __init__(self, spark: SparkSession, base: str, key: str | None = None):
        self.spark, self.base, self.key, self.epochs = spark, base.rstrip("/"), key, []

    def path(self, v: int) -> str:
        return f"{self.base}/epoch={v}"

    def write(self, df: DataFrame, v: int) -> None:
        df.write.mode("overwrite").parquet(self.path(v))
        if v not in self.epochs:
            self.epochs.append(v)

    def read_all(self) -> DataFrame | None:
        """Every committed epoch in the folder, earlier runs' included; None before the first."""
        from pyarrow import fs as pafs
        filesystem, base = _fs_for(self.base)
        if filesystem.get_file_info(base).type == pafs.FileType.NotFound:
            return None
        return self.spark.read.parquet(self.base)

    def read_latest(self) -> DataFrame | None:
        """Newest row per key (rows of the last epoch without a key)."""
        df = self.read_all()
        if df is None:
            return None
        cols = [c for c in df.columns if c != "epoch"]
        if self.key is None:
            last = df.agg(F.max("epoch")).first()[0]
            return df.where(F.col("epoch") == last).select(*cols)
        latest = df.groupBy(self.key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols if c != self.key]),
                                                    F.col("epoch")).alias("_r"))
        return latest.select(self.key, "_r.*").select(*[F.col(f"`{c}`") for c in cols])


def _run(writer, name: str, spark: SparkSession, checkpoint: str | None = None):
    q = writer.option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_index(spark: SparkSession, root: str, store_path: str | None = None, checkpoint: str | None = None,
                 max_size: int | None = None, settle: float = 2.0, full: bool = False) -> DataFrame:
    """STR1: message files that are new below root since the last run are read, parsed and put into the store by path.

    Folders are found and listed by the tasks of the ``maildir`` source; of a changed folder's files, only those that the store doesn't hold
    as they are get read. The store is a ``KeyedStore``, the same that ``refresh_store`` keeps, so a batch index and a stream can
    take turns. The stream adds and replaces; removal is the batch index's. A batch that is replayed finds its files stored.
    Returns the stored messages.
    """
    register(spark)
    store = KeyedStore(spark, store_path or scratch_path(spark, "stream-index"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = (spark.readStream.format("maildir").option("settle", settle).option("parts", n).option("full", full).load(root))

    def upsert(batch: DataFrame, epoch: int) -> None:
        listed, stored = cap_size(batch, max_size), store.read()
        todo = checkpointed(new_or_changed(listed, stored) if stored is not None else listed)
        store.upsert(parse_messages(read_files(todo.repartition(n, "path")), root), keys=todo)

    _run(files.writeStream.foreachBatch(upsert), "stream-index", spark, checkpoint)
    out = store.read()
    if out is None:
        return parse_messages(spark.createDataFrame([], "path string, mtime timestamp_ntz, size bigint, content binary"), root)
    return out


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int = 1) -> DataFrame:
    """A driver table read as a stream (a file source needs a directory or a
    glob; the one-character class makes the glob match only this table)."""
    sf_dir = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(f"{sf_dir}/{name}.parq[u]et"))


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The events table read as a stream."""
    return table_stream(spark, sf_dir, "events", max_files_per_trigger)


def stream_dedupe(s: DataFrame, key: str = "msgid", event_time: str = "date", delay: str = "1 day") -> DataFrame:
    """STR2 with bounded state: the first copy of each message id within the watermark delay.
    Copies arriving after the watermark has passed the first copy re-appear; ``stream_first_copies`` keeps them out."""
    return s.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stream_first_copies(spark: SparkSession, s: DataFrame, key: str = "msgid", order: str = "date", store_path: str | None = None,
                        checkpoint: str | None = None) -> DataFrame:
    """STR2 without a watermark: of each key the first copy ever seen, by ``order`` within its batch; later copies stay out however late.

    The ids seen are the store's own rows, and a batch reads only the buckets of its keys, so memory doesn't grow with the stream.
    A replayed batch finds its rows stored. Null keys are left out.
    """
    store = KeyedStore(spark, store_path or scratch_path(spark, "stream-first"), key=key)

    def keep(batch: DataFrame, epoch: int) -> None:
        others = [c for c in batch.columns if c != key]
        first = checkpointed(batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(key, "_r.*"))
        known = store.read_for(first)
        new = first if known is None else checkpointed(first.join(known.select(key), key, "left_anti"))
        store.upsert(new, keys=new)

    _run(s.writeStream.foreachBatch(keep), "stream-first", spark, checkpoint)
    out = store.read()
    return spark.createDataFrame([], s.schema) if out is None else out.select(*s.columns)


def collect_stream(spark: SparkSession, s: DataFrame, name: str, mode: str = "append", store_path: str | None = None,
                   checkpoint: str | None = None) -> DataFrame:
    """Run a stream to completion into an epoch store; return what it wrote
    (all epochs in append mode, the last result in complete mode)."""
    store = EpochStore(spark, store_path or scratch_path(spark, name))

    def sink(batch: DataFrame, epoch: int) -> None:
        store.write(batch, epoch)

    _run(s.writeStream.outputMode(mode).foreachBatch(sink), name, spark, checkpoint)
    out = store.read_latest() if mode == "complete" else store.read_all()
    if out is None:
        return spark.createDataFrame([], s.schema)
    return out.drop("epoch")


def stream_contacts(spark: SparkSession, occ: DataFrame, store_path: str | None = None,
                    checkpoint: str | None = None) -> DataFrame:
    """STR3: running freq / last_seen per e-mail. Update mode emits the new
    running totals of the keys a batch touched; they are appended and the
    newest per key is the contact table."""
    store = EpochStore(spark, store_path or scratch_path(spark, "stream-contacts"), key="key")
    agg = occ.groupBy(F.lower("email").alias("key")).agg(F.count("*").alias("freq"), F.max("date").alias("last_seen"))
    _run(agg.writeStream.outputMode("update").foreachBatch(lambda b, e: store.write(b, e)), "stream-contacts", spark, checkpoint)
    return store.read_latest()


def stream_saved_counts(spark: SparkSession, s: DataFrame, queries: dict[str, Column], flags: str = "flags",
                        store_path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """STR4: running total / unread per saved query (complete mode)."""
    aggs = []
    for i, (_name, e) in enumerate(queries.items()):
        e = F.coalesce(e, F.lit(False))
        aggs += [F.count_if(e).alias(f"t{i}"), F.count_if(e & is_unread(flags)).alias(f"u{i}")]
    wide = collect_stream(spark, s.agg(*aggs), "stream-counts", "complete", store_path, checkpoint)
    rows = [F.struct(F.lit(n).alias("name"), F.col(f"t{i}").alias("total"), F.col(f"u{i}").alias("unread"))
            for i, n in enumerate(queries)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
