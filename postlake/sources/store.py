"""A table of one row per key that batches and streams update in place (SRC7, SRC8).

Rows lie in Parquet folders by a bucket of the key's hash. An update writes the buckets that it touches, with Spark's
dynamic partition overwrite, and no other file changes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed

BUCKET, GONE = "_bucket", "_gone"


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class KeyedStore:
    """The table at ``base``. The number of buckets is fixed when it is first written; a later opener reads it from there.

    A bucket is rewritten whole, so choose buckets of the size of a file or a few. A removed key leaves a row of its key only
    (a bucket that had no row left couldn't be overwritten), which goes with the bucket's next update. An update that ends half way
    leaves ``dirty`` set: what it should have written is then to be written again, as ``refresh_store`` and a stream's replay do.
    """

    def __init__(self, spark: SparkSession, base: str, key: str = "path", buckets: int = 64):
        self.spark, self.base, self.key = spark, base.rstrip("/"), key
        state = read_if_there(spark, f"{self.base}/state")
        row = state.first() if state is not None else None
        self.buckets, self.dirty = (row["buckets"], row["dirty"]) if row else (buckets, False)

    def _mark(self, dirty: bool) -> None:
        (self.spark.createDataFrame([(self.buckets, dirty)], "buckets int, dirty boolean").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.base}/state"))
        self.dirty = dirty

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame | None:
        return read_if_there(self.spark, f"{self.base}/rows")

    def read(self) -> DataFrame | None:
        """The rows as they are now; None before the first update. Read again after an update: files are replaced."""
        rows = self._rows()
        return None if rows is None else rows.where(~F.col(GONE)).drop(BUCKET, GONE)

    def read_for(self, keys: DataFrame) -> DataFrame | None:
        """The rows of some keys; only the folders of their buckets are read."""
        rows = self._rows()
        if rows is None:
            return None
        keys = checkpointed(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct())
        buckets = [r[0] for r in keys.select(self.bucket_of(F.col(self.key))).distinct().collect()]
        return rows.where(F.col(BUCKET).isin(buckets) & ~F.col(GONE)).drop(BUCKET, GONE).join(keys, self.key, "left_semi")

    def upsert(self, batch: DataFrame, keys: DataFrame | None = None, removed: DataFrame | None = None, newest: str | None = None) -> list[int]:
        """Insert or replace the rows of ``batch`` by key, remove the keys of ``removed``, and return the buckets written.

        Of rows of one key in the batch, the one of the greatest ``newest`` stays (any one without it). ``keys`` has the batch's keys where
        they are known without computing it; a batch without it is written to the checkpoint folder first. Null keys are left out.
        """
        batch = batch.where(F.col(self.key).isNotNull())
        if keys is None:
            batch = checkpointed(batch)
            keys = batch
        touched = keys.select(self.key) if removed is None else keys.select(self.key).union(removed.select(self.key))
        buckets = sorted(r[0] for r in touched.where(F.col(self.key).isNotNull()).select(self.bucket_of(F.col(self.key))).distinct().collect())
        if not buckets:
            return []
        here = F.col(BUCKET).isin(buckets)
        old = self._rows()
        columns = [f.name for f in (old.schema if old is not None else batch.schema) if f.name not in (BUCKET, GONE)]
        kinds = {f.name: f.dataType for df in (batch, old) if df is not None for f in df.schema}
        named = lambda df: df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
        new = named(batch).withColumns({GONE: F.lit(False), "_age": F.lit(1)})
        if removed is not None:
            new = new.unionByName(named(removed.select(self.key).distinct()).withColumns({GONE: F.lit(True), "_age": F.lit(2)}))
        if old is not None:
            new = new.unionByName(old.where(here & ~F.col(GONE)).select(*[F.col(f"`{c}`") for c in columns], GONE).withColumn("_age", F.lit(3)))
        new = new.withColumn(BUCKET, self.bucket_of(F.col(self.key)))
        # one exchange: the window's groups lie inside the buckets that rows are dealt by
        order = [F.col("_age"), *([F.desc(newest)] if newest else [])]
        one = (new.repartition(len(buckets), BUCKET).withColumn("_nth", F.row_number().over(Window.partitionBy(BUCKET, self.key).orderBy(*order)))
               .where("_nth = 1").drop("_nth", "_age"))
        self._mark(True)
        one.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.base}/rows")
        self._mark(False)
        return buckets
