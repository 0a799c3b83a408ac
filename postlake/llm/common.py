"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: fixed value: what counts as a word in every operator here
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` written as Parquet to the shared folder and read back with its schema."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, group: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """For each name in ``values``, the sum of its column over the rows before this one in its group.

    Rows are dealt by range of (group, order), so that a hot group spans many tasks; each task
    sums its own rows, and gets as offset what earlier tasks hold of the group. The table of offsets
    has one row per task and group; it joins on both, and Spark broadcasts it only if it is small.
    Rows that tie in ``order`` get some order among themselves.
    """
    parted = (df.repartitionByRange(shuffle_partitions(df.sparkSession), group, *order)
              .withColumn("_task", F.spark_partition_id()).withColumns({f"_v{k}": c for k, c in enumerate(values.values())}))
    local = stored(parted, "range")  # fixed, so that both branches below see the same tasks
    held = local.groupBy("_task", group).agg(*[F.sum(f"_v{k}").alias(f"_h{k}") for k in range(len(values))])
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(F.col("_task").alias("_t"), F.col(group).alias("_g"), *[
        F.coalesce(F.sum(f"_h{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in range(len(values))])
    w = Window.partitionBy("_task", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (local.withColumns({f"_s{k}": F.coalesce(F.sum(f"_v{k}").over(w), F.lit(0)) for k in range(len(values))})
            .join(offsets, (F.col("_task") == F.col("_t")) & F.col(group).eqNullSafe(F.col("_g")))
            .select(*df.columns, *[(F.col(f"_s{k}") + F.col(f"_o{k}")).alias(name) for k, name in enumerate(values)]))


def n_words(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def min_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges``: (node, label), label the smallest node reachable.

    Rounds of two steps, each a shuffle with map-side minimum: every node takes the smallest label
    among its neighbours, then the label of its label, so that paths halve. A round is written to the
    shared folder, and the rounds end when none changes a label. A node with very many links is
    pre-aggregated by ``min`` before the shuffle; nothing is collected but the number of changes.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                  .union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct(), "links")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m"))
                    .select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), "label"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near")))
        hop = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                               F.least("label", "near").alias("step"))
        up = labels.select(F.col("node").alias("step"), F.col("label").alias("far"))
        new = stored(hop.join(up, "step", "left")
                     .select("node", "old", F.least("step", F.coalesce("far", "step")).alias("label")), "labels")
        moved = new.where("label <> old").count()
        labels = new.select("node", "label")
        if not moved:
            return labels
