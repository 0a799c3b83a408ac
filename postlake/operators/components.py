"""Connected components (THR2): large-star and small-star contraction, each round two joins and two minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20, 0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node above its neighbours is linked, with them, to the least of them. Edges point down: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", "m")).distinct())


def contract(edges: DataFrame) -> tuple[DataFrame, int]:
    """((node, component), rounds) of edges (a, b); a component is named by its least node.

    Each round's edges are checkpointed, and the rounds end when one changes nothing. Their number grows with the logarithm of the
    nodes, also on a chain. A node with very many neighbours costs its own task one row: minima are taken before the
    shuffle, and Spark splits a skewed join. Null ends, loops and repeated edges don't matter.
    """
    named = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    now, rounds = checkpointed(named.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), 0
    before = _state(now)
    while before[0]:
        now = checkpointed(_small_star(checkpointed(_large_star(now))))
        rounds, after = rounds + 1, _state(now)
        if after == before:
            break
        before = after
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(labels.select("component", "component").distinct()), rounds


def thread_components(m: DataFrame, msgid: str = "msgid", refs: str = "refs", out: str = "component") -> DataFrame:
    """THR2: the messages with the least id, by byte order, of all that share an id with them by any chain of
    message ids and references; ids of messages that aren't there link too. A message without links is its own component."""
    links = m.select(F.col(msgid).alias("a"), F.explode(refs).alias("b"))
    labels = contract(links)[0].select(F.col("node").alias(msgid), F.col("component").alias("_label"))
    return m.join(labels, msgid, "left").withColumn(out, F.coalesce("_label", msgid)).drop("_label").select(*m.columns, out)
