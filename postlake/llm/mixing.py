"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import ranked
from .common import n_words, running_sums, stored


def symbol_quality(text: Column) -> Column:
    """Quality weight of a text in (0, 1]: falls with the share of characters that are symbols."""
    size = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))
    symbols = size - F.greatest(F.coalesce(F.length(F.translate(text, "#*$%&|<>!{}", "")), F.lit(0)), F.lit(0))
    return F.when(text.isNull() | (text == ""), F.lit(1.0)).otherwise(1.0 / (1.0 + 20.0 * symbols / size))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """Word targets from (source, source_size): weights repeat over sources in code point order, null last.

    Targets share the sum of all sizes by weight; none exceeds ``cap`` times its source's size, and
    the excess goes to the others by weight until none is above. In order of cap / weight, the sources
    up to some place are capped and the rest share what is left: the first place where the rest's
    share per weight fits under its own caps is the answer, found with running sums. Sources may be as many as
    documents: they are ranked and summed over many tasks, and only totals and the answer's share come to the driver.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    by = ranked(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], out="_place")
    by = (by.withColumn("weight", F.get(w, ((F.col("_place") - 1) % len(weights)).cast("int")))
          .withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
          .select("source", "source_size", "weight", "most", "ratio", F.lit(0).alias("_all")))
    summed = stored(running_sums(by, "_all", ["ratio", "source"], {"_most": F.col("most"), "_weight": F.col("weight")}), "sources")
    total = summed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    share = (F.lit(float(total["size"] or 0)) - F.col("_most")) / (F.lit(total["weight"] or 0.0) - F.col("_weight"))
    answer = summed.withColumn("_share", share).where(F.col("_share") <= F.col("ratio") * (1 + 1e-12)).agg(
        F.min(F.struct("ratio", "source", "_share")).alias("at")).first()["at"]
    level = F.lit(answer["_share"] if answer else None).cast("double")
    return summed.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def repeat_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scored: DataFrame | None = None, **options) -> DataFrame:
    """The mix as documents: each as often as it is taken, with its own columns; those not taken are gone.

    ``scored`` is the documents with the further columns that ``quality`` is made of, where ``docs`` lacks them. Whole
    copies of a row fare alike, as the one of them that is taken most often.
    """
    keys = lambda: [F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k1"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("_k2")]
    mixed = mix_sources(docs if scored is None else scored, id_col, text_col, **options)
    times = mixed.groupBy("k1", "k2").agg(F.max("times").alias("times")).where("times > 0")
    rows = docs.select(*keys(), F.struct("*").alias("_row"))
    taken = rows.join(times.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "times"), ["_k1", "_k2"])
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("_row.*")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                quality: Column | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0,
                seed: int = 1) -> DataFrame:
    """One row per document: id, source, size, source_size, target, epochs, times, key, k1, k2, taken.

    A document's size is its number of words, and ``taken`` how many of its words the mix takes,
    repeats counted: whole epochs of the source first, then for what is left of the target the
    documents with the smallest keys -ln(u) / quality, u drawn by hash from seed, id and text, whose
    prefix sums of sizes fit (to half a document). So better documents are likelier to repeat, no
    document exceeds ``cap`` times its size when the cap is a whole number, and reruns agree.
    ``times`` is how often it is taken, and k1 and k2 hash id and text. ``quality`` is a column of the documents with weights above 0 (null or NaN: 1;
    0 and less count as 1e-9, so such documents come last in a partial epoch).

    Null or empty texts have size 0 and take 0. Null sources are one source, the last. Null and
    repeated ids are documents of their own; whole copies of a row tie, and any order among them gives
    the same result. An empty table gives no rows. Other columns are ignored.
    """
    text = F.col(text_col)
    quality = symbol_quality(text) if quality is None else quality
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11) + F.lit(0.5)) / F.lit(2.0 ** 53)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text).alias("size"),
                       (-F.log(u) / F.greatest(F.coalesce(F.nanvl(quality.cast("double"), F.lit(None).cast("double")), F.lit(1.0)), F.lit(1e-9))).alias("key"),
                       F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(1), F.col(id_col), text).alias("k2"))
    rows = stored(rows, "sizes")  # narrow, so that sampling the ranges reads no text again
    summed = running_sums(rows, "source", ["key", "id", "size"], {"before": F.col("size")})
    sizes = summed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap).withColumnRenamed("source", "_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    again = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))
    return (summed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("epochs", epochs).withColumn("rest", rest)
            .withColumn("times", F.col("epochs") + again.cast("long")).withColumn("taken", F.col("size") * F.col("times"))
            .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "epochs", "times", "key", "k1", "k2", "taken"))
