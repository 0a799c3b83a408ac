"""Chat formatting: logged snapshots of a growing conversation collapse into the longest, then rendering.

Places, prefixes and the choice of conversations need hashes of the turns only; texts are read for the rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sums, stored

#: turns to a row of rendered text
PART = 256


def _hashes(name: str, *columns: str) -> dict[str, Column]:
    """Two independent 64-bit hashes of columns, nulls told from other values."""
    flagged = [c for name_ in columns for c in (F.col(name_), F.col(name_).isNull())]
    return {f"{name}{k}": F.xxhash64(F.lit(k), *flagged) for k in (1, 2)}


def hashed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns as conv, turn, role, text, with the hashes of their content (c1, c2) and of the whole row (i1, i2).

    A row with a null conversation is a conversation of one turn, so its turn number is of no account.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.when(F.col(conv_col).isNotNull(), F.col(turn_col)).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return rows.withColumns(_hashes("c", "role", "text") | _hashes("i", "conv", "turn", "role", "text"))


def _text_order(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``narrow`` with ``nth``: the order by text among turns of one conversation, number and role; only these texts are read."""
    same = ["conv", "turn", "role"]
    content = F.struct("c1", "c2")
    ties = stored(narrow.groupBy(*same).agg(F.min(content).alias("lo"), F.max(content).alias("hi")).where("lo <> hi").select(*[F.col(c).alias(f"_{c}") for c in same]), "ties")
    if ties.isEmpty():
        return narrow.withColumn("nth", F.lit(0).cast("long"))
    tied = (F.col("conv") == F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & F.col("role").eqNullSafe(F.col("_role"))
    texts = rows.join(ties, tied, "left_semi").dropDuplicates(["i1", "i2"]).select(*same, "text", "i1", "i2")
    nth = running_sums(texts, "conv", ["turn", "role", "text"], {"nth": F.lit(1).cast("long")}).select("i1", "i2", "nth")
    return narrow.join(nth, ["i1", "i2"], "left").withColumn("nth", F.coalesce("nth", F.lit(0).cast("long")))


def turn_prefixes(rows: DataFrame) -> DataFrame:
    """The turns of ``hashed_turns`` that have a conversation, without their texts: conv, place, length, h1, h2, i1, i2.

    A turn's term hashes its place and content, and the hash (h1, h2) of the prefix that it ends is the sum of its terms,
    held as two independent 64-bit hashes summed without overflow. Sums over a long conversation are
    distributed (see ``running_sums``). Equal turn numbers are ordered by role, then text, nulls first.
    """
    narrow = stored(rows.where("conv is not null").drop("text"), "narrow")
    placed = running_sums(_text_order(rows, narrow), "conv", ["turn", "role", "nth"], {"place": F.lit(1).cast("long")})
    placed = placed.select("conv", "place", "i1", "i2", *_terms())
    summed = running_sums(placed, "conv", ["place"], {"_p1": F.col("_t1"), "_p2": F.col("_t2")})
    return summed.select("conv", "place", (F.col("place") + 1).alias("length"), (F.col("_p1") + F.col("_t1")).alias("h1"), (F.col("_p2") + F.col("_t2")).alias("h2"), "i1", "i2")


def _terms() -> list[Column]:
    return [F.xxhash64(F.lit(k), "place", "c1", "c2").cast("decimal(20,0)").alias(f"_t{k}") for k in (1, 2)]


def single_turns(rows: DataFrame) -> DataFrame:
    """Conversations of the rows that have none, equal ones as one with their number: n, h1, h2, copies, i1, i2."""
    alone = rows.where("conv is null").withColumn("place", F.lit(0).cast("long")).select("i1", "i2", *_terms())
    return alone.groupBy("i1", "i2", "_t1", "_t2").agg(F.count("*").alias("copies")).select(
        F.lit(1).cast("long").alias("n"), F.col("_t1").cast("decimal(31,0)").alias("h1"), F.col("_t2").cast("decimal(31,0)").alias("h2"), "copies", "i1", "i2")


def maximal_conversations(prefixes: DataFrame, singles: DataFrame) -> DataFrame:
    """(conv, h1, h2, n_turns, n_copies) of the conversations that are no proper prefix of another; of equal ones
    the smallest id stays, null last. ``prefixes`` and ``singles`` are what ``turn_prefixes`` and ``single_turns`` return.

    Prefix hashes are made distinct before the anti-join, so that a first turn shared by very many
    conversations is one row.
    """
    ends = prefixes.groupBy("conv").agg(F.max("length").alias("n"), F.max_by("h1", "length").alias("h1"), F.max_by("h2", "length").alias("h2"))
    each = ends.select("conv", "n", "h1", "h2", F.lit(1).cast("long").alias("copies")).union(
        singles.select(F.lit(None).cast(ends.schema["conv"].dataType), "n", "h1", "h2", "copies"))
    whole = each.groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.sum("copies").alias("n_copies"))
    inner = (prefixes.join(ends.select("conv", "n"), "conv").where("length < n")
             .select(F.col("length").alias("n"), "h1", "h2").distinct())
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv", "h1", "h2", F.col("n").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", part: int = PART) -> DataFrame:
    """Maximal conversations as text: conv_id, part, n_turns, n_copies, text.

    A turn renders as ``<|im_start|>role\\ntext<|im_end|>\\n``; ``<|`` in a text or role becomes ``< |``, a
    null role ``unknown`` and a null text empty. A conversation has one row per ``part`` turns, so that
    a conversation of any length is never gathered in one task; the parts in order are its whole text.
    Snapshots and copies of a conversation vanish, the longest and of equals the smallest id stays.
    Rows of null conversation are conversations of one turn each, also where they are equal: these count as copies. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = hashed_turns(turns, conv_col, turn_col, role_col, text_col)
    prefixes = stored(turn_prefixes(rows), "turns")
    singles = stored(single_turns(rows), "singles")
    kept = stored(maximal_conversations(prefixes, singles), "kept")
    # equal rows of a conversation lie on places in a row
    slots = (prefixes.select("conv", "place", "i1", "i2").join(kept.select("conv", "n_turns", "n_copies"), "conv")
             .groupBy("i1", "i2").agg(F.min("place").alias("first"), F.count("*").alias("many"), F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies")))
    alone = singles.join(kept.where("conv is null").withColumnRenamed("n_turns", "n"), ["n", "h1", "h2"]).select(
        "i1", "i2", F.lit(0).cast("long"), F.lit(1).cast("long"), "n", "n_copies")
    safe = lambda c, empty: F.replace(F.coalesce(F.col(c), F.lit(empty)), F.lit("<|"), F.lit("< |"))
    shown = F.concat(F.lit("<|im_start|>"), safe("role", "unknown"), F.lit("\n"), safe("text", ""), F.lit("<|im_end|>\n"))
    texts = rows.groupBy("i1", "i2").agg(*[F.first(c).alias(c) for c in ("conv", "role", "text")])
    placed = (texts.join(slots.union(alone), ["i1", "i2"])
              .withColumn("place", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1))))
    own = [F.when(F.col("conv").isNull(), F.col(c)).alias(f"_{c}") for c in ("i1", "i2")]  # parts of rows without a conversation stay apart
    return (placed.groupBy("conv", *own, F.floor(F.col("place") / part).alias("part"))
            .agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
                 F.sort_array(F.collect_list(F.struct(F.col("place"), shown.alias("shown")))).alias("turns"))
            .select(F.col("conv").alias(conv_col), "part", "n_turns", "n_copies", F.array_join(F.col("turns.shown"), "").alias("text")))
