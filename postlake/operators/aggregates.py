"""Aggregations: counts, saved queries, tabulations, statistics, histograms
(AGG1-AGG15, AGG18-AGG21). Catalyst plans partial + final aggregation, so a
hot group costs one partial row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.flags import is_unread


def count(m: DataFrame, expr: Column | None = None) -> DataFrame:
    """AGG1 / AGG15."""
    return (m.where(expr) if expr is not None else m).agg(F.count("*").alias("n"))


def saved_query_counts(m: DataFrame, queries: dict[str, Column], flags: str = "flags") -> DataFrame:
    """AGG2: total and unread per saved query in ONE pass, then unpivoted."""
    aggs = []
    for i, (name, e) in enumerate(queries.items()):
        aggs += [F.count_if(F.coalesce(e, F.lit(False))).alias(f"t{i}"),
                 F.count_if(F.coalesce(e, F.lit(False)) & is_unread(flags)).alias(f"u{i}")]
    wide = m.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("name"), F.col(f"t{i}").alias("total"), F.col(f"u{i}").alias("unread"))
            for i, name in enumerate(queries)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def folder_counts(m: DataFrame, flags: str = "flags") -> DataFrame:
    """AGG3: one saved query per folder."""
    return m.groupBy("maildir").agg(F.count("*").alias("total"), F.count_if(is_unread(flags)).alias("unread"))


def tabulate(m: DataFrame, fn: Column, expr: Column | None = None, name: str = "value") -> DataFrame:
    """AGG4: value -> frequency; an array value counts each element."""
    src = m.where(expr) if expr is not None else m
    v = src.select(fn.alias(name))
    if isinstance(v.schema[name].dataType, ArrayType):
        v = v.select(F.explode(name).alias(name))
    return v.groupBy(name).agg(F.count("*").alias("freq"))


def top_n_most_frequent(m: DataFrame, fn: Column, n: int, expr: Column | None = None, name: str = "value") -> DataFrame:
    """AGG5: the n most frequent values (ties by value)."""
    return tabulate(m, fn, expr, name).orderBy(F.col("freq").desc(), F.col(name).asc()).limit(n)


def stats(m: DataFrame, fn: Column, fn2: Column | None = None, expr: Column | None = None) -> DataFrame:
    """AGG6-9: average, population stddev, max, min, and Pearson correlation."""
    src = m.where(expr) if expr is not None else m
    aggs = [F.avg(fn).alias("average"), F.stddev_pop(fn).alias("stddev"), F.max(fn).alias("max"), F.min(fn).alias("min")]
    if fn2 is not None:
        aggs.append(F.corr(fn, fn2).alias("correl"))
    return src.agg(*aggs)


def per_weekday(m: DataFrame, date: str = "date") -> DataFrame:
    """AGG10: 0 = Sunday ... 6 = Saturday, with short names."""
    d = F.col(date)
    return (m.where(d.isNotNull()).groupBy((F.dayofweek(d) - 1).cast("bigint").alias("weekday"))
            .agg(F.first(F.date_format(d, "EEE")).alias("name"), F.count("*").alias("n")))


def per_hour(m: DataFrame, date: str = "date") -> DataFrame:
    """AGG11."""
    d = F.col(date)
    return m.where(d.isNotNull()).groupBy(F.hour(d).cast("bigint").alias("hour")).agg(F.count("*").alias("n"))


def per_month(m: DataFrame, date: str = "date") -> DataFrame:
    """AGG12: month of year 1..12 with short names."""
    d = F.col(date)
    return (m.where(d.isNotNull()).groupBy(F.month(d).cast("bigint").alias("month"))
            .agg(F.first(F.date_format(d, "MMM")).alias("name"), F.count("*").alias("n")))


def per_year_month(m: DataFrame, date: str = "date") -> DataFrame:
    """AGG13: year*100 + month, months 1-based (the reference script's months are
    0-based, so its January 2008 is 200800; ours is 200801)."""
    d = F.col(date)
    return (m.where(d.isNotNull()).groupBy((F.year(d) * 100 + F.month(d)).cast("bigint").alias("year_month"))
            .agg(F.count("*").alias("n")))


def per_year(m: DataFrame, date: str = "date") -> DataFrame:
    """AGG14."""
    d = F.col(date)
    return m.where(d.isNotNull()).groupBy(F.year(d).cast("bigint").alias("year")).agg(F.count("*").alias("n"))


def thread_summary(res: DataFrame, thread: str = "thread_id") -> DataFrame:
    """AGG18: newest date, size and first subject per thread."""
    return res.groupBy(thread).agg(F.max("date").alias("newest"), F.count("*").alias("n_msgs"),
                                   F.min_by("subject", F.struct("date", "doc_id")).alias("first_subject"))
