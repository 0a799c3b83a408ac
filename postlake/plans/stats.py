"""Aggregation queries: counts, saved queries, tabulations, statistics and time
histograms (AGG1-AGG15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import line_count
from ..operators import aggregates as A
from ..operators import predicates as Q
from ..sources import tables as T
from .catalog import query
from .sqlviews import EVENT_MSGS

_UNREAD = "((flags & 64) <> 0 OR (flags & 16) = 0)"


@query("count_all", sql=f"""
SELECT CAST(count(*) AS BIGINT) AS n FROM {EVENT_MSGS} e WHERE (flags & 2) <> 0 OR value > 90""")
def count_all(spark, sf):
    e = T.msgs_from_events(spark, sf)
    return A.count(e, Q.has_flag("flags", "flagged") | (F.col("value") > 90))


_SAVED = {
    "errors": ("lower(maildir) = '/error'", lambda: Q.maildir_is("maildir", "/error")),
    "flagged": ("(flags & 2) <> 0", lambda: Q.has_flag("flags", "F")),
    "big": ("value > 50", lambda: F.col("value") > 50),
    "all": ("true", lambda: Q.match_all()),
}


@query("saved_counts", sql=" UNION ALL ".join(
    f"SELECT '{k}' AS name, CAST(count(*) FILTER (WHERE {s}) AS BIGINT) AS total, "
    f"CAST(count(*) FILTER (WHERE ({s}) AND {_UNREAD}) AS BIGINT) AS unread FROM {EVENT_MSGS} e"
    for k, (s, _) in _SAVED.items()))
def saved_counts(spark, sf):
    e = T.msgs_from_events(spark, sf)
    return A.saved_query_counts(e, {k: f() for k, (_, f) in _SAVED.items()})


@query("tabulate_scalar", sql="""
SELECT 'user' || CAST(user_id AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS freq
FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def tabulate_scalar(spark, sf):
    e = T.msgs_from_events(spark, sf)
    return A.tabulate(e, F.col("from"), F.col("event_type") == "purchase")


@query("tabulate_list", sql="""
SELECT value, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest([lang, source]) AS value FROM documents) GROUP BY value""")
def tabulate_list(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    return A.tabulate(d, F.col("tags"))


@query("top_n", sql="""
SELECT value, CAST(count(*) AS BIGINT) AS freq FROM (SELECT 'user' || CAST(user_id AS VARCHAR) AS value FROM events)
GROUP BY value ORDER BY freq DESC, value LIMIT 10""")
def top_n(spark, sf):
    e = T.msgs_from_events(spark, sf)
    return A.top_n_most_frequent(e, F.col("from"), 10)


@query("stats_size", sql="""
SELECT lang, round(avg(n_chars), 6) AS average, round(stddev_pop(n_chars), 6) AS stddev,
  max(n_chars) AS max, min(n_chars) AS min,
  round(corr(n_chars, length(text) - length(replace(text, chr(10), ''))), 6) AS correl
FROM documents GROUP BY lang""")
def stats_size(spark, sf):
    d = T.msgs_from_documents(spark, sf)
    out = (d.groupBy("lang").agg(F.avg("size").alias("average"), F.stddev_pop("size").alias("stddev"),
                                 F.max("size").alias("max"), F.min("size").alias("min"),
                                 F.corr(F.col("size").cast("double"), line_count("body_text").cast("double")).alias("correl")))
    return out.select("lang", F.round("average", 6).alias("average"), F.round("stddev", 6).alias("stddev"),
                      "max", "min", F.round("correl", 6).alias("correl"))


@query("stats_events", sql="""
SELECT round(avg(value), 6) AS average, round(stddev_pop(value), 6) AS stddev, max(value) AS max,
  min(value) AS min, round(corr(value, CAST(user_id AS DOUBLE)), 6) AS correl FROM events""")
def stats_events(spark, sf):
    e = T.msgs_from_events(spark, sf)
    s = A.stats(e, F.col("value"), F.col("user_id").cast("double"))
    return s.select(F.round("average", 6).alias("average"), F.round("stddev", 6).alias("stddev"), "max", "min",
                    F.round("correl", 6).alias("correl"))


@query("per_weekday", sql="""
SELECT CAST(dayofweek(ts) AS BIGINT) AS weekday, strftime(ts, '%a') AS name, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL""")
def per_weekday(spark, sf):
    return A.per_weekday(T.msgs_from_events(spark, sf))


@query("per_hour", sql="""
SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def per_hour(spark, sf):
    return A.per_hour(T.msgs_from_events(spark, sf))


@query("per_month", sql="""
SELECT CAST(month(o_orderdate) AS BIGINT) AS month, strftime(o_orderdate, '%b') AS name, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY ALL""")
def per_month(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_orderdate").alias("date"))
    return A.per_month(o)


@query("per_year_month", sql="""
SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS year_month, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY ALL""")
def per_year_month(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_orderdate").alias("date"))
    return A.per_year_month(o)


@query("per_year", sql="""
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL""")
def per_year(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_orderdate").alias("date"))
    return A.per_year(o)
