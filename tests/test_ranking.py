"""Distributed ranking equals a window row_number, also with a hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlake.operators.windows import ranked


def test_ranked_hot_group(spark):
    n = 3000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 50).cast("string")).alias("g"), (F.col("id") * 7919 % n).alias("k"), "id")
    r = ranked(df, [F.col("k"), F.col("id")], ["g"], out="rk", num_partitions=8)
    w = r.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert r.count() == n
    assert w.where("rk != rn").count() == 0


def test_ranked_global(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    r = ranked(df, [F.col("k")], out="rk", num_partitions=8)
    assert r.where("rk != k + 1").count() == 0


def test_ranked_groups_of_any_simple_type(spark):
    """Nulls, NaN, several columns, and groups that end where a task does."""
    df = spark.range(2000).selectExpr("id", "if(id % 5 = 0, null, concat('g', id % 3)) as a", "case id % 4 when 0 then double('NaN') when 1 then null else 1.5 end as b")
    r = ranked(df, [F.col("id")], ["a", "b"], out="rk", num_partitions=7)
    w = r.withColumn("rn", F.row_number().over(Window.partitionBy("a", "b").orderBy("id")))
    assert r.columns == ["id", "a", "b", "rk"] and r.count() == 2000
    assert w.where("rk != rn").count() == 0
    assert ranked(df.limit(0), [F.col("id")], ["a"], out="rk").count() == 0
    assert {x.rk for x in ranked(df.where("id < 3"), [F.col("id")], out="rk").collect()} == {1, 2, 3}
