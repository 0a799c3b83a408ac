"""Property tests: each example is one small Spark job over a generated batch."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from postlake.functions import flags as FL
from postlake.functions import text as X
from postlake.operators.windows import ranked
from postlake.schema import FLAG_BITS

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
MASK = sum(b for letter, b in FLAG_BITS.items() if letter != "u")


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=MASK), min_size=1, max_size=200))
def test_flags_roundtrip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "f int")
    out = df.select("f", FL.flags_from_string(FL.flags_to_string("f")).alias("g")).collect()
    assert all(r["f"] == r["g"] for r in out)


_ALPHABET = st.characters(min_codepoint=0x20, max_codepoint=0x04FF, blacklist_categories=("Cs",))


@SETTINGS
@given(st.lists(st.text(alphabet=_ALPHABET, max_size=30), min_size=1, max_size=100))
def test_flatten_matches_python_twin(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r["i"]: r["f"] for r in df.select("i", X.flatten("s").alias("f")).collect()}
    assert all(got[i] == X.flatten_py(t) for i, t in enumerate(texts))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", "c"]), st.integers(0, 50)),
                min_size=1, max_size=300))
def test_ranked_equals_row_number(spark, rows):
    df = spark.createDataFrame([(g, k, i) for i, (g, k) in enumerate(rows)], "g string, k int, id int")
    r = ranked(df, [F.col("k"), F.col("id")], ["g"], out="rk", num_partitions=4)
    w = r.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert w.where("rk != rn").count() == 0
    assert r.count() == len(rows)
