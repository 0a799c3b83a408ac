"""Versions of tables: what is derived from one is made anew when its files change."""

from pyspark.sql import functions as F

from postlake.plans.textindex import dictionary
from postlake.sources import tables as T


def _write(spark, root, texts):
    rows = [(k, text, "en", "web", len(text)) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{root}/documents.parquet")


def test_derived_tables_follow_their_source(spark, tmp_path):
    root = str(tmp_path)
    _write(spark, root, ["one two", "two"])
    before = T.version(spark, root, "documents")
    assert before == T.version(spark, root, "documents")
    assert {(r.term, r.n_docs) for r in dictionary(spark, root).collect()} == {("one", 1), ("two", 2)}
    _write(spark, root, ["three words here", "three"])
    assert T.version(spark, root, "documents") != before
    assert {r.term: r.n_docs for r in dictionary(spark, root).where(F.col("term") != "here").collect()} == {"three": 2, "words": 1}
