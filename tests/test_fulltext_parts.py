"""Full-text index operators and MIME-part operators on literal tables."""

from pyspark.sql import functions as F

from postlake.operators import fulltext as FT
from postlake.operators import parts as PT
from postlake.session import scratch_path


def _postings(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "the lazy dog; quick Fox!"),
                                  (3, "Über den Fluß, schnell")], "doc_id bigint, body string")
    path = scratch_path(spark, "t-postings")
    FT.write_postings(FT.build_postings(docs, {"body": "body"}), path)
    return spark.read.parquet(path)


def _ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_terms_phrase_regex(spark):
    p = _postings(spark)
    assert _ids(FT.match_terms(p, [("body", "QUICK"), ("body", "fox")], "and")) == [1, 2]
    assert _ids(FT.match_terms(p, [("body", "dog"), ("body", "uber")], "or")) == [2, 3]
    assert _ids(FT.match_terms(p, [("body", "quick")], "and", exclude=[("body", "lazy")])) == [1]
    assert _ids(FT.match_phrase(p, "body", "quick brown")) == [1]
    assert _ids(FT.match_phrase(p, "body", "quick fox")) == [2]
    assert _ids(FT.match_regex(p, "body", "^f.*[sx]$")) == [1, 2]  # fox; "fluß" keeps its ß
    assert _ids(FT.match_regex(p, "body", "ß$")) == [3]
    assert _ids(FT.match_prefix(p, "body", "schn*")) == [3]
    d = {r["term"]: r["n_docs"] for r in FT.term_dictionary(p, "body").collect()}
    assert d["the"] == 2 and d["fluß"] == 1


def _parts(spark):
    rows = [(1, 1, "text/plain", 10, None, None, "c1"), (1, 2, "image/png", 2000, "attachment", "a/b:c.png", "c2"),
            (1, 3, "text/html", 30, "inline", None, "c3"), (2, 1, "text/plain", 5, "attachment", "notes.txt", "c4")]
    return spark.createDataFrame(rows, "doc_id bigint, part_index int, mime_type string, size bigint, "
                                       "disposition string, filename string, cid string")


def test_parts_views(spark):
    p = _parts(spark)
    assert sorted((r["doc_id"], r["part_index"]) for r in PT.select_attachments(p).collect()) == [(1, 2), (2, 1)]
    names = {(r["doc_id"], r["part_index"]): r["name"] for r in PT.list_parts(p).collect()}
    assert names[(1, 2)] == "a-b-c.png" and names[(1, 1)] == "1.msgpart"
    assert _ids(PT.select_by_name(p, "NOTES\\.txt")) == [2]
    assert _ids(PT.part_by_cid(p, "<c3>")) == [1]
    att = {r["doc_id"]: r["attachments"] for r in PT.attachment_list(p).collect()}
    assert att == {1: "'a-b-c.png'", 2: "'notes.txt'"}
    flags = {r["doc_id"]: r["has_attach"] for r in PT.message_flags_from_parts(p).collect()}
    assert flags == {1: True, 2: True}
    mc = {r["mime_type"]: (r["n_parts"], r["n_msgs"]) for r in PT.mime_counts(p).collect()}
    assert mc["text/plain"] == (2, 2)
