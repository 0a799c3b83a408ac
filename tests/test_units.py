
import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from postlake.functions import dates as D
from postlake.functions import flags as FL
from postlake.functions import people as P
from postlake.functions import text as X
from postlake.operators import predicates as Q
from postlake.schema import FLAG_BITS

OSLO = "Europe/Oslo"
NOW = dt.datetime(2024, 6, 1, 12, 0, 0)
OPEN = 9999999999


def _at(*parts):
    return int(dt.datetime(*parts, tzinfo=ZoneInfo(OSLO)).timestamp())


@pytest.mark.parametrize("expr,lower,expected", [
    ("2021-11-05T14:25:36", True, _at(2021, 11, 5, 14, 25, 36)),
    ("1983-06-30T23:01:02", False, _at(1983, 6, 30, 23, 1, 2)),
    ("1801-01-01T00:00:00", True, 0),  # before the epoch
    ("2019-04-31T06:00:00", True, _at(2019, 4, 30, 23, 59, 59)),  # no such day: the last second of the month
    ("2020-02-29T12:00:00", True, _at(2020, 2, 29, 12, 0, 0)),
    ("2018", True, _at(2018, 1, 1)), ("2018", False, _at(2019, 1, 1) - 1),
    ("2022-09", True, _at(2022, 9, 1)), ("2022-09", False, _at(2022, 10, 1) - 1),
    ("fork", True, 0), ("fork", False, OPEN), ("", True, 0), ("", False, OPEN),
])
def test_date_bounds(expr, lower, expected):
    assert D.parse_date_bound(expr, lower, NOW, OSLO) == expected


def test_date_ages_and_today():
    as_of = dt.datetime(2024, 3, 31, 15, 30, 0)
    assert D.parse_date_bound("3d", True, as_of, "UTC") == int(dt.datetime(2024, 3, 28, 15, 30, tzinfo=dt.timezone.utc).timestamp())
    assert D.parse_date_bound("1m", True, as_of, "UTC") == int(dt.datetime(2024, 2, 29, 15, 30, tzinfo=dt.timezone.utc).timestamp())
    assert D.parse_date_bound("today", False, as_of, "UTC") == int(dt.datetime(2024, 4, 1, tzinfo=dt.timezone.utc).timestamp())
    assert D.parse_date_bound("today", True, as_of, "UTC") == int(dt.datetime(2024, 3, 31, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize("expr,lower,expected", [
    ("7k", True, 7 * 1024), ("5mb", True, 5 * 1024 ** 2), ("3G", False, 3 * 1024 ** 3), ("", False, OPEN), ("4096", True, 4096)])
def test_sizes(expr, lower, expected):
    assert D.parse_size(expr, lower) == expected


def _one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("src,flat", [("Йога Ёлка", "иога елка"), ("Świętokrzyskie", "swietokrzyskie"), ("Smørrebrød æđ", "smorrebrod ed")])
def test_flatten(spark, src, flat):
    assert _one(spark, X.flatten("s"), src) == flat
    assert X.flatten_py(src) == flat


def test_ctrl_functions(spark):
    assert _one(spark, X.remove_ctrl("s"), "one\n\ntwo") == "one two"
    assert _one(spark, X.remove_ctrl("s"), "one    two") == "one two"
    assert _one(spark, X.clean("s"), "\n x\t\ny\t") == "x  y"
    assert _one(spark, X.strip_ctrl("s"), "ab\x01\x02c\nd\x1fe") == "abc de"


def test_subjects(spark):
    assert _one(spark, X.subject_normalize("s"), "Fwd: re: RE[4]: lunch plans") == "lunch plans"
    assert _one(spark, X.subject_tail("s"), "Re: list:   ending") == "ending"


def _bits(letters):
    return sum(FLAG_BITS[c] for c in letters)


def test_flag_strings(spark):
    assert _one(spark, FL.flags_to_string("f"), _bits("Fz"), "f int") == "Fz"
    assert _one(spark, FL.flags_to_string("f"), _bits("aR"), "f int") == "Ra"
    assert _one(spark, FL.flags_delta("f", "+F-S"), _bits("ST"), "f int") == _bits("FT")
    assert _one(spark, FL.flags_delta("f", "-R+T+F-P"), _bits("zP"), "f int") == _bits("TFz")
    assert _one(spark, FL.custom_flags("s"), "SkT") == "k"
    assert _one(spark, FL.custom_flags("s"), "FabcSdeT9R") == "abcde9"


def test_flags_from_path(spark):
    assert _one(spark, FL.flags_from_path("s"), "/mail/box/cur/77.a:2,TSP") == _bits("TSP")
    assert _one(spark, FL.flags_from_path("s"), "/mail/box/new/77.a:2,S") == _bits("N")


def test_new_path(spark):
    df = spark.createDataFrame([("/mail/box/cur/77.a:2,ST", _bits("N")),
                                ("/mail/box/cur/88.b:2,aSbTc9", _bits("S"))], "p string, f int")
    out = [r[0] for r in df.select(FL.new_path("p", "f")).collect()]
    assert out[0] == "/mail/box/new/77.a"
    assert out[1] == "/mail/box/cur/88.b:2,Sabc9"
    moved = df.select(FL.new_path("p", "f", "/old/2020", root="/mail")).collect()[1][0]
    assert moved == "/mail/old/2020/cur/88.b:2,Sabc9"


def test_personal(spark):
    mine = ["ann@home.example", "ann@work.example", "/ann\\+[a-z]+@list.*/"]
    df = spark.createDataFrame([("Ann@Work.EXAMPLE",), ("ann+news@lists.example",), ("ann@lists.example",), ("ann+9@lists.example",)], "e string")
    got = [r[0] for r in df.select(Q.is_personal("e", mine)).collect()]
    assert got == [True, True, False, False]


def test_nick(spark):
    assert _one(spark, P.nick_base("s"), "Ingrid Solberg") == "IngridS"
    assert _one(spark, P.nick_base("s"), "Bo") == "Bo"


def test_terms_ignore_case_and_accents(spark):
    df = spark.createDataFrame([("Das Smørrebrød schmeckt",)], "s string")
    assert df.where(Q.has_term("s", "SMORREBROD")).count() == 1
    assert df.where(Q.prefix("s", "smor*")).count() == 1
    assert df.where(Q.phrase("s", "das smorrebrod")).count() == 1
    assert df.where(~Q.has_term("s", "nothere")).count() == 1


def test_reversed_ranges(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 5, 9), 3000)], "d timestamp_ntz, z bigint")
    assert df.where(D.date_between("d", "20170512", "20170506", NOW)).count() == 1
    assert df.where(D.size_between("z", "1m", "10b")).count() == 1


@pytest.mark.parametrize("src,flat", [("ĳzer", "ijzer"), ("ª º", "a o"), ("Ǆemal", "dzemal"), ("plain", "plain"), ("caﬁ ﬁx ﬀ", "cafi fix ff"),
                                      ("Ｆｕｌｌ", "full"), ("ᾍδης", "αδης"), ("ガ", "カ"), ("𝐀b", "ab"), ("Ⅷ…", "viii..."), ("한", "한")])
def test_flatten_whole_unicode(spark, src, flat):
    assert _one(spark, X.flatten("s"), src) == flat
    assert X.flatten_py(src) == flat


def test_utf8ify_bytes(spark):
    from postlake.functions.text import utf8ify
    raw = [b"plain\ttext\n", "hé".encode(), b"h\xc3", b"\xff\x00a b\r", b"", None]
    got = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i int, b binary").orderBy("i").select(utf8ify("b")).collect()]
    assert got == ["plain\ttext\n", "hé", "h.", "..a b\r", "", None]


def test_content_flags_by_disposition(spark):
    from postlake.operators.parts import content_flags_from_parts
    rows = [(1, "text/plain", "inline"), (1, "multipart/signed", None), (1, "application/pgp-signature", "inline"), (2, "image/png", "inline"),
            (3, "image/png", None), (4, "text/plain", "ATTACHMENT"), (5, "multipart/encrypted", None), (5, "text/x-diff", "inline"), (6, "message/rfc822", "inline")]
    got = {r["doc_id"]: (r["has_attach"], r["signed"], r["encrypted"]) for r in
           content_flags_from_parts(spark.createDataFrame(rows, "doc_id long, mime_type string, disposition string")).collect()}
    assert got == {1: (False, True, False), 2: (True, False, False), 3: (False, False, False), 4: (True, False, False), 5: (True, False, True), 6: (False, False, False)}


def test_contact_formats_quoted_and_nick(spark):
    from postlake.operators.contacts import contacts_text
    c = spark.createDataFrame([('Ann "A" B', "a@x"), (None, "b1@x")], "name string, email string")
    line = lambda fmt: [r["line"] for r in contacts_text(c, fmt).orderBy("email").collect()]
    assert line("quoted") == ['"\\"Ann \\"A\\" B\\" <a@x>"', '"<b1@x>"']
    assert line("org-contact-nick") == ['* "Ann \\"A\\" B"\n:PROPERTIES:\n:EMAIL:a@x\n:NICK:ann__a__b\n:END:', '* "b1@x"\n:PROPERTIES:\n:EMAIL:b1@x\n:NICK:b__x\n:END:']


def test_table_function_slices():
    """Batches are split a slice at a time: no more than SLICE_BYTES of text, or one row."""
    import pyarrow as pa

    from postlake.functions import udfs as U
    texts = ["a" * 400_000, None, "b" * 700_000, "c" * 3_000_000, "", "d"]
    parts = list(U._slices(pa.RecordBatch.from_pydict({"text": texts}), "text"))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert [p.num_rows for p in parts] == [2, 1, 1, 2]
    assert list(U._slices(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}), "text")) == []


def test_message_chunks_by_rows():
    """Small messages are bounded by their number: parsed, each is far larger than its bytes."""
    from postlake.sources import maildir as MD
    frames = list(MD._chunks(({"a": k} for k in range(1700)), lambda r: 10, ["a"]))
    assert [len(f) for f in frames] == [500, 500, 500, 200]
    assert [v for f in frames for v in f["a"]] == list(range(1700))
