"""Search predicates on literal messages, incl. the missing-field rule of NOT."""

from pyspark.sql import functions as F

from postlake.operators import predicates as Q

SCHEMA = ("doc_id int, subject string, maildir string, tags array<string>, files array<string>, "
          "mimes array<string>, prio string, contacts array<struct<type:string,name:string,email:string,full_address:string>>")


def _m(spark):
    c = lambda t, n, e: (t, n, e, f"{n} <{e}>")
    rows = [(1, "Café Åland opens", "/Archive", ["Work", "éte"], ["Report.PDF"], ["application/pdf"], "high",
             [c("from", "Jo Doe", "jo@Example.com"), c("to", "Me", "me@mine.org")]),
            (2, None, "/inbox", [], [], ["text/plain"], "low", [c("from", "Bot", "noreply@x.io")]),
            (3, "re: cafe aland", "/inbox", ["ete"], ["a.png"], ["image/png"], "normal",
             [c("cc", "Me Too", "team-7@north.example")])]
    return spark.createDataFrame(rows, SCHEMA)


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_fields(spark):
    m = _m(spark)
    assert _ids(m.where(Q.has_term("subject", "aland"))) == [1, 3]
    assert _ids(m.where(~Q.has_term("subject", "aland"))) == [2]  # missing subject: NOT matches
    assert _ids(m.where(Q.maildir_is("maildir", "/archive"))) == [1]
    assert _ids(m.where(Q.has_tag("tags", "ETE"))) == [1, 3]
    assert _ids(m.where(Q.has_file("files", "report.pdf"))) == [1]
    assert _ids(m.where(Q.has_file("files", "report"))) == []  # whole value, as the reference
    assert _ids(m.where(Q.has_mime("mimes", "image/*"))) == [3]
    assert _ids(m.where(Q.prio_is("prio", "h"))) == [1]
    assert _ids(m.where(Q.xor(Q.has_term("subject", "opens"), Q.prio_is("prio", "low")))) == [1, 2]


def test_words_with_other_characters(spark):
    df = spark.createDataFrame([("a foo_bar baz",), ("a foo baz",), ("...",), (None,)], "s string")
    count = lambda p: df.where(p).count()
    assert [count(Q.has_term("s", "foo_bar")), count(Q.phrase("s", "foo_bar baz")), count(Q.prefix("s", "foo_b*")), count(Q.has_term("s", "..."))] == [1, 1, 2, 0]


def test_unread_is_a_flag(spark):
    from postlake.schema import FLAG_BITS
    df = spark.createDataFrame([(0,), (FLAG_BITS["S"],), (FLAG_BITS["S"] | FLAG_BITS["N"],)], "f int")
    assert [r[0] for r in df.select(Q.has_flag("f", "unread")).collect()] == [True, False, True]


def test_all_ids_come_back(spark):
    df = spark.createDataFrame([(k, f"id{k}") for k in range(150)], "doc_id int, msgid string")
    assert Q.by_msgid(df, [f"id{k}" for k in range(150)]).count() == 150
    assert Q.by_msgid(df, [f"id{k}" for k in range(150)], max_hits=3).count() == 3


def test_contacts(spark):
    m = _m(spark)
    assert _ids(m.where(Q.contact("contacts", "example.com"))) == [1]  # domain
    assert _ids(m.where(Q.contact("contacts", "jo"))) == [1]  # local part / name token
    assert _ids(m.where(Q.recip("contacts", "jo"))) == []
    assert _ids(m.where(Q.contact_matches("contacts", ("from",), "^no.?reply"))) == [2]
    mine = ["me@mine.org", "/team-[0-9]+@north.ex.*/"]
    assert _ids(m.where(Q.is_personal_message("contacts", mine))) == [1, 3]
    assert _ids(m.where(Q.sent_by_me("contacts", mine))) == []


def test_html_only_bodies_are_searched(spark):
    rows = [(1, None, "<style>.red {}</style><p>Gr&uuml;n &amp; <b>café</b>s</p>"), (2, "plain green", "<p>red</p>"), (3, None, None)]
    m = spark.createDataFrame(rows, "doc_id long, body_text string, body_html string")
    for c in ("to", "cc", "bcc", "from", "subject"):
        m = m.withColumn(c, F.lit(None).cast("string"))
    hits = lambda w, **o: sorted(r[0] for r in m.where(Q.has_term_default(w, **o)).select("doc_id").collect())
    assert hits("cafe", html="body_html") == [1] and hits("red", html="body_html") == []  # style sheets and hidden HTML aren't text
    assert hits("green", html="body_html") == [2] and hits("cafe") == []


def test_contact_value_and_address_fold_alike(spark):
    m = spark.createDataFrame([(1, [("from", "Jørg", "JÖRG@Hél.example", None)])],
                              "doc_id long, contacts array<struct<type string, name string, email string, full_address string>>")
    for value in ("jörg", "JORG@HEL.example", "hél.EXAMPLE", "Jorg"):
        assert m.where(Q.contact_term("contacts", ("from",), value)).count() == 1, value
    assert m.where(Q.contact_term("contacts", ("to",), "jorg")).count() == 0


def test_regex_on_whole_values(spark):
    m = spark.createDataFrame([(1, "/Archív/2024", ["Work", "tél"]), (2, "/inbox", None), (3, None, [])], "doc_id long, maildir string, tags array<string>")
    at = lambda p: [r[0] for r in m.where(p).select("doc_id").orderBy("doc_id").collect()]
    assert at(Q.regex_value("maildir", "^/ARCHIV/[0-9]+$")) == [1] and at(~Q.regex_value("maildir", "x")) == [1, 3]
    assert at(Q.regex_any("tags", "^tel|^w")) == [1] and at(Q.regex_any("tags", "^ork")) == []
