"""Contact table and export formats on a small literal contact set."""

import datetime as dt

from postlake.operators import contacts as C

OCC = "doc_id bigint, type string, name string, email string, date timestamp_ntz, personal boolean"


def _contacts(spark):
    rows = [(1, "from", "Helmut Kröger", "hk@example.com", dt.datetime(2024, 5, 1), False),
            (2, "from", "", "HK@example.com", dt.datetime(2024, 5, 20), False),
            (3, "to", 'Ann "the" Smith', "ann@example.com", dt.datetime(2024, 1, 1), True),
            (4, "cc", None, "noreply@example.com", dt.datetime(2024, 5, 30), False)]
    return C.build_contacts(spark.createDataFrame(rows, OCC))


def test_build_keeps_newest_nonempty_name(spark):
    c = {r["email"].lower(): r for r in _contacts(spark).collect()}
    hk = c["hk@example.com"]
    assert hk["freq"] == 2 and hk["name"] == "Helmut Kröger" and hk["email"] == "HK@example.com"
    assert c["ann@example.com"]["personal"] is True


def test_rank_and_process(spark):
    c = _contacts(spark)
    ranked = {r["email"]: r["rank"] for r in C.rank_contacts(c, dt.datetime(2024, 6, 1)).collect()}
    assert ranked["ann@example.com"] == 1  # personal first
    kept = {r["email"] for r in C.process_contacts(c).collect()}
    assert "noreply@example.com" not in kept


def test_formats(spark):
    c = _contacts(spark).where("email = 'ann@example.com'")
    line = lambda fmt: C.contacts_text(c, fmt, dt.date(2024, 6, 1)).first()["line"]
    assert line("plain") == 'Ann "the" Smith ann@example.com'
    assert line("mutt-ab") == 'ann@example.com\tAnn "the" Smith\t'
    assert line("csv") == '"Ann ""the"" Smith","ann@example.com"'
    assert line("org-contact") == '* Ann "the" Smith\n:PROPERTIES:\n:EMAIL: ann@example.com\n:END:\n'
    assert line("bbdb") == ('["Ann "the"" "Smith" nil nil nil nil ("ann@example.com") '
                            '((creation-date . "2024-06-01") (time-stamp . "2024-01-01")) nil]')


def test_nicks_unique(spark):
    c = _contacts(spark)
    n = {r["email"]: r["nick"] for r in C.nicks(c).collect()}
    assert n["HK@example.com"] == "HelmutK"
    assert n["ann@example.com"] == "AnntheS"  # first name 'Ann "the"' + 'S', punctuation and spaces dropped


def test_personal_join_with_many_patterns(spark):
    """More patterns than fit one expression, in blocks: the same marks as few patterns give."""
    from postlake.operators.related import MAX_PERSONAL_REGEX, personal_join
    occ = spark.createDataFrame([(k, f"User{k}@x.example") for k in range(30)] + [(99, None), (100, "user3@x.example.org")], "doc_id long, email string")
    some = [("/user[0-4]@x\\.example/",), ("/user7@.*|zed/",), ("USER9@x.example",)]
    many = some + [(f"/nobody{k}@(a|b)/",) for k in range(MAX_PERSONAL_REGEX + 50)]
    for rows in (some, many):
        got = personal_join(occ, spark.createDataFrame(rows, "address string"))
        assert got.columns == ["doc_id", "email", "is_personal"] and got.count() == 32
        assert {r.doc_id for r in got.where("is_personal").collect()} == {0, 1, 2, 3, 4, 7, 9}
