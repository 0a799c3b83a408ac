"""Contacts: build, rank, find, filter, nicks and text exports
(AGG16, AGG17, CON1-CON5, WIN2, WIN3, SNK4, SNK5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ntz_lit
from ..functions.people import first_name, last_name, nick_base
from .windows import ranked

# Fixed value: contacts seen within this many days count as recent when ranking.
RECENT_DAYS = 15

# Fixed value: default pattern of addresses dropped by process_contacts.
NO_REPLY_RX = r"no[t]?[-.]?repl(y|ies)"


def occurrences(m: DataFrame, personal: list[str] | None = None) -> DataFrame:
    """Explode message contacts into occurrences (reply-to not counted). With a
    personal list, all addresses of a message are personal if any is mine."""
    from .predicates import is_personal_message
    base = m
    if personal is not None:
        base = base.withColumn("_pers", is_personal_message("contacts", personal))
    else:
        base = base.withColumn("_pers", F.lit(False))
    occ = base.select("doc_id", "date", "_pers", F.explode("contacts").alias("c"))
    return occ.where(F.col("c.type").isin("from", "to", "cc", "bcc")).select(
        "doc_id", F.col("c.type").alias("type"), F.col("c.name").alias("name"), F.col("c.email").alias("email"),
        "date", F.col("_pers").alias("personal"))


def build_contacts(occ: DataFrame) -> DataFrame:
    """AGG16: one row per case-blind e-mail: freq, last_seen, most recent
    non-empty name and address, personal if any occurrence is."""
    o = occ.withColumn("_key", F.lower("email"))
    named = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.struct("date", "doc_id"))
    return o.groupBy("_key").agg(
        F.count("*").alias("freq"),
        F.max("date").alias("last_seen"),
        F.max_by("email", F.struct("date", "doc_id")).alias("email"),
        F.max_by("name", named).alias("name"),
        F.max(F.col("personal").cast("int")).cast("boolean").alias("personal"),
    ).select("email", "name", "freq", "last_seen", "personal",
             F.when(F.col("name").isNotNull(), F.concat(F.col("name"), F.lit(" <"), F.col("email"), F.lit(">")))
             .otherwise(F.col("email")).alias("full_address"))


def contacts_of(m: DataFrame, expr: Column | None = None, personal: list[str] | None = None) -> DataFrame:
    """AGG17: contacts of the messages matching an expression."""
    src = m.where(expr) if expr is not None else m
    return build_contacts(occurrences(src, personal))


def rank_key(as_of: dt.datetime) -> list[Column]:
    recent = F.col("last_seen") > ntz_lit(as_of - dt.timedelta(days=RECENT_DAYS))
    return [F.col("personal").desc(), recent.desc(), F.col("freq").desc(), F.lower("email").asc(), F.col("email").asc()]


def rank_contacts(c: DataFrame, as_of: dt.datetime) -> DataFrame:
    """CON1 + WIN2: rank 1..n (personal first, then recent, then frequent, then
    e-mail), numbered with the distributed ranking (no single-task window)."""
    recent = (F.col("last_seen") > ntz_lit(as_of - dt.timedelta(days=RECENT_DAYS))).cast("int")
    keyed = c.withColumn("_p", F.col("personal").cast("int")).withColumn("_r", recent).withColumn("_le", F.lower("email"))
    order = [F.col("_p").desc(), F.col("_r").desc(), F.col("freq").desc(), F.col("_le").asc(), F.col("email").asc()]
    return ranked(keyed, order, out="rank").drop("_p", "_r", "_le")


def find_contacts(c: DataFrame, rx: str | None = None, personal_only: bool = False,
                  after: dt.datetime | None = None) -> DataFrame:
    """CON2: case-blind regex on e-mail or name; personal and seen-after filters."""
    out = c
    if rx:
        r = f"(?i){rx}"
        out = out.where(F.col("email").rlike(r) | F.coalesce(F.col("name"), F.lit("")).rlike(r))
    if personal_only:
        out = out.where("personal")
    if after is not None:
        out = out.where(F.col("last_seen") >= ntz_lit(after))
    return out


def contacts_since(c: DataFrame, as_of: dt.datetime, since: dt.datetime) -> DataFrame:
    """CON3: ranked contacts changed after a stamp (rank is over all contacts)."""
    return rank_contacts(c, as_of).where(F.col("last_seen") > ntz_lit(since))


def process_contacts(c: DataFrame, fn: Column | None = None) -> DataFrame:
    """CON4: rewrite the address with ``fn`` (null drops it); default drops no-reply."""
    if fn is None:
        fn = F.when(~F.col("email").rlike(f"(?i){NO_REPLY_RX}"), F.col("email"))
    return c.withColumn("email", fn).where(F.col("email").isNotNull())


def nicks(c: DataFrame, name: str = "name", order: list[Column] | None = None) -> DataFrame:
    """CON5 + WIN3: nick base (FN29); the 2nd, 3rd... holder of a nick gets a suffix."""
    order = order or [F.col("email")]
    n = c.where(F.coalesce(F.col(name), F.lit("")) != "").withColumn("_nick", nick_base(F.col(name)))
    r = ranked(n, order, ["_nick"], out="_nrank")
    return r.withColumn("nick", F.when(F.col("_nrank") == 1, F.col("_nick"))
                        .otherwise(F.concat(F.col("_nick"), F.col("_nrank").cast("string")))).drop("_nick", "_nrank")


def contacts_text(c: DataFrame, fmt: str, today: dt.date | None = None) -> DataFrame:
    """SNK5: one text line (or block) per contact in a named format.

    plain, mutt-alias, mutt-ab, wl, org-contact, org-contact-nick, quoted, bbdb, csv. Formats that need
    a nick expect a ``nick`` column (see :func:`nicks`); org-contact-nick makes its own, letters and '_' only. Contacts without a
    name are skipped by mutt-alias, wl and org-contact.
    """
    name = F.coalesce(F.col("name"), F.lit(""))
    email = F.col("email")
    has_name = name != ""
    if fmt == "plain":
        line = F.concat(F.when(has_name, F.concat(name, F.lit(" "))).otherwise(F.lit("")), email)
    elif fmt == "mutt-alias":
        line = F.when(has_name, F.concat(F.lit("alias "), F.col("nick"), F.lit(" "), name, F.lit(" <"), email, F.lit(">")))
    elif fmt == "mutt-ab":
        line = F.concat(email, F.lit("\t"), name, F.lit("\t"))
    elif fmt == "wl":
        line = F.when(has_name, F.concat(email, F.lit(' "'), F.col("nick"), F.lit('" "'), name, F.lit('"')))
    elif fmt == "org-contact":
        line = F.when(has_name, F.concat(F.lit("* "), name, F.lit("\n:PROPERTIES:\n:EMAIL: "), email, F.lit("\n:END:\n")))
    elif fmt == "org-contact-nick":
        nick = F.regexp_replace(F.lower(F.when(has_name, name).otherwise(email)), r"\P{L}", "_")
        shown = F.replace(F.replace(F.when(has_name, name).otherwise(email), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        line = F.concat(F.lit('* "'), shown, F.lit('"\n:PROPERTIES:\n:EMAIL:'), email, F.lit("\n:NICK:"), nick, F.lit("\n:END:"))
    elif fmt == "quoted":
        whole = F.concat(F.when(has_name, F.concat(F.lit('"'), name, F.lit('" '))).otherwise(F.lit("")), F.lit("<"), email, F.lit(">"))
        line = F.concat(F.lit('"'), F.replace(whole, F.lit('"'), F.lit('\\"')), F.lit('"'))
    elif fmt == "bbdb":
        today_s = (today or dt.date.today()).isoformat()
        line = F.concat(F.lit('["'), first_name(name), F.lit('" "'), last_name(name), F.lit('" nil nil nil nil ("'),
                        email, F.lit('") ((creation-date . "'), F.lit(today_s), F.lit('") (time-stamp . "'),
                        F.date_format("last_seen", "yyyy-MM-dd"), F.lit('")) nil]'))
    elif fmt == "csv":
        def q(x):
            return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        line = F.concat(F.when(has_name, q(name)).otherwise(F.lit("")), F.lit(","), q(email))
    else:
        raise ValueError(f"unknown contact format {fmt!r}")
    return c.select("email", line.alias("line")).where(F.col("line").isNotNull())
