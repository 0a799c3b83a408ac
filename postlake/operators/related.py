"""Relational joins the reference performs implicitly (JN1-JN8, THR1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import personal_regex


def thread_id(refs: str = "refs", msgid: str = "msgid", hashed: bool = False) -> Column:
    """THR1: the oldest reference, else the message's own id (optionally xxhash64)."""
    tid = F.coalesce(F.try_element_at(F.col(refs), F.lit(1)), F.col(msgid))
    return F.xxhash64(tid) if hashed else tid


def include_related(m: DataFrame, leaders: DataFrame, tid: str = "thread_id") -> DataFrame:
    """JN1: every message sharing a thread id with a match (semi join on the
    distinct thread ids of the leaders; AQE broadcasts them when small)."""
    return m.join(leaders.select(tid).distinct(), tid, "left_semi")


def attach_match_info(res: DataFrame, info: DataFrame, key: str = "doc_id") -> DataFrame:
    """JN2: thread/duplicate info joined by doc id."""
    return res.join(info, key, "inner")


def copies_of(m: DataFrame, msgids: DataFrame, key: str = "msgid") -> DataFrame:
    """JN7: every stored copy of the given messages."""
    return m.join(msgids.select(key).distinct(), key, "left_semi")


def list_shortname(list_id: Column | str, names: dict[str, str] | None = None,
                   patterns: list[str] | None = None) -> Column:
    """JN5: short name of a mailing list: the user table, else group 1 of the
    first matching pattern, else the text before the first dot, else the id.

    The name table is a literal map (its size is the user's dictionary), so the
    lookup is an in-expression map access, not a join.
    """
    lid = F.col(list_id) if isinstance(list_id, str) else list_id
    cands = []
    if names:
        cands.append(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[lid])
    for p in patterns or []:
        cands.append(F.when(lid.rlike(p), F.regexp_extract(lid, p, 1)))
    cands.append(F.when(F.instr(lid, ".") > 0, F.regexp_extract(lid, r"^([^.]*)\.", 1)))
    cands.append(lid)
    return F.coalesce(*cands)


def rank_addresses(addr: DataFrame, ranked_contacts: DataFrame, key: str = "email") -> DataFrame:
    """JN6: rank of each address from the ranked contact table (null if unknown)."""
    return addr.join(ranked_contacts.select(key, "rank"), key, "left")


#: personal regexes up to this many become one expression; more of them are a table, met in blocks of REGEX_BLOCK
MAX_PERSONAL_REGEX, REGEX_BLOCK = 1000, 200


def _regex_hits(occ: DataFrame, rx: DataFrame, n: int, email: str) -> DataFrame:
    """(_addr): distinct addresses that one of ``n`` patterns in ``rx`` matches whole, case-blind.

    A block of patterns is one alternation; every distinct address meets every block by an equi join on its number.
    """
    blocks = -(-n // REGEX_BLOCK)
    alternations = (rx.select(F.col("rx"), F.pmod(F.xxhash64("rx"), F.lit(blocks)).alias("_b")).groupBy("_b")
                    .agg(F.concat(F.lit("(?i)^(?:(?:"), F.array_join(F.sort_array(F.collect_set("rx")), ")|(?:"), F.lit("))$")).alias("_any")))
    addresses = occ.select(F.col(email).alias("_addr")).where("_addr is not null").distinct()
    dealt = addresses.select("_addr", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("_b"))
    return dealt.join(alternations, "_b").where("_addr rlike _any").select("_addr").distinct()


def personal_join(occ: DataFrame, personal: DataFrame | list[str], email: str = "email") -> DataFrame:
    """JN8: mark occurrences whose address is personal.

    ``personal`` is a table with an ``address`` column (plain addresses and
    ``/regex/`` entries) or a list. Plain addresses are an equi join on the
    lower-cased address. Up to MAX_PERSONAL_REGEX regex entries (user settings)
    are OR-ed into one expression; more are matched in blocks with the distinct
    addresses, without gathering them.
    """
    hits = None
    if isinstance(personal, list):
        plain, rxs = personal_regex(personal)
        plain_df = occ.sparkSession.createDataFrame([(p,) for p in plain], "address string") if plain else None
    else:
        is_rx = F.col("address").rlike(r"^/.+/$")
        rx = personal.where(is_rx).select(F.expr("substring(address, 2, length(address) - 2)").alias("rx")).distinct()
        few = [r.rx for r in rx.limit(MAX_PERSONAL_REGEX + 1).collect()]
        rxs = few if len(few) <= MAX_PERSONAL_REGEX else []
        if not rxs and few:
            hits = _regex_hits(occ, rx, rx.count(), email)
        plain_df = personal.where(~is_rx).select(F.lower("address").alias("address"))
    o = occ.withColumn("_le", F.lower(F.col(email)))
    if plain_df is not None:
        known = plain_df.select(F.lower("address").alias("_le")).distinct().withColumn("_plain", F.lit(True))
        o = o.join(known, "_le", "left")
    else:
        o = o.withColumn("_plain", F.lit(None).cast("boolean"))
    if hits is not None:
        o = o.join(hits.withColumn("_rx", F.lit(True)), F.col(email) == F.col("_addr"), "left").drop("_addr")
    else:
        o = o.withColumn("_rx", reduce(lambda a, b: a | b, [F.col(email).rlike(f"(?i)^(?:{r})$") for r in rxs]) if rxs else F.lit(False))
    return o.withColumn("is_personal", F.coalesce("_plain", F.lit(False)) | F.coalesce("_rx", F.lit(False))).drop("_le", "_plain", "_rx")


def find_with_related(m: DataFrame, expr: Column, max_results: int = 0, field: str = "date",
                      desc: bool = True) -> DataFrame:
    """Search with related messages (no threading): the leaders take the limit
    (date order), the related set takes it again in the requested order."""
    from .ordering import limit, sort_by, top_k
    mm = m if "thread_id" in m.columns else m.withColumn("thread_id", thread_id())
    leaders = mm.where(expr)
    if max_results > 0:
        leaders = top_k(leaders, max_results, "date", desc=True)
    out = include_related(mm, leaders)
    return limit(sort_by(out, field, desc), max_results)
