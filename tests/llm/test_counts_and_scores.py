"""Collocations, source divergence and exact top-k search against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake.llm import divergence, maxscore, phrases

from .helpers import DOCS, LOWER, odd_documents


# collocations

def _plain_collocations(rows: list[tuple], threshold: int, top: int) -> set:
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[k:k + m])) for k in range(len(w) - m + 1))
    cand = {g: a for g, a in f.items() if a >= threshold and len(g[1]) > 1}
    per_lang = defaultdict(list)
    for (lang, w), a in cand.items():
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(o == lang and len(v) > len(w) and any(v[j:j + len(w)] == w for j in range(len(v) - len(w) + 1)) and 100 * b >= 80 * a
                     for (o, v), b in cand.items())
        if not inside:
            per_lang[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in per_lang.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


def _prose(seed: int, n: int, words: int = 12) -> list[str]:
    rng = random.Random(seed)
    names = ["alpha", "Beta", "über", "日本", "x", "of", "the", "New", "York", "City"]
    return [" ".join(rng.choice(names[:rng.randint(2, len(names))]) + rng.choice(["", "", "", ".", ",\t", "\n", "  "]) for _ in range(rng.randint(0, words))) for _ in range(n)]


@pytest.mark.parametrize("blocks", [(phrases.BLOCK_BYTES, phrases.BUCKET_BYTES), (300, 50)])
def test_collocations_as_plain(spark, blocks):
    rows = [(random.Random(k).choice(["en", "de", None]), t) for k, t in enumerate(_prose(1, 400))] + [("en", None), ("en", ""), (None, "New York City. " * 40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    counts, sizes = phrases.count_phrases(docs, 6, block_bytes=blocks[0], bucket_bytes=blocks[1])
    got = {tuple(r) for r in phrases.collocations(docs, 6, 40).collect()}
    assert got == _plain_collocations(rows, 6, 40)
    assert len(got) > 60 and {r.lang for r in sizes.collect()} == {"en", "de", "und"}
    plain = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                plain.update((lang or "und", " ".join(w[k:k + m])) for k in range(len(w) - m + 1))
    assert {(r.lang, r.phrase): r.f for r in counts.collect()} == {g: a for g, a in plain.items() if a >= 6}


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(3)
    for capacity_share in (1, 2):
        stream = np.concatenate([rng.integers(0, 5000, 40_000), np.repeat(rng.integers(0, 2**32, 50), 40), np.repeat(7, 9000)]).astype(np.uint32)
        rng.shuffle(stream)
        summary = phrases.MisraGries(capacity_share * (len(stream) // 30 + 1))
        for part in np.array_split(stream, 90):
            keys, counts = np.unique(part, return_counts=True)
            summary.add(keys, counts)
        true = Counter(stream.tolist())
        likely = set(summary.frequent(30).tolist())
        assert {k for k, c in true.items() if c >= 30} <= likely
        assert summary.error * (summary.capacity + 1) <= len(stream) and len(summary.keys) <= summary.capacity
        assert all(true[k] - summary.error <= c <= true[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))


def test_long_texts_are_cut_at_pieces():
    text = "a b. c d, " * 50 + "no end " * 30
    assert "".join(phrases.cut_text(text, 30)) == text and len(phrases.cut_text(text, 30)) > 10
    assert all(p[-1] in ".,;:!?\n" for p in phrases.cut_text(text, 30)[:-1])


def test_collocations_odd_rows(spark):
    odd = odd_documents(spark)
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert {tuple(r) for r in phrases.collocations(odd, 2, 50).collect()} == _plain_collocations(rows, 2, 50)
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []


# source divergence

def _plain_audit(rows: list[tuple], min_docs: int, top: int) -> set:
    df, c, groups = defaultdict(set), Counter(), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(divergence.TERM, (text or "").translate(LOWER)):
            df[lang, t].add(k)
            c[lang, source, t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (o, t), d in df.items() if o == lang and len(d) >= min_docs]
        sources = [s for o, s in groups if o == lang]
        total = {s: sum(c[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (c[lang, s, t] + 5) // (total[s] + 5 * len(kept)) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(c[lang, s, t] for s in sources) + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pair = sorted((-sum(abs(p[s, t] - p[o, t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((q[t] - p[s, t], t.encode()) for t in kept if c[lang, s, t] and p[s, t] > q[t])
            for part, found in (("pair", pair), ("term", term[:top])):
                out |= {(lang, s, part, item.decode(), -v, r + 1) for r, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("vocabulary, sources, terms", [(divergence.VOCABULARY, divergence.SOURCES, divergence.TERMS), (8, 2, 3)])
def test_divergence_as_plain(spark, monkeypatch, vocabulary, sources, terms):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rng = random.Random(2)
    rows = [(t + rng.choice([" don't", " ÉTÉ été", ""]), rng.choice(["en", "de", "x\0y", None]), rng.choice(["a", "b", "c", "ü", "", None])) for t in _prose(9, 300)]
    rows += [("only once", "fr", "one"), (None, "fr", "two"), ("", "en", "empty"), ("123 !!", "en", "digits")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    counts = divergence.group_counts(divergence.term_arrays(docs, "text", "lang", "source"), 5, vocabulary)
    assert counts.count() > 20
    if vocabulary == 8:
        monkeypatch.setattr(divergence, "VOCABULARY", 8)
    got = {tuple(r) for r in divergence.audit_sources(docs, 5, 4).collect()}
    assert got == _plain_audit(rows, 5, 4)


def test_sums_are_flushed_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(t, "en", f"s{k % 3}") for k, t in enumerate(_prose(4, 200))], "text string, lang string, source string")
    terms = divergence.term_arrays(docs, "text", "lang", "source")
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "source": ["a", "b"], "indices": pa.array([[0, 2], [1]], pa.list_(pa.int32())),
                                           "values": pa.array([[1.0, 2.0], [4.0]], pa.list_(pa.float64()))}) for _ in range(3)]
    for most in (divergence.SUMMED, 1):
        monkeypatch.setattr(divergence, "SUMMED", most)
        total = Counter()
        for b in divergence.summed(iter(batches), 3):
            for r in b.to_pylist():
                total[r["source"], r["index"]] += r["count"]
        assert total == {("a", 0): 3, ("a", 2): 6, ("b", 1): 12}
    assert terms.where("exists(terms, t -> t not like 'en%')").count() == 0


def test_divergence_odd_rows(spark):
    odd = odd_documents(spark)
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert {tuple(r) for r in divergence.audit_sources(odd, 1).collect()} == _plain_audit(rows, 1, 50)
    assert {tuple(r) for r in divergence.audit_sources(odd, 1000).collect()} == _plain_audit(rows, 1000, 50)
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).collect() == []


# exact top-k search

def _plain_search(rows: list[tuple], queries: list[tuple], k: int) -> set:
    import math
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [max(-2**63, min(2**63 - 1, math.floor(1024 * x) if math.isfinite(1024 * x) else int(math.copysign(2**63, x)))) for x in v]
    kept = [(i, whole(v)) for i, v in rows if i is not None and ok(v)]
    best: dict = defaultdict(dict)
    for q, v in ((i, whole(v)) for i, v in queries if i is not None and ok(v)):
        for i, w in kept:
            if i != q:
                s = max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w))))
                best[q][i] = max(best[q].get(i, -2**63), s)
    return {(q, r + 1, i, s) for q, found in best.items() for r, (s, i) in enumerate(sorted(((s, i) for i, s in found.items()), key=lambda x: (-x[0], x[1]))[:k])}


def _searched(spark, rows: list[tuple], queries: list[tuple], k: int, **index) -> set:
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "dim", "shard", "part", "block")})
    got = [tuple(r) for r in maxscore.search(maxscore.build_index(frame(rows), **index), frame(queries), k, block_bytes=2000).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("shape", ["gauss", "clusters", "sparse", "copies", "positive"])
def test_search_as_brute_force(spark, shape):
    rng = np.random.default_rng(len(shape))
    v = rng.normal(size=(600, 24)) / 5
    if shape == "clusters":
        v = rng.normal(size=(12, 24))[rng.integers(0, 12, 600)] + v / 4
    if shape == "sparse":
        v[rng.random(v.shape) < 0.9] = 0
    if shape == "copies":
        v[200:] = v[rng.integers(0, 3, 400)]
    if shape == "positive":
        v = np.abs(v)
    rows = [(int(k), r.tolist()) for k, r in enumerate(v)]
    queries = [r for r in rows if r[0] % 20 == 0]
    assert _searched(spark, rows, queries, 10, shard_bytes=30_000) == _plain_search(rows, queries, 10)


def test_search_skips_candidates():
    """On vectors of a few large components most postings stay untouched, and the result is exact."""
    rng = np.random.default_rng(8)
    w = rng.integers(-3, 4, (5000, 32))
    for k in range(5000):
        w[k, rng.integers(0, 32)] = 400 + rng.integers(0, 500)
    shard = maxscore.Shard(np.arange(5000), w)
    q = np.zeros(32, np.int64)
    q[[3, 9]] = 900, 2
    ids, scores = shard.search(q, 0, 10)
    true = w @ q
    true[0] = -10**9
    assert scores.tolist() == sorted(true.tolist(), reverse=True)[:10]
    assert ids.tolist() == [i for _, i in sorted((-s, i) for i, s in enumerate(true.tolist()))[:10]]


def test_search_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]),
            (7, [0.0, 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1e300, -1e300]), (11, [-1e300, 1.0]), (12, [0.0005, -0.0005]), (13, [1e7, 1e7])]
    queries = rows + [(2, [-1.0, 1.0]), (99, [1.0])]
    assert _searched(spark, rows, queries, 3) == _plain_search(rows, queries, 3)
    assert _searched(spark, [(4, [1.0])] * 500 + [(k, [0.5]) for k in range(5, 9)], [(1, [1.0]), (4, [2.0])], 3, shard_bytes=100) == {
        (1, 1, 4, 1048576), (1, 2, 5, 524288), (1, 3, 6, 524288), (4, 1, 5, 1048576), (4, 2, 6, 1048576), (4, 3, 7, 1048576)}
    assert _searched(spark, [], rows, 3) == set() and _searched(spark, rows, [], 3) == set()


def test_bags_give_exact_counts(monkeypatch):
    """Weights of the bags that hold a term sum to its occurrences, however often the task empties what it holds."""
    monkeypatch.setattr(divergence, "BAG", 3)
    for most in (4, 300_000):
        monkeypatch.setattr(divergence, "COUNTED", most)
        rng, plain, got, bags = random.Random(5), Counter(), Counter(), divergence.Bags()
        bags.codes = {("en", "a"): 0, ("de", "b"): 1}
        rows = []
        for _ in range(40):
            some = {(rng.randrange(2), f"t{rng.randrange(9)}"): rng.randint(1, 20) for _ in range(6)}
            for (g, t), n in some.items():
                plain[list(bags.codes)[g], t] += n
            rows += bags.add(np.array([g for g, _ in some]), pa.array([t for _, t in some]), np.array(list(some.values())))
        for r in (r for b in [*rows, *bags.flush()] for r in b.to_pylist()):
            assert len(set(r["bag"])) == len(r["bag"]) <= 3 and r["terms"] is None
            for t in r["bag"]:
                got[(r["lang"], r["source"]), t] += r["weight"]
        assert got == plain


def test_sums_of_tasks_go_in_runs():
    """A task gives a row for a range of indices, not one for each, and the rows of all tasks add up."""
    rng, plain, rows = random.Random(6), Counter(), []
    for _ in range(4):
        batches = []
        for _ in range(3):
            vectors = [(rng.choice(["en", "de"]), rng.choice(["a", "b", ""]), sorted(rng.sample(range(40), 12)), rng.choice([1, 2, 64])) for _ in range(9)]
            for lang, source, indices, weight in vectors:
                plain.update({(lang, source, i): 3 * weight for i in indices})
            lang, source, indices, weight = zip(*vectors)
            batches.append(pa.RecordBatch.from_pydict({"lang": lang, "source": source, "indices": pa.array(indices, pa.list_(pa.int32())),
                                                       "values": pa.array([[3.0] * 12] * 9, pa.list_(pa.float64())), "weight": weight}))
        task = [r for b in divergence.summed(iter(batches), 40, 16) for r in b.to_pylist()]
        assert len(task) <= 6 * 3 and all(i // 16 == r["part"] for r in task for i in r["index"])
        rows += task
    rows.sort(key=lambda r: (r["lang"], r["source"], r["part"]))
    types = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.int32()), ("index", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])
    for size in (1, 5, 1000):
        batches = [pa.RecordBatch.from_pylist(rows[k:k + size], schema=types) for k in range(0, len(rows), size)]
        got = [r for b in divergence.added(iter([*batches, pa.RecordBatch.from_pylist([], schema=types)]), 40) for r in b.to_pylist()]
        assert len(got) == len(plain) and {(r["lang"], r["source"], r["index"]): r["count"] for r in got} == plain
    assert list(divergence.added(iter([]), 40)) == []


def test_enough_documents_are_told_once(spark):
    """A term that a task meets in enough documents is in one bag of that weight, not in one of each power of two."""
    docs = spark.createDataFrame([("often" + " twice" * (k < 31) + " thrice" * (k < 6), "en", "a") for k in range(95)], "text string, lang string, source string").coalesce(1)
    terms = divergence.term_arrays(docs, "text", "lang", "source", 30)
    held = {(t.split("\0")[1], r.weight) for r in terms.where("terms is not null").collect() for t in r.terms}
    assert held == {("often", 32), ("twice", 32), ("thrice", 2), ("thrice", 4)}
    assert {tuple(r) for r in divergence.group_counts(terms, 30).collect()} == {("en", "a", "often", 95), ("en", "a", "twice", 31)}
    # no task alone meets them in enough documents
    terms = divergence.term_arrays(docs.repartition(8), "text", "lang", "source", 30)
    assert {tuple(r) for r in divergence.group_counts(terms, 30).collect()} == {("en", "a", "often", 95), ("en", "a", "twice", 31)}
