"""Operators on documents against plain versions: n-gram join, line dedup, rules, classifier, mixing, SentencePiece, secrets."""

from __future__ import annotations

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake.llm import linededup, mixing, ngramjoin, quality, rules, secrets, spieces
from postlake.llm.words import distinct, shingle_sets

from .helpers import DOCS, components, odd_documents, shingles, similar, words

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
model = pytest.mark.skipif(not os.path.exists(MODEL), reason="public tokenizers not present")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


# n-gram join

def _variants(seed: int, n: int) -> list[str]:
    """Texts of 1 to 400 words in families whose members differ a little more or less than the threshold."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 9, 12, 25, 60, 200, 400]))]
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(own) + 1)
                own[at:at + rng.randint(0, 1)] = [f"w{rng.randrange(3000)}"]
            out.append(" ".join(own))
    return out[:n]


def test_similar_sets_share_a_signature():
    texts = _variants(1, 300)
    sets, ptr = shingle_sets(pa.array(texts))
    who, sig = ngramjoin.signatures(sets, ptr)
    held = defaultdict(set)
    for d, s in zip(who.tolist(), sig.tolist()):
        held[d].add(s)
    plain = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similar(plain[i], plain[j])]
    assert len(near) > 100
    assert [p for p in near if not held[p[0]] & held[p[1]]] == []


@pytest.mark.parametrize("block", [ngramjoin.BLOCK, 3])
def test_join_links_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)  # groups of a signature in one block, and in many
    shared = " ".join(f"shared{k}" for k in range(60))
    texts = _variants(2, 150) + [f"{shared} " + " ".join(f"own{k}x{j}" for j in range(12 + k % 5)) for k in range(40)]
    rows = [(k * 3 + 1, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.link_documents(spark.createDataFrame(rows, DOCS)).collect()}
    sets = [shingles(t) for t in texts]
    want = components([r[0] for r in rows], sets)
    assert got == {r[0]: (len(s), c) for r, s, c in zip(rows, sets, want)}


def test_join_odd_rows(spark, odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.link_documents(odd).collect()), key=str)
    rows = odd.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    want = components([r.doc_id for r in rows], sets)
    # rows of one id are documents of their own; components are by content
    assert got == sorted(((r.doc_id, len(s), c) for r, s, c in zip(rows, sets, want)), key=str)
    assert ngramjoin.link_documents(empty).count() == 0
    kept = ngramjoin.keep_one(odd)
    assert kept.columns == odd.columns
    stay = Counter(r.text for r in kept.collect())
    assert stay[rows[0].text] == 1 and stay[None] == 1 and stay[""] == 1
    assert ngramjoin.keep_one(empty).count() == 0


def test_bound_by_sketch_never_exceeds_difference():
    texts = _variants(3, 60)
    sets, ptr = shingle_sets(pa.array(texts))
    odd_bits = ngramjoin.sketches(sets, ptr)
    for i in range(60):
        for j in range(i):
            a, b = set(sets[ptr[i]:ptr[i + 1]].tolist()), set(sets[ptr[j]:ptr[j + 1]].tolist())
            assert np.bitwise_count(odd_bits[i] ^ odd_bits[j]).sum() <= len(a ^ b)


def test_distinct_of_ranges():
    values, ptr = np.array([3, 1, 3, 2, 2, 9], np.uint64), np.array([0, 3, 3, 5, 6, 6])
    got, at, times = distinct(values, ptr)
    assert got.tolist() == [1, 3, 2, 9] and at.tolist() == [0, 2, 2, 3, 4, 4] and times.tolist() == [1, 2, 2, 1]


# line dedup

def _plain_runs(raw: list[str]) -> set[tuple[int, int]]:
    """Removable runs (first line, lines) that hold no smaller one, each also with the blank lines beside it; own code."""
    some = [k for k, x in enumerate(raw) if words(x)]
    size = {k: len(words(raw[k])) for k in some}
    may = lambda i, j: 0 <= i <= j < len(some) and ((j > i and sum(size[k] for k in some[i:j + 1]) >= 10))
    runs = {(k, k) for k in some if size[k] >= 50}
    ends = [next((j for j in range(i, len(some)) if may(i, j)), None) for i in range(len(some))]
    starts = [next((i for i in range(j, -1, -1) if may(i, j)), None) for j in range(len(some))]
    fore = {(some[i], some[j]) for i, j in enumerate(ends) if j is not None} | runs
    back = {(some[i], some[j]) for j, i in enumerate(starts) if i is not None} | runs
    last = lambda a: max([k for k in some if k < a], default=-1) + 1
    after = lambda b: min([k for k in some if k > b], default=len(raw) - (raw[-1] == "")) - 1
    whole = fore | back | {(last(a), b) for a, b in fore} | {(a, max(b, after(b))) for a, b in back}
    return {(a, b - a + 1) for a, b in whole}


def _plain_dedup(rows: list[tuple[int, str]]) -> dict[int, str]:
    """Runs dropped where their bytes lie at an earlier place, by id and line."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").split("\n")
        gone = set()
        for a, n in sorted(_plain_runs(raw)):
            if seen.setdefault((n, "\n".join(raw[a:a + n])), (i, a)) != (i, a):
                gone |= set(range(a, a + n))
        out[i] = "\n".join(x for k, x in enumerate(raw) if k not in gone)
    return out


@given
def test_line_dedup_as_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = "\n".join(f"passage line {k} " + " ".join(f"p{k}w{j}" for j in range(9)) for k in range(12))
    extra = [(10**6 + k, f"own start {k}\n{passage}\nown end {k}", "en", "s", 1) for k in range(30)]
    docs = docs.select(*[c.split()[0] for c in DOCS.split(", ")]).union(spark.createDataFrame(extra, DOCS))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    want = _plain_dedup(rows)
    assert {i: r.text for i, r in got.items()} == want
    later = [got[i] for i, *_ in extra[1:]]
    assert [r.doc_id for r in later if r.n_removed < 9 or not r.text.startswith("own start") or not r.text.endswith(f"own end {r.doc_id - 10**6}")] == []
    assert got[10**6].text == extra[0][1]


def test_line_dedup_boundaries_resist_shifts():
    lines = [f"line {k} with some words of its own" for k in range(60)]
    cut = lambda ls: {tuple(ls[a:a + n]) for a, n, *_ in zip(*linededup.Lines(pa.array(["\n".join(ls)])).chunks(0))}
    whole, shifted = cut(lines), cut(["a new first line"] + lines)
    assert len(whole - shifted) <= 3 and len(whole) > 10


@pytest.mark.parametrize("sizes", [(30, 30), (20, 20, 20), (15, 15, 15, 15), (5, 5), (3, 0, 3, 4), (60,), (60, 0, 60)])
def test_line_dedup_removes_whole_passages(spark, sizes):
    """Passages shared by two documents, between lines that differ, some of them long."""
    rng = random.Random(8)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        passage = [own(n) for n in sizes]
        for i in (2 * k, 2 * k + 1):
            before, after = ([own(rng.choice([1, 8, 20, 80])) for _ in range(rng.randint(1, 4))] for _ in range(2))
            rows.append((i, "\n".join(before + passage + after), "en", "s", 1))
            want[i] = "\n".join(before + (passage if i % 2 == 0 else []) + after)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


def test_line_dedup_odd_rows(odd, empty):
    out = linededup.dedup_lines(odd)
    assert out.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    got = out.collect()
    texts = Counter((r.doc_id, r.text) for r in got)
    before = Counter((r.doc_id, r.text) for r in odd.collect())
    prose = odd.where("doc_id = 1").first().text
    assert texts[(1, prose)] == 1  # the first of the copies stays whole
    assert texts[(2, "")] == 2 and texts[(None, "")] == 1  # a line of over fifty words goes from later ones
    same = {k: v for k, v in before.items() if k[1] != prose}
    assert {k: v for k, v in texts.items() if k in same} == same
    assert linededup.dedup_lines(empty).count() == 0


# rules

def _plain_stats(text: str | None) -> tuple:
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@given
def test_rules_count_as_plain(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = docs.collect()
    got = rules.text_stats(pa.array([r.text for r in texts], pa.string()))
    have = list(zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert have == [_plain_stats(r.text) for r in texts]


def test_rules_ratio_as_plain(spark):
    rows = [(k, ("clean prose of words " if k % 3 else "@@ JUNK!! @@ ") * 20, None, None, None) for k in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    trusted = docs.where("doc_id % 3 <> 0 and doc_id < 15").select("doc_id")
    got = {r.doc_id: r for r in rules.apply_rules(docs, trusted, most_repeat=100).collect()}
    table = rules.gram_ratios(docs, trusted)
    bucket = lambda t: rules.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[:len(t) - rules.GRAM + 1]
    raw, target = Counter(), Counter()
    for k, t, *_ in rows:
        raw.update(bucket(t).tolist())
        if k % 3 and k < 15:
            target.update(bucket(t).tolist())
    n_raw, n_target, smooth = sum(raw.values()), sum(target.values()), rules.SHARE * sum(target.values())
    for k, t, *_ in rows:
        each = [math.log((target[b] + smooth * raw[b] / n_raw) / (n_target + smooth) / (raw[b] / n_raw)) for b in bucket(t).tolist()]
        assert got[k].ratio == pytest.approx(sum(each) / len(each), abs=1e-9)
        assert got[k].kept == (not got[k].base_failed and got[k].ratio >= -0.45)
    assert np.count_nonzero(table) > 0


@given
def test_rules_verdicts_follow_no_size(spark):
    """The same texts added to corpora of different size have the same verdicts, junk that no target has among them."""
    rng = random.Random(11)
    junk = [" ".join("".join(rng.choice("@#%&*!~<>^0123456789") for _ in range(6)) for _ in range(80)) for _ in range(3)]
    verdicts = []
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
        marks = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
        added = spark.createDataFrame([(10**7 + k, t) for k, t in enumerate(junk)], "doc_id long, text string")
        got = rules.apply_rules(docs.union(added), marks.where("quality = 1").select("doc_id"))
        verdicts.append({r.doc_id: (r.base_failed, r.kept) for r in got.where(f"doc_id >= {10**7}").collect()})
        judged = got.where("not base_failed").join(marks, "doc_id").groupBy("quality", "kept").count().collect()
        assert {(r.quality, r.kept) for r in judged if r.quality is not None} == {(0, False), (1, True)}
        low = got.agg(F.min("ratio")).first()[0]
        assert low >= math.log(rules.SHARE / (1 + rules.SHARE)) - 1e-9
    assert verdicts[0] == verdicts[1] == {10**7 + k: (False, False) for k in range(3)}


def test_rules_odd_rows(odd, empty, labels):
    got = rules.apply_rules(odd, labels.where("quality = 1").select("doc_id")).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert rules.apply_rules(empty, labels.select("doc_id")).count() == 0
    assert all(r.ratio == 0 for r in rules.apply_rules(odd, labels.where("false").select("doc_id")).collect())


# classifier

def test_machine_scores_as_plain_pairs():
    rng = np.random.default_rng(1)
    size = quality.BUCKETS + quality.STATISTICS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)) * 0.2)
    at, value, ptr = quality.features(pa.array(["some words of a text", "", None, "A B A! A"]))
    got = m.scores(at, value, ptr)
    for r in range(4):
        i, x = at[ptr[r]:ptr[r + 1]], value[ptr[r]:ptr[r + 1]]
        z = m.bias + sum(m.weights[i] * x)
        z += sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[r] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


@given
def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = quality.score(docs, quality.train(docs, labels))
    assert scores.count() == docs.count()
    held = scores.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_classifier_learns_nothing_from_held_out(spark, labels):
    rows = [(k, f"text {k} " + ("good words here " if k % 2 else "BAD!! ") * 9, "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score(docs, quality.train(docs, x)).collect()} for x in (marks, flipped))
    assert a == b


def test_classifier_odd_rows(odd, empty, labels):
    m = quality.train(odd, labels)
    got = quality.score(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert quality.score(empty, quality.train(empty, labels.where("false"))).count() == 0
    assert quality.keep_good(odd, m).columns == odd.columns


# mixing

def _plain_targets(sizes: dict, weights=(1, 2, 3), cap=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1, None: 5, "é": 3}, {"a": 0, "b": 7}, {"a": 0, None: 0}])
def test_targets_as_plain(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    want = _plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_takes_by_key_and_meets_targets(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randint(0, 40), "en", rng.choice(["a", "b", "c", None, "hot", "hot", "hot", "hot"]), 0) for k in range(1200)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for own in by.values():
        own.sort(key=lambda r: (r.key, r.doc_id, r.size))
        target, size, before = own[0].target, own[0].source_size, 0
        assert size == sum(r.size for r in own)
        epochs = int(target // size)
        for r in own:
            again = r.size > 0 and before + r.size / 2 <= target - epochs * size
            assert r.taken == r.size * (epochs + again) <= 3 * r.size
            before += r.size
        assert abs(sum(r.taken for r in own) - target) <= 40
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect())


def test_mix_weights_of_nothing_come_last(spark):
    rows = [(k, "w " * 10, "en", "a" if k < 40 else "b", k) for k in range(60)]
    weigh = lambda q: {r.doc_id: r.times for r in mixing.mix_sources(spark.createDataFrame(rows, DOCS), quality=q).collect()}
    from pyspark.sql import functions as F
    for nothing in (0.0, -3.0):
        got = weigh(F.when(F.col("doc_id") % 2 == 0, F.lit(nothing)).otherwise(1.0))
        # a: 400 words with a target of 200; all of them are of documents with a weight
        assert {k for k in range(40) if got[k]} == set(range(1, 40, 2))
    plain = weigh(F.lit(1.0))
    assert weigh(F.lit(None).cast("double")) == weigh(F.lit(float("nan"))) == plain


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"site{k:04d}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(3000)} | {None: 7}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = _plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_odd_rows(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.repeat_mixed(odd).columns == odd.columns


# SentencePiece

TEXTS = ["Hello world", "  a  b ", "\nfoo\tbar\r\n", "", " ", "日本 ﬁ Å ñandú", "x" * 300, " " * 40 + "y", "naïve café, résumé; 100% (ok)!"]


@model
def test_ids_are_the_library_s(spark):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    vocabulary = [library.id_to_piece(k).replace("▁", " ") for k in range(300, 32000)]
    texts = TEXTS + ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts += ["".join(rng.choice("aabcdefgthein  \n\té日本x()=ﬁçñ09_-") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = spieces.encode(docs, MODEL)
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    assert got == dict(enumerate(library.encode(texts)))
    assert out.where("not round_trip").count() == 0
    assert {r.doc_id: r.text for r in spieces.decode(out, MODEL).collect()} == dict(enumerate(texts))


def _best(pieces: spieces.Pieces, word: str) -> float:
    best = [0.0] + [-math.inf] * len(word)
    for e in range(1, len(word) + 1):
        for a in range(e):
            t = pieces.number.get(word[a:e], len(pieces.ids) if e - a == 1 else None)
            if t is not None:
                best[e] = max(best[e], best[a] + pieces.score[t])
    return best[-1]


def test_unigram_viterbi_is_optimal():
    rng = random.Random(6)
    texts = ["▁"] + list("abcd") + ["ab", "abc", "▁a", "▁ab", "bcd", "cd", "dd", "aba"]
    pieces = spieces.Pieces([("<unk>", 0.0, spieces.UNKNOWN)] + [(t, -rng.random() * 5 - 1, spieces.NORMAL) for t in texts], spieces.UNIGRAM)
    words_ = ["▁" + "".join(rng.choice("abcdz") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    flat, size = pieces._viterbi([w for w in words_ if len(w) == 8])
    at = np.cumsum(np.r_[0, size])
    for k, w in enumerate(x for x in words_ if len(x) == 8):
        tokens = flat[at[k]:at[k + 1]]
        assert pieces.score[np.where(tokens < 0, len(pieces.ids), tokens)].sum() == pytest.approx(_best(pieces, w))


@model
def test_pieces_odd_rows(odd, empty):
    got = spieces.encode(odd, MODEL).collect()
    assert len(got) == odd.count()
    assert all(r.round_trip for r in got if r.doc_id != 8) and all(r.n_tokens == len(r.ids) for r in got)
    assert not next(r for r in got if r.doc_id == 8).round_trip  # a text with the mark itself
    assert spieces.encode(empty, MODEL).count() == 0


def _small_bpe() -> tuple[spieces.Pieces, list[str]]:
    merges = ["ab", "▁a", "abc", "cd", "bcd", "▁ab", "aba", "dd", "bc", "dda", "▁abc"]
    texts = ["▁", *"abcd", *merges]
    return spieces.Pieces([("<unk>", 0.0, spieces.UNKNOWN)] + [(t, -float(k), spieces.NORMAL) for k, t in enumerate(texts)]), texts


def _plain_bpe(pieces: spieces.Pieces, texts: list[str], word: str) -> list[int]:
    """Merges the best neighbours, the leftmost of equal ones, until none makes a piece."""
    parts = list(word)
    while True:
        known = [(texts.index(parts[j] + parts[j + 1]), j) for j in range(len(parts) - 1) if parts[j] + parts[j + 1] in texts]
        if not known:
            break
        j = min(known)[1]
        parts[j:j + 2] = [parts[j] + parts[j + 1]]
    ids = [1 + texts.index(t) if t in texts else 0 for t in parts]
    return [i for k, i in enumerate(ids) if i or not k or ids[k - 1]]


@pytest.mark.parametrize("verdicts", [1, 4, 1 << 20])
def test_bpe_ids_whatever_is_kept(verdicts, monkeypatch):
    monkeypatch.setattr(spieces, "VERDICTS", verdicts, raising=False)
    pieces, texts = _small_bpe()
    cache = spieces.Cache(pieces, most=40)
    rng = random.Random(12)
    for _ in range(12):
        words_ = list({"▁" + "".join(rng.choice("abcdz") for _ in range(rng.randint(0, 9))) for _ in range(60)})
        at, size, flat = cache.ids_of(np.array(words_, dtype=object))
        assert {w: flat[a:a + n].tolist() for w, a, n in zip(words_, at.tolist(), size.tolist())} == {w: _plain_bpe(pieces, texts, w) for w in words_}


def test_units_met_again_are_encoded_once(monkeypatch):
    pieces, _ = _small_bpe()
    encoded, encode = [], pieces.encode_units
    monkeypatch.setattr(pieces, "encode_units", lambda units: encoded.extend(units) or encode(units))
    cache = spieces.Cache(pieces, most=50)
    often = ["▁" + w for w in ("a", "ab", "cd", "dda", "abcd")]
    for k in range(20):  # each slice brings 20 new units, so the cache is full after three
        cache.ids_of(np.array(often + ["▁" + "abcd"[k % 4] * (j + 5) + "b" * k for j in range(20)], dtype=object))
        assert len(cache.place) <= 50 + 25
    assert all(encoded.count(u) == 1 for u in often)


def test_a_pair_s_verdict_is_found_once(monkeypatch):
    pieces, _ = _small_bpe()
    tried, judge = [], pieces.side_by_side
    monkeypatch.setattr(pieces, "side_by_side", lambda a, b: tried.append(len(a)) or judge(a, b))
    first, again = (pieces.encode_units(["▁abcd", "▁ddab"]) for _ in range(2))
    once = sum(tried)
    pieces.encode_units(["▁abcd", "▁ddab"])
    assert once == sum(tried) and all((x == y).all() for x, y in zip(first, again))


def test_unsupported_models_raise():
    with pytest.raises(ValueError):
        spieces.Pieces([("a▁b", 0.0, spieces.NORMAL)])


# secrets

def _secret_rows() -> list[tuple]:
    rng = random.Random(7)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    out = []
    for k in range(120):
        kind = k % 4
        text = {0: f'set token = "{hexa(40)}" now', 1: f"the documentation characteristics{'ally' * (k % 3)} responsibilities are read", 2: f"key AKIA{''.join(rng.choice('ABCDEFGH234567') for _ in range(16))} here",
                3: "see https://host.example/internationalization/page for words"}[kind]
        out.append((k, text + " and responsibilities of documentation again", "en", "s", 0))
    return out


def test_secret_scan(spark):
    rows = _secret_rows()
    docs = spark.createDataFrame(rows, DOCS)
    got = secrets.scan(docs).collect()
    text = {r[0]: r[1] for r in rows}
    assert all(text[r.doc_id][r.start:r.start + len(r.candidate)] == r.candidate for r in got)
    import re
    want = [(k, m.start(), m.group()) for k, t in text.items() for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", t)]
    assert sorted((r.doc_id, r.start, r.candidate) for r in got) == sorted(want)
    assert {r.doc_id for r in got if r.is_secret} == {k for k in text if k % 4 in (0, 2)}


def test_secret_forest_held_out(spark):
    """Labels of half the documents, and the verdicts on the other half."""
    rows = _secret_rows()
    docs = spark.createDataFrame(rows, DOCS)
    found = secrets.candidates(docs).select("id", "start", "candidate")
    labels = found.where("id % 8 < 4").withColumn("label", F.col("candidate").rlike("[0-9]").cast("int"))
    got = secrets.scan(docs, labels).where("doc_id % 8 >= 4").collect()
    assert sum(r.is_secret == any(c.isdigit() for c in r.candidate) for r in got) / len(got) > 0.95


def test_secret_scan_learns_rare_secrets(spark):
    """Few secrets among many words, and a bound that a uniform sample would fill with words."""
    rng = random.Random(9)
    token = lambda: "".join(rng.choice("ABCDEFGHabcdefgh23456789") for _ in range(24))
    known = [f'set token = "{r[1].split(chr(34))[1]}" now' for r in _secret_rows() if r[0] % 4 == 0]
    rows = [(k, "read the internationalization responsibilities and characteristically", "en", "s", 0) for k in range(3000)]
    docs = spark.createDataFrame(rows + [(5000 + k, t, "en", "s", 0) for k, t in enumerate(known[:6])], DOCS)
    assert {r.doc_id for r in secrets.scan(docs, bound=20).where("is_secret").collect()} == set(range(5000, 5006))
    docs = spark.createDataFrame(rows + [(5000 + k, f"with {token()} in it", "en", "s", 0) for k in range(12)], DOCS)
    labels = secrets.candidates(docs).where("id % 2 = 0").selectExpr("id", "start", "cast(candidate rlike '[0-9]' as int) as label")
    assert {r.doc_id for r in secrets.scan(docs, labels, bound=20).where("is_secret").collect()} == set(range(5000, 5012))


def test_secret_scan_without_labelled_secrets(spark):
    docs = spark.createDataFrame(_secret_rows(), DOCS)
    labels = secrets.candidates(docs).where("id < 4").selectExpr("id", "start", "0 as label")
    got = secrets.scan(docs, labels).where("is_secret").collect()
    assert {r.doc_id for r in got} == {k for k in range(4, 120) if k % 4 in (0, 2)}


GIVEN = [('password = "hunter2x" is set', "hunter2x"), ("api_key: k9$Zq!77pW, then", "k9$Zq!77pW"), ("Passwd := 'a b'", "a"), ("see https://user:p@ss@db.example/x", "p@ss"),
         ('{"secret": "x"}', "x"), ("https://h.example/a?token=q7&b=1 there", "q7"), ("token = " + "ab12" * 6 + ".c", "ab12" * 6 + ".c"), ("the password is long", None), ("https://host:8080/p@q", None), ("a token =", None)]


def test_secret_candidates_of_any_form_after_a_name(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, (t, _) in enumerate(GIVEN)], DOCS)
    got = [(r.id, r.start, r.candidate) for r in secrets.candidates(docs).collect()]
    assert sorted(got) == [(k, t.rindex(c), c) for k, (t, c) in enumerate(GIVEN) if c]


def test_secret_candidates_are_linear_and_keep_their_context(spark):
    """Twenty thousand candidates of one text: places, and the 80 characters beside each, other candidates included."""
    text = " ".join(f"x{k} key{k}abcdefghijklmnop," for k in range(20_000))
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (2, "no candidates", "en", "s", 0), (3, None, "en", "s", 0)], DOCS)
    got = secrets.candidates(docs).collect()
    import re
    want = [(m.start(), m.group()) for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text)]
    assert sorted((r.start, r.candidate) for r in got) == want and len(want) == 20_000
    for r in got:
        assert r.left == (" " + text)[:r.start + 1][-80:] and r.right == text[r.start + len(r.candidate):][:80]


def test_secret_values_beyond_former_bounds(spark):
    texts = ['password =      "hunter2x"', f"see https://{'u' * 70}:{'p' * 280}@db.example/x", "token" + "\t" * 12 + ":" + " " * 14 + "q!7"]
    want = ["hunter2x", "p" * 280, "q!7"]
    got = {r.id: r.candidate for r in secrets.candidates(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)).where("candidate not like 'u%'").collect()}
    assert got == dict(enumerate(want))


def test_secret_forest_decides(spark):
    """A finding of a known form has the forest's score, and a column of its own tells the form."""
    docs = spark.createDataFrame(_secret_rows(), DOCS)
    labels = secrets.candidates(docs).selectExpr("id", "start", "0 as label").where("id % 4 = 2").union(secrets.candidates(docs).selectExpr("id", "start", "1").where("id % 4 = 0 and start < 20"))
    got = [r for r in secrets.scan(docs, labels).collect() if r.known_form]
    assert {r.doc_id % 4 for r in got} == {0, 2} and all(r.is_secret == (r.doc_id % 4 == 0) for r in got)


def test_secret_scan_of_short_values_and_url_keys(spark):
    """Short values are judged, and url text that is no word isn't taken for harmless."""
    rows = _secret_rows() + [(1000, 'now password = "hunter2x7" holds', "en", "s", 0), (1001, "https://h.example/a?id=9f8e7d6c5b4a39281706f5e4 there", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.candidate for r in secrets.scan(docs).where("doc_id = 1000").collect()} == {"hunter2x7"}
    labels = {(r.id, r.label) for r in secrets.seed_labels(secrets.candidates(docs)).where("id >= 1000 or id = 3").collect()}
    assert labels == {(3, 0)}


def test_secret_odd_rows(spark, odd, empty):
    got = secrets.scan(odd).collect()
    assert {r.doc_id for r in got} == {7}
    assert secrets.scan(empty).count() == 0
