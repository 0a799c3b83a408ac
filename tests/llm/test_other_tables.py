"""Operators on conversations, embeddings and pages, the SQL of the queries, and the pipeline."""

from __future__ import annotations

import math
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from postlake.llm import chat, urls, vptree
from postlake.llm.common import min_labels, running_sums
from postlake.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
TURNS = "conv_id long, turn long, role string, text string"


# helpers of the subpackage

def test_running_sums_split_a_hot_group(spark):
    from pyspark.sql import functions as F
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(50), k, rng.randrange(9)) for k in range(2000)]
    got = running_sums(spark.createDataFrame(rows, "g string, o long, k long, v long"), "g", ["o", "k"], {"before": F.col("v"), "nth": F.lit(1)}).collect()
    total, nth = Counter(), Counter()
    for r in sorted(got, key=lambda r: (r.o, r.k)):
        assert (r.before, r.nth) == (total[r.g], nth[r.g])
        total[r.g] += r.v
        nth[r.g] += 1
    assert len(got) == 2000


def test_min_labels(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 3), (200, 200)]
    got = {r.node: r.label for r in min_labels(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert min_labels(spark.createDataFrame([], "a long, b long")).count() == 0


# chat

def _plain_chats(rows: list[tuple]) -> set:
    """(id, turns, copies, text) of each conversation that stays; a row without an id is a conversation of its own."""
    convs: dict = {}
    for n, (c, *rest) in enumerate(rows):
        key = ("c", c) if c is not None else ("n", n)
        convs.setdefault(key, []).append((c, *rest))
    order = lambda t: tuple((x is not None, x or 0 if k == 0 else x or "") for k, x in enumerate(t[1:]))
    lists = {k: [(t[2], t[3]) for t in sorted(v, key=order)] for k, v in convs.items()}
    out = set()
    for key, turns in lists.items():
        if any(len(o) > len(turns) and o[:len(turns)] == turns for o in lists.values()):
            continue
        equal = [k for k, o in lists.items() if o == turns]
        if key != min(equal, key=lambda k: (k[0] == "n", k[1:])):
            continue
        safe = lambda x, e: (e if x is None else x).replace("<|", "< |")
        text = "".join(f"<|im_start|>{safe(r, 'unknown')}\n{safe(t, '')}<|im_end|>\n" for r, t in turns)
        out.add((key[1] if key[0] == "c" else None, len(turns), len(equal), text))
    return out


def test_chats_as_plain(spark):
    rng = random.Random(2)
    rows = []
    for c in range(120):
        base = rng.randrange(25)
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {base if t < 4 else c}"))
    rows += [(500, 0, None, None), (501, 0, None, ""), (502, None, "user", "<|im_start|>x"), (502, None, "user", "<|im_start|>x"), (None, 0, "user", "turn 0 of 3"), (None, 1, "user", "alone"), (None, 1, "user", "alone"), (None, 2, "user", "alone"), (None, None, None, None)]
    rows += [(510, 0, "user", "same")] * 3 + [(511, 0, "user", x) for x in ("b", None, "a", "b")] + [(511, None, None, "z"), (511, None, None, "y")]
    rows += [(520, 7, "user", "hot")] * (chat.PART + 40) + [(520, 8, "user", "end")]
    rows += [(900, t, "user", f"long {t}") for t in range(chat.PART * 2 + 5)]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    whole: dict = {}
    for r in sorted(got, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.text if r.conv_id is None else "", r.part)):
        key = (r.conv_id, r.n_turns, r.n_copies, r.text if r.conv_id is None else None)
        whole[key] = whole.get(key, "") + r.text
    assert {(c, n, m, text) for (c, n, m, _), text in whole.items()} == _plain_chats(rows)
    assert sum(r.conv_id == 900 for r in got) == 3
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chats_ignore_other_columns(spark):
    from pyspark.sql import functions as F
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (None, 0, "user", "c")]
    turns = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(9) for c in ("conv", "place", "n", "h1", "c1", "i1", "i2", "nth", "part", "key", "first", "many")})
    got = {(r.conv_id, r.n_turns, r.n_copies) for r in chat.format_chats(turns).collect()}
    assert got == {(2, 2, 1), (None, 1, 1)}


@given
def test_chats_without_ids_as_sql(spark, tmp_path):
    import duckdb
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 3, "user", "b"), (4, 0, "user", "b"), (5, 0, "user", "c"), (5, 1, "x", "d"), (None, 1, "user", "c")]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(map(repr, con.sql(ORACLE["op3_chat_format"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES["op3_chat_format"](spark, str(tmp_path)).collect()) == want and len(want) == 3


# nearest neighbours

def _plain_search(ids: list, vectors: list, k: int) -> dict:
    x = np.array(vectors, float)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for r, i in enumerate(ids):
        if i % 50:
            continue
        score = u @ u[r]
        best = sorted((-round(s, 12), j) for s, j in zip(score.tolist(), ids) if j != i)[:k]
        out[i] = [(j, -s) for s, j in best]
    return out


def test_search_ties_of_one_direction(spark):
    """Forty multiples of one vector, an id with very many rows, and names that the index uses: ties go to smaller ids."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(4)
    base, other = rng.normal(size=8), rng.normal(size=(60, 8))
    rows = [(k, [float(x) for x in base * 2.0 ** (20 - k)]) for k in range(40)] + [(100 + k, [float(x) for x in v]) for k, v in enumerate(other)]
    rows += [(77, [float(x) for x in v]) for v in rng.normal(size=(400, 8))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vector", "dim", "shard", "part", "block", "tree")})
    index = vptree.build_index(df, shard=64, leaf=4)
    got: dict = {}
    for r in vptree.search(index, df.where("vec_id in (0, 3, 39)"), factor=1.0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert {q: [g[k + 1][0] for k in range(5)] for q, g in got.items()} == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 39: [0, 1, 2, 3, 4]}
    assert all(s == pytest.approx(1) for g in got.values() for _, s in g.values())
    sizes = df.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(8)).alias("s")).where("vec_id = 77").groupBy("s").count()
    assert sizes.count() == 8  # one id's rows are on all shards


@pytest.mark.parametrize("factor", [1.0, 0.25])
def test_search_against_brute_force(spark, factor):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(20, size=3000)] + rng.normal(size=(3000, 16)) * 0.3
    vectors[1000:1900] = vectors[7]  # a very common vector
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = {r.vec_id: r.embedding for r in df.collect()}
    index = vptree.build_index(df, shard=700, leaf=16)
    assert index.count() > 2
    got: dict = {}
    for r in vptree.search(index, df.where("vec_id % 50 = 0"), factor=factor).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = _plain_search(list(kept), list(kept.values()), 5)
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= (0.9 if factor < 1 else 1) * 5 * len(want)
    if factor == 1:
        assert all([got[q][k + 1][0] for k in range(5)] == [v for v, _ in want[q]] for q in want)
        assert all(got[q][k + 1][1] == pytest.approx(want[q][k][1], abs=1e-11) for q in want for k in range(5))


@given
def test_search_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    got: dict = {}
    for r in QUERIES["op6_vantage_point"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = _plain_search(list(rows), list(rows.values()), 5)
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [2.0, 0.0]), (7, [0.0, 1e300]),
            (50, [1.0, 1.0]), (50, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (150, []), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in vptree.search(vptree.build_index(df), df.where("vec_id % 50 = 0")).collect()]
    h = round(2 ** -0.5, 9)
    assert sorted(got) == [(0, 1, 6, 1.0), (0, 2, 50, h), (0, 3, 7, 0.0), (50, 1, 0, h), (50, 2, 6, h), (50, 3, 7, h)]
    nothing = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vptree.search(vptree.build_index(nothing), nothing).count() == 0


# urls

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_url_parts_and_rules(spark):
    cases = [("http://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
             ("https://example.com", "example.com", "", None, "allow"), ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
             ("http://b.net/EN/", "b.net", "/EN/", None, "allow"), ("no scheme/here", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
             ("http://h.org?x=http://b.net/es/", "h.org", "", None, "allow"), ("http://Ä.com/p", "Ä.com", "/p", "com/", "allow"), ("http://", "", "", None, "allow")]
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([(k, u) for k, (u, *_) in enumerate(cases)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("id", "host", "bad", "n")})
    outcomes = spark.createDataFrame([], "id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, outcomes, RULES).collect()}
    assert got == {k: tuple(c[1:]) for k, c in enumerate(cases)}
    assert urls.judge_urls(pages.where("false"), outcomes, RULES).count() == 0


def test_bad_hosts_are_blocked_and_small_ones_shrink(spark):
    rows, bad = [], []
    for host, n, k in (("bad.site.org", 60, 58), ("good.site2.org", 60, 2), ("one.other.org", 1, 1), ("unlabelled.org", 0, 0)):
        for j in range(max(n, 1)):
            rows.append((len(rows), f"https://{host}/{j}"))
            if n:
                bad.append((len(rows) - 1, int(j < k)))
    rows += [(3, "https://bad.site.org/again"), (None, "https://good.site2.org/null")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad + bad[:5], "id long, bad int"), RULES).collect()
    verdict = {r.host: r.verdict for r in got}
    assert len(got) == len(rows)
    assert verdict == {"bad.site.org": "block", "good.site2.org": "allow", "one.other.org": "allow", "unlabelled.org": "allow"}


def test_reputation_as_plain(spark):
    rows = [("a.x.com", 1)] * 8 + [("a.x.com", 0)] * 2 + [("b.x.com", 0)] * 9 + [("c.y.net", 1)] * 3 + [("c.y.net", None)] * 4 + [("d.z.net", None)]
    got = {r.host: r for r in urls.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}

    def level(groups: dict) -> dict:
        """Posterior (a, b) of {name: (n, k, parent's mean)}."""
        s = sum(n * (k / n - m) ** 2 for n, k, m in groups.values() if n)
        v = sum(m * (1 - m) for n, k, m in groups.values() if n)
        t = sum(n * m * (1 - m) for n, k, m in groups.values() if n)
        rho = min(0.5, max(0.001, (s - v) / (t - v) if t > v else 0.001))
        c = (1 - rho) / rho
        return {x: (k + c * m, n - k + c * (1 - m)) for x, (n, k, m) in groups.items()}

    def apart(parent: tuple, n: int, k: int) -> float:
        """A parent's posterior mean without a group's own counts."""
        return (parent[0] - k) / (sum(parent) - n)

    hosts = {"a.x.com": (10, 8), "b.x.com": (9, 0), "c.y.net": (3, 3), "d.z.net": (0, 0)}
    top = (11.5, 11.5)
    suffix = level({"com": (19, 8, apart(top, 19, 8)), "net": (3, 3, apart(top, 3, 3))})
    domain = level({"x.com": (19, 8, apart(suffix["com"], 19, 8)), "y.net": (3, 3, apart(suffix["net"], 3, 3)), "z.net": (0, 0, apart(suffix["net"], 0, 0))})
    own = level({h: (*nk, apart(domain[h[2:]], *nk)) for h, nk in hosts.items()})
    for h, (a, b) in own.items():
        assert got[h].bad_rate == pytest.approx(a / (a + b))
        assert got[h].bad_bound == pytest.approx(max(0, a / (a + b) - 1.645 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5))


# queries and pipeline

@given
@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_its_sql(spark, key):
    import duckdb
    from tools.check_oracle import digest
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[key](spark, SF)
    cur = con.execute(ORACLE[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[1] == digest(cols, cur.fetchall())[1]


def _plain_mix(spark, docs, machine) -> Counter:
    """How often each document is taken: whole epochs, then by -ln(u) / score up to the rest, u the draw of seed 1."""
    from postlake.llm import quality

    from .helpers import words
    from .test_documents import _plain_targets
    draws = {r.doc_id: ((r.h % 2**64 >> 11) + 0.5) / 2**53 for r in docs.selectExpr("doc_id", "xxhash64(1, doc_id, text) AS h").collect()}
    scores = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    by = defaultdict(list)
    for r in docs.collect():
        by[r.source].append((-math.log(draws[r.doc_id]) / max(scores[r.doc_id], 1e-9), r.doc_id, len(words(r.text))))
    totals = {s: sum(size for *_, size in own) for s, own in by.items()}
    targets, out = _plain_targets(totals), Counter()
    for s, own in by.items():
        epochs = int(targets[s] // totals[s]) if totals[s] else 0
        before, rest = 0, targets[s] - epochs * totals[s]
        for _, i, size in sorted(own):
            out[i] += epochs + (size > 0 and before + size / 2 <= rest)
            before += size
    return +out


@given
@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="public tokenizers not present")
def test_pipeline_stages(spark):
    import corpus_pipeline as p
    import sentencepiece
    from postlake.llm import quality
    from postlake.llm.common import stored, table

    from .helpers import components, shingles, words
    from .test_documents import _plain_dedup
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    assert [n for n, _ in p.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece"]
    for name, stage in p.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), "test")
        kept[name] = docs.collect()
        if name != "SentencePiece":
            assert docs.columns == columns
        if name == "quality classifier":
            good = {r.doc_id for r in quality.score(before, quality.train(before, table(spark, SF, "labels"))).collect() if r.predicted}
            assert sorted(map(tuple, docs.collect())) == sorted(tuple(r) for r in before.collect() if r.doc_id in good)
        if name == "n-gram Jaccard join":
            rows = before.collect()
            own = components([r.doc_id for r in rows], [shingles(r.text) for r in rows])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r, c in zip(rows, own) if r.doc_id == c)
        if name == "line dedup":
            assert {r.doc_id: r.text for r in docs.collect()} == _plain_dedup([(r.doc_id, r.text) for r in before.collect()])
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
        if name == "mixing sources":
            assert Counter(r.doc_id for r in docs.collect()) == _plain_mix(spark, before, quality.train(table(spark, SF, "documents"), table(spark, SF, "labels")))
            total = sum(len(words(r.text)) for r in before.collect())
            assert abs(sum(len(words(r.text)) for r in docs.collect()) - total) < 0.5 * total
            assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 3
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    text = {r.doc_id: r.text for r in kept["mixing sources"]}
    assert all(list(r.ids) == library.encode(text[r.doc_id]) and r.round_trip for r in kept["SentencePiece"])
    assert len(kept["SentencePiece"]) == len(kept["mixing sources"])


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; import postlake.plans.catalog as c; c.load_all(); print(any(m.startswith('postlake.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "False"
