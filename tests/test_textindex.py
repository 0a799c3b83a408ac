"""The stored full-text index against plain scans: matches, what is read, and the trigrams of expressions."""

import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from postlake.functions.text import flatten_py
from postlake.operators import fulltext as FT
from postlake.operators import textindex as TI

WORDS = ["the", "of", "Über", "quick", "quickly", "brown", "fox", "foxes", "nation", "station", "stations", "a.b", "x1", "of"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    rows = [(k * 7 - 300, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))), rng.choice(["the fox", None, "of of"])) for k in range(200)]
    return [*rows, (5000, None, "only subject"), (5001, "", None), (5002, "the " * 3000, "rare")]


@pytest.fixture(scope="module")
def index(spark, texts):
    path = tempfile.mkdtemp(prefix="postlake-index-")
    m = spark.createDataFrame(texts, "doc_id long, body string, subject string").repartition(4)
    TI.write_index(m, path, {"body": "body", "subject": F.upper("subject")}, blocks=8, buckets=4, slices=2)
    return TI.TextIndex(spark, path)


def _tokens(text):
    return [t for t in re.split(r"[^\w]+|_", flatten_py(text or "")) if t]


def _docs(df):
    ids = [r[0] for r in df.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    return set(ids)


def test_matches_as_plain_scans(texts, index):
    body = {d: _tokens(b) for d, b, _ in texts}
    has = lambda *ws: {d for d, t in body.items() if set(ws) <= set(t)}
    assert _docs(index.match([("body", "ÜBER"), ("body", "fox"), ("body", "the")])) == has("uber", "fox", "the")
    assert _docs(index.match([("body", "foxes"), ("body", "x1")], "or", exclude=[("body", "of")])) == (has("foxes") | has("x1")) - has("of")
    assert _docs(index.match([("body", "the"), ("subject", "rare")])) == {5002}
    assert _docs(index.match([("body", "the"), ("body", "never")])) == set() == _docs(index.match([]))
    for phrase in ("of the", "the the the", "quick brown", "a b", "fox", "of of of", "station the never"):
        ws = _tokens(phrase)
        want = {d for d, t in body.items() if any(t[k:k + len(ws)] == ws for k in range(len(t)))}
        assert _docs(index.match_phrase("body", phrase)) == want
    for rx in ("^quick", "ation", "s$", "^.*x.*$", "a|of", "sta?tions?", "(na)+tion", "[xf]o", "never"):
        got = {r["doc_id"]: r["n_terms"] for r in index.match_regex("body", rx).collect()}
        want = {d: len({w for w in t if re.search(rx, w)}) for d, t in body.items()}
        assert got == {d: n for d, n in want.items() if n}
    assert _docs(index.match_prefix("body", "QUICK*")) == {d for d, t in body.items() if any(w.startswith("quick") for w in t)}


def test_dictionary_and_field(texts, index):
    got = {(r["field"], r["term"]): (r["n_docs"], r["n_occ"]) for r in index.dictionary().collect()}
    want = {}
    for d, b, s in texts:
        for field, t in (("body", _tokens(b)), ("subject", _tokens(s))):
            for w in set(t):
                n, o = want.get((field, w), (0, 0))
                want[field, w] = (n + 1, o + t.count(w))
    assert got == want


def test_lookups_read_their_folder_only(index):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = index._rows("body", "fox")
    assert "PartitionFilters: [isnotnull(field" in plan(rows) and "PushedFilters: [IsNotNull(term), EqualTo(term,fox)]" in plan(rows)
    one = index._at("postings", "body", ["fox"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].rsplit("/", 1)[0] for r in one}) == 1
    both = plan(index.match([("body", "fox"), ("body", "the")]))
    assert "ReadSchema: struct<term:string,block:int,docs:array<bigint>>" in both and "pos:array" not in both  # positions aren't read
    assert "ReadSchema: struct<term:string,gram:string>" in plan(index.terms_like("body", "^quick"))


def test_index_is_smaller_than_a_row_per_place(spark, texts, index, tmp_path):
    import pathlib
    m = spark.createDataFrame(texts, "doc_id long, body string, subject string")
    FT.write_postings(FT.build_postings(m, {"body": "body"}), str(tmp_path / "rows"))
    size = lambda p: sum(f.stat().st_size for f in pathlib.Path(p).rglob("*.parquet"))
    n = lambda p: spark.read.parquet(p).count()
    assert n(f"{index.path}/postings/field=body") < n(str(tmp_path / "rows")) / 5
    assert size(f"{index.path}/postings/field=body") < 3 * size(tmp_path / "rows")  # tiny files: footers weigh most here


def test_required_trigrams():
    need = TI.required_trigrams
    assert need("^quick") == {"\x02qu", "qui", "uic", "ick"} and need("fox$") == {"fox", "ox\x03"}
    assert need("^th[a-z]*ion$") == {"\x02th", "ion", "on\x03"} and need("a.c") == set() and need("abc?d") == set()
    assert need("abcd?") == {"abc"} and need("abc+def") == {"abc", "def"} and need("a|bcd") == set() == need("(?i)abc")
    assert need(r"abc\.def") == {"abc", "bc.", "c.d", ".de", "def"} and need(r"abc\d{2,3}def") == {"abc", "def"} and need(r"\x41bcd") == set()
    assert need("(abc)def") == {"def"} and need("abc{2}") == set() and need("") == set() and need("[") == set()


def test_trigrams_never_lose_a_term():
    rng = random.Random(3)
    terms = ["".join(rng.choice("abcx.") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    marked = {t: {f"\x02{t}\x03"[k:k + 3] for k in range(len(t))} for t in terms}
    atoms = ["a", "b", "c", "x", r"\.", ".", "[ab]", "[^c]", "(ab)", "(a)", "ab", "abc", r"\w"]
    for _ in range(1500):
        rx = rng.choice(["", "^"]) + "".join(rng.choice(atoms) + rng.choice(["", "", "", "?", "*", "+", "{1,2}", "+?"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "$"])
        need = TI.required_trigrams(rx)
        assert [t for t in terms if re.search(rx, t) and not need <= marked[t]] == [], rx


def test_empty_table(spark):
    path = tempfile.mkdtemp(prefix="postlake-index-") + "/x"
    TI.write_index(spark.createDataFrame([(1, None)], "doc_id long, body string"), path, {"body": "body"})
    x = TI.TextIndex(spark, path)
    assert x.dictionary().count() == 0 and _docs(x.match([("body", "a")])) == set() == _docs(x.match_regex("body", "abc").select("doc_id"))


def test_packs_hold_whole_documents(monkeypatch):
    """Rows of a document, in several batches and with equal and null ids, are in one pack, with their places in order."""
    import pyarrow as pa
    monkeypatch.setattr(TI, "PACKED", 7)
    rng = random.Random(3)
    rows = sorted(((i % 3, i, [rng.choice("abc") for _ in range(rng.randint(0, 4))]) for i in (1, 1, 1, 2, 3, 4, 4, 5, 6, 6, 6, 6, 7)), key=lambda r: r[:2])
    rows = [(2, None, ["a", "b"]), (2, None, ["a"]), (2, 0, ["a"]), *rows]
    schema = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("tokens", pa.list_(pa.string()))])
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[k:k + size]], schema) for k in range(0, len(rows), size)]
        got, packs = {}, list(TI._packs(iter(batches)))
        for r in (r for b in packs for r in b.to_pylist()):
            for d, pos in zip(r["docs"], r["pos"]):
                assert (r["term"], r["block"], d) not in got and pos == sorted(pos)
                got[r["term"], r["block"], d] = pos
        plain = {}
        for block, d, ts in rows:
            for k, t in enumerate(ts):
                plain.setdefault((t, block, d), []).append(k)
        assert got == {k: sorted(v) for k, v in plain.items()}
        assert len(packs) > 2


def test_index_grows_by_blocks(spark, tmp_path, monkeypatch):
    """Blocks and slices follow the documents, and texts and packs cross one exchange each."""
    monkeypatch.setattr(TI, "BLOCK_DOCS", 10)
    monkeypatch.setattr(TI, "SLICE_BLOCKS", 4)
    m = spark.createDataFrame([(k % 700, f"w{k % 5} the") for k in range(800)], "doc_id long, body string")
    TI.write_index(m, str(tmp_path / "x"), {"body": "body"})
    settings = spark.read.parquet(str(tmp_path / "x/settings")).first()
    assert settings["blocks"] == 80
    d = {r["term"]: (r["n_docs"], r["n_occ"]) for r in TI.TextIndex(spark, str(tmp_path / "x")).dictionary("body").collect()}
    assert d == {"the": (700, 800), **{f"w{k}": (140, 160) for k in range(5)}}


def test_postings_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Ranges follow the tokens, a term is first once in a document, and the dictionary makes no (term, document) distinct."""
    monkeypatch.setattr(FT, "TASK_ROWS", 60)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    m = spark.createDataFrame([(k % 90 if k % 10 else None, f"w{k % 7} the the b{k}") for k in range(300)], "doc_id long, body string")
    FT.write_postings(FT.build_postings(m, {"body": "body"}), str(tmp_path / "p"))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    p = spark.read.parquet(str(tmp_path / "p"))
    assert len(p.inputFiles()) > 15 and p.count() == 1200
    stored = FT.term_dictionary(p, "body")
    assert stored._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, FT.term_dictionary(p.drop("first"), "body").collect()))
    assert p.where("last").count() == 300
