"""Plain versions of what the operators count, and small tables with odd rows."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words((text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return bool(a and b) and 100 * both >= 80 * (len(a) + len(b) - both)


def components(ids: list, sets: list[set]) -> list:
    """Smallest id that links lead to, for each document."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if find(i) != find(j) and similar(sets[i], sets[j]):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, x in enumerate(ids):
        if x is not None:
            r = find(i)
            least[r] = min(x, least.get(r, x))
    return [least.get(find(i)) if sets[i] else ids[i] for i in range(len(ids))]


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows and ids, ties, and columns with names used inside operators."""
    prose = " ".join(f"word{k} and{k % 7}" for k in range(80))
    rows = [(1, prose, "en", "a", len(prose)), (2, prose, "en", "a", len(prose)), (2, prose, "en", "a", len(prose)), (2, "another text of this id", "en", "b", 23),
            (None, prose, None, None, None), (None, "no id\nand two lines", "en", None, 5), (3, None, None, "b", None), (4, "", "en", "b", 0), (5, " \t\n ", "en", "b", 4),
            (6, "long " * 60_000, "en", "c", 300_000), (7, "x" * 50_000, "en", "c", 50_000), (8, "Ünïcode “quoted” 日本 ﬁ▁mark\r\nline", "de", "c", 30)]
    docs = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    return docs.withColumns({c: F.lit(9) for c in ("id", "k1", "k2", "size", "label", "h", "score", "n", "row", "_row", "target", "key", "n_lines")})
