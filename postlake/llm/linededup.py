"""Line dedup: shortest removable runs of lines (chunks); a chunk that an earlier place of the corpus has goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import STEP, Words, mix, slices, span_hashes

#: kinds of chunks: by first line, by last line, and both with the blank lines beside them
DEALS = 4
#: a chunk is removable with this many lines with words and words in all, or with LONG words on any number of lines
LINES, FEW, LONG = 2, 10, 50


class Lines:
    """Lines of each text, split at \\n: ``doc``, ``start`` and ``end`` in the bytes of all texts, the \\n included."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.data, offsets = words.data, words.offsets
        start = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(self.data == 10) + 1])
        self.start = start[start < len(self.data)]
        self.end = np.r_[self.start[1:], len(self.data)][:len(self.start)]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.words = np.searchsorted(words.start, self.end) - np.searchsorted(words.start, self.start)
        self.of_doc = np.searchsorted(self.doc, np.arange(len(offsets)))  # lines of text d: of_doc[d] to of_doc[d + 1]
        # the hash of a line leaves its \\n out, so that the last line of a text can equal an inner one
        inner = self.end - (self.data[self.end - 1] == 10) if len(self.start) else self.end
        self.hash = np.zeros(len(self.start), np.uint64)
        some = np.flatnonzero(inner > self.start)
        self.hash[some] = span_hashes(self.data, self.start[some], inner[some])

    def chunks(self, deal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of lines in order of their first line: (first line, lines, hash, removable); all are removable.

        A chunk is a shortest run of at least LINES lines with words and FEW words in all. ``deal`` 0 has the shortest
        that begins at each line with words, deal 1 the shortest that ends at each; deals 2 and 3 have those of 0 with the
        blank lines before them, and those of 1 with the blank lines after them, where there are any. A line of LONG
        words or more is a chunk by itself too. So a chunk depends on its own lines only, and every line of a passage that
        may be removed is in a chunk that lies inside the passage, whatever lines are around it. A line is in a
        bounded number of chunks, as a chunk has fewer than FEW lines with words besides its last or first.
        """
        some = np.flatnonzero(self.words)
        doc, long = self.doc[some], self.words[some] >= LONG
        total = np.r_[0, np.cumsum(self.words[some])]
        i = np.arange(len(some))
        if deal in (0, 2):
            j = np.maximum(np.searchsorted(total, total[:-1] + FEW) - 1, i + LINES - 1)
        else:
            i, j = np.minimum(np.searchsorted(total, total[1:] - FEW, side="right") - 1, i - LINES + 1), i
        within = (i >= 0) & (j < len(some))
        i, j = i[within], j[within]
        within = doc[i] == doc[j]
        i, j = np.r_[i[within], np.flatnonzero(long)], np.r_[j[within], np.flatnonzero(long)]
        at, last = some[i], some[j]
        if deal == 2:
            before = np.where(i > 0, some[i - 1] + 1, 0) if len(i) else at
            wide = np.maximum(before, self.of_doc[self.doc[at]])
            at, last = wide[wide < at], last[wide < at]
        elif deal == 3:
            after = np.r_[some, len(self.start)][j + 1] - 1
            wide = np.minimum(after, self.of_doc[self.doc[last] + 1] - 1)
            at, last = at[wide > last], wide[wide > last]
        order = np.lexsort((last, at))
        at, size = at[order], (last - at + 1)[order]
        # sums over runs of lines as differences of sums from the first line on, scaled back by the inverse of the weight
        n = len(self.start)
        weight = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, STEP, np.uint64)])
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, pow(int(STEP), -1, 2**64), np.uint64)])
        sums = np.r_[np.uint64(0), np.add.accumulate(mix(self.hash, 3) * weight[:n])]
        return at, size, mix((sums[at + size] - sums[at]) * back[at] + size.astype(np.uint64), 5), np.ones(len(at), bool)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per distinct place of a removable chunk: the line of its text that it begins at, its lines and its hash."""
    for batch in batches:
        for part in slices(batch):
            lines = Lines(part.column("text"))
            found = []
            for deal in range(DEALS):
                at, size, h, removable = lines.chunks(deal)
                found.append(np.stack([at, size, h.view(np.int64)], axis=1)[removable])
            at, size, h = np.unique(np.concatenate(found), axis=0).T
            doc = lines.doc[at]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("id", "k1", "k2")), pa.array((at - lines.of_doc[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(h)],
                                             names=["id", "k1", "k2", "line", "lines", "h"])


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks named in ``marks``, without a \\n at the end."""
    for batch in batches:
        for part in slices(batch):
            lines = Lines(part.column("text"))
            raw = lines.data.tobytes()
            rows, marks, texts = [], [], []
            for r, own in enumerate(part.column("marks").to_pylist()):
                for m in own:
                    a = lines.of_doc[r] + m["line"]
                    rows.append(r), marks.append(m)
                    texts.append(raw[lines.start[a]:lines.end[a + m["lines"] - 1]].removesuffix(b"\n"))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("k1").take(take), part.column("k2").take(take), *(pa.array([m[c] for m in marks], kind) for c, kind in (
                ("line", pa.int32()), ("lines", pa.int32()), ("h", pa.int64()), ("keep", pa.bool_()))), pa.array(texts, pa.binary())], names=["k1", "k2", "line", "lines", "h", "keep", "bytes"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of the chunks in ``gone``, with their numbers of lines and of lines removed."""
    for batch in batches:
        for part in slices(batch):
            texts = part.column("text")
            lines = Lines(texts)
            raw, out = lines.data.tobytes(), texts.to_pylist()
            removed = np.zeros(part.num_rows, np.int64)
            for r, own in enumerate(part.column("gone").to_pylist()):
                if not own:
                    continue
                a, b = lines.of_doc[r], lines.of_doc[r + 1]
                stays = np.ones(b - a, bool)
                for m in own:
                    stays[m["line"]:m["line"] + m["lines"]] = False
                removed[r] = (~stays).sum()
                kept = b"".join(raw[i:j] for i, j in zip(lines.start[a:b][stays].tolist(), lines.end[a:b][stays].tolist()))
                if not stays[-1] and raw[lines.end[b - 1] - 1:lines.end[b - 1]] != b"\n":
                    kept = kept.removesuffix(b"\n")  # the text didn't end in a line end before
                out[r] = kept.decode()
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, pa.string()), pa.array(np.diff(lines.of_doc)), pa.array(removed)], names=["row", "text", "n_lines", "n_removed"])


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, line, lines): chunks whose bytes an earlier place has, by smallest id (null last), then place.

    k1 and k2 hash id and text, and name a document, repeated rows included. Hashes find candidates;
    then the candidates' bytes are read and compared. Copies of a hot chunk are counted per task before the
    shuffle, and join the one row of the chunk's first place.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"),
                       F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("k2"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    index = stored(rows.mapInArrow(_index, f"id {kind}, k1 long, k2 long, line int, lines int, h long"), "chunks")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2", "line")
    first = stored(index.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi")
             .select("h", F.col("lo.k1").alias("f1"), F.col("lo.k2").alias("f2"), F.col("lo.line").alias("fl")), "first")  # so that the join on a hot chunk can be split
    found = stored(index.join(first, "h").select("k1", "k2", "line", "lines", "h", ((F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & (F.col("line") == F.col("fl"))).alias("keep")).distinct(), "found")
    marks = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("line", "lines", "h", "keep")).alias("marks"))
    texts = rows.select("k1", "k2", "text").join(marks, ["k1", "k2"])
    read = stored(texts.mapInArrow(_bytes_of, "k1 long, k2 long, line int, lines int, h long, keep boolean, bytes binary"), "bytes")
    kept = stored(read.where("keep").select("h", F.col("bytes").alias("kept")).distinct(), "kept")  # so that the join on a hot chunk can be split
    return read.where("not keep").join(kept, "h").where("bytes = kept").select("k1", "k2", "line", "lines").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated chunks of lines removed, and n_lines and n_removed (lines) added.

    Removable are runs of at least two lines with words and ten words, or of one line of fifty words. A run that
    occurs again goes whole, whatever lines are around it: the first place of equal lines stays, by smallest id (null
    last), then place; later ones go, within one document too, and where the two overlap. So a line goes
    only if a smaller id, or an earlier place, has it in an equal run, and some place keeps it. Blank lines at the edge of
    a run go if all of the blank lines there are repeated with it. Lines that stay keep their bytes. Null texts stay null, empty ones empty. Rows of equal id and text
    are one document, and their copies fare alike. Other columns pass; added columns replace ones of the
    same name.
    """
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    gone = (repeated_chunks(docs, id_col, text_col).groupBy("k1", "k2").agg(F.collect_list(F.struct("line", "lines")).alias("gone")))
    rows = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("k2"))
    joined = rows.join(gone, ["k1", "k2"], "left").select("row", "text", "gone")
    out = joined.mapInArrow(_cut, f"row {joined.schema['row'].dataType.simpleString()}, text string, n_lines long, n_removed long")
    named = {text_col: "text"} | {c: f"row.`{c}`" for c in others}
    order = [c for c in docs.columns if c in named]
    return out.select(*[F.col(named[c]).alias(c) for c in order], "n_lines", "n_removed")
