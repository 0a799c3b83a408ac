"""SentencePiece encoding and decoding by batched Viterbi in numpy."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix, slices, text_bytes

#: fixed values: the mark that stands for a space, piece types and model types of the format
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
#: letters that a run of text is cut around, where no piece has one beside another character
LETTERS = "A-Za-z\u00c0-\u024f"
#: distinct units of text whose ids a task keeps, bytes of text that it splits at once
CACHE, SLICE_BYTES = 100_000, 500_000
#: verdicts on pairs of pieces that a process keeps
VERDICTS = 1 << 20
BASE = np.uint64(0x100000001B3)
PAIR = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at:at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], int, bool]:
    """Pieces (text, score, type), model type and whether a leading mark is added.

    Raises ValueError for a model whose normalisation or type isn't supported here, rather than
    giving other ids than the model means.
    """
    pieces, model, prefix, collapse, charsmap = [], UNIGRAM, True, True, b""
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            model = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            own = dict(_fields(value))
            prefix, collapse, charsmap = bool(own.get(3, 1)), bool(own.get(4, 1)), own.get(2, b"")
    if model not in (UNIGRAM, BPE) or charsmap or collapse or any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, t in pieces):
        raise ValueError("this model's type, normalisation or piece types aren't supported")
    return pieces, model, prefix


class Pieces:
    """A model as arrays: sorted hashes of pieces, scores, and for BPE which pieces may stand side by side.

    Tokens are numbered in the order in which BPE prefers merges, single characters first; one number
    past the last stands for a character without a piece. Size follows the vocabulary alone.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], model: int = BPE, prefix: bool = True):
        self.model, self.prefix = model, prefix
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        normal = sorted((len(t) > 1, -s, i) for i, (t, s, kind) in enumerate(pieces) if kind == NORMAL)
        self.ids = np.array([i for _, _, i in normal], np.int64)
        texts = [pieces[i][0] for i in self.ids]
        self.number = {t: k for k, t in enumerate(texts)}
        self.score = np.array([pieces[i][1] for i in self.ids] + [min((p[1] for p in pieces if p[2] == NORMAL), default=0.0) - 10.0])
        self.longest = max(map(len, texts), default=1)
        if any(MARK in t.lstrip(MARK) for t in texts):
            raise ValueError("pieces that span words aren't supported")
        cut_lines = not any("\n" in t for t in texts if len(t) > 1)
        cut_words = not any(re.search(f"[{LETTERS}][^{LETTERS}{MARK}]|[^{LETTERS}{MARK}][{LETTERS}]", t) for t in texts)
        line = "\n" if cut_lines else ""
        self.unit = f"{MARK}*[{LETTERS}]+|{MARK}*[^{LETTERS}{MARK}{line}]+|{MARK}+" if cut_words else f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+"
        if cut_lines:
            self.unit += "|\n"
        self.runs = {len(t): int(i) for t, i in zip(texts, self.ids) if not t.strip(MARK)}
        self.odd = mix(np.arange(self.longest + 1, dtype=np.uint64), 13) | np.uint64(1)  # a factor for each length
        hashes = np.array([self._hash(t) for t in texts], np.uint64)
        self.seen = np.zeros(1 << 20, bool)  # by the highest bits of a hash: whether any key has them
        self.seen[hashes >> np.uint64(44)] = True
        order = np.argsort(hashes)
        self.keys, self.key_token = hashes[order], order.astype(np.int64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        held = np.bincount((self.keys >> np.uint64(44)).astype(np.int64), minlength=1 << 20)
        self.first, self.crowd = (np.cumsum(held) - held).astype(np.int32), int(held.max())  # keys by their highest bits
        self.plain = [bytes([int(t[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN
                      else t.replace(MARK, " ").encode() for t, _, kind in pieces]
        self.plain_size = np.array([len(b) for b in self.plain], np.int64)
        self.plain_at = np.concatenate([[0], np.cumsum(self.plain_size)])[:-1]
        self.plain_bytes = np.frombuffer(b"".join(self.plain), np.uint8)
        if model == BPE:
            self._merges(texts)

    def _hash(self, text: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = h * BASE + np.uint64(ord(c) + 1)
        return int((h * self.odd[len(text)])[0])

    def _merges(self, texts: list[str]) -> None:
        """The last merge of each piece, and a sorted table of all pairs of pieces that make a piece."""
        number, n = self.number, len(texts)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        pairs = []
        for k, t in enumerate(texts):
            if len(t) == 1:
                continue
            if any(c not in number for c in t):
                raise ValueError("a piece has a character that is no piece")
            pairs += [(number[t[:j]] * (n + 1) + number[t[j:]], k) for j in range(1, len(t)) if t[:j] in number and t[j:] in number]
            parts = list(t)
            while len(parts) > 2:
                best, j = min((number.get(parts[j] + parts[j + 1], n), j) for j in range(len(parts) - 1))
                if best == n:
                    break
                parts[j:j + 2] = [parts[j] + parts[j + 1]]
            if len(parts) == 2:
                self.left[k], self.right[k] = number[parts[0]], number[parts[1]]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_token = table[:, 0].copy(), table[:, 1].copy()
        self.paired = np.zeros(1 << 22, bool)  # by the highest bits of a scrambled pair: whether the table may hold it
        self.paired[(self.pair_keys.astype(np.uint64) * PAIR) >> np.uint64(42)] = True
        single = np.array([len(t) == 1 for t in texts] + [True])
        self.whole = single | (self.left != np.arange(n + 1))  # pieces that merging can reach
        self.verdicts = None

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves token b to the right of token a.

        Merges of both are undone from the last to the first; if at some time the pieces that then met
        could merge before the merge just undone, BPE would have taken that one. Equal merges go from
        left to right.
        """
        ok = np.ones(len(a), bool)
        live, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), NEVER)
        size = len(self.left)
        while len(live):
            key = a * size + b
            maybe = np.flatnonzero(self.paired[(key.astype(np.uint64) * PAIR) >> np.uint64(42)])
            lost = np.zeros(len(a), bool)
            if len(maybe):
                at = np.minimum(np.searchsorted(self.pair_keys, key[maybe]), len(self.pair_keys) - 1)
                lost[maybe] = (self.pair_keys[at] == key[maybe]) & (self.pair_token[at] < limit[maybe])
                ok[live[lost]] = False
            left_last = ((a > b) & (self.right[a] != a)) | (self.left[b] == b)
            done = (self.right[a] == a) & (self.left[b] == b)
            limit = np.where(left_last, a, b + 1)
            a, b = np.where(left_last, self.right[a], a), np.where(left_last, b, self.left[b])
            stay = ~lost & ~done
            live, a, b, limit = live[stay], a[stay], b[stay], limit[stay]
        return ok

    def _lookup(self, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the sorted keys, whether the probe is there) of hashes whose highest bits some key has."""
        at = self.first[probe >> np.uint64(44)].astype(np.int64)
        for _ in range(self.crowd - 1):
            at += self.keys[at] < probe
            np.minimum(at, len(self.keys) - 1, out=at)
        return at, self.keys[at] == probe

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``side_by_side`` from a table of fixed size of the verdicts so far, in which a pair takes the place of another."""
        if self.verdicts is None:  # made in the task, so that it isn't sent with the model
            self.verdicts = np.full(VERDICTS, -1)
        key = a * len(self.left) + b
        slot = ((key.astype(np.uint64) * PAIR) >> np.uint64(40)) % np.uint64(VERDICTS)
        held = self.verdicts[slot]
        ok = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            ok[new] = self.side_by_side(a[new], b[new])
            self.verdicts[slot[new]] = key[new] * 2 + ok[new]
        return ok

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of one length, which advance together a character at a time: (all tokens, number per word).

        At each place, hashes of the substrings that end there probe the sorted keys of pieces;
        the best of them by score is kept as a pointer back. For BPE a substring scores 0 if its piece may
        stand after the best piece of the prefix before it, else nothing: one does at each place.
        A character without a piece is -1 less its code point in the result.
        """
        n, length, none = len(words), len(words[0]), len(self.ids)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
        prefix = np.zeros((length + 1, n), np.uint64)
        for k in range(length):
            prefix[k + 1] = prefix[k] * BASE + chars[:, k] + np.uint64(1)
        weight = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.longest, BASE, np.uint64)])
        token, back = np.zeros((length + 1, n), np.int64), np.ones((length + 1, n), np.int64)
        token[0] = -1
        total, rows = np.zeros((length + 1, n)), np.arange(n)
        for end in range(1, length + 1):
            sizes = np.arange(1, min(end, self.longest) + 1)
            sub = (prefix[end] - prefix[end - sizes] * weight[sizes, None]) * self.odd[sizes, None]
            s, r = np.nonzero(self.seen[sub >> np.uint64(44)])
            probe = sub[s, r]
            at, hit = self._lookup(probe)
            s, r, at = s[hit], r[hit], self.key_token[at[hit]]
            lone = np.ones(n, bool)
            lone[r[:np.searchsorted(s, 1)]] = False
            lone = np.flatnonzero(lone)
            if len(lone):
                s, r, at = np.r_[np.zeros(len(lone), np.int64), s], np.r_[lone, r], np.r_[np.full(len(lone), none), at]
            if self.model == BPE:
                before = token[end - s - 1, r]
                fits = self.whole[at]
                check = np.flatnonzero(fits & (before >= 0))
                fits[check] = self._fits(before[check], at[check])
                s, r, at = s[fits][::-1], r[fits][::-1], at[fits][::-1]  # of several, the shortest is written last
                token[end, r], back[end, r] = at, s + 1
                continue
            value, piece = np.full((len(sizes), n), -np.inf), np.zeros((len(sizes), n), np.int64)
            value[s, r], piece[s, r] = total[end - s - 1, r] + self.score[at], at
            best = value.argmax(axis=0)
            total[end], token[end], back[end] = value[best, rows], piece[best, rows], best + 1
        out, place = np.zeros((n, length), np.int64), np.full(n, length)
        used = np.zeros((n, length), bool)
        live = np.arange(n)
        while len(live):
            here = place[live]
            t = token[here, live]
            out[live, here - 1] = np.where(t == none, -1 - chars[live, here - 1].astype(np.int64), t)
            used[live, here - 1] = True
            place[live] = here - back[here, live]
            live = live[place[live] > 0]
        return out[used], used.sum(axis=1)

    def _run(self, size: int) -> list[int]:
        """Marks alone: merges of equal score go from left to right, so runs are cut into the longest pieces."""
        out = []
        while size:
            step = max(k for k in self.runs if k <= size)
            out.append(self.runs[step])
            size -= step
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, number per unit) for distinct units, as ``split`` makes them."""
        extra = np.zeros(len(units), np.int64)
        if self.model == BPE:
            extra = np.array([max(len(u) - len(u.lstrip(MARK)) - 1, 0) if u.startswith(MARK * 2) else 0 for u in units], np.int64)
        cores = [u[e:] if e else u for u, e in zip(units, extra.tolist())]
        lengths = np.array([len(c) for c in cores])
        tokens, sizes, rows = [], [], []
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            step = max(1, 500_000 // (length * self.longest))
            for k in range(0, len(own), step):
                some = own[k:k + step]
                t, n = self._viterbi([cores[i] for i in some.tolist()])
                tokens.append(t), sizes.append(n), rows.append(some)
        rows = np.concatenate(rows)
        size = np.concatenate(sizes)
        flat, start = np.concatenate(tokens), np.concatenate([[0], np.cumsum(size)])[:-1]
        order = np.argsort(rows)
        flat, ptr = gather(order, start, size, flat)
        size = size[order]
        ids = np.where(flat >= 0, self.ids[np.maximum(flat, 0)], -1).astype(np.int32)
        # units with characters without a piece, or with more marks than one, are finished one by one
        odd = np.unique(np.r_[np.searchsorted(ptr, np.flatnonzero(flat < 0), side="right") - 1, np.flatnonzero(extra)])
        if not len(odd):
            return ids, size
        own_ids, mark = [ids], self.number.get(MARK, -1)
        at, end = ptr[:-1].copy(), len(ids)
        for u in odd.tolist():
            own, got = flat[ptr[u]:ptr[u + 1]].tolist(), []
            for t in own:
                if t >= 0:
                    got.append(int(self.ids[t]))
                elif self.byte_ids:
                    got += [self.byte_ids[b] for b in chr(-1 - t).encode()]
                elif not got or got[-1] != self.unknown:
                    got.append(self.unknown)
            if extra[u]:
                got = self._run(int(extra[u]) + 1) + got[1:] if own[0] == mark else self._run(int(extra[u])) + got
            own_ids.append(np.array(got, np.int32))
            at[u], size[u] = end, len(got)
            end += len(got)
        return gather(np.arange(len(size)), at, size, np.concatenate(own_ids))[0], size

    def split(self, text: str) -> list[str]:
        """Units that no piece crosses: letters or other characters with the marks before them, a line end apart."""
        if not text:
            return []
        return re.findall(self.unit, (MARK if self.prefix else "") + text.replace(" ", MARK))


class Cache:
    """Ids of units encoded so far.

    When it holds more than ``most``, it keeps those met again since it last did, or none if these are more than half.
    """

    def __init__(self, pieces: Pieces, most: int = CACHE):
        self.pieces, self.most = pieces, most
        self.place: dict[str, int] = {}
        self.size, self.flat, self.again = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.again)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        units = np.array(list(self.place), dtype=object)[keep]
        self.place = dict(zip(units.tolist(), range(len(keep))))
        self.flat, _ = gather(keep, np.cumsum(self.size) - self.size, self.size, self.flat)
        self.size, self.again = self.size[keep], np.zeros(len(keep), bool)

    def ids_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, all ids): where the ids of each distinct unit are."""
        if len(self.place) > self.most:
            self._shrink()
        place = self.place
        at = np.array([place.get(u, -1) for u in units.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new):
            names = units[new].tolist()
            flat, size = self.pieces.encode_units(names)
            at[new] = np.arange(len(place), len(place) + len(new))
            place.update(zip(names, at[new].tolist()))
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return (np.cumsum(self.size) - self.size)[at], self.size[at], self.flat


def gather(ids: np.ndarray, at: np.ndarray, size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``flat[at[i]:at[i] + size[i]]`` of the given ids one after another, and their n + 1 offsets."""
    n = size[ids]
    ptr = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(int(ptr[-1])) + np.repeat(at[ids] - ptr[:-1], n)], ptr


def encode_texts(texts: list[str | None], cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, n + 1 offsets); each distinct unit is encoded once."""
    units, counts = [], []
    for t in texts:
        own = cache.pieces.split(t or "")
        units += own
        counts.append(len(own))
    if not units:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    codes, distinct = pd.factorize(np.array(units, dtype=object))
    ids, ptr = gather(codes, *cache.ids_of(distinct))
    return ids, ptr[np.concatenate([[0], np.cumsum(counts)])]


def decode_bytes(pieces: Pieces, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of the decoded texts, n + 1 offsets), without the space that stands for the added mark."""
    data, ends = gather(ids, pieces.plain_at, pieces.plain_size, pieces.plain_bytes)
    offsets = ends[ptr]
    if pieces.prefix:
        keep = np.ones(len(data), bool)
        starts = offsets[:-1][np.diff(offsets) > 0]
        keep[starts[data[starts] == 32]] = False
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        data = data[keep]
    return data, offsets


def load(spark: SparkSession, path: str):
    """The model at ``path``, read through Spark and broadcast; its size follows the vocabulary."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    return spark.sparkContext.broadcast(Pieces(*read_model(data)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and round_trip (the ids decode to exactly the text) of every whole text.

    ``model`` is the path of a SentencePiece model. Null and empty texts have no ids and round-trip. A text that
    holds the mark itself decodes to a space there, as with the format's own library, and is reported
    as no round trip. Repeated rows and null ids are encoded each. Other columns are ignored.
    """
    shared = load(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        cache = Cache(pieces)
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                texts = part.column("text")
                ids, ptr = encode_texts(texts.to_pylist(), cache)
                data, offsets = decode_bytes(pieces, ids, ptr)
                raw, own = text_bytes(texts)
                same = np.diff(offsets) == np.diff(own)
                if same.all():
                    differ = np.concatenate([[0], np.cumsum(data != raw)])
                    same = differ[own[1:]] == differ[own[:-1]]
                else:
                    a, b = data.tobytes(), raw.tobytes()
                    same = np.array([a[i:j] == b[k:m] for i, j, k, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), own[:-1].tolist(), own[1:].tolist())])
                lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(ptr)), lists, pa.array(same, pa.bool_())], names=["id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of rows with arrays of ids; a null array gives an empty text, bytes that are no UTF-8 U+FFFD."""
    shared = load(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            ptr = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            data, offsets = decode_bytes(shared.value, ids, ptr)
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
