"""Sampled segmentations over the lattice of a SentencePiece vocabulary, and their lossless decoding.

The text, with a blank before it, is a lattice whose edges are the vocabulary's pieces; characters without a
piece are spelled in byte pieces. Forward filtering sums the weights of all paths to each position; backward
sampling then draws a segmentation from the end, exactly in proportion to its weight. Random numbers are a
hash of the row key, the place in the text and the step, so a row is segmented alike wherever it runs.

Between two bytes that no piece holds side by side, as at the end of a word, the lattice falls apart into units:
a worker filters equal units once and keeps them for later blocks, up to a bound, and all units of a block are
sampled together.

Nulls and edge cases: a null or empty text has no pieces; a literal U+2581 is spelled in bytes and comes back;
very long units are filtered like others; rows with equal keys and texts get equal pieces; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, text_blocks
from .rolling import Ranges, mix, owners, sums

BLANK = 0x20
#: Shares and random numbers are whole numbers below this.
ONE = 1 << 40


class Pieces:
    """The vocabulary: bytes of each piece (with a plain blank for U+2581), their fingerprints and log weights."""

    def __init__(self, path: str, sharpness: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        raw: list[bytes] = []
        usable = np.zeros(n, bool)
        rank = np.zeros(n)
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                raw.append(bytes([value]))
                self.byte_ids[value] = i
                rank[i] = n
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                raw.append(model.id_to_piece(i).replace("▁", " ").encode())
                usable[i] = True
                rank[i] = max(0.0, -model.get_score(i)) if model.get_score(i) > -1e8 else 0.0
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.at = sums(np.array([len(r) for r in raw]))
        self.weight = -sharpness * np.log(rank + 10.0)
        ids = np.flatnonzero(usable)
        at, length = self.at[ids], np.diff(self.at)[ids]
        self.longest = int(length.max(initial=1))
        # Every beginning of a piece, with the piece that it is (-1: none), so that a search stops where no piece goes on.
        some = np.repeat(np.arange(len(ids)), length)
        size = np.arange(len(some)) - np.repeat(sums(length)[:-1], length) + 1
        h = Ranges(self.data).of(at[some], at[some] + size)
        self.hash, first = np.unique(h, return_index=True)
        self.id = np.full(len(self.hash), -1, np.int32)
        whole = size == length[some]
        self.id[np.searchsorted(self.hash, h[whole])] = ids[some[whole]]
        self._may = np.zeros(1 << 22, bool)  # most substrings are ruled out here
        self._may[self.hash >> np.uint64(42)] = True
        # No piece holds the pairs of bytes that are False here, so the lattice falls apart between them.
        self.joined = np.zeros(1 << 16, bool)
        inner = np.ones(len(self.data), bool)
        inner[self.at[:-1][np.diff(self.at) > 0]] = False
        q = np.flatnonzero(inner)
        self.joined[self.data[q - 1].astype(np.int32) << 8 | self.data[q]] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the fingerprints begin a piece, and the ids of the pieces that they are, or -1."""
        at = np.flatnonzero(self._may[h >> np.uint64(42)])
        i = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        hit = self.hash[i] == h[at]
        return at[hit], self.id[i[hit]]


class Lattice:
    """The filtered lattice of many units at once. Node of a position: its index plus the unit's number."""

    def __init__(self, data: np.ndarray, at: np.ndarray, pieces: Pieces):
        n = len(data)
        unit = owners(at)
        ranges, stop = Ranges(data), at[1:][unit]
        begins, ends, ids = [], [], []
        one = np.zeros(n, bool)  # the character that begins here is a piece
        width = np.select([data < 0x80, data < 0xC0, data < 0xE0, data < 0xF0], [1, 0, 2, 3], 4)
        spot = np.flatnonzero(width > 0)
        live = spot
        for k in range(1, pieces.longest + 1):
            live = live[live + k <= stop[live]]
            if not len(live):
                break
            some, found = pieces.find(ranges.of(live, live + k))
            live = live[some]
            p = live[found >= 0]
            begins.append(p)
            ends.append(p + k)
            ids.append(found[found >= 0])
            one[p[width[p] == k]] = True
        lead = np.flatnonzero(width > 0)
        has = one[lead][np.searchsorted(lead, np.arange(n), "right") - 1] if n else one
        p = np.flatnonzero(~has)
        begins.append(p)
        ends.append(p + 1)
        ids.append(pieces.byte_ids[data[p]])
        begin, end, self.id = (np.concatenate(x).astype(np.int64) for x in (begins, ends, ids))
        row = unit[begin]
        depth = end - at[row]  # filter by distance from the unit's start, all units together
        span = pieces.longest + 1  # sort keys are unique, so that sums don't depend on the block
        order = np.argsort((depth * len(at) + row) * span + (end - begin))
        begin, end, row, depth, self.id = begin[order], end[order], row[order], depth[order], self.id[order]
        self.source, node = begin + row, end + row
        forward = np.full(n + len(at), -np.inf)
        forward[at[:-1] + np.arange(len(at) - 1)] = 0.0
        weight = pieces.weight[self.id]
        step = np.concatenate([np.flatnonzero(np.diff(depth, prepend=-1)), [len(depth)]])
        for a, b in zip(step[:-1], step[1:], strict=True):
            score = forward[self.source[a:b]] + weight[a:b]
            first = np.flatnonzero(np.diff(node[a:b], prepend=-1))
            top = np.maximum.reduceat(score, first)
            size = np.diff(np.append(first, b - a))
            safe = np.where(np.isfinite(top), top, 0.0)
            forward[node[a:b][first]] = safe + np.log(np.add.reduceat(np.exp(score - np.repeat(safe, size)), first))
        order = np.argsort(node * span + (node - self.source))
        node, self.source, self.id = node[order], self.source[order], self.id[order]
        share = np.round(np.exp(forward[self.source] + weight[order] - forward[node]) * ONE).astype(np.int64)
        first = np.flatnonzero(np.diff(node, prepend=-1))
        total = np.cumsum(share)  # whole numbers, so that differences are exact wherever the block begins
        before = np.repeat(np.concatenate([np.zeros(1, np.int64), total[first[1:] - 1]]) if len(first) else total, np.diff(np.append(first, len(node))))
        self.upto = total - before  # cumulative shares of the edges into a node
        self.upto[np.append(first[1:], len(node)) - 1] = 2 * ONE
        self.begin = np.zeros(n + len(at), np.int64)
        self.begin[node[first]] = first
        self.last = at[1:] + np.arange(len(at) - 1)
        self.first = at[:-1] + np.arange(len(at) - 1)


class Units:
    """Filtered units by their bytes, in one lattice that grows from block to block; emptied beyond MOST edges."""

    MOST = 3_000_000
    _KINDS = {"upto": np.int64, "source": np.int32, "id": np.int32, "begin": np.int32, "first": np.int32, "last": np.int32}

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        """Begin anew."""
        self._known: dict[bytes, int] = {}
        self._room = {k: np.zeros(1024, kind) for k, kind in self._KINDS.items()}
        self._used = dict.fromkeys(self._KINDS, 0)

    def _append(self, name: str, values: np.ndarray) -> None:
        have, room = self._used[name], self._room[name]
        if have + len(values) > len(room):
            self._room[name] = np.zeros(max(have + len(values), 2 * len(room)), room.dtype)
            self._room[name][:have] = room[:have]
        self._room[name][have : have + len(values)] = values
        self._used[name] = have + len(values)

    def __getattr__(self, name: str) -> np.ndarray:
        if name in Units._KINDS:
            return self._room[name]
        raise AttributeError(name)

    def of(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the distinct units text[start : start + size]."""
        if self._used["upto"] > self.MOST:
            self.forget()
        raw = text.tobytes()
        unit = [raw[a : a + k] for a, k in zip(start.tolist(), size.tolist(), strict=True)]
        number = np.array([self._known.get(u, -1) for u in unit], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            at = sums(size[new])
            lattice = Lattice(text[np.arange(at[-1]) - np.repeat(at[:-1], size[new]) + np.repeat(start[new], size[new])], at, self.pieces)
            edges, nodes, units = (self._used[k] for k in ("upto", "begin", "first"))
            for name, values in (("upto", lattice.upto), ("source", lattice.source + nodes), ("id", lattice.id), ("begin", lattice.begin + edges), ("first", lattice.first + nodes), ("last", lattice.last + nodes)):
                self._append(name, values)
            number[new] = np.arange(units, units + len(new))
            self._known.update((unit[k], units + i) for i, k in enumerate(new.tolist()))
        return number


def sample(data: np.ndarray, at: np.ndarray, keys: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of every text and where each text's begin (n + 1)."""
    full = np.flatnonzero(np.diff(at))
    text = np.insert(data, at[:-1][full], BLANK)
    grown = at + np.searchsorted(full, np.arange(len(at)))
    cut = (text & 0xC0) != 0x80
    cut[1:] &= ~units.pieces.joined[text[:-1].astype(np.int32) << 8 | text[1:]]
    cut[grown[:-1][full]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(text))
    first, which = Ranges(text).classes(start, end)
    number = units.of(text, start[first], (end - start)[first])[which]

    ptr = np.searchsorted(start, grown)
    row = owners(ptr)
    place = mix(keys.astype(np.uint64)[row] + (np.arange(len(start)) - ptr[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    begin, upto, source, id_ = units.begin, units.upto, units.source, units.id
    active, node, stop = np.arange(len(start)), units.last[number], units.first[number]
    drawn, count, step = [], np.zeros(len(start), np.int64), 0
    while len(active):
        u = (mix(place[active] + np.uint64(step)) >> np.uint64(24)).astype(np.int64)
        edge = begin[node]
        miss = np.flatnonzero(upto[edge] <= u)
        while len(miss):
            edge[miss] += 1
            miss = miss[upto[edge[miss]] <= u[miss]]
        drawn.append((active, id_[edge]))
        count[active] += 1
        node = source[edge]
        more = node > stop
        active, node, stop, step = active[more], node[more], stop[more], step + 1
    where = sums(count)
    out = np.empty(where[-1], np.int32)
    for k, (some, ids) in enumerate(drawn):
        out[where[some + 1] - 1 - k] = ids
    return out, where[ptr]


def decode(ids: np.ndarray, ptr: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every text from its pieces, without the leading blank, and n + 1 offsets."""
    size = np.diff(pieces.at)[ids]
    place = sums(size)
    data = pieces.data[np.arange(place[-1]) - np.repeat(place[:-1], size) + np.repeat(pieces.at[ids], size)]
    at = place[ptr]
    full = np.flatnonzero(np.diff(at))
    keep = np.ones(len(data), bool)
    keep[at[:-1][full]] = False
    return data[keep], at - np.searchsorted(full, np.arange(len(at)))


_loaded: dict[tuple[str, float], Units] = {}


def load(path: str, sharpness: float = 1.0) -> Units:
    """The vocabulary with what this worker has filtered of it; one at a time."""
    if (path, sharpness) not in _loaded:
        _loaded.clear()
        _loaded[path, sharpness] = Units(Pieces(path, sharpness))
    return _loaded[path, sharpness]


def sample_pieces(docs: DataFrame, vocabulary: str, seed: int = 0, sharpness: float = 1.0, id_col: str = "doc_id", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """id_col, pieces (ids of a sampled segmentation), n_pieces and lossless (they decode to the text) of every row.

    vocabulary: path of the model file, as executors see it; sharpness: exponent of the piece weights, which
    fall with the piece's rank; copies_col: how many segmentations a row gets (without it: one), each drawn anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = load(vocabulary, sharpness)
        for block, data, at in text_blocks(batches, "text"):
            ids, ptr = sample(data, at, block.column(1).to_numpy(zero_copy_only=False), units)
            back, back_at = decode(ids, ptr, units.pieces)
            same = np.diff(at) == np.diff(back_at)
            if same.all() and len(back) == len(data):
                wrong = sums(back != data)[at]
                same = np.diff(wrong) == 0
            else:
                same = np.array([np.array_equal(data[at[i] : at[i + 1]], back[back_at[i] : back_at[i + 1]]) for i in range(len(at) - 1)], bool)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(ids)), pa.array(np.diff(ptr)), pa.array(same)], names=["id", "pieces", "n_pieces", "lossless"])
        units.forget()  # an idle worker stays for a while beside those of later stages
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    key = [F.col(id_col), F.lit(seed)]
    if copies_col:
        docs = docs.select(id_col, text_col, F.explode(F.sequence(F.lit(1), F.col(copies_col))).alias(copies_col))
        key.append(F.col(copies_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(*key).alias("key"), F.col(text_col).alias("text"))
    return bounded_batches(rows).mapInArrow(run, f"id {kind}, pieces array<int>, n_pieces long, lossless boolean").withColumnRenamed("id", id_col)


def sample_copies(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """sample_pieces of a table that repeats rows: equal rows are counted, and each of them gets a draw of its own."""
    counted = docs.groupBy(id_col, text_col).agg(F.count(F.lit(1)).alias("copies_"))
    return sample_pieces(counted, vocabulary, id_col=id_col, text_col=text_col, copies_col="copies_", **how)


def decode_pieces(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """id_col and the text that the pieces of every row spell (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(vocabulary).pieces
        for batch in batches:
            lists = [np.array(x.as_py() or [], np.int64) for x in batch.column(1)]
            data, at = decode(np.concatenate([np.zeros(0, np.int64), *lists]), sums(np.array([len(x) for x in lists], np.int64)), pieces)
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(pieces_col).cast("array<int>").alias("pieces")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
