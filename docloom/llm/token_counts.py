"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is compiled into two transducers. The first reads character classes, has nine
states and emits the boundaries of pre-tokens; it is total and deterministic, so a chunk of text is a map from
states to states, and such maps compose. All chunks of a block run at once from every state, a parallel prefix
scan composes their maps, and a last run from the then known states emits the boundaries. The second is
compiled lazily: its accepting transitions, keyed by the pre-token's fingerprint, are annotated with the number
of tokens that the merges leave.

Nulls and edge cases: a null text counts as empty (0 bytes, 0 tokens); very long texts are one block each;
repeated rows are counted row by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_blocks
from .rolling import Ranges, owners, sums

# Character classes; the pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, NUMBER, BLANK, WHITE, OTHER, QUOTE, STMD, RV, E, LL, RESET = range(11)
_LETTERS = (LETTER, STMD, RV, E, LL)
# States: fresh, in letters, in numbers, in others, after a blank, after an opening quote, after 'r or 'v, after 'l, after a contraction.
FRESH, IN_L, IN_N, IN_O, PREFIX, QUOTED, QUOTED_RV, QUOTED_L, CLOSED = range(9)
N_STATES = 9
CHUNK = 128


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts at the character, by class * 16 + state."""
    go, start = np.zeros(256, np.uint8), np.zeros(256, bool)
    for s in range(N_STATES):
        for c in range(11):
            if c in (RESET, WHITE):
                to = FRESH
            elif c == BLANK:
                to = PREFIX
            elif s == QUOTED and c in (STMD, RV, LL):
                to = {STMD: CLOSED, RV: QUOTED_RV, LL: QUOTED_L}[c]
            elif (s, c) in ((QUOTED_RV, E), (QUOTED_L, LL)):
                to = CLOSED
            elif c in _LETTERS:
                to = IN_L
            elif c == NUMBER:
                to = IN_N
            elif c == QUOTE:
                to = IN_O if s in (IN_O, PREFIX, QUOTED) else QUOTED
            else:
                to = IN_O
            go[c * 16 + s] = to
            same = {IN_L: (IN_L,), IN_N: (IN_N,), IN_O: (IN_O,), PREFIX: (IN_L, IN_N, IN_O), QUOTED: (IN_O, CLOSED, QUOTED_RV, QUOTED_L), QUOTED_RV: (IN_L, CLOSED), QUOTED_L: (IN_L, CLOSED)}
            start[c * 16 + s] = to not in same.get(s, ())
    return go, start


_GO, _START = _compile()
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
            for m in regex.finditer(name, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                table[a : b + 1] = kind
        table[0xD800:0xE000] = OTHER
        for chars, kind in ((" ", BLANK), ("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", LL)):
            table[[ord(c) for c in chars]] = kind
        _classes = table
    return _classes


def run_states(classes: np.ndarray) -> np.ndarray:
    """The state before each character (starting fresh): chunk maps, their prefix scan, then one run."""
    n = len(classes)
    rows = max(1, -(-n // CHUNK))
    grid = np.full(rows * CHUNK, RESET, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray((grid << 4).reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8)[:, None], (1, rows))
    for column in grid:
        maps = _GO[maps | column]
    step = 1
    while step < rows:  # maps[:, i] becomes the map of all chunks up to i
        maps = np.hstack([maps[:, :step], np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), 0)])
        step *= 2
    state = np.concatenate([[FRESH], maps[FRESH, :-1]]).astype(np.uint8)
    before = np.empty((CHUNK, rows), np.uint8)
    for k, column in enumerate(grid):
        before[k] = state
        state = _GO[state | column]
    return before.T.reshape(-1)[:n]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[at].astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    wide = np.flatnonzero(cp >= 0xC0)
    w, b = at[wide], cp[wide]
    c1, c2, c3 = (padded[w + k] & 0x3F for k in (1, 2, 3))
    cp[wide] = np.where(b < 0xE0, (b & 0x1F) << 6 | c1, np.where(b < 0xF0, (b & 0x0F) << 12 | c1 << 6 | c2, (b & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
    return cp, at


def pretoken_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions where the pre-tokens of the segments at[i]:at[i + 1] start."""
    cp, where = code_points(data)
    bounds = np.searchsorted(where, at[:-1][at[:-1] < at[1:]])  # a reset goes before each of these
    classes = np.insert(_class_table()[cp], bounds, RESET)
    where = np.insert(where, bounds, -1)
    before = run_states(classes)
    start = _START[(classes << 4) | before]
    after = np.append(classes[1:], RESET)
    white = (classes == BLANK) | (classes == WHITE)
    solid_next = (after != BLANK) & (after != WHITE) & (after != RESET)
    white_before = np.concatenate([[False], white[:-1]])
    start[white] = (~white_before | solid_next)[white]  # the first of a run, and its last if the text goes on
    state = _GO[(classes << 4) | before]
    closed_next = np.append(state[1:] == CLOSED, False)
    pending = (state == QUOTED_RV) | (state == QUOTED_L)
    start[pending] = ~closed_next[pending]
    return where[start & (classes != RESET)]


class Lexicon:
    """The lazily compiled transducer from pre-tokens to numbers of tokens."""

    #: Pre-tokens whose counts are kept, and their bytes at most.
    MOST, LONGEST = 1_000_000, 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.width = max(vocab.values()) + 1
        keys, into = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] * self.width + vocab[b])
            into.append(vocab[a + b])
        order = np.argsort(keys)
        self.keys, self.rank, self.into = np.array(keys, np.int64)[order], order.astype(np.int64), np.array(into, np.int64)
        self.none = len(keys)
        self.special = [t["content"].encode() for t in spec["added_tokens"] if t["special"]]
        self.known: dict[bytes, int] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.rank[i], self.none)

    def _merge_rows(self, tokens: np.ndarray) -> np.ndarray:
        """Lengths after all merges; rows are padded with -1."""
        left = (tokens >= 0).sum(1)
        live = np.arange(len(tokens))
        spot = np.arange(tokens.shape[1])
        while len(live) and tokens.shape[1] > 1:
            rank = self._ranks(tokens[:, :-1], tokens[:, 1:])
            j = rank.argmin(1)
            best = np.take_along_axis(rank, j[:, None], 1)[:, 0]
            go = best < self.none
            live, tokens, j, best = live[go], tokens[go], j[go], best[go]
            if not len(live):
                break
            left[live] -= 1
            source = np.minimum(spot + (spot > j[:, None]), len(spot) - 1)
            last = tokens.shape[1] - 1
            tokens = np.take_along_axis(tokens, source, 1)
            tokens[:, last] = -1
            np.put_along_axis(tokens, j[:, None], self.into[best][:, None], 1)
            spot = spot[: max(1, int(left[live].max()))]
            tokens = tokens[:, : len(spot)]
        return left

    def _merge_long(self, tokens: np.ndarray) -> int:
        """The same for one long pre-token: a queue of pairs over linked neighbours."""
        t, n = tokens.tolist(), len(tokens)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        ranks = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True)) if not hasattr(self, "_dict") else self._dict
        self._dict = ranks
        queue = [(r, i, t[i], t[i + 1]) for i in range(n - 1) if (r := ranks.get(t[i] * self.width + t[i + 1])) is not None]
        heapq.heapify(queue)
        left = n
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or t[i] != a or t[j] != b:
                continue
            t[i], alive[j], after[i] = int(self.into[r]), False, after[j]
            left -= 1
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := ranks.get(t[x] * self.width + t[y])) is not None:
                    heapq.heappush(queue, (k, x, t[x], t[y]))
        return left

    def _compile(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        out = length.copy()
        low = 1
        while low <= 64:
            some = np.flatnonzero((length > low) & (length <= 2 * low))
            for part in np.array_split(some, max(1, len(some) * 2 * low // 400_000)):
                if len(part):
                    spot = start[part][:, None] + np.arange(2 * low)
                    tokens = np.where(spot < end[part][:, None], self.byte[data[np.minimum(spot, len(data) - 1)]], -1)
                    out[part] = self._merge_rows(tokens)
            low *= 2
        for k in np.flatnonzero(length > 128):
            out[k] = self._merge_long(self.byte[data[start[k] : end[k]]])
        return out

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        first, which = Ranges(data).classes(start, end)
        if len(self.known) > self.MOST:
            self.known = {}
        raw = data.tobytes()
        unit = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        counts = np.array([self.known.get(u, -1) for u in unit], np.int64)
        new = np.flatnonzero(counts < 0)
        counts[new] = self._compile(data, start[first[new]], end[first[new]])
        self.known.update((unit[k], n) for k, n in zip(new.tolist(), counts[new].tolist(), strict=True) if len(unit[k]) <= self.LONGEST)
        return counts[which]


def _cut_specials(data: np.ndarray, at: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments between special strings: bounds, their rows and whether each is such a string (leftmost first, longest first)."""
    raw = data.tobytes()
    if not any(s in raw for s in special):
        return at, np.arange(len(at) - 1), np.zeros(len(at) - 1, bool)
    import re

    pattern = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    bounds, rows, marked = [0], [], []
    for row in range(len(at) - 1):
        here = int(at[row])
        for m in [*pattern.finditer(raw, int(at[row]), int(at[row + 1])), None]:
            stop = m.start() if m else int(at[row + 1])
            bounds.append(stop)
            rows.append(row)
            marked.append(False)
            if m:
                bounds.append(m.end())
                rows.append(row)
                marked.append(True)
                here = m.end()
    return np.array(bounds), np.array(rows), np.array(marked)


_lexicons: dict[str, Lexicon] = {}


def count_tokens(data: np.ndarray, at: np.ndarray, path: str) -> np.ndarray:
    """Tokens of every text of a block."""
    if path not in _lexicons:
        _lexicons[path] = Lexicon(path)
    lexicon = _lexicons[path]
    bounds, rows, marked = _cut_specials(data, at, lexicon.special)
    start = pretoken_starts(data, bounds)
    if not len(start):
        return np.bincount(rows[marked], minlength=len(at) - 1)
    end = np.append(start[1:], len(data))
    segment = np.searchsorted(bounds, start, "right") - 1
    end = np.minimum(end, bounds[segment + 1])
    plain = ~marked[segment]
    start, end, row = start[plain], end[plain], rows[segment[plain]]
    n = np.bincount(rows[marked], minlength=len(at) - 1)
    return n + np.bincount(row, lexicon.count(data, start, end), len(at) - 1).astype(np.int64) if len(start) else n


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text; vocabulary: path of the tokenizer's JSON file, as executors see it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches, "text"):
            n = count_tokens(data, at, vocabulary)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(at)), pa.array(n.astype(np.int64)), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
