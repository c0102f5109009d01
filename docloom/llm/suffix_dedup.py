"""Removal of long repeated byte strings by difference-cover blockwise suffix sorting.

Two equal strings of min_length bytes hold, at one shift below the period v, two suffixes that both start at
positions of a difference cover modulo v. So

1. the cover-sample suffixes alone (8 of each 57 positions) are sorted first, by the fingerprint of a prefix of
   about half of min_length: equal prefixes tie, whatever their alignment;
2. a suffix enters a bucket only if, for one residue of the cover, all samples of that residue tie that lie in its
   first min_length bytes: equal strings meet at the same residues all along, others differ somewhere;
3. the buckets are sorted one at a time, by the fingerprint of min_length bytes; ties are repeated strings.

What the removal needs of the order of suffixes is which of them tie, so fingerprints are sorted instead of
bytes. Those of step 3 are a polynomial of the bytes modulo 2^61 - 1 and 16 bits of a second one: two different
strings of 400 bytes agree in both for less than one of 2^66 choices of the points, whatever their structure.
Those of step 1 only rule suffixes out and have 32 bits besides the bucket number.

Texts are packed into chunks, and a chunk sends each bucket its distinct fingerprints only: a string that is
frequent in the corpus costs a bucket at most one entry a chunk. Buckets answer with one bit an entry, in the
order sent, and chunks recompute their fingerprints to read the answer. Of texts that are equal as a whole (by
128-bit digests) only the first takes part; its copies share its fate.

The samples also tell which shorter passages a text shares with others: every string of half of min_length that
another text holds too covers a tied sample.

Nulls and edge cases: a null text counts as empty; texts below min_length bytes stay whole; rows that repeat
are copies of each other; an empty table gives an empty result; further columns are ignored. A character that
is cut stays as its remaining bytes, as kept_sha256 is over bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import bounded_batches, release_memory, store, text_blocks
from .rolling import Ranges, sums

#: Difference covers: every residue modulo the period is a difference of two members. Fixed values.
COVERS = {
    1: [0],
    3: [0, 1],
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    31: [1, 5, 11, 24, 25, 27],
    57: [0, 1, 6, 15, 22, 26, 45, 55],
    183: [0, 12, 19, 20, 22, 43, 60, 71, 76, 85, 89, 115, 121, 168],
}
SAMPLES, TEXTS, SUFFIXES = 0, 1, 2


def cover_period(min_length: int) -> int:
    """The largest period that leaves samples long prefixes below half of min_length."""
    return max(v for v in COVERS if v <= max(1, min_length // 7))


def sample_depth(min_length: int) -> int:
    """Bytes of a sample's prefix: every repeated string of half of min_length holds one that ties."""
    return max(1, min_length // 2 - cover_period(min_length) + 1)


def _sorted(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal fingerprints side by side, and which of them begin a run of equal ones."""
    order = np.argsort(first)
    new = np.ones(len(order), bool)
    new[1:] = first[order][1:] != first[order][:-1]
    if second is not None:
        other = second[order][1:] != second[order][:-1]
        if (other & ~new[1:]).any():  # equal in the first part only
            order = np.lexsort((second, first))
            new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    return order, new


class Sent:
    """Distinct fingerprints by bucket: what a chunk sends, in this order, and which entry each fingerprint is."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None, n_buckets: int):
        order, new = _sorted(first, second)
        at = np.flatnonzero(new)
        bucket = ((first if second is None else second >> np.uint64(16))[order[at]] % np.uint64(n_buckets)).astype(np.uint16 if n_buckets <= 65_536 else np.int64)
        turn = np.argsort(bucket, kind="stable")
        place = np.empty(len(at), np.int64)
        place[turn] = np.arange(len(at))
        self.which = np.empty(len(order), np.int64)
        self.which[order] = place[np.cumsum(new) - 1]
        self.first, self.second = first[order[at]][turn], None if second is None else second[order[at]][turn]
        self.ptr = np.searchsorted(bucket[turn], np.arange(n_buckets + 1))
        self.count = np.diff(np.append(at, len(order)))[turn]

    def rows(self, chunk: int, kind: int) -> pa.RecordBatch:
        """A row for each bucket that gets something."""
        full = np.flatnonzero(np.diff(self.ptr))
        prints = (self.first >> np.uint64(32)).astype(np.uint32) if kind == SAMPLES else self.first
        more = {SAMPLES: lambda: np.zeros(0, np.uint8), TEXTS: lambda: self.second, SUFFIXES: lambda: self.second.astype(np.uint16)}[kind]()
        cut = lambda x: pa.array([x[self.ptr[b] : self.ptr[b + 1]].tobytes() for b in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk)), cut(prints), cut(more)], names=["kind", "bucket", "chunk", "prints", "more"])

    def answers(self, replies: list[dict], kind: int) -> np.ndarray:
        """The answers of all buckets, by entry."""
        out = np.zeros(len(self.first), np.uint8)
        for r in replies:
            if r["kind"] == kind:
                a, b = self.ptr[r["bucket"]], self.ptr[r["bucket"] + 1]
                bits = np.frombuffer(r["answer"], np.uint8)
                out[a:b] = bits[: b - a] if kind == TEXTS else np.unpackbits(bits)[: b - a]
        return out


class Chunk:
    """Fingerprints of the texts of one chunk."""

    def __init__(self, blob: bytes, lengths: np.ndarray, min_length: int):
        self.data = np.frombuffer(zstandard.decompress(blob, int(lengths.sum()) or 1) if len(lengths) and lengths.sum() else b"", np.uint8)
        self.at, self.min_length = sums(lengths), min_length
        self.period, self.depth = cover_period(min_length), sample_depth(min_length)
        self.ranges = Ranges(self.data)
        v, cover = self.period, np.array(sorted(COVERS[self.period]), np.int64)
        whole = np.maximum(0, lengths - self.depth + 1)  # start positions of each text
        rounds = -(-whole // v)
        text = np.repeat(np.arange(len(lengths), dtype=np.int32), rounds)
        turn = np.arange(len(text)) - np.repeat(sums(rounds)[:-1], rounds)
        local = (turn[:, None] * v + cover).reshape(-1)
        text, residue = np.repeat(text, len(cover)), np.tile(np.arange(len(cover), dtype=np.int8), len(turn))
        ok = local < whole[text]
        #: Text, residue and position of each cover sample, by position.
        self.text, self.residue = text[ok], residue[ok]
        self.position = local[ok] + self.at[:-1][self.text]

    def samples(self, n_buckets: int) -> Sent:
        return Sent(self.ranges.of(self.position, self.position + self.depth), None, n_buckets)

    def digests(self, n_buckets: int) -> Sent:
        raw = b"".join(hashlib.blake2b(self.data[a:b].tobytes(), digest_size=16).digest() for a, b in zip(self.at[:-1], self.at[1:], strict=True))
        both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        return Sent(both[:, 0], both[:, 1], n_buckets)

    def candidates(self, tied: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """Positions whose first min_length bytes hold only tied samples of some residue, in texts that aren't skipped."""
        window, n = self.min_length - self.depth, np.diff(self.at)
        fit = np.flatnonzero(~skipped & (n >= self.min_length))
        classes = len(COVERS[self.period])
        loose = ~tied & ~skipped[self.text] & (n[self.text] >= self.min_length)
        # What ends a run of tied samples of a residue: the text's beginning, an untied sample, the last sample's place.
        stops = np.concatenate([self.position[loose], *([self.at[fit] - 1, self.at[fit + 1] - self.depth + 1] * classes)])
        residue = np.concatenate([self.residue[loose], np.repeat(np.arange(classes, dtype=np.int8), 2 * len(fit))])
        text = np.concatenate([self.text[loose], np.tile(fit, 2 * classes)])
        order = np.argsort((residue.astype(np.int64) * len(n) + text) * (len(self.data) + 2) + stops + 1)
        stops, text, residue = stops[order], text[order], residue[order]
        wide = np.flatnonzero((np.diff(stops) > window + 1) & (np.diff(text) == 0) & (np.diff(residue) == 0))
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, stops[wide] + 1, 1)
        np.add.at(step, stops[wide + 1] - window, -1)
        return np.flatnonzero(np.cumsum(step[:-1]) > 0)

    def suffixes(self, p: np.ndarray, n_buckets: int) -> Sent:
        """The fingerprints of min_length bytes from the positions p."""
        if not hasattr(self, "_other"):
            self._other = Ranges(self.data[::-1])  # read backwards: another polynomial of the same bytes
        n = len(self.data)
        return Sent(self.ranges.of(p, p + self.min_length), self._other.of(n - p - self.min_length, n - p), n_buckets)


def pack(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """chunk, ids, lengths and blob (compressed texts) of chunks of about chunk_bytes; a longer text is its own chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b, _, _ in held])
            lengths = np.concatenate([np.diff(a) for _, _, a in held])
            blob = zstandard.ZstdCompressor(level=3).compress(np.concatenate([d for _, d, _ in held]).tobytes())
            ends = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, pa.array(lengths)), pa.array([blob], pa.binary())], names=["chunk", "ids", "lengths", "blob"])

        for block in text_blocks(batches, "text", chunk_bytes):
            if held and size + len(block[1]) > chunk_bytes:
                yield flush()
                n, held, size = n + 1, [], 0
            held.append(block)
            size += len(block[1])
        if held:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"chunk long, ids array<{kind}>, lengths array<long>, blob binary")


_SENT = "kind int, bucket int, chunk long, prints binary, more binary"
_REPLY = "chunk long, kind int, bucket int, answer binary"
_KINDS = {SAMPLES: (np.uint32, None), TEXTS: (np.uint64, np.uint64), SUFFIXES: (np.uint64, np.uint16)}


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Sort one bucket; the answer of each entry: 1 if another chunk has an equal one (texts: 1 for the first chunk, 2 for others)."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    chunks = table.column("chunk").to_numpy()
    read = lambda name, dtype: [np.frombuffer(x.as_buffer(), dtype) for c in table.column(name).chunks for x in c]
    parts = read("prints", _KINDS[kind][0])
    value, ends = np.concatenate(parts), sums(np.array([len(x) for x in parts]))
    order, new = _sorted(value, None if _KINDS[kind][1] is None else np.concatenate(read("more", _KINDS[kind][1])))
    same = ~new[1:]
    mask = np.zeros(len(value), np.uint8)
    mask[order[1:][same]] = 1
    mask[order[:-1][same]] = 1
    if kind == TEXTS:  # in each run of equal entries all but one of the least chunk
        run = np.cumsum(new) - 1
        chunk = np.repeat(chunks, np.diff(ends))[order]
        least = np.minimum.reduceat(chunk, np.flatnonzero(new))
        mask[order[(chunk != least[run]) & (mask[order] > 0)]] = 2
    out = [(x if kind == TEXTS else np.packbits(x)).tobytes() for x in (mask[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
    release_memory()
    return pa.table({"chunk": pa.array(chunks), "kind": pa.array(np.full(len(parts), kind, np.int32)), "bucket": pa.array(np.full(len(parts), bucket, np.int32)), "answer": pa.array(out, pa.binary())})


def _replies(sent: DataFrame, name: str) -> DataFrame:
    """All answers to each chunk, as one row."""
    answers = sent.groupBy("kind", "bucket").applyInArrow(_sort_bucket, _REPLY)
    return store(answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "answer")).alias(name)), name)


def remove_repeats(docs: DataFrame, min_length: int = 400, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 2 << 20, bucket_samples: int = 1_000_000, bucket_bytes: int = 2_000_000) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept_sha256 of every text after the removal of each byte that a
    string of min_length bytes covers which also starts elsewhere; n_shared, the bytes that tied samples of other
    texts cover, longest_shared, the longest run of them, and shares_passage: it has half of min_length bytes.

    A passage of half of min_length bytes or more that another text holds too is in n_shared but for less than a
    period at either end. chunk_bytes, bucket_samples and bucket_bytes bound what a task holds: a chunk of text,
    the cover samples of a bucket, and the suffixes of a bucket if all text were repeated.
    """
    chunks = store(pack(docs, id_col, text_col, chunk_bytes), "chunks")
    total = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).collect()[0][0] or 0
    period = cover_period(min_length)
    n_samples = max(8, -(-total * len(COVERS[period]) // period // bucket_samples))
    n_suffixes = max(8, -(-total // bucket_bytes))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, dict, pa.Array]]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield row["chunk"], Chunk(row["blob"], np.array(row["lengths"], np.int64), min_length), row, batch.column(batch.schema.get_field_index("ids"))[k].values if "ids" in batch.schema.names else None
        release_memory()

    def send_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, _, _ in opened(batches):
            yield chunk.samples(n_samples).rows(number, SAMPLES)
            yield chunk.digests(n_samples).rows(number, TEXTS)

    def known(chunk: Chunk, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Copied texts, samples that tie at all and with other texts, and the positions to sort."""
        sent = chunk.samples(n_samples)
        elsewhere = sent.answers(row["samples"], SAMPLES) > 0
        tied = ((sent.count > 1) | elsewhere)[sent.which]
        # Entries of several texts of this chunk: the first and last text that have them differ.
        low, high = np.full(len(sent.first), len(chunk.at)), np.full(len(sent.first), -1)
        low[sent.which[::-1]] = chunk.text[::-1]
        high[sent.which] = chunk.text
        shared = (elsewhere | (low != high))[sent.which]
        sent = chunk.digests(n_samples)
        answer = sent.answers(row["samples"], TEXTS)
        copied = ((sent.count > 1) | (answer > 0))[sent.which]
        skipped = np.ones(len(sent.which), bool)
        skipped[np.unique(sent.which, return_index=True)[1]] = False
        skipped |= (answer == 2)[sent.which]
        return copied, tied, shared, chunk.candidates(tied, skipped)

    def send_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, row, _ in opened(batches):
            yield chunk.suffixes(known(chunk, row)[3], n_suffixes).rows(number, SUFFIXES)

    def covered(chunk: Chunk, start: np.ndarray, length: int) -> np.ndarray:
        step = np.zeros(len(chunk.data) + 1, np.int32)
        np.add.at(step, start, 1)
        np.add.at(step, start + length, -1)
        return np.cumsum(step[:-1]) > 0

    def runs(chunk: Chunk, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes inside, none beyond its text."""
        begin = chunk.at[:-1][np.diff(chunk.at) > 0]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[begin], last[np.append(begin[1:], len(inside))[: len(begin)] - 1] = inside[begin], inside[np.append(begin[1:], len(inside))[: len(begin)] - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, row, ids in opened(batches):
            copied, _, shared, p = known(chunk, row)
            sent = chunk.suffixes(p, n_suffixes)
            again = (sent.count > 1) | (sent.answers(row["suffixes"] or [], SUFFIXES) > 0)
            gone = covered(chunk, p[again[sent.which]], min_length)
            n = np.diff(chunk.at)
            for i in np.flatnonzero(copied & (n >= min_length)):
                gone[chunk.at[i] : chunk.at[i + 1]] = True
            spans = np.searchsorted(runs(chunk, gone)[0], chunk.at)
            common = covered(chunk, chunk.position[shared], chunk.depth)
            start, end = runs(chunk, common)
            longest = np.zeros(len(n), np.int64)
            np.maximum.at(longest, np.searchsorted(chunk.at, start, "right") - 1, end - start)
            kept = [hashlib.sha256(chunk.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(chunk.at[:-1], chunk.at[1:], strict=True)]
            counts = [pa.array(x) for x in (n, np.diff(sums(gone)[chunk.at]), np.diff(spans))]
            yield pa.RecordBatch.from_arrays([ids, *counts, pa.array(kept), pa.array(np.diff(sums(common)[chunk.at])), pa.array(longest)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "longest_shared"])

    samples = _replies(chunks.select("chunk", "lengths", "blob").mapInArrow(send_samples, _SENT), "samples")
    asked = chunks.select("chunk", "lengths", "blob").join(samples, "chunk")
    suffixes = _replies(asked.mapInArrow(send_suffixes, _SENT), "suffixes")
    known_all = samples.join(suffixes, "chunk", "left")
    element = chunks.schema["ids"].dataType
    kind = (element.elementType if isinstance(element, ArrayType) else element).simpleString()
    out = chunks.join(known_all, "chunk").mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, longest_shared long")
    return out.withColumn("shares_passage", F.col("longest_shared") >= min_length // 2).withColumnRenamed("id", id_col)
