"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long hash string, the sides of random hyperplanes it lies on, and keeps the strings
sorted. A query descends each tree to the longest prefix that it shares with a string there; then all trees
ascend together, one bit at a time, and the ranges of equal prefixes hold the candidates. What a range adds is
scored, first when the ranges hold FIRST entries, then at each doubling, and the ascent ends when hardly any of
the k best has changed, or with MOST of the shard's entries: where vectors lie in clusters a small part is
scored, where they lie anywhere much more is. Hyperplanes separate by angle, so vectors of unequal norms get one
more component that makes them equal, and the inner product becomes an angle.

The index is cut into shards of bounded size, each with a forest of its own, and the stated queries visit all
shards in blocks, so every vector is indexed. Of exactly equal vectors only the k + 1 with the smallest ids
are indexed: no result can name more of them.

Nulls and edge cases: vectors that are null, zero, or hold null or non-finite components take no part, neither
do rows with a null id; a row that repeats with its id is one candidate, and of an id with different vectors
the least vector counts; vectors are compared with those of their own length only; a query without candidates
has no rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

SHARD_ROWS, QUERY_ROWS = 8_192, 2_048
#: Trees and bits of a string.
TREES, BITS = 64, 24
#: Entries (with repetitions over trees) at which candidates are scored first; share of the shard's rows, and
#: multiple of k, that end the ascent; share of the k best that may still change when it ends earlier.
FIRST, MOST, LEAST, CHANGED = 64, 0.45, 64, 0.1


class Forest:
    """Sorted hash strings of the rows of x in every tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 1):
        self.bits, self.trees = bits, trees
        norm = np.sqrt((x * x).sum(1))
        self.top = float(norm.max(initial=0.0)) or 1.0
        x = x / self.top
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * bits))
        labels = self.labels(np.hstack([x, np.sqrt(np.maximum(0, 1 - (norm / self.top) ** 2))[:, None]]))
        self.order = np.argsort(labels, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(labels, self.order, 1)
        self.x = x.astype(np.float32)  # for the first scores; those near the k-th are scored again exactly

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Hash strings by tree and row, the first bit the highest."""
        out = np.zeros((self.trees, len(x)), np.int64)
        for part in range(0, len(x), 1024):
            side = (x[part : part + 1024] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            for b in range(self.bits):
                out[:, part : part + 1024] = out[:, part : part + 1024] << 1 | side[:, :, b].T
        return out

    def _deepest(self, labels: np.ndarray) -> np.ndarray:
        """The length of the longest prefix that each query shares with a string of any tree."""
        out = np.zeros(labels.shape[1], np.int64)
        for own, text in zip(self.sorted, labels, strict=True):
            i = np.searchsorted(own, text)
            for j in (np.maximum(i - 1, 0), np.minimum(i, len(own) - 1)):
                out = np.maximum(out, self.bits - np.frexp((own[j] ^ text).astype(float))[1])
        return out

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, row) that hold each query's k best candidates and ties, and how many rows each query scored."""
        n, m = len(self.x), len(queries)
        unit = queries / np.abs(queries).max(1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        labels, flat = self.labels(np.hstack([unit, np.zeros((m, 1))])), unit.astype(np.float32)
        slack = 2 * (queries.shape[1] + 4) * 2.0**-23
        most, spare = max(LEAST * k, int(MOST * n)), int(CHANGED * k)
        deepest, target = self._deepest(labels), np.full(m, FIRST)
        low, high, seen = np.zeros(labels.shape, np.int32), np.zeros(labels.shape, np.int32), np.zeros((m, n), bool)
        rows, scores = [np.zeros(0, np.int64)] * m, [np.zeros(0, np.float32)] * m
        live = np.arange(m)
        for depth in range(int(deepest.max(initial=0)), -1, -1):
            now = live[deepest[live] >= depth]
            begin, end = np.empty((self.trees, len(now)), np.int32), np.empty((self.trees, len(now)), np.int32)
            shift = self.bits - depth
            for t, own in enumerate(self.sorted):
                prefix = labels[t, now] >> shift << shift
                begin[t], end[t] = np.searchsorted(own, prefix), np.searchsorted(own, prefix + (1 << shift))
            held = (end - begin).sum(0)
            ready = (held >= target[now]) | (depth == 0)
            q, begin, end, held = now[ready], begin[:, ready], end[:, ready], held[ready]
            if not len(q):
                continue
            fresh = np.zeros((len(q), n), bool)
            for t, order in enumerate(self.order):  # what the ranges hold on both sides of what they held before
                empty = low[t, q] == high[t, q]
                for a, b in ((begin[t], np.where(empty, end[t], low[t, q])), (np.where(empty, end[t], high[t, q]), end[t])):
                    some = np.repeat(np.arange(len(q)), b - a)
                    at = np.arange(len(some)) + np.repeat(a - np.cumsum(b - a) + (b - a), b - a)
                    fresh[some, order[at]] = True
            low[:, q], high[:, q] = begin, end
            fresh &= ~seen[q]
            seen[q] |= fresh
            stop = (held >= most) | (depth == 0)
            for i, one in enumerate(q.tolist()):
                new = np.flatnonzero(fresh[i])
                s = self.x[new] @ flat[one]
                if len(scores[one]) >= k:
                    better = s >= np.partition(scores[one], len(scores[one]) - k)[len(scores[one]) - k] - slack
                    new, s = new[better], s[better]
                    stop[i] |= len(new) <= spare
                new, s = np.concatenate([rows[one], new]), np.concatenate([scores[one], s])
                if len(s) > k:
                    near = s >= np.partition(s, len(s) - k)[len(s) - k] - slack
                    new, s = new[near], s[near]
                rows[one], scores[one] = new, s
            target[q] = 2 * held
            live = np.setdiff1d(live, q[stop], assume_unique=True)
        return np.repeat(np.arange(m), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows]), seen.sum(1)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the neighbour's id, score (inner product) of the k nearest found of every query row, and n_scored, the candidates that the query scored."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    rows = store(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("d", F.size("v")), "vectors")
    # Of equal vectors the smallest ids; the ranking is cut before the shuffle too.
    indexed = rows.select("id", "v", "d").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    indexed = store(indexed.select("id", "v", "d"), "indexed")
    queries = rows.filter("q").select("id", "v", "d")
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    # One row a vector length: its number of shards.
    sizes = indexed.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ids = _matrix(right.column("v")), right.column("id").to_numpy()
        q, query_ids = _matrix(left.column("v")), left.column("id").to_numpy()
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        if len(x) and len(q):
            a, b, scored = Forest(x).nearest(q, k + 1)
            other = query_ids[a] != ids[b]
            a, b = a[other], b[other]
            score = np.empty(len(a))
            for i in range(0, len(a), 16_384):  # the same order of additions for every pair
                score[i : i + 16_384] = (q[a[i : i + 16_384]] * x[b[i : i + 16_384]]).sum(1)
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            best = place < k
            out = [query_ids[a[best]], ids[b[best]], score[best], np.where(place == 0, scored[a], 0)[best]]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "neighbour": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64()), "scored": pa.array(out[3], pa.int64())})

    block = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(blocks)).cast("int")
    shard = F.pmod(F.xxhash64("id", F.lit(23)), F.col("shards")).cast("int")
    to_all_shards = queries.join(sizes, "d").select("id", "v", "d", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    to_all_blocks = indexed.join(sizes, "d").select("id", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), shard.alias("shard"))
    found = to_all_shards.groupBy("d", "shard", "block").cogroup(to_all_blocks.groupBy("d", "shard", "block")).applyInArrow(search, "query_id long, neighbour long, score double, scored long")
    of = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "neighbour"))).withColumn("n_scored", F.sum("scored").over(of))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("neighbour").alias(id_col), "score", "n_scored")
