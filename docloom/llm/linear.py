"""Linear classifiers over hashed words: features in tasks, fitting on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, store, text_blocks
from .rolling import LOWER, Ranges, mix, owners, word_spans

BITS = 20
#: Beginnings of longer words that count as features, in bytes; a feature needs this chi-square.
PREFIXES, MIN_SCORE = (5, 8), 20.0
_BLANK = np.full(256, 0x20, np.uint8)  # everything but letters and characters outside ASCII separates
_BLANK[0x61:0x7B] = np.arange(0x61, 0x7B)
_BLANK[0x41:0x5B] = np.arange(0x61, 0x7B)
_BLANK[0x80:] = np.arange(0x80, 0x100)
_BLANK[0x30:0x3A] = np.arange(0x30, 0x3A)


def word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct hashed word and word beginning of every text, by row."""
    plain = _BLANK[LOWER[data]]
    start, end, ptr = word_spans(plain, at)
    ranges, row = Ranges(plain), owners(ptr).astype(np.uint64)
    hashes, rows = [ranges.of(start, end)], [row]
    for k in PREFIXES:
        long = end - start > k
        hashes.append(mix(ranges.of(start[long], start[long] + k) + np.uint64(k)))
        rows.append(row[long])
    key = np.unique((np.concatenate(rows) << np.uint64(BITS)) | (np.concatenate(hashes) >> np.uint64(64 - BITS)))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64(2**BITS - 1)).astype(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, targets: list[str], max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, buckets and the integer columns targets of at most max_rows labelled rows, chosen by a hash of the id.

    labels holds id_col and targets; rows with a null among them take no part. The sample is small by its
    bound, so it is broadcast to the documents. Of documents that share an id the one with the least buckets
    counts, and of labels that share an id the least.
    """
    chosen = labels.select(id_col, *targets).dropna().groupBy(id_col).agg(F.min(F.struct(*targets)).alias("least_")).select(id_col, "least_.*").orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text_")).join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("id"), F.col("text_").alias("text"), *(F.col(c).cast("int").alias(f"y{k}") for k, c in enumerate(targets)))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches, "text"):
            row, bucket = word_features(data, at)
            ends = np.searchsorted(row, np.arange(len(at))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column(0), *(block.column(2 + k) for k in range(len(targets))), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], names=["id", *(f"y{k}" for k in range(len(targets))), "buckets"])

    seen = bounded_batches(rows).mapInArrow(run, f"id {kind}, {', '.join(f'y{k} int' for k in range(len(targets)))}, buckets array<int>")
    ys = [f"y{k}" for k in range(len(targets))]
    return store(seen.groupBy("id").agg(F.min(F.struct("buckets", *ys)).alias("least")).select("id", *(f"least.{c}" for c in (*ys, "buckets"))), "training")


def select_buckets(rows: DataFrame, target: str, n_classes: int, most: int) -> np.ndarray:
    """The buckets that depend most on the class (chi-square of presence against each class), at most most of them."""
    sizes = dict(rows.groupBy(target).count().collect())
    n = sum(sizes.values())
    seen = rows.select(target, F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), *(F.sum((F.col(target) == k).cast("long")).alias(f"c{k}") for k in range(n_classes)))
    score = F.lit(0.0)
    for k in range(n_classes):
        nk = sizes.get(k, 0)
        if 0 < nk < n:
            score = F.greatest(score, F.pow(F.col(f"c{k}") * float(n) - F.col("df") * float(nk), 2) * n / (F.col("df") * (n - F.col("df") + 1) * float(nk) * (n - nk)))
    top = seen.filter("df >= 2").withColumn("score", score).filter(F.col("score") >= MIN_SCORE).orderBy(F.desc("score"), "bucket").limit(most).select("bucket").collect()
    return np.sort(np.array([r[0] for r in top], np.int64))


class Sparse:
    """Rows of present features, in compressed form, with dense columns beside."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n_rows: int, n_cols: int, dense: np.ndarray | None = None):
        self.row, self.col, self.n, self.m = row, col, n_rows, n_cols
        self.dense = np.ones((n_rows, 1)) if dense is None else np.hstack([np.ones((n_rows, 1)), dense])

    def times(self, w: np.ndarray) -> np.ndarray:
        out = self.dense @ w[self.m :]
        full = np.flatnonzero(np.diff(self.row, prepend=-1))  # rows come in order
        if len(full):
            out[self.row[full]] += np.add.reduceat(w[self.col], full)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        top = np.stack([np.bincount(self.col, g[:, k][self.row], self.m) for k in range(g.shape[1])], 1)
        return np.vstack([top, self.dense.T @ g])

    def rows(self, keep: np.ndarray) -> Sparse:
        new = np.cumsum(keep) - 1
        some = keep[self.row]
        return Sparse(new[self.row[some]], self.col[some], int(keep.sum()), self.m, self.dense[keep][:, 1:])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: Sparse, y: np.ndarray, n_classes: int, penalty: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Weights of a multinomial logistic regression by accelerated gradient steps with restarts."""
    target = np.eye(n_classes)[y]
    per_row = np.bincount(x.row, minlength=x.n) + (x.dense**2).sum(1) if x.n else np.ones(1)
    ridge = np.full((x.m + x.dense.shape[1], 1), penalty)
    ridge[x.m] = 1e-3  # the intercept

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        p = softmax(x.times(w))
        return -np.log(np.maximum(p[np.arange(x.n), y], 1e-300)).sum() + 0.5 * float((ridge * w * w).sum()), p

    w = np.zeros((x.m + x.dense.shape[1], n_classes))
    best, t, v, step = np.inf, 1.0, w, 4.0 / max(1.0, float(per_row.sum()) / 4)
    for _ in range(rounds):
        value, p = loss(v)
        g = x.back(p - target) + ridge * v
        while step > 1e-12:
            new = v - step * g
            after, _ = loss(new)
            if after <= value - 0.5 * step * float((g * g).sum()) + 1e-12:
                break
            step /= 2
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, t = (new + (t - 1) / s * (new - w), s) if after <= best else (new, 1.0)
        done = abs(best - after) <= 1e-4 * max(1.0, abs(after))
        w, best, step = new, after, step * 1.2
        if done:
            break
    return w


def collect_rows(rows: DataFrame, selected: np.ndarray, targets: list[str]) -> tuple[Sparse, np.ndarray]:
    """The training rows, reduced to the selected buckets, on the driver; both are bounded. A feature takes two bytes on the way."""
    n_targets = len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(2**BITS, -1, np.int32)
        place[selected] = np.arange(len(selected))
        for batch in batches:
            lists = batch.column(n_targets + 1)
            ptr, at = lists.offsets.to_numpy(), place[lists.values.to_numpy()]
            packed = [x[x >= 0].astype(np.uint16).tobytes() for x in (at[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_targets + 1)), pa.array(packed, pa.binary())], names=["h", *targets, "features"])

    table = rows.select(F.xxhash64("id").alias("h"), *targets, "buckets").mapInArrow(run, f"h long, {', '.join(f'{c} int' for c in targets)}, features binary").toArrow()
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    features = table.column("features").combine_chunks() if len(table) else []
    lists = [np.frombuffer(features[int(i)].as_buffer(), np.uint16) for i in order]
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists]) if lists else np.zeros(0, np.int32)
    col = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
    y = np.stack([table.column(c).to_numpy()[order] for c in targets], 1).astype(np.int64) if lists else np.zeros((0, n_targets), np.int64)
    return Sparse(row, col, len(lists), len(selected)), y


def block_matrix(data: np.ndarray, at: np.ndarray, selected: np.ndarray, dense: np.ndarray | None = None) -> Sparse:
    """The same features of a block of texts."""
    place = np.full(2**BITS, -1, np.int32)
    place[selected] = np.arange(len(selected))
    row, bucket = word_features(data, at)
    col = place[bucket]
    return Sparse(row[col >= 0], col[col >= 0].astype(np.int64), len(at) - 1, len(selected), dense)
