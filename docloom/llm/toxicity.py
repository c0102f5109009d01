"""Toxicity by classifier chains.

Linear models predict the categories in order. Each later model also sees the log-odds that the earlier ones
give; in training these come from folds that did not see the row.

Nulls and edge cases: labelled rows with a null label take no part; a category with one class only gets its
share as a constant probability; a null text counts as empty and gets the intercepts; a row that repeats is
scored row by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_blocks
from .linear import Sparse, block_matrix, collect_rows, fit, select_buckets, softmax, training_rows

#: Labelled rows that the models are fitted on at most, features of each model, and folds.
MAX_ROWS, MAX_FEATURES, FOLDS = 20_000, 1_024, 3


@dataclass
class Chain:
    """A fitted chain: for each category its buckets and weights (None: a constant probability)."""

    categories: list[str]
    buckets: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray | None] = field(default_factory=list)
    share: list[float] = field(default_factory=list)

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One column for each category."""
        seen: list[np.ndarray] = []
        for b, w, share in zip(self.buckets, self.weights, self.share, strict=True):
            if w is None:
                seen.append(np.full(len(at) - 1, share))
                continue
            dense = _log_odds(np.stack(seen, 1)) if seen else None
            seen.append(softmax(block_matrix(data, at, b, dense).times(w))[:, 1])
        return np.stack(seen, 1)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, folds: int = FOLDS) -> Chain:
    """A chain over the 0/1 columns categories of labels, in that order, fitted on at most max_rows labelled rows."""
    rows = training_rows(docs, labels, categories, max_rows, id_col, text_col).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(folds)).cast("int"))
    chain, seen = Chain(categories), []
    columns = [*(f"y{j}" for j in range(len(categories))), "fold"]
    for k in range(len(categories)):
        buckets = select_buckets(rows, f"y{k}", 2, max_features)
        x, y = collect_rows(rows, buckets, columns)
        mine = np.clip(y[:, k], 0, 1) if len(y) else np.zeros(0, np.int64)
        chain.buckets.append(buckets)
        chain.share.append(float(mine.mean()) if len(mine) else 0.0)
        if len(np.unique(mine)) < 2:
            chain.weights.append(None)
            seen.append(np.full(len(mine), chain.share[-1]))
            continue
        dense = _log_odds(np.stack(seen, 1)) if seen else None
        chain.weights.append(fit(Sparse(x.row, x.col, x.n, x.m, dense), mine, 2))
        if k + 1 < len(categories):
            seen.append(_out_of_fold(rows, columns, k, dense, chain.share[-1], max_features, folds))
    return chain


def _out_of_fold(rows: DataFrame, columns: list[str], k: int, dense: np.ndarray | None, share: float, max_features: int, folds: int) -> np.ndarray:
    """Probabilities of category k for each training row by a model that has seen neither its label nor features chosen with it."""
    out = None
    for f in range(folds):
        buckets = select_buckets(rows.filter(F.col("fold") != f), f"y{k}", 2, max_features)
        x, y = collect_rows(rows, buckets, columns)
        x, train, mine = Sparse(x.row, x.col, x.n, x.m, dense), y[:, -1] != f, np.clip(y[:, k], 0, 1)
        out = np.full(x.n, share) if out is None else out
        if len(np.unique(mine[train])) == 2 and not train.all():
            out[~train] = softmax(x.rows(~train).times(fit(x.rows(train), mine[train], 2)))[:, 1]
    return out


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, the probability p_<category> of each category, and the last category as a boolean column of its name."""
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches, "text"):
            p = chain.probabilities(data, at)
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)], names=["id", *names, chain.categories[-1]])

    kind = docs.schema[id_col].dataType.simpleString()
    out = bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, {', '.join(f'`{c}` double' for c in names)}, `{chain.categories[-1]}` boolean")
    return out.withColumnRenamed("id", id_col)
