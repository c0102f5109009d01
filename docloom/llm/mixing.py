"""Mixing sources to target weights with soft memberships.

A classifier fitted on the labelled rows gives every document its domain posteriors p. Rates r, nonnegative,
then minimise the distance between the expected token totals of the domains, the sum of r * tokens * p, and
their targets, by accelerated projected gradient steps until the projected gradient vanishes. All rates start
alike and a step shifts them by the posteriors, so that rows of equal posteriors keep equal rates: the descent
runs over sums by small cells of posteriors, and the rows follow its steps.

Nulls and edge cases: a null text has no tokens and the posteriors of an empty text; a domain without tokens
is left out of the fit; labels that are null take no part; repeated rows are documents of their own; an empty
table gives an empty result; `apply_rates` carries all columns of docs.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from .common import bounded_batches, free_name, store, text_blocks
from .linear import block_matrix, collect_rows, fit, select_buckets, softmax, training_rows
from .rolling import word_spans

#: Domains by label: toxic texts, texts of low quality, all others; and the weights they should have.
DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.8, "low": 0.12, "toxic": 0.08}
#: Labelled rows that the classifier is fitted on at most, and its features.
MAX_ROWS, MAX_FEATURES = 20_000, 1_024
#: How often apply_rates repeats a document at most.
MOST_TIMES = 4.0
#: Share of the tokens by which a target may be off without a warning.
MISSED = 1e-3


def domain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and domain, an index into DOMAINS."""
    return labels.select(id_col, F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).alias("domain"))


def posteriors(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, n_domains: int = len(DOMAINS), id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> tuple[DataFrame, list[str]]:
    """docs with the number of tokens (words) and the domain posteriors after its columns; the names of the new columns.

    labels (id_col, domain) describe rows of labelled_docs.
    """
    rows = training_rows(labelled_docs, labels, ["domain"], max_rows, id_col, text_col)
    buckets = select_buckets(rows, "y0", n_domains, max_features)
    x, y = collect_rows(rows, buckets, ["y0"])
    weights = fit(x, y[:, 0], n_domains) if len(y) else np.zeros((len(buckets) + 1, n_domains))
    names = free_name(docs, "tokens_", *(f"p{k}_" for k in range(n_domains)))
    (text,) = free_name(docs, "text_")
    schema = StructType(list(docs.schema)).add(names[0], LongType())
    for c in names[1:]:
        schema = schema.add(c, DoubleType())
    n_own = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches, text):
            p = softmax(block_matrix(data, at, buckets).times(weights))
            yield pa.RecordBatch.from_arrays([*(block.column(i) for i in range(n_own)), pa.array(np.diff(word_spans(data, at)[2])), *(pa.array(p[:, k]) for k in range(n_domains))], names=schema.names)

    own = [F.col(f"`{c}`") for c in docs.columns]
    return bounded_batches(docs.select(*own, F.col(f"`{text_col}`").alias(text))).mapInArrow(run, schema), names


def descend(tokens: np.ndarray, p: np.ndarray, target: np.ndarray, lower: float, tolerance: float, rounds: int, upper: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated projected gradient with restarts: the steps (one row a round: the shift by posterior, the momentum) and the rates.

    It ends when the totals meet the target, or when no rate that may move has a gradient left.
    """
    x = y = np.full(len(p), min(max(1.0, lower), upper))
    length = np.linalg.eigvalsh((tokens[:, None] * p).T @ p).max(initial=0.0)
    scale, t, best, steps = max(target.sum(), 1.0), 1.0, np.inf, []
    if not length:
        return np.zeros((0, p.shape[1] + 1)), x
    size = 1 / length
    for _ in range(rounds):
        off = (tokens * x) @ p - target
        slope = x - np.clip(x - p @ off / length, lower, upper)
        if np.abs(off).max() <= tolerance * scale or length * np.sqrt((tokens * slope**2).sum()) <= 1e-2 * tolerance * scale * np.sqrt(tokens.sum()):
            break
        if off @ off > best:
            t, y = 1.0, x
            if steps:
                steps[-1][-1] = 0.0
        best = off @ off
        slope_y, size = (tokens * y) @ p - target, size * 1.3
        while True:  # only rows that move count, so a step can be far longer than 1 / length
            new = np.clip(y - p @ (step := slope_y * size), lower, upper)
            d = new - y
            if size * length <= 1 or size * (((tokens * d) @ p) ** 2).sum() <= (tokens * d**2).sum():
                break
            size /= 2
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / s
        y, x, t = new + momentum * (new - x), new, s
        steps.append([*step, momentum])
    return np.array(steps).reshape(-1, p.shape[1] + 1), x


def follow(steps: np.ndarray, p: np.ndarray, lower: float, upper: float = np.inf) -> np.ndarray:
    """The rates of rows with posteriors p after these steps."""
    x = y = np.full(len(p), min(max(1.0, lower), upper))
    for *step, momentum in steps:
        new = np.clip(y - p @ np.array(step), lower, upper)
        y, x = new + momentum * (new - x), new
    return x


def fit_rates(table: DataFrame, names: list[str], weights: np.ndarray, lower: float = 0.0, upper: float = np.inf, total: float | None = None, tolerance: float = 1e-5, rounds: int = 20_000) -> Column:
    """The rate of each row as an expression over its posteriors.

    table has the columns names (tokens, then posteriors). The targets are weights times total (the tokens
    there are; with lower > 0 the smallest total at which no domain has to shrink below its tokens times lower).
    No rate is below lower or above upper. A rate depends on the posteriors of its row only, so rows of nearly equal posteriors are summed up first
    (at most 6 % apart, with their own mean); the driver descends over these sums and the rows follow its
    steps. Targets that are missed are told by a warning, from the totals of the rows themselves.
    """
    tokens, p = F.col(names[0]).cast("double"), [F.col(c) for c in names[1:]]
    k = len(p)
    cells = table.filter(tokens > 0).groupBy(*(F.round(F.log(c + 1e-6) * 16).alias(f"c{i}") for i, c in enumerate(p))).agg(F.sum(tokens).alias("t"), *(F.sum(tokens * c).alias(f"s{i}") for i, c in enumerate(p)))
    got = cells.orderBy(*(f"c{i}" for i in range(k))).select("t", *(f"s{i}" for i in range(k))).toArrow()
    mass = np.array(got.column("t"), float)
    parts = np.stack([np.array(got.column(f"s{i}"), float) for i in range(k)], 1)
    now = parts.sum(0)
    weights = np.where(now > 0, weights, 0.0)
    weights = weights / weights.sum() if weights.sum() else np.zeros(k)
    if total is None:
        total = now.sum() if lower <= 0 else max((lower * n / w for n, w in zip(now, weights, strict=True) if w > 0), default=0.0)
    target = weights * total
    steps, _ = descend(mass, parts / np.maximum(mass, 1e-300)[:, None], target, lower, tolerance, rounds, upper) if total else (np.zeros((0, k + 1)), None)

    @F.arrow_udf("double")
    def rate_of(*columns: pa.Array) -> pa.Array:
        return pa.array(follow(steps, np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1), lower, upper))

    rate = rate_of(*p)
    if total:
        mix = table.select(tokens.alias("t"), *(c.alias(f"p{i}") for i, c in enumerate(p)), rate.alias("r")).agg(*(F.sum(F.col("r") * F.col("t") * F.col(f"p{i}")) for i in range(k))).collect()[0]
        off = np.abs(np.array(mix, float) - target).max() / total
        if off > max(MISSED, tolerance):
            shares = np.array(mix, float) / sum(mix)
            warnings.warn(f"mixing misses its targets by up to {off:.2%} of the tokens: shares {shares.round(4).tolist()} instead of {weights.round(4).tolist()} after {len(steps)} rounds", stacklevel=2)
    return rate


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, p_<domain> and rate of every document."""
    table, names = posteriors(docs.select(id_col, text_col), docs, domain_labels(labels, id_col), id_col=id_col, text_col=text_col)
    table = store(table.select(id_col, *names), "posteriors")
    rate = fit_rates(table, names, np.array([weights[d] for d in DOMAINS]))
    return table.select(id_col, F.col(names[0]).alias("n_tokens"), *(F.col(c).alias(f"p_{d}") for c, d in zip(names[1:], DOMAINS, strict=True)), rate.alias("rate"))


def apply_rates(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, lower: float = 1.0, upper: float = MOST_TIMES, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as often as its rate says, fractions rounded by a hash of the id; columns as in docs.

    With lower = 1 the mix is reached by repetition only: every row stays at least once. No row is repeated more
    than upper times, so that a domain of few documents is not made of copies; targets that this keeps out of
    reach are missed with a warning.
    """
    table, names = posteriors(docs, labelled_docs, domain_labels(labels, id_col), id_col=id_col, text_col=text_col)
    table = store(table, "posteriors")
    rate = fit_rates(table, names, np.array([weights[d] for d in DOMAINS]), lower, upper)
    chance = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.greatest(F.lit(0.0), rate) + chance).cast("int")
    return table.withColumn(names[0], F.explode(F.array_repeat(F.lit(True), times))).select(*(F.col(f"`{c}`") for c in docs.columns))
