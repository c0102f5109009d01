"""Quality rules: repetition and length counts, and the divergence of a text from its language.

A text is compared with references that are measured over the whole corpus: for each language the mean
histogram of character classes and of common words of its ordinary texts (see `language_references`). The
Jensen-Shannon distances to them decide, but only for texts long enough for a histogram to mean something.

Nulls and edge cases: a null text counts as empty (all counts 0, base_failed); a null language is a language
of its own; ties and repeated rows are judged row by row; an empty table gives an empty result; further
columns are carried by `quality_filter` and ignored by `quality_counts`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, free_name, release_memory, store, text_blocks, utf8
from .rolling import LOWER, Ranges, owners, sums, word_spans

#: Function words whose shares tell prose of a language from other text. Fixed values.
COMMON_WORDS = (
    "the of and to in is that it for was on are as with be by at this from or an not have you he which a "
    "der die das und ist von den zu mit sich des auf für nicht ein eine dem im werden "
    "le la les de des et en un une du que qui dans pour par sur est au il elle ou "
    "el los las del y una por con para se lo como su al es no"
).split()
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
#: Classes: a-z, A-Z, digits, spaces, line ends, sentence marks, other ASCII, two-byte letters, longer characters; 9: within a character.
_CLASS = np.full(256, 6, np.int64)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0D]] = 4
_CLASS[list(b".,;:'\"!?-")] = 5
_CLASS[0xC0:0xE0] = 7
_CLASS[0xE0:] = 8
_CLASS[0x80:0xC0] = 9
N_CLASSES = 9

#: References of up to this many languages (0.7 KB each) are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    words = list(dict.fromkeys(COMMON_WORDS))
    data = np.frombuffer("".join(words).encode(), np.uint8)
    at = sums(np.array([len(w.encode()) for w in words]))
    h = Ranges(LOWER[data]).of(at[:-1], at[1:])
    order = np.argsort(h)
    return h[order], order


N_COMMON = len(dict.fromkeys(COMMON_WORDS))


def histograms(data: np.ndarray, at: np.ndarray, words: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (the last column: any other word) of every text."""
    n = len(at) - 1
    row = owners(at)
    chars = np.bincount(row * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10)[:, :N_CLASSES]
    start, end, ptr = words or word_spans(data, at)
    known, order = _common_hashes()
    h = Ranges(LOWER[data]).of(start, end)
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    which = np.where(known[i] == h, order[i], N_COMMON)
    common = np.bincount(owners(ptr) * (N_COMMON + 1) + which, minlength=n * (N_COMMON + 1)).reshape(n, N_COMMON + 1)
    return chars.astype(float), common.astype(float)


def base_counts(data: np.ndarray, at: np.ndarray, words: tuple) -> dict[str, np.ndarray]:
    """The counts of COUNTS for every text."""
    n = len(at) - 1
    start, end, ptr = words
    span = sums((data & 0xC0) != 0x80)
    row = owners(ptr)
    ranges = Ranges(data)
    out = {"n_words": np.diff(ptr), "word_chars": np.bincount(row, span[end] - span[start], n).astype(np.int64), "n_symbols": np.diff(sums(_SYMBOLS[data])[at])}

    cuts = np.flatnonzero(data == 0x0A)  # lines; those without a word don't count
    line_start = np.sort(np.concatenate([at[:-1], cuts + 1]))
    line_row = np.searchsorted(at, line_start, "right") - 1
    line_end = np.append(line_start[1:], len(data))
    stop = np.searchsorted(cuts, line_start)
    line_end = np.minimum(np.append(cuts, len(data))[stop], line_end)
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    full &= line_row < n
    line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
    line = line_row * (len(line_row) + 1) + ranges.classes(line_start, line_end)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(np.unique(line) // (len(line_row) + 1), minlength=n)

    out["n_repeat_words"] = np.zeros(n, np.int64)
    whole = np.flatnonzero(row[:-2] == row[2:])  # windows of three words of one text
    if len(whole):
        key = row[whole]
        word = ranges.classes(start, end)[1]
        for k in range(3):
            key = np.unique(key * len(word) + word[whole + k], return_inverse=True)[1]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(start), bool)
        for k in range(3):
            cover[whole[twice] + k] = True
        out["n_repeat_words"] = np.bincount(row[cover], minlength=n).astype(np.int64)
    return out


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every text: id_col and COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches, "text"):
            counts = base_counts(data, at, word_spans(data, at))
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(v, pa.int64()) for v in counts.values())], names=["id", *counts])

    kind = docs.schema[id_col].dataType.simpleString()
    out = bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, {COUNTS}")
    return out.withColumnRenamed("id", id_col)


def base_rule(counts: dict[str, np.ndarray], min_words: int, max_repeat_percent: int) -> np.ndarray:
    """Which texts fail by their counts alone: too few words, or too many of them in repeated windows."""
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > max_repeat_percent * counts["n_words"])


def distinct_shares(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_words: int, max_repeat_percent: int) -> DataFrame:
    """lang, source (the least of its copies), n_words and packed shares of each distinct text of a language that passes the base rule; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches, "text"):
            words = word_spans(data, at)
            counts = base_counts(data, at, words)
            chars, common = histograms(data, at, words)
            good = np.flatnonzero(~base_rule(counts, min_words, max_repeat_percent) & (counts["n_words"] > 0))
            shares = np.hstack([chars[good] / chars[good].sum(1, keepdims=True), common[good] / common[good].sum(1, keepdims=True)]).astype(np.float32)
            some = block.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(some.column(k) for k in (1, 2, 3)), pa.array(counts["n_words"][good]), pa.array([v.tobytes() for v in shares], pa.binary())], names=["lang", "source", "h", "n_words", "shares"])

    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), source.alias("source"), F.xxhash64(text_col).alias("h"))
    parts = bounded_batches(texts).mapInArrow(run, "lang string, source string, h long, n_words long, shares binary")
    return store(parts.groupBy("lang", "h").agg(F.min("source").alias("source"), F.first("n_words").alias("n_words"), F.first("shares").alias("shares")).drop("h"), "shares")


def with_references(rows: DataFrame, references: DataFrame, lang_col: str, name: str) -> DataFrame:
    """rows with the reference of their language (array<double>) as the column name; null if there is none.

    references has one row a language; it is broadcast only if its counted size is small.
    """
    key, value = free_name(rows, "reference_lang_", name)
    few = references.count() <= BROADCAST_LANGUAGES
    side = references.select(F.col("lang").alias(key), F.col("reference").alias(value))
    return rows.join(F.broadcast(side) if few else side, F.col(f"`{lang_col}`").eqNullSafe(F.col(key)), "left").drop(key)


def _vectors(column: pa.Array, width: int, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the distinct vectors each row of a list column has (null: missing), and those vectors."""
    flat = np.tile(missing, (len(column), 1))
    flat[pc.is_valid(column).to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    _, first, code = np.unique(flat.view(np.dtype((np.void, 8 * width))).reshape(-1), return_index=True, return_inverse=True)
    return code.reshape(-1), flat[first]


def language_references(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_char_distance: float = 0.32,
    max_word_distance: float = 0.25,
    word_noise: float = 3.5,
    rounds: int = 15,
    tolerance: float = 1e-3,
) -> DataFrame:
    """lang, n (its distinct texts) and reference (array<double>: the shares of character classes, then of common
    words, of its ordinary texts) of each language.

    Texts that pass the base rule count, each distinct one once, and each source of a language weighs the same
    whatever it holds. Their geometric median (by Weiszfeld steps) stays with the ordinary texts as long as
    these have clearly more than half of the weight; the reference is the mean of the texts that are within the
    distances of it. Languages are rows of a table throughout; only one number a round reaches the driver.
    """
    table = distinct_shares(docs, text_col, lang_col, source_col, min_words, max_repeat_percent)
    width = N_CLASSES + N_COMMON + 1

    def means(centres: DataFrame | None, last: bool) -> DataFrame:
        """The mean of each language's texts: plain without centres, near them if last, else by 1 / distance."""
        weighted = centres is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, _ = utf8(batch.column(3))
                x = data.view(np.float32).reshape(-1, width).astype(float)
                codes, names = [], []
                for k in (0, 1):
                    coded = batch.column(k).dictionary_encode(null_encoding="encode")
                    codes.append(coded.indices.to_numpy().astype(np.int64))
                    names.append(coded.dictionary.to_pylist())
                weight, n_words = np.ones(len(x)), batch.column(2).to_numpy()
                if weighted and len(x):
                    code, distinct = _vectors(batch.column(4), width, np.zeros(width))
                    for k, c in enumerate(distinct):
                        mine = np.flatnonzero(code == k)
                        if last:
                            near = js_distance(x[mine, :N_CLASSES], c[:N_CLASSES]) <= max_char_distance
                            weight[mine] = near & (js_distance(x[mine, N_CLASSES:], c[N_CLASSES:]) <= word_limit(n_words[mine], max_word_distance, word_noise))
                        else:
                            weight[mine] = 1 / np.maximum(np.sqrt(((x[mine] - c) ** 2).sum(1)), 1e-3)
                key = codes[0] * max(1, len(names[1])) + codes[1]
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                if len(first):
                    got = np.add.reduceat(np.hstack([np.ones((len(x), 1)), weight[:, None], x * weight[:, None]])[order], first)
                    of = [[names[k][c] for c in codes[k][order][first]] for k in (0, 1)]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(of[0], pa.string()), "source": pa.array(of[1], pa.string()), "sums": pa.array(got.tolist(), pa.list_(pa.float64()))})
            release_memory()

        rows = table.select("lang", "source", "n_words", "shares")
        rows = rows if not weighted else with_references(rows, centres, "lang", "reference")
        parts = bounded_batches(rows).mapInArrow(run, "lang string, source string, sums array<double>")
        by_source = parts.groupBy("lang", "source").agg(*(F.sum(F.element_at("sums", k + 1)).alias(f"s{k}") for k in range(width + 2)))
        by_lang = by_source.groupBy("lang").agg(F.sum("s0").cast("long").alias("n"), *(F.sum(F.col(f"s{k}") / F.col("s0")).alias(f"s{k}") for k in range(1, width + 2)))
        return by_lang.filter("s1 > 0").select("lang", "n", F.array(*(F.col(f"s{k}") / F.col("s1") for k in range(2, width + 2))).alias("reference"))

    now = store(means(None, False), "references")
    for _ in range(rounds):
        new = store(means(now, False), "references")
        was = now.select(F.col("lang").alias("lang_"), F.col("reference").alias("was"))
        change = F.array_max(F.zip_with("reference", "was", lambda a, b: F.abs(a - b)))
        moved = new.join(was, F.col("lang").eqNullSafe(F.col("lang_"))).agg(F.max(change)).collect()[0][0]
        now = new
        if moved is None or moved <= tolerance:
            break
    near = means(now, True).select(F.col("lang").alias("lang_"), F.col("reference").alias("near"))
    # A language of which nothing is near keeps its median.
    return store(now.join(near, F.col("lang").eqNullSafe(F.col("lang_")), "left").select("lang", "n", F.coalesce("near", "reference").alias("reference")), "references")


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts or shares p to the shares q."""
    total = p.sum(1, keepdims=True)
    p = p / np.where(total > 0, total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def word_limit(n_words: np.ndarray, max_word_distance: float, word_noise: float) -> np.ndarray:
    """The largest distance to the common words at each number of words: a sample of n words has a squared distance of its own of about 1 / n."""
    return np.sqrt(max_word_distance**2 + word_noise / np.maximum(n_words, 1))


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_char_distance: float = 0.32,
    max_word_distance: float = 0.25,
    min_chars: int = 200,
    min_histogram_words: int = 50,
    carry: bool = False,
    source_col: str = "source",
    word_noise: float = 3.5,
) -> DataFrame:
    """Counts, distances and verdicts of every text.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated windows.
    kept: not base_failed, and the distance to the language's character classes at most max_char_distance
    (texts of min_chars characters or more) and to its common words at most word_limit, which nears
    max_word_distance as texts grow (texts of min_histogram_words words or more). carry: keep the columns of
    docs before the new ones. Without a column source_col all texts are of one source.
    """
    references = language_references(
        docs, text_col, lang_col, source_col=source_col, min_words=min_words, max_repeat_percent=max_repeat_percent, max_char_distance=max_char_distance, max_word_distance=max_word_distance, word_noise=word_noise
    )
    # A text of a language without a reference (none of its texts passes the base rule) is held against the mean of all.
    width = N_CLASSES + N_COMMON + 1
    overall = references.agg(F.sum("n"), *(F.sum(F.col("n") * F.element_at("reference", k + 1)) for k in range(width))).collect()[0]
    fallback = np.array(overall[1:], float) / overall[0] if overall[0] else np.r_[np.full(N_CLASSES, 1 / N_CLASSES), np.full(N_COMMON + 1, 1 / (N_COMMON + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches, text):
            words = word_spans(data, at)
            counts = base_counts(data, at, words)
            chars, common = histograms(data, at, words)
            far_chars, far_words = np.zeros(len(chars)), np.zeros(len(chars))
            code, distinct = _vectors(block.column(block.schema.get_field_index(reference)), width, fallback)
            for k, ref in enumerate(distinct):
                mine = np.flatnonzero(code == k)
                far_chars[mine], far_words[mine] = js_distance(chars[mine], ref[:N_CLASSES]), js_distance(common[mine], ref[N_CLASSES:])
            far_chars[chars.sum(1) < min_chars] = 0
            far_words[counts["n_words"] < min_histogram_words] = 0
            failed = base_rule(counts, min_words, max_repeat_percent)
            kept = ~failed & (far_chars <= max_char_distance) & (far_words <= word_limit(counts["n_words"], max_word_distance, word_noise))
            new = [*(pa.array(v, pa.int64()) for v in counts.values()), pa.array(failed), pa.array(kept), pa.array(far_chars), pa.array(far_words)]
            yield pa.RecordBatch.from_arrays([*(block.column(i) for i in range(n_own)), *new], names=[f.name for f in schema])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words"]
    own = docs if carry else docs.select(id_col)
    text, lang, reference = free_name(own, "text_", "lang_", "reference_")
    own_cols = [F.col(f"`{c}`") for c in own.columns]
    n_own = len(own.columns)
    source = docs.select(*own_cols, F.col(text_col).alias(text), F.col(lang_col).cast("string").alias(lang))
    source = with_references(source, references, lang, reference)
    schema = StructType(list(own.schema))
    for name, kind in zip(free_name(own, *names), ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2, strict=True):
        schema = schema.add(name, kind)
    return bounded_batches(source).mapInArrow(run, schema)


def quality_filter(docs: DataFrame, **rules) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns only."""
    judged = quality_verdicts(docs, carry=True, **rules)
    kept = judged.columns[len(docs.columns) + 6]
    return judged.filter(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
