"""How far the sources of a language differ in their words.

One pass of bytes.translate over a text lowers A-Z and blanks what separates terms (all of ASCII but letters);
bytes.split and a Counter a document give its frequencies. A task adds them up by language, source and term
before anything is shuffled, so rows grow with the distinct terms of a task and not with its words.

A language keeps the terms that many of its documents hold. Counts by source stay sparse: a source that lacks a
kept term has the share of count 0 there. Two sources are compared over all kept terms: the terms of a language are
dealt to buckets, a bucket holds the shares of one block of sources against another's, and the sums of absolute
differences are added up over the buckets. So a language that holds most of the rows is spread by its terms.

All shares are whole numbers (billionths), so nothing depends on the order of additions.

Nulls and edge cases: null text, language and source count as ''; a text without terms adds its source only; a
source without kept terms and a language without any have their pairs, with values of the shares of count 0 (0
without kept terms); a source alone in its language has no pairs; a repeated row is a document of its own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, store

#: Letters are lowered, other ASCII becomes a blank, bytes of longer characters stay.
TABLE = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Entries of a task's sums before they are passed on.
HELD = 200_000
#: Shares are whole numbers of this many parts; count added to each term.
PARTS, PRIOR = 1_000_000_000, 5
#: Sources of a block, and entries (sources times terms) of a bucket.
SOURCES, ENTRIES = 128, 1 << 15
#: Up to this many groups are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents), added up by task; each group also has a row whose term is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, bytes], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.binary()).cast(pa.string())]
            columns += [pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault((lang, source, None), [0, 0])
                for term, n in Counter(text.encode().translate(TABLE).split()).items():
                    sums = held.setdefault((lang, source, term), [0, 0])
                    sums[0] += n
                    sums[1] += 1
                if len(held) > HELD:
                    yield flush()
        yield flush()
        release_memory()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return bounded_batches(rows).mapInArrow(run, "lang string, source string, term string, n long, d long")


def _share(count: str, total: str) -> Column:
    """1 + floor(PARTS * (count + PRIOR) / total) of two columns, exactly; the quotient counts as 0 where total is 0."""
    return 1 + F.expr(f"coalesce((cast({count} + {PRIOR} as decimal(19,0)) * cast({PARTS} as decimal(10,0))) div cast(nullif({total}, 0) as decimal(20,0)), 0L)")


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, total (n of all sources) and first (once a term) of the terms that least_docs documents of their language hold; groups keep their row without a term."""
    of_term = Window.partitionBy("lang", "term")
    rows = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    rows = rows.withColumn("total", F.sum("n").over(of_term)).withColumn("docs", F.sum("d").over(of_term)).withColumn("first", (F.row_number().over(of_term.orderBy("source")) == 1).cast("long"))
    return rows.filter((F.col("docs") >= least_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "total", "first")


def _by_group(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if small else groups, ["lang", "source"])


def _pairs(terms: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """lang, source, item (another source) and value (the sum of absolute differences over all kept terms)."""
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("v").alias("v_"))
    blocks, buckets = F.ceil(F.col("sources") / SOURCES), F.ceil(F.col("v_") * F.least("sources", F.lit(2 * SOURCES)) / ENTRIES)
    langs = langs.filter("sources > 1").select("lang", blocks.cast("int").alias("blocks"), F.greatest(F.lit(1), buckets.cast("int")).alias("buckets"))
    numbered = groups.withColumn("number", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")).select("lang", "source", "zero", "number")
    numbered = store(numbered.join(langs, "lang").withColumn("block", (F.col("number") / SOURCES).cast("int")), "sources")
    # Every source's share of count 0 goes to every bucket, beside the shares of its terms there.
    heads = numbered.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("zero"))
    shares = _by_group(terms.select("lang", "source", "term", "p"), numbered, small).withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    columns = ["lang", "bucket", "block", "blocks", "number", "term", "p"]
    rows = shares.select(columns).union(heads.select(columns))
    # A block meets itself and all others, once.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def meet(table: pa.Table) -> pa.Table:
        number, p = table.column("number").to_numpy(), table.column("p").to_numpy()
        code = table.column("term").combine_chunks().dictionary_encode()
        if isinstance(code, pa.ChunkedArray):
            code = code.combine_chunks()
        head, term = code.indices.is_null().to_numpy(zero_copy_only=False), code.indices.fill_null(0).to_numpy(zero_copy_only=False)
        known = np.unique(number)
        row = np.searchsorted(known, number)
        matrix = np.zeros((len(known), len(code.dictionary)), np.int64)
        matrix[row[head]] = p[head, None]
        matrix[row[~head], term[~head]] = p[~head]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        a, b = np.flatnonzero(known // SOURCES == low), np.flatnonzero(known // SOURCES == high)
        value = np.zeros((len(a), len(b)), np.int64)
        for i, k in enumerate(a):
            for part in np.array_split(b, max(1, len(b) * matrix.shape[1] // (1 << 20))):
                value[i, np.searchsorted(b, part)] = np.abs(matrix[part] - matrix[k]).sum(1)
        x, y = np.repeat(known[a], len(b)), np.tile(known[b], len(a))
        keep = x < y
        release_memory()
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * int(keep.sum()), pa.string()), "x": x[keep], "y": y[keep], "value": value.reshape(-1)[keep]})

    met = rows.select("lang", "bucket", "low", "high", "number", "term", "p").groupBy("lang", "bucket", "low", "high").applyInArrow(meet, "lang string, x long, y long, value long")
    sums = met.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("at"), "value")
    named = lambda c, out: numbered.select("lang", F.col("number").cast("long").alias(c), F.col("source").alias(out))
    both = both.select("lang", "at.*", "value")
    first, second = named("a", "source"), named("b", "item")
    return both.join(F.broadcast(first) if small else first, ["lang", "a"]).join(F.broadcast(second) if small else second, ["lang", "b"]).select("lang", "source", "item", "value")


def source_divergence(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank (from 1, value descending, then item) of every group.

    Part 'pair': the other sources of the language by their sum of absolute differences of shares. Part 'term': the
    most_terms terms whose share in the source exceeds that in the language most, by the excess.
    """
    terms = store(kept_terms(term_counts(docs, text_col, lang_col, source_col), least_docs), "terms")
    sums = terms.groupBy("lang", "source").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).alias("n_"), F.sum(F.when(F.col("term").isNotNull(), F.col("first")).otherwise(0)).alias("firsts"))
    langs = sums.groupBy("lang").agg(F.sum("n_").alias("all_"), F.sum("firsts").alias("v"))
    groups = sums.join(langs, "lang").select("lang", "source", "v", F.expr(f"n_ + {PRIOR} * v").alias("size"), F.expr(f"all_ + {PRIOR} * v").alias("lang_size"), F.lit(0).cast("long").alias("none"))
    groups = store(groups.withColumn("zero", _share("none", "size")).drop("none"), "groups")
    small = groups.count() <= BROADCAST_GROUPS
    known = _by_group(terms.filter("term IS NOT NULL"), groups, small)
    known = known.withColumn("p", _share("n", "size")).withColumn("q", _share("total", "lang_size")).select("lang", "source", "term", "p", "q")
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = known.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(of_group)).filter(F.col("rank") <= most_terms)
    pairs = _pairs(known, groups, small).withColumn("rank", F.row_number().over(of_group))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").union(columns(over, "term"))
