"""Near-duplicates by b-bit MinHash.

The minima of many hash functions over a text's word shingles are banded into bucket keys; of each minimum
only the low bits are kept, packed into a few longs. Pairs that share a bucket are estimated by counting equal
low bits, corrected for chance, and confirmed on the full shingle sets. A pair with a low estimate is passed
over only if its sets also can't overlap enough: shingles are counted by bin, and what two sets have in common
is at most the sum of the lesser counts. So an unlucky estimate loses no link.

No bucket is expanded into all its pairs. Texts with the same set are one class. For a few rounds everything in
a bucket is compared with one hub, taken from the bucket's largest component, and linked texts become components.
A hub that has met all outside its component leaves the bucket, and a bucket of one component is done. In the
buckets left every text outside the largest component meets all others, in blocks of bounded size and best
estimates first, and pairs whose components have joined meanwhile are passed over. So no bucket is cut short,
and no link between different components is lost.

Nulls and edge cases: a text without words (or null) has an empty set and links with nothing; rows that share
an id count as one document; a null id links with nothing and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, release_memory, store, text_blocks
from .graph import components
from .rolling import LOWER, Ranges, mix, word_spans

#: Low bits kept of each minimum.
B_BITS = 2
#: Pairs with an estimate this far below the threshold are compared by bins before they are confirmed; number of bins.
MARGIN, BINS = 0.25, 128
#: Rounds with one hub a bucket before the rest of a bucket meets in blocks of this many bytes of sets.
HUB_ROUNDS, BLOCK_BYTES = 3, 8 << 20
#: Up to this many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of every text; fewer words than width are one shingle."""
    lower = LOWER[data]
    start, end, ptr = word_spans(lower, at)
    h = Ranges(lower).of(start, end)
    n = len(h)
    joined = np.zeros(n, np.uint64)
    for k in range(width):
        part = mix(h * np.uint64(2 * k + 3) + np.uint64(k))
        joined[: max(0, n - k)] = mix(joined[: max(0, n - k)] * np.uint64(0x9FB21C651E98DF25) + part[k:])
    for i in range(len(ptr) - 1):
        a, b = int(ptr[i]), int(ptr[i + 1])
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix(np.array([whole * np.uint64(0x9FB21C651E98DF25) + x]))[0]
            yield np.array([whole])
        else:
            yield np.zeros(0, np.uint64)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union for two sorted sets."""
    if len(y) < len(x):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def can_link(size: np.ndarray, counts: np.ndarray, other_size: int, other_counts: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets may still have 100 * intersection >= percent * union with the other one."""
    both = np.minimum(counts, other_counts).sum(1).astype(np.int64)
    return 100 * both >= percent * (size + other_size - both)


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), key_a and key_b (digest of the set), bands (bucket keys), bits (packed low bits) and bins (shingles by bin) of every text."""
    k = bands * rows
    factors = np.random.default_rng(7).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    per = 64 // B_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for block, data, at in text_blocks(batches, "text"):
                sets = list(shingle_sets(data, at, width))
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                key = np.zeros((2, len(sets)), np.uint64)
                band = np.zeros((bands, len(full)), np.uint64)
                bits = np.zeros((-(-k // per), len(full)), np.uint64)
                if len(full):
                    flat, first = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    key[0, full], key[1, full] = np.add.reduceat(mix(flat + np.uint64(1)), first), np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first)
                    for i in range(k):
                        least = mix(np.minimum.reduceat(flat * factors[i], first))
                        band[i // rows] = mix(band[i // rows] * np.uint64(31) + least + np.uint64(i // rows))
                        bits[i // per] |= (least & np.uint64(2**B_BITS - 1)) << np.uint64(B_BITS * (i % per))
                lists = []
                for values in (band, bits):
                    ends = np.concatenate([[0], np.cumsum((size > 0) * len(values))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(_i64(np.ascontiguousarray(values.T).reshape(-1)))))
                bins = np.bincount(np.repeat(np.arange(len(sets)), size) * BINS + (np.concatenate(sets) & np.uint64(BINS - 1)).astype(np.int64) if len(full) else np.zeros(0, np.int64), minlength=len(sets) * BINS).reshape(-1, BINS)
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BINS), pa.array(bins.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(size), *(pa.array(_i64(x)) for x in key), *lists, counts], names=["id", "n", "key_a", "key_b", "bands", "bits", "bins"])

    return bounded_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "id long, n long, key_a long, key_b long, bands array<long>, bits array<long>, bins array<int>")


def _estimate(a: str, b: str, words: int, k: int):
    """Similarity from packed low bits: the share of equal ones, less what chance makes equal."""
    low = sum(1 << (B_BITS * i) for i in range(64 // B_BITS))
    differ = F.lit(0)
    for i in range(words):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        folded = x
        for s in range(1, B_BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(low - 2**64 if low >= 2**63 else low)))
    chance = 2.0**-B_BITS
    return ((1 - differ / k) - chance) / (1 - chance)


def _confirm(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, words: int, k: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"b_{c}"), F.col("bins").alias(f"c_{c}"))
    both = F.aggregate(F.zip_with("c_u", "c_v", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda s, x: s + x)
    may = (_estimate("b_u", "b_v", words, k) >= percent / 100 - MARGIN) | (100 * both >= percent * (F.col("n_u") + F.col("n_v") - both))
    met = pairs.join(side("u"), "u").join(side("v"), "v").filter("100 * least(n_u, n_v) >= %d * greatest(n_u, n_v)" % percent).filter(may).select("u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if linked(*(np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b)), percent):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))
        release_memory()

    first = sets.select(F.col("id").alias("u"), F.col("shingles").alias("s_u"))
    second = sets.select(F.col("id").alias("v"), F.col("shingles").alias("s_v"))
    return met.join(first, "u").join(second, "v").select("u", "v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def _finish(entries: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, words: int, k: int) -> DataFrame:
    """Links (u, v) that join the components of each bucket as far as any pair in it can.

    entries: key, id, comp and main, the bucket's largest component. Every text outside main meets every text of
    its bucket, in blocks of bounded size; a pair whose components are joined by then is not looked at.
    """
    low = np.uint64(sum(1 << (B_BITS * i) for i in range(64 // B_BITS)))

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
        size = table.column("n").to_numpy()
        counts = table.column("bins").combine_chunks().flatten().to_numpy().reshape(len(ids), BINS)
        bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
        base, asks = np.flatnonzero(table.column("as_base").to_numpy(zero_copy_only=False)), np.flatnonzero(table.column("as_outside").to_numpy(zero_copy_only=False))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        out = []
        for i in asks:
            x = bits[base] ^ bits[i]
            folded = x.copy()
            for s in range(1, B_BITS):
                folded |= x >> np.uint64(s)
            equal = 1 - np.bitwise_count(folded & low).sum(1) / k
            estimate = (equal - 2.0**-B_BITS) / (1 - 2.0**-B_BITS)
            may = (comp[base] != comp[i]) & (100 * np.minimum(size[base], size[i]) >= percent * np.maximum(size[base], size[i]))
            near = estimate >= percent / 100 - MARGIN
            far = np.flatnonzero(may & ~near)
            for part in np.array_split(far, len(far) // 4096 + 1):
                if len(part):
                    may[part] = can_link(size[base[part]], counts[base[part]], size[i], counts[i], percent)
            for j in base[may][np.argsort(-estimate[may], kind="stable")]:
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a != b and linked(shingles[i], shingles[j], percent):
                    root[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[j]))
        return pa.table({"u": pa.array([min(p) for p in out], pa.int64()), "v": pa.array([max(p) for p in out], pa.int64())})

    rows = entries.join(reps, "id").join(sets, "id").withColumn("outside", F.col("comp") != F.col("main"))
    per_key = rows.groupBy("key").agg(F.sum(F.col("n") * 8 + 100).alias("all_bytes"), F.sum(F.when(F.col("outside"), F.col("n") * 8 + 100).otherwise(0)).alias("out_bytes"))
    per_key = per_key.select("key", F.ceil(F.col("all_bytes") / BLOCK_BYTES).cast("int").alias("ab"), F.greatest(F.lit(1), F.ceil(F.col("out_bytes") / BLOCK_BYTES).cast("int")).alias("ob"))
    rows = rows.join(per_key, "key").withColumn("a", F.pmod(F.xxhash64("id", F.lit(1)), F.col("ab")).cast("int")).withColumn("o", F.pmod(F.xxhash64("id", F.lit(2)), F.col("ob")).cast("int"))
    as_base = F.transform(F.sequence(F.lit(0), F.col("ob") - 1), lambda o: F.struct(o.alias("o"), F.col("a").alias("a")))
    as_outside = F.transform(F.sequence(F.lit(0), F.col("ab") - 1), lambda a: F.struct(F.col("o").alias("o"), a.alias("a")))
    rows = rows.withColumn("at", F.explode(F.array_distinct(F.when(F.col("outside"), F.concat(as_base, as_outside)).otherwise(as_base))))
    rows = rows.select("key", F.col("at.o").alias("bo"), F.col("at.a").alias("ba"), "id", "comp", "n", "bits", "bins", "shingles", (F.col("at.a") == F.col("a")).alias("as_base"), (F.col("outside") & (F.col("at.o") == F.col("o"))).alias("as_outside"))
    return rows.groupBy("key", "bo", "ba").applyInArrow(meet, "u long, v long").distinct()


def _sets_of(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id and shingles (packed fingerprints) of the documents in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([s.tobytes() for s in shingle_sets(data, at, width)], pa.binary())], names=["id", "shingles"])

    small = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if small else ids, "id", "left_semi")
    return store(bounded_batches(texts).mapInArrow(run, "id long, shingles binary"), "sets")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = 24, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links) and kept (it is its own) of every row.

    Documents link if 100 * intersection >= percent * union of their sets of width-word shingles. With 24 bands
    of 5 rows a pair at 85 % misses all buckets with a probability below 1e-6.
    """
    k = bands * rows
    words = -(-k * B_BITS // 64)
    signed = store(signatures(docs, width, bands, rows, id_col, text_col), "signatures")
    full = signed.filter("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("key_a", "key_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    copies = store(classes.filter("size > 1").select("key_a", "key_b", "rep"), "copies")
    in_class = full.join(copies, ["key_a", "key_b"], "left")
    reps = store(in_class.filter("rep IS NULL OR rep = id").select("id", "n", "bands", "bits", "bins"), "representatives")

    entries = reps.select("id", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("other")).filter("hub <> other").select("key", "hub")
    entries = store(entries.join(buckets, "key"), "buckets")
    reps = reps.select("id", "n", "bits", "bins")
    ids = store(entries.select("id").distinct(), "candidates")
    sets = _sets_of(docs, ids, width, id_col, text_col)
    copy_links = in_class.filter("rep IS NOT NULL AND rep <> id").select(F.col("rep").alias("u"), F.col("id").alias("v"))

    links = labels = None
    for turn in range(HUB_ROUNDS):
        outside = entries.filter("id <> hub") if turn == 0 else entries.filter("id <> hub AND comp <> main")
        pairs = outside.select(F.least("hub", "id").alias("u"), F.greatest("hub", "id").alias("v")).distinct()
        found = _confirm(pairs, reps, sets, percent, words, k)
        links = store(found if links is None else links.union(found), "links")
        labels = components(links)
        # The hub has been compared with all that are outside its component, so it leaves; buckets of one component are done.
        left = entries.filter("id <> hub").select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        parts = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id")).alias("first"))
        main = parts.groupBy("key").agg(F.max(F.struct("c", F.col("comp").alias("main"), F.col("first.id").alias("hub"))).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        entries = store(left.join(main.select("key", "m.main", "m.hub"), "key"), "open")
        if not entries.limit(1).count():
            break
    rest = store(_finish(entries.select("key", "id", "comp", "main"), reps, sets, percent, words, k), "links")
    if rest.limit(1).count():
        links = store(links.union(rest), "links")
        labels = components(links)

    # Rows that share an id but not a set are one document: its classes link through that id.
    labels = components(store(links.union(copy_links), "links")) if copy_links.limit(1).count() else labels
    out = signed.select("id", "n").join(labels.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of docs; a null id stays."""
    (group,) = free_name(docs, "group_")
    dropped = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).filter("NOT kept").select(F.col(id_col).alias(group)).distinct()
    dropped = store(dropped, "dropped")
    small = dropped.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(dropped) if small else dropped, F.col(f"`{id_col}`") == F.col(group), "left_anti")
    return kept
