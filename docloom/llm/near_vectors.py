"""Near-duplicate vectors by robust-pruned flat graphs on overlapping cluster shards.

1. Vectors are normalised, equal ones are one class. Centres fitted on a bounded sample cut space into cells; a vector is
   a member of its nearest cell and of each cell whose border is within reach of what a near-duplicate can
   lie off. A cell with more members than a shard holds is cut into pieces, and every two pieces share a shard.
2. Each shard builds a flat graph: from a random one, every vector searches from the medoid, prunes what it met
   so that of neighbours in one direction the nearest stays, and offers itself to those it keeps; twice.
3. The adjacency lists of all shards are united by vector.
4. In each shard every member searches again over the united lists, from the medoid and from itself. What it met
   within a wider range is expanded until no more is found: all that such meetings join is compared in blocks,
   in double precision, so a dense group costs no walk for each of its pairs. A pair that meets in several
   shards counts in one: the first cell both are members of.
5. Shards return a count by member and a spanning tree of what is linked, not pairs; the trees are joined to
   components. A bounded sample of vectors is compared with all vectors, and low recall is told.

Nulls and edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing and
are kept, so does a null id; rows that share an id are one vector, of different ones the least; vectors link with those of
their own length only; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import _usable
from .common import bounded_batches, release_memory, store
from .graph import components

#: Members of a shard, at most; vectors a centre stands for; most centres of a vector length.
SHARD_ROWS, CELL_ROWS, MOST_CELLS = 8_192, 1_024, 4_096
#: Rows and bytes of the sample that centres are fitted on, and rounds of the fit.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS = 50_000, 64 << 20, 8
#: Border width in standard deviations of a near-duplicate's offset in one direction.
REACH = 0.75
#: Neighbours a vector keeps, width of the beam, factors of the two pruning passes, queries searched and nodes of a beam expanded at a time.
DEGREE, BEAM, ALPHAS, BLOCK, EXPANDED = 24, 24, (1.0, 1.2), 512, 4
#: Vectors that are compared with all; recall below which a warning is given.
AUDITED, GOOD_RECALL = 256, 0.9
#: Cells that are broadcast, at most.
BROADCAST_CELLS = 100_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = [np.frombuffer(v.as_buffer(), np.float64) for v in column]
    return np.stack(rows) if rows else np.zeros((0, 1))


class Graph:
    """A flat graph over unit vectors: neighbour lists padded with -1."""

    def __init__(self, x: np.ndarray, links: np.ndarray):
        self.x, self.links = x.astype(np.float32), links
        self.medoid = int((self.x @ self.x.mean(0)).argmax()) if len(x) else 0

    def search(self, queries: np.ndarray, beam: int, from_self: bool = False, near: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest nodes found of each query node (-1: none), nearest first. With near: all that was met within it, as a matrix of queries and nodes."""
        n, q = len(self.x), np.arange(len(queries))
        seen = np.zeros((len(queries), n), bool)
        hits = np.zeros((len(queries), n), bool) if near is not None else np.zeros((0, 0), bool)
        ids, sims, done = np.full((len(queries), beam), -1), np.full((len(queries), beam), -np.inf, np.float32), np.ones((len(queries), beam), bool)
        seen[q, queries] = True
        fresh = np.where(queries == self.medoid, -1, self.medoid)[:, None]
        if from_self or (queries == self.medoid).any():
            fresh = np.hstack([fresh, self.links[queries]])
        active = q
        while len(active):
            fresh = np.sort(fresh, axis=1)
            there = (fresh >= 0) & ~seen[active[:, None], fresh]
            there[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            rows, cols = np.nonzero(there)
            seen[active[rows], fresh[rows, cols]] = True
            value = np.full(fresh.shape, -np.inf, np.float32)
            value[rows, cols] = np.einsum("ij,ij->i", self.x[fresh[rows, cols]], self.x[queries[active[rows]]])
            if near is not None:
                hit = value[rows, cols] >= near
                hits[active[rows[hit]], fresh[rows[hit], cols[hit]]] = True
            all_ids, all_sims = np.hstack([ids[active], np.where(there, fresh, -1)]), np.hstack([sims[active], value])
            all_done = np.hstack([done[active], ~there])
            if all_sims.shape[1] > 2 * beam:
                best = np.argpartition(-all_sims, 2 * beam, axis=1)[:, : 2 * beam]
                all_ids, all_sims, all_done = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_done))
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active], sims[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_done))
            active = active[~done[active].all(1)]
            if not len(active):
                break
            # The nearest that are not expanded yet go together.
            place = np.argsort(done[active], axis=1, kind="stable")[:, :EXPANDED]
            ready = ~np.take_along_axis(done[active], place, 1)
            done[active[:, None], place] = True
            fresh = np.where(ready[:, :, None], self.links[np.take_along_axis(ids[active], place, 1)], -1).reshape(len(active), -1)
        if near is None:
            return ids, sims
        return hits, sims

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
        """Of each node's candidates (-1: none) the nearest, again and again, each ruling out those alpha times nearer to it than to the node."""
        out = np.full((len(nodes), degree), -1)
        for i in range(0, len(nodes), 256):
            node, some = nodes[i : i + 256], candidates[i : i + 256]
            some = np.where(some == node[:, None], -1, some)
            v = self.x[some]
            sims = np.where(some >= 0, np.einsum("ijk,ik->ij", v, self.x[node]), -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")
            some, sims = np.take_along_axis(some, order, 1), np.take_along_axis(sims, order, 1)
            v = np.take_along_axis(v, order[:, :, None], 1)
            between = np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))) * np.float32(alpha**2)
            away = np.maximum(0, 2 - 2 * sims)
            alive, rows = some >= 0, np.arange(len(node))
            alive[:, 1:] &= ~((some[:, 1:] == some[:, :-1]) & (some[:, 1:] >= 0))  # a candidate that is named twice stands side by side
            for k in range(degree):
                first = alive.argmax(1)
                has = alive[rows, first]
                if not has.any():
                    break
                out[i : i + 256, k] = np.where(has, some[rows, first], -1)
                alive &= (between[rows, first] > away) | ~has[:, None]
                alive[rows, first] = False
        return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 1) -> Graph:
    """The robust-pruned graph of unit vectors; a list holds up to twice the degree before it is pruned to it."""
    n, rng = len(x), np.random.default_rng(seed)
    links = np.full((n, 2 * degree), -1)
    links[:, :degree] = rng.integers(0, max(n, 1), (n, degree))
    graph = Graph(x, links)
    for alpha in ALPHAS:
        order = rng.permutation(n)
        for part in np.array_split(order, max(1, -(-n // BLOCK))):
            if not len(part):
                continue
            met = graph.search(part, beam)[0]
            kept = graph.prune(part, np.hstack([met, graph.links[part]]), alpha, degree)
            graph.links[part, :degree], graph.links[part, degree:] = kept, -1
            # Those that were kept get an offer back. It is taken while there is room; a full list is pruned with its offers, the nearest first.
            rows, cols = np.nonzero(kept >= 0)
            to, offer = kept[rows, cols], part[rows]
            fresh = ~(graph.links[to] == offer[:, None]).any(1)
            to, offer = to[fresh], offer[fresh]
            rank = np.lexsort((-np.einsum("ij,ij->i", graph.x[to], graph.x[offer]), to))
            to, offer = to[rank], offer[rank]
            target, first = np.unique(to, return_index=True)
            count = np.diff(np.append(first, len(to)))
            place, which = np.arange(len(to)) - np.repeat(first, count), np.repeat(np.arange(len(target)), count)
            have = (graph.links[target] >= 0).sum(1)
            full = have + count > 2 * degree
            room = ~full[which]
            graph.links[to[room], (have[which] + place)[room]] = offer[room]
            offers = np.full((len(target), 2 * degree), -1)
            fit = ~room & (place < 2 * degree)
            offers[which[fit], place[fit]] = offer[fit]
            crowded = target[full]
            if len(crowded):
                pruned = graph.prune(crowded, np.hstack([graph.links[crowded], offers[full]]), alpha, degree)
                graph.links[crowded, :degree], graph.links[crowded, degree:] = pruned, -1
    return graph


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of the unit vectors x, as unit vectors."""
    centres = x[np.random.default_rng(3).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(x, len(x) // 4096 + 1)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


def _centres(classes: DataFrame, sizes: list[tuple[int, int]], cell_rows: int) -> dict[int, np.ndarray]:
    """Centres by vector length, from a sample of bounded size; a length that the sample lacks is one cell."""
    n, longest = sum(c for _, c in sizes), max((d for d, _ in sizes), default=1)
    rows = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * longest))
    share = min(1 << 30, -(-(rows << 30) // max(n, 1)))
    sample: dict[int, list[np.ndarray]] = {}
    for r in classes.filter(F.pmod(F.xxhash64("id", F.lit(77)), F.lit(1 << 30)) < share).select("d", "x").limit(2 * rows).toLocalIterator():
        sample.setdefault(r["d"], []).append(np.frombuffer(bytes(r["x"]), np.float64))
    counts = dict(sizes)
    return {d: _fit(np.stack(x), min(MOST_CELLS, len(x), -(-counts[d] // cell_rows))) for d, x in sample.items()}


def _packed(column: str):
    """Normalise the vectors of the column v to packed doubles x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index(column))
            packed = [_unit(np.asarray(r, np.float64)[None])[0].tobytes() for r in (y.values.to_numpy(zero_copy_only=False) for y in v)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(p) // 8 for p in packed], pa.int32()), pa.array(packed, pa.binary())], names=["id", "size", "d", "x"])
        release_memory()

    return run


def _members(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """A row for each cell of a class: id, size, d, x, cell and cells, all its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {}
        for d, c in centres.items():
            apart[d] = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))
        for batch in batches:
            cells: list[np.ndarray] = []
            for d, x in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                if d not in centres:
                    cells.append(np.zeros(1, np.int64))
                    continue
                sims = centres[d] @ np.frombuffer(x.as_buffer(), np.float64)
                home = int(sims.argmax())
                width = REACH * np.sqrt(max(0.0, 1 - threshold**2) / d)
                cells.append(np.flatnonzero(sims[home] - sims <= width * apart[d][home]))
            n = np.array([len(c) for c in cells], np.int64)
            rows = np.repeat(np.arange(len(cells)), n)
            many = batch.take(pa.array(rows))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int32)), pa.array(np.concatenate([cells[i] for i in rows]) if len(rows) else np.zeros(0, np.int64)))
            cell = np.concatenate(cells) if cells else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*many.columns, pa.array(cell), lists], names=["id", "size", "d", "x", "cell", "cells"])
        release_memory()

    return bounded_batches(classes.select("id", "size", "d", "x")).mapInArrow(run, "id long, size long, d int, x binary, cell long, cells array<long>")


def _in_shards(members: DataFrame) -> DataFrame:
    """members in their shards: a and b, the pieces of the cell that share a shard, and piece, their own."""
    cells = store(members.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    pieces = F.when(F.col("n") > SHARD_ROWS, F.ceil(F.col("n") * 2 / SHARD_ROWS)).otherwise(1).cast("int")
    cells = cells.select("d", "cell", pieces.alias("pieces"))
    small = cells.count() <= BROADCAST_CELLS
    rows = members.join(F.broadcast(cells) if small else cells, ["d", "cell"])
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(5)), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return rows.withColumn("a", F.least("piece", "other")).withColumn("b", F.greatest("piece", "other")).drop("pieces", "other")


def _build_shard(table: pa.Table) -> pa.Table:
    """The neighbours of every member, by id."""
    table = table.sort_by("id").combine_chunks()
    ids = table.column("id").to_numpy()
    graph = build(_matrix(table.column("x")))
    release_memory()
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((graph.links >= 0).sum(1))]).astype(np.int32)), pa.array(ids[graph.links[graph.links >= 0]]))
    return pa.table({"id": pa.array(ids), "near": lists})


def _groups(near: np.ndarray) -> Iterator[np.ndarray]:
    """The nodes that a symmetric matrix joins, group by group, those of single nodes left out."""
    open_ = near.any(1)
    for i in range(len(near)):
        if open_[i]:
            inside, frontier = np.zeros(len(near), bool), np.array([i])
            inside[i], open_[i] = True, False
            while len(frontier):
                reach = near[frontier].any(0) & open_
                open_[reach] = False
                inside |= reach
                frontier = np.flatnonzero(reach)
            yield np.flatnonzero(inside)


def _search_shard(threshold: float):
    """count: vectors linked with a member by pairs that count in this shard; root: a member of its component here."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, size, x = table.column("id").to_numpy(), table.column("size").to_numpy(), _matrix(table.column("x"))
        cell, piece = table.column("cell")[0].as_py(), table.column("piece").to_numpy()
        split = table.column("a")[0].as_py() != table.column("b")[0].as_py()
        n = len(ids)
        near = table.column("near").combine_chunks()
        ends = near.offsets.to_numpy() - near.offsets[0].as_py()
        owner, names = np.repeat(np.arange(n), np.diff(ends)), near.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, names), n - 1)
        here = ids[at] == names  # united lists also name members of other shards
        owner, at = owner[here], at[here]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        links = np.full((n, int(place.max(initial=0)) + 1), -1)
        links[owner, place] = at
        graph = Graph(x, links)
        wide = threshold - (1 - threshold)  # what lies a little further leads to more
        near = np.zeros((n, n), bool)
        for i in range(0, n, BLOCK):
            part = np.arange(i, min(n, i + BLOCK))
            near[part] = graph.search(part, BEAM, True, wide)[0]
        for i in range(0, n, BLOCK):  # a pair is near if either end meets the other
            for j in range(i, n, BLOCK):
                near[i : i + BLOCK, j : j + BLOCK] |= near[j : j + BLOCK, i : i + BLOCK].T
                near[j : j + BLOCK, i : i + BLOCK] = near[i : i + BLOCK, j : j + BLOCK].T
        cells = table.column("cells").combine_chunks()
        k = np.diff(cells.offsets.to_numpy())
        none = np.iinfo(np.int64).max
        where = np.full((n, int(k.max(initial=0))), none)
        where[np.repeat(np.arange(n), k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)] = cells.flatten().to_numpy()
        count = np.zeros(n, np.int64)
        for group in _groups(near):
            near[np.ix_(group, group)] = False  # from here on the verified links
            for part in np.array_split(group, len(group) * len(group) // (1 << 20) + 1):
                linked = x[part] @ x[group].T >= threshold
                linked[np.arange(len(part)), np.searchsorted(group, part)] = False
                near[np.ix_(part, group)] = linked
                first = np.full(linked.shape, none)
                for a in range(where.shape[1]):
                    mine = where[part, a][:, None]
                    shared = (where[group][None, :, :] == mine[:, :, None]).any(2) & (mine < none)
                    first = np.minimum(first, np.where(shared, mine, none))
                counts = linked & (first == cell)
                if split:
                    counts &= piece[part][:, None] != piece[group][None, :]
                count[part] = counts @ size[group]
        root = np.arange(n)
        for group in _groups(near):
            root[group] = group[0]
        release_memory()
        return pa.table({"id": pa.array(ids), "count": pa.array(count), "root": pa.array(ids[root])})

    return run


def _audit(classes: DataFrame, counted: DataFrame, threshold: float) -> DataFrame:
    """id and audited, the links by comparison with all vectors, of at most AUDITED sampled classes."""
    n = classes.count()
    share = min(1 << 30, -(-(AUDITED << 29) // max(n, 1)))
    chosen = classes.filter(F.pmod(F.xxhash64("id", F.lit(99)), F.lit(1 << 30)) < share).select("id", "d", "x").limit(AUDITED).collect()
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["d"] for r in chosen}:
        some = [r for r in chosen if r["d"] == d]
        asked[d] = (np.array([r["id"] for r in some]), np.stack([np.frombuffer(bytes(r["x"]), np.float64) for r in some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for d in set(lengths.tolist()) & set(asked):
                some = batch.filter(pa.array(lengths == d))
                ids, x = asked[d]
                other = some.column(0).to_numpy()[None, :] != ids[:, None]
                links = ((x @ _matrix(some.column(3)).T >= threshold) & other) @ some.column(1).to_numpy()
                for i, c in zip(ids.tolist(), links.tolist(), strict=True):
                    sums[i] = sums.get(i, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["id", "audited"])

    exact = bounded_batches(classes.select("id", "size", "d", "x")).mapInArrow(run, "id long, audited long").groupBy("id").agg(F.sum("audited").alias("audited"))
    exact = store(exact, "audit")
    found, there = exact.join(counted, "id").agg(F.sum(F.least("count", "audited")), F.sum("audited")).collect()[0]
    if there and found < GOOD_RECALL * there:
        warnings.warn(f"near vectors: {found} of {there} links of the audited vectors were found", stacklevel=3)
    return exact


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links (other vectors linked directly), component_id (the smallest id reachable), kept (it is its own) of every row, and audited: the exact number of links of the vectors sampled for the audit."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = rows.filter(F.col("id").isNotNull() & _usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    usable = store(usable, "vectors")
    # Equal vectors are one class; partial sums come first, so a frequent vector is a row a task.
    grouped = usable.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    copied = store(grouped.filter("size > 1").select("v", F.col("id").alias("rep")), "copies")
    classes = store(bounded_batches(grouped.select("id", "size", "v")).mapInArrow(_packed("v"), "id long, size long, d int, x binary"), "classes")
    sizes = [(r["d"], r["n"]) for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()]
    members = store(_members(classes, _centres(classes, sizes, CELL_ROWS), threshold), "members")

    shards = ["d", "cell", "a", "b"]
    placed = _in_shards(members)
    built = placed.select(*shards, "id", "x").groupBy(*shards).applyInArrow(_build_shard, "id long, near array<long>")
    near = store(built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    asked = placed.join(near, "id").select(*shards, "id", "size", "x", "cells", "piece", "near")
    found = store(asked.groupBy(*shards).applyInArrow(_search_shard(threshold), "id long, count long, root long"), "found")

    counted = store(found.groupBy("id").agg(F.sum("count").alias("count")), "counts")
    labels = components(found.select(F.col("root").alias("u"), F.col("id").alias("v")))
    audited = _audit(classes, counted, threshold)
    known = counted.join(classes.select("id", "size"), "id").join(labels, "id", "left").join(F.broadcast(audited), "id", "left")
    known = known.select(F.col("id").alias("rep"), (F.col("count") + F.col("size") - 1).alias("n_links"), F.coalesce("comp", "id").alias("component_id"), (F.col("audited") + F.col("size") - 1).alias("audited"))
    # Copies take the figures of their class.
    reps = usable.join(copied, "v", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    out = rows.select("id").join(reps.join(known, "rep").drop("rep"), "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "audited")
