"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from docloom.llm import near_vectors


def exact(rows, threshold=0.95):
    """n_links and component of each id by brute force; rows: (id, vector)."""
    least = {}
    for i, v in rows:
        ok = i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        if ok and (i not in least or v < least[i]):
            least[i] = v
    ids = sorted(least)
    links = {i: set() for i in ids}
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = np.array(least[i], float), np.array(least[j], float)
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i].add(j)
                links[j].add(i)
    comp = {i: i for i in ids}
    for i in ids:
        if comp[i] == i:
            stack = [i]
            while stack:
                for j in links[stack.pop()]:
                    if comp[j] > i:
                        comp[j] = i
                        stack.append(j)
    return {i: (len(links[i]), comp[i]) for i in ids}


def clustered(n, groups, d=16, seed=4):
    r = np.random.default_rng(seed)
    out = [r.standard_normal(d) for _ in range(n)]
    for g in range(groups):
        middle = r.standard_normal(d)
        out += [middle + 0.12 * r.standard_normal(d) for _ in range(3 + 7 * (g % 5))]
    out += [out[0], out[0], 3 * out[1], -out[2]]
    return [(k, [float(c) for c in v]) for k, v in enumerate(out)]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS x", "'y' AS Cell", "0 AS n_links")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"], r["audited"]) for r in near_vectors.near_duplicates(df, **how).collect()}


@pytest.mark.parametrize("shard,cell", [(8192, 2048), (8192, 40), (100, 150)])
def test_links_equal_brute_force(spark, monkeypatch, shard, cell):
    monkeypatch.setattr(near_vectors, "SHARD_ROWS", shard)
    monkeypatch.setattr(near_vectors, "CELL_ROWS", cell)
    rows = clustered(250, 12)
    got, want = run(spark, rows), exact(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want), "a link below the threshold"
    assert sum(x[0] for x in got.values()) >= 0.98 * sum(x[0] for x in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    assert all(x[2] == (x[1] == i) for i, x in got.items())
    audited = {i: x[3] for i, x in got.items() if x[3] is not None}
    assert audited and all(want[i][0] == n for i, n in audited.items())


def test_pruning_keeps_one_direction_once():
    x = near_vectors._unit(np.array([[1.0, 0.0], [0.99, 0.14], [0.98, 0.2], [0.98, -0.2], [0.0, 1.0]]))
    graph = near_vectors.Graph(x, np.full((5, 2), -1))
    assert graph.prune(np.array([0]), np.array([[4, 3, 2, 1, 1, 0, -1]]), 1.0, 4).tolist() == [[1, 3, -1, -1]]


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1e200, 1e190]), (9, [1.0, 0.0, 0.0]), (10, [1e-200, 0.0]), (11, [0.0, 1.0]), (11, [1.0, 0.0]), (12, [1.0, 0.0]), (12, [1.0, 0.0])]
    got = run(spark, rows)
    linked = {7, 8, 10, 12}
    assert {i for i, x in got.items() if x[0]} == linked and {got[i][:3] for i in linked - {7}} == {(3, 7, False)}
    assert got[7][:3] == (3, 7, True) and got[11][:3] == (0, 11, True) and got[None][:3] == (0, None, True)
    assert run(spark, []) == {}
    assert run(spark, [(1, None)]) == {1: (0, 1, True, None)}
