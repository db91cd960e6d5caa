"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from kumoji.llm import multiindex


def brute(rows, cosine=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for size in {len(v) for (_, v), good in zip(rows, ok, strict=True) if good}:
        at = [i for i in range(n) if ok[i] and len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link[np.ix_(at, at)] = x @ x.T >= cosine - 1e-12
    np.fill_diagonal(link, False)
    root = [i for i, _ in rows]
    while True:
        best = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if best == root:
            return sorted((rows[i][0], int(link[i].sum()), root[i], rows[i][0] == root[i]) for i in range(n))
        root = best


def vectors(seed, n, dim, noise=0.1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    rows = [(i, (base[rng.integers(len(base))] + rng.random() * noise * 2 * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]
    return [*rows, (n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, [2 * x for x in rows[1][1]]), (n + 3, None), (n + 4, []), (n + 5, [0.0] * dim), (n + 6, [float("nan")] * dim), (n + 7, [None] + [1.0] * (dim - 1)), (n + 8, [1.0, 2.0, 3.0]), (n + 9, [1.0, 2.0, 3.0]), (n + 10, [float("inf")] * dim)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_links_at_recall_one(spark, kind):
    rows = vectors(1, 900, 16)
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as node", "2 as cell", "3 as size")
    for members in (multiindex.MEMBERS, 5):  # cells in several blocks
        got = sorted(tuple(r) for r in multiindex.near_vectors(table, recall=1.0, members=members).collect())
        assert got == brute(rows)


def test_recall_at_the_default(spark):
    rows = vectors(2, 3000, 32, 0.15)
    want = {r[0]: r for r in brute(rows)}
    got = {r.vec_id: r for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert all(got[i].n_links <= want[i][1] for i in want) and len(got) == len(rows)
    assert sum(g.n_links for g in got.values()) >= 0.97 * sum(w[1] for w in want.values()) > 100


def test_a_large_group_and_odd_tables(spark):
    rng = np.random.default_rng(5)
    center = rng.standard_normal(8)
    rows = [(i, (center + 0.02 * rng.standard_normal(8)).tolist()) for i in range(400)] + [(1000 + i, rng.standard_normal(8).tolist()) for i in range(200)]
    got = sorted(tuple(r) for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), members=50).collect())
    assert got == brute(rows)
    for odd in ([], [(3, None)], [(3, [1.0]), (3, [2.0])]):
        found = sorted(tuple(r) for r in multiindex.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).collect())
        assert found == brute(odd)
    null = multiindex.near_vectors(spark.createDataFrame([(None, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [9.0, -1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in null) == [("5", 1, 5, True), ("None", 0, None, True), ("None", 1, 5, False)]


def test_traversal_visits_every_pair_below_the_limit_in_order():
    rng = np.random.default_rng(7)
    grid = multiindex.fit(rng.standard_normal((500, 12)), 9, 0.95, 1.0)
    grid.limit = 0.3
    _, first, second = grid.borders(multiindex.unit(rng.standard_normal((50, 12))))
    for f, s in zip(first, second, strict=True):
        sums = {a * len(s) + b: f[a] + s[b] for a in range(len(f)) for b in range(len(s)) if f[a] + s[b] <= 0.3}
        got = grid.visits(f, s)
        assert set(got) == set(sums) and [sums[c] for c in got] == sorted(sums.values())
