"""Algorithms over edge tables against plain versions on random graphs."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.operators import forest, graph, paths, solve

DAMAGED = [(1, 1, 5.0), (None, 2, 1.0), (3, None, 1.0)]  # a loop and null ends


def sparse(seed, n, m, weight=lambda r: r.random() + 0.1):
    """A tree on most nodes, further edges, a part of its own, and a path."""
    r = random.Random(seed)
    e = {(r.randrange(max(1, i - 6), i) if i > 1 else 0, i) for i in range(1, n)}
    while len(e) < n - 1 + m:
        a, b = sorted(r.sample(range(n // 2), 2))
        e.add((a, b))
    e |= {(1000 + i, 1001 + i) for i in range(20)} | {(2000, 2001), (2001, 2002), (2000, 2002)}
    e |= {(3000, 3001 + i) for i in range(30)}  # a hub
    return [(a, b, weight(r)) for a, b in sorted(e)]


def parts(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def frame(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, w double")


@pytest.mark.parametrize("ties", [False, True])
def test_spanning_forest(spark, ties):
    rows = sparse(3, 60, 50, (lambda r: float(r.randrange(3))) if ties else (lambda r: r.random()))
    more = [*rows, *((b, a, w + 1) for a, b, w in rows[:20]), *DAMAGED]
    tree, root = forest.spanning_forest(frame(spark, more))
    got = sorted(tuple(r) for r in tree.collect())
    nodes, left, want = {x for a, b, _ in rows for x in (a, b)}, [], []
    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        p = parts(nodes, left)
        if p[a] != p[b]:
            left.append((a, b))
            want.append((a, b, w))
    assert got == sorted(want)
    p, by = parts(nodes, left), {}
    for r in root.collect():
        by.setdefault(r["root"], set()).add(p[r["node"]])
    assert all(len(s) == 1 for s in by.values()) and len(by) == len(set(p.values())) and sum(1 for _ in root.collect()) == len(nodes)


def test_bridges_and_totals_below(spark):
    rows = sparse(5, 60, 25)
    got = {(r["a"], r["b"]): r["side"] for r in forest.bridges(frame(spark, [*rows, *DAMAGED])).collect()}
    nodes, edges = {x for a, b, _ in rows for x in (a, b)}, [(a, b) for a, b, _ in rows]
    whole, want = len(set(parts(nodes, edges).values())), {}
    for e in edges:
        p = parts(nodes, [x for x in edges if x != e])
        if len(set(p.values())) > whole:
            want[e] = sum(v == p[e[0]] for v in p.values())
    assert got == want and 0 < len(want) < len(edges)


def test_forest_of_no_edges(spark):
    none = frame(spark, DAMAGED)
    assert forest.spanning_tree(none).count() == 0 and forest.bridges(none).count() == 0


@pytest.mark.parametrize("equal", [False, True])
def test_betweenness_by_blocks(spark, equal):
    rows = sparse(8, 24, 18, (lambda r: 1.0) if equal else (lambda r: r.random() + 0.1))
    adj = graph.adjacency(frame(spark, rows))
    got = {r["node"]: r["score"] for r in paths.betweenness(adj, block=40).collect()}
    g = {}
    for a, b, w in rows:
        g.setdefault(a, {})[b] = w
        g.setdefault(b, {})[a] = w
    score = dict.fromkeys(g, 0.0)
    for s in g:
        dist, count, before, done, heap = {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.append(v)
            for u, w in g[v].items():
                if u not in dist or d + w < dist[u] - 1e-12:
                    dist[u], count[u], before[u] = d + w, count[v], [v]
                    heapq.heappush(heap, (d + w, u))
                elif u not in done and abs(d + w - dist[u]) <= 1e-12:
                    count[u] += count[v]
                    before[u].append(v)
        share = dict.fromkeys(done, 0.0)
        for v in reversed(done):
            for u in before[v]:
                share[u] += count[u] / count[v] * (1 + share[v])
            score[v] += share[v] if v != s else 0
    n = len(g)
    assert got == pytest.approx({v: x / (n - 1) / (n - 2) for v, x in score.items()}, abs=1e-12)


def case(rows):
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    k = np.zeros((len(nodes), len(rows)))
    for e, (a, b, _) in enumerate(rows):
        k[nodes.index(a), e], k[nodes.index(b), e] = 1, -1
    b = np.array([w for _, _, w in rows])
    return nodes, k, b, np.linalg.pinv((k * b) @ k.T, hermitian=True)


def test_conjugate_gradients(spark):
    """Angles, flows and factors of two cases, one of several islands, as with the pseudoinverse."""
    rng = random.Random(2)
    cases = {"one": sparse(11, 14, 8, lambda r: 1 + 9 * r.random()), "two": [(0, 1, 2.0), (1, 2, 3.0), (0, 2, 4.0), (7, 9, 1.0)]}
    table = [(c, f"{a}-{b}", a, b, w, 10.0, 0.1 if a % 3 == 1 else None) for c, rows in cases.items() for a, b, w in rows]
    branches = spark.createDataFrame(table + [("two", "none", 0, 7, 0.0, 1.0, None), ("two", "loop", 1, 1, 5.0, 1.0, None)], "case string, name string, bus0 long, bus1 long, b double, s_nom double, phi double")
    power = [(c, x, rng.uniform(-5, 5)) for c, rows in cases.items() for x in case(rows)[0][:-1]] + [("two", 555, 9.0)]
    p = spark.createDataFrame(power, "case string, bus long, p double")
    theta = {(r["case"], r["bus"]): r["theta"] for r in solve.angles(branches, p).collect()}
    for c, rows in cases.items():
        nodes, k, b, inverse = case(rows)
        phi = np.array([0.1 if a % 3 == 1 else 0.0 for a, _, _ in rows])
        v = np.array([sum(q for d, x, q in power if d == c and x == n) for n in nodes])
        want = inverse @ (v + k @ (b * phi))
        assert [theta[c, n] for n in nodes] == pytest.approx(want, abs=1e-8)
    some = spark.createDataFrame([("one", 3), ("one", 1005), ("two", 1)], "case string, bus long")
    got = {(r["case"], r["branch"], r["bus"]): r["v"] for r in solve.ptdf(branches, some).collect()}
    for c, bus in (("one", 3), ("one", 1005), ("two", 1)):
        nodes, k, b, inverse = case(cases[c])
        f = b * (k.T @ inverse[:, nodes.index(bus)])
        assert [got[c, f"{a}-{d}", bus] for a, d, _ in cases[c]] == pytest.approx(f, abs=1e-8)
    loads = p.select("case", F.lit("x").alias("k"), "bus", "p")
    assert all(r["residual"] <= 1e-9 for r in solve.potentials(branches, loads).select("residual").distinct().collect())
    assert solve.potentials(branches, loads.filter("false")).count() == 0


def test_susceptibility_is_the_derivative(spark):
    rows = [(0, 1, 2.0), (1, 2, 3.0), (0, 2, 4.0), (2, 3, 5.0)]
    p = np.array([3.0, -1.0, 0.5, -2.5])
    branches = spark.createDataFrame([("c", f"{a}-{b}", a, b, w, 1.0) for a, b, w in rows], "case string, name string, bus0 long, bus1 long, b double, s_nom double")
    got = {(r["branch"], r["changed"]): r["v"] for r in solve.susceptibility(branches, spark.createDataFrame([("c", i, x) for i, x in enumerate(p.tolist())], "case string, bus long, p double")).collect()}
    flow = lambda e: (lambda n, k, b, inv: b * (k.T @ (inv @ p)))(*case(e))
    for j, (a, b, w) in enumerate(rows):
        up, down = ([*rows[:j], (a, b, w + h), *rows[j + 1 :]] for h in (1e-5, -1e-5))
        d = (flow(up) - flow(down)) / 2e-5
        assert [got[f"{x}-{y}", f"{a}-{b}"] for x, y, _ in rows] == pytest.approx(d, abs=1e-6)


def test_correlated_draws(spark):
    """A factor of given correlations, of contradictory ones, and the same numbers in every run and partitioning."""
    from sparrowgrid.operators import draws

    pairs = [(1, 2, 0.8), (2, 5, 0.3), (1, 5, 0.1)]
    d = spark.createDataFrame(pairs, "a long, b long, r double")
    low = np.array([r["row"] for r in sorted(draws.factor(d).collect(), key=lambda r: r["i"])])
    assert low @ low.T == pytest.approx(np.array([[1, 0.8, 0.1], [0.8, 1, 0.3], [0.1, 0.3, 1]]), abs=1e-12)
    odd = spark.createDataFrame([(1, 2, 0.95), (2, 5, 0.95), (1, 5, -0.95)], "a long, b long, r double")
    low = np.array([r["row"] for r in sorted(draws.factor(odd).collect(), key=lambda r: r["i"])])
    assert (low**2).sum(axis=1) == pytest.approx([1, 1, 1])
    times = spark.range(4000).withColumnRenamed("id", "t")
    got = {(r["t"], r["site"]): r["z"] for r in draws.correlated(d, times, "t", 3).collect()}
    again = {(r["t"], r["site"]): r["z"] for r in draws.correlated(d, times.repartition(3), "t", 3).collect()}
    assert got == again and len(got) == 12_000
    z = np.array([[got[t, s] for t in range(4000)] for s in (1, 2, 5)])
    assert np.corrcoef(z)[0, 1] == pytest.approx(0.8, abs=0.03) and np.corrcoef(z)[1, 2] == pytest.approx(0.3, abs=0.08)


def test_normal_distribution_function(spark):
    import math

    from sparrowgrid.functions import scalars

    z = [-40.0, -8.1, -7.9, -5.0, -1.3, -1e-9, 0.0, 0.4, 3.0, 6.5, 8.5, 40.0]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").orderBy("i").select(scalars.normal_cdf("z")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], abs=1e-14)
