"""Every query against its SQL, in DuckDB over the same tables."""

import itertools
import math
import re

import duckdb
import numpy as np
import pytest

from sparrowgrid.operators import graph
from sparrowgrid.plans import ORACLES, QUERIES, network

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


def weights(spark, sf):
    """Nodes and the weight matrix of the query network."""
    e = [(r["a"], r["b"], r["w"]) for r in network.adj(spark, sf).collect()]
    nodes = sorted({a for a, _, _ in e})
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, x in e:
        w[nodes.index(a), nodes.index(b)] += x
    return nodes, w


def conductance(w, side):
    inside = np.isin(np.arange(len(w)), side)
    cut, a = w[inside][:, ~inside].sum(), w[inside].sum()
    return cut / min(a, w.sum() - a)


def covers(rows, spark, sf, label, most):
    nodes, _ = weights(spark, sf)
    assert sorted(r["node"] for r in rows) == nodes and 1 < len({r[label] for r in rows}) <= most


def check_bisection(rows, spark, sf):
    nodes, w = weights(spark, sf)
    order = [nodes.index(r["node"]) for r in sorted(rows, key=lambda r: r["fiedler"])]
    side = [nodes.index(r["node"]) for r in rows if r["side"] == 0]
    assert set(order[: len(side)]) == set(side)
    assert conductance(w, side) <= min(conductance(w, order[:m]) for m in range(1, len(nodes))) + 1e-9


def check_eigenpairs(rows, spark, sf):
    nodes, w = weights(spark, sf)
    d = w.sum(axis=1)
    lap = np.eye(len(w)) - w / np.sqrt(d[:, None] * d[None, :])
    all_values = np.sort(np.linalg.eigvalsh(lap))
    for i in {r["i"] for r in rows}:
        v = np.zeros(len(nodes))
        for r in rows:
            if r["i"] == i:
                v[nodes.index(r["node"])], value = r["v"], r["value"]
        assert np.allclose(lap @ v, value * v, atol=1e-9) and abs(v @ v - 1) < 1e-9 and abs(value - all_values[i]) < 1e-9


def check_cut_tree_zones(rows, spark, sf):
    """Between two parts, no minimum cut is larger than the largest one that was taken out."""
    nodes, w = weights(spark, sf)
    assert len({r["cluster"] for r in rows}) == 4 and all(r["cluster"] == min(x["node"] for x in rows if x["cluster"] == r["cluster"]) for r in rows)
    tree = graph.cut_tree(network.adj(spark, sf)).collect()
    taken = sorted(t["cut"] for t in tree)[:3]
    g = {a: {b: w[i, j] for j, b in enumerate(nodes) if w[i, j]} for i, a in enumerate(nodes)}
    part = {r["node"]: r["cluster"] for r in rows}
    for a in nodes[:6]:
        for b in nodes:
            if part[a] != part[b]:
                assert graph.max_flow(g, a, b)[0] <= max(taken) + 1e-6


def check_remedies(rows, spark, sf):
    by = {}
    for r in rows:
        by.setdefault(r["outage"], {})[r["arm"]] = r
    for arms in by.values():
        assert arms["veto"]["new"] == 0 and arms["lp"]["status"] in ("least", "closest", "none")
        if arms["lp"]["status"] == "least":
            assert arms["lp"]["cleared"] and all(a["cut_mw"] >= arms["lp"]["cut_mw"] - 1e-4 for a in arms.values() if a["worst_loading"] <= 1.001 + 1e-9)
    assert any(a["lp"]["status"] == "least" for a in by.values())


def check_usage(rows, spark, sf):
    veto = [r for r in network.QUERIES["remedies"](spark, sf).collect() if r["arm"] == "veto"]
    assert sum(r["cut_mw"] for r in rows) == pytest.approx(sum(r["cut_mw"] for r in veto)) and {r["events"] for r in rows} == {len(veto)}


def check_headline(rows, spark, sf):
    every = network.QUERIES["remedies"](spark, sf).collect()
    for r in rows:
        mine = [x["cut_mw"] for x in every if x["arm"] == r["arm"]]
        assert r["events"] == len(mine) and r["mean_mw"] == pytest.approx(np.mean(mine)) and r["median_mw"] == pytest.approx(np.median(mine))


def check_cascade(rows, spark, sf):
    assert {r["arm"] for r in rows} == {"nothing", "prorata", "veto", "lp"} and any(r["rounds"] for r in rows)
    assert all(r["cut_mw"] == 0 for r in rows if r["arm"] == "nothing") and all(r["lost"] <= 12 or r["runaway"] for r in rows)
    assert all(r["demand_at_risk"] == 0 for r in rows if not r["islanded"] and not r["runaway"])


def check_reinforcement(rows, spark, sf):
    rows = sorted(rows, key=lambda r: r["round"])
    assert [r["round"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["status"] != "upgraded" and all(r["loading"] > 1.001 for r in rows)


def check_alignment(rows, spark, sf):
    """No other renaming of a run overlaps the run before it more."""
    runs = {}
    for r in rows:
        runs.setdefault(r["run"], {})[r["item"]] = r["label"]
    order = sorted(runs)
    for a, b in zip(order, order[1:]):
        same = lambda p: sum(runs[a].get(i) == p[x] for i, x in runs[b].items())
        assert same((0, 1, 2)) == max(map(same, itertools.permutations(range(3))))


def check_token_sort(rows, spark, sf):
    key = lambda n: " ".join(sorted(x for x in re.split("[^a-z0-9]+", n.lower()) if x))

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
        return 200 * row[-1] / (len(a) + len(b))

    names = sorted({r["name"] for r in rows})
    for r in rows[:12]:
        found = sorted(((-ratio(key(r["name"]), key(n)), n) for n in names if n != r["name"]))
        assert (r["best"], r["score"], r["runner_up"]) == (found[0][1], pytest.approx(-found[0][0]), pytest.approx(-found[1][0]))


def check_correlated(rows, spark, sf):
    """Means, deviations and correlations within five standard errors of what is asked for."""
    z = {}
    for r in rows:
        z.setdefault(r["site"], {})[r["hour"]] = r["z"]
    hours = sorted(next(iter(z.values())))
    m = np.array([[z[s][h] for h in hours] for s in sorted(z)])
    n = len(hours)
    assert abs(m.mean(axis=1)).max() < 5 / n**0.5 and abs(m.std(axis=1) - 1).max() < 5 / (2 * n) ** 0.5
    want = {(r["a"], r["b"]): 10 ** (-r["km"] / 200) for r in QUERIES["haversine_pairs"](spark, sf).collect()}
    got = np.corrcoef(m)
    for (a, b), x in want.items():
        assert abs(np.arctanh(got[a, b]) - np.arctanh(x)) < 5 / (n - 3) ** 0.5
    for r in rows[:200]:
        assert r["speed"] == pytest.approx(8 * math.sqrt(-math.log(0.5 * math.erfc(r["z"] / math.sqrt(2)))), rel=1e-9)


CHECKS = {
    "remedies": check_remedies, "arm_headline": check_headline, "node_usage": check_usage, "cascade": check_cascade, "reinforcement_loop": check_reinforcement,
    "spectral_zones": lambda *a: covers(*a, "zone", 4), "walk_zones": lambda *a: covers(*a, "zone", 4), "bisected_zones": lambda *a: covers(*a, "part", 4), "peeled_zones": lambda *a: covers(*a, "part", 4),
    "cheeger_zones": lambda *a: covers(*a, "part", 4), "cut_tree_zones": check_cut_tree_zones, "fiedler_bisection": check_bisection, "lowest_eigenpairs": check_eigenpairs, "week_alignment": check_alignment,
    "token_sort_ratio": check_token_sort, "correlated_speeds": check_correlated,
}


def test_every_query_has_sql_or_a_check():
    assert set(QUERIES) == set(ORACLES) | set(CHECKS)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in ORACLES:
        assert rows
        return CHECKS[name]([r.asDict() for r in df.collect()], spark, sf_dir)
    r = con.execute(ORACLES[name])
    found = [d[0] for d in r.description]
    assert sorted(found) == columns
    assert rows == sorted(([plain(x[found.index(c)]) for c in columns] for x in r.fetchall()), key=str)


def test_token_sort_ratio_across_first_letters(spark, tmp_path):
    names = ["blue steel pipe", "alue steel pipe", "blue rust", "green tin"]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["name"]: r["best"] for r in QUERIES["token_sort_ratio"](spark, str(tmp_path)).collect()}
    assert got["blue steel pipe"] == "alue steel pipe" and got["alue steel pipe"] == "blue steel pipe" and set(got) == set(names)
