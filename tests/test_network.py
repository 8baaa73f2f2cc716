"""Identities on networks that can be solved by hand."""

import numpy as np
import pandas as pd
import pytest

from sparrowgrid.operators import cluster, contingency, graph, linalg
from sparrowgrid.operators.linalg import Net, star_legs


def net(*rows):
    return Net(pd.DataFrame([(f"{a}-{b}", a, b, s, 1.0) for a, b, s in rows], columns=["name", "bus0", "bus1", "b", "s_nom"]))


TRIANGLE = ((0, 1, 10.0), (0, 2, 10.0), (1, 2, 10.0))


def test_triangle_shares():
    n = net(*TRIANGLE)
    flow = n.ptdf @ np.array([1.0, 0, -1.0])
    assert np.allclose(flow, [1 / 3, 2 / 3, 1 / 3])
    assert np.allclose(n.ptdf.sum(axis=1), 0)
    assert np.allclose(n.laplacian @ n.inverse @ n.laplacian, n.laplacian)


def test_null_transfer():
    assert np.allclose(net(*TRIANGLE).ptdf @ np.zeros(3), 0)


def test_outage_equals_rebuild_and_islanding_is_refused():
    n = net(*TRIANGLE, (2, 3, 10.0))
    for e, name in enumerate(n.branches["name"]):
        out = n.outage(e)
        if name == "2-3":
            assert out is None
        else:
            assert np.allclose(out, n.rebuilt(e))


def test_susceptibility_is_the_derivative():
    n, p = net(*TRIANGLE), np.array([1.0, 0.5, -1.5])
    s = n.susceptibility(p)
    for j in range(3):
        more = n.branches.copy()
        more.loc[j, "b"] += 1e-6
        assert np.allclose((Net(more).ptdf @ p - n.ptdf @ p) / 1e-6, s[:, j], atol=1e-5)


def test_simplex():
    status, x = contingency.simplex(np.array([1.0, 1.0]), np.array([[-1.0, -2.0], [-3.0, -1.0]]), np.array([-4.0, -6.0]))
    assert status == "optimal" and np.allclose(x, [1.6, 1.2])
    assert contingency.simplex(np.array([1.0]), np.array([[1.0], [-1.0]]), np.array([1.0, -2.0]))[0] == "infeasible"
    assert contingency.simplex(np.array([-1.0]), np.array([[-1.0]]), np.array([1.0]))[0] == "unbounded"


@pytest.mark.parametrize("arm", list(contingency.ARMS))
def test_remedies_clear_one_overload(arm):
    n = net(*TRIANGLE)
    p, limit = np.array([2.0, 0, -2.0]), np.array([5.0, 1.0, 5.0])
    v = contingency.hosted_cut(n.ptdf, np.array([0.0, 0.0, 1.0]))
    event = contingency.Event(n.ptdf @ p, limit, v, np.array([2.0, 0.0, 0.0]), np.ones(3, bool))
    status, cut = contingency.remedy(arm, event)
    assert np.all(np.abs(n.ptdf @ p + v @ cut) <= limit * contingency.OVER + 1e-6)
    assert cut.sum() == pytest.approx(0.4985, abs=1e-3) and status in ("done", "least")


def random_case(seed, buses=9, extra=6):
    rng = np.random.default_rng(seed)
    ends = [(i, int(rng.integers(0, i))) for i in range(1, buses)] + [tuple(map(int, rng.choice(buses, 2, replace=False))) for _ in range(extra)]
    b = pd.DataFrame([(f"l{k:02d}", x, y, float(rng.uniform(1, 5)), float(rng.uniform(4, 12))) for k, (x, y) in enumerate(ends)], columns=["name", "bus0", "bus1", "b", "s_nom"])
    g, d = rng.uniform(0, 20, buses), rng.uniform(0, 20, buses)
    p = pd.DataFrame({"bus": range(buses), "p": g - d - (g - d).mean(), "available": g, "load": d})
    return b, p


def events(seed):
    b, p = random_case(seed)
    n = Net(b)
    return n, [e for _, e in contingency._events(n, p, list(range(len(b))))]


@pytest.mark.parametrize("seed", range(8))
def test_arms_keep_their_promises(seed):
    n, found = events(seed)
    for e in found:
        was = np.abs(e.flow)
        cost = {}
        for arm in contingency.ARMS:
            status, cut = contingency.remedy(arm, e)
            assert (cut >= -1e-9).all() and (cut <= e.available + 1e-6).all()
            now = np.abs(e.now)
            if (now[e.over] <= e.most[e.over] + 1e-6).all():
                cost[arm] = cut.sum(), (now <= e.most + 1e-3)[e.live].all()
            if "veto" in arm or arm == "lp" and status != "none":
                healthy = e.live & ~np.isin(np.arange(len(was)), e.over)
                assert (now[healthy] <= e.most[healthy] + 1e-6).all()  # nothing else is broken
        if "lp" in cost:  # nothing that ends within all limits costs less
            assert all(mw >= cost["lp"][0] - 1e-6 for mw, whole in cost.values() if whole)
        else:
            assert not any(whole for _, whole in cost.values())


def test_program_against_grid_search():
    """Where two buses may be cut, the least MW found is the least on a fine grid."""
    done = 0
    for seed in range(6):
        for e in events(seed)[1]:
            two = np.argsort(-contingency.remedy("lp", e)[1], kind="stable")[:2]
            e.available = np.where(np.isin(np.arange(9), two), e.available, 0.0)
            status, cut = contingency.remedy("lp", e)
            xs = [np.array([x, y]) for x in np.linspace(0, e.available[two[0]], 41) for y in np.linspace(0, e.available[two[1]], 41)]
            good = [x.sum() for x in xs if (np.abs(e.flow + e.v[:, two] @ x) <= e.most + 1e-9)[e.live].all()]
            if status == "least":
                done += 1
                assert not good or cut.sum() <= min(good) + 1e-6
            else:
                assert not good
    assert done > 5


@pytest.mark.parametrize("seed", [1, 5])
def test_cascades_follow_a_plain_simulation(spark, seed):
    b, p = random_case(seed)
    got = contingency.cascades(spark.createDataFrame(b.assign(case="c")), spark.createDataFrame(p.assign(case="c")), ("nothing", "lp")).collect()
    assert len(got) == 2 * len(b)
    for r in [r for r in got if r["arm"] == "nothing"]:
        alive, rounds = b[b["name"] != r["start"]], 0
        while True:
            buses, edges = set(range(9)), list(zip(alive["bus0"], alive["bus1"]))
            seen, todo = {0}, [0]
            while todo:
                x = todo.pop()
                for u, v in edges:
                    for a, c in ((u, v), (v, u)):
                        if a == x and c not in seen:
                            seen.add(c)
                            todo.append(c)
            if seen != buses or len(b) - len(alive) > contingency.RUNAWAY:
                break
            k = np.zeros((9, len(alive)))
            for j, (x, y) in enumerate(edges):
                k[x, j], k[y, j] = 1, -1
            s = alive["b"].to_numpy()
            flow = s * (k.T @ np.linalg.lstsq((k * s) @ k.T, p["p"].to_numpy(), rcond=None)[0])
            over = np.abs(flow) > alive["s_nom"].to_numpy() * contingency.OVER + contingency.MARGIN
            if not over.any():
                break
            rounds += 1
            alive = alive[~over]
        assert (r["lost"], r["rounds"], r["islanded"]) == (len(b) - len(alive) - 1, rounds, seen != buses)
    lost = lambda arm: sum(r["lost"] for r in got if r["arm"] == arm)
    assert lost("lp") <= lost("nothing")


def test_reinforcement_ends_clear_or_says_why(spark):
    b, p = random_case(4)
    got = contingency.reinforcement(spark.createDataFrame(b.assign(case="c")), spark.createDataFrame(p.assign(case="c"))).orderBy("round").collect()
    assert got and [r["status"] for r in got[:-1]] == ["upgraded"] * (len(got) - 1) and got[-1]["status"] in ("clear", "stalled", "capped")
    if got[-1]["status"] == "clear":
        for r in got:
            b.loc[b["name"] == r["branch"], ["s_nom", "b"]] *= 1.5
        n = Net(b)
        assert (np.abs(n.ptdf @ n.vector(p)) <= n.limit * contingency.OVER).all()


def test_usage_counts_events(spark):
    d = spark.createDataFrame([("c", "a", 1, 10.0, 4.0), ("c", "b", 1, 10.0, 0.0), ("c", "b", 2, 0.0, 0.0)], "case string, outage string, bus long, available double, cut double")
    got = {r["bus"]: r for r in contingency.usage(d).collect()}
    assert (got[1]["events"], got[1]["cut_events"], got[1]["cut_share"], got[1]["kept_share"]) == (2, 1, 0.5, 0.8) and got[2]["kept_share"] is None


def test_hvdc_release_and_placed(spark):
    links = spark.createDataFrame([("ew", 5, -500.0, 500.0, 0.05), ("m", 6, 0.0, 300.0, None)], "name string, bus0 long, p_min double, p_max double, loss double")
    far = spark.createDataFrame([("ew", "gb")], "name string, bus1 string")
    got = {r["unit"]: r for r in linalg.pass_through(links, far).collect()}
    assert set(got) == {"ew import", "ew export", "m import"} and got["ew export"]["far_bus"] == "gb" and got["m import"]["far_bus"] == "far:m" and got["ew import"]["efficiency"] == 0.95
    units = spark.createDataFrame([("g", 1.5, 2.0)], "name string, p_set double, p_nom double")
    assert linalg.released(units, ["p_set"]).first() == ("g", None, 2.0)
    buses = spark.createDataFrame([("a", 0.0, 0.0, "map"), ("b", -6.0, 53.0, "map"), ("c", -6.0, 53.0, None), ("d", None, 1.0, "map"), ("e", -6.0, 53.0, "none")], "name string, x double, y double, coordinate_source string")
    assert [r["name"] for r in linalg.placed(buses).collect()] == ["b"]


def test_large_case_is_refused_before_it_reaches_a_worker(spark, monkeypatch):
    monkeypatch.setattr(linalg, "MOST_BRANCHES", 3)
    b, _ = random_case(0)
    with pytest.raises(Exception, match="at most"):
        linalg.ptdf(spark.createDataFrame(b.assign(case="c"))).collect()


def test_assignment_and_similarity():
    assert cluster.assignment(np.array([[1.0, 9.0, 2.0], [8.0, 1.0, 3.0], [2.0, 3.0, 7.0]])) == [1, 0, 2]
    assert cluster.lcs_ratio("abcd", "abed") == pytest.approx(75.0)
    assert cluster.lcs_ratio("", "") == 100.0


def test_max_flow():
    g = {0: {1: 3.0, 2: 2.0}, 1: {3: 2.0}, 2: {3: 4.0}, 3: {}}
    value, side = graph.max_flow(g, 0, 3)
    assert value == 4.0 and 3 not in side


def test_star_legs_keep_negative_reactance(spark):
    d = spark.createDataFrame([("t", 1, 2, 3, 0.02, 0.1, 0.02, 0.1, 0.02, 0.3)], "name string, bus1 int, bus2 int, bus3 int, r12 double, x12 double, r23 double, x23 double, r31 double, x31 double")
    legs = {r["leg"]: r["x"] for r in star_legs(d).collect()}
    assert legs == pytest.approx({1: 0.15, 2: -0.05, 3: 0.15})


def test_clusterings(spark):
    two = [(a, b, 10.0 if (a < 3) == (b < 3) else 0.1) for a in range(6) for b in range(6) if a != b]
    adj = spark.createDataFrame(two, "a long, b long, w double")
    zones = {r["node"]: r["zone"] for r in cluster.spectral_zones(adj, 2).collect()}
    assert len({zones[i] for i in range(3)}) == 1 and len({zones[i] for i in range(3, 6)}) == 1 and zones[0] != zones[5]
    sides = {r["node"]: r["side"] for r in cluster.bisection(adj).collect()}
    assert sides[0] == sides[1] == sides[2] != sides[3]
    tree = graph.cut_tree(adj).collect()
    assert len(tree) == 5
