"""Outage cases, remedies and cascades. A remedy or cascade is a loop over one event's branches, so each event is worked
out inside a grouped pandas call, many events to a case spread over tasks; scoring and reports are relational."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import Net, by_outages, with_case

# Thresholds that results depend on.
OVER = 1.001  # loading that counts as an overload
MEMBER = 0.05  # relief per MW from which a node belongs to a branch's group
NOISE = 1e-6  # MW below which a cut is no instruction
MARGIN = 1e-3  # MW beyond a limit that count as broken
RUNAWAY = 12  # branches lost beyond which a cascade is given up


def violations(outages: DataFrame) -> DataFrame:
    """case, outage, branch, before, after, s_nom -> overloads by outage: count, the worst, MW over."""
    over = F.abs("after") - F.col("s_nom")
    v = outages.withColumn("loading", F.abs("after") / F.nullif("s_nom", F.lit(0.0))).filter(F.col("loading") > OVER).withColumn("over", over)
    return v.groupBy("case", "outage").agg(F.count("*").alias("n_over"), F.max_by("branch", F.struct("loading", "branch")).alias("worst"), F.max("loading").alias("worst_loading"), F.sum("over").alias("over_mw"))


def worst_cases(outages: DataFrame) -> DataFrame:
    """For each branch the outage with its largest flow; `none` where no outage exceeds the intact network's."""
    o = outages.filter("outage <> branch")
    best = o.groupBy("case", "branch").agg(F.max_by("outage", F.struct(F.abs("after"), "outage")).alias("outage"), F.max(F.abs("after")).alias("flow"), F.max(F.abs("before")).alias("intact"))
    return best.withColumn("outage", F.when(F.col("flow") > F.col("intact"), F.col("outage")).otherwise("none"))


def score(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Branch flows of an event before and after a remedy -> cleared, resolved, new, worsened, residual MW."""
    b = before.select(*by, "branch", F.col("flow").alias("f0"), "s_nom")
    j = b.join(after.select(*by, "branch", F.col("flow").alias("f1")), [*by, "branch"])
    l0, l1 = F.abs("f0") / F.col("s_nom"), F.abs("f1") / F.col("s_nom")
    over = F.greatest(F.lit(0.0), F.abs("f1") - F.col("s_nom"))
    return j.groupBy(*by).agg(
        (F.count_if(l1 > OVER) == 0).alias("cleared"), F.count_if((l0 > OVER) & (l1 <= OVER)).alias("resolved"), F.count_if((l0 <= OVER) & (l1 > OVER)).alias("new"),
        F.count_if((l0 > OVER) & (l1 > l0 + 1e-6)).alias("worsened"), F.sum(F.when(l1 > OVER, over).otherwise(0.0)).alias("residual"),
    )


def simplex(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray]:
    """min c x for a x <= b, x >= 0, by the two-phase tableau: (status, x), status `optimal`, `infeasible` or `unbounded`.
    Bland's rule (the first column that improves, the first row of a tie) never comes back to a basis, so it ends."""
    m, n = a.shape
    sign = np.where(b < 0, -1.0, 1.0)
    need = np.flatnonzero(sign < 0)
    t = np.hstack([a * sign[:, None], np.diag(sign), np.eye(m)[:, need], (b * sign)[:, None]])
    basis = np.arange(n, n + m)
    basis[need] = n + m + np.arange(len(need))

    def optimise(cost: np.ndarray, width: int) -> bool:
        while True:
            better = np.flatnonzero(cost[:width] - cost[basis] @ t[:, :width] < -1e-9)
            if not len(better):
                return True
            enter = better[0]
            rows = np.flatnonzero(t[:, enter] > 1e-9)
            if not len(rows):
                return False
            ratio = t[rows, -1] / t[rows, enter]
            i = min(rows[ratio <= ratio.min() + 1e-12], key=lambda r: basis[r])
            t[i] /= t[i, enter]
            other = np.arange(m) != i
            t[other] -= np.outer(t[other, enter], t[i])
            basis[i] = enter

    total = n + m + len(need)
    x = np.zeros(total)
    phase = np.zeros(total)
    phase[n + m :] = 1
    if len(need) and (not optimise(phase, total) or phase[basis] @ t[:, -1] > 1e-6):
        return "infeasible", x[:n]
    if not optimise(np.concatenate([c, np.zeros(m + len(need))]), n + m):
        return "unbounded", x[:n]
    x[basis] = t[:, -1]
    return "optimal", x[:n]


def hosted_cut(ptdf: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Change of every flow for 1 MW cut at each bus and made up by the reference weights."""
    w = weights / weights.sum()
    return -(ptdf - (ptdf @ w)[:, None])


def safe_cut(flow: np.ndarray, limit: np.ndarray, column: np.ndarray, guarded: np.ndarray) -> float:
    """Largest cut at one bus that takes no guarded branch beyond its limit, in either direction."""
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(column > 1e-12, (limit - flow) / column, np.where(column < -1e-12, (limit + flow) / -column, np.inf))
    return float(max(0.0, np.min(room[guarded], initial=np.inf)))


def safe_cuts(branches: DataFrame, injections: DataFrame) -> DataFrame:
    """case, bus, mw: the largest cut at each bus, made up by the load, that takes no branch beyond its limit. Branches over
    it already do not count; NULL where no branch ever binds."""

    def run(case, b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        n = Net(b)
        flow, v = n.ptdf @ n.vector(p), hosted_cut(n.ptdf, n.vector(p, "load"))
        mw = np.array([safe_cut(flow, n.limit, v[:, i], np.abs(flow) <= n.limit * OVER) for i in range(len(n.buses))])
        return pd.DataFrame({"case": case, "bus": n.buses, "mw": np.where(np.isfinite(mw), mw, np.nan)})

    return with_case(branches, injections, run, "case string, bus long, mw double").withColumn("mw", F.nanvl("mw", F.lit(None).cast("double")))


@dataclass
class Event:
    """One overloaded state: flows, limits, the change of every flow for 1 MW cut at a bus, MW that may be cut; branches
    that are out do not count. `intact`: the same changes in the network before the outage."""

    flow: np.ndarray
    limit: np.ndarray
    v: np.ndarray
    available: np.ndarray
    live: np.ndarray
    intact: np.ndarray | None = None

    def __post_init__(self):
        self.most = self.limit * OVER
        self.over = np.flatnonzero((np.abs(self.flow) > self.most) & self.live)
        self.cut = np.zeros(len(self.available))

    @property
    def now(self) -> np.ndarray:
        return self.flow + self.v @ self.cut

    @property
    def left(self) -> np.ndarray:
        return self.available - self.cut

    def still(self) -> np.ndarray:
        now = np.abs(self.now)
        return self.over[now[self.over] > self.most[self.over]]

    def relief(self, v: np.ndarray, branches: np.ndarray, now: np.ndarray) -> np.ndarray:
        """MW off each branch's loading for 1 MW cut at each bus."""
        return -v[branches] * np.where(now[branches] < 0, -1.0, 1.0)[:, None]

    def room(self, column: np.ndarray, now: np.ndarray) -> float:
        """MW along a direction until a branch meets its limit; one that is over it already may not get worse."""
        return safe_cut(now, np.maximum(self.most, np.abs(now)), column, self.live)


def _prorata(e: Event) -> str:
    """Circuit by circuit, the worst first: the members of its group share the cut by what they have left."""
    for branch in sorted(e.over, key=lambda k: -(abs(e.flow[k]) - e.limit[k])):
        while True:
            now = e.now
            need = abs(now[branch]) - e.most[branch]
            relief = e.relief(e.v, np.array([branch]), now)[0]
            group = (relief >= MEMBER) & (e.left > NOISE)
            if need <= NOISE or not group.any():
                break
            share = e.left * group
            e.cut += share * min(1.0, need / float(relief @ share))
    return "done"


RANKS: dict[str, Callable[[np.ndarray, np.ndarray, int], np.ndarray]] = {
    # relief of the violated branches by bus, MW each needs, the worst of them -> merit of each bus
    "worst": lambda r, need, worst: r[worst],
    "sum": lambda r, need, worst: r.sum(axis=0),
    "need": lambda r, need, worst: need @ r / need.sum(),
    "minmax": lambda r, need, worst: (r / need[:, None]).min(axis=0) * need.mean(),
}


def _greedy(e: Event, rank: str = "sum", veto: bool = False) -> str:
    """One bus at a time, the best by the rank rule; a step ends where the first violated branch is relieved. With the
    veto, no branch is pushed beyond its limit; a bus without room waits until the flows have moved."""
    blocked = np.zeros(len(e.cut), bool)
    while len(over := e.still()):
        now = e.now
        need = np.abs(now[over]) - e.most[over]
        relief = e.relief(e.v, over, now)
        merit = np.where((e.left > NOISE) & ~blocked, RANKS[rank](relief, need, int(need.argmax())), -np.inf)
        bus = int(merit.argmax())
        if merit[bus] <= MEMBER:
            break
        room = min(e.left[bus], e.room(e.v[:, bus], now)) if veto else e.left[bus]
        if room <= NOISE:
            blocked[bus] = True
            continue
        helps = relief[:, bus] > 1e-9
        want = float((need[helps] / relief[helps, bus]).min()) if helps.any() else room
        e.cut[bus] += min(room, max(want, 1e-4))
        blocked[:] = False
    return "done"


def _stale(e: Event, roster_only: bool = False) -> str:
    """Groups drawn from the intact network: membership by its factors and the flows before any cut. Ranking and step
    follow the same factors, or the true ones if only the roster is stale; flows always follow the true ones."""
    old = e.intact if e.intact is not None else e.v
    while len(over := e.still()):
        now = e.now
        need = np.abs(now[over]) - e.most[over]
        worst = over[[int(need.argmax())]]
        listed = e.relief(old, worst, e.flow)[0]
        use = e.relief(e.v, worst, now)[0] if roster_only else listed
        merit = np.where((listed >= MEMBER) & (e.left > NOISE), use, -np.inf)
        bus = int(merit.argmax())
        if merit[bus] <= MEMBER:
            break
        e.cut[bus] += min(e.left[bus], max(need.max() / use[bus], 1e-4))
    return "done"


def _grouped(e: Event, net: bool = False, veto: bool = False) -> str:
    """Groups dispatched as units: every violated branch has one, its members in proportion to what they have left. The
    unit to move is the worst branch's, or the one that takes most off all violated branches for a MW."""
    blocked: set[int] = set()
    while len(over := e.still()):
        now = e.now
        need = np.abs(now[over]) - e.most[over]
        relief = e.relief(e.v, over, now)
        units = {}
        for k, branch in enumerate(over):
            share = e.left * ((relief[k] >= MEMBER) & (e.left > NOISE))
            if share.sum() > NOISE and int(branch) not in blocked:
                units[k] = share / share.sum(), share.sum()
        if not units:
            break
        merit = (lambda k: float((need @ relief @ units[k][0]) / need.sum())) if net else (lambda k: float(need[k]))
        k = max(units, key=merit)
        way, most = units[k]
        takes = float(relief[k] @ way)
        room = min(most, e.room(e.v @ way, now)) if veto else most
        if room <= NOISE or takes <= 1e-9:
            blocked.add(int(over[k]))
            continue
        e.cut += way * min(room, max(need[k] / takes, 1e-4))
        blocked.clear()
    return "done"


def _least_mw(e: Event) -> str:
    """The least MW that ends with every live branch within its limit; where none does, the least residual on the violated
    branches that breaks no other. Branches that no cut can bring to their limit are left out of the program."""
    reach = np.abs(e.v) @ e.available
    rows = np.flatnonzero(e.live & ((np.abs(e.flow) + reach > e.most - 1e-9) | np.isin(np.arange(len(e.flow)), e.over)))
    may = np.flatnonzero(e.available > NOISE)
    n, v = len(may), e.v[np.ix_(rows, may)]
    a, room = np.vstack([v, -v]), np.concatenate([e.most[rows] - e.flow[rows], e.most[rows] + e.flow[rows]])
    bounds = np.eye(n), e.available[may]
    status, x = simplex(np.ones(n), np.vstack([a, bounds[0]]), np.concatenate([room, bounds[1]]))
    if status == "optimal":
        e.cut[may] += np.clip(x, 0, bounds[1])
        return "least"
    slack = np.array([rows == k for k in e.over], float).T
    a2 = np.vstack([np.hstack([a, -np.vstack([slack, slack])]), np.hstack([bounds[0], np.zeros((n, len(e.over)))])])
    status, x = simplex(np.concatenate([np.zeros(n), np.ones(len(e.over))]), a2, np.concatenate([room, bounds[1]]))
    if status != "optimal":
        return "none"
    e.cut[may] += np.clip(x[:n], 0, bounds[1])
    return "closest"


ARMS: dict[str, Callable[[Event], str]] = {
    "prorata": _prorata,
    "greedy": lambda e: _greedy(e, "sum"),
    "worst": lambda e: _greedy(e, "worst"),
    "need": lambda e: _greedy(e, "need"),
    "minmax": lambda e: _greedy(e, "minmax"),
    "veto": lambda e: _greedy(e, "sum", veto=True),
    "stale": _stale,
    "stale roster": lambda e: _stale(e, roster_only=True),
    "group": _grouped,
    "group net veto": lambda e: _grouped(e, net=True, veto=True),
    "lp": _least_mw,
}


def remedy(arm: str, event: Event) -> tuple[str, np.ndarray]:
    """Status and MW cut at each bus by one arm. Every arm runs until nothing is over or no bus is left that helps."""
    event.cut = np.zeros(len(event.available))
    return ARMS[arm](event), event.cut


def _events(net: Net, p: pd.DataFrame, outages: list[int]):
    """(outage, event) for each outage that leaves the network whole and a branch over its limit."""
    inject, available, load = (net.vector(p, c) for c in ("p", "available", "load"))
    intact = hosted_cut(net.ptdf, load)
    before = net.ptdf @ inject
    for e in outages:
        live = np.ones(len(net.b), bool)
        live[e] = False
        flow = net.outage_flow(e, before, inject)
        if flow is not None and ((np.abs(flow) > net.limit * OVER) & live).any():
            yield e, Event(flow, net.limit, hosted_cut(net.outage(e), load), available, live, intact)


SCORED = "case string, outage string, arm string, status string, n_over long, cut_mw double, nodes long, cleared boolean, new long, worsened long, residual double, worst_loading double"


def remedies(branches: DataFrame, injections: DataFrame, arms: tuple[str, ...] = ("prorata", "greedy", "veto", "lp")) -> DataFrame:
    """A row for each arm and each outage with an overload: status (`least` and `closest` of the linear program, `none`
    where it found neither), overloads, MW and buses cut, whether all are cleared, branches newly over, made worse, MW
    still over, highest loading.

    injections: case, bus, p, available (MW that may be cut), load (weights of the reference)."""

    def run(case, net: Net, p: pd.DataFrame, outages: list[int]) -> pd.DataFrame:
        rows = []
        for e, event in _events(net, p, outages):
            was = np.abs(event.flow)
            for arm in arms:
                status, cut = remedy(arm, event)
                now = np.abs(event.now)
                hot, was_hot = (now > event.most + MARGIN) & event.live, (was > event.most + MARGIN) & event.live
                left = event.over[now[event.over] > event.most[event.over] + MARGIN]
                rows.append((
                    case, net.branches["name"][e], arm, status, len(event.over), float(cut.sum()), int((cut > NOISE).sum()), not len(left), int((hot & ~was_hot).sum()),
                    int((was_hot & (now > was + MARGIN)).sum()), float((now[left] - event.limit[left]).sum()), float((now / event.limit)[event.live].max()),
                ))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCORED.split(", ")])

    return by_outages(branches, injections, run, SCORED)


def remedy_cuts(branches: DataFrame, injections: DataFrame, arm: str = "veto") -> DataFrame:
    """The table to look a remedy up in: case, outage, bus, available, cut, for every outage with an overload."""

    def run(case, net: Net, p: pd.DataFrame, outages: list[int]) -> pd.DataFrame:
        out = []
        for e, event in _events(net, p, outages):
            _, cut = remedy(arm, event)
            out.append(pd.DataFrame({"case": case, "outage": net.branches["name"][e], "bus": net.buses, "available": event.available, "cut": cut}))
        return pd.concat(out) if out else pd.DataFrame(columns=["case", "outage", "bus", "available", "cut"])

    return by_outages(branches, injections, run, "case string, outage string, bus long, available double, cut double")


def usage(cuts: DataFrame) -> DataFrame:
    """Use of each bus over all events: events that cut it, MW cut and offered, shares."""
    g = cuts.groupBy("case", "bus").agg(F.count("*").alias("events"), F.count_if(F.col("cut") > NOISE).alias("cut_events"), F.sum("cut").alias("cut_mw"), F.sum("available").alias("offered_mw"))
    return g.withColumn("cut_share", F.col("cut_events") / F.col("events")).withColumn("kept_share", 1 - F.col("cut_mw") / F.nullif("offered_mw", F.lit(0.0)))


def demand_at_risk(net: Net, alive: np.ndarray, p: np.ndarray) -> float:
    """MW of demand beyond the generation of its island, over the islands; 0 if none has come about."""
    parts: dict = {}
    live = Net(net.branches[alive]) if alive.any() else None
    group = dict(zip(live.buses, live.parts())) if live else {}
    for bus, x in zip(net.buses, p):
        parts.setdefault(group.get(bus, ("alone", bus)), []).append(x)
    return float(sum(max(0.0, -sum(x)) for x in parts.values())) if len(parts) > len(set(net.parts())) else 0.0


CASCADE = "case string, start string, arm string, lost long, rounds long, cut_mw double, islanded boolean, runaway boolean, demand_at_risk double"


def cascades(branches: DataFrame, injections: DataFrame, arms: tuple[str, ...] = ("nothing", "prorata", "veto", "lp")) -> DataFrame:
    """What follows the loss of each branch: in a round the flows are solved, the arm cuts, and every branch that is still
    over is lost too, until nothing is over, the network splits, or more than RUNAWAY branches are lost."""

    def run(case, net: Net, p: pd.DataFrame, outages: list[int]) -> pd.DataFrame:
        inject, available, load = (net.vector(p, c) for c in ("p", "available", "load"))
        w, whole, rows = load / load.sum(), len(set(net.parts())), []
        for start in outages:
            for arm in arms:
                alive, cut = np.ones(len(net.b), bool), np.zeros(len(net.buses))
                alive[start] = False
                rounds, islanded, runaway = 0, False, False
                while True:
                    runaway = int((~alive).sum()) > RUNAWAY
                    islanded = not runaway and _parts(net, alive) > whole
                    if runaway or islanded:
                        break
                    b = np.where(alive, net.b, 0.0)
                    ptdf = b[:, None] * (net.k.T @ np.linalg.pinv((net.k * b) @ net.k.T, hermitian=True))
                    event = Event(ptdf @ (inject - cut + cut.sum() * w), net.limit, hosted_cut(ptdf, load), np.maximum(available - cut, 0), alive)
                    event.over = np.flatnonzero((np.abs(event.flow) > event.most + MARGIN) & alive)
                    if not len(event.over):
                        break
                    rounds += 1
                    if arm != "nothing":
                        cut = cut + remedy(arm, event)[1]
                    lost = (np.abs(event.now) > event.most + MARGIN) & alive
                    if not lost.any():
                        break
                    alive &= ~lost
                risk = demand_at_risk(net, alive, inject - cut + cut.sum() * w)
                rows.append((case, net.branches["name"][start], arm, int((~alive).sum()) - 1, rounds, float(cut.sum()), islanded, runaway, risk))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CASCADE.split(", ")])

    return by_outages(branches, injections, run, CASCADE, 16)


def _parts(net: Net, alive: np.ndarray) -> int:
    """Number of components over all buses with some branches out."""
    root = np.arange(len(net.buses))
    ends = np.array(net.ends)[alive]
    while True:  # the least label of both ends, until nothing changes
        before = root.copy()
        low = np.minimum(root[ends[:, 0]], root[ends[:, 1]])
        np.minimum.at(root, ends[:, 0], low)
        np.minimum.at(root, ends[:, 1], low)
        root = root[root]
        if (root == before).all():
            return len(set(root.tolist()))


def reinforcement(branches: DataFrame, injections: DataFrame, factor: float = 1.5, most: int = 25) -> DataFrame:
    """case, round, branch, loading, s_nom, status: the worst branch is upgraded until nothing is overloaded. The last
    row's status tells how it ended: `clear`, `stalled` (the worst loading has not fallen for as many rounds as there are
    branches) or `capped` (`most` upgrades, the plan's budget); all others have `upgraded`. A case without an overload has
    no row."""

    def run(case, b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        b, rows, best, since = b.copy(), [], np.inf, 0
        while True:
            n = Net(b)
            load = np.abs(n.ptdf @ n.vector(p)) / n.limit
            e = int(np.argmax(load))
            since, best = (0, load[e]) if load[e] < best - 1e-9 else (since + 1, best)
            status = "clear" if load[e] <= OVER else "stalled" if since > len(b) else "capped" if len(rows) >= most else None
            if status:
                break
            name = n.branches["name"][e]
            b.loc[b["name"] == name, ["s_nom", "b"]] *= factor
            rows.append([case, len(rows) + 1, name, float(load[e]), float(n.limit[e] * factor), "upgraded"])
        if rows:
            rows[-1][-1] = status
        return pd.DataFrame(rows, columns=["case", "round", "branch", "loading", "s_nom", "status"])

    return with_case(branches, injections, run, "case string, round long, branch string, loading double, s_nom double, status string")
