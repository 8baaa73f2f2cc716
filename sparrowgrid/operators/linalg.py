"""Linear network operators in coordinate form: incidence, PTDF, flows, shift factors, outages.

A branch table has name, bus0, bus1, b (susceptance) and s_nom. What is a sum over a join (injections, flows,
factors against a reference) stays relational; the pseudoinverse of a Laplacian is one dense kernel per case.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BUSES = 2000
MOST_BRANCHES = 4 * MOST_BUSES
OUTAGES = 64  # of one task


class Net:
    """Dense matrices of one case, for use inside a kernel."""

    def __init__(self, branches: pd.DataFrame):
        self.branches = branches.sort_values("name", ignore_index=True)
        self.buses = sorted(set(branches["bus0"]) | set(branches["bus1"]))
        if len(self.buses) > MOST_BUSES:
            raise ValueError(f"a dense case takes at most {MOST_BUSES} buses")
        at = {b: i for i, b in enumerate(self.buses)}
        self.k = np.zeros((len(self.buses), len(branches)))  # incidence
        self.ends = [(at[x], at[y]) for x, y in zip(self.branches["bus0"], self.branches["bus1"])]
        for e, (x, y) in enumerate(self.ends):
            self.k[x, e] += 1
            self.k[y, e] -= 1
        self.b = self.branches["b"].to_numpy(float)
        self.limit = self.branches["s_nom"].to_numpy(float)
        self.laplacian = (self.k * self.b) @ self.k.T
        self.inverse = np.linalg.pinv(self.laplacian, hermitian=True)
        self.ptdf = self.b[:, None] * (self.k.T @ self.inverse)

    def vector(self, injections: pd.DataFrame, column: str = "p") -> np.ndarray:
        p = injections.groupby("bus")[column].sum()
        return np.array([float(p.get(b, 0.0)) for b in self.buses])

    def shift(self) -> np.ndarray:
        """Angles of phase shifters (column phi, 0 where it is absent or null)."""
        return self.branches["phi"].fillna(0.0).to_numpy(float) if "phi" in self.branches else np.zeros(len(self.b))

    def theta(self, p: np.ndarray) -> np.ndarray:
        """Bus angles; a shifter acts like a pair of injections at its ends."""
        return self.inverse @ (p + self.k @ (self.b * self.shift()))

    def flow(self, p: np.ndarray) -> np.ndarray:
        return self.b * (self.k.T @ self.theta(p) - self.shift())

    def parts(self, without: int | None = None) -> np.ndarray:
        """Component number of each bus, with one branch out."""
        root = list(range(len(self.buses)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for e, (x, y) in enumerate(self.ends):
            if e != without:
                root[find(x)] = find(y)
        return np.array([find(i) for i in range(len(root))])

    @cached_property
    def transfer(self) -> np.ndarray:
        """Flow on each branch for 1 MW sent from end to end of each other, branch by branch."""
        return self.ptdf @ self.k

    def share_left(self, e: int) -> float:
        """The part of a transfer between a branch's ends that does not take the branch itself; 0 for a bridge."""
        return 1 - float(self.transfer[e, e])

    def splits(self, e: int) -> bool:
        """Whether the loss of a branch splits the network."""
        return self.share_left(e) <= 1e-3 and len(set(self.parts(e))) > len(set(self.parts()))

    def outage(self, e: int) -> np.ndarray | None:
        """PTDF after the loss of a branch, by an exact rank-one update; None where it splits the network."""
        if self.splits(e):
            return None
        rest = self.share_left(e)
        if rest <= 1e-3:
            return self.rebuilt(e)
        out = self.ptdf + np.outer(self.transfer[:, e] / rest, self.ptdf[e])
        out[e] = 0
        return out

    def outage_flow(self, e: int, flow: np.ndarray, p: np.ndarray) -> np.ndarray | None:
        """Flows after the loss of a branch from those before: its own flow takes the other ways."""
        if self.splits(e):
            return None
        rest = self.share_left(e)
        if rest <= 1e-3:
            return self.rebuilt(e) @ p
        out = flow + self.transfer[:, e] * (flow[e] / rest)
        out[e] = 0
        return out

    def rebuilt(self, e: int) -> np.ndarray:
        """The same by a new pseudoinverse."""
        b = self.b.copy()
        b[e] = 0
        return b[:, None] * (self.k.T @ np.linalg.pinv((self.k * b) @ self.k.T, hermitian=True))

    def susceptibility(self, p: np.ndarray) -> np.ndarray:
        """d flow / d susceptance, branch by branch."""
        a = self.k.T @ (self.inverse @ p)
        return np.diag(a) - self.b[:, None] * (self.k.T @ self.inverse @ self.k) * a[None, :]


def _checked(branches: DataFrame) -> DataFrame:
    """Raises for a case that is too large for a dense kernel, before any worker is given its rows."""
    n = F.count("*").over(Window.partitionBy("case"))
    bad = F.when(n > MOST_BRANCHES, F.raise_error(F.concat(F.lit(f"a dense case takes at most {MOST_BRANCHES} branches: "), "case")))
    return branches.withColumn("__bad", bad).filter("__bad IS NULL").drop("__bad")


def _by_case(df: DataFrame, f, schema: str) -> DataFrame:
    return _checked(df).groupBy("case").applyInPandas(f, schema)


def with_case(branches: DataFrame, injections: DataFrame, f, schema: str) -> DataFrame:
    """f(case, branches, injections) for each case."""
    return _checked(branches).groupBy("case").cogroup(injections.groupBy("case")).applyInPandas(lambda key, b, p: f(key[0], b, p), schema)


def by_outages(branches: DataFrame, injections: DataFrame, f, schema: str, per_task: int = OUTAGES) -> DataFrame:
    """f(case, net, injections, outages) for runs of a case's outages (numbers of its branches by name), so that one large
    case keeps many tasks busy. Each task solves the intact case once."""
    b = _checked(branches).withColumn("__parts", F.ceil(F.count("*").over(Window.partitionBy("case")) / per_task).cast("int"))
    parts = b.groupBy("case").agg(F.max("__parts").alias("n")).select("case", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    each = b.join(parts, "case")

    def run(key, bs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        net = Net(bs.drop(columns=["__parts", "part"]))
        mine = [e for e in range(len(net.b)) if e % int(bs["__parts"].iloc[0]) == key[1]]
        return f(key[0], net, ps, mine)

    ps = injections.join(parts.select(F.col("case").alias("c"), F.col("part").alias("p_part")), F.col("case") == F.col("c")).drop("c").withColumnRenamed("p_part", "part")
    return each.groupBy("case", "part").cogroup(ps.groupBy("case", "part")).applyInPandas(run, schema)


def balanced(branches: DataFrame, injections: DataFrame) -> DataFrame:
    """Injections (case, bus, p and further columns) of the buses that the branches reach, each less the mean of its
    component: what flows can carry."""

    def run(case, b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        root = {x: x for x in [*b["bus0"], *b["bus1"]]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(b["bus0"], b["bus1"]):
            root[find(x)] = find(y)
        p = p[p["bus"].isin(set(root))].copy()
        p["p"] -= p.groupby(p["bus"].map(find))["p"].transform("mean")
        return p

    return with_case(branches, injections, run, injections.schema.simpleString()[7:-1].replace(":", " "))


def incidence(branches: DataFrame) -> DataFrame:
    """(bus, branch, v) with +1 at bus0 and -1 at bus1."""
    return branches.select(F.col("bus0").alias("bus"), F.col("name").alias("branch"), F.lit(1).alias("v")).unionByName(branches.select(F.col("bus1").alias("bus"), F.col("name").alias("branch"), F.lit(-1).alias("v")))


def ptdf(branches: DataFrame) -> DataFrame:
    """case, branch, bus, v: flow on the branch for 1 MW injected at the bus and spread over all buses."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = Net(pdf)
        e, i = n.ptdf.shape
        return pd.DataFrame({"case": pdf["case"].iloc[0], "branch": np.repeat(n.branches["name"].to_numpy(), i), "bus": n.buses * e, "v": n.ptdf.ravel()})

    return _by_case(branches, run, "case string, branch string, bus long, v double")


def flows(factors: DataFrame, injections: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Flow on each branch: factors (case, branch, bus, v) times injections (bus, p and further keys)."""
    return factors.join(injections, "bus").groupBy("case", "branch", *(by or [])).agg(F.sum(F.col("v") * F.col("p")).alias("flow"))


def angles(branches: DataFrame, injections: DataFrame) -> DataFrame:
    """case, bus, theta of the linear power flow; branches may have a column phi (phase shifters)."""

    def run(case, b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        n = Net(b)
        return pd.DataFrame({"case": case, "bus": n.buses, "theta": n.theta(n.vector(p))})

    return with_case(branches, injections, run, "case string, bus long, theta double")


def angle_flows(branches: DataFrame, injections: DataFrame) -> DataFrame:
    """case, branch, flow, loading from bus angles, phase shifters included."""
    t = angles(branches, injections)
    j = branches.join(t.toDF("case", "bus0", "t0"), ["case", "bus0"]).join(t.toDF("case", "bus1", "t1"), ["case", "bus1"])
    phi = F.coalesce("phi", F.lit(0.0)) if "phi" in branches.columns else F.lit(0.0)
    j = j.withColumn("flow", F.col("b") * (F.col("t0") - F.col("t1") - phi))
    return j.select("case", F.col("name").alias("branch"), "flow", (F.abs("flow") / F.nullif("s_nom", F.lit(0.0))).alias("loading"))


def shift_factors(factors: DataFrame, reference: DataFrame) -> DataFrame:
    """Factors against a weighted reference (bus, w): less the weighted mean of each branch."""
    mean = factors.join(reference, "bus").groupBy("case", "branch").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    return factors.join(mean, ["case", "branch"]).select("case", "branch", "bus", (F.col("v") - F.col("m")).alias("v"))


def bus_reference(factors: DataFrame, reference: DataFrame) -> DataFrame:
    """Factors against one bus of each case (case, bus): less the factor of that bus."""
    at = factors.join(reference.select("case", "bus"), ["case", "bus"]).select("case", "branch", F.col("v").alias("m"))
    return factors.join(at, ["case", "branch"]).select("case", "branch", "bus", (F.col("v") - F.col("m")).alias("v"))


def relative_effectiveness(factors: DataFrame, capacity: DataFrame, least: float = 0.05) -> DataFrame:
    """Factors of the fleet's buses less the capacity-weighted mean on each line; those of at least `least` in size."""
    w = Window.partitionBy("case", "branch")
    j = factors.join(capacity, "bus")
    mean: Column = F.sum(F.col("v") * F.col("capacity")).over(w) / F.sum("capacity").over(w)
    return j.withColumn("effect", F.col("v") - mean).filter(F.abs("effect") >= least).select("case", "branch", "bus", "effect")


def outage_errors(branches: DataFrame) -> DataFrame:
    """Per case and outage: whether it splits the network, and the largest difference of update and rebuild."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = Net(pdf)
        rows = []
        for e, name in enumerate(n.branches["name"]):
            out = n.outage(e)
            rows.append((pdf["case"].iloc[0], name, out is None, None if out is None else float(np.abs(out - n.rebuilt(e)).max())))
        return pd.DataFrame(rows, columns=["case", "outage", "islands", "error"])

    return _by_case(branches, run, "case string, outage string, islands boolean, error double")


def outage_flows(branches: DataFrame, injections: DataFrame, per_task: int = OUTAGES) -> DataFrame:
    """case, outage, branch, before, after, s_nom for every outage that leaves the network whole."""

    def run(case, n: Net, p: pd.DataFrame, outages: list[int]) -> pd.DataFrame:
        v, frames = n.vector(p), []
        before, names = n.ptdf @ v, n.branches["name"]
        for e in outages:
            after = n.outage_flow(e, before, v)
            if after is not None:
                frames.append(pd.DataFrame({"case": case, "outage": names[e], "branch": names, "before": before, "after": after, "s_nom": n.limit}))
        return pd.concat(frames) if frames else pd.DataFrame(columns=["case", "outage", "branch", "before", "after", "s_nom"])

    return by_outages(branches, injections, run, "case string, outage string, branch string, before double, after double, s_nom double", per_task)


def susceptibility(branches: DataFrame, injections: DataFrame, step: float = 1e-5) -> DataFrame:
    """case, branch, changed, v: d flow of branch / d susceptance of changed; fd: the same by a finite difference."""

    def run(case, b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        n = Net(b)
        v = n.vector(p)
        s, rows = n.susceptibility(v), []
        for j, changed in enumerate(n.branches["name"]):
            more = n.branches.copy()
            more.loc[j, "b"] += step
            fd = (Net(more).ptdf @ v - n.ptdf @ v) / step
            rows.append(pd.DataFrame({"case": case, "branch": n.branches["name"], "changed": changed, "v": s[:, j], "fd": fd}))
        return pd.concat(rows)

    return with_case(branches, injections, run, "case string, branch string, changed string, v double, fd double")


def candidates(susceptible: DataFrame, flows_: DataFrame) -> DataFrame:
    """Reinforcement candidates of each branch: the changes that relieve it, the strongest first. What susceptibility()
    gives, and flows (case, branch, flow): case, branch, changed, relief (MW off the flow for 1 of susceptance), rank."""
    relief = -F.when(F.col("flow") < 0, -F.col("v")).otherwise(F.col("v"))
    d = susceptible.join(flows_.select("case", "branch", "flow"), ["case", "branch"]).withColumn("relief", relief)
    rank = F.row_number().over(Window.partitionBy("case", "branch").orderBy(F.abs("relief").desc(), "changed"))
    return d.withColumn("rank", rank).select("case", "branch", "changed", "relief", "rank")


def pass_through(links: DataFrame, terminals: DataFrame) -> DataFrame:
    """HVDC links (name, bus0, p_min, p_max, loss) with a far terminal each (name, bus1): an import and an export pair of
    units at the near bus, and the far bus they trade with. One direction only where the other has no room."""
    j = links.join(terminals, "name", "left")
    pair = F.array(
        F.struct(F.lit("import").alias("side"), F.greatest(F.lit(0.0), "p_max").alias("p_nom"), (1 - F.coalesce("loss", F.lit(0.0))).alias("efficiency")),
        F.struct(F.lit("export").alias("side"), F.greatest(F.lit(0.0), -F.col("p_min")).alias("p_nom"), (1 - F.coalesce("loss", F.lit(0.0))).alias("efficiency")),
    )
    d = j.select("name", F.col("bus0").alias("bus"), "bus1", F.explode(pair).alias("u")).filter("u.p_nom > 0")
    return d.select(F.concat_ws(" ", "name", "u.side").alias("unit"), "bus", F.coalesce("bus1", F.concat(F.lit("far:"), "name")).alias("far_bus"), "u.side", "u.p_nom", "u.efficiency")


def released(units: DataFrame, set_points: list[str]) -> DataFrame:
    """The network with its dispatch released: set-points become NULL, everything else stays."""
    return units.select(*[F.lit(None).cast(units.schema[c].dataType).alias(c) if c in set_points else F.col(c) for c in units.columns])


def placed(buses: DataFrame, x: str = "x", y: str = "y", source: str = "coordinate_source") -> DataFrame:
    """Buses with coordinates: not NULL, not (0, 0), and from some source."""
    return buses.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~((F.col(x) == 0) & (F.col(y) == 0)) & (F.coalesce(F.col(source), F.lit("none")) != "none"))


def star_legs(three: DataFrame) -> DataFrame:
    """Three-winding units (name, bus1, bus2, bus3, r12, x12, r23, x23, r31, x31) as three legs to a star bus. A leg's
    reactance may be negative and stays so."""
    half = lambda a, b, c: (F.col(a) + F.col(b) - F.col(c)) / 2
    leg = lambda i, x, y, z: F.struct(F.lit(i).alias("leg"), F.col(f"bus{i}").alias("bus"), half(f"r{x}", f"r{y}", f"r{z}").alias("r"), half(f"x{x}", f"x{y}", f"x{z}").alias("x"))
    return three.select("name", F.concat(F.lit("star:"), "name").alias("star"), F.explode(F.array(leg(1, "12", "31", "23"), leg(2, "12", "23", "31"), leg(3, "23", "31", "12"))).alias("l")).select("name", "star", "l.*")
