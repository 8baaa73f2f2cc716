"""Linear power flow of networks of any size: preconditioned conjugate gradients over the edge table.

A case's Laplacian is never made: its product with a vector is a join of the vector with the branches and a sum at each
bus. Any number of right-hand sides, of any number of cases, go through one iteration together; each has its own step
lengths and stands still once it has converged. An iteration takes one product and one sum over each vector (the form
of Chronopoulos and Gear, in which both inner products are worked out at once)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, saved

TOLERANCE = 1e-10  # of the largest residual, in proportion to the largest right-hand side


def _ends(branches: DataFrame) -> DataFrame:
    """case, a, b, w for both directions; parallel branches add up, loops and branches without susceptance go."""
    e = branches.filter("bus0 <> bus1 AND b <> 0").select("case", F.col("bus0").alias("a"), F.col("bus1").alias("b"), F.col("b").cast("double").alias("w"))
    return e.union(e.select("case", "b", "a", "w")).groupBy("case", "a", "b").agg(F.sum("w").alias("w"))


def islands(branches: DataFrame) -> DataFrame:
    """case, bus, island: the parts of each case, named by their smallest bus."""
    e = _ends(branches)
    node = lambda c: F.struct("case", F.col(c).alias("bus"))
    nodes = e.select(node("a").alias("node")).distinct()
    c = components(nodes, e.select(node("a").alias("a"), node("b").alias("b")))
    return c.select("node.case", "node.bus", F.col("component.bus").alias("island"))


def level(values: DataFrame, parts: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """`column` (of case, bus and keys) less its mean over each island and value of the keys."""
    v = values.join(parts, ["case", "bus"])
    mean = v.groupBy("case", "island", *keys).agg(F.avg(column).alias("__m"))
    return v.join(mean, ["case", "island", *keys]).withColumn(column, F.col(column) - F.col("__m")).drop("__m", "island")


def potentials(branches: DataFrame, loads: DataFrame, tolerance: float = TOLERANCE, most: int | None = None) -> DataFrame:
    """case, k, bus, theta, residual: solutions of (Laplacian of the case) theta = p, for p in loads (case, k, bus, p).

    Susceptances must be positive. Loads at buses without a branch are ignored, a bus without a row has 0, and what an
    island does not balance is spread evenly over its buses; the solution's mean is 0 on every island, as with the
    pseudoinverse. The residual is the largest of all buses. `most` ends the search after that many rounds (unset: twice
    the number of buses, where exact arithmetic needs no more than once); residuals say how far it came."""
    e = saved(_ends(branches))
    parts = saved(islands(branches))
    degree = e.groupBy("case", F.col("a").alias("bus")).agg(F.sum("w").alias("degree"))
    ks = loads.select("case", "k").distinct()
    p = loads.groupBy("case", "k", "bus").agg(F.sum("p").alias("p"))
    full = degree.join(ks, "case").join(p, ["case", "k", "bus"], "left").withColumn("r", F.coalesce("p", F.lit(0.0))).drop("p")
    full = saved(level(full, parts, "r", ["k"]))
    goal = full.groupBy("case", "k").agg((tolerance * F.max(F.abs("r"))).alias("goal"))
    zero = F.lit(0.0)
    state = saved(full.join(goal, ["case", "k"]).select("case", "k", "bus", "degree", "r", "goal", zero.alias("x"), zero.alias("p"), zero.alias("s"), zero.alias("gamma"), zero.alias("alpha"), F.lit(False).alias("done")))
    most = most or 2 * (parts.groupBy("case").count().agg(F.max("count")).first()[0] or 0)
    for _ in range(most):
        if state.filter("NOT done").isEmpty():
            break
        z = state.filter("NOT done").select("case", "k", F.col("bus").alias("b"), (F.col("r") / F.col("degree")).alias("z"))
        near = e.join(z, ["case", "b"]).groupBy("case", "k", F.col("a").alias("bus")).agg(F.sum(F.col("w") * F.col("z")).alias("t"))
        w = state.join(near, ["case", "k", "bus"], "left").withColumn("z", F.col("r") / F.col("degree")).withColumn("w", F.col("r") - F.coalesce("t", zero))
        sums = w.groupBy("case", "k").agg(
            F.sum(F.col("r") * F.col("z")).alias("g"), F.sum(F.col("w") * F.col("z")).alias("d"), F.max("gamma").alias("g0"), F.max("alpha").alias("a0"),
            (F.bool_or("done") | (F.max(F.abs("r")) <= F.max("goal"))).alias("stop"),
        )
        beta = F.when(F.col("g0") == 0, zero).otherwise(F.col("g") / F.col("g0"))
        step = F.col("g") / F.when(F.col("g0") == 0, F.col("d")).otherwise(F.col("d") - F.col("beta") * F.col("g") / F.col("a0"))
        sums = sums.withColumn("beta", F.when(~F.col("stop"), beta)).withColumn("step", F.when(~F.col("stop"), step))
        n = w.join(sums, ["case", "k"])
        pick = lambda new, old: F.when(F.col("stop"), F.col(old)).otherwise(new)
        n = n.withColumn("p", pick(F.col("z") + F.col("beta") * F.col("p"), "p")).withColumn("s", pick(F.col("w") + F.col("beta") * F.col("s"), "s"))
        n = n.withColumn("x", pick(F.col("x") + F.col("step") * F.col("p"), "x")).withColumn("r", pick(F.col("r") - F.col("step") * F.col("s"), "r"))
        state = saved(n.select("case", "k", "bus", "degree", "r", "goal", "x", "p", "s", pick(F.col("g"), "gamma").alias("gamma"), pick(F.col("step"), "alpha").alias("alpha"), F.col("stop").alias("done")))
    out = state.groupBy("case", "k").agg(F.max(F.abs("r")).alias("residual"))
    return level(state.select("case", "k", "bus", F.col("x").alias("theta")), parts, "theta", ["k"]).join(out, ["case", "k"]).select("case", "k", "bus", "theta", "residual")


def angles(branches: DataFrame, injections: DataFrame, **options) -> DataFrame:
    """case, bus, theta of the linear power flow for injections (case, bus, p); a phase shifter (column phi of branches, null
    or 0 without) acts like a pair of injections at its ends."""
    p = injections.select("case", "bus", "p")
    if "phi" in branches.columns:
        bent = branches.filter("phi <> 0").select("case", "bus0", "bus1", (F.col("b") * F.col("phi")).alias("p"))
        p = p.union(bent.select("case", "bus0", "p")).union(bent.select("case", "bus1", -F.col("p")))
    return potentials(branches, p.withColumn("k", F.lit(0)), **options).select("case", "bus", "theta")


def branch_flows(branches: DataFrame, theta: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """case, branch, flow, loading (and keys) from bus angles, phase shifters included."""
    keys = keys or []
    at = lambda end, name: theta.select("case", F.col("bus").alias(end), *keys, F.col("theta").alias(name))
    j = branches.join(at("bus0", "t0"), ["case", "bus0"]).join(at("bus1", "t1"), ["case", "bus1", *keys])
    phi = F.coalesce("phi", F.lit(0.0)) if "phi" in branches.columns else F.lit(0.0)
    j = j.withColumn("flow", F.col("b") * (F.col("t0") - F.col("t1") - phi))
    return j.select("case", F.col("name").alias("branch"), *keys, "flow", (F.abs("flow") / F.nullif("s_nom", F.lit(0.0))).alias("loading"))


def ptdf(branches: DataFrame, buses: DataFrame | None = None, **options) -> DataFrame:
    """case, branch, bus, v: flow on the branch for 1 MW injected at the bus and spread over all buses of its island, for all
    buses or those of a table (case, bus). A right-hand side a bus, all in one solve."""
    every = _ends(branches).select("case", F.col("a").alias("bus")).distinct()
    some = every if buses is None else every.join(buses, ["case", "bus"], "left_semi")
    t = potentials(branches, some.select("case", F.col("bus").alias("k"), "bus", F.lit(1.0).alias("p")), **options)
    return branch_flows(branches.drop("phi"), t.select("case", "k", "bus", "theta"), ["k"]).select("case", "branch", F.col("k").alias("bus"), F.col("flow").alias("v"))


def susceptibility(branches: DataFrame, injections: DataFrame, **options) -> DataFrame:
    """case, branch, changed, v: d flow of branch / d susceptance of changed, from one solve with a right-hand side a branch:
    a change acts like a transfer between the branch's ends, of the angle across it."""
    across = branch_flows(branches.drop("phi"), angles(branches.drop("phi"), injections, **options))
    across = branches.select("case", F.col("name").alias("branch"), "b", "bus0", "bus1").join(across, ["case", "branch"]).select("case", "branch", "bus0", "bus1", (F.col("flow") / F.col("b")).alias("angle"))
    across = saved(across)
    pairs = across.select("case", F.col("branch").alias("k"), "bus0", "bus1")
    loads = pairs.select("case", "k", F.col("bus0").alias("bus"), F.lit(1.0).alias("p")).union(pairs.select("case", "k", "bus1", F.lit(-1.0)))
    t = potentials(branches.drop("phi"), loads, **options)
    f = branch_flows(branches.drop("phi"), t.select("case", "k", "bus", "theta"), ["k"])
    j = f.join(across.select("case", F.col("branch").alias("k"), "angle"), ["case", "k"])
    own = F.when(F.col("branch") == F.col("k"), 1.0).otherwise(0.0)
    return j.select("case", "branch", F.col("k").alias("changed"), ((own - F.col("flow")) * F.col("angle")).alias("v"))
