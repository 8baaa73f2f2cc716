"""Graphs as edge tables (a, b, w): adjacency, Laplacians, components, attachment, cuts, and bounded kernels.

Relational steps are joins and aggregations; what needs a whole small network at once (spectra, cut trees) runs as one
grouped pandas call per network, which checks its size first. Spanning trees and bridges are in forest.py, shortest
paths in paths.py.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import runner_up, top

MOST_NODES = 2000
MOST_ROWS = 1_000_000
_saved: list[tuple[SparkSession, str]] = []


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in spark.checkpoint.dir (a temporary folder where it is unset, locally). A table that is
    read back has a known size and brings no constraints along, which rounds of self-joins would double each time."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="sparrowgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _saved.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _saved:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


def kernel(df: DataFrame, f, schema: str, by: str | None = None) -> DataFrame:
    """f(pandas frame of one network) for each value of `by`, or once. Networks of more than MOST_ROWS rows are refused
    before a worker is given any, and those of more than MOST_NODES nodes by the worker."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = [c for c in ("a", "b") if c in pdf.columns]
        if ends and len(pd.unique(pdf[ends].to_numpy().ravel())) > MOST_NODES:
            raise ValueError(f"a kernel takes at most {MOST_NODES} nodes")
        return f(pdf)

    df = df if by else df.withColumn("__one", F.lit(0))
    n = F.count("*").over(Window.partitionBy(by or "__one"))
    df = df.withColumn("__bad", F.when(n > MOST_ROWS, F.raise_error(F.lit(f"a kernel takes at most {MOST_ROWS} rows")))).filter("__bad IS NULL").drop("__bad")
    drop = (lambda pdf: run(pdf)) if by else (lambda pdf: run(pdf.drop(columns="__one")))
    return df.groupBy(by or "__one").applyInPandas(drop, schema)


def adjacency(edges: DataFrame, weight: Column | str = "w") -> DataFrame:
    """Undirected adjacency as rows for both directions; parallel edges add up, loops go."""
    w = F.col(weight) if isinstance(weight, str) else weight
    e = edges.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(w).alias("w"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"), F.count("*").alias("neighbours"))


def laplacian(adj: DataFrame, normalised: bool = False) -> DataFrame:
    """Coordinates (i, j, v) of the Laplacian, or of the symmetrically normalised one."""
    d = degree(adj).select("node", "degree")
    if not normalised:
        return adj.select(F.col("a").alias("i"), F.col("b").alias("j"), (-F.col("w")).alias("v")).unionByName(d.select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("degree").alias("v")))
    off = adj.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b").select(F.col("a").alias("i"), F.col("b").alias("j"), (-F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("v"))
    return off.unionByName(d.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("v")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached. Labels also jump to their label's label, so rounds
    grow with the logarithm of the diameter on most graphs."""
    e = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = saved(nodes.select(F.col("node"), F.col("node").alias("component")))
    while True:
        low = e.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        nxt = now.join(low, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = nxt.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        nxt = saved(nxt.join(jump, F.col("component") == F.col("n2")).select("node", F.least("component", "c2").alias("component")))
        if nxt.join(now.withColumnRenamed("component", "was"), "node").filter("component <> was").isEmpty():
            return nxt
        now = nxt


def attach(nodes: DataFrame, edges: DataFrame, retained: DataFrame) -> DataFrame:
    """Nearest retained node by path length for every other node: node, home, distance, runner_up, margin. Paths do
    not pass another retained node. Relaxation keeps the two nearest homes of a node, and goes on until nothing changes
    (lengths must not be negative)."""
    e = saved(edges.select("a", "b", "w").union(edges.select("b", "a", "w")))
    keep = retained.select("node")
    best = saved(keep.select("node", F.col("node").alias("home"), F.lit(0.0).alias("d")))
    while True:
        front = best.join(keep.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left").filter(F.col("k").isNull() | (F.col("node") == F.col("home"))).drop("k")
        step = front.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "home", (F.col("d") + F.col("w")).alias("d")).join(keep, "node", "left_anti")
        nxt = best.union(step).groupBy("node", "home").agg(F.min("d").alias("d"))
        nxt = saved(top(nxt, ["node"], ["d", "home"], 2))
        if nxt.exceptAll(best).isEmpty():
            break
        best = nxt
    out = runner_up(best.join(keep, "node", "left_anti"), ["node"], ["d", "home"], "d")
    return nodes.join(keep, "node", "left_anti").join(out, "node", "left").select("node", "home", F.col("d").alias("distance"), "runner_up", (F.col("runner_up") - F.col("d")).alias("margin"))


def cut_volume(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, volume, cut and conductance of each cluster of a labelled graph (node, label)."""
    l = labels.select("node", "label")
    j = adj.join(l.toDF("a", "la"), "a").join(l.toDF("b", "lb"), "b")
    total = j.agg(F.sum("w").alias("t"))
    g = j.groupBy(F.col("la").alias("label")).agg(F.sum("w").alias("volume"), F.coalesce(F.sum(F.when(F.col("la") != F.col("lb"), F.col("w"))), F.lit(0.0)).alias("cut"))
    return g.crossJoin(total).withColumn("conductance", F.col("cut") / F.nullif(F.least("volume", F.col("t") - F.col("volume")), F.lit(0.0))).drop("t")


def pagerank(adj: DataFrame, seeds: DataFrame, rounds: int = 10, restart: float = 0.15) -> DataFrame:
    """Personalised PageRank after a fixed number of rounds: node, p."""
    n = seeds.select("node", (F.lit(1.0) / F.count("*").over(Window.partitionBy())).alias("s"))
    nodes = adj.select(F.col("a").alias("node")).distinct().join(n, "node", "left").select("node", F.coalesce("s", F.lit(0.0)).alias("s"))
    out = saved(adj.join(degree(adj).select(F.col("node").alias("a"), "degree"), "a").select("a", "b", (F.col("w") / F.col("degree")).alias("t")))
    p = nodes.select("node", F.col("s").alias("p"))
    for i in range(rounds):
        flow = out.join(p, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("t") * F.col("p")).alias("f"))
        p = nodes.join(flow, "node", "left").select("node", (restart * F.col("s") + (1 - restart) * F.coalesce("f", F.lit(0.0))).alias("p"))
        if i % 3 == 2:
            p = saved(p)
    return p


def sweep(adj: DataFrame, scores: DataFrame) -> DataFrame:
    """Sweep cut over nodes by falling score: rank, volume, cut, conductance of each prefix."""
    order = Window.orderBy(F.col("score").desc(), "node")
    r = scores.withColumn("rank", F.row_number().over(order)).select("node", "rank")
    j = adj.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b")
    inside = j.groupBy(F.greatest("ra", "rb").alias("rank")).agg(F.sum("w").alias("within"))
    vol = adj.join(r.toDF("a", "rank"), "a").groupBy("rank").agg(F.sum("w").alias("d"))
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    s = vol.join(inside, "rank", "left").select("rank", F.sum("d").over(run).alias("volume"), F.sum(F.coalesce("within", F.lit(0.0))).over(run).alias("held"), F.sum("d").over(Window.partitionBy()).alias("t"))
    s = s.withColumn("cut", F.col("volume") - F.col("held"))
    return s.filter("t - volume > 1e-9").select("rank", "volume", "cut", (F.col("cut") / F.least("volume", F.col("t") - F.col("volume"))).alias("conductance"))


def _adjacent(pdf: pd.DataFrame) -> dict:
    g: dict = {}
    for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"]):
        g.setdefault(a, {})[b] = g.setdefault(a, {}).get(b, 0.0) + w
        g.setdefault(b, {})
    return g


def max_flow(g: dict, s, t) -> tuple[float, set]:
    """Value of a maximum flow and the source side of a minimum cut, by shortest augmenting paths."""
    cap = {v: dict(n) for v, n in g.items()}
    value = 0.0
    while True:
        before, todo = {s: None}, deque([s])
        while todo and t not in before:
            v = todo.popleft()
            for u, c in cap[v].items():
                if c > 1e-9 and u not in before:
                    before[u] = v
                    todo.append(u)
        if t not in before:
            return value, set(before)
        path, v = [], t
        while before[v] is not None:
            path.append((before[v], v))
            v = before[v]
        room = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= room
            cap[b][a] = cap[b].get(a, 0.0) + room
        value += room


def cut_tree(adj: DataFrame) -> DataFrame:
    """Gomory-Hu tree in Gusfield's form: for each node but the first its parent and the value of their minimum cut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _adjacent(pdf)
        nodes = sorted(g)
        parent = dict.fromkeys(nodes[1:], nodes[0])
        value = {}
        for i, v in enumerate(nodes[1:], 1):
            value[v], side = max_flow(g, v, parent[v])
            for u in nodes[i + 1 :]:
                if u in side and parent[u] == parent[v]:
                    parent[u] = v
        return pd.DataFrame([(v, parent[v], value[v]) for v in nodes[1:]], columns=["node", "parent", "cut"])

    return kernel(adj, run, "node long, parent long, cut double")


def spectrum(adj: DataFrame, k: int = 6) -> DataFrame:
    """The k smallest eigenvalues of the normalised Laplacian and the gap to the next."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, lap = normalised_matrix(pdf)
        v = np.linalg.eigvalsh(lap)[: k + 1]
        return pd.DataFrame({"i": np.arange(len(v[:k])), "value": v[:k], "gap": np.append(np.diff(v), np.nan)[: len(v[:k])]})

    return kernel(adj, run, "i long, value double, gap double")


def eigenpairs(adj: DataFrame, k: int = 6) -> DataFrame:
    """The k smallest eigenpairs of the normalised Laplacian: i, value, node, v; of each vector the largest component is
    positive."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, lap = normalised_matrix(pdf)
        values, v = np.linalg.eigh(lap)
        k_ = min(k, len(nodes))
        v = v[:, :k_] * np.where(v[np.abs(v[:, :k_]).argmax(axis=0), np.arange(k_)] < 0, -1.0, 1.0)
        return pd.DataFrame({"i": np.repeat(np.arange(k_), len(nodes)), "value": np.repeat(values[:k_], len(nodes)), "node": nodes * k_, "v": v.T.ravel()})

    return kernel(adj, run, "i long, value double, node long, v double")


def corridors(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """Branches between two clusters by pair of clusters: lo, hi, branches, w. Rows of adj stand for both directions."""
    l = labels.select("node", "label")
    j = adj.filter("a < b").join(l.toDF("a", "la"), "a").join(l.toDF("b", "lb"), "b").filter("la <> lb")
    return j.groupBy(F.least("la", "lb").alias("lo"), F.greatest("la", "lb").alias("hi")).agg(F.count("*").alias("branches"), F.sum("w").alias("w"))


def ringed_buses(branches: DataFrame, labels: DataFrame) -> DataFrame:
    """Buses to mark where a boundary runs through a transformer (name, kind, bus0, bus1): its real end, as a star point
    has no place of its own."""
    l = labels.select(F.col("node"), "label")
    j = branches.join(l.toDF("bus0", "l0"), "bus0").join(l.toDF("bus1", "l1"), "bus1").filter((F.col("l0") != F.col("l1")) & F.contains("kind", F.lit("transformer")))
    return j.select(F.when(F.col("bus0").startswith("star:"), F.col("bus1")).otherwise(F.col("bus0")).alias("bus")).distinct()


def cut_tree_clusters(tree: DataFrame, k: int) -> DataFrame:
    """node, cluster: the k parts that are left when the k - 1 least cuts of a cut tree (node, parent, cut) are taken out;
    a part is named by its smallest node."""
    rank = F.row_number().over(Window.orderBy("cut", "node"))
    kept = tree.withColumn("__r", rank).filter(F.col("__r") >= k).select(F.col("node").alias("a"), F.col("parent").alias("b"))
    nodes = tree.select("node").union(tree.select("parent")).distinct()
    return components(nodes, kept).withColumnRenamed("component", "cluster")


def normalised_matrix(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    nodes = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"]):
        m[at[a], at[b]] += w
    d = m.sum(axis=1)
    s = 1 / np.sqrt(np.where(d > 0, d, 1))
    return nodes, np.eye(len(nodes)) - s[:, None] * m * s[None, :]
