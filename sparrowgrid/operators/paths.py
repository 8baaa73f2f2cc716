"""Shortest paths from blocks of sources, and what share of them passes each node: tables keyed by (source, node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import saved

SOURCES = 1000  # to a block; a block's table has that many rows for each node
SAME = 1e-12  # lengths that differ by no more, in proportion, are equal


def _no_longer(a: Column, b: Column) -> Column:
    return a <= b + SAME * (1 + F.abs(b))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """s, v, d: shortest distance from each source (node) to every node it reaches; edges a, b, w for both directions,
    w > 0. In each round only what the last one shortened goes on."""
    best = saved(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("new")))
    while True:
        step = best.filter("new").join(edges, F.col("v") == F.col("a")).select("s", F.col("b").alias("v"), (F.col("d") + F.col("w")).alias("d"), F.lit(False).alias("old"))
        every = best.select("s", "v", "d", F.lit(True).alias("old")).union(step)
        was = F.min(F.when(F.col("old"), F.col("d")))
        nxt = every.groupBy("s", "v").agg(F.min("d").alias("m"), was.alias("was"))
        shorter = F.col("was").isNull() | ~_no_longer(F.col("was"), F.col("m"))
        nxt = saved(nxt.select("s", "v", F.when(shorter, F.col("m")).otherwise(F.col("was")).alias("d"), shorter.alias("new")))
        if nxt.filter("new").isEmpty():
            return nxt.select("s", "v", "d")
        best = nxt


def dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """s, v, dependency: for each source the share of its shortest paths to all others that pass v or end there, less one.

    The shortest-path edges of each source are found once. Path counts go outwards over them level by level, a node when
    all nodes before it are done; shares come back the same way."""
    d = distances(edges, sources)
    dag = edges.join(d.select("s", F.col("v").alias("a"), F.col("d").alias("da")), "a").join(d.select("s", F.col("v").alias("b"), F.col("d").alias("db")), ["s", "b"])
    dag = saved(dag.filter(_no_longer(F.col("da") + F.col("w"), F.col("db"))).select("s", "a", "b"))
    waits = dag.groupBy("s", F.col("b").alias("v")).agg(F.count("*").alias("waits"))
    state = d.join(waits, ["s", "v"], "left").select("s", "v", F.coalesce("waits", F.lit(0)).alias("waits"), F.when(F.col("s") == F.col("v"), 1.0).otherwise(0.0).alias("paths"))
    state = saved(state.withColumn("level", F.when(F.col("waits") == 0, 0)))
    level = 0
    while True:
        sent = state.filter(F.col("level") == level).join(dag.withColumnRenamed("a", "v"), ["s", "v"]).groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("more"), F.count("*").alias("done"))
        nxt = state.join(sent, ["s", "v"], "left")
        left = F.col("waits") - F.coalesce("done", F.lit(0))
        now = F.coalesce("level", F.when((left == 0) & F.col("done").isNotNull(), level + 1))
        nxt = saved(nxt.select("s", "v", left.alias("waits"), (F.col("paths") + F.coalesce("more", F.lit(0.0))).alias("paths"), now.alias("level")))
        state = nxt
        if state.filter(F.col("level") == level + 1).isEmpty():
            break
        level += 1
    back = state.select("s", "v", "paths", "level", F.lit(0.0).alias("dependency"))
    for at in range(level, 0, -1):
        gone = back.filter(F.col("level") == at).select("s", F.col("v").alias("b"), ((1 + F.col("dependency")) / F.col("paths")).alias("each"))
        share = gone.join(dag, ["s", "b"]).groupBy("s", F.col("a").alias("v")).agg(F.sum("each").alias("each"))
        back = saved(back.join(share, ["s", "v"], "left").select("s", "v", "paths", "level", (F.col("dependency") + F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("dependency")))
    return back.select("s", "v", "dependency")


def betweenness(adj: DataFrame, block: int = SOURCES) -> DataFrame:
    """Share of shortest paths (by w as length) through each node, undirected, normalised: node, score. Sources are worked
    off in blocks, so that at most `block` rows a node are held at once."""
    nodes = saved(adj.select(F.col("a").alias("node")).distinct())
    n = nodes.count()
    edges = saved(adj.filter("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")))
    blocks = -(-n // block)
    parts = []
    for k in range(blocks):
        d = dependencies(edges, nodes.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k))
        parts.append(saved(d.filter("s <> v").groupBy(F.col("v").alias("node")).agg(F.sum("dependency").alias("score"))))
    score = nodes.withColumn("score", F.lit(0.0))
    for p in parts:
        score = score.union(p)
    return score.groupBy("node").agg((F.sum("score") / ((n - 1) * (n - 2) or 1)).alias("score"))
