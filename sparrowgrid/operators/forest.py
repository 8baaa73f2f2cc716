"""Spanning forests, tours and bridges of graphs of any size, as rounds of joins over the edge table.

The minimum spanning forest comes from Boruvka rounds: each part takes its least edge, the parts that these join become
one, and parallel edges fold to their least. Rounds grow with the logarithm of the number of nodes. A tour of the forest
visits every arc once; its ranks and running sums come from pointer doubling, again in logarithmic rounds, whatever the
depth. A bridge is a tree edge that no other edge spans: other edges get random labels, and an edge's label is the xor of
those that leave the nodes below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, saved

SPREAD = 64  # parts of a node's neighbours that are put in order one by one


def followed(parents: DataFrame) -> DataFrame:
    """(node, parent) with roots as their own parents -> every node with its root; paths halve in each round."""
    p = saved(parents)
    while True:
        up = p.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
        nxt = saved(p.join(up, F.col("parent") == F.col("__n")).select("node", F.col("__p").alias("parent"), (F.col("__p") != F.col("parent")).alias("moved")))
        p = nxt.select("node", "parent")
        if nxt.filter("moved").isEmpty():
            return p


def spanning_forest(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges a, b, w of the minimum spanning forest (ties by a, b), and the root of each node: node, root.

    `adj` has rows (a, b, w) for one or both directions; loops and null ends are ignored, parallel edges count as their
    least. Null weights come before all others."""
    key = F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = adj.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), key.alias("key"))
    e = saved(e.groupBy("a", "b").agg(F.min("key").alias("key")))
    root = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().select("node", F.col("node").alias("root"))
    tree = e.filter("false").select("key")
    while not e.isEmpty():
        both = e.select("a", "b", "key").union(e.select("b", "a", "key"))
        best = saved(both.groupBy("a").agg(F.min(F.struct("key", "b")).alias("m")).select("a", "m.b", "m.key"))
        tree = tree.union(best.select("key"))
        other = best.select(F.col("a").alias("a2"), F.col("b").alias("b2"))
        # two parts that take each other: the smaller becomes the root
        hooked = best.join(other, F.col("b") == F.col("a2")).select(F.col("a").alias("node"), F.when((F.col("b2") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("parent"))
        at = followed(hooked)
        root = saved(root.join(at.toDF("root", "__r"), "root", "left").select("node", F.coalesce("__r", "root").alias("root")))
        e = e.join(at.toDF("a", "ra"), "a").join(at.toDF("b", "rb"), "b").filter("ra <> rb")
        e = saved(e.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("key").alias("key")))
    return tree.distinct().select("key.a", "key.b", "key.w"), root


def spanning_tree(adj: DataFrame) -> DataFrame:
    """Edges of the minimum spanning forest: a, b, w."""
    return spanning_forest(adj)[0]


def tour(tree: DataFrame, root: DataFrame) -> DataFrame:
    """u, v, nu, nv, start: the arcs of a forest (a, b; root: node, root), each with the next of its tree's tour from the root,
    null at its end, and the first of v's neighbours. A node's neighbours follow one another in SPREAD parts, so that a hub is no single task."""
    arcs = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).union(tree.select("b", "a"))
    arcs = saved(arcs.select("u", "v", F.pmod(F.xxhash64("u"), F.lit(SPREAD)).alias("part")))  # of v's neighbours u
    parts = arcs.groupBy("v", "part").agg(F.min("u").alias("first"))
    order = Window.partitionBy("v").orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("v", "part", F.lead("first").over(order).alias("then"), F.first("first").over(whole).alias("start"))
    nxt = F.lead("u").over(Window.partitionBy("v", "part").orderBy("u"))
    out = arcs.withColumn("after", nxt).join(parts, ["v", "part"]).withColumn("to", F.coalesce("after", "then", "start"))
    out = out.withColumn("wraps", F.col("after").isNull() & F.col("then").isNull())
    out = out.join(root.select(F.col("node").alias("v"), "root"), "v")
    ends = (F.col("v") == F.col("root")) & F.col("wraps")
    return out.select("u", "v", F.when(~ends, F.col("v")).alias("nu"), F.when(~ends, F.col("to")).alias("nv"), "start")


def ranked_tour(arcs: DataFrame, values: DataFrame, sums: dict[str, str]) -> DataFrame:
    """The arcs with `left`, the arcs from each to the end of its tour, and for each column of `values` (node, ...) its
    running total over the arcs from the next one on; a node's value stands at one arc that leaves it. `sums` names the
    columns: 'xor' or 'sum'."""
    # the arc out of a node that stands for it: the one to the first of its neighbours
    own = arcs.select(F.col("v").alias("u"), F.col("start").alias("v")).distinct().withColumn("own", F.lit(True))
    zero = F.lit(0).cast("long")
    r = arcs.select("u", "v", "nu", "nv").join(own, ["u", "v"], "left").join(values.withColumnRenamed("node", "u"), "u", "left")
    at = {c: F.when(F.col("own"), F.coalesce(c, zero)).otherwise(zero) for c in sums}
    add = lambda c, x, y: F.col(x).bitwiseXOR(F.col(y)) if sums[c] == "xor" else F.col(x) + F.col(y)
    r = saved(r.select("u", "v", "nu", "nv", F.lit(1).cast("long").alias("left"), *[x.alias(c) for c, x in at.items()], *[x.alias(f"{c}_own") for c, x in at.items()]))
    while not r.filter("nu IS NOT NULL").isEmpty():
        n = r.select(F.col("u").alias("__u"), F.col("v").alias("__v"), F.col("nu").alias("__nu"), F.col("nv").alias("__nv"), F.col("left").alias("__left"), *[F.col(c).alias(f"__{c}") for c in sums])
        n = n.withColumn("__hit", F.lit(True))
        j = r.join(n, (F.col("nu") == F.col("__u")) & (F.col("nv") == F.col("__v")), "left")
        pick = lambda c, x: F.when(F.col("__hit"), x).otherwise(F.col(c)).alias(c)
        r = saved(j.select("u", "v", F.col("__nu").alias("nu"), F.col("__nv").alias("nv"), pick("left", F.col("left") + F.col("__left")), *[pick(c, add(c, c, f"__{c}")) for c in sums], *[f"{c}_own" for c in sums]))
    return r.select("u", "v", "left", *[add(c, c, f"{c}_own").alias(c) if sums[c] == "xor" else (F.col(c) - F.col(f"{c}_own")).alias(c) for c in sums])


def below(tree: DataFrame, root: DataFrame, values: DataFrame, sums: dict[str, str]) -> DataFrame:
    """top, node and totals of `values` over the nodes below each tree edge, the edge's lower end `node` included."""
    r = ranked_tour(tour(tree, root), values, sums)
    back = r.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("left").alias("__left"), *[F.col(c).alias(f"__{c}") for c in sums])
    j = r.join(back, ["u", "v"]).filter(F.col("left") > F.col("__left"))
    total = lambda c: F.col(c).bitwiseXOR(F.col(f"__{c}")) if sums[c] == "xor" else F.col(c) - F.col(f"__{c}")
    return j.select(F.col("u").alias("top"), F.col("v").alias("node"), *[total(c).alias(c) for c in sums])


def bridges(adj: DataFrame, seed: int = 1) -> DataFrame:
    """Edges a, b (a < b) whose loss splits a component, and `side`, the nodes that stay with a. Parallel edges count as one
    (adjacency() has added them up); loops are ignored.

    An edge without a label is a bridge but for a chance of 2 to the -128; that is verified: without all of them the
    components must be as many more, otherwise other labels are drawn."""
    e = saved(adj.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")))
    tree, root = spanning_forest(e)
    tree = saved(tree)
    size = root.groupBy("root").agg(F.count("*").alias("nodes"))
    parts = size.count()
    other = e.select("a", "b").join(tree.select("a", "b"), ["a", "b"], "left_anti")
    while True:
        marks = other.select("a", "b", F.xxhash64(F.lit(seed), "a", "b").alias("x"), F.xxhash64(F.lit(seed), "b", "a").alias("y"))
        at = marks.select(F.col("a").alias("node"), "x", "y").union(marks.select("b", "x", "y")).groupBy("node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        values = root.select("node").join(at, "node", "left").withColumn("n", F.lit(1).cast("long"))
        seen = below(tree, root, values, {"x": "xor", "y": "xor", "n": "sum"})
        found = seen.filter("x = 0 AND y = 0").join(root, "node").join(size, "root")
        found = saved(found.select(F.least("top", "node").alias("a"), F.greatest("top", "node").alias("b"), F.when(F.col("top") < F.col("node"), F.col("nodes") - F.col("n")).otherwise(F.col("n")).alias("side")))
        rest = e.select("a", "b").join(found.select("a", "b"), ["a", "b"], "left_anti")
        if components(root.select("node"), rest).select("component").distinct().count() == parts + found.count():
            return found
        seed += 1
