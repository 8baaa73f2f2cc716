"""Queries against their SQL on tables made for the findings of round 3."""

import os
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from sparrowgrid.operators import cluster, relational, spatial
from sparrowgrid.plans import ORACLES, QUERIES, network


def put(spark, folder, **tables) -> str:
    """Tables (schema, rows) as Parquet files."""
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same(spark, name: str, folder: str, data: str = "") -> list:
    """The query's rows, which its SQL must give as well; tables that are not in the folder come from `data`."""
    c = duckdb.connect()
    for f in sorted({*os.listdir(folder), *(os.listdir(data) if data else [])}):
        if f.endswith(".parquet"):
            p = f"{folder}/{f}" if os.path.exists(f"{folder}/{f}") else f"{data}/{f}"
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
            if not os.path.exists(f"{folder}/{f}"):
                os.symlink(p, f"{folder}/{f}")
    got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
    assert Counter(got) == Counter(c.execute(ORACLES[name]).fetchall())
    return got


def trade_tables(weights: dict) -> dict:
    """Tables in which each pair of nations trades what `weights` says: a supplier and a customer a nation."""
    nations = sorted({n for p in weights for n in p})
    rows = list(enumerate(weights.items()))
    return {
        "customer": ("c_custkey long, c_nationkey int, c_acctbal double", [(n, n, 1.0) for n in nations]),
        "supplier": ("s_suppkey long, s_nationkey int, s_acctbal double", [(n, n, 1.0) for n in nations]),
        "orders": ("o_orderkey long, o_custkey long", [(i, b) for i, ((_, b), _) in rows]),
        "lineitem": ("l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double", [(i, a, 1.0, w, 0.0) for i, ((a, _), w) in rows]),
    }


def test_cut_tree_of_partners_in_a_ring(spark, tmp_path):
    weights = {(0, 1): 50.0, (1, 2): 40.0, (2, 0): 30.5, (3, 1): 7.25, (4, 5): 9.0, (5, 4): 8.0}  # 0 -> 1 -> 2 -> 0
    got = same(spark, "cut_tree", put(spark, tmp_path / "sf", **trade_tables(weights)))
    assert sorted(got) == [(0.0, 1), (7.25, 1), (17.0, 1), (30.5, 1), (40.0, 1), (50.0, 1)]


def test_weibull_speeds_near_rank_one(spark, tmp_path):
    values = [(i, v / 100) for i, v in enumerate([0, 5000, *range(24900, 25100, 7), *range(33000, 46000, 5)])]
    same(spark, "weibull_copula", put(spark, tmp_path / "sf", events=("event_id long, value double", values)))


def counted(monkeypatch) -> list:
    """Rows that each call of spatial.within() gives."""
    rows, within = [], spatial.within

    def count(*a):
        out = within(*a)
        rows.append(out.count())
        return out

    monkeypatch.setattr(spatial, "within", count)
    return rows


def test_nearest_and_snapped_meet_places_and_not_points(spark, monkeypatch):
    rows = counted(monkeypatch)
    p = spark.createDataFrame([(i, float(i % 2) * 9, 0.0) for i in range(600)] + [(900, None, 0.0), (901, float("nan"), 0.0)], "id long, x double, y double")
    got = {(r["id_a"], r["id_b"], r["rank"]) for r in spatial.nearest(p, p, 3, 1.0).collect()}
    assert got == {(i, i % 2 + 2 * k, k + 1) for i in range(600) for k in range(3)}
    assert sum(rows) <= 6  # two places, three points of each
    got = {tuple(r) for r in spatial.snapped(p, 1.0).collect()}
    assert got == {(i, i % 2) for i in range(600)} | {(900, 900), (901, 901)}
    assert sum(rows) <= 8


def test_a_crowded_cell_is_no_single_task(spark):
    p = spark.range(900).select("id", (F.col("id") % 30 / 30.0).alias("x"), (F.floor(F.col("id") / 30) / 30.0).alias("y"))  # one cell of width 1
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in spatial.within(p, p, 1.0).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert max(sizes) < 0.9 * sum(sizes)


def test_numbered_rows_and_spaced_pick(spark, tmp_path):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v")).repartition(7)
    rows, total = relational.numbered(df, ["v"], "i")
    assert total == 1000 and rows.filter("v <> i").isEmpty()
    for n in (3, 16, 40):
        orders = [(i, float(i * 7 % 11)) for i in range(n)]
        same(spark, "spaced_pick", put(spark, tmp_path / f"sf{n}", orders=("o_orderkey long, o_totalprice double", orders)))


def test_best_matches_of_copied_texts(spark):
    left = spark.createDataFrame([(i, "large ring" if i % 2 else "hot bolt") for i in range(200)], "id long, a string")
    right = spark.createDataFrame([(i, "large rung" if i % 2 else "hot belt", f"x{i}") for i in range(200)], "m long, b string, c string")
    got = relational.best_similar(left, right, "a", "b", "m", 0.8, 2).collect()
    assert {(r["id"], r["m"], r["c"]) for r in got} == {(i, i % 2 + 2 * k, f"x{i % 2 + 2 * k}") for i in range(200) for k in range(2)}


def test_network_is_read_once(spark, sf_dir):
    for df in (network._power(spark, sf_dir), network.ring(spark, sf_dir), network.pairs(spark, sf_dir)):
        plan = df._jdf.queryExecution().toString()
        assert "c_acctbal" not in plan and "l_orderkey" not in plan


def test_silhouette_of_copies(spark, tmp_path):
    rng = random.Random(3)
    some = [([rng.gauss(0, 1) + 3 * k for _ in range(4)], k) for k in range(3) for _ in range(9)] + [([9.0] * 4, 7)]
    rows = [(i, x, k) for i, (x, k) in enumerate(some * 3 + [([50.0] * 4, 8), ([50.0, 50.0, 50.0, 50.0001], 9)])]
    same(spark, "silhouette", put(spark, tmp_path / "sf", embeddings=("vec_id long, embedding array<float>, label int", rows)))
    p = spark.createDataFrame(rows, "id long, x array<double>, label long")
    wide = {r["id"]: r["s"] for r in cluster.silhouette(p).collect()}
    assert all(abs(r["s"] - wide[r["id"]]) < 1e-12 for r in cluster.silhouette(p, 5, 3).collect())
