"""Further queries: engineering formulas, candidate narrowing, space, network rules, clusterings."""

from __future__ import annotations

from collections.abc import Iterator

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cluster as C
from ..operators import draws as D
from ..operators import linalg as L
from ..operators import relational as R
from ..operators import spatial as P
from .network import SPARSE, TREE, adj, branches, injections, nodes, pairs, rows_only
from .relational import HOURLY, TRADE, hourly, places, query, r, table, trade


@query("""SELECT event_type, round(avg(CASE WHEN hub < 3 OR hub >= 25 THEN 0 WHEN hub >= 12 THEN 1 ELSE (pow(hub, 3) - 27) / (1728 - 27) END * 0.95), 6) AS cf FROM (
SELECT event_type, v * pow(0.9, CASE WHEN u > 0 AND v > 0 THEN least(greatest(ln(v / u) / ln(10), 0), 0.5) END) AS hub FROM (SELECT event_type, value / 15 AS v, (value / 15) * (0.5 + (event_id % 5) / 10.0::DOUBLE) AS u FROM events)) GROUP BY 1""")
def wind_capacity_factor(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("value") / 15).alias("v"), (F.col("value") / 15 * (0.5 + (F.col("event_id") % 5) / 10.0)).alias("u"))
    hub = S.hub_speed("v", S.shear_exponent("u", "v"), 90.0)
    return e.groupBy("event_type").agg(r(F.avg(S.power_curve(hub) * 0.95), 6).alias("cf"))


@query("""SELECT event_type, round(avg(CASE WHEN z < 90 THEN d * greatest(0, cos(radians(z) - radians(35.0))) + 50 * (1 + cos(radians(35.0))) / 2 + 200 * 0.2 * (1 - cos(radians(35.0))) / 2 ELSE 0 END), 4) AS poa,
round(avg(least(greatest(p / 1000 * (1 - 0.004 * (12 + (45.0 - 20) / 800 * p - 25)), 0), 1)), 6) AS cf FROM (SELECT *, CASE WHEN z < 90 THEN d * greatest(0, cos(radians(z) - radians(35.0))) + 50 * (1 + cos(radians(35.0))) / 2 + 200 * 0.2 * (1 - cos(radians(35.0))) / 2 ELSE 0 END AS p
FROM (SELECT event_type, value AS d, (event_id % 120)::DOUBLE AS z FROM events)) GROUP BY 1""")
def solar_plane(spark, sf):
    e = table(spark, sf, "events").select("event_type", S.plane_irradiance("value", F.lit(50.0), F.lit(200.0), (F.col("event_id") % 120).cast("double")).alias("p"))
    return e.groupBy("event_type").agg(r(F.avg("p")).alias("poa"), r(F.avg(S.solar_capacity_factor("p", F.lit(12.0))), 6).alias("cf"))


@query("""SELECT event_id, round(CASE WHEN k <= 0.22 THEN 1 - 0.09 * k WHEN k <= 0.8 THEN 0.9511 - 0.1604 * k + 4.388 * k * k - 16.638 * pow(k, 3) + 12.336 * pow(k, 4) ELSE 0.165 END, 8) AS diffuse FROM (SELECT event_id, value / 500 AS k FROM events)""")
def diffuse_fraction(spark, sf):
    return table(spark, sf, "events").select("event_id", r(S.diffuse_fraction(F.col("value") / 500), 8).alias("diffuse"))


@query("""SELECT event_id, round(value * (1 + 0.3 * cos(2 * pi() * (dayofyear(ts) - 15) / 365.25)), 6) AS seasonal, round((1 - cos(pi() * least(greatest((value - 20) / 60, 0), 1))) / 2, 8) AS taper FROM events""")
def seasonal_taper(spark, sf):
    return table(spark, sf, "events").select("event_id", r(F.col("value") * S.seasonal_factor("ts", 0.3, 15), 6).alias("seasonal"), r(S.raised_cosine("value", F.lit(20.0), F.lit(80.0)), 8).alias("taper"))


@query("""SELECT l_suppkey, round(sum(CASE code WHEN 1 THEN x * 100 / s WHEN 2 THEN x ELSE x / 10 END), 6) AS x_pu, count(*) FILTER ((w = 0 AND stat IN (0, 4)) OR (w = 1 AND stat IN (0, 2)) OR (w = 2 AND stat IN (0, 3))) AS windings_out
FROM (SELECT l_suppkey, 1 + l_linenumber % 3 AS code, l_discount AS x, 50 + l_quantity AS s, l_linenumber % 5 AS stat, l_partkey % 3 AS w FROM lineitem) GROUP BY 1""")
def per_unit_and_windings(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", (1 + F.col("l_linenumber") % 3).alias("code"), F.col("l_discount").alias("x"), (50 + F.col("l_quantity")).alias("s"), (F.col("l_linenumber") % 5).alias("stat"), (F.col("l_partkey") % 3).alias("w"))
    x = F.when(F.col("code") == 1, F.col("x") * 100 / F.col("s")).when(F.col("code") == 2, F.col("x")).when(F.col("code") == 3, F.col("x") / 10).otherwise(F.raise_error(F.lit("unsupported impedance code")).cast("double"))
    out = F.col("stat").isin(0) | ((F.col("w") == 0) & (F.col("stat") == 4)) | ((F.col("w") == 1) & (F.col("stat") == 2)) | ((F.col("w") == 2) & (F.col("stat") == 3))
    return l.groupBy("l_suppkey").agg(r(F.sum(x), 6).alias("x_pu"), F.count_if(out).alias("windings_out"))


@query("""SELECT count(*) FILTER (v >= 110 AND v < 220) AS layer, count(*) FILTER (v IS NULL) AS untagged, count(*) FILTER (v IS NULL OR NOT v >= 220) AS not_known_above FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)""")
def layer_mask(spark, sf):
    v = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return table(spark, sf, "events").agg(F.count_if((v >= 110) & (v < 220)).alias("layer"), F.count_if(v.isNull()).alias("untagged"), F.count_if(v.isNull() | ~(v >= 220)).alias("not_known_above"))


@query("""SELECT CASE WHEN n BETWEEN 0 AND 9 THEN '0-9' WHEN n BETWEEN 10 AND 14 THEN '10-14' WHEN n BETWEEN 15 AND 19 THEN '15-19' ELSE '20+' END AS bucket, count(*) AS c FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1) GROUP BY 1""")
def histogram_buckets(spark, sf):
    h = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    label = S.first_rule([(F.col("n").between(a, b), f"{a}-{b}") for a, b in ((0, 9), (10, 14), (15, 19))], "20+")
    return h.groupBy(label.alias("bucket")).agg(F.count("*").alias("c"))


@query("""SELECT k, round((d + 180) - 360 * floor((d + 180) / 360) - 180, 6) AS wrapped, round((d + 180) - 360 * floor((d + 180) / 360) - 180 - (SELECT median((d + 180) - 360 * floor((d + 180) / 360) - 180) FROM (SELECT s_acctbal / 10 AS d FROM supplier)), 6) AS centred FROM (SELECT s_suppkey AS k, s_acctbal / 10 AS d FROM supplier)""")
def angle_centred(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), S.wrap_degrees(F.col("s_acctbal") / 10).alias("w"))
    return s.crossJoin(s.agg(F.percentile("w", 0.5).alias("m"))).select("k", r("w", 6).alias("wrapped"), r(F.col("w") - F.col("m"), 6).alias("centred"))  # one row


PTS = """pts AS (SELECT user_id AS id, (user_id * 37 % 101) / 10.0::DOUBLE AS x, (user_id * 53 % 97) / 10.0::DOUBLE AS y FROM (SELECT DISTINCT user_id FROM events))"""


def points(spark, sf) -> DataFrame:
    u = table(spark, sf, "events").select("user_id").distinct()
    return u.select(F.col("user_id").alias("id"), (F.col("user_id") * 37 % 101 / 10.0).alias("x"), (F.col("user_id") * 53 % 97 / 10.0).alias("y"))


@query(f"WITH {PTS} SELECT a.id AS id_a, b.id AS id_b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM pts a JOIN pts b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.0")
def within_distance(spark, sf):
    p = points(spark, sf)
    return P.within(p, p, 1.0).filter("id_a < id_b").select("id_a", "id_b", r("d", 6).alias("d"))


@query(f"""WITH {PTS}, k AS (SELECT a.id AS id_a, b.id AS id_b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) AS rank FROM pts a JOIN pts b ON b.id % 3 = 0)
SELECT id_a, id_b, round(d, 6) AS d, rank::INT AS rank FROM k WHERE rank <= 3""")
def k_nearest(spark, sf):
    p = points(spark, sf)
    return P.nearest(p, p.filter("id % 3 = 0"), 3, 1.5).select("id_a", "id_b", r("d", 6).alias("d"), "rank")


@query(f"""WITH RECURSIVE {PTS}, e AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.55), reach(node, seen) AS (SELECT id, id FROM pts UNION SELECT node, e.b FROM reach JOIN e ON seen = e.a), c AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)
SELECT size, count(*) AS components, round(size * count(*) / (SELECT count(*) FROM pts)::DOUBLE, 6) AS share FROM (SELECT component, count(*) AS size FROM c GROUP BY 1) GROUP BY 1""")
def snapped_components(spark, sf):
    p = points(spark, sf)
    c = P.snapped(p, 0.55).groupBy("component").agg(F.count("*").alias("size"))
    g = c.groupBy("size").agg(F.count("*").alias("components"))
    return g.crossJoin(p.agg(F.count("*").alias("t"))).select("size", "components", r(F.col("size") * F.col("components") / F.col("t"), 6).alias("share"))  # one row


@query(f"""WITH {PTS} SELECT id, 'diamond' AS name FROM pts WHERE abs(x - 5) + abs(y - 5) <= 3 + 1e-9 UNION ALL SELECT id, 'box' FROM pts WHERE x >= 1 - 1e-9 AND x <= 3 + 1e-9 AND y >= 1 - 1e-9 AND y <= 8 + 1e-9""")
def point_in_polygon(spark, sf):
    """A point on an edge is inside."""
    shapes = {"diamond": [(2.0, 5.0), (5.0, 2.0), (8.0, 5.0), (5.0, 8.0)], "box": [(1.0, 1.0), (3.0, 1.0), (3.0, 8.0), (1.0, 8.0)]}  # points lie on edges and corners of both
    polygons = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in s]) for n, s in shapes.items()], "name string, ring array<struct<x: double, y: double>>")
    return P.in_polygon(points(spark, sf), polygons, 1.0)


@query("""WITH codes AS (SELECT DISTINCT substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, -1, 1) AS code FROM part WHERE p_size < 25), names AS (SELECT DISTINCT p_name AS name FROM part)
SELECT code, count(*) AS n, min(name) AS first FROM codes JOIN names ON starts_with(name, left(code, 1)) AND name LIKE left(code, 1) || '%' || substr(code, 2, 1) || '%' || right(code, 1) || '%' GROUP BY 1""")
def subsequence_match(spark, sf):
    p = table(spark, sf, "part")
    codes = p.filter("p_size < 25").select(F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 1), F.substring("p_name", -1, 1)).alias("code")).distinct()
    names = p.select(F.col("p_name").alias("name")).distinct()
    like = F.concat(F.substring("code", 1, 1), F.lit("%"), F.substring("code", 2, 1), F.lit("%"), F.substring("code", 3, 1), F.lit("%"))
    j = codes.join(names, F.substring("code", 1, 1) == F.substring("name", 1, 1)).filter(F.expr("name LIKE " + "concat(substring(code, 1, 1), '%', substring(code, 2, 1), '%', substring(code, 3, 1), '%')"))
    return j.groupBy("code").agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query("""WITH c AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal > 3000 AS r1, s_suppkey % 3 = 0 AS r2 FROM supplier), a AS (SELECT *, r1 OR NOT bool_or(r1) OVER (PARTITION BY k) AS k1 FROM c), b AS (SELECT * FROM a WHERE k1), d AS (SELECT *, r2 OR NOT bool_or(r2) OVER (PARTITION BY k) AS k2 FROM b)
SELECT k, id FROM d WHERE k2""")
def candidate_narrowing(spark, sf):
    """Rules in turn; a rule that would leave a group without candidates is not applied to it."""
    c = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 3000).alias("r1"), (F.col("s_suppkey") % 3 == 0).alias("r2"))
    w = Window.partitionBy("k")
    for rule in ("r1", "r2"):
        c = c.withColumn("__any", F.bool_or(rule).over(w)).filter(F.col(rule) | ~F.col("__any")).drop("__any")
    return c.select("k", "id")


@query(f"""WITH RECURSIVE {SPARSE}, x0 AS (SELECT n_nationkey::BIGINT AS n, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey * 1.5::DOUBLE END AS v FROM nation), x1 AS (SELECT n, coalesce(v, (SELECT avg(y.v) FROM adj JOIN x0 y ON adj.b = y.n WHERE adj.a = x0.n)) AS v FROM x0), x2 AS (SELECT n, coalesce(v, (SELECT avg(y.v) FROM adj JOIN x1 y ON adj.b = y.n WHERE adj.a = x1.n)) AS v FROM x1)
SELECT n, round(v, 6) AS v FROM x2""")
def neighbour_mean(spark, sf):
    x = nodes(spark, sf).select(F.col("node").alias("n"), F.when(F.col("node") % 4 != 0, F.col("node") * 1.5).alias("v"))
    a = adj(spark, sf).select("a", "b")
    for _ in range(2):
        near = a.join(x.withColumnRenamed("n", "b"), "b").groupBy(F.col("a").alias("n")).agg(F.avg("v").alias("m"))
        x = x.join(near, "n", "left").select("n", F.coalesce("v", "m").alias("v"))
    return x.select("n", r("v", 6).alias("v"))


SOME = "CASE WHEN n_nationkey % 6 = 1 THEN n_nationkey * 1.5::DOUBLE END AS x, CASE WHEN n_nationkey % 6 = 1 THEN 50 - n_nationkey * 0.5::DOUBLE END AS y"


def some_places(spark, sf: str) -> DataFrame:
    k, has = F.col("n_nationkey").cast("long"), F.col("n_nationkey") % 6 == 1
    return table(spark, sf, "nation").select(k.alias("node"), F.when(has, k * 1.5).alias("x"), F.when(has, 50 - k * 0.5).alias("y"), "n_regionkey")


@query(f"""WITH RECURSIVE {TREE}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), p AS (SELECT n_nationkey::BIGINT AS node, {SOME} FROM nation),
walk(node, origin, links) AS (SELECT node, node, 0 FROM p WHERE x IS NOT NULL UNION SELECT e.b, origin, links + 1 FROM walk JOIN e ON node = e.a WHERE links < 25),
best AS (SELECT node, min((links, origin)) AS m FROM walk GROUP BY 1)
SELECT p.node, o.x, o.y, o.node AS origin, CASE WHEN o.node IS NOT NULL THEN m[1] END::INT AS links FROM p LEFT JOIN best USING (node) LEFT JOIN p o ON o.node = m[2]""")
def coupled_places(spark, sf):
    return P.coupled(some_places(spark, sf), pairs(spark, sf, 1))


@query(f"""WITH p AS (SELECT n_nationkey::BIGINT AS node, n_regionkey, {SOME} FROM nation), m AS (SELECT n_regionkey, avg(x) AS mx, avg(y) AS my FROM p WHERE x IS NOT NULL GROUP BY 1)
SELECT node, round(coalesce(x, mx), 6) AS x, round(coalesce(y, my), 6) AS y, n_regionkey, x IS NULL AND mx IS NOT NULL AS shared FROM p LEFT JOIN m USING (n_regionkey)""")
def same_site_places(spark, sf):
    return P.same_site(some_places(spark, sf), "n_regionkey").withColumn("x", r("x", 6)).withColumn("y", r("y", 6))


@query(f"""WITH {SPARSE}, kv AS (SELECT n_nationkey AS n, n_nationkey * 10 % 250 AS kv FROM nation), legs AS (SELECT a AS star, count(*) FILTER (kv >= 110) AS kept FROM adj JOIN kv ON adj.b = kv.n WHERE adj.a % 5 = 0 GROUP BY 1)
SELECT n::BIGINT AS bus FROM kv WHERE kv >= 110 AND n % 5 <> 0 UNION ALL SELECT star FROM legs WHERE kept >= 2""")
def retained_star_rule(spark, sf):
    """Buses at or above the floor stay; a star bus (here: a multiple of 5) stays if two of its legs end at such a bus."""
    kv = nodes(spark, sf).select("node", (F.col("node") * 10 % 250).alias("kv"))
    legs = adj(spark, sf).filter("a % 5 = 0").join(kv, F.col("b") == F.col("node")).groupBy("a").agg(F.count_if(F.col("kv") >= 110).alias("kept")).filter("kept >= 2")
    return kv.filter("kv >= 110 AND node % 5 <> 0").select(F.col("node").alias("bus")).union(legs.select("a"))


@query("""SELECT 'shed ' || c_nationkey AS name, c_nationkey AS bus, round(1.5 * max(d), 4) AS p_nom, 10000.0::DOUBLE AS cost FROM (SELECT c_nationkey, date_trunc('month', o_orderdate) AS h, sum(o_totalprice::DECIMAL(12, 2))::DOUBLE AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY c_nationkey""")
def load_shedding_units(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.date_trunc("month", "o_orderdate").alias("h")).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("d"))
    return d.groupBy(F.col("c_nationkey").alias("bus")).agg(r(1.5 * F.max("d"), 4).alias("p_nom")).select(F.concat(F.lit("shed "), "bus").alias("name"), "bus", "p_nom", F.lit(10000.0).alias("cost"))


@query("""WITH p AS (SELECT n_regionkey AS area, c_nationkey AS bus, sum(c_acctbal) AS load FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), g AS (SELECT n_regionkey AS area, sum(s_acctbal) AS gen FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT area, bus, round(load * gen / sum(load) OVER (PARTITION BY area), 3) AS load FROM p JOIN g USING (area)""")
def rebalanced_loads(spark, sf):
    n = table(spark, sf, "nation")
    p = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("area"), F.col("c_nationkey").alias("bus")).agg(F.sum("c_acctbal").alias("load"))
    g = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("area")).agg(F.sum("s_acctbal").alias("gen"))
    return p.join(g, "area").select("area", "bus", r(F.col("load") * F.col("gen") / F.sum("load").over(Window.partitionBy("area")), 3).alias("load"))


@query(f"WITH {SPARSE} SELECT a, b, round(greatest(0, 1 - w / 3e7), 6) AS headroom, round(w / 3e7, 6) AS loading, round(1 / w * 1e6, 6) AS inverse, round(qty / sum(qty) OVER (), 6) AS share FROM pairs")
def edge_weightings(spark, sf):
    w, q = F.col("w"), F.col("qty")
    return pairs(spark, sf).select("a", "b", r(F.greatest(F.lit(0.0), 1 - w / 3e7), 6).alias("headroom"), r(w / 3e7, 6).alias("loading"), r(1 / w * 1e6, 6).alias("inverse"), r(q / F.sum(q).over(Window.partitionBy()), 6).alias("share"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.x, b.x)) AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, min(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM d GROUP BY 1) SELECT vec_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM s""")
def silhouette(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return C.silhouette(e).select(F.col("id").alias("vec_id"), r("s", 6).alias("s"))


@query(f"""WITH {HOURLY}, l AS (SELECT event_type, snapshot, ntile(3) OVER (PARTITION BY snapshot ORDER BY round(v, 6), event_type) AS label FROM hourly) SELECT event_type, count(*) FILTER (label <> was) AS changes, count(was) AS steps FROM (SELECT *, lag(label) OVER (PARTITION BY event_type ORDER BY snapshot) AS was FROM l) GROUP BY 1""")
def label_churn(spark, sf):
    l = hourly(spark, sf).select("event_type", "snapshot", F.ntile(3).over(Window.partitionBy("snapshot").orderBy(F.round("v", 6), "event_type")).alias("label"))
    l = l.withColumn("was", F.lag("label").over(Window.partitionBy("event_type").orderBy("snapshot")))
    return l.groupBy("event_type").agg(F.count_if(F.col("label") != F.col("was")).alias("changes"), F.count("was").alias("steps"))


@query(f"WITH {TRADE} SELECT a, arg_max(b, (round(w, 4), -b)) AS partner, round(max(w), 2) AS w FROM trade GROUP BY 1")
def argmax_first_on_ties(spark, sf):
    return trade(spark, sf).groupBy("a").agg(F.max_by("b", F.struct(F.round("w", 4), -F.col("b"))).alias("partner"), r(F.max("w"), 2).alias("w"))


@query("""SELECT n_regionkey AS area, count(*) AS n FROM nation GROUP BY 1 ORDER BY n DESC, area LIMIT 1""")
def largest_part(spark, sf):
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("area")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area").limit(1)


@query("""WITH h AS (SELECT l_suppkey AS line, date_trunc('month', l_shipdate) AS h, sum(l_quantity) / 60 AS x FROM lineitem GROUP BY 1, 2)
SELECT line, count(*) FILTER (x >= 1) AS hours, round(100.0 * count(*) FILTER (x >= 1) / count(*), 4) AS share, round(max(x), 4) AS peak, round(avg(x), 4) AS mean, arg_max(h, (round(x, 6), -epoch(h))) AS at FROM h GROUP BY 1""")
def congestion_table(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("line"), F.date_trunc("month", "l_shipdate").alias("h")).agg((F.sum("l_quantity") / 60).alias("x"))
    busy = F.count_if(F.col("x") >= 1)
    return h.groupBy("line").agg(busy.alias("hours"), r(100 * busy / F.count("*")).alias("share"), r(F.max("x")).alias("peak"), r(F.avg("x")).alias("mean"), F.max_by("h", F.struct(F.round("x", 6), -F.unix_timestamp(F.col("h").cast("timestamp")))).alias("at"))


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"name": b["name"], "best": b["best"], "score": [C.lcs_ratio(x, y) for x, y in zip(b["ka"], b["kb"])]})


@rows_only
def token_sort_ratio(spark, sf):
    """Best and second match of each name by the Indel ratio of sorted words, among all names."""
    n = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().withColumn("ka", S.token_sort_key("name"))
    j = R.every_pair(n, n.toDF("best", "kb")).filter("name <> best")
    scored = j.select("name", "best", "ka", "kb").mapInPandas(_similar, "name string, best string, score double")
    return R.runner_up(scored, ["name"], [F.desc("score"), "best"], "score")


@query("""WITH s AS (SELECT event_id, (value - 50) / 50 AS z, abs(value - 50) / 50 / sqrt(2::DOUBLE) AS x FROM events),
p AS (SELECT event_id, 0.5 + sign(z) * CASE WHEN x = 0 THEN 0 ELSE exp(-x * x) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(x) - lgamma(k + 1.5)))) / 2 END AS p FROM s)
SELECT event_id, round(8 * sqrt(-ln(1 - least(p, 1 - 1e-12))), 3) AS speed FROM p""")
def weibull_copula(spark, sf):
    """Normal scores to Weibull speeds (scale 8, shape 2)."""
    e = table(spark, sf, "events").select("event_id", ((F.col("value") - 50) / 50).alias("z"))
    return e.select("event_id", r(S.weibull_speed("z", 8.0, 2.0), 3).alias("speed"))


@rows_only
def correlated_speeds(spark, sf):
    """Wind speeds of all nations in every hour with events: correlated by distance (a tenth for every 200 km), Weibull."""
    p = places(spark, sf)
    x, y = p.toDF("a", "lat1", "lon1"), p.toDF("b", "lat2", "lon2")
    km = S.haversine_km("lat1", "lon1", "lat2", "lon2")
    near = x.join(y, F.col("a") < F.col("b")).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.exp(-km * math.log(10) / 200).alias("r"))
    hours = table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("hour")).distinct()
    return D.correlated(near, hours, "hour", seed=30).withColumn("speed", S.weibull_speed("z", 8.0, 2.0))


@query(f"""WITH {HOURLY}, k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY snapshot) AS t FROM hourly)
SELECT event_type, snapshot, round(pow(0.8, t) * sum(v * pow(0.8, -t)) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING), 5) AS x FROM k""")
def autoregressive_series(spark, sf):
    """x[t] = 0.8 x[t-1] + e[t] for each type: a recursion, so one grouped call per series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, out = pdf.sort_values("snapshot"), 0.0, []
        for e in pdf["v"]:
            x = 0.8 * x + e
            out.append(x)
        return pd.DataFrame({"event_type": pdf["event_type"], "snapshot": pdf["snapshot"], "x": out})

    return hourly(spark, sf).groupBy("event_type").applyInPandas(run, "event_type string, snapshot timestamp_ntz, x double").withColumn("x", r("x", 5))
