"""Queries on projections, joins, roll-ups, picks and set operations, and the SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators.textindex import nearest_texts
from ..operators import series as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, n: int = 4):
    """Rounded for comparison, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n) + F.lit(0.0)


def trade(spark, sf: str) -> DataFrame:
    """Directed nation pairs: supplier's nation to customer's, value and quantity. Money is summed as decimals, so that the
    sum does not depend on the order."""
    l, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, l["l_suppkey"] == s["s_suppkey"])
    return j.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("w"), F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


TRADE = """trade AS (SELECT s_nationkey AS a, c_nationkey AS b, sum(l_extendedprice::DECIMAL(12, 2) * (1 - l_discount::DECIMAL(4, 2)))::DOUBLE AS w, sum(l_quantity) AS qty, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
HOURLY = """hourly AS (SELECT event_type, date_trunc('hour', ts) AS snapshot, avg(value) AS v, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2)"""


def hourly(spark, sf: str) -> DataFrame:
    return T.resample(table(spark, sf, "events"), "ts", ["event_type"], {"v": F.avg("value"), "s": F.sum("value"), "n": F.count("*")})


@query("""SELECT count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS in_service, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS rating,
  round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END), 2) AS normal_value FROM lineitem""")
def service_filter_summary(spark, sf):
    on = F.col("l_linestatus") == "O"
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.count_if(on).alias("in_service"), r(F.coalesce(F.sum(F.when(on, F.col("l_quantity"))), F.lit(0.0)), 2).alias("rating"), r(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice")).otherwise(0.0)), 2).alias("normal_value"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, status")
def count_by_value(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


@query("""SELECT CASE WHEN s_nationkey BETWEEN 0 AND 11 THEN 'IE' WHEN s_nationkey IN (12, 13) THEN 'NI' ELSE '??' END AS area,
  CASE WHEN starts_with(s_name, 'Supplier#00000000') THEN 'first' WHEN contains(s_name, '9') THEN 'nine' ELSE 'other' END AS carrier, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1, 2""")
def class_label(spark, sf):
    k = F.col("s_nationkey")
    area = S.first_rule([(k.between(0, 11), "IE"), (k.isin(12, 13), "NI")], "??")
    carrier = S.first_rule([(F.col("s_name").startswith("Supplier#00000000"), "first"), (F.col("s_name").contains("9"), "nine")], "other")
    return table(spark, sf, "supplier").groupBy(area.alias("area"), carrier.alias("carrier")).agg(F.count("*").alias("n"), r(F.sum("s_acctbal"), 2).alias("total"))


@query(f"""WITH {TRADE}, volt AS (SELECT n_nationkey AS k, n_nationkey * 10 % 250 AS kv FROM nation)
SELECT a, b, round(w, 2) AS w FROM trade JOIN volt x ON a = x.k JOIN volt y ON b = y.k WHERE x.kv >= 110 AND y.kv >= 110""")
def both_ends_filter(spark, sf):
    volt = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 10 % 250).alias("kv"))
    j = R.with_groups(trade(spark, sf), volt, "n_nationkey", "kv")
    return j.filter("group_a >= 110 AND group_b >= 110").select("a", "b", r("w", 2).alias("w"))


@query("""SELECT event_type, count(x) AS rated, count(*) AS n, round(avg(x), 4) AS mean FROM (
  SELECT event_type, CASE WHEN floor(value) IN (0, 99) THEN NULL ELSE value END AS x FROM events) GROUP BY 1""")
def sentinel_to_null(spark, sf):
    e = table(spark, sf, "events").withColumn("x", F.when(S.sentinel_to_null(F.floor("value").cast("double"), (0.0, 99.0)).isNotNull(), F.col("value")))
    return e.groupBy("event_type").agg(F.count("x").alias("rated"), F.count("*").alias("n"), r(F.avg("x")).alias("mean"))


@query("SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS rating FROM region")
def missing_column_null(spark, sf):
    return R.missing_columns(table(spark, sf, "region"), {"rating": "double", "r_name": "string"})


@query("""SELECT event_id, CASE WHEN x IS NULL THEN NULL ELSE round(least(greatest(x, 5.0), 50.0), 4) END AS x FROM (SELECT event_id, nullif(round(value / 10, 4), 1.0) AS x FROM events)""")
def clip_null_safe(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.nullif(F.round(F.col("value") / 10, 4), F.lit(1.0)).alias("x"))
    return e.select("event_id", r(S.clip("x", 5.0, 50.0)).alias("x"))


PLACES = """place AS (SELECT n_nationkey AS k, 50 + (n_nationkey * 7 % 50) / 10.0::DOUBLE AS lat, -10 + (n_nationkey * 13 % 60) / 10.0::DOUBLE AS lon FROM nation)"""


def places(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("k"), (50 + (k * 7 % 50) / 10.0).alias("lat"), (-10 + (k * 13 % 60) / 10.0).alias("lon"))


KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))"


@query(f"WITH {PLACES} SELECT x.k AS a, y.k AS b, round({KM}, 3) AS km FROM place x JOIN place y ON x.k < y.k")
def haversine_pairs(spark, sf):
    p = places(spark, sf)
    x, y = p.toDF("a", "lat1", "lon1"), p.toDF("b", "lat2", "lon2")
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", r(S.haversine_km("lat1", "lon1", "lat2", "lon2"), 3).alias("km"))


@query("""SELECT printf('%.1f', round_even(value / 0.5, 0) * 0.5 + 0.0) AS cell, count(*) AS n FROM events GROUP BY 1""")
def cell_rounding(spark, sf):
    return table(spark, sf, "events").groupBy(F.format_string("%.1f", S.cell("value", 0.5) + 0.0).alias("cell")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(avg(CASE WHEN v < 3 OR v >= 25 THEN 0 WHEN v >= 12 THEN 1 ELSE (pow(v, 3) - 27) / (1728 - 27) END), 6) AS cf,
  round(avg(v * pow(0.8, 1.0 / 7)), 6) AS hub FROM (SELECT event_type, value / 15 AS v FROM events) GROUP BY 1""")
def power_curve_cf(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("value") / 15).alias("v"))
    return e.groupBy("event_type").agg(r(F.avg(S.power_curve("v")), 6).alias("cf"), r(F.avg(S.hub_speed("v", F.lit(1 / 7), 80.0)), 6).alias("hub"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.event_type'), event_type) AS event_type FROM events""")
def json_map_expand(spark, sf):
    return R.expand_map(table(spark, sf, "events"), "props", {"k": "int", "event_type": "string"}).select("event_id", "k", "event_type")


@query("""WITH a AS (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS v FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 8000 GROUP BY 1),
b AS (SELECT s_nationkey AS k, round(sum(s_acctbal), 2) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS value_a, b.v AS value_b, round(a.v - b.v, 2) AS diff, CASE WHEN b.v IS NULL THEN 'left' WHEN a.v IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def outer_compare(spark, sf):
    a = table(spark, sf, "customer").filter("c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    b = table(spark, sf, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.sum("s_acctbal"), 2).alias("v"))
    return R.outer_compare(a, b, "k", "v").withColumn("diff", r("diff", 2))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_members(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 400000")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_orphans(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(f"""WITH {TRADE}, m AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1)
SELECT a, b, coalesce(x.k, y.k) AS inside, round(w, 4) AS w FROM trade LEFT JOIN m x ON a = x.k LEFT JOIN m y ON b = y.k WHERE (x.k IS NULL) <> (y.k IS NULL)""")
def boundary_xor(spark, sf):
    return R.boundary(trade(spark, sf), table(spark, sf, "nation").filter("n_regionkey = 1"), "n_nationkey").select("a", "b", "inside", r("w", 4).alias("w"))


@query(f"""WITH {TRADE} SELECT x.n_regionkey AS group_a, y.n_regionkey AS group_b, count(*) AS circuits, round(sum(w), 2) AS w
FROM trade JOIN nation x ON a = x.n_nationkey JOIN nation y ON b = y.n_nationkey WHERE x.n_regionkey <> y.n_regionkey GROUP BY 1, 2""")
def cross_group_circuits(spark, sf):
    j = R.with_groups(trade(spark, sf), table(spark, sf, "nation"), "n_nationkey", "n_regionkey").filter("group_a <> group_b")
    return j.groupBy("group_a", "group_b").agg(F.count("*").alias("circuits"), r(F.sum("w"), 2).alias("w"))


@query("""WITH bands AS (SELECT * FROM (VALUES (0.0, 50.0, 'low'), (50.0, 110.0, 'mid'), (110.0, 1000.0, 'high')) t(lo, hi, band))
SELECT band, count(*) AS n, round(sum(value), 2) AS total FROM events JOIN bands ON value >= lo AND value < hi GROUP BY 1""")
def range_band_join(spark, sf):
    b = S.band("value", [(0.0, 50.0, "low"), (50.0, 110.0, "mid"), (110.0, 1000.0, "high")])
    return table(spark, sf, "events").withColumn("band", b).filter("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), x AS (SELECT event_id AS other_id, user_id AS u, ts AS other_ts FROM events WHERE event_type = 'click'),
j AS (SELECT event_id, other_id, abs(epoch_us(ts) - epoch_us(other_ts)) AS gap_us, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(other_ts)), other_ts) AS k
  FROM l JOIN x ON user_id = u AND abs(epoch_us(ts) - epoch_us(other_ts)) <= 21600000000)
SELECT event_id, other_id, gap_us FROM j WHERE k = 1""")
def nearest_asof(spark, sf):
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select(F.col("event_id").alias("other_id"), "user_id", F.col("ts").alias("other_ts"))
    return R.nearest_in_time(left, right, "user_id", "ts", "other_ts", "event_id", 21600).select("event_id", "other_id", "gap_us")


@query(f"""WITH {PLACES}, u AS (SELECT s_suppkey, s_nationkey, s_suppkey % 4 AS carrier, s_acctbal >= 0 AS has FROM supplier),
j AS (SELECT a.s_suppkey, b.s_suppkey AS donor, {KM} AS km FROM u a JOIN place x ON a.s_nationkey = x.k JOIN u b ON a.carrier = b.carrier AND b.has JOIN place y ON b.s_nationkey = y.k WHERE NOT a.has),
k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(km, 6), donor) AS n FROM j) SELECT s_suppkey, donor, round(km, 3) AS km FROM k WHERE n = 1""")
def nearest_donor(spark, sf):
    u = table(spark, sf, "supplier").join(places(spark, sf), F.col("s_nationkey") == F.col("k")).select("s_suppkey", (F.col("s_suppkey") % 4).alias("carrier"), (F.col("s_acctbal") >= 0).alias("has"), "lat", "lon")
    # donors of one carrier and place are alike: one of them stands for all
    donors = u.filter("has").groupBy("carrier", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).agg(F.min("s_suppkey").alias("donor"))
    j = u.filter("NOT has").join(donors, "carrier").withColumn("km", S.haversine_km("lat", "lon", "lat2", "lon2"))
    return R.top(j, ["s_suppkey"], [F.round("km", 6), "donor"]).select("s_suppkey", "donor", r("km", 3).alias("km"))


@query(f"""WITH {TRADE} SELECT least(a, b) AS lo, greatest(a, b) AS hi, round(sum(w), 4) AS w, sum(n)::BIGINT AS circuits, max(qty) AS widest FROM trade WHERE a <> b GROUP BY 1, 2""")
def canonical_pair_routes(spark, sf):
    return R.canonical_pairs(trade(spark, sf).filter("a <> b"), "a", "b", {"w": r(F.sum("w"), 4), "circuits": F.sum("n"), "widest": F.max("qty")})


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT substr(p_name, 1, 6) AS stem, count(*) AS n, min(p_name) AS name FROM n GROUP BY 1)
SELECT stem, name FROM s WHERE n = 1""")
def prefix_unique(spark, sf):
    n = table(spark, sf, "part").select("p_name").distinct()
    return n.groupBy(F.substring("p_name", 1, 6).alias("stem")).agg(F.count("*").alias("n"), F.min("p_name").alias("name")).filter("n = 1").drop("n")


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), j AS (SELECT a.p_name, b.p_name AS best, levenshtein(a.p_name, b.p_name) AS d FROM n a JOIN n b ON a.p_name <> b.p_name),
k AS (SELECT *, lead(d) OVER w AS runner_up, row_number() OVER w AS i FROM j WINDOW w AS (PARTITION BY p_name ORDER BY d, best))
SELECT p_name, best, d::INT AS d, runner_up::INT AS runner_up, (d - runner_up)::INT AS margin FROM k WHERE i = 1""")
def levenshtein_top1_margin(spark, sf):
    n = table(spark, sf, "part").select("p_name").distinct()
    return R.runner_up(nearest_texts(n, n.withColumnRenamed("p_name", "best"), "p_name", "best"), ["p_name"], ["d", "best"], "d")


@query("""SELECT array_to_string(list_sort(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')), ' ') AS token_key, count(*) AS n, count(DISTINCT p_name) AS names FROM part GROUP BY 1""")
def token_sort_match(spark, sf):
    return table(spark, sf, "part").groupBy(S.token_sort_key("p_name").alias("token_key")).agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("names"))


@query("""WITH l AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 10), rr AS (SELECT min(p_partkey) AS id, CASE WHEN p_size > 40 THEN p_name ELSE substr(p_name, 1, 8) END AS k FROM part WHERE p_size > 30 GROUP BY 2),
e AS (SELECT name, min(id) AS match_id, 'exact' AS method, 1.0::DOUBLE AS score FROM l JOIN rr ON name = k GROUP BY 1),
p AS (SELECT substr(k, 1, 5) AS p, min(id) AS match_id FROM rr GROUP BY 1 HAVING count(*) = 1),
n AS (SELECT name, match_id, 'prefix' AS method, 0.9::DOUBLE AS score FROM l JOIN p ON substr(name, 1, 5) = p WHERE name NOT IN (SELECT name FROM e)),
f AS (SELECT name, id AS match_id, 1 - levenshtein(name, k)::DOUBLE / greatest(length(name), length(k)) AS score FROM l JOIN rr ON true WHERE name NOT IN (SELECT name FROM e) AND name NOT IN (SELECT name FROM n)),
g AS (SELECT name, match_id, 'fuzzy' AS method, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, match_id) AS i FROM f WHERE score >= 0.6) WHERE i = 1)
SELECT l.name, match_id, coalesce(method, 'none') AS method, round(score, 4) AS score FROM l LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM n UNION ALL SELECT * FROM g) m ON l.name = m.name""")
def staged_resolution(spark, sf):
    p = table(spark, sf, "part")
    left = p.filter("p_size < 10").select(F.col("p_name").alias("name")).distinct().withColumn("key", F.col("name"))
    right = p.filter("p_size > 30").groupBy(F.when(F.col("p_size") > 40, F.col("p_name")).otherwise(F.substring("p_name", 1, 8)).alias("k")).agg(F.min("p_partkey").alias("id"))
    return R.staged_match(left, right, "key", "k", "name", "id", 5, 0.6).select("name", "match_id", "method", r("score").alias("score"))


@query("""WITH g AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 150))) AS a, list_sort(list_distinct(list(event_type) FILTER (value < 15))) AS b FROM events GROUP BY 1)
SELECT user_id, CASE WHEN len(coalesce(a, [])) = 0 AND len(coalesce(b, [])) = 0 THEN 'neither' WHEN len(coalesce(a, [])) = 0 THEN 'only b' WHEN len(coalesce(b, [])) = 0 THEN 'only a' WHEN a = b THEN 'equal' WHEN list_has_any(a, b) THEN 'overlap' ELSE 'disjoint' END AS verdict,
len(list_intersect(coalesce(a, []), coalesce(b, [])))::INT AS shared FROM g""")
def membership_overlap(spark, sf):
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("event_type"))))
    g = table(spark, sf, "events").groupBy("user_id").agg(pick(F.col("value") > 150).alias("a"), pick(F.col("value") < 15).alias("b"))
    verdict = S.first_rule([((F.size("a") == 0) & (F.size("b") == 0), "neither"), (F.size("a") == 0, "only b"), (F.size("b") == 0, "only a"), (F.col("a") == F.col("b"), "equal"), (F.arrays_overlap("a", "b"), "overlap")], "disjoint")
    return g.select("user_id", verdict.alias("verdict"), F.size(F.array_intersect("a", "b")).alias("shared"))


@query("""SELECT a, round(max(w), 2) AS top, count(*) AS n FROM (SELECT s_nationkey AS a, s_suppkey, abs(s_acctbal - 4500) AS w, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal - 4500) DESC, s_suppkey) AS k FROM supplier) WHERE k <= 3 GROUP BY 1""")
def topk_abs(spark, sf):
    s = table(spark, sf, "supplier").withColumn("w", F.abs(F.col("s_acctbal") - 4500))
    return R.top(s, ["s_nationkey"], [F.desc("w"), "s_suppkey"], 3).groupBy(F.col("s_nationkey").alias("a")).agg(r(F.max("w"), 2).alias("top"), F.count("*").alias("n"))


@query(f"""WITH {HOURLY}, t AS (SELECT snapshot, sum(s) AS s FROM hourly GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY round(s, 4) DESC, snapshot) AS k FROM t)
SELECT snapshot, round(s, 2) AS s, row_number() OVER (ORDER BY snapshot) AS seq FROM k WHERE k <= 24""")
def topk_then_chrono(spark, sf):
    t = hourly(spark, sf).groupBy("snapshot").agg(F.sum("s").alias("s")).orderBy(F.round("s", 4).desc(), "snapshot").limit(24)
    return t.select("snapshot", r("s", 2).alias("s"), F.row_number().over(Window.orderBy("snapshot")).cast("long").alias("seq"))


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 20),
b AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) AND o_orderpriority <> '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10),
c AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) AND o_orderkey NOT IN (SELECT o_orderkey FROM b) AND o_orderpriority <> '1-URGENT' ORDER BY md5('8:' || o_orderkey), o_orderkey LIMIT 15)
SELECT o_orderkey, 'flagged' AS stratum FROM a UNION ALL SELECT o_orderkey, 'severe' FROM b UNION ALL SELECT o_orderkey, 'rest' FROM c""")
def stratified_pick(spark, sf):
    o = table(spark, sf, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    a = R.hash_pick(o.filter(urgent), "o_orderkey", 7, 20)
    return R.union_typed({"flagged": a.select("o_orderkey"), "severe": (b := o.filter(~urgent).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)).select("o_orderkey"), "rest": R.hash_pick(o.filter(~urgent).join(b.select("o_orderkey"), "o_orderkey", "left_anti"), "o_orderkey", 8, 15).select("o_orderkey")}, "stratum")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, t, row_number() OVER (PARTITION BY t ORDER BY o_totalprice, o_orderkey) AS k FROM (SELECT *, ntile(16) OVER (ORDER BY o_totalprice, o_orderkey) AS t FROM orders)) WHERE k = 1""")
def spaced_pick(spark, sf):
    return R.spaced_pick(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], 16).select("o_orderkey")


@query("""SELECT 'customer' AS kind, c_nationkey AS bus, round(-sum(c_acctbal), 2) AS p, CAST(NULL AS BIGINT) AS units FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'supplier', s_nationkey, round(sum(s_acctbal), 2), count(*) FROM supplier GROUP BY s_nationkey""")
def union_typed(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("bus")).agg(r(-F.sum("c_acctbal"), 2).alias("p"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("bus")).agg(r(F.sum("s_acctbal"), 2).alias("p"), F.count("*").alias("units"))
    return R.union_typed({"customer": c, "supplier": s})


@query("SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def dedupe_first(spark, sf):
    return R.top(table(spark, sf, "part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_brand", "p_type", "p_partkey")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def except_keys(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, sf, "lineitem").filter("l_quantity > 48").select("l_partkey").distinct())


@query("""SELECT n_nationkey, coalesce(n, 0) AS n, round(coalesce(v, 0), 2) AS v FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, sum(s_acctbal) AS v FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) ON n_nationkey = s_nationkey""")
def zero_filled_keys(spark, sf):
    v = table(spark, sf, "supplier").filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("v"))
    return R.zero_filled(table(spark, sf, "nation").select("n_nationkey"), v, ["n_nationkey"], ["n", "v"]).withColumn("v", r("v", 2))


@query("""SELECT signature, count(*) AS n FROM (SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '+') AS signature FROM events WHERE value > 120 GROUP BY 1) GROUP BY 1""")
def signature_counts(spark, sf):
    e = table(spark, sf, "events").filter("value > 120").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("signature"))
    return e.groupBy("signature").agg(F.count("*").alias("n"))


@query("""SELECT date_part('year', o_orderdate)::INT AS year, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS F, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS O, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS P FROM orders GROUP BY 1""")
def pivot_annual(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return p.select("year", *[r(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("F", "O", "P")])


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def contingency_table(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("""WITH g AS (SELECT user_id, unnest(string_split(string_agg(DISTINCT event_type, ';'), ';')) AS grp, sum(value) AS v FROM events GROUP BY 1)
SELECT grp, count(*) AS n, round(sum(v), 2) AS v FROM g GROUP BY 1""")
def group_rollup_overlapping(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.collect_set("event_type"), ";").alias("groups"), F.sum("value").alias("v"))
    return u.select("user_id", "v", F.explode(F.split("groups", ";")).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"), r(F.sum("v"), 2).alias("v"))


@query("""SELECT region, round(sum(c), 2) AS capacity FROM (SELECT DISTINCT n_regionkey AS region, s_suppkey, s_acctbal AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE l_returnflag = 'R') GROUP BY 1""")
def distinct_capacity(spark, sf):
    s, n, l = (table(spark, sf, t) for t in ("supplier", "nation", "lineitem"))
    used = s.join(l.filter("l_returnflag = 'R'"), s["s_suppkey"] == l["l_suppkey"], "left_semi")  # each entity once
    return used.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(r(F.sum("s_acctbal"), 2).alias("capacity"))


@query("""SELECT least(greatest(n, 1), 6)::BIGINT AS bucket, count(*) AS users, round(avg(v), 4) AS v FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1) GROUP BY 1""")
def clipped_count_bucket(spark, sf):
    u = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    return u.groupBy(F.least(F.greatest("n", F.lit(1)), F.lit(6)).cast("long").alias("bucket")).agg(F.count("*").alias("users"), r(F.avg("v")).alias("v"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(stddev_samp(value), 4) AS sd, round(round_even(avg(value), 1), 1) AS mean1 FROM events GROUP BY 1""")
def percentile_limits(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(r(F.percentile("value", 0.5)).alias("p50"), r(F.percentile("value", 0.95)).alias("p95"), r(F.stddev_samp("value")).alias("sd"), r(F.bround(F.avg("value"), 1), 1).alias("mean1"))


@query("""SELECT n_regionkey AS grp, count(*) AS n, max(s_acctbal) AS widest, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS names, arg_min(s_name, s_suppkey) AS first_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def group_ordered_lists(spark, sf):
    j = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("grp")).agg(F.count("*").alias("n"), F.max("s_acctbal").alias("widest"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), F.min_by("s_name", "s_suppkey").alias("first_name"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 2 THEN upper(n_name) || '1' ELSE upper(n_name) END AS station FROM nation""")
def station_keys(spark, sf):
    """Nations' names decorated as bus names are, and their stations."""
    n, k = F.col("n_name"), F.col("n_nationkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("W_"), n)).when(k == 1, F.concat(F.lit(" PV_GEN_"), n, F.lit("_PST "))).when(k == 2, F.concat(n, F.lit("1A-"))).when(k == 3, F.concat(F.lower(n), F.lit(" T_CAP"))).otherwise(n)
    return table(spark, sf, "nation").select("n_nationkey", S.station_key(raw).alias("station"))


@query("""WITH l AS (SELECT p_partkey AS id, p_name, p_brand FROM part WHERE p_size = 1), rr AS (SELECT p_partkey AS match_id, p_name AS k, p_brand AS brand FROM part WHERE p_size = 50),
s AS (SELECT *, 1 - levenshtein(p_name, k)::DOUBLE / greatest(length(p_name), length(k)) AS score FROM l JOIN rr ON true), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) AS i FROM s WHERE score >= 0.4)
SELECT id, match_id, round(score, 4) AS score, p_brand = brand AS agrees, score >= 0.95 OR score >= 0.4 AND p_brand = brand AS accepted FROM b WHERE i = 1""")
def corroborated_match(spark, sf):
    """The best of all names, accepted by its score or by a lower one with the same brand."""
    p = table(spark, sf, "part")
    left = p.filter("p_size = 1").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    right = p.filter("p_size = 50").select(F.col("p_partkey").alias("match_id"), F.col("p_name").alias("k"), F.col("p_brand").alias("brand"))
    best = R.best_similar(left, right, "p_name", "k", "match_id", 0.4)
    return R.corroborated(best, F.col("p_brand") == F.col("brand"), 0.95, 0.4).select("id", "match_id", r("score").alias("score"), "agrees", "accepted")


@query("""WITH e AS (SELECT event_type, event_id % 5 AS m, value / (SELECT max(value) FROM events) AS s FROM events) SELECT m AS method, count(*) AS n, round(avg(s), 6) AS mean_score, round(min(s), 6) AS least_score, round(count(*) / (SELECT count(*) FROM e)::DOUBLE, 6) AS share FROM e GROUP BY 1""")
def match_method_weights(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 5).alias("method"), (F.col("value") / F.max("value").over(Window.partitionBy())).alias("score"))
    return R.method_weights(e).select("method", "n", r("mean_score", 6).alias("mean_score"), r("least_score", 6).alias("least_score"), r("share", 6).alias("share"))


@query("""SELECT event_type, round(sum(CASE WHEN v = 25 THEN 0.5 WHEN v >= 0 AND v < 4 THEN 0 WHEN v >= 4 AND v < 12 THEN (v - 4) / 8 WHEN v >= 12 AND v < 25 THEN 1 - (v - 12) * 0.5 / 13 ELSE 0 END), 5) AS total FROM (SELECT event_type, value / 5 AS v FROM events) GROUP BY 1""")
def interpolated_curve(spark, sf):
    """A curve given by points; 0 outside them."""
    y = S.interpolated("v", [(0.0, 0.0), (4.0, 0.0), (12.0, 1.0), (25.0, 0.5)])
    return table(spark, sf, "events").select("event_type", (F.col("value") / 5).alias("v")).groupBy("event_type").agg(r(F.sum(y), 5).alias("total"))


@query(f"""WITH {PLACES}, m AS (SELECT n_name AS name, lat, lon FROM nation JOIN place ON n_nationkey = k), p AS (SELECT n_name AS name, lat + n_nationkey / 100.0::DOUBLE AS lat2, lon AS lon2 FROM nation JOIN place ON n_nationkey = k WHERE n_nationkey % 3 <> 0)
SELECT name, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))), 4) AS distance_km, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))) <= 10 AS agrees FROM m JOIN p USING (name)""")
def cross_checked_places(spark, sf):
    n = table(spark, sf, "nation").join(places(spark, sf), F.col("n_nationkey") == F.col("k"))
    published = n.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"), (F.col("lat") + F.col("n_nationkey") / 100.0).alias("lat"), "lon")
    return R.cross_check(n.select(F.col("n_name").alias("name"), "lat", "lon"), published, "name", 10.0).select("name", r("distance_km").alias("distance_km"), "agrees")
