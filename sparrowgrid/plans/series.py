"""Queries on time series, attribution, errors and statistics, and the SQL for each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import series as T
from .relational import HOURLY, KM, PLACES, TRADE, hourly, places, query, r, table, trade


@query(f"""WITH e AS (SELECT user_id, event_type, value, date_trunc('hour', ts) AS h FROM events), w AS (SELECT h, user_id, sum(value) AS offered, sum(CASE WHEN event_type = 'error' THEN 0 ELSE value END) AS used FROM e GROUP BY 1, 2),
a AS (SELECT *, offered / nullif(sum(offered) OVER (PARTITION BY h), 0) * (sum(offered) OVER (PARTITION BY h) - sum(used) OVER (PARTITION BY h)) AS lost FROM w)
SELECT (user_id % 10)::BIGINT AS grp, count(DISTINCT user_id) AS farms, round(sum(offered), 2) AS available, round(sum(lost), 2) AS curtailed, round(100 * sum(lost) / nullif(sum(offered), 0), 4) AS curtailed_pct FROM a GROUP BY 1 ORDER BY 1""")
def prorata_attribution(spark, sf):
    used = F.sum(F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")))
    w = T.resample(table(spark, sf, "events"), "ts", ["user_id"], {"offered": F.sum("value"), "used": used})
    hour = Window.partitionBy("snapshot")
    a = T.prorata(w.withColumn("total", F.sum("offered").over(hour) - F.sum("used").over(hour)), "offered", "total", ["snapshot"], "lost")
    g = a.groupBy((F.col("user_id") % 10).alias("grp")).agg(F.countDistinct("user_id").alias("farms"), F.sum("offered").alias("o"), F.sum("lost").alias("l"))
    return g.select("grp", "farms", r("o", 2).alias("available"), r("l", 2).alias("curtailed"), r(100 * F.col("l") / F.nullif("o", F.lit(0.0))).alias("curtailed_pct")).orderBy("grp")


@query(f"WITH {HOURLY} SELECT event_type, snapshot, round(v, 4) AS v, n FROM hourly")
def hourly_resample(spark, sf):
    return hourly(spark, sf).select("event_type", "snapshot", r("v").alias("v"), "n")


@query("""SELECT (user_id % 5)::BIGINT AS grp, date_trunc('day', ts) AS snapshot, round(sum(value * (1 + user_id % 7)) / nullif(sum(1 + user_id % 7), 0), 4) AS v FROM events GROUP BY 1, 2""")
def weighted_mean_group_hour(spark, sf):
    e = table(spark, sf, "events").withColumn("grp", F.col("user_id") % 5).withColumn("cap", (1 + F.col("user_id") % 7).cast("double"))
    return T.resample(e, "ts", ["grp"], {"v": r(T.weighted_mean("value", "cap"))}, "day")


@query("SELECT date_trunc('hour', ts) AS snapshot, round(sum(value), 2) AS mw, count(DISTINCT user_id) AS units FROM events GROUP BY 1")
def fleet_series(spark, sf):
    return T.resample(table(spark, sf, "events"), "ts", [], {"mw": r(F.sum("value"), 2), "units": F.countDistinct("user_id")})


@query("""SELECT bus, round(sum(p), 2) AS p FROM (SELECT s_nationkey AS bus, s_acctbal AS p FROM supplier UNION ALL SELECT c_nationkey, -c_acctbal FROM customer
UNION ALL SELECT c_nationkey, 0.95 * o_totalprice / 1000 FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def signed_injections(spark, sf):
    c = table(spark, sf, "customer")
    link = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", 0.95 * F.col("o_totalprice") / 1000)
    p = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("bus"), F.col("s_acctbal").alias("p")).union(c.select("c_nationkey", -F.col("c_acctbal"))).union(link)
    return p.groupBy("bus").agg(r(F.sum("p"), 2).alias("p"))


LOST = """SELECT user_id, event_type, value AS offered, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * (0.6 + (event_id % 9) / 10.0::DOUBLE) END AS taken FROM events"""


def offered(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("user_id", "event_type", F.col("value").alias("offered"), F.when(k % 11 != 0, F.col("value") * (0.6 + (k % 9) / 10.0)).alias("taken"))


def _lost(spark, sf, by):
    d = T.dispatch_down(offered(spark, sf), [by])
    return d.select(by, *[r(c).alias(c) for c in ("offered", "taken", "lost", "lost_pct")])


def _lost_sql(by):
    return f"""SELECT {by}, round(sum(offered), 4) AS offered, round(coalesce(sum(taken), 0), 4) AS taken, round(coalesce(sum(CASE WHEN taken IS NOT NULL THEN greatest(offered - taken, 0) END), 0), 4) AS lost,
round(100 * coalesce(sum(CASE WHEN taken IS NOT NULL THEN greatest(offered - taken, 0) END), 0) / nullif(sum(offered), 0), 4) AS lost_pct FROM ({LOST}) GROUP BY 1"""


@query(_lost_sql("user_id"))
def dispatch_down(spark, sf):
    return _lost(spark, sf, "user_id")


@query(_lost_sql("event_type"))
def dispatch_down_by_class(spark, sf):
    return _lost(spark, sf, "event_type")


@query("""WITH l AS (SELECT l_suppkey AS line, date_trunc('month', l_shipdate) AS h, sum(l_quantity) / 60 AS loading FROM lineitem GROUP BY 1, 2)
SELECT line, count(*) FILTER (loading >= 0.999) AS hours, round(max(loading), 4) AS peak FROM l GROUP BY 1 HAVING count(*) FILTER (loading >= 0.999) > 0""")
def binding_hours(spark, sf):
    l = T.resample(table(spark, sf, "lineitem"), "l_shipdate", ["l_suppkey"], {"q": F.sum("l_quantity")}, "month").withColumn("loading", F.col("q") / 60)
    return l.groupBy(F.col("l_suppkey").alias("line")).agg(F.count_if(F.col("loading") >= 0.999).alias("hours"), r(F.max("loading")).alias("peak")).filter("hours > 0")


@query("""WITH l AS (SELECT l_suppkey AS line, date_trunc('month', l_shipdate) AS h, sum(l_quantity) / 60 AS loading FROM lineitem GROUP BY 1, 2), b AS (SELECT * FROM l WHERE loading >= 0.999)
SELECT (SELECT count(DISTINCT h) FROM b) AS hours_with, (SELECT count(DISTINCT line) FROM b) AS lines_ever, (SELECT count(*) FROM b) AS line_hours, (SELECT max(n) FROM (SELECT count(*) AS n FROM b GROUP BY h)) AS most_at_once""")
def binding_report(spark, sf):
    l = T.resample(table(spark, sf, "lineitem"), "l_shipdate", ["l_suppkey"], {"q": F.sum("l_quantity")}, "month").filter(F.col("q") / 60 >= 0.999)
    per = l.groupBy("snapshot").agg(F.count("*").alias("n"))
    return l.agg(F.countDistinct("snapshot").alias("hours_with"), F.countDistinct("l_suppkey").alias("lines_ever"), F.count("*").alias("line_hours")).crossJoin(per.agg(F.max("n").alias("most_at_once")))


@query(f"""WITH {TRADE}, s AS (SELECT a AS node, b, (w / sum(w) OVER (PARTITION BY b) - 0.04) * CASE WHEN (a + b) % 3 = 0 THEN -1 ELSE 1 END AS s, qty FROM trade)
SELECT node, count(*) FILTER (abs(s) >= 0.01) AS reach, count(*) FILTER (s >= 0.01) AS helps, count(*) FILTER (s <= -0.01) AS hurts, round(max(abs(s)), 6) AS depth,
round(coalesce(sum(CASE WHEN s >= 0.01 THEN s * qty END), 0), 3) AS relief, round(coalesce(sum(CASE WHEN s <= -0.01 THEN -s * qty END), 0), 3) AS harm,
round(coalesce(sum(CASE WHEN abs(s) >= 0.01 THEN s * qty END), 0), 3) AS net FROM s GROUP BY 1""")
def reach_relief_harm(spark, sf):
    w = Window.partitionBy("b")
    s = trade(spark, sf).withColumn("s", (F.col("w") / F.sum("w").over(w) - 0.04) * F.when((F.col("a") + F.col("b")) % 3 == 0, -1).otherwise(1))
    x, q = F.col("s"), F.col("qty")
    total = lambda c, v: r(F.coalesce(F.sum(F.when(c, v)), F.lit(0.0)), 3)
    return s.groupBy(F.col("a").alias("node")).agg(F.count_if(F.abs(x) >= 0.01).alias("reach"), F.count_if(x >= 0.01).alias("helps"), F.count_if(x <= -0.01).alias("hurts"), r(F.max(F.abs(x)), 6).alias("depth"), total(x >= 0.01, x * q).alias("relief"), total(x <= -0.01, -x * q).alias("harm"), total(F.abs(x) >= 0.01, x * q).alias("net"))


@query(f"""WITH {HOURLY}, p AS (SELECT a.snapshot, a.v AS model, b.v AS actual FROM hourly a JOIN hourly b ON a.snapshot = b.snapshot WHERE a.event_type = 'click' AND b.event_type = 'view')
SELECT count(*) AS n, round(corr(model, actual), 6) AS r, round(avg(abs(model - actual)), 4) AS mae, round(avg(model - actual), 4) AS bias, round(sqrt(avg(pow(model - actual, 2))), 4) AS rmse FROM p""")
def error_metrics(spark, sf):
    h = hourly(spark, sf)
    p = h.filter("event_type = 'click'").select("snapshot", F.col("v").alias("model")).join(h.filter("event_type = 'view'").select("snapshot", F.col("v").alias("actual")), "snapshot")
    m = p.agg(*T.error_metrics("model", "actual"))
    return m.select("n", r("r", 6).alias("r"), *[r(c).alias(c) for c in ("mae", "bias", "rmse")])


@query(f"""WITH {HOURLY}, p AS (SELECT a.snapshot, a.v AS model, b.v AS actual FROM hourly a JOIN hourly b ON a.snapshot = b.snapshot WHERE a.event_type = 'click' AND b.event_type = 'view'), q AS (SELECT unnest([0.8, 0.9, 1.0, 1.1]) AS k)
SELECT round(k, 1) AS k, round(avg(model * k - actual), 4) AS bias, round(sqrt(avg(pow(model * k - actual, 2))), 4) AS rmse FROM p, q GROUP BY 1""")
def calibration_sweep(spark, sf):
    h = hourly(spark, sf)
    p = h.filter("event_type = 'click'").select("snapshot", F.col("v").alias("model")).join(h.filter("event_type = 'view'").select("snapshot", F.col("v").alias("actual")), "snapshot")
    swept = p.withColumn("k", F.explode(F.array(*map(F.lit, (0.8, 0.9, 1.0, 1.1))))).withColumn("model", F.col("model") * F.col("k"))
    m = swept.groupBy("k").agg(*T.error_metrics("model", "actual"))
    return m.select("k", r("bias").alias("bias"), r("rmse").alias("rmse"))


@query("""WITH s AS (SELECT s_nationkey AS k, sum(s_acctbal) AS x, count(*) AS y FROM supplier GROUP BY 1), q AS (SELECT rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y DESC) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM s)
SELECT CASE WHEN count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN round(corr(rx, ry), 6) END AS rho FROM q""")
def spearman_avg_rank(spark, sf):
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("x"), F.count("*").alias("y"))
    return R.average_rank(R.average_rank(s, "x", "rx"), "y", "ry").agg(r(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")), 6).alias("rho"))


@query("""WITH u AS (SELECT label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), x AS (SELECT label, unnest(e) / n AS v, unnest(range(len(e))) AS i FROM u),
s AS (SELECT label, i, sum(v) AS s, count(*) AS n FROM x GROUP BY 1, 2) SELECT label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 5) AS cosine FROM s GROUP BY 1""")
def group_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    s = e.withColumn("norm", norm).select("label", "norm", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    return s.groupBy("label").agg(F.max("n").alias("n"), r((F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1)), 5).alias("cosine"))


@query(f"""WITH e AS (SELECT user_id % 12 AS u, date_trunc('day', ts) AS t, sum(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT a.u AS a, b.u AS b, corr(a.v, b.v) AS r FROM e a JOIN e b ON a.t = b.t AND a.u < b.u GROUP BY 1, 2),
{PLACES}, d AS (SELECT c.*, {KM} AS km FROM c JOIN place x ON a = x.k JOIN place y ON b = y.k) SELECT (floor(km / 100) * 100)::INT AS band, count(*) AS pairs, round(avg(r), 5) AS mean_r FROM d GROUP BY 1""")
def pair_correlation_bands(spark, sf):
    e = T.resample(table(spark, sf, "events").withColumn("u", F.col("user_id") % 12), "ts", ["u"], {"v": F.sum("value")}, "day")
    p = places(spark, sf)
    c = T.pair_correlations(e, "u", "snapshot", "v").join(F.broadcast(p.toDF("a", "lat1", "lon1")), "a").join(F.broadcast(p.toDF("b", "lat2", "lon2")), "b")
    km = S.haversine_km("lat1", "lon1", "lat2", "lon2")
    return c.groupBy((F.floor(km / 100) * 100).cast("int").alias("band")).agg(F.count("*").alias("pairs"), r(F.avg("r"), 5).alias("mean_r"))


@query(f"""WITH e AS (SELECT user_id % 12 AS u, date_trunc('day', ts) AS t, sum(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT a.u AS a, b.u AS b, corr(a.v, b.v) AS r FROM e a JOIN e b ON a.t = b.t AND a.u < b.u GROUP BY 1, 2),
{PLACES}, d AS (SELECT ln(r) AS y, {KM} AS km FROM c JOIN place x ON a = x.k JOIN place y ON b = y.k WHERE r > 0.01) SELECT count(*) AS n, round(regr_slope(y, km), 8) AS slope FROM d""")
def decay_fit(spark, sf):
    e = T.resample(table(spark, sf, "events").withColumn("u", F.col("user_id") % 12), "ts", ["u"], {"v": F.sum("value")}, "day")
    p = places(spark, sf)
    c = T.pair_correlations(e, "u", "snapshot", "v").filter("r > 0.01").join(F.broadcast(p.toDF("a", "lat1", "lon1")), "a").join(F.broadcast(p.toDF("b", "lat2", "lon2")), "b")
    d = c.select(F.ln("r").alias("y"), S.haversine_km("lat1", "lon1", "lat2", "lon2").alias("km"))
    return d.agg(F.count("*").alias("n"), r(F.regr_slope("y", "km"), 8).alias("slope"))


@query("""WITH o AS (SELECT c_nationkey AS k, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT k, row_number() OVER w AS rank, round(sum(v) OVER w / sum(v) OVER (), 6) AS cum_share FROM o WINDOW w AS (ORDER BY v DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def lorenz_share(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return T.cumulative_share(o, [], "v", "k").select("k", F.col("rank").cast("long"), r("cum_share", 6).alias("cum_share"))


@query(f"""WITH {HOURLY}, c AS (SELECT event_type, snapshot, v < 45 AS calm FROM hourly), g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY snapshot) - row_number() OVER (PARTITION BY event_type, calm ORDER BY snapshot) AS g FROM c),
q AS (SELECT event_type, g, count(*) AS n FROM g WHERE calm GROUP BY 1, 2) SELECT event_type, max(n) AS longest, count(*) AS runs FROM q GROUP BY 1""")
def longest_run(spark, sf):
    return T.runs(hourly(spark, sf), ["event_type"], ["snapshot"], F.col("v") < 45).groupBy("event_type").agg(F.max("length").alias("longest"), F.count("*").alias("runs"))


@query(f"""WITH {HOURLY}, x AS (SELECT event_type, snapshot, CASE WHEN date_part('hour', snapshot) % 6 = 0 THEN round(v, 4) END AS mark FROM hourly)
SELECT event_type, snapshot, last_value(mark IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY snapshot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM x""")
def forward_fill(spark, sf):
    x = hourly(spark, sf).withColumn("mark", F.when(F.hour("snapshot") % 6 == 0, F.round("v", 4)))
    return T.forward_fill(x, ["event_type"], ["snapshot"], "mark", "filled").select("event_type", "snapshot", "filled")


@query("""SELECT user_id, round(avg(gap), 1) AS mean_gap, count(*) AS steps FROM (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1000000.0::DOUBLE AS gap FROM events) WHERE gap > 0 GROUP BY 1""")
def successive_gap(spark, sf):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    e = table(spark, sf, "events").withColumn("sec", sec)
    g = e.withColumn("gap", F.col("sec") - F.lag("sec").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("gap > 0")
    return g.groupBy("user_id").agg(r(F.avg("gap"), 1).alias("mean_gap"), F.count("*").alias("steps"))


@query(f"""WITH {TRADE}, k AS (SELECT a, b, w, lead(w) OVER x AS second, row_number() OVER x AS i FROM trade WINDOW x AS (PARTITION BY a ORDER BY w DESC, b)) SELECT a, b AS best, round(w, 2) AS w, round(w - second, 2) AS margin FROM k WHERE i = 1""")
def runner_up_margin(spark, sf):
    return R.runner_up(trade(spark, sf), ["a"], [F.desc("w"), "b"], "w").select("a", F.col("b").alias("best"), r("w", 2).alias("w"), r("margin", 2).alias("margin"))


@query(f"WITH {HOURLY} SELECT event_type, arg_max(snapshot, (round(s, 4), -epoch(snapshot))) AS peak, round(max(s), 2) AS s FROM hourly GROUP BY 1")
def peak_hour(spark, sf):
    key = F.struct(F.round("s", 4), -F.unix_timestamp(F.col("snapshot").cast("timestamp")))
    return hourly(spark, sf).groupBy("event_type").agg(F.max_by("snapshot", key).alias("peak"), r(F.max("s"), 2).alias("s"))


@query(f"""WITH {HOURLY}, x AS (SELECT event_type, epoch(snapshot)::BIGINT AS t, v - 50 AS f FROM hourly), p AS (SELECT *, first_value(f) OVER (PARTITION BY event_type ORDER BY abs(f) DESC, t) AS peak FROM x)
SELECT event_type, round(avg(CASE WHEN (f < 0) = (peak < 0) THEN 1.0 ELSE 0.0 END), 6) AS agree, min(f < 0) <> max(f < 0) AS flips FROM p GROUP BY 1""")
def sign_stability(spark, sf):
    x = hourly(spark, sf).select("event_type", F.unix_timestamp(F.col("snapshot").cast("timestamp")).alias("t"), (F.col("v") - 50).alias("f"))
    return T.sign_stability(x, ["event_type"], "f", "f", "t").select("event_type", r("agree", 6).alias("agree"), "flips")


@query(f"""WITH {HOURLY}, a AS (SELECT event_type, round(v, 4) AS v, row_number() OVER (PARTITION BY event_type ORDER BY round(v, 4) DESC, snapshot) AS rank FROM hourly), b AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, snapshot) AS rank FROM hourly)
SELECT event_type, rank, v, n FROM a FULL JOIN b USING (event_type, rank)""")
def duration_curve(spark, sf):
    h = hourly(spark, sf).withColumn("v", F.round("v", 4))
    return T.duration_curves(h, ["event_type"], ["v", "n"], "snapshot").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {HOURLY}, k AS (SELECT event_type, snapshot, round(v, 4) AS v, row_number() OVER (PARTITION BY event_type ORDER BY snapshot) AS i, count(*) OVER (PARTITION BY event_type) AS total FROM hourly),
m AS (SELECT *, min(CASE WHEN snapshot >= TIMESTAMP '2024-01-15 12:00:00' THEN i END) OVER (PARTITION BY event_type) AS mid FROM k) SELECT event_type, snapshot, v FROM m WHERE i >= greatest(1, least(mid - 84, total - 167)) AND i < greatest(1, least(mid - 84, total - 167)) + 168""")
def anchor_window(spark, sf):
    h = hourly(spark, sf).withColumn("v", F.round("v", 4))
    return T.anchored(h, ["event_type"], "snapshot", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 168).select("event_type", "snapshot", "v")


@query("""WITH o AS (SELECT n_regionkey AS area, s_suppkey, greatest(s_acctbal, 0) AS offered FROM supplier JOIN nation ON s_nationkey = n_nationkey), d AS (SELECT n_regionkey AS area, 0.2 * sum(c_acctbal) / 10 AS demand FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT s_suppkey, area, round(offered * CASE WHEN sum(offered) OVER (PARTITION BY area) > 0 THEN least(1, demand / sum(offered) OVER (PARTITION BY area)) ELSE 0 END, 3) AS dispatched FROM o JOIN d USING (area)""")
def prorata_dispatch(spark, sf):
    return T.area_prorata(_supply(spark, sf), "offered", "demand", ["area"]).select("s_suppkey", "area", r("dispatched", 3).alias("dispatched"))


def _supply(spark, sf):
    n = table(spark, sf, "nation")
    o = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("area"), "s_suppkey", F.greatest("s_acctbal", F.lit(0.0)).alias("offered"))
    d = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("area")).agg((0.2 * F.sum("c_acctbal") / 10).alias("demand"))
    return o.join(d, "area")


@query("""WITH o AS (SELECT n_regionkey AS area, s_suppkey, greatest(s_acctbal, 0) AS offered FROM supplier JOIN nation ON s_nationkey = n_nationkey), d AS (SELECT n_regionkey AS area, 0.2 * sum(c_acctbal) / 10 AS demand FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
b AS (SELECT *, coalesce(sum(offered) OVER (PARTITION BY area ORDER BY s_suppkey % 7, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o JOIN d USING (area)) SELECT s_suppkey, area, round(greatest(0, least(offered, demand - before)), 3) AS dispatched FROM b""")
def merit_order_dispatch(spark, sf):
    s = _supply(spark, sf).withColumn("cost", F.col("s_suppkey") % 7)
    return T.merit_order(s, ["area"], "cost", "offered", "demand", "s_suppkey").select("s_suppkey", "area", r("dispatched", 3).alias("dispatched"))


@query("""WITH u AS (SELECT user_id, user_id % 25 AS bus, date_trunc('day', ts) AS d, sum(value) AS mw FROM events GROUP BY 1, 2, 3), b AS (SELECT bus, d, sum(mw) AS mw FROM u GROUP BY 1, 2), c AS (SELECT bus, count(DISTINCT user_id) AS farms, sum(m) AS cap FROM (SELECT user_id, bus, max(mw) AS m FROM u GROUP BY 1, 2) GROUP BY 1)
SELECT bus, farms, round(cap, 2) AS capacity, round(avg(mw), 2) AS mean_mw, round(max(mw), 2) AS peak_mw, round(avg(mw) / nullif(cap, 0), 5) AS cf FROM b JOIN c USING (bus) GROUP BY bus, farms, cap""")
def bus_rollup(spark, sf):
    u = T.resample(table(spark, sf, "events").withColumn("bus", F.col("user_id") % 25), "ts", ["user_id", "bus"], {"mw": F.sum("value")}, "day")
    cap = u.groupBy("user_id", "bus").agg(F.max("mw").alias("m")).groupBy("bus").agg(F.count("*").alias("farms"), F.sum("m").alias("cap"))
    b = u.groupBy("bus", "snapshot").agg(F.sum("mw").alias("mw")).groupBy("bus").agg(F.avg("mw").alias("mean"), F.max("mw").alias("peak"))
    return b.join(cap, "bus").select("bus", "farms", r("cap", 2).alias("capacity"), r("mean", 2).alias("mean_mw"), r("peak", 2).alias("peak_mw"), r(F.col("mean") / F.nullif("cap", F.lit(0.0)), 5).alias("cf"))


DRAWS = 40


@query(f"""WITH u AS (SELECT vec_id AS k, label, embedding[1]::DOUBLE AS x FROM embeddings), obs AS (SELECT label, avg(x) AS m, count(*) AS n FROM u GROUP BY 1), draws AS (SELECT unnest(range({DRAWS})) AS d),
ranked AS (SELECT d, x, row_number() OVER (PARTITION BY d ORDER BY md5(d || ':' || k), k) AS i FROM u, draws), nul AS (SELECT label, d, avg(ranked.x) AS m FROM obs JOIN ranked ON i <= obs.n GROUP BY 1, 2)
SELECT label, any_value(n) AS n, round(any_value(obs.m), 6) AS observed, round(avg(nul.m), 6) AS null_mean, round((count(*) FILTER (nul.m < obs.m) + 1) / ({DRAWS} + 1.0::DOUBLE), 6) AS p_rank, round(({DRAWS} - count(*) FILTER (nul.m < obs.m)) / ({DRAWS} + 1.0::DOUBLE), 6) AS p_above FROM obs JOIN nul USING (label) GROUP BY 1""")
def null_test_pvalue(spark, sf):
    u = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), "label", F.element_at("embedding", 1).cast("double").alias("x"))
    obs = u.groupBy("label").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    drawn = u.select("k", "x", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("d"))
    drawn = drawn.withColumn("i", F.row_number().over(Window.partitionBy("d").orderBy(F.md5(F.concat_ws(":", "d", "k")), "k")))
    nul = F.broadcast(obs).join(drawn, F.col("i") <= F.col("n")).groupBy("label", "d").agg(F.avg("x").alias("nm"))
    below = F.count_if(F.col("nm") < F.col("m"))
    g = obs.join(nul, "label").groupBy("label").agg(F.first("n").alias("n"), r(F.first("m"), 6).alias("observed"), r(F.avg("nm"), 6).alias("null_mean"), below.alias("b"))
    return g.select("label", "n", "observed", "null_mean", r((F.col("b") + 1) / (DRAWS + 1.0), 6).alias("p_rank"), r((DRAWS - F.col("b")) / (DRAWS + 1.0), 6).alias("p_above"))


@query(f"""WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS one, sum(l_quantity * (1 - l_discount)) AS two FROM lineitem GROUP BY 1), d AS (SELECT unnest(range({DRAWS})) AS d), n AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS c FROM a),
pick AS (SELECT d, i, (('0x' || substr(md5(d || '/' || i), 1, 8))::BIGINT % c) AS j FROM n, d), s AS (SELECT d, 100 * (1 - sum(two) / sum(one)) AS saving FROM pick JOIN n ON pick.j = n.i GROUP BY 1)
SELECT round((SELECT 100 * (1 - sum(two) / sum(one)) FROM a), 6) AS saving, round(quantile_cont(saving, 0.025), 6) AS low, round(quantile_cont(saving, 0.975), 6) AS high, (SELECT count(*) FROM a WHERE two < one) AS wins, (SELECT round(median(one - two), 6) FROM a) AS median_gain FROM s""")
def paired_saving_ci(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("one"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("two"))
    a, c = R.numbered(a, ["k"], "i")
    i = spark.range(0, c, 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).select(F.col("id").alias("at"))  # a row's place
    pick = i.select("at", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("d")).select("d", (F.conv(F.substring(F.md5(F.concat_ws("/", "d", "at")), 1, 8), 16, 10).cast("long") % c).alias("j"))
    s = pick.join(a.select("i", "one", "two").hint("shuffle_hash"), F.col("j") == F.col("i")).groupBy("d").agg((100 * (1 - F.sum("two") / F.sum("one"))).alias("s"))
    ci = s.agg(r(F.percentile("s", 0.025), 6).alias("low"), r(F.percentile("s", 0.975), 6).alias("high"))
    whole = a.agg(r(100 * (1 - F.sum("two") / F.sum("one")), 6).alias("saving"), F.count_if(F.col("two") < F.col("one")).alias("wins"), r(F.percentile(F.col("one") - F.col("two"), 0.5), 6).alias("median_gain"))
    return whole.crossJoin(ci)


@query(f"""WITH {HOURLY} SELECT event_type, snapshot, round(degrees(acos(greatest(-1, least(1, sin(radians(53.3)) * sin(decl) + cos(radians(53.3)) * cos(decl) * cos(radians((date_part('hour', snapshot) * 60 + eot - 4 * 6.3) / 4 - 180)))))), 4) AS zenith FROM (
SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eot, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl
FROM (SELECT *, 2 * pi() / 365 * (dayofyear(snapshot) - 1 + (date_part('hour', snapshot) - 12) / 24.0::DOUBLE) AS g FROM hourly)) WHERE event_type = 'click'""")
def solar_zenith(spark, sf):
    return hourly(spark, sf).filter("event_type = 'click'").select("event_type", "snapshot", r(S.solar_zenith("snapshot", F.lit(53.3), F.lit(-6.3))).alias("zenith"))
