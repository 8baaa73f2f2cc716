"""Long time series (snapshot, name, value): resampling, runs, shares, attribution, errors, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, Window.currentRow)


def resample(df: DataFrame, ts: str, by: list[str], values: dict[str, Column], unit: str = "hour") -> DataFrame:
    """Aggregates per `by` and truncated time (`snapshot`)."""
    return df.groupBy(*by, F.date_trunc(unit, ts).alias("snapshot")).agg(*[c.alias(n) for n, c in values.items()])


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0.0))


def share(value: str, by: list) -> Column:
    """Part of the group's total, NULL where that is 0."""
    return F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*by)), F.lit(0.0))


def prorata(df: DataFrame, weight: str, total: str, by: list, name: str = "attributed") -> DataFrame:
    """Attributes a total that is known for each group to the group's rows by weight."""
    return df.withColumn(name, F.coalesce(share(weight, by), F.lit(0.0)) * F.col(total))


def dispatch_down(df: DataFrame, by: list[str], offered: str = "offered", taken: str = "taken") -> DataFrame:
    """offered, taken, lost (never below 0 in an hour) and percent lost of each group."""
    lost = F.when(F.col(offered).isNotNull() & F.col(taken).isNotNull(), F.greatest(F.col(offered) - F.col(taken), F.lit(0.0)))
    g = df.groupBy(*by).agg(F.coalesce(F.sum(offered), F.lit(0.0)).alias("offered"), F.coalesce(F.sum(taken), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(lost), F.lit(0.0)).alias("lost"))
    return g.withColumn("lost_pct", 100 * F.col("lost") / F.nullif(F.col("offered"), F.lit(0.0)))


def runs(df: DataFrame, by: list, order: list, condition: Column) -> DataFrame:
    """Runs of consecutive rows where the condition holds: by, start, end, length."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order_cols))
    d = df.withColumn("__c", condition).withColumn("__n", n)
    k = F.row_number().over(Window.partitionBy(*by, "__c").orderBy(*order_cols))
    d = d.withColumn("__g", F.col("__n") - k).filter("__c")
    return d.groupBy(*by, "__g").agg(F.min(order_cols[0]).alias("start"), F.max(order_cols[0]).alias("end"), F.count("*").alias("length")).drop("__g")


def forward_fill(df: DataFrame, by: list, order: list, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*BEFORE)))


def cumulative_share(df: DataFrame, by: list, value: str, key: str) -> DataFrame:
    """Rank from the largest value down and the share of the total held so far."""
    order = [F.col(value).desc(), F.col(key)]
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("cum_share", F.sum(value).over(w.rowsBetween(*BEFORE)) / F.nullif(F.sum(value).over(Window.partitionBy(*by)), F.lit(0.0)))


def duration_curves(df: DataFrame, by: list, columns: list[str], key: str) -> DataFrame:
    """Each column sorted downwards by itself: by, rank and the value of each column at that rank."""
    out = None
    for c in columns:
        r = df.filter(F.col(c).isNotNull()).select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(c).desc(), key)).alias("rank"), c)
        out = r if out is None else out.join(r, [*by, "rank"], "full")
    return out


def anchored(df: DataFrame, by: list, order: str, anchor, rows: int) -> DataFrame:
    """The `rows` rows centred on the first row at or after the anchor, clipped at the ends."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__n", F.row_number().over(w))
    at = F.min(F.when(F.col(order) >= anchor, F.col("__n"))).over(Window.partitionBy(*by))
    total = F.count("*").over(Window.partitionBy(*by))
    start = F.greatest(F.lit(1), F.least(at - rows // 2, total - rows + 1))
    return d.withColumn("__s", start).filter((F.col("__n") >= F.col("__s")) & (F.col("__n") < F.col("__s") + rows)).drop("__n", "__s")


def error_metrics(model: str, actual: str, capacity: Column | None = None) -> list[Column]:
    e = F.col(model) - F.col(actual)
    rmse = F.sqrt(F.avg(e * e))
    out = [
        F.count("*").alias("n"), F.corr(model, actual).alias("r"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), rmse.alias("rmse"),
    ]
    return out if capacity is None else [*out, (100 * rmse / capacity).alias("rmse_pct")]


def sign_stability(df: DataFrame, by: list, value: str, size: str, key: str) -> DataFrame:
    """Peak by absolute value, share of rows with the peak's sign, and whether the sign ever flips."""
    sign = F.when(F.col(value) < 0, -1).otherwise(1)
    peak = F.max(F.struct(F.abs(value), (-F.col(key)).alias("k"), F.col(value).alias("v"))).over(Window.partitionBy(*by))["v"]
    d = df.withColumn("__s", sign).withColumn("__p", F.when(peak < 0, -1).otherwise(1))
    return d.groupBy(*by).agg(F.avg((F.col("__s") == F.col("__p")).cast("double")).alias("agree"), (F.min("__s") != F.max("__s")).alias("flips"))


def area_prorata(df: DataFrame, offered: str, demand: str, by: list) -> DataFrame:
    """Merit-order dispatch of a copper plate: each unit of an area and hour runs at the share demand over offered, at most 1."""
    total = F.sum(offered).over(Window.partitionBy(*by))
    part = F.when(total > 0, F.least(F.lit(1.0), F.col(demand) / total)).otherwise(0.0)
    return df.withColumn("dispatched", F.col(offered) * part)


def merit_order(df: DataFrame, by: list, cost: str, offered: str, demand: str, key: str) -> DataFrame:
    """Cheapest first until the demand of the group is met; ties by key."""
    w = Window.partitionBy(*by).orderBy(cost, key).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(offered).over(w), F.lit(0.0))
    return df.withColumn("dispatched", F.greatest(F.lit(0.0), F.least(F.col(offered), F.col(demand) - before)))


def pair_correlations(df: DataFrame, name: str, ts: str, value: str) -> DataFrame:
    """corr of each pair of series over their common times (a < b)."""
    a = df.select(F.col(name).alias("a"), F.col(ts).alias("t"), F.col(value).alias("va"))
    b = df.select(F.col(name).alias("b"), F.col(ts).alias("t"), F.col(value).alias("vb"))
    return a.join(b, "t").filter("a < b").groupBy("a", "b").agg(F.corr("va", "vb").alias("r"), F.count("*").alias("n"))
