"""Fuzzy matches of texts by an index of their rarest q-grams, in place of all pairs.

One edit changes at most Q of a text's q-grams. Of two texts within t edits, with sets of a and b distinct grams, at
least max(a, b) - Q t are shared at places that differ by t at most; with all grams in one order, rarest first, the first
of these is among the first Q t + 1 of each. Texts with so few grams that nothing need be shared meet by length. The nearest texts come from rounds with
a growing bound: a text that has found enough partners within the bound is settled, as nothing outside it is nearer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved

Q = 2


def grams(texts: DataFrame, text: str) -> DataFrame:
    """text, n (characters), grams: array of distinct ones, g, with their first and last place, lo and hi."""
    n = F.char_length(text)
    d = texts.select(text).filter(F.col(text).isNotNull()).distinct().withColumn("n", n)
    d = d.withColumn("__every", F.when(F.col("n") >= Q, F.transform(F.sequence(F.lit(1), n - Q + 1), lambda i: F.substring(F.col(text), i, F.lit(Q)))).otherwise(F.array().cast("array<string>")))
    place = lambda g: F.struct(g.alias("g"), F.array_position("__every", g).alias("lo"), (F.size("__every") + 1 - F.array_position(F.reverse("__every"), g)).alias("hi"))
    return d.select(text, "n", F.transform(F.array_distinct("__every"), place).alias("grams"))


def close_pairs(left: DataFrame, right: DataFrame, key: str, other: str, reach: Callable[[Column], Column]) -> DataFrame:
    """Distinct (key, other) among which all pairs within t edits are, where t is at most reach(length) of both texts, a whole
    number that does not fall with the length. Null texts have no partner."""
    l, r = grams(left, key), grams(right, other)
    often = r.select(F.explode("grams.g").alias("g")).groupBy("g").agg(F.count("*").alias("times"))

    def rarest(d: DataFrame, text: str) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(text).orderBy(F.coalesce("times", F.lit(0)), "g"))
        rows = d.select(text, "n", F.inline("grams")).join(often, "g", "left").withColumn("first", first)
        return rows.filter(F.col("first") <= Q * reach(F.col("n")) + 1).select(text, "n", "g", "lo", "hi")

    a, b = rarest(l, key), rarest(r, other).toDF(other, "m", "g", "lo2", "hi2")
    t = F.least(reach(F.col("n")), reach(F.col("m")))
    shared = a.join(b, "g").filter((F.abs(F.col("n") - F.col("m")) <= t) & (F.col("lo") <= F.col("hi2") + t) & (F.col("lo2") <= F.col("hi") + t))
    few = lambda d: d.filter(F.size("grams") <= Q * reach(F.col("n")))
    span = F.sequence(F.greatest(F.lit(0), (F.col("n") - reach(F.col("n"))).cast("int")), (F.col("n") + reach(F.col("n"))).cast("int"))
    short = few(l).withColumn("m", F.explode(span)).join(few(r).select(other, F.col("n").alias("m")), "m")
    return shared.select(key, other).union(short.select(key, other)).distinct()


def nearest_texts(left: DataFrame, right: DataFrame, key: str, other: str, k: int = 2) -> DataFrame:
    """key, other, d: for each text of left all texts of right but itself within some number of edits, at least the k
    nearest (ties included) or all there are."""
    open_ = saved(left.select(key).filter(F.col(key).isNotNull()).distinct())
    texts = saved(right.select(other).filter(F.col(other).isNotNull()).distinct())
    longest = max(open_.agg(F.max(F.char_length(key))).first()[0] or 0, texts.agg(F.max(F.char_length(other))).first()[0] or 0)
    found, bound = [], 2
    while True:
        pairs = close_pairs(open_, texts, key, other, lambda n: F.lit(bound)).filter(F.col(key) != F.col(other))
        pairs = saved(pairs.withColumn("d", F.levenshtein(key, other, bound)).filter(F.col("d") >= 0))
        if bound >= longest:
            return _all([*found, pairs])
        settled = pairs.groupBy(key).agg(F.count("*").alias("__k")).filter(F.col("__k") >= k).select(key)
        found.append(pairs.join(settled, key, "left_semi"))
        open_ = saved(open_.join(settled, key, "left_anti"))
        if open_.isEmpty():
            return _all(found)
        bound *= 2


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def similar_texts(left: DataFrame, right: DataFrame, key: str, other: str, least: float) -> DataFrame:
    """key, other, score: distinct pairs of texts with an edit similarity (1 less the distance over the longer length) of
    `least` or more."""
    reach = lambda n: F.floor((1 - least) / least * n + 1e-9).cast("int")  # noqa: E731  the longer text is at most n / least long
    pairs = close_pairs(left, right, key, other, reach)
    score = 1 - F.levenshtein(key, other) / F.nullif(F.greatest(F.char_length(key), F.char_length(other)), F.lit(0))
    return pairs.withColumn("score", F.coalesce(score, F.lit(1.0))).filter(F.col("score") >= least)
