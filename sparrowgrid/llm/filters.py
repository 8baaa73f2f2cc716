"""Filter interaction audit: what each of several filters removes in every order of applying them.

A document fails some set of the filters, its mask. In whatever order filters run, what one of them meets depends only
on the set that ran before it: the lattice of subsets has an edge from a set to that set with one filter more, 80 edges
for five filters, and an order is a path of five edges from the empty set to the full one. Documents are counted by
(part, mask); each count contributes to the 80 edges, the edges are summed, and the 600 steps of the 120 orders are
joined to them. Documents are read once, whatever the number of orders, and a group of any size is summed map-side.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

BLANK = "\t\n\x0b\x0c\r"
LEAST_WORDS = 200


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a text alone fails a filter, by letter."""
    words = F.array_remove(F.split(F.translate(text, BLANK, " " * len(BLANK)), " "), "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))  # words are found once
    n = F.get(counts, F.lit(0))
    return {
        "A": n["n"] < LEAST_WORDS,
        "B": 100 * n["distinct"].cast("long") < 50 * n["n"].cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: documents by part, set of failed filters (bit i for letter i) and label.

    A null text is empty, a null part the empty string. Filter E (the text of a smaller doc_id again) sees the whole
    table: a row without a doc_id neither fails it nor makes others fail. Rows that share a doc_id count one by one, and
    do not fail E by one another. Of several labels of a doc_id the highest counts; without a label, or with a null one,
    a document is neither good nor toxic. Other columns are not read."""
    text = F.coalesce("text", F.lit(""))
    own = text_filters(F.col("text"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), text.alias("text"))
    rows = stash(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits")), "audit-rows")
    known, nameless = rows.filter("doc_id IS NOT NULL"), rows.filter("doc_id IS NULL")
    # a text's first rows are met by both columns, so a text that many rows hold is dealt out by their ids
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = known.join(first, ["doc_id", "digest"], "left")
    label = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.join(label, "doc_id", "left")
    last = 1 << len(own)
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    seen = known.select("part", (F.col("bits") + F.when(F.col("first"), 0).otherwise(last)).alias("mask"), flag("quality").alias("good"), flag("toxic").alias("toxic"))
    seen = seen.union(nameless.select("part", F.col("bits").alias("mask"), F.lit(False), F.lit(False)))
    return seen.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def edges(counted: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """part, mask, good, toxic, n -> for each part and each of the lattice's edges (before: the set that ran, bit: the
    next filter): kept, removed, redundant, unique_fails, good_lost, toxic_lost, and the orders that pass the edge."""
    k = len(letters)
    lattice = [(s, i) for s in range(1 << k) for i in range(k) if not s >> i & 1]
    paths = {s: factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s, _ in lattice}
    listed = F.expr("array(" + ", ".join(f"struct({s} AS before, {i} AS bit, {paths[s]}L AS orders)" for s, i in lattice) + ")")
    e = counted.withColumn("edge", F.explode(listed)).select("part", "mask", "good", "toxic", "n", "edge.*")
    fails = F.expr("mask & shiftleft(1, bit)") != 0
    met = F.expr("mask & before") == 0  # no filter before it has removed the document
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return e.groupBy("part", "before", "bit", "orders").agg(
        total(met & ~fails).alias("kept"), total(met & fails).alias("removed"), total(~met & fails).alias("redundant"), total(F.expr("mask = shiftleft(1, bit)")).alias("unique_fails"),
        total(met & fails & F.col("good")).alias("good_lost"), total(met & fails & F.col("toxic")).alias("toxic_lost"),
    )


def orders(spark, letters: str = "ABCDE") -> DataFrame:
    """filter_order, step, before, bit: the steps of every order of the filters."""
    rows = [("".join(p), j + 1, sum(1 << letters.index(c) for c in p[:j]), letters.index(p[j])) for p in permutations(letters) for j in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, bit int")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row for each part that occurs, order and step, zeros included. `shapley` is what the step's filter removes, summed
    over all orders: its edges' counts, each as often as orders pass it. Without documents there are no rows."""
    e = stash(edges(masks(docs, labels, part), letters), "audit-edges")
    share = e.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    out = e.join(share, ["part", "bit"]).join(F.broadcast(orders(docs.sparkSession, letters)), ["before", "bit"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filters(spark, sf_dir: str) -> DataFrame:
    return audit(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
labelled AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
rows AS (
  SELECT d.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
    [x.letter FOR x IN [
      {'letter': 'A', 'fails': len(d.w) < 200}, {'letter': 'B', 'fails': 100 * len(list_distinct(d.w)) < 50 * len(d.w)},
      {'letter': 'C', 'fails': 100 * len(regexp_extract_all(d.t, '[A-Z]')) > 3 * length(d.t)}, {'letter': 'D', 'fails': regexp_matches(d.t, '[#$%&*|]')},
      {'letter': 'E', 'fails': coalesce(d.doc_id > f.first, false)}] IF x.fails] AS failed
  FROM words d JOIN firsts f ON d.t = f.t LEFT JOIN labelled l ON d.doc_id = l.doc_id),
counted AS (SELECT part, failed, good, toxic, count(*) AS n FROM rows GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
met AS (
  SELECT s.o, s.step, c.*, list_contains(c.failed, s.o[s.step]) AS fails, coalesce(list_has_any(c.failed, s.o[1:s.step - 1]), false) AS gone
  FROM steps s, counted c),
summed AS (
  SELECT part, o, step, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND len(failed) = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0) AS toxic_lost
  FROM met GROUP BY part, o, step)
SELECT part, array_to_string(o, '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
FROM summed
"""
