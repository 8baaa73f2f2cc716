"""Source divergence audit: how far apart the word frequencies of sources are, and which terms set a source apart.

1. Terms are counted in runs of text and summed by (lang, source, term) map-side; a term is kept if enough documents of
   its lang hold it.
2. Each kept term becomes one wide row: its counts as an array indexed by the sources of its lang.
3. The arrays' sums give the totals, and with them every count becomes a smoothed frequency in billionths. Higher-order
   functions over the array emit what the term adds to each pair of sources; these are summed map-side.
All arithmetic is in whole numbers; a product that could pass a long's range is worked off in three digits of base 1,000.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, release, slices, stash, text_batches

MIN_DOCS = 10
TOP = 10
SLICE = 4_000_000  # bytes of text that are counted at once
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))  # A-Z to a-z, letters and bytes beyond ASCII stay, else blank


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of each slice; a group's row without a term says that it occurs."""
    try:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                data, at = flat(b.column("text"))
                raw = data.tobytes()
                times, holding = defaultdict(Counter), defaultdict(Counter)
                for group, i, j in zip(zip(b.column("lang").to_pylist(), b.column("source").to_pylist()), at.tolist(), at[1:].tolist()):
                    own = Counter(raw[i:j].translate(LETTERS).split())
                    times[group].update(own)
                    holding[group].update(own.keys())
                lang, source, term, n, docs = [], [], [], [], []
                for group, c in times.items():
                    k = len(c) + 1
                    lang += [group[0]] * k
                    source += [group[1]] * k
                    term += [None, *c]
                    n += [0, *c.values()]
                    docs += [0, *map(holding[group].__getitem__, c)]
                column = pa.array(term, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), column, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])
    finally:
        whole = b = data = raw = times = holding = own = lang = source = term = n = docs = column = None
        release()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it): one row a group and term, and one with a null
    term for every group. Null lang, source and text are empty strings; each row of docs is a document."""
    text_batches(docs.sparkSession)
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = d.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def billionths(count: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(1000000000 * (count + 2) / (total + 2 * terms)), exact for counts of up to 9e15."""
    d = f"({total} + 2 * {terms})"
    a, b = f"({count} + 2)", f"((({count} + 2) * 1000) % {d})"
    c = f"(({b} * 1000) % {d})"
    return f"(1 + (({a} * 1000) div {d}) * 1000000 + (({b} * 1000) div {d}) * 1000 + (({c} * 1000) div {d}))"


def _apart(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div ({p} + {q}))"


def wide_terms(counts: DataFrame, groups: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, counts (array by the number of the source in its lang) of the terms in at least min_docs documents."""
    named = counts.filter("term IS NOT NULL").join(groups, ["lang", "source"])
    wide = named.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.first("width").alias("width"), F.map_from_entries(F.collect_list(F.struct("no", "n"))).alias("by"))
    wide = wide.filter(F.col("docs") >= min_docs)
    return wide.select("lang", "term", F.expr("transform(sequence(0, width - 1), i -> coalesce(element_at(by, i), 0L))").alias("counts"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: the divergence of a source from each other source of its lang, all ranks. Part `term`: the terms that a
    source has more of than its lang, by what they add to its divergence from it, ranks to `top`. Equal values rank by
    the item's bytes. Null lang, source and text are empty strings; a source without kept terms takes part with zeros; a
    lang with one source has no pairs; repeated rows count as often as they stand there; an empty table gives none.
    Other columns are not read. All pairs of sources of a lang are results; nothing else is paired."""
    counts = stash(term_counts(docs), "term-counts")
    groups = counts.filter("term IS NULL").select("lang", "source")
    by_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", (F.row_number().over(by_lang.orderBy("source")) - 1).alias("no"), F.count("*").over(by_lang).cast("int").alias("width"))
    groups = stash(groups, "term-groups")
    wide = stash(wide_terms(counts, groups, min_docs), "term-vectors")
    totals = wide.select("lang", F.posexplode("counts").alias("no", "n")).groupBy("lang", "no").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    totals = totals.groupBy("lang").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_list(F.struct("no", "n"))).alias("of"), F.sum("n").alias("total"))
    totals = stash(totals.select("lang", "terms", "total", F.transform("of", lambda x: x["n"]).alias("of")), "term-totals")
    smooth = wide.join(totals, "lang").select(
        "lang", "term", "counts", F.expr("transform(counts, (c, i) -> " + billionths("c", "of[i]", "terms") + ")").alias("p"),
        F.expr("transform(array(aggregate(counts, 0L, (s, c) -> s + c)), c -> " + billionths("c", "total", "terms") + ")[0]").alias("q"),
    )
    # what each term adds to each pair, summed map-side
    added = F.expr(f"flatten(transform(slice(p, 1, size(p) - 1), (x, i) -> transform(slice(p, i + 2, size(p)), (y, j) -> struct(i AS a, i + j + 1 AS b, {_apart('x', 'y')} AS f))))")
    sums = smooth.filter(F.size("p") > 1).select("lang", F.explode(added).alias("x")).groupBy("lang", F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("x.f").alias("f"))
    ordered = sums.select("lang", "a", "b", "f").union(sums.select("lang", "b", "a", "f")).withColumnRenamed("a", "no").withColumnRenamed("b", "other")
    names = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"))
    pairs = groups.join(names, "lang").filter("no <> other").join(ordered, ["lang", "no", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).cast("long").alias("value"))
    more = F.expr(f"filter(transform(p, (x, i) -> if(counts[i] > 0 AND x > q, struct(i AS no, {_apart('x', 'q')} AS value), null)), x -> x IS NOT NULL)")
    terms = smooth.select("lang", "term", F.explode(more).alias("x")).select("lang", "term", "x.no", "x.value")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), F.asc("item")))
    terms = terms.withColumnRenamed("term", "item").withColumn("rank", rank("lang", "no")).filter(F.col("rank") <= top)  # the limit is applied before the shuffle as well
    terms = terms.join(groups, ["lang", "no"]).select("lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return pairs.withColumn("rank", rank("lang", "source")).union(terms)


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
terms AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN terms t ON f.lang = t.lang AND f.term = t.term GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v FROM terms GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
full_table AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS p
  FROM groups g JOIN terms t ON g.lang = t.lang JOIN vocabulary v ON g.lang = v.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
whole AS (
  SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.n + 2)) // (s.n + 2 * v.v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) t JOIN (SELECT lang, sum(n) AS n FROM sizes GROUP BY lang) s ON t.lang = s.lang JOIN vocabulary v ON t.lang = v.lang),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM full_table a JOIN full_table b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
own AS (
  SELECT f.lang, f.source, 'term' AS part, f.term AS item, ((f.p - w.q) * (f.p - w.q)) // (f.p + w.q) AS value
  FROM full_table f JOIN whole w ON f.lang = w.lang AND f.term = w.term WHERE f.c > 0 AND f.p > w.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
