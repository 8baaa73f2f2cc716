"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. Each source gets a share of the requested words in proportion to its weight; a
source that would need more than `max_epochs` passes is clamped there and its excess goes to the others by
weight. The fixpoint of clamping and resharing is found in one pass: with sources ordered by cap over weight,
the clamped ones are a prefix. A source with target T and size S takes floor(T / S) whole repetitions of each
document and a fractional one: documents in the order of a seeded hash until T is met, the last one in part.

The running total in hash order comes from two levels: sums by (source, hash bucket), then a window inside
one bucket, so that a source with a third of all rows is spread over `BUCKETS` groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
BUCKETS = 4096  # the first three hex digits of the hash


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with `target`, one row per source. Sources by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", pick.alias("w"))
    fill = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, all_rows = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.select(
        "source", "source_size", "w",
        ((F.lit(float(share)) * F.sum("source_size").over(all_rows) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))).alias("level"),
    )
    cap = (max_epochs * F.col("source_size")).cast("double")
    s = s.withColumn("clamped", cap < F.col("w") * F.col("level"))
    level = F.min(F.when(~F.col("clamped"), F.struct((F.col("source_size") / F.col("w")).alias("o"), F.col("level").alias("level")))).over(all_rows)["level"]
    return s.select("source", "source_size", F.when(F.col("clamped"), cap).otherwise(F.least(cap, F.col("w") * F.coalesce(level, F.lit(0.0)))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, text, source -> doc_id, size, source, source_size, target, taken; a row for each row of docs.

    A null text has size 0 and takes nothing; a null source is a source of its own, the last; rows with a null
    doc_id are placed by the hash of their text. Repeated rows count as often as they stand there. An empty table gives none.
    Other columns of docs are not read. `taken` is at most max_epochs times `size`."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))))
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    base = base.withColumn("at", F.substring("key", 1, 3)).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    base = stash(base, "mix-sizes")
    per = base.groupBy("skey", "at").agg(F.first("source").alias("source"), F.sum("size").alias("part"))
    by = per.groupBy("skey").agg(F.first("source").alias("source"), F.sum("part").alias("source_size"))
    plan = source_targets(by.select("source", "source_size"), weights, share, max_epochs)
    plan = plan.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    words = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs).cast("long"), F.floor(words / F.col("source_size")).cast("long"))).otherwise(F.lit(0).cast("long"))
    parts = per.select("skey", "at", F.coalesce(F.sum("part").over(Window.partitionBy("skey").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    parts = parts.join(plan, "skey").select("skey", "at", "before", "source_size", "target", whole.alias("whole"), (words - whole * F.col("source_size")).alias("rest"))
    inside = Window.partitionBy("skey", "at").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("prior", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["skey", "at"])
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("prior")))
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: docs with each row as often as the mix takes it, columns unchanged.

    A fractional repetition counts as whole where it takes at least half of the document. Rows without words
    (size 0) stay once: they weigh nothing. Rows that share a doc_id are taken alike, by the most that one of them takes."""
    taken = mix(docs, **parameters).groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1)).cast("int").alias("__times"))
    out = docs.join(taken.withColumnRenamed("doc_id", "__id"), docs["doc_id"].eqNullSafe(F.col("__id")))
    return out.filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM src),
levels AS (
  SELECT *, source_size / w AS o,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2 * coalesce(sum(source_size) OVER b, 0)::DOUBLE) / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM weighed WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, (2 * source_size)::DOUBLE < w * level AS clamped FROM levels),
plan AS (
  SELECT source, source_size, CASE WHEN clamped THEN (2 * source_size)::DOUBLE ELSE
    least((2 * source_size)::DOUBLE, w * coalesce((SELECT level FROM flagged WHERE NOT clamped ORDER BY o, source NULLS LAST LIMIT 1), 0)) END AS target FROM flagged),
whole AS (
  SELECT *, floor(target + 0.5)::BIGINT AS words, CASE WHEN source_size > 0 THEN least(2, floor(floor(target + 0.5) / source_size))::BIGINT ELSE 0 END AS n FROM plan),
placed AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.n, p.words - p.n * p.source_size AS rest,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id NULLS FIRST, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
  FROM base b JOIN whole p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (n * size + greatest(0, least(size, rest - prior)))::BIGINT AS taken FROM placed
"""
