"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors become rows of whole numbers. The corpus is cut into blocks, turned into posting lists: for each dimension the
rows that are not zero there, with their values. The query rows are cut into blocks as well and every corpus block meets
every query block once, as an equi-join of blocks. For a pair of blocks, each sparse query row scatters its weight times
the postings of its terms into a dense array of scores, term by term; partition selection keeps the k best of the block,
and the survivors merge. The query set is part of the request; nothing is broadcast. Rows move (query blocks) times and
queries (corpus blocks) times, so both blocks are as large as a worker can hold.

Scores are exact. Where the products of two blocks might leave 64 bits, they are summed as Python's unbounded integers;
survivors are merged by an order key that holds the whole number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

QUERY_BLOCK = 16_384  # rows, at most
CORPUS_BLOCK = 65_536  # rows, at most
LEAST_BLOCK = 1024  # rows; a small corpus is cut into as many blocks as there are partitions, but no smaller
K = 5
EVERY = 50
SCALE = 256
HIGH, LOW = (1 << 63) - 1, -(1 << 63)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding -> vec_id, v (array of double, whole numbers): floor(scale * x) of each component as double.

    Rows whose vec_id or vector is null, or that hold a null, NaN or infinite component, are left out. All others stay,
    whatever their size; what scale * x leaves of the range of a double counts as its largest number."""
    e = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    good = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= float(np.finfo(np.float64).max)), F.lit(False)))
    most = float(np.finfo(np.float64).max)
    # from 2^53 on a double is a whole number
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), y)))
    return e.filter(good).select("vec_id", F.transform("e", lambda x: whole(x * float(scale))).alias("v"))


def order_key(score: int) -> str:
    """Text that sorts like the number, of any length."""
    digits = str(abs(score))
    if score >= 0:
        return f"p{len(digits):04d}{digits}"
    return f"n{9999 - len(digits):04d}" + "".join(chr(ord("9") + ord("0") - ord(c)) for c in digits) + "~"


class Postings:
    """A block of rows by dimension: where it is not zero, and what it holds there. One dtype for the whole block."""

    def __init__(self, ids: np.ndarray, rows: list[np.ndarray]):
        self.ids, n = ids, np.array([len(r) for r in rows], np.int64)
        values = np.concatenate([np.empty(0), *rows])
        own, term = np.repeat(np.arange(len(rows)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
        use = values != 0
        values, own, term = values[use], own[use], term[use]
        order = np.argsort(term, kind="stable")
        self.values, self.own = values[order], own[order]
        self.at = np.searchsorted(term[order], np.arange(int(n.max(initial=0)) + 1))
        self.most, self.widest = float(np.abs(values).max(initial=0)), int(n.max(initial=0))
        self.whole = self.values.astype(np.int64) if self.most < 2.0**62 else None

    def scores(self, row: np.ndarray) -> np.ndarray:
        """The products of one query row with every row of the block, term by term."""
        terms = np.flatnonzero(row)
        terms = terms[terms < len(self.at) - 1]
        small = self.whole is not None and float(np.abs(row).max(initial=0)) * self.most * max(1, len(terms)) < 2.0**62
        out = np.zeros(len(self.ids), np.int64 if small else object)
        for t in terms.tolist():
            i, j = self.at[t], self.at[t + 1]
            if small and j - i == len(out):  # a posting of every row, in order
                out += int(row[t]) * self.whole[i:j]
            elif small:
                out[self.own[i:j]] += int(row[t]) * self.whole[i:j]
            else:
                weight = int(row[t])
                out[self.own[i:j]] += np.array([weight * int(x) for x in self.values[i:j]], object)
        return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; every tie at the threshold is weighed."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k] if scores.dtype != object else np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _accumulate(queries: pd.DataFrame, corpus: pd.DataFrame, k: int) -> pd.DataFrame:
    postings = Postings(corpus["vec_id"].to_numpy(np.int64), [np.asarray(v, float) for v in corpus["v"]])
    out: tuple[list, list, list, list] = ([], [], [], [])
    for name, v in zip(queries["vec_id"].tolist(), queries["v"]):
        scores = postings.scores(np.asarray(v, float))
        at = np.flatnonzero(postings.ids != name)
        best = at[_best(scores[at], postings.ids[at], k)]
        found = [int(x) for x in scores[best]]
        for column, values in zip(out, ([name] * len(best), postings.ids[best].tolist(), [max(LOW, min(HIGH, x)) for x in found], list(map(order_key, found)))):
            column += values
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "key"), out))).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "key": object})


def top_k(queries: DataFrame, corpus: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, corpus_block: int | None = None) -> DataFrame:
    """queries, corpus: vec_id long, v (array of whole numbers as double) -> query_id, rank, vec_id, score.

    A query's own row, known by its vec_id, is no candidate. Rows that repeat a vec_id are candidates each, and
    queries that repeat one share their k results. Shorter vectors count as padded with zeros. Ties go to the
    smaller vec_id. No queries or no candidates: no rows. Ranks follow the whole score; `score` itself is a long, so one
    beyond its range stands as the nearest long. One action counts both sides to fix the blocks."""
    counts = queries.select(F.lit(0).alias("side")).union(corpus.select(F.lit(1).alias("side"))).groupBy("side").count().collect()
    n = {r["side"]: r["count"] for r in counts}
    if corpus_block is None:
        corpus_block = min(CORPUS_BLOCK, max(LEAST_BLOCK, -(-n.get(1, 0) // partitions(corpus.sparkSession))))
    nq, nc = -(-n.get(0, 0) // query_block) or 1, -(-n.get(1, 0) // corpus_block) or 1
    q = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(nq)).cast("int").alias("qb"), "vec_id", "v")
    c = corpus.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(nc)).cast("int").alias("cb"), "vec_id", "v")
    pairs_q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    pairs_c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _accumulate(a, b, k)

    found = pairs_q.groupBy("qb", "cb").cogroup(pairs_c.groupBy("qb", "cb")).applyInPandas(meet, "query_id long, vec_id long, score long, key string")
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("key", (-F.col("vec_id")).alias("n"), "vec_id", "score")))), 1, k)
    return found.groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("r", "b")).select(
        "query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )


def op8_topk(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.filter(F.col("vec_id") % EVERY == 0), rows)


OP8_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
