"""Pairs of texts by the Jaccard similarity of their word shingles: MinHash candidates, exact comparison.

A text's set holds the 64-bit hashes of its distinct shingles. `BANDS` bands of `ROWS` least values name the buckets
in which sets meet; at similarity s a pair shares none with probability (1 - s^ROWS)^BANDS: 3.2e-6 at 0.8, 2.0e-8 at
0.85. Every candidate that could decide a class is compared on the whole sets, so no pair below the bound is linked.

Equal sets are collapsed first. The members of a bucket meet its most connected one: as many pairs as members. Sets
whose bucket is left with several classes go on to an exact join by their rarest shingles: with all shingles in one
order, rarest first, two sets at the bound share one among the first few of both (as many as may differ, and one), and it
does not stand so late that too few can follow. Copies that differ in words of their own have none in common there, so
members of a large group that lie just below the bound do not meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, components, release, settle, slices, stash, text_batches, unstash

BANDS, ROWS = 24, 4
SALTS = 64
_FACTORS = np.random.default_rng(8).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * U64(2) + U64(1)


def bands(h: np.ndarray) -> list[int]:
    """The bucket of a set of hashes in each band; no hashes: no buckets."""
    if not len(h):
        return []
    low = np.full(BANDS * ROWS, ~U64(0))
    for i in range(0, len(h), 4096):  # a very long text is taken in parts
        low = np.minimum(low, (h[None, i : i + 4096] * _FACTORS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(low.reshape(BANDS, ROWS))]


def shingle_sets(docs: DataFrame, hashes, words: int = 5) -> DataFrame:
    """doc_id, text -> doc_id, th (hash of the text), fp (hash of the set), n, shingles, bands; hashes(text, words)
    gives a text's shingle hashes in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                sets = [np.unique(np.concatenate([np.empty(0, np.uint64), *hashes(t, words)])) for t in b.column("text").to_pylist()]
                fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                at = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                flat = pa.array(np.concatenate(sets).view(np.int64))
                cols = [b.column("doc_id"), b.column("th"), pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(at, flat), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "fp", "n", "shingles", "bands"])
        release()

    text_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return d.mapInArrow(run, "doc_id long, th long, fp long, n long, shingles array<long>, bands array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) with their sizes -> (a, b) of those alike. A set that many pairs share is sent in SALTS parts of them."""
    p = pairs.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)).select("a", "b").distinct().withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    p = stash(p, "minhash-pairs")
    one = lambda c: sets.join(p.select(F.col(c).alias("fp")).distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias(f"{c}_set")).withColumnRenamed("fp", c)
    left = p.select("a", "s").distinct().join(one("a"), "a")
    j = p.join(one("b"), "b").join(left, ["a", "s"]).withColumn("i", F.size(F.array_intersect("a_set", "b_set")))
    out = stash(j.filter(F.col("i") * 100 >= (F.size("a_set") + F.size("b_set") - F.col("i")) * percent).select("a", "b"), "minhash-links")
    unstash(p)
    settle(sets.sparkSession)
    return out


def _rare_pairs(sets: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """fp, root -> (a, b, na, nb): every pair of different roots that can reach the similarity, by its rarest shingles."""
    own = sets.join(rest, "fp").groupBy("fp", "root").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    own = stash(own, "minhash-open")
    tokens = own.select("fp", F.explode("shingles").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1")
    # a shingle that no other set has keeps its place in the order and needs no row
    shared = tokens.join(often, "t").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("ts"))
    first = own.select("fp", "root", "n").join(shared, "fp").withColumn("alone", F.col("n") - F.size("ts"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1  # places in which one at least is shared
    first = first.withColumn("ts", F.slice("ts", 1, F.greatest(F.lit(0), most - F.col("alone")).cast("int")))
    rows = stash(first.select("fp", "root", "n", "alone", F.posexplode("ts").alias("i", "x")).select("fp", "root", "n", (F.col("alone") + F.col("i")).alias("at"), "x.t"), "minhash-rare")
    left, right = rows.toDF("a", "ra", "na", "ia", "t"), rows.toDF("b", "rb", "nb", "ib", "t")
    can = 1 + F.least(F.col("na") - F.col("ia") - 1, F.col("nb") - F.col("ib") - 1)  # shared ones, if this is the first
    fits = (can * (100 + percent) >= (F.col("na") + F.col("nb")) * percent) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.t") == F.col("r.t")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits)
    out = stash(pairs.select("a", "b", "na", "nb").distinct(), "minhash-rare-pairs")
    unstash(own)
    unstash(rows)
    return out


def similar_links(sets: DataFrame, percent: int = 80) -> DataFrame:
    """What shingle_sets() gives -> (a, b): pairs of fp at the similarity or more, enough to connect every class."""
    per = sets.groupBy("fp").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = per.select("fp", "n", F.explode("bands").alias("k"))
    shared = rows.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1")
    met = stash(rows.join(shared, "k"), "minhash-buckets")
    met_by = met.join(met.groupBy("fp").agg(F.sum("m").alias("ties")), "fp")
    first = met_by.groupBy("k").agg(F.max(F.struct("ties", "fp", "n")).alias("p"))
    star = met.join(first, "k").filter("p.fp <> fp").select(F.col("p.fp").alias("a"), F.col("fp").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"))
    links = _alike(star, sets, percent)
    roots = components(links, "minhash-classes")
    named = met.select("k", "fp", "m").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stash(named, "minhash-named")
    # buckets of more than one class; with two members, the star has compared them already
    apart = named.filter("m > 2").groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("k")
    rest = stash(named.join(apart, "k", "left_semi").select("fp", "root").distinct(), "minhash-rest")
    unstash(met)
    unstash(named)
    if rest.isEmpty():
        return links
    return links.union(_alike(_rare_pairs(sets, rest, percent), sets, percent))
