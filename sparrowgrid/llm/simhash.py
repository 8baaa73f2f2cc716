"""SimHash near-dedup with covering locality-sensitive hashing.

A document's fingerprint holds, bit by bit, the majority of the 64-bit hashes of its word shingles. Candidate
pairs come from a covering family of bit masks: bit i carries the nonzero vector m(i) of GF(2)^(r+1), and the
mask of each nonzero v keeps the bits with <m(i), v> = 1. The differing bits of a pair within radius r span at
most r dimensions, so some v is orthogonal to all of them: the pair agrees under that mask, without exception.

Equal fingerprints are collapsed first. A bucket with more than `SMALL` fingerprints is covered once more on the
bits its mask left out, which bounds a group by the free bits that remain (2^13 for radius 2) whatever the data;
inside a group each fingerprint that lies within the radius of another is tied to it by a spanning forest, so
that links grow with the rows and not with the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import components, partitions, slices, stash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEED = 42
SMALL = 1024


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The 64-bit hashes of a text's word shingles; a very long text's in parts."""
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return
    if len(w) < words:
        shingles = [" ".join(w)]
    else:
        shingles = list(map(" ".join, zip(*[w[i:] for i in range(words)])))
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(shingles), 65536):
        yield np.array([digest(s.encode(), SEED) for s in shingles[i : i + 65536]], np.uint64)


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint as an unsigned 64-bit number; no words: 0."""
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text -> doc_id, th (hash of the text), fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 8_000_000):
                fp = np.array([simhash(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp)], ["doc_id", "th", "fp"])

    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return d.mapInArrow(run, "doc_id long, th long, fp long")


def masks(radius: int, bits: list[int]) -> list[int]:
    """The 2^(radius+1) - 1 covering masks over the given bit positions, as unsigned numbers."""
    m = {b: i % (2 ** (radius + 1) - 1) + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (m[b] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Positions (a, b) of a spanning forest of the pairs within the radius; distances in blocks of rows."""
    n = len(fp)
    root = np.arange(n)
    a, b = [], []
    for i in range(n - 1):  # row i against all later ones, still apart from it
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1
        for j in near[root[near] != root[i]]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                a.append(i)
                b.append(int(j))
    return a, b


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty((0, 2), np.int64), np.empty(0, np.int64)

        def groups(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(f)]
            left, right = [], []
            for i, j in zip(at, at[1:]):
                g = np.unique(f[i:j])
                if len(g) > 1:
                    a, b = _forest(g.view(np.uint64), radius)
                    left.append(g[a])
                    right.append(g[b])
            empty = np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *left])), pa.array(np.concatenate([empty, *right]))], ["a", "b"])

        for batch in batches:
            k = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "k")]).astype(np.int64)
            f = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            held_k, held_f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            if len(held_f):
                cut = int(np.flatnonzero((held_k == held_k[-1]).all(axis=1))[0])  # the last group may go on
                if cut:
                    yield groups(held_k[:cut], held_f[:cut])
                    held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_f):
            yield groups(held_k, held_f)

    return run


def near_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """fp (distinct) -> (a, b): enough pairs within the radius to connect every class of linked fingerprints."""
    first = masks(radius, list(range(64)))
    tables = [F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for i, m in enumerate(first)]
    keyed = distinct.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.t", "x.k")
    size = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(size, ["t", "k"])
    again = []
    for i, m in enumerate(first):
        rest = masks(radius, [b for b in range(64) if not m >> b & 1])
        again.append(F.array(*[F.struct(F.lit((i + 1) * 1000 + j).cast("long").alias("t"), F.xxhash64("k", F.col("fp").bitwiseAND(F.lit(_signed(r)).cast("long"))).alias("k")) for j, r in enumerate(rest)]))
    small = shared.filter(F.col("n") <= SMALL).select("t", "k", "fp")
    large = shared.filter(F.col("n") > SMALL).select("fp", "k", F.element_at(F.array(*again), (F.col("t") + 1).cast("int")).alias("x"))
    large = large.select("k", "fp", F.explode("x").alias("x")).select("x.t", "x.k", "fp")
    rows = small.union(large).repartition(partitions(distinct.sparkSession), "t", "k").sortWithinPartitions("t", "k")
    return rows.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, text -> doc_id, th (hash of the text), fp, component_id, stays; a row for each row of docs.

    component_id is the smallest doc_id among the documents that links reach, the document itself included; rows
    with a null doc_id take part and do not name a component (null if it has no other). `stays` marks the rows with
    the smallest doc_id (null last), then the smallest text hash, of a component. Null, empty and blank texts have
    fingerprint 0 and are linked with one another. Repeated rows are linked like others. An empty table gives an
    empty result. Other columns are not read."""
    return _classes(stash(fingerprints(docs, words), "simhash"), lambda distinct: near_links(distinct, radius))


def _classes(fps: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    per = stash(fps.groupBy("fp").agg(F.min(me).alias("low")), "simhash-distinct")
    roots = components(links(per.select("fp")), "simhash-links")
    named = per.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = named.groupBy("root").agg(F.min("low").alias("first"))
    classes = named.join(lows, "root").select("fp", "first")
    return fps.join(classes, "fp").select("doc_id", "th", "fp", F.col("first.doc_id").alias("component_id"), (me == F.col("first")).alias("stays"))


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, radius: int = 2) -> DataFrame:
    """As near_duplicates(), with its links (SimHash fingerprints within the radius, by covering masks) and those between
    texts whose sets of shingles have a Jaccard similarity of `percent` hundredths or more; fp is a hash of the set. Texts
    without words are linked with one another."""
    sets = stash(minhash.shingle_sets(docs, shingle_hashes, words), "shingle-sets")
    prints = fingerprints(docs).select("th", F.col("fp").alias("print")).dropDuplicates(["th"])
    both = stash(sets.select("th", "fp").distinct().join(prints, "th").select("fp", "print").distinct(), "simhash")

    def links(distinct: DataFrame) -> DataFrame:
        # the least set of a fingerprint stands for it
        low = stash(both.groupBy("print").agg(F.min("fp").alias("low")), "simhash-lows")
        equal = both.join(low, "print").select(F.col("low").alias("a"), F.col("fp").alias("b")).filter("a <> b")
        near = near_links(low.select(F.col("print").alias("fp")), radius)
        near = near.join(low.toDF("a", "low_a"), "a").join(low.toDF("b", "low_b"), "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
        return minhash.similar_links(sets, percent).union(equal).union(near)

    return _classes(sets.select("doc_id", "th", "fp"), links)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs less the near duplicates that similar_documents() links: of each component the row that `stays` is kept,
    columns unchanged. Rows that agree in doc_id and text are one document and leave one row."""
    c = stash(similar_documents(docs, words, percent), "simhash-classes")
    gone = c.filter("NOT stays").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th")), "left_anti")
    again = c.filter("stays").groupBy("doc_id", "th").count().filter("count > 1")
    return left if again.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    c = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 2)
    return c.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
