"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into content-defined paragraphs (line ends, and word ends chosen by a rolling hash, some five words
apart), each hashed to 64 bits. A sketch adds every distinct digest to one cell in each of three sub-tables: a
count, the xor of the digests and the xor of a check hash. Subtracting two sketches cell by cell leaves only the
digests in which the versions differ; peeling cells that hold a single digest recovers them. The likeness of two
versions is twice the shared digests over the digests of both, exact once peeling has succeeded.

A published fingerprint has room for a version that differs in a good quarter of its text. Sub-tables have 6 * 2^k cells
and a digest's cell is its hash modulo that, so a larger sketch folds to the size of a smaller one and any two can be
subtracted. compare() does so and gives the differing digests, or tells that the versions are too far apart; then the
pair is sketched again from the texts with four times the cells until it peels.

All texts of a batch are sketched and peeled together in array operations.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, partitions, slices

CELLS = 18  # of the smallest sketch, in three sub-tables
ROOM = 0.75  # cells of a published fingerprint for each digest, at least
CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])
BASE = 0x9E3779B97F4A7C15 | 1
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse powers modulo 2^64 for i up to n."""
    for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
        if len(POWERS[name]) <= n:
            steps = np.full(max(n + 1, 1 << 16), b, U64)
            steps[0] = 1
            POWERS[name] = np.cumprod(steps, dtype=U64)
    return POWERS["up"], POWERS["down"]


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of every distinct paragraph of each text, sorted."""
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, U64)
    up, down = _powers(len(data) + 1)
    blank = BLANK[data]
    ends = np.flatnonzero(blank)
    h, begin = np.zeros(len(ends), U64), at[np.searchsorted(at, ends, side="right") - 1]
    for i in range(1, 5):  # of the word that ends here, within its text
        h = h * U64(0x100000001B3) + np.where(ends - i >= begin, data[np.maximum(ends - i, 0)], 0).astype(U64)
    chosen = (mix64(h) % U64(5) == 0) | (data[ends] == 0x0A)
    cut = np.unique(np.concatenate([at, ends[chosen] + 1]))
    own = np.searchsorted(at, cut[:-1], side="right") - 1
    total = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], dtype=U64)])
    digest = mix64((total[cut[1:]] - total[cut[:-1]]) * down[cut[:-1]] + (cut[1:] - cut[:-1]).astype(U64) * U64(0xD6E8FEB86659FD93))
    order = np.lexsort((digest, own))
    own, digest = own[order], digest[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (digest[1:] != digest[:-1])
    return own[new], digest[new]


def check(digest: np.ndarray) -> np.ndarray:
    return mix64(digest ^ U64(0xA0761D6478BD642F)) >> U64(32)


def places(digest: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
    """The cell in each sub-table, counted from the start of a sketch of so many cells."""
    third = (cells // 3).astype(U64)
    return [(mix64(digest + U64(i * 0x632BE59BD9B4E019 & (2**64 - 1))) % third + U64(i) * third).astype(np.int64) for i in range(3)]


class Sketches:
    """A row of sketches, `cells` of each (a multiple of three)."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.start = cells, np.concatenate([[0], np.cumsum(cells)])
        n = int(self.start[-1])
        self.count, self.digest, self.check = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)

    def add(self, own: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> None:
        c = check(digest)
        for p in places(digest, self.cells[own]):
            np.add.at(self.count, self.start[own] + p, sign)
            np.bitwise_xor.at(self.digest, self.start[own] + p, digest)
            np.bitwise_xor.at(self.check, self.start[own] + p, c)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sketch number, digest and sign of what is recovered, and for each sketch whether it is empty now."""
        found: list[tuple[np.ndarray, ...]] = []
        look = np.arange(len(self.count))
        while True:
            pure = look[np.abs(self.count[look]) == 1]
            pure = pure[check(self.digest[pure]) == self.check[pure]]
            if not len(pure):
                break
            own = np.searchsorted(self.start, pure, side="right") - 1
            _, first = np.unique(np.stack([own.astype(U64), self.digest[pure]]), axis=1, return_index=True)
            own, digest, sign = own[first], self.digest[pure[first]], self.count[pure[first]]
            found.append((own, digest, sign))
            if len(found) > len(self.count):  # each round empties a cell; a false check could go on for ever
                break
            self.add(own, digest, -sign)
            look = np.unique(np.concatenate([self.start[own] + p for p in places(digest, self.cells[own])]))
        left = np.concatenate([[0], np.cumsum((self.count != 0) | (self.digest != 0))])
        own, digest, sign = (np.concatenate([np.empty(0, t), *(f[i] for f in found)]) for i, t in enumerate((np.int64, U64, np.int64)))
        return own, digest, sign, left[self.start[1:]] == left[self.start[:-1]]


def cells_for(n: np.ndarray) -> np.ndarray:
    """Cells of the published sketch of n digests: CELLS times a power of two."""
    need = np.maximum(1.0, (ROOM * n + 12) / CELLS)
    return (CELLS * 2 ** np.ceil(np.log2(need)).astype(np.int64)).astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Twice the shared digests over those of both, for each pair of texts (0 to n - 1), by subtracting and peeling: first
    with the cells of the smaller published sketch (folding the other gives the same cells), then larger."""
    na, nb = np.bincount(a[0], minlength=n), np.bincount(b[0], minlength=n)
    out, todo, cells = np.ones(n), np.arange(n), np.minimum(cells_for(na), cells_for(nb))
    while len(todo):
        at = np.full(n, -1)
        at[todo] = np.arange(len(todo))
        s = Sketches(cells[todo])
        for (own, digest), sign in ((a, 1), (b, -1)):
            mine = at[own] >= 0
            s.add(at[own[mine]], digest[mine], sign)
        own, _, _, empty = s.peel()
        got = np.bincount(own, minlength=len(todo))
        good = todo[empty]
        differ, all_of = got[empty], na[good] + nb[good]
        out[good] = np.where(all_of > 0, (all_of - differ) / np.maximum(1, all_of), 1.0)
        todo = todo[~empty]
        cells[todo] *= 4
    return out


def published(own: np.ndarray, digest: np.ndarray, n: int) -> list[str]:
    """The sketch of each text as a string in base 64: the number of its digests, then its cells."""
    total = np.bincount(own, minlength=n)
    s = Sketches(cells_for(total))
    s.add(own, digest, 1)
    raw = np.zeros(len(s.count), CELL)
    raw["count"], raw["digest"], raw["check"] = s.count, s.digest, s.check
    return [base64.b64encode(int(t).to_bytes(4, "little") + raw[i:j].tobytes()).decode() for t, i, j in zip(total, s.start, s.start[1:])]


def compare(a: str, b: str) -> dict | None:
    """What two published fingerprints tell: the digests that only one has, and their likeness. None if they differ in
    more than the smaller one can hold; then the texts have to be sketched again, with more cells."""
    sides = []
    for fp in (a, b):
        raw = base64.b64decode(fp)
        sides.append((int.from_bytes(raw[:4], "little"), np.frombuffer(raw[4:], CELL)))
    size = min(len(cells) for _, cells in sides)
    s = Sketches(np.array([size]))
    for (_, cells), sign in zip(sides, (1, -1)):
        parts = cells.reshape(3, -1, size // 3)  # each sub-table in stretches that fold onto one another
        s.count += sign * parts["count"].astype(np.int64).sum(axis=1).ravel()
        s.digest ^= np.bitwise_xor.reduce(parts["digest"], axis=1).ravel()
        s.check ^= np.bitwise_xor.reduce(parts["check"].astype(U64), axis=1).ravel()
    _, digest, sign, empty = s.peel()
    if not empty[0]:
        return None
    both = sides[0][0] + sides[1][0]
    return {"only_a": sorted(digest[sign > 0].tolist()), "only_b": sorted(digest[sign < 0].tolist()), "likeness": (both - len(digest)) / both if both else 1.0}


def fingerprint(texts: list[str]) -> list[str]:
    return published(*paragraphs([t.encode() for t in texts]), len(texts))


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compare(texts: list[str], following: list[str]) -> dict[str, pa.Array]:
    edited = [edit(t, f) for t, f in zip(texts, following)]
    raw = [t.encode() for t in edited]
    n = len(texts)
    a, b, c = paragraphs([t.encode() for t in texts]), paragraphs(raw), paragraphs([t.encode() for t in following])
    return {
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
        "fingerprint": pa.array(published(*a, n)),
        "edited_fingerprint": pa.array(published(*b, n)),
        "near_edited": pa.array(likeness(a, b, n)),
        "near_next": pa.array(likeness(a, c, n)),
    }


def _below(marks: list[int], x: Column) -> Column:
    """How many of the sorted marks are at most x: first among every g-th of them, then within the g that follow."""
    g = max(1, round(len(marks) ** 0.5))
    long = lambda part: F.array(*[F.lit(m).cast("long") for m in part])
    coarse = F.size(F.filter(long(marks[::g]), lambda m: m <= x))
    groups = F.array(*[long(marks[i : i + g]) for i in range(0, len(marks), g)])
    fine = F.size(F.filter(F.get(groups, coarse - 1), lambda m: m <= x))
    return F.when(x.isNotNull(), F.when(coarse > 0, (coarse - 1) * g + fine).otherwise(0))


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The following document is the next by doc_id (null first, rows of one doc_id by the hash of their text), and the first after the
    last; a single document follows itself. Null text counts as empty; two empty texts are alike (1). Repeated rows
    follow each other like any rows. An empty table gives none. Other columns are not read.

    Documents are dealt by ranges of doc_id, a partition each, with a copy of the next range's first document; a range
    is then read in order with one row of look-ahead. Texts are shuffled once."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    marks = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    marks = sorted(set(marks))  # at most one number for each partition
    d = d.withColumn("part", F.coalesce(_below(marks, F.col("doc_id")), F.lit(0)) if marks else F.lit(0))
    # The first row of each range, known by its doc_id and the hash of its text, so that only few texts are looked up.
    d = d.withColumn("h", F.sha2("text", 256))
    firsts = d.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("f")).collect()  # one small row for each range
    firsts.sort(key=lambda r: r["part"])
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {firsts[(i + 1) % len(firsts)]["f"]: r["part"] for i, r in enumerate(firsts)}
    ahead = spark.createDataFrame([(f["doc_id"], f["h"], p) for f, p in before.items()], "doc_id long, h string, to int")
    e = d.alias("d").join(F.broadcast(ahead.alias("x")), F.expr("d.doc_id <=> x.doc_id AND d.h = x.h"))
    e = e.select("d.doc_id", "d.text", F.col("to").alias("part"), "d.h", F.lit(1).alias("ahead")).dropDuplicates(["part"])
    rows = d.select("doc_id", "text", "part", "h", F.lit(0).alias("ahead")).unionByName(e)
    rows = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", "h").drop("h")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                got = list(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("ahead").to_pylist()))
                if last is not None:
                    got.insert(0, last)
                pairs = [(x, y[1]) for x, y in zip(got, got[1:]) if not x[2]]
                last = got[-1]
                if pairs:
                    made = _compare([x[1] for x, _ in pairs], [f for _, f in pairs])
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x, _ in pairs], pa.int64()), *made.values()], names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return versions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
