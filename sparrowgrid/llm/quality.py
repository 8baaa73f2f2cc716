"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A labelled document has grade 0 (poor), 1 (sound but toxic) or 2 (good). The model has one weight for each hashed
text feature, shared by all grades, and ordered thresholds: P(grade > k) = sigmoid(w x - t_k). It gives a document
its expected grade and its tail probabilities; a document stays if P(grade = 2) reaches `LEAST`.

Features of a whole text: the hashed words that occur in it, and ratios of its characters and words (symbols,
capitals, repetition and so on) in ranges. Words enter if their presence marks a lower grade in the labelled sample.
The fit reads at most `SAMPLE` labelled documents, the ones with the least hash of their doc_id; scoring reads all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, flat, mix64, release, slices, text_batches
from .fingerprint import _powers

SAMPLE = 8000
LEAST = 0.7  # probability of the top grade from which a document stays
BINS = 1 << 18
SLICE = 500_000  # bytes of text that a worker takes at once
RANGES = {
    "symbols": (0.001, 0.005, 0.02, 0.05, 0.1, 0.2),
    "bars": (0.001, 0.005, 0.02, 0.05, 0.1, 0.2),
    "capitals": (0.01, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits": (0.001, 0.01, 0.05, 0.1, 0.2, 0.4),
    "repeats": (0.005, 0.02, 0.05, 0.1, 0.2, 0.5),
    "cries": (0.001, 0.005, 0.01, 0.02, 0.05, 0.1),
    "word length": (2.0, 3.0, 4.0, 6.0, 8.0, 12.0),
}
WIDTH = 8  # places kept for the ranges of one ratio
STRENGTH = 6.0  # least z score of a word's presence in a lower grade
FEWEST = 5  # documents that a word must occur in
KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 symbol, 4 bar, 5 exclamation mark
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
KIND[[ord(c) for c in "#$%&*+<=>@\\^_`{}~[]"]] = 3
KIND[ord("|")] = 4
KIND[ord("!")] = 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each distinct feature, from the joined bytes of texts that begin at `at`."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    kind = KIND[data]
    count = lambda mask: np.bincount(doc[mask], minlength=n).astype(float)
    size, letters = np.maximum(1, np.diff(at)), np.maximum(1, count(kind == 1))
    letter = kind == 1
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | (doc[1:] != doc[:-1])
    end = letter.copy()
    end[:-1] &= ~letter[1:] | (doc[1:] != doc[:-1])
    a, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum((LOWER[data].astype(U64) + U64(1)) * up[: len(data)], dtype=U64)])
    word = mix64((total[e] - total[a]) * down[a] + (e - a).astype(U64))
    own = doc[a]
    words = np.maximum(1, np.bincount(own, minlength=n))
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    ratios = {
        "symbols": count(kind == 3) / size,
        "bars": count(kind == 4) / size,
        "capitals": count((data >= 65) & (data < 91)) / letters,
        "digits": count(kind == 2) / size,
        "repeats": np.bincount(own[again], minlength=n) / words,
        "cries": count(kind == 5) / size,
        "word length": np.bincount(own, weights=e - a, minlength=n) / words,
    }
    pairs = np.unique((own.astype(U64) << U64(32)) | (word % U64(BINS)))
    docs, found = [(pairs >> U64(32)).astype(np.int64)], [(pairs & U64(0xFFFFFFFF)).astype(np.int64)]
    for i, (name, edges) in enumerate(RANGES.items()):
        docs.append(np.arange(n))
        found.append(BINS + i * WIDTH + np.searchsorted(edges, ratios[name], side="right"))
    return np.concatenate(docs), np.concatenate(found)


class Model:
    """Weights of the chosen features and the two thresholds."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, thresholds: tuple[float, float]):
        self.chosen, self.weights, self.thresholds = chosen, weights, thresholds

    def scorer(self):
        """A function of the joined bytes of texts and their offsets: P(grade >= 1) and P(grade >= 2) of each text."""
        table = np.zeros(BINS + len(RANGES) * WIDTH)
        table[self.chosen] = self.weights

        def tails(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            doc, f = features(data, at)
            score = np.bincount(doc, weights=table[f], minlength=len(at) - 1)
            return tuple(1 / (1 + np.exp(-np.clip(score - t, -500, 500))) for t in self.thresholds)

        return tails


def _chosen(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """The ratio ranges that occur, and the words whose presence marks one of the lower grades (words that good texts
    share would only tell how long a text is)."""
    size, n = BINS + len(RANGES) * WIDTH, len(grade)
    seen = np.bincount(feature, minlength=size)
    best = np.zeros(size)
    for g in (0, 1):
        inside = grade == g
        n1, n0 = inside.sum(), n - inside.sum()
        if n1 and n0:
            in1 = np.bincount(feature[inside[doc]], minlength=size)
            p = seen / n
            spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
            best = np.maximum(best, (in1 / n1 - (seen - in1) / n0) / spread)
    words = np.flatnonzero((best[:BINS] >= STRENGTH) & (seen[:BINS] >= FEWEST))
    return np.concatenate([words, BINS + np.flatnonzero(seen[BINS:] > 0)])


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, penalty: float = 1e-5, rounds: int = 2000) -> Model:
    """Maximum likelihood with a ridge penalty, by Adam on the whole sample. With one grade only: all are good."""
    if len(np.unique(grade)) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), (-500.0, -500.0))
    chosen = _chosen(doc, feature, grade)
    column = np.full(BINS + len(RANGES) * WIDTH, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(grade), len(chosen)), np.float32)
    use = column[feature] >= 0
    x[doc[use], column[feature[use]]] = 1
    theta = np.zeros(len(chosen) + 2)  # weights, the lower threshold, the log of the gap to the upper one
    theta[-2] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        t0, gap = theta[-2], np.exp(np.clip(theta[-1], -20, 20))
        s = x @ theta[:-2].astype(np.float32)
        p1, p2 = (1 / (1 + np.exp(-np.clip(s - t, -30, 30))) for t in (t0, t0 + gap))
        q = np.maximum(np.choose(grade, [1 - p1, p1 - p2, p2]), 1e-9)
        d1, d2 = p1 * (1 - p1), p2 * (1 - p2)
        ds = np.choose(grade, [-d1, d1 - d2, d2]) / q  # of the log likelihood by the score
        dt1, dt2 = np.choose(grade, [d1, -d1, 0 * d1]) / q, np.choose(grade, [0 * d2, d2, -d2]) / q
        g = -np.concatenate([x.T @ ds.astype(np.float32), [dt1.sum() + dt2.sum(), dt2.sum() * gap]]) / len(grade)
        g[:-2] += penalty * theta[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Model(chosen, theta[:-2], (theta[-2], theta[-2] + np.exp(np.clip(theta[-1], -20, 20))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, quality, toxic. Labels with a null are left out; of several labels for a
    document the lowest grade holds; of rows that share a doc_id the one whose text has the least hash is the case (a null
    text before all others), so that at most `sample` documents are fitted, however often an id repeats."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    g = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    g = g.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(sample)
    cases = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(g), "doc_id")
    least = F.min_by(F.struct("text", "grade"), F.struct(F.when(F.col("text").isNotNull(), F.xxhash64("text")), F.md5("text")))
    cases = cases.groupBy("doc_id").agg(least.alias("c")).select("doc_id", "c.text", "c.grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                data, at = flat(b.column("text"))
                doc, f = features(data, at)
                order = np.argsort(doc, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(f[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), lists], ["doc_id", "grade", "f"])

    rows = cases.mapInArrow(run, "doc_id long, grade int, f array<int>").toArrow().sort_by("doc_id")
    lists = rows.column("f").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    feature = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.empty(0, np.int64)
    return fit(np.repeat(np.arange(len(n)), n), feature, rows.column("grade").to_numpy().astype(np.int64))


def rated(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with further columns __p1, __p2: P(grade >= 1) and P(grade >= 2). Null text is rated like an empty one.

    Only the text goes to the Python workers and only two numbers come back; the other columns stay where they are."""

    @F.arrow_udf("struct<p1: double, p2: double>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weigh = model.scorer()
        for whole in texts:
            parts = [weigh(*flat(b.column("text"))) for b in slices(pa.RecordBatch.from_arrays([whole], ["text"]), "text", SLICE)]
            p1, p2 = (np.concatenate([np.empty(0), *(p[i] for p in parts)]) for i in (0, 1))
            yield pa.StructArray.from_arrays([pa.array(p1), pa.array(p2)], ["p1", "p2"])
        release()

    text_batches(docs.sparkSession)
    return docs.withColumn("__p", score(F.col(text))).select(*[docs[c] for c in docs.columns], F.col("__p.p1").alias("__p1"), F.col("__p.p2").alias("__p2"))


def grade(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and labels -> doc_id, expected_grade, p_sound, p_good, keep; a row for each row of docs.

    Null and empty texts get the rating of a text without words. Repeated rows are rated alike; an empty table of
    documents gives no rows; without labels of two grades every document is good. Other columns are not read."""
    r = rated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, sample))
    return r.select("doc_id", (F.col("__p1") + F.col("__p2")).alias("expected_grade"), F.col("__p1").alias("p_sound"), F.col("__p2").alias("p_good"), (F.col("__p2") >= LEAST).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier keeps, columns unchanged."""
    return rated(docs, train(docs, labels, sample)).filter(F.col("__p2") >= LEAST).drop("__p1", "__p2")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return grade(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
