"""Fuzzy matches by the index against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sparrowgrid.operators import relational, textindex


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def names():
    r = random.Random(6)
    base = ["".join(r.choices("abcdeé ", k=r.randrange(1, 30))) for _ in range(40)]
    out = ["", "a", "ab", "anananananan", "nananananana", "x" * 40, "q" * 33 + "z"]
    for b in base:
        for _ in range(2):
            t = list(b)
            for _ in range(r.randrange(5)):
                i = r.randrange(len(t) + 1)
                t[i : i + r.randrange(2)] = r.choice(["", "x", "yz"])
            out.append("".join(t))
    return sorted(set(out))


def test_nearest_texts(spark, names):
    d = spark.createDataFrame([(n,) for n in names] + [(None,), (names[3],)], "a string")
    got = {}
    for r in textindex.nearest_texts(d, d.withColumnRenamed("a", "b"), "a", "b").collect():
        assert r["d"] == lev(r["a"], r["b"]) and r["a"] != r["b"]
        got.setdefault(r["a"], []).append((r["d"], r["b"]))
    for n in names:
        want = sorted((lev(n, m), m) for m in names if m != n)[:2]
        assert sorted(got[n])[:2] == want and len(got[n]) == len(set(got[n]))


@pytest.mark.parametrize("least", [0.4, 0.75, 1.0])
def test_similar_pairs_keep_rows(spark, names, least):
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(900, names[5]), (901, None)], "i int, a string")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(names[::2])] + [(902, None)], "j int, b string")
    got = sorted((r["i"], r["j"], round(r["score"], 9)) for r in relational.similar_pairs(left, right, "a", "b", least).collect())
    score = lambda a, b: 1 - lev(a, b) / max(len(a), len(b)) if a or b else 1.0
    want = sorted((i, j, round(score(a, b), 9)) for i, a in [*enumerate(names), (900, names[5])] for j, b in enumerate(names[::2]) if score(a, b) >= least)
    assert got == want


def test_no_texts(spark):
    none = spark.createDataFrame([], "a string")
    some = spark.createDataFrame([("x",)], "b string")
    assert textindex.nearest_texts(none, some, "a", "b").count() == 0 and textindex.nearest_texts(some, none.withColumnRenamed("a", "c"), "b", "c").count() == 0


def test_candidates_of_many_names_are_few(spark):
    """Names that differ from all but a few others: candidates in proportion to the names."""
    word = F.sha2(F.col("id").cast("string"), 256)
    d = spark.range(3000).select(F.substring(word, 1, 24).alias("a"))
    d = d.union(d.limit(300).select(F.concat(F.lit("x"), F.substring("a", 2, 23)).alias("a")))
    pairs = textindex.close_pairs(d, d.withColumnRenamed("a", "b"), "a", "b", lambda n: F.lit(1))
    assert pairs.count() < 200 * 3300
