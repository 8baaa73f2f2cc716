"""The test that pairs of lines pass before their edit distance is worked out."""

import random

from pyspark.sql import functions as F

from sparrowgrid.llm import lines


def test_pairs_that_may_be_two_edits_apart(spark):
    rng, rows = random.Random(9), [("", ""), ("", "ab"), ("", "abc"), ("a", "bcd"), ("ab", "ba"), ("aaaa", "aa"), ("né𝄞x", "n𝄞")]
    for k in range(600):
        a = [rng.choice("abé𝄞") for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = [rng.choice("abé𝄞")] * rng.randint(0, 1)
        rows.append(("".join(a), "".join(b)))
    d = spark.createDataFrame(rows, "a string, b string")
    d = d.select("a", "b", lines.may_be_two_apart(F.col("a"), F.col("b")).alias("may"), (F.levenshtein("a", "b") <= 2).alias("are"))
    got = d.collect()
    assert [r for r in got if r["may"] != r["are"]] == [] and 100 < sum(r["are"] for r in got) < 600


def test_copies_of_a_line_do_not_meet_in_pairs(spark):
    """Near copies of one long line: every line within two edits of an earlier one is found, and few pairs are made."""
    rng = random.Random(4)
    base = [rng.choice(["the", "onsti", "erth", "whing", "tion", "nd"]) for _ in range(70)]
    texts = []
    for _ in range(600):
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = "".join(rng.choices("abcdefgh", k=7))
        texts.append(" ".join(w))
    for k in range(60):
        t = list(texts[rng.randrange(600)])
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "x"])
        texts.append("".join(t))
    rows = list(enumerate(dict.fromkeys(texts)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    far = d.select(F.col("doc_id").alias("a"), F.col("text").alias("x")).join(d, (F.col("a") < F.col("doc_id")) & (F.levenshtein("x", "text") <= 2))
    want = {r["doc_id"] for r in far.select("doc_id").distinct().collect()}
    met, stashed = [], lines.stash

    def counted(df, name):
        out = stashed(df, name)
        if name == "line-pairs":
            met.append(out.count())
        return out

    lines.stash, may = counted, lines.may_be_two_apart
    lines.may_be_two_apart = lambda a, b: F.lit(True)  # pairs as they are made, before the exact test of their ends
    try:
        got = {r["doc_id"] for r in lines.dedup_lines(d).collect() if r["n_near"]}
    finally:
        lines.stash, lines.may_be_two_apart = stashed, may
    assert got == want and len(want) > 30
    assert sum(met) < 4 * len(rows)
