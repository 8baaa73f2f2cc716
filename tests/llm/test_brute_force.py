"""Queries without SQL, and the pipeline, against plain versions on whole small tables."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sparrowgrid.llm import bpe, lines, quality, sharding, simhash
from sparrowgrid.llm.fingerprint import BASE

M = (1 << 64) - 1


def _mix64(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def _tails(model, text):
    """P(grade >= 1), P(grade >= 2), with loops over bytes and words."""
    b = (text or "").encode()
    letter = lambda c: 65 <= c < 91 or 97 <= c < 123 or c >= 128
    words, now = [], b""
    for c in b:
        if letter(c):
            now += bytes([c + 32 if 65 <= c < 91 else c])
        elif now:
            words.append(now)
            now = b""
    words += [now] if now else []
    code = lambda w: _mix64((sum((c + 1) * pow(BASE, i, 1 << 64) for i, c in enumerate(w)) + len(w)) & M) % quality.BINS
    size, letters, n = max(1, len(b)), max(1, sum(map(letter, b))), max(1, len(words))
    share = lambda chars: sum(c in chars for c in b)
    ratios = {
        "symbols": share(b"#$%&*+<=>@\\^_`{}~[]") / size, "bars": share(b"|") / size, "capitals": sum(65 <= c < 91 for c in b) / letters, "digits": share(b"0123456789") / size,
        "repeats": sum(x == y for x, y in zip(words, words[1:])) / n, "cries": share(b"!") / size, "word length": sum(map(len, words)) / n,
    }
    found = {code(w) for w in words}
    for i, (name, edges) in enumerate(quality.RANGES.items()):
        found.add(quality.BINS + i * quality.WIDTH + sum(ratios[name] >= e for e in edges))
    weight = dict(zip(model.chosen.tolist(), model.weights.tolist()))
    score = sum(weight.get(f, 0.0) for f in found)
    return tuple(1 / (1 + math.exp(-max(-500, min(500, score - t)))) for t in model.thresholds)


def test_quality_query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.op5_quality(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        p1, p2 = _tails(model, r["text"])
        g = got[r["doc_id"]]
        assert (g["p_sound"], g["p_good"], g["expected_grade"]) == pytest.approx((p1, p2, p1 + p2), abs=1e-9) and g["keep"] == (g["p_good"] >= quality.LEAST)


def test_quality_fit_is_the_likeliest():
    """No small change of a weight or a threshold raises the penalised likelihood of ordered grades."""
    rng = np.random.default_rng(3)
    n, f = 600, quality.BINS + np.arange(12)
    x = rng.random((n, 12)) < 0.4
    s = x @ rng.normal(0, 1.5, 12) + rng.logistic(size=n)
    grade = np.digitize(s, [-1.0, 1.0])
    doc, col = np.nonzero(x)
    m = quality.fit(doc, f[col], grade)
    chosen = {c: i for i, c in enumerate(m.chosen.tolist())}

    def loss(w, t0, t1):
        z = np.array([sum(w[chosen[f[j]]] for j in np.flatnonzero(row)) for row in x])
        p1, p2 = 1 / (1 + np.exp(-(z - t0))), 1 / (1 + np.exp(-(z - t1)))
        return -np.log(np.choose(grade, [1 - p1, p1 - p2, p2])).mean() + 0.5e-5 * (w**2).sum()

    t0, t1 = m.thresholds
    best = loss(m.weights, t0, t1)
    assert t0 < t1
    for i in range(len(m.weights)):
        for step in (-0.05, 0.05):
            w = m.weights.copy()
            w[i] += step
            assert loss(w, t0, t1) >= best - 1e-6
    assert all(loss(m.weights, t0 + a, t1 + b) >= best - 1e-6 for a, b in ((-0.05, 0), (0.05, 0), (0, -0.05), (0, 0.05)))


def test_bpe_query(spark, sf_dir):
    e = bpe.Encoder(bpe.vocabulary())
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = e.plain(r["text"] or "")
        decoded = e.tokenizer.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.op6_bpe(spark, sf_dir).collect())) == sorted(want)


def _shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)


def _classes(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(items):
        for j in items[:n]:
            if linked(i, j) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in items}


def test_simhash_query(spark, sf_dir):
    fp = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in _shingles(r["text"], 3)]
        fp[r["doc_id"]] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = _classes(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    assert sorted(map(tuple, simhash.op7_simhash(spark, sf_dir).collect())) == sorted((i, f"{f:016x}", root[i]) for i, f in fp.items())


def test_shard_query(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in sharding.op10_shards(spark, sf_dir).collect()}
    n = Counter(r["shard"] for r in got.values())
    assert set(got) == set(rows) and set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    assert {(r["shard"], r["slot"]) for r in got.values()} == {(s, k) for s in n for k in range(n[s])}
    # groups that fit a shard: cut links against the best, which is none, and against chance
    groups = {}
    for i, t in rows.items():
        groups.setdefault(t, []).append(got[i]["shard"])
    small = [g for g in groups.values() if 1 < len(g) <= max(n.values())]
    cut = sum(len(set(g)) > 1 for g in small)
    assert not small or cut <= 0.5 * len(small)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randrange(2, 9))) for _ in range(n))
    text = lambda: "\n".join(say(rng.randrange(4, 30)) for _ in range(rng.randrange(1, 5)))
    base = [text() for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(0, 8)]  # whole copies: every line of them repeats
    rows += [(200 + i, say(60)) for i in range(4)] + [(300 + i, rows[-4 + i][1] + " tail end") for i in range(4)]  # near copies
    rows += [(400 + i, base[i].split("\n")[0] + "\n" + say(12) + "\nAll rights reserved.") for i in range(8)]  # shared lines
    rows += [(500 + i, "buy buy buy !!! $$$ @@@ " * 6 + str(i)) for i in range(14)]  # poor ones
    rows += [(600, None), (601, ""), (602, " \n "), (None, say(40)), (603, say(9000))]
    docs = [(i, t, "en", None if i is None else f"s{i % 4}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(500 + i, 0, 0) for i in range(14)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"

    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [d for d in docs if _tails(model, d[1])[1] >= quality.LEAST]
    assert all(any(i == k[0] for k in kept) for i in range(40)) and not any(k[0] is not None and 500 <= k[0] < 600 for k in kept)
    # lines
    seen, cut = [], []
    for i, t, lang, source, n in sorted(kept, key=lambda d: (d[0] is not None, d[0] or 0)):
        if t is None:
            cut.append((i, t, lang, source, n))
            continue
        left = []
        for line in t.split("\n"):
            blank = not re.search(r"[^\x20\x09-\x0D]", line)
            long = len(line) >= lines.MIN_CHARS
            if not blank:
                if not any(line == s or long and len(s) >= lines.MIN_CHARS and abs(len(s) - len(line)) <= 2 and len(s) < 500 and _distance(s, line) <= 2 for s in seen):
                    left.append(line)
                seen.append(line)
            else:
                left.append(line)
        if len(left) == len(t.split("\n")) or "".join(left).strip(" "):
            cut.append((i, "\n".join(left), lang, source, len("\n".join(left))))
    # near duplicates
    sets = {k: frozenset(_shingles(d[1], 5)) for k, d in enumerate(cut)}
    alike = lambda a, b: sets[a] == sets[b] or bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = _classes(sorted(sets), alike)
    first = {}
    for k, d in enumerate(cut):
        key = (d[0] is None, d[0] or 0)
        if root[k] not in first or key < first[root[k]][0]:
            first[root[k]] = (key, d)
    one = [d for _, d in first.values()]
    # mix
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for d in one:
        total[d[3]] += size(d[1])
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight, clamped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in clamped]
        level = (1.5 * sum(total.values()) - sum(clamped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * total[s]]
        if not over:
            break
        clamped |= {s: 2 * total[s] for s in over}
    want = Counter()
    e = bpe.Encoder(bpe.vocabulary())
    for s in names:
        target = clamped.get(s, weight[s] * level)
        words = math.floor(target + 0.5)
        whole = min(2, words // total[s]) if total[s] else 0
        rest, prior = words - whole * total[s], 0
        for d in sorted((d for d in one if d[3] == s), key=lambda d: (hashlib.md5(f"17:{hashlib.md5((d[1] or '').encode()).hexdigest() if d[0] is None else d[0]}".encode()).hexdigest(), d[0] or 0, size(d[1]))):
            n = size(d[1])
            taken = whole * n + max(0, min(n, rest - prior))
            prior += n
            times = math.floor(taken / n + 0.5) if n else 1
            ids = e.plain(d[1] or "")
            want[d[0], len(ids), e.tokenizer.decode(ids, skip_special_tokens=False)] += times
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
