"""Components of links, and how many tables they take."""

import random

from sparrowgrid.llm import common


def components(spark, edges, monkeypatch):
    names, stashed = [], common.stash
    monkeypatch.setattr(common, "stash", lambda df, name: names.append(name) or stashed(df, name))
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "links")
    return dict(map(tuple, got.collect())), len(names)


def test_stars_take_no_further_round(spark, monkeypatch):
    assert components(spark, [(5, 1), (7, 1), (9, 8)], monkeypatch) == ({1: 1, 5: 1, 7: 1, 8: 8, 9: 8}, 1)


def test_any_links(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(12)] + [(3, 3)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert components(spark, edges, monkeypatch)[0] == root
