"""Map extracts that the test writes, read back and filtered."""

import random
import struct
import zlib

import pytest

from sparrowgrid.sources import extracts


def varint(x):
    x &= (1 << 64) - 1
    out = bytearray()
    while x >= 128:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


zig = lambda x: x << 1 if x >= 0 else (-x << 1) - 1
pack = lambda xs: b"".join(map(varint, xs))
steps = lambda xs: pack(zig(b - a) for a, b in zip([0, *xs], xs))


def blob(kind, body, plain=False):
    b = field(1, body) if plain else field(2, len(body)) + field(3, zlib.compress(body))
    head = field(1, kind.encode()) + field(3, len(b))
    return struct.pack(">I", len(head)) + head + b


def block(rows, dense, grain=100, lat0=0):
    words = [""]
    at = lambda w: words.index(w) if w in words else words.append(w) or len(words) - 1
    deg = lambda x, base: round((x * 1e9 - base) / grain)
    keyed = lambda t: field(2, pack(at(k) for k in t)) + field(3, pack(at(v) for v in t.values()))
    groups = []
    nodes = [r for r in rows if r[0] == "node"]
    if nodes and dense:
        kv = [x for r in nodes for x in [*(y for k, v in r[4].items() for y in (at(k), at(v))), 0]]
        groups.append(field(2, field(1, steps([r[1] for r in nodes])) + field(8, steps([deg(r[2], lat0) for r in nodes])) + field(9, steps([deg(r[3], 0) for r in nodes])) + field(10, pack(kv))))
    elif nodes:
        groups.append(b"".join(field(1, field(1, zig(r[1])) + keyed(r[4]) + field(8, zig(deg(r[2], lat0))) + field(9, zig(deg(r[3], 0)))) for r in nodes))
    for r in rows:
        if r[0] == "way":
            groups.append(field(3, field(1, r[1]) + keyed(r[4]) + field(8, steps(r[5]))))
        elif r[0] == "relation":
            m = r[6]
            groups.append(field(4, field(1, r[1]) + keyed(r[4]) + field(8, pack(at(x[2]) for x in m)) + field(9, steps([x[1] for x in m])) + field(10, pack(extracts.KINDS.index(x[0]) for x in m))))
    table = b"".join(field(1, w.encode()) for w in words)
    return field(1, table) + b"".join(field(2, g) for g in groups) + field(17, grain) + field(19, lat0)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    nodes = [("node", 10**10 - 7 * i if i % 2 else i + 1, round(53 + r.random(), 6), round(-8 - r.random(), 6), {"power": "tower"} if i % 9 == 0 else {"name": "é"} if i % 5 == 0 else {}, None, None) for i in range(200)]
    ids = [n[1] for n in nodes]
    ways = [("way", 500 + i, None, None, {"power": "line", "voltage": "110000"} if i % 3 == 0 else {"highway": "x"}, r.sample(ids, 4), None) for i in range(30)]
    relations = [("relation", 900, None, None, {"power": "circuit"}, None, [("way", 501, "section"), ("node", ids[3], ""), ("way", 77777, "gone")]), ("relation", 901, None, None, {"route": "bus"}, None, [("way", 502, "")])]
    return nodes, ways, relations


@pytest.fixture(scope="module")
def path(rows, tmp_path_factory):
    nodes, ways, relations = rows
    p = tmp_path_factory.mktemp("extract") / "a.pbf"
    parts = [blob("OSMHeader", field(4, b"DenseNodes"))]
    for k in range(0, 200, 40):
        parts.append(blob("OSMData", block(nodes[k : k + 40], dense=k % 80 == 0, grain=1000 if k == 80 else 100, lat0=10**9 if k == 40 else 0), plain=k == 120))
    parts += [blob("OSMData", block(ways, False)), blob("OSMData", block(relations, False)), blob("OSMData", block([], True))]
    p.write_bytes(b"".join(parts))
    return str(p)


def test_round_trip_in_runs_of_blocks(spark, rows, path):
    d = extracts.read_extract(spark, path, run_bytes=1500)
    assert d.rdd.getNumPartitions() > 2
    got = {(r["kind"], r["id"]): r for r in d.collect()}
    every = [x for part in rows for x in part]
    assert len(got) == len(every) == d.count()
    for kind, i, lat, lon, tags, refs, members in every:
        r = got[kind, i]
        assert (r["tags"], r["refs"]) == (tags, refs) and (lat is None or (r["lat"], r["lon"]) == pytest.approx((lat, lon), abs=1e-9))
        assert (r["members"] is None) == (members is None) and [tuple(m) for m in r["members"] or []] == (members or [])
    assert extracts.read_extract(spark, "file://" + path, path).count() == 2 * len(every)


def test_prefilter(spark, rows, path):
    nodes, ways, relations = rows
    got = {(r["kind"], r["id"]): r["own"] for r in extracts.prefiltered(extracts.read_extract(spark, path), ["power"]).collect()}
    own = {(x[0], x[1]) for part in rows for x in part if "power" in x[4]}
    kept = {("way", w[1]) for w in ways if "power" in w[4] or w[1] == 501}
    want = own | kept | {("node", nodes[3][1])} | {("node", n) for w in ways if ("way", w[1]) in kept for n in w[5]}
    assert set(got) == want and {k for k, v in got.items() if v} == own
    assert extracts.prefiltered(extracts.read_extract(spark, path), []).count() == 0


def test_damaged_extracts(spark, path, tmp_path):
    data = open(path, "rb").read()
    for k, cut in enumerate((len(data) - 5, 3, 60)):
        p = tmp_path / f"{k}.pbf"
        p.write_bytes(data[:cut])
        with pytest.raises(Exception, match="cut off or damaged"):
            extracts.read_extract(spark, str(p)).count()
    p = tmp_path / "none.pbf"
    p.write_bytes(b"")
    assert extracts.read_extract(spark, str(p)).count() == 0
