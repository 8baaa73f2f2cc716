"""The filter audit, the divergence audit and the token files: odd tables against SQL and plain versions."""

import random
import struct
import zlib
from itertools import permutations

import duckdb
import pytest

from sparrowgrid.llm import divergence, filters, tokenfile
from sparrowgrid.llm.common import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "délta", "ЖУК", "x", "don't", "A1b", "ÀB", "日本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 150, 260)))) + rng.choice(("", "", " #", "\n|\t", "  ")) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(("en", "de", "", None)), rng.choice(("s", "t", "", None, "ü")), None) for i in range(120)]
    rows += [(None, texts[0], "en", "s", 1), (None, texts[0], None, "t", 1), (7, rows[7][1], "en", "s", 1), (7, rows[8][1], "fr", None, 1), (500, None, "fr", "only", 1), (501, "", "xx", "only", 0)]
    return rows


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, 1), (6, None, 1), (None, 1, 1), (9999, 1, 1)]


def _same(spark, tmp_path, sql, frame, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    labels.coalesce(1).write.parquet(str(tmp_path / "l"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/l/*.parquet'")
    r = con.execute(sql)
    found = [d[0] for d in r.description]
    got = sorted((tuple(x[c] for c in found) for x in frame(docs, labels).collect()), key=str)
    assert got and got == sorted(r.fetchall(), key=str)


def test_filter_audit_of_odd_rows(spark, tmp_path, odd):
    extra = lambda d: d.withColumn("mask", d["doc_id"]).withColumn("part", d["lang"]).withColumn("n", d["doc_id"])  # noqa: E731  clashing names
    _same(spark, tmp_path, filters.OP11_SQL, lambda d, x: filters.audit(extra(d), x.withColumn("first", x["doc_id"])), odd)


def test_filter_audit_in_every_order(spark, odd):
    """Each order applied to the documents one filter after the other."""
    docs = [(r[0], r[1] or "", r[2] or "") for r in odd if r[0] is not None]
    space = str.maketrans("\t\n\x0b\x0c\r", "     ")
    first = {}
    for i, t, _ in docs:
        first[t] = min(first.get(t, i), i)
    fails = []
    for i, t, _ in docs:
        w = [x for x in t.translate(space).split(" ") if x]
        capitals = sum("A" <= c <= "Z" for c in t)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * capitals > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i > first[t]})
    rows = [r for r in odd if r[0] is not None]
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filters.audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()}
    parts = {d[2] for d in docs}
    assert len(got) == 600 * len(parts)
    total = {}
    for p in parts:
        for order in permutations("ABCDE"):
            left = [k for k, d in enumerate(docs) if d[2] == p]
            every = list(left)
            for j, f in enumerate(order):
                r = got[p, "".join(order), j + 1]
                gone = [k for k in left if fails[k][f]]
                redundant = [k for k in every if fails[k][f] and k not in left]
                left = [k for k in left if not fails[k][f]]
                assert (r["kept"], r["removed"], r["redundant"]) == (len(left), len(gone), len(redundant))
                assert r["unique_fails"] == sum(fails[k][f] and sum(fails[k].values()) == 1 for k in every)
                total[p, f] = total.get((p, f), 0) + len(gone)
    assert all(r["shapley"] == total[p, o[s - 1]] for (p, o, s), r in got.items())


def test_divergence_of_odd_rows(spark, tmp_path, odd):
    extra = lambda d: d.withColumn("term", d["text"]).withColumn("no", d["doc_id"]).withColumn("p", d["doc_id"])
    _same(spark, tmp_path, divergence.OP12_SQL, lambda d, _: divergence.divergence(extra(d)), odd)


@pytest.mark.parametrize("c,n,v", [(0, 0, 1), (5, 5, 1), (123, 4567, 89), (9 * 10**15 - 2, 9 * 10**15, 10**6), (10**13 + 7, 3 * 10**15 + 1, 3)])
def test_billionths_are_exact(spark, c, n, v):
    got = spark.sql(f"SELECT {divergence.billionths('c', 'n', 'v')} AS p FROM (SELECT {c}L AS c, {n}L AS n, {v}L AS v)").first()["p"]
    assert got == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_audits_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(docs, labels).count() == 0 and divergence.divergence(docs).count() == 0
    folder = new_folder(spark, "test-token-files")
    tokenfile.write_records(docs, folder, tokenfile.vocabulary())
    assert tokenfile.read_records(spark, folder).count() == 0 and tokenfile.build_index(spark, folder).count() == 0
    # one lang with one source and no kept term: no pairs, no terms
    assert divergence.divergence(spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA)).count() == 0
    assert [(r["part"], r["item"], r["value"]) for r in divergence.divergence(spark.createDataFrame([(1, "a", "en", "s", 1), (2, None, "en", None, 1)], SCHEMA)).orderBy("source").collect()] == [("pair", "s", 0), ("pair", "", 0)]


TEXTS = [
    "", " ", "  ", "a", " a", "a  b", "a\n\n  b\n", "don't we'll 'tis it's", "x <|endoftext|> y  <|endoftext|>", "tab\tand\x1c odd \x1fspaces here  there", "日本語のテキスト と 空白",
    "número 123 ½ ² ٣ élan naïve œuvre ªº µ ßẞ", "é combining", "a" * 5000, "ab " * 3000, "!!! ... ?!,;: (x) [y] {z} ~`@^", "\r\n\r\n x \r", "🙂🙂 🙂", " \n \n a", "a \n", "\x00 nul \x00", "don'T X'S 'S 'll'", "Wort,Wort;3,5 kg.", "fin.\nNext",
]


def _check(t, rows, got):
    """Records in ascending order of doc_id, as the library encodes."""
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    start = 0
    for i in sorted(want):
        ids = want[i]
        assert got[i] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), i
        start += len(ids)


def test_token_file_query(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.op13_token_files(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    _check(Tokenizer.from_file(tokenfile.vocabulary()), rows, got)


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    rng, t, e = random.Random(5), Tokenizer.from_file(tokenfile.vocabulary()), tokenfile.Encoder(tokenfile.vocabulary())
    parts = [" ", "  ", "\n", "\t", "a", "Ab", "é", "Ω", "9", "½", ".", ",", "'", "'s", "'LL", "_", " ", "　", "\x1c", "日", "🙂", "don't", "<|endoftext|>", "ª", "é", "\r\n", "of the"]
    for x in [*TEXTS, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(20_000))]:
        assert list(memoryview(e.encode(x)).cast("H")) == t.encode(x, add_special_tokens=False).ids, x


def test_token_files_of_odd_rows(spark):
    rows = [(i * 3 - 20, x) for i, x in enumerate(TEXTS)] + [(None, "no id"), (None, None), (4, "twice"), (4, "twice"), (900, None)]
    docs = spark.createDataFrame([(i, x, "u") for i, x in rows], "doc_id long, text string, ids string")
    folder = new_folder(spark, "test-token-files")
    tokenfile.write_records(docs, folder, tokenfile.vocabulary(), file_bytes=2000)
    index = tokenfile.build_index(spark, folder)
    by_place = index.orderBy("part", "offset").collect()
    ids = [r["doc_id"] for r in by_place]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i)) and len({r["part"] for r in by_place}) > 1
    at = 0
    for r in by_place:
        assert r["start"] == at
        at += r["n_tokens"]
    every = {(r["part"], r["offset"]): r for r in tokenfile.read_records(spark, folder).collect()}
    assert len(every) == len(rows) and all(len(every[r["part"], r["offset"]]["ids"]) == 4 * r["n_tokens"] for r in by_place)
    some = index.filter("doc_id IN (4, 7)").withColumn("note", index["doc_id"] * 2)
    got = tokenfile.read_at(spark, folder, some).collect()
    assert sorted(r["note"] for r in got) == [8, 8, 8, 14] and all(bytes(r["ids"]) in [bytes(x["ids"]) for x in every.values() if x["doc_id"] == r["doc_id"]] for r in got)
    shuffled = [tokenfile.read_shuffled(spark, folder, index, seed).collect() for seed in (1, 1, 2)]
    assert shuffled[0] == shuffled[1] and [r["doc_id"] for r in shuffled[0]] != [r["doc_id"] for r in shuffled[2]] != ids
    assert sorted(bytes(r["ids"]) for r in shuffled[2]) == sorted(bytes(r["ids"]) for r in every.values())


def test_damaged_records_are_noticed():
    data = tokenfile.record(5, b"\1\0\2\0", 2) + tokenfile.record(None, b"\3\0\0\0", 4)
    assert [(i, list(x)) for _, _, i, x in tokenfile.records(data)] == [(5, [1, 2]), (None, [3])]
    for at in range(len(data)):
        with pytest.raises(ValueError):
            list(tokenfile.records(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :]))
    for n in range(1, len(data)):
        if n != len(tokenfile.record(5, b"\1\0\2\0", 2)):
            with pytest.raises(ValueError):
                list(tokenfile.records(data[:n]))
