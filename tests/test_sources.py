"""Readers on small files of their own."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from sparrowgrid.functions import scalars
from sparrowgrid.sources import cases, tables

# fixed values: lines as the format has them
HEAD = "0, 100.00, 35, 0, 1, 50.00 / title\nline two\nline three\n"
BUSES = "@! comment\n1,'A   ',110.0,1,3,1,1,1.0,0.0\r\n2,\"B,x\",220.0,1,13,1,1,1.0,0.0 / note\n0 / END OF BUS DATA\n"
LOADS = "1,'1 ',1,3,1,10.0,2.0\n2,'1 ',0,3,1,5.0\n0 / END OF LOAD DATA\n"


def write(tmp_path, text, name="a.raw"):
    p = tmp_path / name
    p.write_bytes(text.encode("latin-1"))
    return f"file://{p}"


def test_split_fields(spark):
    # fixed values: lines and the fields that the format gives them
    want = {
        "1,'a, b ',3 / note": ["1", "a, b ", "3"], "": [""], ",": ["", ""], "  10,'F_M   ',  38.0,1": ["10", "F_M   ", "38.0", "1"], "\"it's\",1,": ["it's", "1", ""],
        "0,  100.00, 35 / some, more": ["0", "100.00", "35"], "'open, end": ["open, end"], "1,/": ["1", ""], "a'b/c'd": ["ab/cd"], "'','x'": ["", "x"],
    }
    d = spark.createDataFrame([(k,) for k in want], "line string").select("line", cases.split_fields("line").alias("f"))
    assert {r["line"]: r["f"] for r in d.collect()} == want


def test_named_sections_and_all_tables(spark, tmp_path):
    begin = lambda a, b: f"0 / END OF {a} DATA, BEGIN {b} DATA\r\n"
    text = HEAD.replace("35,", "35.0,") + begin("SYSTEM-WIDE", "BUS") + BUSES.rsplit("0 /", 1)[0] + begin("BUS", "LOAD") + LOADS.rsplit("0 /", 1)[0] + begin("LOAD", "FIXED SHUNT") + "9,9\n" + begin("FIXED SHUNT", "GENERATOR")
    text += "1,'W1',25.5,0,10,-10,1.01,0,0,40.0,0,1,0,0,1,1,100,40,0\n" + begin("GENERATOR", "BRANCH") + "1, 2,'1 ',0.01,0.1,0.02,'line',100,110,120\n" + begin("BRANCH", "TRANSFORMER")
    text += "1,2,0,'1 ',1,1,1,0,0,2,'T1',1\n0.001,0.05,100\n1.0,110,30.0,50\n1.0,38\n1,2,3,'1 ',1\n0.1,0.2,100,0.3\n1\n2\n3,400\n" + begin("TRANSFORMER", "AREA") + "1,0,0,0,'EAST  '\n" + begin("AREA", "TWO-TERMINAL DC")
    text += '"dc ",1,2.0956\n11,2,15\n22,4,18\n' + begin("TWO-TERMINAL DC", "ZONE") + "7,'Z7'\n0 / END OF ZONE DATA\nQ\n"
    t = cases.read_case(spark, write(tmp_path, text))
    row = lambda name, *cols: [tuple(r[c] for c in cols) for r in t[name].collect()]
    assert sorted(row("bus", "I", "NAME")) == [(1, "A   "), (2, "B,x")] and len(row("load", "I")) == 2
    assert row("generator", "I", "ID", "PG", "MBASE", "STAT", "PT", "WMOD") == [(1, "W1", 25.5, 40.0, 1, 40.0, None)]
    assert row("branch", "I", "J", "CKT", "X", "NAME", "RATE1", "RATE3", "RATE4", "STAT") == [(1, 2, "1 ", 0.1, "line", 100.0, 120.0, None, None)]
    assert sorted(row("transformer", "K", "X1_2", "NOMV1", "ANG1", "RATE1_1", "NOMV2", "WINDV3", "NOMV3", "WINDINGS")) == [(0, 0.05, 110.0, 30.0, 50.0, 38.0, None, None, 2), (3, 0.2, None, None, None, None, 3.0, 400.0, 3)]
    assert row("two-terminal dc", "NAME", "RDC", "IPR", "ANMXR", "IPI", "NBI") == [("dc ", 2.0956, 11, 15.0, 22, 4)]
    assert row("area", "ARNAME") == [("EAST  ",)] and row("zone", "I", "ZONAME") == [(7, "Z7")]
    assert row("header", "sbase", "title") == [(100.0, ["line two", "line three"])]


def test_unknown_section_raises(spark, tmp_path):
    with pytest.raises(Exception, match="unknown section"):
        cases.read_case(spark, write(tmp_path, HEAD + "0 / END OF X DATA, BEGIN ODD DATA\n"))["bus"].collect()


def test_flat_sections(spark, tmp_path):
    t = cases.read_case(spark, write(tmp_path, HEAD + BUSES + LOADS))
    assert [(r["I"], r["NAME"], r["BASKV"], r["NVHI"]) for r in t["bus"].orderBy("I").collect()] == [(1, "A   ", 110.0, None), (2, "B,x", 220.0, None)]
    assert t["load"].filter("STAT = 1").agg(F.sum("PL")).first()[0] == 10.0


def test_other_revision_raises(spark, tmp_path):
    with pytest.raises(Exception, match="unsupported revision"):
        cases.read_case(spark, write(tmp_path, HEAD.replace("35", "33") + BUSES))["bus"].collect()


def test_long_record_raises(spark, tmp_path):
    with pytest.raises(Exception, match="too long"):
        cases.read_case(spark, write(tmp_path, HEAD + "1" + ",1" * 20 + "\n0 /\n"))["bus"].collect()


def test_transformers_do_not_slide(spark, tmp_path):
    two, three = "1,2,0,'1'\n0.1,0.2\n1,0\n1,0\n", "1,2,3,'1'\n0.1\n1\n1\n1\n"
    body = HEAD + "0 /\n" * 6 + two + three + two + "0 /\n"
    rows = cases.lexed(cases.sections(cases.read_lines(spark, write(tmp_path, body))))
    assert [r["windings"] for r in cases.transformer_records(rows).orderBy("record").collect()] == [2, 3, 2]
    cut = cases.lexed(cases.sections(cases.read_lines(spark, write(tmp_path, HEAD + "0 /\n" * 6 + three[:-2] + "0 /\n", "b.raw"))))
    with pytest.raises(Exception, match="inside a record"):
        cases.transformer_records(cut).collect()


def test_ragged_dc_block_raises(spark, tmp_path):
    good = cases.lexed(cases.sections(cases.read_lines(spark, write(tmp_path, HEAD + "0 /\n" * 8 + "'dc1',1\n1,2\n3,4\n0 /\n"))))
    assert cases.grouped_records(good, "two-terminal dc", 3).count() == 1
    bad = cases.lexed(cases.sections(cases.read_lines(spark, write(tmp_path, HEAD + "0 /\n" * 8 + "'dc1',1\n1,2\n0 /\n", "c.raw"))))
    with pytest.raises(Exception, match="inside a record"):
        cases.grouped_records(bad, "two-terminal dc", 3).collect()


def test_hourly_block_and_aliases(spark):
    raw = spark.createDataFrame([(1, '{"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "v": [1.0, 2.5]}')], "cell int, js string")
    assert [(r["cell"], r["v"]) for r in tables.hourly_block(raw, "js", ["v"]).orderBy("snapshot").collect()] == [(1, 1.0), (1, 2.5)]
    d = spark.createDataFrame([("t", 1.0)], "EffectiveTime string, Value double")
    assert tables.discovered(d, {"time": ["time", "effectivetime"], "value": ["value"]}).columns == ["time", "value"]
    with pytest.raises(ValueError):
        tables.discovered(d, {"x": ["nothing"]})


def test_network_round_trip(spark, tmp_path):
    b = spark.createDataFrame([("a", "1021", "star:1", 0.1)], "name string, bus0 string, bus1 string, x double")
    tables.save_network({"lines": b}, f"file://{tmp_path}/net")
    assert spark.read.parquet(f"file://{tmp_path}/net/lines").collect() == b.collect()


def test_sheet_helpers(spark):
    d = spark.createDataFrame([(1, "2023", "Jan", 1.0, None), (2, None, "Feb", 2.0, 3.0)], "n int, year string, period string, a double, b double")
    assert sorted((r["year"], r["period"], r["metric"], r["value"]) for r in tables.tidy(d, "n", "year", "period", ["a", "b"]).collect()) == [("2023", "Feb", "a", 2.0), ("2023", "Feb", "b", 3.0), ("2023", "Jan", "a", 1.0)]
    one, two = tables.before_marker(d, "n", F.col("n") == 1)
    assert one.count() == 0 and two.count() == 1
    assert tables.rejoined(d, "n", F.col("year").isNotNull(), "period").first()["period"] == "Jan Feb"


def test_paged_source(spark):
    class Numbers(tables.PagedSource):
        fetch = staticmethod(lambda page: iter([(page, page * 10 + i) for i in range(3)]))

        @classmethod
        def name(cls):
            return "numbers"

        def schema(self):
            return "page int, v int"

    spark.dataSource.register(Numbers)
    assert spark.read.format("numbers").option("pages", 4).load().count() == 12


def test_volts_and_curves(spark):
    # fixed values: texts and the voltages they stand for
    cases_ = [(None, None), ("yes", None), ("-1", None), ("10000;20000", 20000.0), ("38000 V", 38000.0), ("110000", 110000.0)]
    d = spark.createDataFrame(cases_, "raw string, want double").withColumn("got", scalars.parse_volts("raw"))
    assert all(r["want"] == r["got"] for r in d.collect())
    v = spark.createDataFrame([(x,) for x in (0.0, 2.9, 3.0, 8.0, 12.0, 24.9, 25.0, None)], "v double").select("v", scalars.power_curve("v").alias("cf"), scalars.fleet_curve("v").alias("f"))
    got = {r["v"]: r["cf"] for r in v.collect()}
    assert got[0.0] == got[2.9] == got[25.0] == 0 and got[3.0] == 0 and 0 < got[8.0] < 1 and got[12.0] == got[24.9] == 1 and got[None] is None
    clip = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double").select(scalars.clip("x", 0.0, 1.0).alias("x"))
    assert [r["x"] for r in clip.collect()] == [None, 0.0, 1.0]


def workbook(sheets):
    """A small .xlsx, made by hand: shared strings, numbers, an inline string, gaps."""
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings, out = [], io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, rows in enumerate(sheets.values(), 1):
            cells = ""
            for r, row in enumerate(rows, 1):
                cells += f'<row r="{r}">'
                for c, v in enumerate(row):
                    place = f"{chr(65 + c)}{r}"
                    if isinstance(v, str):
                        strings.append(v)
                        cells += f'<c r="{place}" t="s"><v>{len(strings) - 1}</v></c>'
                    elif v is not None:
                        cells += f'<c r="{place}"><v>{v}</v></c>'
                cells += "</row>"
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"Wind": [["title"], ["Hour", "MW", "note"], [1, 2.5, "x"], [2, "n/a", None], [None, None, None], [3, 7]], "Other": [["v"], [9]]}))
    cells = tables.read_workbooks(spark, f"file://{tmp_path}/*.xlsx")
    got = tables.sheet_table(cells.filter("sheet = 'Wind'"), 2, {"Hour": "int", "MW": "double", "note": "string"}).orderBy("row")
    assert [tuple(r)[2:] for r in got.collect()] == [(3, 1, 2.5, "x"), (4, 2, None, None), (6, 3, 7.0, None)]
    assert [r["value"] for r in cells.filter("sheet = 'Other'").orderBy("row").collect()] == ["v", "9"]


def test_layers_round_trip(spark, tmp_path):
    point = lambda x, y: b"\x01\x01\x00\x00\x00" + struct.pack("<dd", x, y)
    rows = [(1, point(-6.2, 53.3), {"name": "A", "kv": "110"}), (2, point(-8.0, 52.0), {"name": "B"})]
    (tmp_path / "n.gpkg").write_bytes(tables.layer_file(rows, "stations"))
    got = tables.read_layers(spark, f"file://{tmp_path}/n.gpkg", "stations").orderBy("fid").collect()
    assert [(r["fid"], bytes(r["wkb"]), r["attributes"]) for r in got] == [(1, rows[0][1], {"name": "A", "kv": "110"}), (2, rows[1][1], {"name": "B", "kv": None})]


def test_verified_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    good = {"x.bin": hashlib.md5(b"abc").hexdigest().upper()}
    assert [(r["name"], bytes(r["content"])) for r in tables.verified(spark, f"file://{tmp_path}/*.bin", good).collect()] == [("x.bin", b"abc")]
    for bad in ({"x.bin": "0" * 32}, good | {"y.bin": "0" * 32}):
        with pytest.raises(Exception, match="checksum"):
            tables.verified(spark, f"file://{tmp_path}/*.bin", bad).collect()


def test_counted_pages_and_resume(spark):
    class Counted(tables.PagedSource):
        count = staticmethod(lambda: 25)
        fetch = staticmethod(lambda page: ((i,) for i in range(page * 10, min(25, page * 10 + 10))))

        @classmethod
        def name(cls):
            return "counted"

    spark.dataSource.register(Counted)
    read = lambda **o: sorted(r["i"] for r in spark.read.format("counted").schema("i int").options(page_rows=10, **o).load().collect())
    assert read() == list(range(25)) and read(first=2) == list(range(20, 25))


def test_missing_days(spark, tmp_path):
    assert tables.missing_days(spark, f"file://{tmp_path}/none", "2024-02-27", "2024-03-01").count() == 4
    for d in ("2024-02-28", "2024-03-01"):
        (tmp_path / f"day={d}").mkdir()
    assert [str(r["day"]) for r in tables.missing_days(spark, f"file://{tmp_path}", "2024-02-27", "2024-03-01").orderBy("day").collect()] == ["2024-02-27", "2024-02-29"]


def test_matrix_payload_and_printed_tables(spark, tmp_path):
    long = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 3.0), ("b", 2, 7.0)], "bus string, hour int, mw double")
    got = {r["bus"]: (r["columns"], r["values"]) for r in tables.matrix_rows(long, "bus", "hour", "mw").collect()}
    assert got == {"a": ([1, 2], [3.0, 5.0]), "b": ([1, 2], [0.0, 7.0])}
    d = spark.createDataFrame([(1, [1, None, 2, None, None], None), (2, [None], "x")], "id int, v array<int>, s string")
    tables.payload(d, f"file://{tmp_path}/p")
    lines = sorted(x for f in (tmp_path / "p").glob("part-*") for x in f.read_text().splitlines())
    assert lines == ['{"id":1,"v":[1,null,2]}', '{"id":2,"v":[],"s":"x"}']
    t = spark.createDataFrame([("Jan 1,234.5 12%",), ("a heading",), ("Feb -7 x",)], "line string")
    assert [tuple(r) for r in tables.table_lines(t, "line", r"^(\w{3}) (\S+) (\S+)$", ["month", "mwh", "share"]).collect()] == [("Jan", "1234.5", "12"), ("Feb", "-7", "x")]


def test_lists_and_strict_voltages(spark):
    d = spark.createDataFrame([("['a', \"b\"]",), ("{x; y}",), ("a, , b",), (None,)], "raw string")
    assert [r[0] for r in d.select(scalars.listed("raw")).collect()] == [["a", "b"], ["x", "y"], ["a", "b"], None]
    v = spark.createDataFrame([("110",), ("38 kV",), ("110;220",), ("yes",), ("-1",), (None,)], "raw string")
    assert [r[0] for r in v.select(scalars.strict_kilovolts("raw")).collect()] == [110.0, 38.0, None, None, None, None]


def test_station_keys(spark):
    # fixed values: names and the stations that the rules give them
    want = {"HY_ARDN ": "ARDN", "w_pv_x": "X", "CLOGHER_CAP": "CLOGHER", "ENNK_PST": "ENNK", "ANTR1A": "ANTR1", "COOL1-": "COOL1", "CAST1B": "CAST1", "A1B": "A1B", "TEG FOO T": "FOO", "KILL1-CL": "KILL1-CL", "MAGF2-": "MAGF2", "X ESS_SVC": "X", "": ""}
    d = spark.createDataFrame([(k,) for k in want], "n string").select("n", scalars.station_key("n").alias("s"))
    assert {r["n"]: r["s"] for r in d.collect()} == want


def test_interned_ranks_in_ranges(spark):
    from sparrowgrid.sources import tables

    rows = [(i, f"w{i * 7919 % 1000:04d}") for i in range(3000)] + [(5000, None)]
    coded, words = tables.interned(spark.createDataFrame(rows, "i int, name string").repartition(5), "name")
    names = sorted({w for _, w in rows if w})
    assert {r["name"]: r["name_id"] for r in words.collect()} == {w: k for k, w in enumerate(names)}
    assert {r["i"]: r["name_id"] for r in coded.collect()} == {i: names.index(w) for i, w in rows if w}
