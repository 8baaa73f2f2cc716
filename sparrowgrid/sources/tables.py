"""Readers and writers of tabular networks, hourly JSON blocks, sheets, layers, tidy series and paged services."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Schemas of network component tables.
SCHEMAS = {
    "buses": "name string, v_nom double, x double, y double, control string",
    "lines": "name string, bus0 string, bus1 string, x double, r double, b double, s_nom double, length double, carrier string",
    "generators": "name string, bus string, control string, p_nom double, p_min_pu double, p_max_pu double, carrier string, marginal_cost double",
    "loads": "name string, bus string, carrier string, p_set double",
    "links": "name string, bus0 string, bus1 string, carrier string, efficiency double, p_nom double, p_min_pu double, p_max_pu double",
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a stated schema; what does not parse is NULL."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def load_network(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in SCHEMAS.items()}


def save_network(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each component, and a manifest of their names."""
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(n,) for n in sorted(tables)], "component string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def catalog(spark: SparkSession, path: str, scenario: str | None = None, scope: str | None = None) -> DataFrame:
    m = spark.read.option("header", True).csv(path)
    for c, v in (("scenario", scenario), ("scope", scope)):
        m = m if v is None else m.filter(F.col(c) == v)
    return m


def hourly_block(raw: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows of a JSON block of parallel arrays ({"time": [...], value: [...]}): snapshot and one column for each value."""
    schema = "struct<time: array<string>, " + ", ".join(f"`{v}`: array<double>" for v in values) + ">"
    j = raw.withColumn("__j", F.from_json(column, schema)).drop(column)
    z = j.withColumn("__z", F.explode(F.arrays_zip(F.col("__j.time").alias("time"), *[F.col(f"__j.{v}").alias(v) for v in values]))).drop("__j")
    return z.select("*", F.to_timestamp("__z.time").alias("snapshot"), *[F.col(f"__z.{v}").alias(v) for v in values]).drop("__z")


def discovered(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns found without regard to case among their aliases; a missing one raises."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, options in aliases.items():
        found = next((have[o.lower()] for o in options if o.lower() in have), None)
        if found is None:
            raise ValueError(f"no column for {name}: {options}")
        out.append(F.col(found).alias(name))
    return df.select(*out)


def tidy(df: DataFrame, order: str, carried: str, periods: str, metrics: list[str], by: str | None = None) -> DataFrame:
    """A sheet with a carried-forward label and one column for each metric -> label, period, metric, value. `by`: the column
    that tells sheets apart; each is read in its own order."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn(carried, F.last(carried, ignorenulls=True).over(w))
    return d.unpivot([*([by] if by else []), carried, periods], metrics, "metric", "value").filter("value IS NOT NULL")


def rejoined(df: DataFrame, order: str, starts, text: str, by: str | None = None) -> DataFrame:
    """Wrapped rows joined to the row that starts them, for each document of `by`."""
    key = [by] if by else []
    d = df.withColumn("record", F.sum(starts.cast("int")).over(Window.partitionBy(*key).orderBy(order)))
    return d.groupBy(*key, "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias(text))


def table_lines(df: DataFrame, text: str, pattern: str, names: list[str]) -> DataFrame:
    """Rows of a printed table: the groups of a pattern as columns, numbers without their thousands marks; lines that do not
    match are left out."""
    d = df.filter(F.col(text).rlike(pattern))
    cell = lambda i: F.nullif(F.trim(F.regexp_extract(text, pattern, i)), F.lit(""))
    plain = lambda c: F.when(c.rlike(r"^-?[\d,]+(\.\d+)?%?$"), F.regexp_replace(c, "[,%]", "")).otherwise(c)
    return d.select(*[plain(cell(i)).alias(n) for i, n in enumerate(names, 1)])


def before_marker(df: DataFrame, order: str, marker) -> tuple[DataFrame, DataFrame]:
    """A sheet that holds two tables, split at its first marker row."""
    at = df.filter(marker).agg(F.min(order).alias("__at"))
    j = df.crossJoin(F.broadcast(at))  # one row
    return j.filter(F.col("__at").isNull() | (F.col(order) < F.col("__at"))).drop("__at"), j.filter(F.col(order) > F.col("__at")).drop("__at")


def interned(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """A column replaced by the rank of its value, from 0, and the dictionary. The values are sorted in ranges, a task each; a
    rank is the place in its range and the number of values in the ranges before. Rows with NULL are left out."""
    from ..operators.graph import saved

    d = df.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(F.col(column)).sortWithinPartitions(column)
    d = saved(d.withColumn("__at", F.monotonically_increasing_id()))  # the range's number, and the place in it in the lower 33 bits
    d = d.withColumn("__range", F.shiftright("__at", 33))
    sizes = d.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    words = d.join(sizes, "__range").select(column, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias(f"{column}_id"))
    return df.join(words, column).drop(column), words


def delta_encoded(points: str) -> Column:
    """An array of numbers as its first and the steps from one to the next."""
    return F.transform(F.col(points), lambda x, i: F.when(i == 0, x).otherwise(x - F.get(F.col(points), i - 1)))


def matrix_rows(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A long table (row, column, value) as one row for each row key with its values in the order of the column keys: what a
    matrix file holds, with its row and column order. Absent cells are 0."""
    order = df.select(column).distinct().agg(F.array_sort(F.collect_list(column)).alias("columns"))
    m = df.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(column, value))).alias("__m"))
    j = m.crossJoin(F.broadcast(order))  # one row: the order of columns
    return j.select(row, "columns", F.transform("columns", lambda c: F.coalesce(F.try_element_at("__m", c), F.lit(0.0))).alias("values"))


def payload(df: DataFrame, path: str) -> None:
    """One JSON object to a line, nulls at the end of arrays cut off, for a page that draws it."""
    trim = lambda c: F.slice(c, 1, F.coalesce(F.array_max(F.transform(F.col(c), lambda x, i: F.when(x.isNotNull(), i + 1))), F.lit(0)))
    cols = [trim(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def verified(spark: SparkSession, path: str, md5: dict[str, str]) -> DataFrame:
    """name, content of files whose MD5 is as published; a file with another one, or a missing one, raises."""
    want = spark.createDataFrame(sorted(md5.items()), "name string, want string")
    f = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    j = want.join(f, "name", "left").withColumn("__got", F.md5("content"))
    bad = F.when(~F.coalesce(F.col("__got") == F.lower("want"), F.lit(False)), F.raise_error(F.concat(F.lit("checksum of "), "name")))
    return j.withColumn("__bad", bad).filter("__bad IS NULL").select("name", "content")


CELLS = "file string, sheet string, row int, col int, value string"


def _sheet_cells(content: bytes):
    """(sheet, row, column, text) of the cells of a workbook that are not empty; rows and columns count from 1."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name))
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in read("xl/sharedStrings.xml").iter(f"{main}si")]
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        for sheet in read("xl/workbook.xml").iter(f"{main}sheet"):
            target = targets[sheet.get(link)]
            for c in read(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(f"{main}c"):
                place = c.get("r")
                letters = place.rstrip("0123456789")
                value = c.find(f"{main}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{main}t"))
                elif value is None:
                    continue
                else:
                    text = strings[int(value.text)] if c.get("t") == "s" else value.text
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                yield sheet.get("name"), int(place[len(letters) :]), column, text


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, col, value (text) of all cells of the spreadsheets (.xlsx) at a path; a file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["file"], b["content"]):
                yield pd.DataFrame([(name, *cell) for cell in _sheet_cells(content)], columns=["file", "sheet", "row", "col", "value"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    return files.mapInPandas(run, CELLS)


def sheet_table(cells: DataFrame, header: int, columns: dict[str, str]) -> DataFrame:
    """Cells of one sheet as a table: the header row names the columns (name -> type); what does not parse is NULL, and rows
    without any value are left out."""
    names = cells.filter(F.col("row") == header).select("file", "sheet", "col", F.trim("value").alias("name"))
    body = cells.filter(F.col("row") > header).join(names, ["file", "sheet", "col"])
    wide = body.groupBy("file", "sheet", "row").pivot("name", list(columns)).agg(F.first("value"))
    typed = wide.select("file", "sheet", "row", *[F.col(f"`{n}`").try_cast(t).alias(n) for n, t in columns.items()])
    return typed.dropna("all", subset=list(columns))


def read_layers(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """file, fid, wkb, attributes (map) of one layer of the GeoPackages at a path. The geometry's header is taken off, what
    stays is well-known binary. A file is read by one task, in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["file"], b["content"]):
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                (geometry,) = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                found = con.execute('SELECT * FROM "{}"'.format(layer.replace('"', '""')))
                cols = [d[0] for d in found.description]
                rows = []
                for n, r in enumerate(found, 1):
                    g = dict(zip(cols, r))
                    blob = g.pop(geometry)
                    rows.append((name, int(g.pop("fid", n)), None if blob is None else _wkb(blob), {k: None if v is None else str(v) for k, v in g.items()}))
                con.close()
                yield pd.DataFrame(rows, columns=["file", "fid", "wkb", "attributes"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    return files.mapInPandas(run, "file string, fid long, wkb binary, attributes map<string,string>")


ENVELOPE = (0, 32, 48, 48, 64)  # fixed values: bytes of the envelope by its code


def _wkb(blob: bytes) -> bytes:
    return bytes(blob)[8 + ENVELOPE[(blob[3] >> 1) & 7] :]


def layer_file(rows: list[tuple[int, bytes, dict]], layer: str, srs: int = 4326) -> bytes:
    """A GeoPackage with one layer of (fid, well-known binary, attributes): the reverse of read_layers(), for a layer that
    fits a driver."""
    names = list(dict.fromkeys(k for _, _, a in rows for k in a))
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
    con.execute(f"CREATE TABLE {quoted(layer)} ({', '.join(['fid INTEGER PRIMARY KEY', 'geom BLOB', *(quoted(n) + ' TEXT' for n in names)])})")
    con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srs))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srs))
    head = b"GP\x00\x01" + srs.to_bytes(4, "little")
    con.executemany(f"INSERT INTO {quoted(layer)} VALUES ({', '.join('?' * (2 + len(names)))})", [(i, head + g, *(a.get(n) for n in names)) for i, g, a in rows])
    con.commit()
    return con.serialize()


class PagedSource(DataSource):
    """Rows of a service that counts first and serves ordered pages; one partition for each page, so that a lost task
    fetches one page again.

    Class attributes: `count`, a function that gives the number of rows (or None: the option `pages` tells the number of
    pages), and `fetch`, a function of the page number that yields rows. Options: page_rows (rows to a page), pages, first
    (the page to resume from)."""

    fetch: Callable[[int], Iterator[tuple]] = staticmethod(lambda page: iter(()))
    count: Callable[[], int | None] = staticmethod(lambda: None)

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> DataSourceReader:
        source = self

        class Reader(DataSourceReader):
            def partitions(self):
                rows = type(source).count()
                pages = int(source.options["pages"]) if rows is None else -(-rows // int(source.options.get("page_rows", 1000)))
                return [InputPartition(i) for i in range(int(source.options.get("first", 0)), pages)]

            def read(self, partition):
                yield from type(source).fetch(partition.value)

        return Reader()


def missing_days(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """Days (`day`) from first to last that have no partition day=... in a folder yet: where a download by days resumes."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().getName()[4:] for s in fs.listStatus(path) if s.getPath().getName().startswith("day=")] if fs.exists(path) else []
    return days.filter(~F.col("day").cast("string").isin(done)) if done else days
