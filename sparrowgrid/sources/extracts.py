"""Map extracts in the PBF format as a table of objects, and the prefilter that keeps what a study needs.

A file is a run of length-prefixed blocks, each for itself: only their heads are read to plan the scan, and a partition is a
run of blocks of one file. Blocks are decoded with numpy (variable-length integers, differences, dense nodes)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>, members array<struct<kind: string, id: long, role: string>>"
KINDS = ("node", "way", "relation")  # fixed by the format, in this order
RUN_BYTES = 32_000_000  # of blocks to a partition, about


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: whole numbers as they are, the rest as bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 2, 5):
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            if at + n > end:
                raise ValueError("a field of the extract is cut off")
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"field type {kind} is not used by map extracts")


def packed(data: bytes) -> np.ndarray:
    """All variable-length integers of a packed field, as unsigned 64-bit numbers."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    last = b < 128
    if not last[-1]:
        raise ValueError("a packed field of the extract is cut off")
    begin = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begin)


def zigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def summed(data: bytes) -> np.ndarray:
    """Signed numbers that were stored as differences."""
    return np.cumsum(zigzag(packed(data)))


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def one(m: dict[int, list], number: int, default=b""):
    return m[number][-1] if number in m else default


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def objects(block: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of a data block."""
    m = message(block)
    words = [w.decode("utf-8", "replace") for w in message(one(m, 1)).get(1, [])]
    grain, lat0, lon0 = one(m, 17, 100), signed(one(m, 19, 0)), signed(one(m, 20, 0))
    place = lambda x, base: 1e-9 * (base + grain * x)
    tags = lambda o: [(words[int(k)], words[int(v)]) for k, v in zip(packed(b"".join(o.get(2, []))), packed(b"".join(o.get(3, []))))]
    for group in m.get(2, []):
        g = message(group)
        for raw in g.get(1, []):
            o = message(raw)
            i, lat, lon = (int(zigzag(np.array([one(o, f, 0)], np.uint64))[0]) for f in (1, 8, 9))
            yield "node", i, place(lat, lat0), place(lon, lon0), tags(o), None, None
        for raw in g.get(2, []):
            o = message(raw)
            ids, lats, lons = (summed(one(o, f)) for f in (1, 8, 9))
            keyed = iter(packed(one(o, 10)).tolist())
            for i, lat, lon in zip(ids.tolist(), lats.tolist(), lons.tolist()):
                own = []
                for k in keyed:
                    if not k:
                        break
                    own.append((words[k], words[next(keyed)]))
                yield "node", i, place(lat, lat0), place(lon, lon0), own, None, None
        for raw in g.get(3, []):
            o = message(raw)
            yield "way", signed(one(o, 1, 0)), None, None, tags(o), summed(one(o, 8)).tolist(), None
        for raw in g.get(4, []):
            o = message(raw)
            kinds, roles = packed(one(o, 10)).tolist(), packed(one(o, 8)).tolist()
            members = [{"kind": KINDS[k], "id": i, "role": words[r]} for k, i, r in zip(kinds, summed(one(o, 9)).tolist(), roles)]
            yield "relation", signed(one(o, 1, 0)), None, None, tags(o), None, members


def unpacked(blob: bytes) -> bytes:
    m = message(blob)
    if 1 in m:
        return one(m, 1)
    if 3 in m:
        return zlib.decompress(one(m, 3))
    raise ValueError("a block is neither plain nor packed with zlib")


def opened(path: str):
    """A file that can be read from any place, on a local disk or in a store that Arrow knows."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        return store.open_input_file(inner)
    return open(path, "rb")


def heads(path: str) -> Iterator[tuple[str, int, int]]:
    """(type, offset, bytes) of each block's body; bodies are passed over."""
    with opened(path) as f:
        f.seek(0, 2)
        end, at = f.tell(), 0
        while at < end:
            f.seek(at)
            start = f.read(4)
            n = struct.unpack(">I", start)[0] if len(start) == 4 else -1
            head = message(f.read(n)) if 0 <= n <= 65536 else {}
            size = one(head, 3, -1)
            if size < 0 or at + 4 + n + size > end:
                raise ValueError(f"{path}: the block at byte {at} is cut off or damaged")
            yield one(head, 1).decode(), at + 4 + n, size
            at += 4 + n + size


@dataclass
class Run(InputPartition):
    path: str
    blocks: list[tuple[int, int]]


class ExtractReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.run_bytes = int(options.get("runBytes", RUN_BYTES))

    def partitions(self) -> list[Run]:
        out = []
        for path in self.paths:
            run, held = [], 0
            for kind, at, size in heads(path):
                if kind != "OSMData":
                    continue
                if run and held + size > self.run_bytes:
                    out.append(Run(path, run))
                    run, held = [], 0
                run, held = [*run, (at, size)], held + size
            if run:
                out.append(Run(path, run))
        return out or [Run("", [])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        with opened(partition.path) as f:
            for at, size in partition.blocks:
                f.seek(at)
                rows = list(objects(unpacked(f.read(size))))
                if rows:
                    kind, ids, lat, lon, tags, refs, members = map(list, zip(*rows))
                    columns = [
                        pa.array(kind), pa.array(ids, pa.int64()), pa.array(lat, pa.float64()), pa.array(lon, pa.float64()), pa.array([list(dict(t).items()) for t in tags], pa.map_(pa.string(), pa.string())),
                        pa.array(refs, pa.list_(pa.int64())), pa.array(members, pa.list_(pa.struct([("kind", pa.string()), ("id", pa.int64()), ("role", pa.string())]))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "id", "lat", "lon", "tags", "refs", "members"])


class ExtractSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExtractReader:
        return ExtractReader(self.options)


def read_extract(spark: SparkSession, *paths: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Objects of some extracts: kind, id, lat, lon (nodes), tags, refs (ways), members (relations). Driver and executors
    must reach the paths. A partition holds blocks of about `run_bytes`; a tag that stands twice has its last value."""
    spark.dataSource.register(ExtractSource)
    return spark.read.format("map_extract").option("path", ",".join(paths)).option("runBytes", run_bytes).load()


def prefiltered(found: DataFrame, keys: list[str]) -> DataFrame:
    """The objects with one of the tags, the members of such relations, and all nodes and ways that these refer to:
    the columns of `found` and `own`, whether the object itself has one of the tags. Relations within relations are kept
    one level down. What is referred to but is not in the extract is left out."""
    own = F.exists(F.map_keys("tags"), lambda k: k.isin(*keys)) if keys else F.lit(False)
    tagged = found.select("kind", "id", "refs", "members").filter(own)
    members = tagged.select(F.inline("members")).select("kind", "id")
    first = tagged.select("kind", "id").union(members).distinct()
    ways = found.filter("kind = 'way'").join(first.filter("kind = 'way'").select("id"), "id", "left_semi")
    nodes = ways.select(F.lit("node").alias("kind"), F.explode("refs").alias("id"))
    wanted = first.union(nodes).distinct()
    return found.join(wanted, ["kind", "id"], "left_semi").withColumn("own", F.coalesce(own, F.lit(False))).select(*found.columns, "own")
