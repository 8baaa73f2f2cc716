"""Token ids in files of length-delimited binary records, with an offset index for reads in any order.

A file is a run of records. A record is

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32 of the length's bytes
    payload  1 byte: 1 with a document id, 0 without; 8 bytes: the id, signed; 1 byte: width of a token id, 2 or 4; the ids
    check    4 bytes: masked CRC-32 of the payload
    end      1 byte: a line feed

so that a reader who stands at a record knows its end before he reads it, and sees torn or altered bytes in the length as
well as in the payload. A check is masked (turned by 15 bits, plus a constant), as a CRC over data that holds its own
CRC says little. Ids take two bytes where the vocabulary allows it.

Documents are dealt out by ranges of doc_id, sorted, encoded where they lie and written by Spark's own committed writer,
a file a range: files in the order of their numbers hold the documents in ascending order, a lost executor's files are
written again, and any file system that Spark knows will do. The index (part, offset, length, doc_id, n_tokens, start)
is built from the files themselves.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat, new_folder, partitions, release, slices, stash, text_batches

END_ID = 0
FILE_BYTES = 48_000_000  # of text to a file, about
SLICE = 2_000_000  # bytes of text that are encoded at once
WORDS, LONGEST = 300_000, 64  # entries of a generation of a worker's table; characters of a word that is kept
HEAD, BODY = struct.Struct("<QI"), struct.Struct("<BqB")
FRAME = HEAD.size + 5  # bytes of a record besides its payload
PLAIN = "A-Za-zÀ-ÖØ-öø-ÿ"
CUT = re.compile(r" (?=\S)")  # a blank before a character that is none begins a word of the byte-level pattern
EASY = re.compile(f"[ \\n0-9!-/:-@\\[-`{{-~{PLAIN}]*")  # of these characters, letters, digits and white space are told apart alike everywhere
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{PLAIN}]+| ?[0-9]+| ?[^\\s0-9{PLAIN}]+|\\s+(?!\\S)|\\s+")
# The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on in order.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: b if b in PRINTED else 256 + i - sum(p < b for p in PRINTED) for i, b in enumerate(range(256))}
BLANK = chr(ALPHABET[32])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def record(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record; ids are little-endian numbers of `width` bytes."""
    body = BODY.pack(doc_id is not None, doc_id or 0, width) + ids
    n = struct.pack("<Q", len(body))
    return b"".join((n, struct.pack("<I", masked(n)), body, struct.pack("<I", masked(body)), b"\n"))


def records(data: bytes, verify: bool = True) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids as unsigned 32-bit numbers) of each record from the start of data on."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        n, check = HEAD.unpack_from(data, at)
        if check != masked(data[at : at + 8]):
            raise ValueError(f"length of the record at byte {at} is damaged")
        end = at + n + FRAME
        if end > len(data) or data[end - 1] != 10:
            raise ValueError(f"record at byte {at} is cut off")
        body = data[at + HEAD.size : end - 5]
        if verify and struct.unpack_from("<I", data, end - 5)[0] != masked(body):
            raise ValueError(f"record at byte {at} is damaged")
        known, doc_id, width = BODY.unpack_from(body)
        yield at, end - at, doc_id if known else None, np.frombuffer(body, f"<u{width}", offset=BODY.size).astype("<u4")
        at = end


class Table(dict):
    """What was worked out before, in two generations of `most` entries; keys of up to LONGEST characters are kept."""

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most, self.old = work, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.work(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Packed ids of texts by a byte-level BPE file of the tokenizers library, the same as its encode().

    Texts of plain characters are cut into the pattern's words at once; other texts before blanks, and their pieces of
    plain characters into words. Words that are known already are looked up; a new word is put to the library's model and
    a piece of other characters to the whole tokenizer. Texts that hold a special token, or all texts where the file is
    not plainly byte-level, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        pre, post = spec["pre_tokenizer"] or {}, spec["post_processor"] or {"type": "ByteLevel"}
        self.plain = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None and post["type"] == "ByteLevel"
        self.plain = self.plain and not spec["model"].get("dropout")
        self.special = [t["content"] for t in spec["added_tokens"]]
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if n <= 65536 else 4
        self.packed = [i.to_bytes(self.width, "little") for i in range(n)]
        self.forget()

    def forget(self) -> None:
        """Empties the table."""
        self.words = Table(self.word, WORDS)

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))

    def word(self, w: str) -> bytes:
        if w.isascii() and w.isprintable() and " " not in w[1:]:
            w = w.replace(" ", BLANK)
        elif EASY.fullmatch(w):
            w = w.encode().decode("latin-1").translate(ALPHABET)
        else:
            return self.whole(w)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(w)])

    def cut(self, text: str) -> list[str]:
        """The words of a text in order, and pieces that hold other characters."""
        if EASY.fullmatch(text):
            return SPLIT.findall(text)
        first, *rest = CUT.split(text)
        out = []
        for p in (first, *[" " + p for p in rest]):
            if EASY.fullmatch(p):
                out += SPLIT.findall(p)
            else:
                out.append(p)
        return out

    def encode(self, text: str) -> bytes:
        if not self.plain or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, self.cut(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file, with its table: most words of a task were met in the one before."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, folder: str, path: str, end: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """doc_id, text -> files of records in `folder`, with the id `end` after each text.

    Documents stand in ascending order of doc_id, null first, rows that share one in the order of a hash of their text;
    repeated rows are records of their own. A null text is empty: its record holds `end` only. Texts of any length are
    one record. Other columns are not read; an empty table gives no records."""
    spark = docs.sparkSession
    text_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        last = end.to_bytes(e.width, "little")
        try:
            for whole in batches:
                for b in slices(whole, "text", SLICE):
                    texts = (t or "" for t in b.column("text").to_pylist())
                    rows = [record(i, e.encode(t) + last, e.width) for i, t in zip(b.column("doc_id").to_pylist(), texts)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])
        finally:
            e = whole = b = texts = rows = None  # the table stays for the worker's next task
            release()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // file_bytes))
    tie = F.xxhash64("text")  # parts the rows of one doc_id as well
    d = d.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    rows = d.mapInArrow(run, "record binary")
    # the writer ends each record by its line feed and takes the bytes before as they are
    rows.select(F.expr("substring(record, 1, octet_length(record) - 1)").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """part, content: the files of a folder by number."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return found.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("part"), "content")


def _walk(ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, content in zip(b.column("part").to_pylist(), b.column("content")):
                held, before = [], 0
                for at, n, doc_id, tokens in records(content.as_py(), verify=ids):
                    held.append((part, at, n, doc_id, len(tokens), before, tokens.tobytes() if ids else None))
                    before += len(tokens)
                    if len(held) == 1000:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    return run


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["part", "offset", "length", "doc_id", "n_tokens", "before", "ids"])


SEEN = "part int, offset long, length long, doc_id long, n_tokens long, before long, ids binary"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """part, offset, doc_id, n_tokens, ids (little-endian unsigned 32-bit): every record, lengths and checks verified."""
    return files(spark, folder).mapInArrow(_walk(True), SEEN).select("part", "offset", "doc_id", "n_tokens", "ids")


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """part, offset, length, doc_id, n_tokens, start (ids of all records before), from the records' heads."""
    heads = stash(files(spark, folder).mapInArrow(_walk(False), SEEN).drop("ids"), "record-heads")
    # a row a file
    base = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = base.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return heads.join(base, "part").select("part", "offset", "length", "doc_id", "n_tokens", (F.col("base") + F.col("before")).alias("start"))


def read_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records that `wanted` (rows of an index, with any further columns) names: its columns and `ids`.

    A file is read once, whatever is wanted of it, and of its bytes only the records named are checked and unpacked."""
    extra = [c for c in wanted.columns if c not in ("part", "offset", "length")]
    by_file = wanted.groupBy("part").agg(F.collect_list(F.struct("offset", "length", *extra)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, rows in zip(b.column("content"), b.column("rows")):
                data, named = content.as_buffer(), rows.values
                for k in range(0, len(named), 1000):
                    some = named.slice(k, 1000)
                    ids = []
                    for at, n in zip(some.field("offset").to_pylist(), some.field("length").to_pylist()):
                        [(_, _, _, tokens)] = records(data.slice(at, n).to_pybytes())
                        ids.append(tokens.tobytes())
                    yield pa.RecordBatch.from_arrays([some.field("offset"), some.field("length"), *[some.field(c) for c in extra], pa.array(ids, pa.binary())], ["offset", "length", *extra, "ids"])

    kinds = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in extra)
    return files(spark, folder).join(by_file, "part").select("content", "rows").mapInArrow(run, f"offset long, length long, {kinds + ', ' if kinds else ''}ids binary")


def read_shuffled(spark: SparkSession, folder: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """place, doc_id, n_tokens, ids: all records in the order of a seeded hash of where they stand, dealt by ranges of it."""
    wanted = index.select("part", "offset", "length", F.xxhash64(F.lit(seed), "part", "offset").alias("place"), "doc_id", "n_tokens")
    out = read_at(spark, folder, wanted).select("place", "doc_id", "n_tokens", "ids")
    return out.repartitionByRange(partitions(spark), "place").sortWithinPartitions("place")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, vocabulary())
    index = stash(build_index(spark, folder), "token-index")
    seen = read_records(spark, folder).select("part", "offset", F.crc32("ids").alias("ids_crc32"))
    return seen.join(index, ["part", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")
