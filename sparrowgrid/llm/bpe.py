"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes of a text cuts it into chunks, anywhere between two code points, so the same passage
is cut alike in every document, whatever stands before it. A worker encodes a chunk once and keeps it in a bounded
table: its inside (between two blanks that the tokenizer never joins to what precedes them), and what hangs over at
both ends. At each join the two overhangs, which were encoded by themselves, are encoded again as one; where that
disagrees with what they gave apart (a word was cut in two), the join is repaired by the new ids. A chunk without such
a blank has no inside and only widens the join, up to the next chunk that has one. Inside a new chunk, words that are
known already are not encoded again. Nothing is shuffled and the tables are bounded by bytes, not by the corpus.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, flat, mix64, release, slices, text_batches

CHUNK = 512  # bytes, on average
WINDOW = 16  # bytes of the rolling hash
CHUNK_TABLE = 1_000_000  # characters of text in one generation of the chunk table
WORD_TABLE = 40_000  # words in one generation of the word table
SLICE = 1_000_000  # bytes of text that a worker takes at once
TAILS = ".,!?;:"
BYTES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
Found = tuple[bytes, str]  # packed ids, decoded text


def cuts(data: np.ndarray, every: int = CHUNK) -> np.ndarray:
    """Offsets of content-defined chunk starts in the bytes: code points before which the hash of WINDOW bytes is 0
    modulo `every`."""
    if len(data) <= WINDOW:
        return np.empty(0, np.int64)
    h, n = BYTES[data], 1
    while n < WINDOW:
        h = h[:-n] * U64(pow(0x100000001B3, n, 1 << 64)) + h[n:]
        n *= 2
    at = np.flatnonzero((h[:-1] ^ (h[:-1] >> U64(29))) % U64(every) == 0) + WINDOW
    return at[(data[at] & 0xC0) != 0x80]


class Encoder:
    """Encodes and decodes with one tokenizer file; keeps two generations of chunks and of words.

    Ids are kept packed (little-endian, 32 bits) and decoded text beside them, so that a chunk is put together by two
    joins over its words and a text by two joins over its chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = [vocabulary.get(i, "") for i in range(max(vocabulary) + 1)]
        self.ends = np.array([t.endswith("</w>") for t in self.names])
        self.joined = self._tokens_are_joined()
        self.split_safe = self._words_are_apart()
        safe = "".join(filter(self._parts_before, " \n"))
        self.parting = re.compile(f"(?<=\\S)[{safe}](?=\\S)") if safe else None
        self.joins = self.repaired = self.asked = self.reused = 0  # joins, those that disagreed; characters, those from a known chunk
        self.letters_apart = False
        self.clear()
        self.letters_apart = self._letters_are_apart()

    def clear(self) -> None:
        """Empties the tables."""
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self._enter(list(TAILS), list(map(self.plain, TAILS)))
        self.old_ids: dict[str, bytes] = {}
        self.old_text: dict[str, str] = {}
        self.chunks: dict[str, tuple[str, bytes, Found | None, str, bytes]] = {}
        self.old_chunks: dict[str, tuple[str, bytes, Found | None, str, bytes]] = {}
        self.held = 0

    def _words_are_apart(self) -> bool:
        """Whether text between blanks can be encoded by itself: blanks separate words and leave no token."""
        probe = ["a", "b1", "don't", "x,y", "é", "A.B", "!!"]
        ids = [self.plain(p) for p in probe]
        return all(self.plain(a + s + b) == x + y for a, x in zip(probe, ids) for b, y in zip(probe, ids) for s in (" ", "\n", "  \n"))

    def _parts_before(self, blank: str) -> bool:
        """Whether a text may always be cut before this blank, if it stands alone."""
        ends, starts = ("a", "word", "7", "don't", "x,", "!!", "é", ")"), ("a", "word", "7", "'s", ".", "!!", "É", "(", "\u0301")
        return all(self.plain(a + blank + b) == self.plain(a) + self.plain(blank + b) for a in ends for b in starts)

    def _tokens_are_joined(self) -> bool:
        """Whether decoding joins the tokens with blanks (no decoder in the file)."""
        ids = self.plain("Words, 12 of them: don't \u00e9t\u00e9 <|endoftext|>")
        return self.tokenizer.decoder is None and self.tokenizer.decode(ids, skip_special_tokens=False) == self._named(ids)

    def _named(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids])

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters_are_apart(self) -> bool:
        """Whether a run of letters is a piece of its own, ends in a marked token, and ignores the case of ASCII."""
        if not (self.split_safe and self.joined):
            return False
        same = all(self.plain(a.upper() + t) == self.plain(a) + self.plain(t) for a in ("a", "word", "xylophones") for t in TAILS)
        one = all(sum(self.ends[self.plain(a)]) == 1 and self.ends[self.plain(a)[-1]] for a in ("a", "word", "xylophones", "été"))
        return same and one

    def _enter(self, words: list[str], found: list[list[int]]) -> None:
        for w, f in zip(words, found):
            self.ids[w] = struct.pack(f"<{len(f)}I", *f)
            self.text[w] = self._named(f) if self.joined else ""

    def _letters(self, words: list[str]) -> None:
        """Words of letters only, many to a string: the tokens that end a piece part them again. A string whose pieces
        are not as many as its words (odd lower-case forms) is encoded word by word."""
        parts = [words[i : i + 200] for i in range(0, len(words), 200)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(list(map(" ".join, parts)), add_special_tokens=False)):
            found = e.ids
            stops = (np.flatnonzero(self.ends[found]) + 1).tolist()
            if len(stops) == len(part):
                self._enter(part, [found[a:b] for a, b in zip([0, *stops], stops)])
            else:
                self._enter(part, [self.plain(w) for w in part])

    def _learn(self, words: list[str]) -> None:
        """Enters the words that the current table lacks, from the old one, from their letters, or by the tokenizer."""
        ids, text, missing = self.ids, self.text, []
        for w in dict.fromkeys(words):
            if w not in ids:
                old = self.old_ids.get(w)
                if old is None:
                    missing.append(w)
                else:
                    ids[w], text[w] = old, self.old_text[w]
        if self.letters_apart:
            stems, derived, others = {}, [], []
            for w in missing:
                stem, tail = (w[:-1], w[-1]) if w[-1] in TAILS else (w, "")
                if not (stem.isalpha() and stem.lower().isalpha()):  # some letters have a lower-case form with a mark
                    others.append(w)
                    continue
                key = stem.lower() if stem.isascii() else stem
                if key not in ids:
                    stems[key] = None
                if key != w:
                    derived.append((w, key, tail))
            self._letters(list(stems))
            for w, key, tail in derived:
                ids[w] = ids[key] + ids[tail] if tail else ids[key]
                text[w] = f"{text[key]} {text[tail]}" if tail else text[key]
            missing = others
        self._enter(missing, [e.ids for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)])

    def prepare(self, texts: list[list[str]]) -> None:
        """Learns the words of texts with a chunk that is not known yet, all at once: many words to a call."""
        if not self.split_safe or self.parting is None:
            return
        words: set[str] = set()
        for parts in texts:
            new = [p for p in parts if p not in self.chunks and p not in self.old_chunks]
            if new:
                words.update("".join(parts).replace("\n", " ").split(" "))
                for p in new:  # what a cut leaves of a word
                    p = p.replace("\n", " ")
                    words.add(p[: p.find(" ")] if " " in p else p)
                    words.add(p[p.rfind(" ") + 1 :])
        words.discard("")
        if len(self.ids) > WORD_TABLE:
            self._turn_over()
        self._learn(list(words))

    def _turn_over(self) -> None:
        self.old_ids, self.old_text, self.ids, self.text = self.ids, self.text, {}, {}
        self._enter(list(TAILS), list(map(self.plain, TAILS)))

    def whole(self, text: str) -> Found:
        """A text as one piece; by its words, where the tokenizer keeps them apart."""
        if not self.split_safe:
            found = self.plain(text)
            return struct.pack(f"<{len(found)}I", *found), self._named(found) if self.joined else ""
        words = list(filter(None, text.replace("\n", " ").split(" ")))
        try:
            ids = b"".join(map(self.ids.__getitem__, words))
        except KeyError:
            if len(self.ids) > 2 * WORD_TABLE:
                self._turn_over()
            self._learn(words)
            ids = b"".join(map(self.ids.__getitem__, words))
        return ids, " ".join(filter(None, map(self.text.__getitem__, words))) if self.joined else ""

    def _parted(self, text: str) -> tuple[str, bytes, Found | None, str, bytes]:
        """A chunk: what hangs over before its first parting blank, the inside, what hangs over from the last one."""
        first = self.parting.search(text)
        if not first:
            return text, self.whole(text)[0], None, "", b""
        a, b = first.start(), len(text) - 1
        while not self.parting.match(text, b):
            b -= 1
        return text[:a], self.whole(text[:a])[0], self.whole(text[a:b]), text[b:], self.whole(text[b:])[0]

    def chunk(self, text: str) -> tuple[str, bytes, Found | None, str, bytes]:
        found = self.chunks.get(text)
        self.asked += len(text)
        if found is None:
            found = self.old_chunks.get(text)
            if found is None:
                found = self._parted(text)
            else:
                self.reused += len(text)
            self.chunks[text] = found
            self.held += len(text)
            if self.held > CHUNK_TABLE:
                self.old_chunks, self.chunks, self.held = self.chunks, {}, 0
        else:
            self.reused += len(text)
        return found

    def _join(self, left: str, left_ids: bytes, right: str, right_ids: bytes) -> Found:
        """The overhangs of two chunks encoded as one, whatever they gave apart."""
        both = self.whole(left + right)
        self.joins += 1
        self.repaired += both[0] != left_ids + right_ids
        return both

    def encode(self, pieces: list[str]) -> Found:
        """Packed ids and decoded text of a text, from its chunks in order."""
        if self.parting is None:
            found = [self.whole("".join(pieces))]
        else:
            found, text, ids = [], "", b""
            for p in pieces:
                head, head_ids, inside, tail, tail_ids = self.chunk(p)
                if inside is None:
                    text, ids = text + head, ids + head_ids
                else:
                    found += [self._join(text, ids, head, head_ids), inside]
                    text, ids = tail, tail_ids
            found.append(self.whole(text))
        ids = b"".join([f[0] for f in found])
        if self.joined:
            return ids, " ".join([f[1] for f in found if f[1]])
        return ids, self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file. A task has one core, so the tokenizer starts no threads of its own;
    each thread would keep a heap beside the worker's. A setting that the user has made stays."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def dismiss(path: str) -> None:
    """Empties the tables of a worker's encoder; the tokenizer stays. A function of the module, as a function that is sent
    to workers has its own copy of the module's names."""
    if path in _encoders:
        _encoders[path].clear()
    release()


def pieces(data: np.ndarray, at: np.ndarray) -> Iterator[list[str]]:
    """The chunks of each text, from all bytes of some texts and their offsets."""
    raw = data.tobytes()
    for i, j in zip(at.tolist(), at[1:].tolist()):
        own = [i, *(cuts(data[i:j]) + i).tolist(), j]
        yield [raw[a:b].decode() for a, b in zip(own, own[1:]) if b > a]


def encode(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """doc_id, text -> doc_id, ids, decoded; a row for each row, null text like an empty one.

    `ids` is binary: the ids as little-endian unsigned 32-bit integers (token_ids() makes an array of them). `decoded`
    is decode(ids) of the tokenizer with special tokens kept. Repeated rows are encoded alike; an empty table gives
    none; other columns are not read. A text of any length is encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        try:
            for whole in batches:
                for b in slices(whole, "text", SLICE):
                    texts = list(pieces(*flat(b.column("text"))))
                    e.prepare(texts)
                    found = list(map(e.encode, texts))
                    packed = pa.array([ids for ids, _ in found], pa.binary())
                    text = pa.array([t if decode else None for _, t in found], pa.string())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), packed, text], ["doc_id", "ids", "decoded"])
        finally:
            e = whole = b = texts = found = packed = text = None  # an idle worker holds the tokenizer only
            dismiss(path)

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def token_ids(encoded: DataFrame) -> DataFrame:
    """Adds `tokens` array<long>, from the packed ids."""
    byte = lambda i, k: F.conv(F.hex(F.substring("ids", i * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
    n = F.octet_length("ids") / 4
    whole = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)
    return encoded.withColumn("tokens", F.when(n > 0, whole).otherwise(F.array().cast("array<long>")))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    e = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return e.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
