"""Exact removal of repeated byte strings with range-partitioned, locally sorted suffixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier (smaller doc_id, or the same
document further left). Sorting the suffixes at every byte would move a hundred times the corpus, so suffixes are
thinned without loss: of the k-grams in a window of LENGTH bytes the one with the least hash (the leftmost of
equals) is its anchor. Equal windows have equal anchors at equal places, and one anchor serves a run of windows; only
the suffixes at anchors are sorted.

1. Anchors whose gram occurs once in the corpus cannot lie in a repeated window and end here: grams are dealt by hash
   and counted. Repeats inside a batch of documents are told apart before the shuffle.
2. The other suffixes (from the anchor on, with the bytes that its windows have before it) go to buckets by ranges of
   their eight leading bytes, with splitters from a sample; equal ones in a batch send one. Where one lead takes
   several splitters, its suffixes are spread over as many buckets.
3. A bucket collapses equal byte strings and sorts its suffixes in byte order by multikey sort (eight bytes at a time,
   only ties go on). Suffixes that agree in a whole gram lie together; their windows are sorted the same way, and every
   one that is not the first of its equals is named.
4. Across boundaries: of a lead that several buckets share, each hands on the windows that are the first here, a row each
   with 128 bits of hash; these are dealt by hash, so that a lead of any size is spread over all tasks, and of equal ones
   (at most one a bucket) all but the first are named.
5. The named windows return to their documents, are united, and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, flat, mix64, partitions, slices

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
NULL_ID = -(1 << 63)
SAMPLED = 2000  # documents, at most about so many, for the splitters
TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
STEP = [U64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
BLOCK = 1 << 16
BUCKET = 1 << 26  # bytes of text to a bucket, at most about so many
AT_ONCE = 2_000_000  # windows that are compared at once
LOW = U64((1 << 20) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes that begin at each place."""
    h, n = TABLE[data], 1
    for step in STEP:
        h = h[:-n] * step + h[n:]
        n *= 2
    return h ^ (h >> U64(31))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of LENGTH bytes: the place of its anchor, and the anchor's hash. Worked off in blocks."""
    n = len(data) - LENGTH + 1
    place, name = np.empty(max(n, 0), np.int64), np.empty(max(n, 0), U64)
    for b in range(0, n, BLOCK):
        e = min(n, b + BLOCK)
        h = _grams(data[b : e + LENGTH - 1])
        v = (h & ~LOW) | np.arange(len(h), dtype=U64)  # at equal hashes the leftmost is the least
        w = 1
        while 2 * w <= WINDOW:
            v = np.minimum(v[:-w], v[w:])
            w *= 2
        v = np.minimum(v[: e - b], v[WINDOW - w : WINDOW - w + e - b])
        at = (v & LOW).astype(np.int64)
        place[b:e], name[b:e] = at + b, h[at]
    return place, name


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, from the joined bytes of texts that begin at `at`:
    text number, first and last window, anchor (counted in the joined bytes), anchor's hash."""
    place, name = anchors(data)
    n = len(place)
    if not n:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    valid = np.arange(n) + LENGTH <= at[own + 1]
    first = valid.copy()
    first[1:] &= (place[1:] != place[:-1]) | (own[1:] != own[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return own[lo], lo, hi, place[lo], name[lo]


def _key(docs: DataFrame) -> DataFrame:
    """A row's key: doc_id (null before all) and the hash of its text. Rows that agree in both are one document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text", 4_000_000):
            data, at = flat(b.column("text"))
            own, lo, _, p, h = runs(data, at)
            _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            is_first = np.zeros(len(h), bool)
            is_first[first] = True
            route = np.where(is_first, h, mix64(_longs(b, "id").astype(U64) + U64(1))[own])  # those need no neighbour
            yield _batch(route=route.view(np.int64), id=_longs(b, "id")[own], th=_longs(b, "th")[own], p=(p - at[own]).astype(np.int32), sure=count[inverse] > 1)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by route: those that are sure, and those whose neighbour has the same route."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        route = _longs(b, "route")
        same = route[1:] == route[:-1]
        keep = _longs(b, "sure").copy()
        keep[1:] |= same
        keep[:-1] |= same
        last = b.num_rows - 1  # the last row waits for its next neighbour
        rows = b.filter(pa.array(keep[:last].tolist() + [False]) if last else pa.array([False]))
        if rows.num_rows:
            yield rows.select(["id", "th", "p"])
        held = b.slice(last)
        if keep[last]:
            held = _batch(**{c: held.column(c) for c in ("route", "id", "th", "p")}, sure=pa.array([True]))
    if held is not None and held.column("sure")[0].as_py():
        yield held.select(["id", "th", "p"])


def big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; numbers compare like the bytes."""
    raw = np.ascontiguousarray(data)
    return np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,)).astype(U64) if len(raw) > 7 else np.empty(0, U64)


def _leads(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight leading bytes of the suffix at each place, as signed longs in the same order."""
    raw = np.ascontiguousarray(data)
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,)) if len(raw) > 7 else np.empty(0, ">u8")
    return (words[places].astype(U64) ^ U64(1 << 63)).view(np.int64)


def dealt(lead: np.ndarray, salt: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The bucket of each suffix by its lead, given the sorted splitters. A lead that takes several of them goes to the
    buckets between, by its salt; buckets are in the order of leads in any case."""
    low, high = np.searchsorted(cut, lead, side="left"), np.searchsorted(cut, lead, side="right")
    spread = np.maximum(1, high - low)
    return np.where(spread > 1, high - (salt % spread.astype(U64)).astype(np.int64), high).astype(np.int32)


def _sampled_leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            data, at = flat(b.column("text"))
            yield _batch(lead=_leads(data, runs(data, at)[3]))


def _joined(found: list[tuple]) -> list[tuple]:
    """Adjoining runs of windows of a document made one: (id, th, first window, windows after it, place)."""
    out: list[tuple] = []
    for r in sorted(found):
        if out and out[-1][:2] == r[:2] and r[2] <= out[-1][2] + out[-1][3] + 1:
            out[-1] = (*out[-1][:3], max(out[-1][3], r[2] + r[3] - out[-1][2]), out[-1][4])
        else:
            out.append(r)
    return out


def _segments(splitters: list[int]):
    cut = np.array(splitters, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 4_000_000):
                data, at = flat(b.column("text"))
                own, lo, hi, p, h = runs(data, at)
                marks = b.column("p")
                values, offsets = marks.values.to_numpy(zero_copy_only=False), marks.offsets.to_numpy()
                n = np.diff(offsets) * marks.is_valid().to_numpy(zero_copy_only=False)
                wanted = np.concatenate([np.empty(0, np.int64), *(values[o : o + k] + a for o, k, a in zip(offsets, n, at) if k)])
                mine = np.flatnonzero(np.isin(p, wanted))
                ids, ths = _longs(b, "id"), _longs(b, "th")
                raw = data.tobytes()
                best: dict[bytes, tuple] = {}
                sure = []
                for i, o, x, y in zip(mine.tolist(), own[mine].tolist(), lo[mine].tolist(), hi[mine].tolist()):
                    s = raw[x : y + LENGTH]
                    me = (int(ids[o]), int(ths[o]), x - int(at[o]), y - x, i)
                    other = best.setdefault(s, me)
                    if other is not me:
                        if me[:3] < other[:3]:
                            best[s], me = me, other
                        if me[:3] != best[s][:3]:
                            sure.append(me)
                rows = [*best.values(), *_joined(sure)]
                if not rows:
                    continue
                i = np.array([r[4] for r in rows])
                k = len(best)
                salt = mix64(np.array([r[0] for r in rows], np.int64).view(U64) ^ mix64(i.astype(U64)))
                bucket = dealt(_leads(data, p[i]), salt, cut)
                bucket[k:] = (salt[k:] % U64(len(cut) + 1)).astype(np.int32)
                yield _batch(
                    bucket=bucket, id=pa.array([r[0] for r in rows], pa.int64()), th=pa.array([r[1] for r in rows], pa.int64()),
                    lo=pa.array([r[2] for r in rows], pa.int32()), more=pa.array([r[3] for r in rows], pa.int32()), anchor=(p[i] - lo[i]).astype(np.int32),
                    s=pa.array([*best, *[None] * (len(rows) - k)], pa.binary()),
                )

    return run


def multikey_sort(words: np.ndarray, start: np.ndarray, cls: np.ndarray, depth: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Strings that begin at `start`, given the word at each place: (indices, class) of those that equal another of the
    same class in all words at `depth`, in the order of their bytes. Each step sorts by one word, as it parts every class
    into the strings below, at and above each of its values; only ties go on to the next."""
    at = np.arange(len(start))
    for d in depth:
        key = words[start[at] + d]
        order = np.lexsort((key, cls))
        at, cls, key = at[order], cls[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = (cls[1:] != cls[:-1]) | (key[1:] != key[:-1])
        cls = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        at, cls = at[~alone], cls[~alone]
    return at, cls


class Bucket:
    """Suffixes of one bucket as columns; rows (id, th, lo, more, anchor, s), equal strings collapsed on the way in."""

    def __init__(self):
        self.best: dict[tuple, tuple] = {}
        self.removed: tuple[list, list, list, list] = ([], [], [], [])
        self.marked: list[np.ndarray] = []  # windows that are not the first here: 128 times their row's number, plus their own

    def remove(self, *run: int) -> None:
        for column, x in zip(self.removed, run):
            column.append(x)

    def add(self, r: tuple) -> None:
        other = self.best.setdefault((r[4], r[5]), r)
        if other is not r:
            if r[:3] < other[:3]:
                self.best[r[4], r[5]], r = r, other
            if r[:3] != self.best[r[4], r[5]][:3]:
                self.remove(r[0], r[1], r[2], r[2] + r[3])

    def compare(self) -> None:
        """Sorts the suffixes and names their windows that are not the first of their equals."""
        rows = list(self.best.values())
        if not rows:
            return
        buffer = np.frombuffer(b"".join(r[5] for r in rows) + bytes(8), np.uint8)
        words = big_endian(buffer)
        begin = np.cumsum([0, *(len(r[5]) for r in rows)])[:-1]
        anchor, windows = np.array([r[4] for r in rows]), np.array([r[3] + 1 for r in rows])
        # suffixes from the anchor on, in byte order; those that agree in a gram are one class
        at, group = multikey_sort(words, begin + anchor, np.zeros(len(rows), np.int64), list(range(0, GRAM, 8)))
        if len(at):
            load = np.cumsum(windows[at])
            part = load // AT_ONCE  # whole classes, about so many windows at once
            ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(at))
            last = 0
            for e in ends.tolist():
                if e == len(at) or part[e] != part[last]:
                    self._windows(rows, at[last:e], group[last:e], words, begin, anchor, windows)
                    last = e

    def _windows(self, rows, some, group, words, begin, anchor, windows) -> None:
        n = windows[some]
        which = np.repeat(np.arange(len(some)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        gap = anchor[some][which] - step  # from the window's start to its anchor: equal windows agree in it
        depth = [*range(0, LENGTH - 7, 8), LENGTH - 8]
        ids, ths, los = (np.array([rows[i][c] for i in some.tolist()], np.int64) for c in (0, 1, 2))
        marked = np.zeros(len(which), bool)
        for part in [np.arange(len(which))] if len(which) <= 2 * AT_ONCE else [np.flatnonzero(gap == g) for g in np.unique(gap)]:
            at, cls = multikey_sort(words, (begin[some][which] + step)[part], (group[which] * LENGTH + gap)[part], depth)
            at = part[at]
            w, s = which[at], los[which[at]] + step[at]
            order = np.lexsort((s, ths[w], ids[w], cls))
            at, cls, w, s = at[order], cls[order], w[order], s[order]
            head = np.ones(len(at), bool)
            head[1:] = cls[1:] != cls[:-1]
            first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            marked[at[(ids[w] != ids[w[first]]) | (ths[w] != ths[w[first]]) | (s != s[first])]] = True
        begins = marked.copy()
        begins[1:] &= ~(marked[:-1] & (which[1:] == which[:-1]))
        ends = marked.copy()
        ends[:-1] &= ~(marked[1:] & (which[1:] == which[:-1]))
        for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist()):
            w = which[a]
            self.remove(int(ids[w]), int(ths[w]), int(los[w] + step[a]), int(los[w] + step[b]))
        self.marked.append(some[which[marked]] * 128 + step[marked])

    def named(self) -> dict:
        i, t, a, b = self.removed
        return dict(id=pa.array(i, pa.int64()), th=pa.array(t, pa.int64()), first=pa.array(a, pa.int32()), last=pa.array(b, pa.int32()))


RUN = "id long, th long, first int, last int"
EDGE = "w1 long, w2 long, id long, th long, first int, last int"


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[Bucket, list[pa.RecordBatch]]:
    """A bucket's rows, and the runs that were decided in their batch."""
    bucket, sure = Bucket(), []
    for b in batches:
        done = b.filter(b.column("s").is_null())
        if done.num_rows:
            lo, more = _longs(done, "lo"), _longs(done, "more")
            sure.append(_batch(id=done.column("id"), th=done.column("th"), first=lo.astype(np.int32), last=(lo + more).astype(np.int32)))
        b = b.filter(b.column("s").is_valid())
        for r in zip(*(b.column(c).to_pylist() for c in ("id", "th", "lo", "more", "anchor", "s"))):
            bucket.add(r)
    return bucket, sure


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, sure = _read(batches)
    bucket.compare()
    yield from [*sure, _batch(**bucket.named())]


def window_hashes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the LENGTH bytes at each place, given the word at each place."""
    a, b = np.full(len(at), 1, U64), np.full(len(at), 2, U64)
    for d in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        w = words[at + d]
        a, b = mix64((a ^ w) * STEP[0]), mix64((b + w) * STEP[2] ^ U64(d + 1))
    return a.view(np.int64), b.view(np.int64)


def _sorted_with_edges(shared: list[int]):
    """The same, and of the leads that several buckets share the windows that are the first here."""
    leads = np.array(sorted(set(shared)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sure = _read(batches)
        bucket.compare()
        for b in [*sure, _batch(**bucket.named())]:
            n = b.num_rows
            if n:
                route = mix64(_longs(b, "id").view(U64)).view(np.int64)
                yield _batch(w1=route, w2=pa.nulls(n, pa.int64()), id=b.column("id"), th=b.column("th"), first=b.column("first"), last=b.column("last"))
        rows = list(bucket.best.values())
        lead = np.array([int.from_bytes(r[5][r[4] : r[4] + 8], "big") - (1 << 63) for r in rows], np.int64)
        keep = np.flatnonzero(np.isin(lead, leads)).tolist()
        known = np.sort(np.concatenate([np.empty(0, np.int64), *bucket.marked]))
        for k in range(0, len(keep), 20_000):
            some = keep[k : k + 20_000]
            words = big_endian(np.frombuffer(b"".join(rows[i][5] for i in some) + bytes(8), np.uint8))
            begin = np.cumsum([0, *(len(rows[i][5]) for i in some)])[:-1]
            n = np.array([rows[i][3] + 1 for i in some])
            which = np.repeat(np.arange(len(some)), n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            new = ~np.isin(np.array(some)[which] * 128 + step, known)
            which, step = which[new], step[new]
            w1, w2 = window_hashes(words, begin[which] + step)
            ids, ths, los = (np.array([rows[i][c] for i in some], np.int64) for c in (0, 1, 2))
            at = (los[which] + step).astype(np.int32)
            yield _batch(w1=w1, w2=w2, id=ids[which], th=ths[which], first=at, last=at)

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes runs on; of the windows, sorted by their hashes and then their place, all but the first of equals."""
    held = None
    for b in batches:
        runs = b.filter(b.column("w2").is_null())
        if runs.num_rows:
            yield runs.select(["id", "th", "first", "last"])
        b = b.filter(b.column("w2").is_valid())
        if not b.num_rows:
            continue
        w1, w2, ids, ths, at = (_longs(b, c) for c in ("w1", "w2", "id", "th", "first"))
        again = np.zeros(len(w1), bool)
        again[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
        again[0] = held is not None and held[:2] == (w1[0], w2[0])
        head = np.maximum.accumulate(np.where(again, -1, np.arange(len(w1))))
        f = np.maximum(head, 0)
        first = [np.where(head < 0, held[2 + i] if held else 0, c[f]) for i, c in enumerate((ids, ths, at))]
        same = (first[0] == ids) & (first[1] == ths) & (first[2] == at)  # a row that came twice
        rows = b.filter(pa.array(again & ~same))
        if rows.num_rows:
            yield rows.select(["id", "th", "first", "last"])
        held = (w1[-1], w2[-1], *(x[-1] for x in first))


def _unite(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of bytes from runs of windows."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    return a[new], b[np.append(new[1:], True)]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text", 4_000_000):
            data, at = flat(b.column("text"))
            found = b.column("runs")
            inner, offsets = found.values, found.offsets.to_numpy()
            first, last = (inner.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            valid = found.is_valid().to_numpy(zero_copy_only=False)
            raw = data.tobytes()
            kept, removed, spans = [], [], []
            for i, (x, y) in enumerate(zip(at.tolist(), at[1:].tolist())):
                text = raw[x:y]
                if valid[i] and offsets[i + 1] > offsets[i]:
                    a, e = _unite(first[offsets[i] : offsets[i + 1]], last[offsets[i] : offsets[i + 1]])
                    text = b"".join(text[m:n] for m, n in zip([0, *e.tolist()], [*a.tolist(), y - x]))
                    spans.append(list(zip(a.tolist(), e.tolist())))
                else:
                    spans.append([])
                kept.append(text)
                removed.append(y - x - len(text))
            yield _batch(
                id=b.column("id"), n_bytes=np.diff(at).astype(np.int64), n_removed=pa.array(removed, pa.int64()),
                spans=pa.array([[{"from": m, "to": n} for m, n in s] for s in spans], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), kept=pa.array(kept, pa.binary()),
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_removed, spans array<struct<from, to>> (byte offsets removed), kept binary.

    A row for each row of docs. Null text counts as empty. A null doc_id comes before all others. Rows that share a
    doc_id are ordered by the hash of their text; rows that agree in doc_id and text are one document and get the
    same result. An empty table gives none; other columns are not read. Remaining bytes may not be valid UTF-8."""
    spark = docs.sparkSession
    n = partitions(spark)
    d = _key(docs)
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    lead = d.sample(fraction=min(1.0, SAMPLED / max(rows, 1)), seed=3).select("text").mapInArrow(_sampled_leads, "lead long")
    buckets = max(2 * n, -(-size // BUCKET))
    marks = sorted(lead.agg(F.percentile_approx("lead", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or [])
    shared = [a for a, b in zip(marks, marks[1:]) if a == b]
    found = d.mapInArrow(_anchor_rows, "route long, id long, th long, p int, sure boolean").repartition(n, "route").sortWithinPartitions("route")
    marked = found.mapInArrow(_repeated, "id long, th long, p int").groupBy("id", "th").agg(F.collect_list("p").alias("p"))
    segments = d.join(marked, ["id", "th"], "left").select("id", "th", "text", "p").mapInArrow(
        _segments(marks), "bucket int, id long, th long, lo int, more int, anchor int, s binary"
    )
    segments = segments.repartitionById(len(marks) + 1, F.col("bucket"))
    if shared:
        edges = segments.mapInArrow(_sorted_with_edges(shared), EDGE).repartition(n, "w1").sortWithinPartitions("w1", "w2", "id", "th", "first")
        named = edges.mapInArrow(_across, RUN)
    else:
        named = segments.mapInArrow(_sorted_buckets, RUN)
    named = named.groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    out = d.join(named, ["id", "th"], "left").select("id", "th", "text", "runs").mapInArrow(
        _cut_out, "id long, n_bytes long, n_removed long, spans array<struct<`from`: bigint, `to`: bigint>>, kept binary"
    )
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def op3_suffixes(spark, sf_dir: str) -> DataFrame:
    r = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
