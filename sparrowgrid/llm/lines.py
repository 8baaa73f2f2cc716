"""Line dedup: a segment-partition edit join between lines. DataFrame functions only.

A line goes if an equal line stands earlier in the corpus (smaller doc_id, then line number), unless it is blank; a
line of at least `MIN_CHARS` code points also goes if one of that length within `EDITS` edits (insert, delete, replace)
stands earlier. Lines are judged on the input, not on what is left of it, so the result does not depend on any order
of work.

A line has EDITS + 1 segments of one width, which goes by its length in blocks of `BLOCK` code points; the first half of
them are counted from its start, the others from its end. Of two lines within EDITS edits, some segment i is intact with
i edits at most before it and EDITS - i at most after it (the first at which the edits so far are no more than the
segments), so the one line's segment stands in the other at a place that differs by no more than that. Each line is
indexed by its own segments and probes with the substrings at those places; a line at the start of a block does so for
the block before as well, as its partner may be that much shorter. Keys that two
different lines have in common are kept, their lines fetched, and pairs are tested: lengths and counts of twelve letters
first (bounds on the distance, inside the join), then the banded bit-parallel edit distance.

Only whether a line has an earlier neighbour matters. Every member of a key is first tested against the key's
earliest lines, which takes as many pairs as members; only lines that this leaves open meet the others. Where a key has
more than MANY members (copies of a line, lines that differ in their numbers only), these meet by all that two edits
leave: of COMBINED segments two hold the edits, and the others together are a key, with what lies between the two sought
one place to either side. Members of such a key that are still more than CROWD meet in the same way by the two segments
that are left of them, and so on; so a line meets at most CROWD others for each of its keys, however many copies there are.
(For more than two edits: of PIECES segments at most EDITS are hit, and a line is indexed by its rarest EDITS + 1.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, unstash

MIN_CHARS = 24
EDITS = 2
BLOCK = 8  # code points; lines whose lengths lie in one block have segments of one width
NULL_ID = -(1 << 63)
LETTERS = "etaonirshdlu"  # twelve frequent letters
BROADCAST_KEYS = 100_000  # keys of 8 bytes that may be sent to every executor
MANY = 64  # members of a key that meet one another as they are
COMBINED = 7  # segments of a line of which all but two are a key
CROWD = 256  # members of such a key that meet one another as they are
PIECES = 9  # finer segments of a line, for more than two edits
DIGITS = "0123456789.-"
HOT = 10_000  # a line with more than this part of all repeats is hot; there are fewer than that


def segment_keys(lines: DataFrame, edits: int = EDITS, pieces: int | None = None) -> DataFrame:
    """h1, h2, side, k from h1, h2, line, n: side 0 is indexed and probes, 1 only probes. With `pieces` that many segments
    in place of EDITS + 1, each sought at all places that the edits allow.

    Each line meets a constant list of windows (blocks back, segment, shift), and one small compiled expression works out
    the window's place."""
    reach = lambda i: min(i, edits - i) if pieces is None else edits
    count = pieces or edits + 1
    places = [(i, shift) for i in range(count) for shift in range(-reach(i), reach(i) + 1)]
    listed = lambda back: [f"struct({int(shift != 0 or k > 0)} AS side, {k} AS back, {i} AS i, {shift} AS shift)" for k in back for i, shift in places]
    backs = -(-edits // BLOCK)  # blocks that a partner may lie before this one's
    windows = F.expr(f"if(n % {BLOCK} < {edits % BLOCK or BLOCK}, array({', '.join(listed(range(backs + 1)))}), array({', '.join(listed(range(backs)))}))")
    d = lines.withColumn("x", F.explode(windows)).select("h1", "h2", "line", "n", "x.*")
    d = d.withColumn("w", F.expr(f"(cast(n / {BLOCK} AS int) - back) * {BLOCK}")).filter("w >= 0").withColumn("w", F.expr(f"cast(w / {count} AS int)"))
    d = d.withColumn("at", F.expr(f"if(2 * i < {count}, i * w, n - ({count} - i) * w) + shift")).filter("at >= 0 AND at + w <= n")
    return d.select("h1", "h2", "side", F.expr("xxhash64(w, i, substring(line, at + 1, w))").alias("k"))


def edit_distance_within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings lie within `edits` (at most 30) of each other, by bit-parallel steps in a band.

    a, b: arrays of code points. Bit 2 * edits - k of the words stands for the cell k rows above the lowest of the
    band; the band moves one row down with each code point of b. Until it reaches the end of a, the distance
    follows the band's lowest diagonal, then a's last row."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    long = lambda x: F.lit(x).cast("long")
    m, n = F.size(a), F.size(b)

    def step(s: Column, j: Column) -> Column:
        char = F.get(b, j - 1)
        match = long(0)
        for bit in range(width):
            at = j - edits + bit - 1
            match = match.bitwiseOR(F.when((at >= 0) & (F.get(a, at) == char), long(1 << bit)).otherwise(long(0)))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), match.alias("x"), j.alias("j"))

    def zero(s: Column) -> Column:
        vp, x = s["vp"], s["x"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(long(full))
        return F.struct(vp.alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), d0.alias("d0"), s["j"].alias("j"))

    def delta(s: Column) -> Column:
        hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"]))).bitwiseAND(long(full))
        return F.struct(s["d"].alias("d"), s["d0"].alias("d0"), hp.alias("hp"), s["d0"].bitwiseAND(s["vp"]).alias("hn"), s["j"].alias("j"))

    def close(s: Column) -> Column:
        half = F.shiftright(s["d0"], 1)
        vp = s["hn"].bitwiseOR(F.bitwise_not(half.bitwiseOR(s["hp"]))).bitwiseAND(long(full))
        top = long(1 << (width - 1))
        # the bit of a's last row, once the band hangs below it
        below = s["j"] + edits - m
        bit = F.when(below <= 0, top).otherwise(F.element_at(F.array(*[long(1 << max(0, width - 1 - k)) for k in range(1, width + 1)]), F.least(F.greatest(below, F.lit(1)), F.lit(width))))
        on = lambda w: w.bitwiseAND(bit) != 0
        d = F.when(below <= 0, s["d"] + F.when(on(s["d0"]), 0).otherwise(1)).otherwise(s["d"] + F.when(on(s["hp"]), 1).otherwise(0) - F.when(on(s["hn"]), 1).otherwise(0))
        return F.struct(vp.alias("vp"), half.bitwiseAND(s["hp"]).alias("vn"), d.cast("int").alias("d"))

    def once(s: Column, j: Column) -> Column:
        # each part is bound once by a one-element array, so that no expression is copied into the next
        for f in (lambda q: step(q, j), zero, delta, close):
            s = F.get(F.transform(F.array(s), f), F.lit(0))
        return s

    start = F.struct(long(full ^ ((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("d"))
    run = F.aggregate(F.sequence(F.lit(1), n), start, once, lambda s: s["d"])
    short = F.greatest(m, n) <= edits
    return F.when(F.abs(m - n) > edits, False).when(short, True).when((n == 0) | (m < edits), F.levenshtein(F.array_join(a, ""), F.array_join(b, "")) <= edits).otherwise(run <= edits)


def may_be_two_apart(a: Column, b: Column) -> Column:
    """Whether two strings can lie within two edits of each other, without a step for each character: less what they share at
    either end, one edit is at the front and one at the back, and what lies between is equal."""
    bind = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    n = F.char_length

    def shared(s: Column) -> Column:
        """Characters that s.a and s.b have in common at the front, by halving steps."""
        a, b = s["a"], s["b"]
        fits = lambda k, w: (k + w <= F.least(n(a), n(b))) & (F.substring(a, k + 1, w) == F.substring(b, k + 1, w))
        return F.aggregate(F.array(*[F.lit(1 << i) for i in range(29, -1, -1)]), F.lit(0), lambda k, w: F.when(fits(k, w), k + w).otherwise(k))

    def rest(s: Column) -> Column:
        return bind(shared(s), lambda k: F.struct(F.reverse(F.substring(s["a"], k + 1, n(s["a"]))).alias("a"), F.reverse(F.substring(s["b"], k + 1, n(s["b"]))).alias("b")))

    def between(s: Column) -> Column:
        a, b = s["a"], s["b"]
        out = F.greatest(n(a), n(b)) <= 2
        ends = [(1, 0), (0, 1), (1, 1)]
        for i, j in ends:
            for k, l in ends:
                u, v = n(a) - i - k, n(b) - j - l
                out = out | ((u == v) & (u >= 0) & (F.substring(a, F.lit(i + 1), u) == F.substring(b, F.lit(j + 1), v)))
        return out

    return bind(bind(bind(F.struct(a.alias("a"), b.alias("b")), rest), rest), between)


def _letters(line: str, letters: str = LETTERS) -> Column:
    """Counts of letters, six to a long, ten bits each (a larger count stays at 1023, which only loosens the bound)."""
    n = [F.least(F.lit(1023), F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long") for c in letters]
    pack = lambda part: sum((F.shiftleft(x, 10 * i) for i, x in enumerate(part)), F.lit(0).cast("long"))
    return F.array(*[pack(n[i : i + 6]) for i in range(0, len(letters), 6)])


def _apart(a: str, b: str, letters: str = LETTERS) -> Column:
    """Sum of the differences of the letter counts: at most two for each edit."""
    field = lambda c, w, i: F.shiftright(F.get(F.col(c), F.lit(w)), 10 * i).bitwiseAND(F.lit(1023).cast("long"))
    return sum((F.abs(field(a, i // 6, i % 6) - field(b, i // 6, i % 6)) for i in range(len(letters))), F.lit(0).cast("long"))


def _lines(docs: DataFrame) -> DataFrame:
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))  # the text is hashed before that
    return d.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line")).withColumn("n", F.char_length("line"))


def _near(lines: DataFrame, edits: int) -> DataFrame:
    """(h1, h2) of the lines that have an earlier, different neighbour within the edits."""
    keyed = segment_keys(lines, edits)
    live = keyed.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("side").alias("s")).filter("a <> b AND s = 0").select("k")
    live = stash(live, "line-keys")
    few = live.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    members = stash(keyed.join(F.broadcast(live) if few else live, "k", "left_semi").distinct(), "line-members")
    unstash(live)
    who = members.select("h1", "h2").distinct()
    who = F.broadcast(who) if who.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else who
    known = lines.join(who, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "no")).alias("at"), F.first("line").alias("line"))
    known = stash(known.select("h1", "h2", "at", "line", F.char_length("line").alias("n"), _letters("line").alias("bag")), "line-texts")
    m = members.join(known.select("h1", "h2", "at", "n", "bag"), ["h1", "h2"]).select("k", "side", F.struct("at", "h1", "h2", "n", "bag").alias("me"))
    m = stash(m, "line-places")
    unstash(members)

    near = _meet(m, known, edits, LETTERS).distinct()
    unstash(m)
    unstash(known)
    return near


def _finer(hot: DataFrame, known: DataFrame, edits: int) -> DataFrame:
    """The members of hot keys (h1, h2) by finer segments: k, side, me."""
    lines = stash(known.join(hot, ["h1", "h2"], "left_semi").withColumn("bag", _letters("line", LETTERS + DIGITS)), "line-hot")
    keyed = segment_keys(lines, edits, PIECES)
    often = keyed.filter("side = 0").groupBy("k").agg(F.count("*").alias("times"))
    rare = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("times", "k")) <= edits + 1
    own = stash(keyed.filter("side = 0").distinct().join(often, "k").withColumn("rare", rare).filter("rare").select("k", "h1", "h2"), "line-rare")
    probes = keyed.select("k", "h1", "h2").distinct().join(own.select("k").distinct(), "k", "left_semi")
    members = probes.join(own.withColumn("side", F.lit(0)), ["k", "h1", "h2"], "left").withColumn("side", F.coalesce("side", F.lit(1)))
    return members.join(lines.select("h1", "h2", "at", "n", "bag"), ["h1", "h2"]).select("k", "side", F.struct("at", "h1", "h2", "n", "bag").alias("me"))


def combined_keys(parts: DataFrame) -> DataFrame:
    """k, side, me, part (what is not known to be equal) -> the same by finer keys: all of a part but two of its segments;
    part becomes what the two hold. The first of them is counted from the start, what follows the second from the end, and
    what lies between them is sought up to one place away. A part under BLOCK characters keeps its key."""
    places = [(i, j, shift) for i in range(COMBINED) for j in range(i + 1, COMBINED) for shift in ((0,) if j == i + 1 else (-1, 0, 1))]
    listed = lambda back: ", ".join(f"struct({int(shift != 0 or b > 0)} AS probe, {b} AS back, {i} AS i, {j} AS j, {shift} AS shift)" for b in back for i, j, shift in places)
    d = parts.withColumn("n", F.char_length("part")).withColumn("x", F.explode(F.expr(f"if(n % {BLOCK} < 2, array({listed((0, 1))}), array({listed((0,))}))")))
    d = d.select("k", F.expr("greatest(side, x.probe)").alias("side"), "me", "part", "n", "x.i", "x.j", "x.shift", F.expr(f"(cast(n / {BLOCK} AS int) - x.back) * {BLOCK}").alias("w"))
    d = d.filter("w >= 0").withColumn("w", F.expr(f"cast(w / {COMBINED} AS int)")).filter("w > 0 OR (i = 0 AND j = 1)")
    d = d.withColumn("a", F.expr("(i + 1) * w + shift")).withColumn("b", F.expr("j * w + shift")).withColumn("e", F.expr(f"n - ({COMBINED - 1} - j) * w")).filter("e >= b")
    k = F.expr("xxhash64(k, w, i, j, substring(part, 1, i * w), substring(part, a + 1, b - a), substring(part, e + 1, n - e))")
    left = F.expr("if(j = i + 1, substring(part, i * w + 1, e - i * w), concat(substring(part, i * w + 1, a - i * w), '\n', substring(part, b + 1, e - b)))")
    return d.select(k.alias("k"), "side", "me", left.alias("part"))


def _combined(parts: DataFrame) -> DataFrame:
    """The members of combined keys that two different lines have in common."""
    keyed = stash(combined_keys(parts), "line-combined")
    live = keyed.groupBy("k").agg(F.min("me.h1").alias("a"), F.max("me.h1").alias("b"), F.min("side").alias("s")).filter("a <> b AND s = 0").select("k")
    out = stash(keyed.join(live, "k", "left_semi").groupBy("k", "me").agg(F.min("side").alias("side"), F.first("part").alias("part")), "line-finer")
    unstash(keyed)
    return out


def _meet(m: DataFrame, known: DataFrame, edits: int, letters: str, many: int | None = MANY) -> DataFrame:
    """(h1, h2) of the lines that have an earlier neighbour among the members (k, side, me) of one of their keys."""

    def tested(pairs: DataFrame) -> DataFrame:
        """(early, late) structs -> (h1, h2) of the late lines of those within the edits."""
        p = pairs.select(F.col("early.h1").alias("e1"), F.col("early.h2").alias("e2"), F.col("late.h1").alias("h1"), F.col("late.h2").alias("h2")).distinct()
        chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
        texts = known.select("h1", "h2", "line")
        p = p.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("other")), ["e1", "e2"])
        if edits == 2:  # most pairs end here, before the steps for each character of those that are left
            p = p.filter(may_be_two_apart(F.col("line"), F.col("other")))
        # written, so that the characters of a line are worked out once and only for lines of a pair
        p = stash(p.select("h1", "h2", chars("line").alias("chars"), chars("other").alias("others")), "line-pairs")
        out = stash(p.filter(edit_distance_within(F.col("others"), F.col("chars"), edits)).select("h1", "h2").distinct(), "line-near")
        unstash(p)
        return out

    def allowed(early: str, late: str) -> Column:
        return (F.col(f"{early}.at") < F.col(f"{late}.at")) & (F.abs(F.col(f"{early}.n") - F.col(f"{late}.n")) <= edits) & (_apart(f"{early}.bag", f"{late}.bag", letters) <= 2 * edits)

    # the earliest line of a key, and the earliest that is indexed: one pair for each member
    parts = F.min(F.char_length("part")) if "part" in m.columns else F.lit(BLOCK)  # shorter parts have no finer keys
    members = F.when(parts >= BLOCK, F.count("*")).otherwise(0)
    first = m.groupBy("k").agg(F.min("me").alias("any"), F.min(F.when(F.col("side") == 0, F.col("me"))).alias("own"), members.alias("members"))
    star = m.join(first.drop("members"), "k").select("me", F.when(F.col("side") == 0, F.col("any")).otherwise(F.col("own")).alias("early"))
    star = star.filter("early IS NOT NULL").filter(allowed("early", "me"))
    done = tested(star.select("early", F.col("me").alias("late")))
    # lines still open meet every earlier member: pairs of an indexed and any member
    gone = done.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    left = m.select("k", "side", F.col("me").alias("late"), *[c for c in m.columns if c == "part"]).join(gone, F.expr("late.h1 = g1 AND late.h2 = g2"), "left_anti")
    others = m.select("k", F.col("side").alias("side2"), F.col("me").alias("early"), *[F.col(c).alias("part2") for c in m.columns if c == "part"])
    hot = stash(first.filter(F.col("members") > many).select("k"), "line-hot-keys") if many else None
    if hot is not None and not hot.isEmpty():
        of_hot = m.join(hot, "k", "left_semi")
        if edits > 2:
            fine = stash(_finer(of_hot.select("me.h1", "me.h2").distinct(), known, edits), "line-finer")
        elif "part" in m.columns:  # a line that has its verdict takes part for the others' sake
            fine = _combined(of_hot.select("k", "side", "me", "part"))
        else:
            hot_lines = known.join(of_hot.select("me.h1", "me.h2").distinct(), ["h1", "h2"], "left_semi").withColumn("bag", _letters("line", LETTERS + DIGITS))
            fine = _combined(hot_lines.select(F.lit(0).cast("long").alias("k"), F.lit(0).alias("side"), F.struct("at", "h1", "h2", "n", "bag").alias("me"), F.col("line").alias("part")))
        done = done.union(_meet(fine, known, edits, LETTERS + DIGITS, CROWD if edits <= 2 else None))
        unstash(fine)
        left = left.join(hot, "k", "left_anti")
    fits = (F.col("l.k") == F.col("e.k")) & ((F.col("side") == 0) | (F.col("side2") == 0)) & allowed("early", "late")
    if "part" in m.columns:  # what is not known to be equal is as near as the lines
        fits = fits & (F.levenshtein("part", "part2", edits) >= 0)
    rest = left.alias("l").join(others.alias("e"), fits)
    return done.union(tested(rest.select("early", "late")))


def line_flags(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, th (a document's key: doc_id and the hash of its text), marks: number and kind of each of its lines that goes,
    in order; kind 1 repeats an earlier line, kind 2 is only close to one. Documents without any have no row.

    The lines are hashed once; what decides about them is read from that table of hashes. A hot line meets its verdict
    by a broadcast of at most HOT rows, all others by a join on the hash."""
    lines = _lines(docs)
    near = _near(lines.filter(F.col("n") >= min_chars), edits) if edits else None
    judged = lines.filter((F.col("n") >= min_chars) | F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("id", "th", "no", "h1", "h2")
    judged = stash(judged, "line-hashes")
    seen = judged.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "no")).alias("first"), F.count("*").alias("times"))
    if near is not None:
        seen = seen.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").filter("times > 1 OR near")
    else:
        seen = seen.withColumn("near", F.lit(False)).filter("times > 1")
    seen = stash(seen, "line-seen")
    every = seen.agg(F.sum("times")).first()[0] or 0
    kind = F.when(F.struct("id", "th", "no") != F.col("first"), 1).when(F.col("near"), 2).otherwise(0)
    hot = F.broadcast(seen.filter(F.col("times") * HOT > every))
    at_once = judged.join(hot, ["h1", "h2"])
    by_join = judged.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(seen.filter(F.col("times") * HOT <= every), ["h1", "h2"])
    rows = at_once.select("id", "th", "no", kind.alias("kind")).union(by_join.select("id", "th", "no", kind.alias("kind"))).filter("kind > 0")
    # rows that agree in doc_id and text are one document
    out = stash(rows.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("no", "kind"))).alias("marks")), "line-marks")
    unstash(judged)
    unstash(seen)
    return out


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with `text` less its repeated lines, further columns n_lines, n_exact, n_near (in place of such columns of
    docs); columns else unchanged.

    A row for each row of docs. Null text stays null with no lines; empty text has one empty line. Blank lines stay. Rows
    that agree in doc_id and text are one document and keep the same lines; a null doc_id comes before all others; rows
    that share a doc_id are ordered by the hash of their text. An empty table gives none."""
    out, text, (n_lines, n_exact, n_near) = _cut(docs, edits, min_chars)
    counts = [n_lines.alias("n_lines"), n_exact.alias("n_exact"), n_near.alias("n_near")]
    return out.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")], *counts)


def _cut(docs: DataFrame, edits: int, min_chars: int) -> tuple[DataFrame, Column, tuple[Column, Column, Column]]:
    """docs beside their marks; the text that stays, lines, exact and near repeats as columns of that."""
    marks = line_flags(docs.filter("text IS NOT NULL"), edits, min_chars).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("marks").alias("__marks"))
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    out = docs.join(marks, key, "left")
    mark = F.col("__marks")
    out = out.withColumn("__lines", F.when(mark.isNotNull(), F.split(docs["text"], "\n")))  # once, and only where lines go
    lines = F.col("__lines")
    # the stretches between marked lines, each from one past the last mark
    out = out.withColumn("__nos", F.concat(F.array(F.lit(-1)), F.transform(mark, lambda m: m["no"]), F.array(F.size(lines))))
    nos = F.col("__nos")
    kept = F.transform(F.sequence(F.lit(0), F.size(mark)), lambda k: F.slice(lines, F.get(nos, k) + 2, F.get(nos, k + 1) - F.get(nos, k) - 1))
    text = F.when(mark.isNull(), docs["text"]).otherwise(F.array_join(F.flatten(kept), "\n"))
    count = lambda kind: F.when(mark.isNull(), 0).otherwise(F.size(F.filter(mark, lambda m: m["kind"] == kind))).cast("long")
    n_lines = F.octet_length(docs["text"]) - F.octet_length(F.replace(docs["text"], F.lit("\n"), F.lit(""))) + 1
    return out, text, (F.coalesce(n_lines, F.lit(0)).cast("long"), count(1), count(2))


def dedup_documents(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with their repeated lines cut out, columns unchanged (n_chars follows the text), whatever they are called. A
    document that had lines with text and keeps none of them goes; one that had none to begin with stays."""
    out, text, (_, n_exact, n_near) = _cut(docs, edits, min_chars)
    whole = n_exact + n_near == 0
    out = out.withColumn("__text", text).filter(whole | (F.trim(F.replace("__text", F.lit("\n"), F.lit(""))) != ""))
    n_chars = lambda: F.when(whole, docs["n_chars"]).otherwise(F.char_length("__text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[F.col("__text").alias(c) if c == "text" else n_chars().alias(c) if c == "n_chars" else docs[c] for c in docs.columns])


def op2_lines(spark, sf_dir: str) -> DataFrame:
    d = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return d.select("doc_id", "n_lines", "n_exact", "n_near", F.char_length(kept).cast("long").alias("n_kept_chars"), F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
firsts AS (SELECT line, length(line) AS n, min((doc_id, no)) AS at FROM lines WHERE length(line) >= 24 OR regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
long AS (SELECT * FROM firsts WHERE n >= 24),
near AS (
  SELECT DISTINCT b.line FROM long a JOIN long b
  ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.at < b.at AND (
    substr(a.line, 1, a.n // 3) = substr(b.line, 1, a.n // 3) OR substr(a.line, a.n - (a.n // 3) + 1) = substr(b.line, b.n - (a.n // 3) + 1)
    OR contains(b.line, substr(a.line, a.n // 3 + 1, a.n // 3)))
  WHERE levenshtein(a.line, b.line) <= 2),
flagged AS (
  SELECT l.doc_id, l.no, l.line, CASE WHEN f.line IS NULL THEN 0 WHEN (l.doc_id, l.no) <> f.at THEN 1 WHEN r.line IS NOT NULL THEN 2 ELSE 0 END AS kind
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near r ON l.line = r.line),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (kind = 1) AS n_exact, count(*) FILTER (kind = 2) AS n_near,
    coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (kind = 0), '') AS kept FROM flagged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near,
  coalesce(length(kept), 0)::BIGINT AS n_kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
"""
