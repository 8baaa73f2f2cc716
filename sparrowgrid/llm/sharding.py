"""Sharding by balanced label propagation.

Documents that link to one another (here: equal texts) are members of a group. Every document starts on a shard
chosen by a hash. In each round the groups elect the shards that hold most of their members, as many as the
group needs under the capacity of a shard, and members elsewhere ask to move there; a join brings each member
its group's choice, and a quota for each shard admits the share of requests that its room allows. At the end the
shards are levelled exactly, unlinked documents moving first. The law is `rows`: counts differ by one at most.

Links stay implicit in the group key, so a group of n copies costs n rows and not n^2 edges. What reaches the
driver is a row for each shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, unstash

SHARDS = 40
ROUNDS = 6  # at most; they end when no member asks to move
BUCKET_ROWS = 100_000  # rows of one shard that are numbered in one window, about


def _share(*what) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 30)) / float(1 << 30)


def _numbered(rows: DataFrame, buckets: int, cls: Column) -> DataFrame:
    """Adds `place`: the row's number from 0 within its shard, by class, then bucket. Counts of buckets give each
    bucket its first number, a window inside the bucket the rest."""
    spread = F.when(F.col("big"), F.xxhash64("rid", F.lit(5))).otherwise(F.xxhash64("g1", F.lit(7)))
    rows = rows.withColumn("cls", cls.cast("int")).withColumn("bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    n = rows.groupBy("shard", "cls", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select("shard", "cls", "bucket", before.alias("first"))
    inside = Window.partitionBy("shard", "cls", "bucket").orderBy("g1", "g2", "doc_id", "no")
    return rows.withColumn("inner", F.row_number().over(inside)).join(n, ["shard", "cls", "bucket"]).withColumn("place", F.col("first") + F.col("inner") - 1).drop("cls", "bucket", "inner", "first")


def _levelled(rows: DataFrame, shards: int, total: int, buckets: int) -> DataFrame:
    """Moves as few rows as possible so that counts differ by one at most; unlinked rows move first."""
    loads = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}  # a row for each shard
    over = [loads.get(s, 0) - (total // shards + (s < total % shards)) for s in range(shards)]
    if not any(over):
        return rows
    first, targets, starts, out, into = [], [], [], 0, 0  # movers are numbered through all shards, and so is the room for them
    for s, x in enumerate(over):
        first.append(out)
        out += max(x, 0)
        if x < 0:
            targets.append(s)
            starts.append(into)
            into -= x
    of = lambda numbers, at: F.element_at(F.array(*[F.lit(x).cast("long") for x in numbers]), at)
    own = F.col("shard") + 1
    rows = _numbered(rows, buckets, F.col("linked"))
    mover = F.when(F.col("place") < of(over, own), F.col("place") + of(first, own))
    target = of(targets, F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in starts]), lambda x: x <= mover)))
    return rows.withColumn("shard", F.when(mover.isNull(), F.col("shard")).otherwise(target).cast("int")).drop("place")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, g1, g2 (two hashes of the text), and `no`: rows that agree in doc_id and text are
    counted and numbered from 1, so that every row has a name that does not depend on how the table is stored."""
    d = docs.select(
        F.col("doc_id").cast("long"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long")).alias("text_crc32"), F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(11), "text").alias("g2"),
    )
    n = d.groupBy("doc_id", "size", "text_crc32", "g1", "g2").agg(F.count("*").cast("int").alias("n"))
    return n.select("doc_id", "size", "text_crc32", "g1", "g2", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("no"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text -> doc_id, size, text_crc32, law, shard, slot, grown_shard; a row for each row of docs.

    Size is the bytes of the text plus 16; a null text has no bytes, its checksum is 0, and null texts are a group
    of their own, apart from empty ones. Rows with a null or repeated doc_id are placed like any others. An empty
    table gives none. Other columns are not read. Slots count from 0 within a shard, without gaps. The same rows get the
    same shards however the table is partitioned.

    A group with more than an eighth of a shard's rows is big: there are at most 8 * shards of them, which bounds what is
    broadcast. Its members find their group by that; a group that is dealt by its key has fewer rows than that."""
    rows = stash(_rows(docs).withColumn("rid", F.xxhash64("doc_id", "g1", "g2", "no")), "shard-rows")
    total = rows.count()
    cap = max(1, -(-total // shards))
    buckets = max(4, cap // BUCKET_ROWS)
    groups = stash(rows.groupBy("g1", "g2").agg(F.count("*").alias("members")).filter("members > 1").withColumn("big", F.col("members") * 8 > cap), "shard-groups")
    key = ["g1", "g2"]
    big = rows.join(F.broadcast(groups.filter("big").select(*key)), key)
    small = rows.join(F.broadcast(groups.filter("big").select(*key)), key, "left_anti").join(groups.filter("NOT big").select(*key, F.lit(True).alias("linked")), key, "left")
    every = small.withColumn("big", F.lit(False)).unionByName(big.withColumn("linked", F.lit(True)).withColumn("big", F.lit(True))).withColumn("linked", F.coalesce("linked", F.lit(False)))
    every = stash(every.withColumn("shard", F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(shards)).cast("int")), "shard-state")
    unstash(rows)
    unstash(groups)
    # only linked rows have anything to move for
    now = every.filter("linked")
    held_by_one = stash(every.filter("NOT linked"), "shard-single")
    now = stash(now, "shard-state")
    unstash(every)
    load = [0] * shards  # linked rows that the last round would have put there; of equal shards the emptier one is a home
    for r in range(rounds):
        held = now.groupBy(*key, "big", "shard").count()
        best = F.reverse(F.array_sort(F.collect_list(F.struct("count", (-F.element_at(F.array(*map(F.lit, load)), F.col("shard") + 1)).alias("load"), (-F.col("shard")).alias("s")))))  # at most one entry for each shard
        chosen = held.groupBy(*key, "big").agg(best.alias("b"), F.sum("count").alias("members"))
        need = F.ceil(F.col("members") / F.lit(cap)).cast("int")
        chosen = chosen.select(*key, "big", F.transform(F.slice("b", 1, F.least(need, F.size("b"))), lambda x: (-x["s"]).cast("int")).alias("homes"))
        chosen = stash(chosen, "shard-homes")
        few = F.broadcast(chosen.filter("big").drop("big"))
        asked = now.filter("big").join(few, key).unionByName(now.filter("NOT big").join(chosen.filter("NOT big").drop("big"), key))
        pick = F.element_at("homes", (F.pmod(F.xxhash64("rid", F.lit(r)), F.size("homes")) + 1).cast("int"))
        asked = stash(asked.withColumn("to", F.when(~F.array_contains("homes", F.col("shard")), pick)).drop("homes"), "shard-asked")
        unstash(chosen)
        room = {x["s"]: x for x in asked.select(F.coalesce("to", "shard").alias("s"), F.col("to").isNotNull().cast("long").alias("moves")).groupBy("s").agg(F.sum("moves").alias("ask"), F.count("*").alias("all")).collect()}
        load = [room[s]["all"] if s in room else 0 for s in range(shards)]
        if not any(x["ask"] for x in room.values()):
            unstash(asked)
            break
        quota = [min(1.0, max(0.0, cap - (x["all"] - x["ask"])) / x["ask"]) if (x := room.get(s)) and x["ask"] else 0.0 for s in range(shards)]
        lucky = _share(F.when(F.col("big"), F.col("rid")).otherwise(F.col("g1")), F.lit(100 + r)) < F.element_at(F.array(*map(F.lit, quota)), F.col("to") + 1)
        before, now = now, stash(asked.withColumn("shard", F.when(F.col("to").isNotNull() & lucky, F.col("to")).otherwise(F.col("shard"))).drop("to"), "shard-state")
        unstash(before)
        unstash(asked)
    out = _numbered(_levelled(now.unionByName(held_by_one), shards, total, buckets), buckets, F.lit(0))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame, group: str) -> DataFrame:
    """Pairs of linked documents in all, and on different shards."""
    n = sharded.groupBy(group, "shard").agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    return n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("links"), F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("same")).alias("cut"))


def op10_shards(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
