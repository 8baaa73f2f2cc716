"""Streams give what the same functions give on the whole table."""

from pyspark.sql import functions as F

from sparrowgrid.streaming import events


def run(df, mode, name, spark, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
    try:
        q.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        q.stop()


def test_windows_sessions_and_state(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartitionByRange(3, "ts").write.parquet(f"file://{tmp_path}/in")
    stream = lambda: events.timed(events.read(spark, f"file://{tmp_path}/in", batch.schema), "60 days")
    whole = events.timed(batch)
    assert sorted(run(events.windowed(stream()), "complete", "w", spark, tmp_path), key=str) == sorted(events.windowed(whole).collect(), key=str)
    got = run(events.sessions(stream()), "complete", "s", spark, tmp_path)
    want = events.sessions(whole).collect()
    near = lambda rows: sorted((r["start"], r["end"], r["user_id"], r["n"], round(r["total"], 6)) for r in rows)
    assert near(got) == near(want)
    assert len(run(events.distinct_events(stream()), "append", "d", spark, tmp_path)) == events.distinct_events(whole).count()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _runs(rows, gap):
    """Plain version: runs of a user's events that no gap parts -> {(user, last)}: (n, total)."""
    out, now = {}, {}
    for u, t, v in sorted(rows):
        if u in now and (t - now[u][1]).total_seconds() > gap:
            out[u, now[u][1]] = (now[u][0], round(now[u][2], 6))
            del now[u]
        n, _, s = now.get(u, (0, t, 0.0))
        now[u] = (n + 1, t, s + (v or 0.0))
    newest = max(t for _, t, _ in rows)
    over = lambda t: (newest - t).total_seconds() > gap  # noqa: E731  the watermark has passed it
    out |= {(u, t): (n, round(s, 6)) for u, (n, t, s) in now.items() if over(t)}
    return out, {(u, t): (n, round(s, 6)) for u, (n, t, s) in now.items() if not over(t)}


def test_totals_end_after_a_gap_and_go_on_after_a_restart(spark, tmp_path):
    from datetime import datetime, timedelta

    begin = datetime(2024, 1, 1)
    at = lambda minutes: begin + timedelta(minutes=minutes)
    batches = [
        [(1, at(0), 1.0), (2, at(5), 2.0), (1, at(10), None), (3, at(-200), 1.0), (3, at(20), 5.0)],
        [(1, at(25), 4.0), (2, at(30), 7.0), (None, at(31), 1.0)],
        [(4, at(1000), 1.0)],
        [(1, at(1010), 8.0), (None, at(1020), 2.0)],
    ]
    schema = "user_id long, ts timestamp, value double"
    held = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    got = []
    try:
        for k, rows in enumerate(batches):  # each batch by a query that starts again from the checkpoint
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            stream = events.timed(events.read(spark, f"file://{tmp_path}/in", "user_id long, ts timestamp, value double"), "0 seconds")
            out = events.running_totals(stream, gap_minutes=60)
            q = out.writeStream.foreachBatch(lambda d, _: got.extend(d.collect())).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
            q.awaitTermination(120)
            q.stop()
    finally:
        spark.conf.set(PROVIDER, held)
    ended, live = _runs([(u if u is not None else -1, t, v) for b in batches for u, t, v in b], 3600)
    name = lambda r: (-1 if r["user_id"] is None else r["user_id"], r["last"])
    assert {name(r): (r["n"], round(r["total"], 6)) for r in got if r["ended"]} == ended
    assert sum(r["ended"] for r in got) == len(ended)
    last = {}
    for r in got:
        last[name(r)[0]] = r
    assert {name(r): (r["n"], round(r["total"], 6)) for r in last.values() if not r["ended"]} == live


def test_day_files_resume(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = batch.filter("event_id % 2 = 0")
    half.write.parquet(f"file://{tmp_path}/in")
    go = lambda: events.to_day_files(events.timed(events.read(spark, f"file://{tmp_path}/in", batch.schema)), f"file://{tmp_path}/days", f"file://{tmp_path}/check").awaitTermination()
    go()
    assert spark.read.parquet(f"file://{tmp_path}/days").count() == half.count()
    batch.filter("event_id % 2 = 1").write.mode("append").parquet(f"file://{tmp_path}/in")
    go()
    got = spark.read.parquet(f"file://{tmp_path}/days")
    assert got.count() == batch.count() == got.select("event_id").distinct().count() and got.filter("day <> to_date(ts)").isEmpty()
    assert events.daily(events.timed(batch)).agg(F.sum("n")).first()[0] == batch.count()
