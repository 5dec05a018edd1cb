"""Streams over files that arrive one by one: late rows, state across batches, and the batch twin."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from sluice.streaming import queries as streams
from sluice.streaming import state

START = dt.datetime(2024, 1, 1)


def _write(spark, path, batches):
    """One file for each batch of (event_id, minute, user_id, event_type, value), in order of time."""
    import os
    import time

    for k, rows in enumerate(batches):
        made = [(i, START + dt.timedelta(minutes=m), u, t, v, "{}") for i, m, u, t, v in rows]
        spark.createDataFrame(made, streams.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
        for name in os.listdir(path):
            if name.endswith(".parquet") and not name.startswith("seen"):
                os.rename(f"{path}/{name}", f"{path}/seen-{k:03d}.parquet")
                os.utime(f"{path}/seen-{k:03d}.parquet", (time.time() - 100 + k, time.time() - 100 + k))


def test_late_rows_are_dropped(spark, tmp_path):
    # The watermark that drops rows is the one of the batch before, so a batch lies between.
    _write(spark, tmp_path / "in", [[(1, 0, 1, "a", 1.0), (2, 200, 1, "a", 1.0)], [(6, 201, 1, "a", 1.0)], [(3, 5, 1, "a", 1.0), (4, 190, 1, "a", 2.0)], [(5, 600, 1, "a", 1.0)]])
    made = streams.tumbling_counts(streams.event_stream(spark, str(tmp_path / "in")), "1 hour", "1 hour")
    rows = streams.run_to_table(made, "late_rows", str(tmp_path / "check")).collect()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    assert {(r["bucket"] - base, r["n"], r["total"]) for r in rows} == {(0, 1, 1.0), (10800, 3, 4.0)}


def test_silence_lasts_over_batches(spark, tmp_path):
    _write(spark, tmp_path / "in", [[(1, 0, 1, "a", 1.0), (2, 0, 2, "a", 1.0)], [(3, 8, 1, "a", 1.0)], [(4, 11, 1, "a", 1.0)], [(5, 15, 1, "a", 1.0)]])
    made = streams.throttled_alerts(streams.event_stream(spark, str(tmp_path / "in")), 10)
    rows = streams.run_to_table(made, "silence", str(tmp_path / "check")).collect()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted((r["user_id"], (r["sec"] - base) // 60) for r in rows) == [(1, 0), (1, 11), (2, 0)]


def test_duplicates_within_their_time_to_live(spark, tmp_path):
    _write(spark, tmp_path / "in", [[(1, 0, 1, "a", 1.0)], [(2, 30, 1, "a", 1.0), (3, 30, 2, "a", 1.0)], [(6, 1000, 3, "a", 1.0)], [(7, 1500, 4, "a", 1.0)], [(4, 2000, 1, "a", 1.0)], [(5, 2001, 1, "a", 1.0)]])
    made = streams.deduplicated(streams.event_stream(spark, str(tmp_path / "in")), ["user_id"], "1 hour").select("event_id")
    assert sorted(r[0] for r in streams.run_to_table(made, "ttl", str(tmp_path / "check")).collect()) == [1, 3, 4, 6, 7]


def test_sessions_end_after_a_gap(spark, tmp_path):
    _write(spark, tmp_path / "in", [[(1, 0, 1, "a", 1.0), (2, 20, 1, "a", 1.0), (3, 100, 1, "a", 1.0)], [(4, 1000, 2, "a", 1.0)], [(5, 1001, 2, "a", 1.0)]])
    made = streams.sessions(streams.event_stream(spark, str(tmp_path / "in")))
    rows = streams.run_to_table(made, "sessions", str(tmp_path / "check"))
    assert sorted(r["n"] for r in rows.filter(F.col("user_id") == 1).collect()) == [1, 2]


def test_a_gap_of_full_length_ends_a_session(spark, tmp_path):
    """In one batch and across two: rows 30 minutes apart are two sessions, rows 29 minutes apart are one."""
    _write(spark, tmp_path / "in", [[(1, 0, 1, "a", 1.0), (2, 30, 1, "a", 1.0), (3, 59, 1, "a", 1.0)], [(4, 89, 1, "a", 1.0), (5, 118, 1, "a", 1.0)], [(6, 1000, 2, "a", 1.0)], [(7, 1001, 2, "a", 1.0)]])
    made = streams.sessions(streams.event_stream(spark, str(tmp_path / "in")))
    rows = streams.run_to_table(made, "full_gaps", str(tmp_path / "check"))
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted(((r["start"] - base) // 60, r["n"]) for r in rows.filter(F.col("user_id") == 1).collect()) == [(0, 1), (30, 2), (89, 2)]


def test_restart_from_a_checkpoint(spark, tmp_path):
    """A second run reads only what came since the first, keeps its state and writes each row once."""
    rows = [(k, "2024-01-01T00:00:00", k % 3, "error", 1.0, "{}") for k in range(6)]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    made.filter("event_id < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = streams.event_stream(spark, str(tmp_path / "in"))
        streams.run_updates(stream.groupBy("user_id").count(), str(tmp_path / "out"), str(tmp_path / "c"))
        streams.run_to_parquet(streams.event_stream(spark, str(tmp_path / "in")).select("event_id"), str(tmp_path / "rows"), str(tmp_path / "c2"))
        made.filter("event_id >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.run_updates(streams.event_stream(spark, str(tmp_path / "in")).filter("event_id < 99").groupBy("user_id").count(), str(tmp_path / "out"), str(tmp_path / "c"))
    found = streams.latest(spark.read.parquet(str(tmp_path / "out")), ["user_id"])
    assert {r["user_id"]: r["count"] for r in found.collect()} == {0: 3, 1: 3, 2: 3}
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [0, 1, 2, 3, 4, 5]


def test_expired_keys_come_again(spark, tmp_path):
    """A key is new again once its time to live is over."""
    times = ["2024-01-01T00:00:00", "2024-01-01T01:00:00", "2024-01-05T00:00:00", "2024-01-05T00:10:00", "2024-01-09T00:00:00", "2024-01-09T00:10:00"]
    for k, t in enumerate(times):
        time.sleep(0.05)  # files are read in the order of their times
        row = spark.createDataFrame([(k, t, 7, "view", 1.0, "{}")], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.deduplicated(streams.event_stream(spark, str(tmp_path / "in"), per_batch=1), ["user_id"], "8 hours")
    made = streams.run_to_table(stream.select("event_id"), "expired", str(tmp_path / "c"))
    found = {r["event_id"] for r in made.collect()}
    assert 0 in found and 1 not in found and len(found & {2, 3}) <= 1 and len(found & {2, 3, 4, 5}) >= 1


def test_readers_and_alerts_of_streams(spark, tmp_path):
    from sluice.sources import readers, sinks

    (tmp_path / "t.txt").write_text("a|b|c")
    assert [r["value"] for r in readers.text_records(spark, str(tmp_path / "t.txt"), "|").collect()] == ["a", "b", "c"]
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    query = sinks.send_alerts(readers.follow(spark, str(tmp_path / "in"), "id long").filter("id > 2"), lambda batch, number: seen.extend(r["id"] for r in batch.collect()), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [3, 4]


def _plain_new(rows, slots, expiry):
    """(event_id, attribute) of rows (event_id, minute, user, attribute) that are new to their user, all in one go."""
    found, seen = set(), {}
    for sec, i, user, attribute in sorted((m * 60, i, u, t) for i, m, u, t in rows):
        own = seen.setdefault(user, {})
        for old in [a for a, t in own.items() if sec - t > expiry]:
            del own[old]
        if attribute not in own:
            found.add((i, attribute))
        own.pop(attribute, None)
        own[attribute] = sec
        if len(own) > slots:
            del own[next(iter(own))]
    return found


def test_new_attributes_over_batches_and_a_restart(spark, tmp_path):
    """State lives on in RocksDB: a query that stops after some batches goes on where it was, and attributes expire."""
    rng = random.Random(11)
    rows = [(k, 40 * k + rng.randrange(30), rng.randrange(3), rng.choice("abcdef")) for k in range(120)]
    batches = [[(i, m, u, t, 1.0) for i, m, u, t in rows[k : k + 20]] for k in range(0, 120, 20)]
    _write(spark, tmp_path / "in", batches[:3])
    made = lambda: state.new_attributes(streams.event_stream(spark, str(tmp_path / "in")), 3, 7200, "0 seconds")
    for part in (None, batches[3:]):
        if part:
            _more(spark, tmp_path / "in", part, 3)
        state.run(spark, made(), lambda s: streams.run_to_parquet(s, str(tmp_path / "out"), str(tmp_path / "check")))
    got = {(r["event_id"], r["attribute"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == _plain_new(rows, 3, 7200)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != state.ROCKS


def _more(spark, path, batches, first):
    for k, part in enumerate(batches, first):
        _write_one(spark, path, part, k)


def _write_one(spark, path, rows, k):
    made = [(i, START + dt.timedelta(minutes=m), u, t, v, "{}") for i, m, u, t, v in rows]
    spark.createDataFrame(made, streams.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    for name in os.listdir(path):
        if name.endswith(".parquet") and not name.startswith("seen"):
            os.rename(f"{path}/{name}", f"{path}/seen-{k:03d}.parquet")


def test_timers_empty_the_state(spark, tmp_path):
    """Once the watermark has passed its expiry, a user's state is gone without another row of theirs."""
    _write(spark, tmp_path / "in", [[(1, 0, 1, "a", 1.0), (2, 0, 2, "a", 1.0)], [(3, 500, 2, "b", 1.0)], [(4, 501, 2, "b", 1.0)], [(5, 502, 2, "b", 1.0)]])
    made = state.new_attributes(streams.event_stream(spark, str(tmp_path / "in")), 3, 3600, "0 seconds")
    state.run(spark, made, lambda s: streams.run_to_parquet(s, str(tmp_path / "out"), str(tmp_path / "check")))
    with state.rocks_state(spark):
        held = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "check")).select("key.user_id").distinct().collect()
    assert {r[0] for r in held} == {2}


def test_back_and_forth_is_told_once(spark, tmp_path):
    steps = [(0, "a"), (10, "b"), (20, "a"), (30, "b"), (40, "a"), (400, "b"), (410, "a"), (2000, "b"), (4000, "a")]
    _write(spark, tmp_path / "in", [[(k, m, 7, t, 1.0)] for k, (m, t) in enumerate(steps)])
    found = {}
    for quiet in (0, 3600):
        made = state.back_again(streams.event_stream(spark, str(tmp_path / "in")), 3600, quiet, "0 seconds")
        state.run(spark, made, lambda s, q=quiet: streams.run_to_parquet(s, str(tmp_path / f"out{q}"), str(tmp_path / f"check{q}")))
        found[quiet] = [(r["event_id"], r["other"], r["width"]) for r in spark.read.parquet(str(tmp_path / f"out{quiet}")).orderBy("event_id").collect()]
    assert found[0] == [(2, "b", 1200), (3, "a", 1200), (4, "b", 1200)]
    assert found[3600] == [(2, "b", 1200)]


def test_alerts_of_one_second_are_told_together(spark, tmp_path):
    """Silence is for what comes after an alert: another alert in its second is told, in its batch or the next."""
    steps = [(0, "a"), (10, "b"), (20, "a"), (20, "b"), (20, "a"), (30, "b"), (200, "a"), (200, "b")]
    _write(spark, tmp_path / "in", [[(k, m, 7, t, 1.0) for k, (m, t) in enumerate(steps) if k in part] for part in ((0, 1, 2, 3), (4, 5), (6, 7))])
    made = state.back_again(streams.event_stream(spark, str(tmp_path / "in")), 12_000, 3600, "0 seconds")
    state.run(spark, made, lambda s: streams.run_to_parquet(s, str(tmp_path / "out"), str(tmp_path / "check")))
    found = [(r["event_id"], r["other"], r["width"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").collect()]
    assert found == [(2, "b", 1200), (3, "a", 600), (4, "b", 0), (6, "b", 10_800), (7, "a", 10_200)]


def test_alerts_come_once_until_the_clock_has_run_out(spark, tmp_path):
    _write(spark, tmp_path / "in", [[(1, 0, 1, "a", 1.0), (2, 1, 1, "a", 1.0), (3, 2, 1, "b", 1.0)]])
    go = lambda alive: state.run(spark, state.once_in_a_while(streams.event_stream(spark, str(tmp_path / "in")), alive), lambda s: s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination(60))
    ids = lambda: sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    go(4000)
    assert ids() == [1, 3]
    time.sleep(5)
    _write_one(spark, tmp_path / "in", [(4, 3, 1, "a", 1.0), (5, 4, 1, "a", 1.0)], 1)
    go(4000)
    assert ids() == [1, 3, 4]
