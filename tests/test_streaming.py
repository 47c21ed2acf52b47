import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from burrow.operators import paths as P
from burrow.operators import series as S
from burrow.plans import live_queries
from burrow.streaming import live

SCHEMA = "session_id string, frame_number bigint, ts timestamp, state string, v double"
START = datetime(2024, 5, 1)


def at(second):
    return START + timedelta(seconds=second)


def frames_of(n=120, seed=3):
    rng = random.Random(seed)
    return [
        (s, i, at(i), rng.choice(["a", "b", "-", "-", None]), None if rng.random() < 0.1 else rng.random())
        for s in ("x", "y")
        for i in range(n)
    ]


def written(spark, folder, batches):
    """One file per batch, in that order."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def dealt(rows, batches, late):
    """Rows by arrival, up to ``late`` seconds after their time; then a heartbeat."""
    rng = random.Random(8)
    last = max(r[1] for r in rows) + 1
    parts = [[] for _ in range(batches)]
    for row in rows:
        parts[min(batches - 1, int((row[1] + rng.random() * late) * batches / last))].append(row)
    for part in parts:
        rng.shuffle(part)
    return [*parts, [("x", None, at(last + 1_000), None, None)]]


def drained(spark, df, name, tmp_path):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
    )
    query.processAllAvailable()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    return spark.table(name), states


def cells(df):
    rounded = [F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), 9).alias(c) for c in ("y_low", "y_high")]
    return sorted(map(str, df.select("session_id", "frame_number", *rounded).collect()))


def found(df):
    return sorted(map(tuple, df.select("session_id", "path_id", "start_frame", "end_frame").collect()))


def test_late_rows_over_many_batches_give_the_batch_result(spark, tmp_path):
    rows = frames_of()
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = written(spark, tmp_path / "in", dealt(rows, 8, late=15))
    paths = live.live_transitions(stream, "state", "a", "state", "b", delay="30 seconds")
    got, states = drained(spark, paths, "live_paths", tmp_path)
    assert found(got) == found(P.transitions(batch, "state", "a", "state", "b")) and len(states) >= 8
    window = live.live_window(stream, "v", 7, delay="30 seconds")
    got, states = drained(spark, window, "live_window", tmp_path)
    assert cells(got) == cells(S.trace_window(batch, "v", "frame_number", 7))


def test_state_does_not_grow_with_the_session(spark, tmp_path):
    """Frames within the delay wait; nothing else is kept but the queues and clocks."""
    few, many = ([f for f in frames_of(n) if f[0] == "x"] for n in (60, 200))
    most = []
    for name, rows in (("few", few), ("many", many)):
        stream = written(spark, tmp_path / name, dealt(rows, len(rows) // 20, late=5))
        _, states = drained(spark, live.live_window(stream, "v", 7, delay="25 seconds"), f"window_{name}", tmp_path)
        most.append(max(states))
    assert most[1] <= most[0] + 5


def test_rows_behind_the_watermark_are_dropped_and_repeats_count_once(spark, tmp_path):
    rows = [("x", i, at(i), "a" if i == 2 else "b" if i == 8 else "-", 1.0 * i) for i in range(10)]
    beats = [[("y", None, at(t), None, None)] for t in (51, 52, 900)]
    batches = [rows[:5], [*rows[6:], rows[6]], [("x", 50, at(50), "-", 50.0)], *beats[:2], [rows[5]], [("x", 60, at(60), "-", None)]]
    stream = written(spark, tmp_path / "in", [*batches, beats[2]])
    got, _ = drained(spark, live.live_window(stream, "v", 3, delay="10 seconds"), "late_window", tmp_path)
    kept = [0, 1, 2, 3, 4, 6, 7, 8, 9, 50, 60]
    assert sorted(r.frame_number for r in got.collect()) == kept
    assert {r.frame_number: (r.y_low, r.y_high) for r in got.collect()}[9] == pytest.approx((6.8, 9.2))
    got, _ = drained(spark, live.live_transitions(stream, "state", "a", "state", "b", delay="10 seconds"), "late_paths", tmp_path)
    assert found(got) == [("x", 0, 2, 8)]


def test_an_idle_session_is_forgotten(spark, tmp_path):
    def marks(start):
        return [("x", start + i, at(start + i), s, 1.0) for i, s in enumerate("ab-a")]

    beats = [[("y", None, at(t), None, None)] for t in (150, 160, 170, 900, 910)]
    batches = [marks(0), *beats[:3], marks(200), *beats[3:]]
    stream = written(spark, tmp_path / "in", batches)
    followed = live.live_transitions(stream, "state", "a", "state", "b", delay="10 seconds", idle="60 seconds")
    got, states = drained(spark, followed, "idle_paths", tmp_path)
    # The start at frame 3 is forgotten; the frames from 200 on are numbered anew.
    assert found(got) == [("x", 0, 0, 1), ("x", 0, 200, 201)] and states[-1] == 0
    kept = live.live_transitions(stream, "state", "a", "state", "b", delay="10 seconds")
    assert found(drained(spark, kept, "kept_paths", tmp_path)[0]) == [("x", 0, 0, 1), ("x", 1, 3, 201)]


def test_state_is_kept_by_group_whatever_the_number_of_sessions(spark, tmp_path):
    """Numbers beyond 2^53 and a session without an id stay what they are next to null frame numbers."""
    big = 2**60 + 1
    ids = [None, *(str(big + i) for i in range(150))]
    rows = [(s, big + k, at(k), mark, float(k)) for s in ids for k, mark in enumerate("a-ba")]
    late = [(s, big + 4, at(4), "b", None) for s in ids[::3]]
    stream = written(spark, tmp_path / "in", [rows, [*late, ("x", None, at(20), None, None)], [("x", None, at(900), None, None)]])
    stream = stream.withColumn("session_id", F.col("session_id").try_cast("bigint"))
    got, states = drained(spark, live.live_transitions(stream, "state", "a", "state", "b", delay="10 seconds", groups=3), "grouped_paths", tmp_path)
    want = {(s and int(s), 0, big, big + 2) for s in ids} | {(s and int(s), 1, big + 3, big + 4) for s in ids[::3]}
    found_rows = [tuple(r) for r in got.collect()]
    assert set(found_rows) == want and len(found_rows) == len(want)
    assert got.schema["session_id"].dataType.simpleString() == "bigint" and max(states) <= 3 * 8
    window = live.live_window(stream, "v", 2, delay="10 seconds", groups=3)
    got, states = drained(spark, window, "grouped_window", tmp_path)
    ends = {(r.session_id, r.frame_number - big): (r.y_low, r.y_high) for r in got.collect()}
    assert len(ends) == 4 * len(ids) + len(late) and max(states) <= 3 * 8
    assert ends[None, 2] == pytest.approx((0.9, 2.1)) and ends[big + 149, 0] == (-1.0, 1.0) and ends[big + 2, 4] == (2.0, 4.0)


def test_a_batch_reads_a_slice(spark, monkeypatch):
    monkeypatch.setattr(live_queries, "FILES", 2)
    monkeypatch.setattr(live_queries, "_folders", {})
    folder = Path(live_queries._arrivals(spark, "/root/testdata/sf0.001").removeprefix("file:"))
    assert len(list(folder.glob("*.parquet"))) <= 2 * live_queries.SLICES + 1
    assert spark.read.parquet(str(folder)).where("frame_number IS NOT NULL").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
