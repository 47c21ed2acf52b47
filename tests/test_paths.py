import math
import random

import pytest
from pyspark.sql import functions as F

from burrow.operators import paths as P


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def frames_of(spark, columns: dict, session="s"):
    """Frames from equal-length lists; schema given as name -> (type, values)."""
    n = len(next(iter(columns.values()))[1])
    schema = "session_id string, frame_number bigint, " + ", ".join(
        f"{name} {kind}" for name, (kind, _) in columns.items()
    )
    def value(kind, v):
        return float(v) if kind == "double" and v is not None else v

    rows = [(session, i, *[value(k, vals[i]) for k, vals in columns.values()]) for i in range(n)]
    return table(spark, schema, rows)


def pairs(df):
    rows = df.orderBy("session_id", "start_frame").collect()
    return [(r.start_frame, r.end_frame) for r in rows]


def greedy(starts, ends, first_end=True):
    """Plain loop over (frame) lists of booleans."""
    n, at, out = len(starts), 0, []
    while True:
        s = next((i for i in range(at, n) if starts[i]), None)
        if s is None:
            return out
        after = [i for i in range(s + 1, n) if ends[i]]
        if not after:
            return out
        e = after[0]
        if not first_end:
            nxt = next((i for i in range(s + 1, n) if starts[i]), n)
            inside = [i for i in after if i < nxt]
            e = inside[-1] if inside else after[0]
        out.append((s, e))
        at = e + 1


@pytest.mark.parametrize("first_end", [True, False])
@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_transitions_equal_greedy_loop(spark, first_end, chunk):
    rng = random.Random(chunk)
    rows, want = [], {}
    for case in range(150):
        n = rng.randint(1, 40)
        kinds = [rng.choice(["S", "E", "SE", "-", "-"]) for _ in range(n)]
        if case % 3 == 0:
            kinds = [k if k != "SE" else "S" for k in kinds]
        want[str(case)] = greedy(["S" in k for k in kinds], ["E" in k for k in kinds], first_end)
        rows += [(str(case), i, "S" if "S" in k else None, "E" if "E" in k else None) for i, k in enumerate(kinds)]
    df = table(spark, "session_id string, frame_number bigint, a string, b string", rows)
    got = {k: [] for k in want}
    found = P.transitions(df, "a", "S", "b", "E", first_end=first_end, chunk_frames=chunk)
    for r in found.orderBy("session_id", "path_id").collect():
        assert r.path_id == len(got[r.session_id])
        got[r.session_id].append((r.start_frame, r.end_frame))
    assert got == want


def test_golden_states(spark):
    df = frames_of(spark, {
        "state": ("string", ["exploring"] * 2 + ["moving"] * 2 + ["rewarded"] * 2),
        "node_id": ("int", [1, 2, 2, 3, 3, 4]),
        "zone": ("string", list("AAABBB")),
    })
    assert pairs(P.transitions(df, "state", "exploring", "state", "rewarded")) == [(0, 4)]
    assert pairs(P.transitions(df, "zone", "A", "zone", "B")) == [(0, 3)]
    distinct = P.transitions(df, "state", "exploring", "state", "rewarded", min_distinct={"node_id": 3})
    assert pairs(distinct) == [(0, 4)]
    assert pairs(P.transitions(df, "state", "exploring", "state", "rewarded", min_distinct={"node_id": 4})) == []
    assert pairs(P.transitions(df, "zone", "A", "zone", "B", min_length=4)) == []
    assert pairs(P.transitions(df, "zone", "A", "zone", "B", max_length=2)) == []
    with pytest.raises(ValueError):
        P.transitions(df, "nope", 1, "zone", "B")


def whole(spark, last, session="s"):
    return table(
        spark, "session_id string, path_id bigint, start_frame bigint, end_frame bigint", [(session, 0, 0, last)]
    )


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_golden_counts_and_distance(spark, chunk):
    df = frames_of(spark, {
        "node_id": ("int", [1, 1, 2, 2, 3, 3, 3, 4]),
        "x": ("double", [float(i) for i in range(8)]),
        "y": ("double", [0.0, 0, 1, 1, 2, 2, 3, 3]),
    })
    path = whole(spark, 7)
    assert P.distinct_in_path(df, path, "node_id", chunk_frames=chunk).first().distinct_values == 4
    assert P.changes_in_path(df, path, "node_id", chunk_frames=chunk).first().value_changes == 3
    seq = P.sequence_in_path(df, path, "node_id", chunk_frames=chunk).orderBy("pos").collect()
    assert [(r.pos, r.value) for r in seq] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    full = P.sequence_in_path(df, path, "node_id", collapse=False, chunk_frames=chunk).orderBy("pos").collect()
    assert [(r.pos, r.value) for r in full] == list(enumerate([1, 1, 2, 2, 3, 3, 3, 4]))
    d = P.distance_in_path(df, whole(spark, 3), chunk_frames=chunk).first().distance
    assert d == pytest.approx(2 + math.sqrt(2))


@pytest.mark.parametrize("chunk", [2, 1000])
def test_golden_gaps(spark, chunk):
    df = frames_of(spark, {
        "state": ("string", ["start", None, "moving", None, "moving", "goal"]),
        "node": ("int", [1, None, 2, None, 3, 4]),
        "x": ("double", [0.0, None, 10.0, None, 20.0, 30.0]),
        "y": ("double", [0.0, None, 5.0, None, 10.0, 15.0]),
    })
    found = P.transitions(df, "state", "start", "state", "goal", chunk_frames=chunk)
    assert pairs(found) == [(0, 5)]
    assert P.distinct_in_path(df, found, "node", chunk_frames=chunk).first().distinct_values == 4
    assert P.changes_in_path(df, found, "node", chunk_frames=chunk).first().value_changes == 3
    assert P.distance_in_path(df, found, chunk_frames=chunk).first().distance == pytest.approx(math.sqrt(125))


def test_golden_last_end(spark):
    df = frames_of(spark, {"s": ("string", ["start", "moving", "goal", "goal", "moving", "goal"])})
    assert pairs(P.transitions(df, "s", "start", "s", "goal")) == [(0, 2)]
    assert pairs(P.transitions(df, "s", "start", "s", "goal", first_end=False)) == [(0, 5)]


def test_golden_metrics(spark):
    df = frames_of(spark, {
        "node": ("int", [1, 2, 2, 3, 3, 4, 4, 5, 5, 5]),
        "x": ("double", [0.0, 10, 15, 20, 25, 30, 35, 40, 45, 50]),
        "y": ("double", [0.0, 0, 5, 5, 10, 10, 15, 15, 20, 20]),
        "state": ("string", ["start"] * 3 + ["moving"] * 4 + ["goal"] * 3),
    })
    sessions = table(spark, "session_id string, fps double, pixel_to_meter double", [("s", 30.0, None)])
    found = P.transitions(df, "state", "start", "state", "goal")
    assert P.time_in_path(found, sessions).first().seconds == pytest.approx(7 / 30)
    assert P.time_in_path(found).first().seconds == pytest.approx(7 / 30)
    assert P.velocity_in_path(df, found, sessions=sessions).first().velocity == pytest.approx(198.056586)
    metres = P.velocity_in_path(df, found, sessions=sessions, pixel_to_meter=0.01).first()
    assert metres.velocity == pytest.approx(1.98056586)
    assert P.values_in_path(df, found, "node").first().value == 5
    assert P.values_in_path(df, found, "node", "percentage", graph_totals=(10, 15)).first().value == 50
    assert P.values_in_path(df, found, "node", "other").count() == 0


def test_share_of_first_path(spark):
    df = frames_of(spark, {
        "s": ("string", ["a", None, "b", "a", None, "b"]),
        "v": ("int", [1, 1, 2, 1, 2, 3]),
    })
    found = P.transitions(df, "s", "a", "s", "b")
    got = P.values_in_path(df, found, "v", "percentage").orderBy("start_frame").collect()
    assert [r.value for r in got] == [100.0, 150.0]


def test_paths_over_many_chunks_equal_one_chunk(spark):
    rng = random.Random(5)
    rows = []
    for s in "xyz":
        for i in range(200):
            v = rng.choice([None, 1, 2, 3])
            rows.append((s, i, rng.choice("abcdefgh"), v, rng.random(), None if rng.random() < 0.1 else rng.random()))
    df = table(spark, "session_id string, frame_number bigint, k string, v int, x double, y double", rows)

    def answers(chunk):
        found = P.transitions(df, "k", "a", "k", "b", chunk_frames=chunk)
        out = [sorted(map(tuple, found.collect()))]
        for op in (P.distinct_in_path, P.changes_in_path, P.sequence_in_path):
            out.append(sorted(map(tuple, op(df, found, "v", chunk_frames=chunk).collect())))
        moved = P.distance_in_path(df, found, chunk_frames=chunk).withColumn("distance", F.round("distance", 9))
        out.append(sorted(map(tuple, moved.collect())))
        return out

    assert answers(6) == answers(10_000)


@pytest.mark.parametrize("chunk", (4, 8, 131_072))
def test_distance_over_gaps(spark, chunk):
    rows = [("s", f, float(i), 0.0) for i, f in enumerate((0, 1, 5, 9, 13, 17, 21))]
    df = table(spark, "session_id string, frame_number bigint, x double, y double", rows)
    found = table(spark, "session_id string, path_id bigint, start_frame bigint, end_frame bigint", [("s", 0, 0, 21)])
    assert P.distance_in_path(df, found, chunk_frames=chunk).first().distance == 6.0


def test_value_types(spark):
    df = frames_of(spark, {
        "text": ("string", ["3", "b", "3", "b"]),
        "number": ("double", [1, 2, 1, 2]),
        "flag": ("boolean", [True, False, True, False]),
    })
    assert pairs(P.transitions(df, "text", 3, "text", "b")) == []
    assert pairs(P.transitions(df, "number", 1, "number", "2.0")) == [(0, 1), (2, 3)]
    assert pairs(P.transitions(df, "flag", True, "flag", False)) == [(0, 1), (2, 3)]
