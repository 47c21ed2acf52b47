import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burrow.functions import angles as A
from burrow.operators import chunks
from burrow.operators import frames as FR
from burrow.operators import metrics as M
from burrow.operators import series as S
from burrow.operators.chunks import previous_row, running_sum, with_chunk, with_ordinal
from burrow.operators.skew import hot_keys, salted_join
from tests.test_paths import table

CHUNKS = [3, 5, 1000]


def angle_table(spark, rng, n=40):
    values = {s: [rng.uniform(-400, 400) for _ in range(n)] for s in "ab"}
    rows = [(s, i, v) for s, vs in values.items() for i, v in enumerate(vs)]
    return values, table(spark, "session_id string, pos bigint, a double", rows)


def by_session(df, column):
    out = {}
    for r in df.orderBy("session_id", "pos").collect():
        out.setdefault(r.session_id, []).append(r[column])
    return out


@pytest.mark.parametrize("chunk", CHUNKS)
def test_unwrap_gradient_smooth_equal_numpy(spark, chunk):
    values, df = angle_table(spark, random.Random(1))
    got = by_session(S.unwrap(df, "a", "pos", chunk_frames=chunk), "unwrapped")
    turned = {s: np.rad2deg(np.unwrap(np.deg2rad(v))) for s, v in values.items()}
    for s in values:
        np.testing.assert_allclose(got[s], turned[s], atol=1e-8)
    got = by_session(S.angular_velocity(df, "a", "pos", dt=0.5, chunk_frames=chunk), "velocity")
    for s in values:
        np.testing.assert_allclose(got[s], np.gradient(turned[s]) / 0.5, atol=1e-8)
    uneven = df.withColumn("t", F.col("pos") + F.col("pos") % 3 * 0.2)
    got = by_session(S.angular_velocity(uneven, "a", "pos", position="t", chunk_frames=chunk), "velocity")
    at = np.array([i + i % 3 * 0.2 for i in range(40)])
    for s in values:
        np.testing.assert_allclose(got[s], np.gradient(turned[s], at), atol=1e-7)
    for k in (2, 3, 6, 7):
        got = by_session(S.smooth(df, "a", "pos", k, chunk_frames=chunk), "smoothed")
        for s, v in values.items():
            np.testing.assert_allclose(got[s], np.convolve(v, np.ones(k) / k, mode="same"), atol=1e-8)


def test_angle_goldens(spark):
    wrapped = table(spark, "i int, a double", [(0, 270.0), (1, 360.0), (2, -200.0), (3, 180.0)])
    assert [r[0] for r in wrapped.orderBy("i").select(A.wrap(F.col("a"))).collect()] == [-90.0, 0.0, 160.0, -180.0]
    df = table(spark, "session_id string, pos bigint, a double", [("s", i, a) for i, a in enumerate((350.0, 10.0, 20.0))])
    assert by_session(S.unwrap(df, "a", "pos"), "unwrapped")["s"] == [350.0, 370.0, 380.0]
    quaternions = [(1.0, 0.0, 0.0, 0.0), (0.9239, 0.0, 0.0, 0.3827), (0.7071, 0.0, 0.0, 0.7071), (0.0, 0.0, 1.0, 0.0), (-0.7071, 0.0, 0.0, 0.7071), (0.0, 0.0, 0.0, 0.0)]
    rows = [("s", i, *q) for i, q in enumerate(quaternions)]
    samples = table(spark, "session_id string, pos bigint, qw double, qx double, qy double, qz double", rows)
    raw = FR.head_orientation(samples).orderBy("pos").collect()
    yaw = FR.head_orientation(samples, offset=A.YAW_OFFSET).orderBy("pos").collect()
    for i, (r, y, roll) in enumerate([(0, -167, 0), (45.000856, 147.999144, 0), (90, 103, 0), (180, 13, 180), (-90, -77, 0)]):
        assert abs(raw[i].yaw) == pytest.approx(abs(r), abs=1e-5)
        assert yaw[i].yaw == pytest.approx(y, abs=1e-5)
        assert raw[i].pitch == pytest.approx(0, abs=1e-9)
        assert abs(raw[i].roll) == pytest.approx(roll, abs=1e-9)
    assert raw[5].yaw is None


@pytest.mark.parametrize("chunk", CHUNKS)
def test_trail_and_window_over_chunks(spark, chunk):
    rng = random.Random(4)
    rows = [("s", "A", i * rng.randint(1, 1) + i // 3, float(i), 0.0) for i in range(30)]
    df = table(spark, "session_id string, bodypart string, frame_number bigint, x double, y double", rows)
    for r in S.trail(df, 4, chunk_frames=chunk).collect():
        nth = int(r.x)
        assert [p.x for p in r.trail] == [float(i) for i in range(max(0, nth - 3), nth + 1)]
        assert r.trail[-1].weight == 1.0
    dense = table(spark, "session_id string, frame_number bigint, v double", [("s", i, float(i % 7)) for i in range(30)])
    for r in S.trace_window(dense, "v", "frame_number", 5, continuous=True, chunk_frames=chunk).collect():
        seen = [float(i % 7) for i in range(max(0, r.frame_number - 4), r.frame_number + 1)]
        pad = (max(seen) - min(seen)) * 0.1 if max(seen) != min(seen) else 1.0
        assert (r.y_low, r.y_high) == (pytest.approx(min(seen) - pad), pytest.approx(max(seen) + pad))
        assert r.x_offset == max(0, r.frame_number - 4)
    fixed = S.trace_window(dense, "v", "frame_number", fixed=(0, 1)).first()
    assert (fixed.y_low, fixed.y_high) == (0.0, 1.0)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_speed_over_chunks(spark, chunk):
    rng = random.Random(8)
    xs = [rng.random() for _ in range(40)]
    df = table(spark, "session_id string, frame_number bigint, x double, y double", [("s", i, x, 0.0) for i, x in enumerate(xs)])
    got = FR.frame_speed(df, chunk_frames=chunk).orderBy("frame_number").collect()
    speed = [None] + [abs(b - a) for a, b in zip(xs, xs[1:])]
    for i, r in enumerate(got):
        assert r.speed == (None if i == 0 else pytest.approx(speed[i]))
        span = speed[i - 5:i + 5] if i >= 5 else []
        want = sum(span) / 10 if len(span) == 10 and None not in span else None
        assert r.smooth_speed == (None if want is None else pytest.approx(want))


def test_chunk_helpers_with_gaps(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.randint(-5, 5)) for k in "pq" for i in sorted(rng.sample(range(100), 40))]
    df = table(spark, "k string, i bigint, v bigint", rows).transform(with_chunk, "i", 6)
    lagged = {(r.k, r.i): r.pv for r in previous_row(df, ["k"], "i", {"v": "pv"}).collect()}
    summed = {(r.k, r.i): r.total for r in running_sum(df, ["k"], "i", "v", "total").collect()}
    for key in "pq":
        before, total = None, 0
        for k, i, v in rows:
            if k == key:
                total += v
                assert lagged[k, i] == before and summed[k, i] == total
                before = v


def test_ordinals_of_a_hot_key(spark):
    rng = random.Random(10)
    rows = [("hot", rng.random(), i) for i in range(3000)] + [(f"k{i % 40}", rng.random(), i) for i in range(400)]
    df = table(spark, "k string, t double, id bigint", rows).repartition(6)
    got = {}
    for r in with_ordinal(df, ["k"], ["t", "id"], "n").collect():
        got.setdefault(r.k, []).append((r.n, r.t, r.id))
    for key in {r[0] for r in rows}:
        want = sorted((t, i) for k, t, i in rows if k == key)
        assert sorted(got[key]) == [(n, *w) for n, w in enumerate(want)]


@pytest.mark.parametrize("target, spread", [(2_000, True), (1 << 20, False)])
def test_ordinals_write_hot_keys_only(spark, monkeypatch, target, spread):
    rows = [("hot", i % 7, i) for i in range(3000)] + [(k, -i, i) for k in ("a", "b", None) for i in range(50)]
    df = table(spark, "k string, t int, id bigint", rows).repartition(5)
    written = []
    kept = chunks.materialise
    monkeypatch.setattr(chunks, "materialise", lambda d, label: written.extend([label, d.select("k").distinct().count()]) or kept(d, label))
    out = with_ordinal(df, ["k"], ["t", "id"], "n", target=target)
    assert written == (["ordered", 1] if spread else [])
    if not spread:
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {}
    for r in out.collect():
        got.setdefault(r.k, []).append((r.n, r.t, r.id))
    assert {k: sorted(v) for k, v in got.items()} == {
        key: [(n, *w) for n, w in enumerate(sorted((t, i) for k, t, i in rows if k == key))] for key in ("hot", "a", "b", None)
    }


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("most, parts", [(100, 33), (1 << 20, 4)])
def test_ordinals_are_dealt_to_tasks_by_rows(spark, monkeypatch, most, parts, hot):
    written = []
    kept = chunks.materialise
    monkeypatch.setattr(chunks, "TASK_ROWS", most)
    monkeypatch.setattr(chunks, "materialise", lambda d, label: written.append(d.rdd.getNumPartitions()) or kept(d, label))
    rows = [(0 if hot and i > 300 else i % 60, -i, i) for i in range(3300)]
    out = with_ordinal(table(spark, "k int, t int, id bigint", rows), ["k"], ["t", "id"], "n", target=1000)
    if hot:
        assert written == [parts]
    else:
        assert written == [] and out.rdd.getNumPartitions() == parts
    got = {}
    for r in out.collect():
        got.setdefault(r.k, []).append((r.n, r.t, r.id))
    assert {k: sorted(v) for k, v in got.items()} == {
        key: [(n, *w) for n, w in enumerate(sorted((t, i) for k, t, i in rows if k == key))] for key in range(60)
    }


def test_salted_join_keeps_every_row(spark):
    big = table(spark, "k string, i bigint", [("hot", i) for i in range(500)] + [("b", 1), ("lonely", 2)])
    small = table(spark, "k string, w int", [("hot", 1), ("hot", 2), ("b", 3)])
    hot, _ = hot_keys(big, ["k"], 50)
    assert [(r.k, r._salts) for r in hot.collect()] == [("hot", 10)]
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, ["k"], how).collect()))
        assert sorted(map(str, salted_join(big, small, ["k"], ["i"], how, 50).collect())) == want
    many = table(spark, "k string, i bigint", [(f"k{i % 30}", i) for i in range(900)])
    hot, target = hot_keys(many, ["k"], 10, limit=5)
    assert hot is None and target == 180  # a fifth of all rows


def test_mask_and_derived_bodypart(spark):
    rows = [("s", 0, "A", 1.0, 2.0, 0.9), ("s", 0, "B", 3.0, 6.0, 0.2), ("s", 1, "A", None, None, None), ("s", 1, "B", 5.0, 5.0, 0.1)]
    pose = table(spark, "session_id string, frame_number bigint, bodypart string, x double, y double, likelihood double", rows)
    masked = FR.mask_unlikely(pose, 0.3)
    made = {r.frame_number: r for r in FR.derived_bodypart(masked, "mid", ["A", "B"]).where("bodypart = 'mid'").collect()}
    assert (made[0].x, made[0].y, made[0].likelihood) == (1.0, 2.0, 0.2)
    assert (made[1].x, made[1].likelihood) == (None, 0.1)
    assert FR.mask_unlikely(pose, 0).where("x is null").count() == 1
    assert FR.derived_bodypart(pose, "mid", []).count() == 4
    with pytest.raises(ValueError):
        FR.derived_bodypart(pose, "mid", ["A"], "median")


def test_missing_values_are_null(spark):
    df = table(spark, "x double", [(float("nan"),), (1.0,), (None,)])
    assert FR.no_nan(df, "x").where("x is null").count() == 2


def test_assembly_needs_required_sources(spark):
    base = table(spark, "session_id string, frame_number bigint", [("s", 0), ("s", 1)])
    yaw = table(spark, "session_id string, frame_number bigint, yaw double", [("s", 0, 1.0), ("s", 5, 2.0)])
    out = FR.assemble(base, [(yaw, ["yaw"], True), (None, ["c"], False)])
    assert sorted((r.frame_number, r.yaw) for r in out.collect()) == [(0, 1.0), (1, None)]
    with pytest.raises(ValueError):
        FR.assemble(base, [(None, ["c"], True)])


def test_flat_footprints_have_no_mask(spark):
    rows = [("s", 1, 0, x, 0.5) for x in range(4)] + [("s", 2, 0, x, float(x)) for x in range(4)]
    mask = FR.footprint_mask(table(spark, "session_id string, unit_id bigint, y int, x int, w double", rows))
    # Levels 85, 170, 255 over zero; the median is 170 and only more than that stays.
    assert [(r.unit_id, r.x) for r in mask.collect()] == [(2, 3)]


def test_exploration_rules(spark):
    df = table(spark, "session_id string, frame_number bigint, node int, zone string", [("s", 0, 1, "a"), ("s", 1, 2, None), ("s", 2, 2, "a")])
    assert M.exploration(df, "node", total=4).first().exploration == 50.0
    assert M.exploration(df, "node", graph_totals=(8, 3)).first().exploration == 25.0
    assert M.exploration(df, "zone", graph_totals=(8, 3)).first().exploration == 1.0
    assert M.exploration(df, "node", total=0).first().exploration == 0.0
    assert M.exploration(df, "nothing").first().exploration == 0.0


def test_user_metrics_and_bad_arguments(spark):
    df = table(spark, "session_id string, frame_number bigint, state string", [("s2", 0, "a"), ("s2", 1, "b"), ("s10", 0, "a"), ("s10", 1, "b")])

    @M.session_metric("frames_seen")
    def frames_seen(frames, context, scale=1.0):
        return frames.groupBy("session_id").agg((F.count("*") * scale).alias("value")).withColumn("path_id", F.lit(None).cast("bigint"))

    @M.cross_session_metric("total")
    def total(metrics, metric_name):
        return metrics.where(F.col("metric") == metric_name).agg(F.sum("value").alias("value"))

    out = M.battery(M.Context(df), {"n": ("frames_seen", {"scale": 2.0})})
    assert sorted((r.session_id, r.value) for r in out.collect()) == [("s10", 4.0), ("s2", 4.0)]
    assert M.CROSS_METRICS["total"](out, "n").first().value == 8.0
    order = [r.session_id for r in M.learning_progression(out, "n").orderBy("pos").collect()]
    assert order == ["s2", "s10"]
    with pytest.raises(TypeError):
        M.battery(M.Context(df), {"n": ("frames_seen", {"a": 1})})
    one = table(spark, "session_id string", [("s",)])
    assert M.if_many_sessions(out, one).isEmpty()
    assert not M.if_many_sessions(out, df).isEmpty()


@pytest.mark.parametrize("chunk", (4, 8, 131_072))
def test_rows_not_frames_are_counted_over_gaps(spark, chunk):
    at = [0, 1, 5, 9, 13, 17, 21, 40, 41, 90]
    xs = [float(i * i % 7) for i in range(len(at))]
    df = table(spark, "session_id string, frame_number bigint, x double, y double", [("s", f, x, 0.0) for f, x in zip(at, xs)])
    speed = {r.frame_number: r for r in FR.frame_speed(df, window=3, chunk_frames=chunk).collect()}
    steps = [None] + [abs(b - a) for a, b in zip(xs, xs[1:])]
    assert [speed[f].speed for f in at] == steps
    for i in range(2, len(at) - 1):
        assert speed[at[i]].smooth_speed == pytest.approx(sum(steps[i - 1:i + 2]) / 3)
    window = {r.frame_number: r for r in S.trace_window(df, "x", "frame_number", 3, margin=0.0, fixed=None, chunk_frames=chunk).collect()}
    for i, f in enumerate(at):
        seen = xs[max(0, i - 2):i + 1]
        if min(seen) != max(seen):
            assert (window[f].y_low, window[f].y_high) == (min(seen), max(seen))
    smooth = {r.frame_number: r.smoothed for r in S.smooth(df, "x", "frame_number", 3, chunk_frames=chunk).collect()}
    for i, f in enumerate(at):
        assert smooth[f] == pytest.approx(sum(xs[max(0, i - 1):i + 2]) / 3)
    turned = {r.frame_number: r.unwrapped for r in S.unwrap(df.withColumn("a", F.col("x") * 170), "a", "frame_number", chunk_frames=chunk).collect()}
    for a, b in zip(at, at[1:]):
        assert abs(turned[b] - turned[a]) <= 180


def test_every_unit_in_every_frame_without_a_shuffle_of_pairs(spark):
    frames = table(spark, "session_id string, frame_number bigint", [("a", 0), ("a", 1), ("a", 1), ("a", None), ("b", 0), ("c", 0), (None, 0)])
    traces = table(
        spark,
        "session_id string, unit_id bigint, frame_number bigint, c double",
        [("a", 1, 0, 0.5), ("a", 1, 0, 0.7), ("a", 2, 1, None), ("a", 9, 0, 0.1), ("a", None, 0, 0.4), ("b", 1, 1, 0.3), (None, 1, 0, 0.2)],
    )
    contours = table(
        spark, "session_id string, unit_id bigint, contour array<int>", [("a", 1, [1]), ("a", 1, [2]), ("a", 2, None), ("a", None, [3]), ("b", 1, []), (None, 1, [4])]
    )
    out = FR.modulated_footprints(frames, traces, contours)
    assert out.columns == ["session_id", "frame_number", "unit_id", "contour", "activity"]
    want = []
    for s, f in [tuple(r) for r in frames.collect()]:
        for t, u, ring in [tuple(r) for r in contours.collect()]:
            if s is not None and s == t:
                met = [c for a, v, n, c in traces.collect() if (a, v, n) == (s, u, f) and None not in (u, f)]
                want += [(s, f, u, ring, c or 0.0) for c in met or [None]]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if " Exchange " in line]
    assert dealt and not any("frame_number" in line and "unit_id" in line for line in dealt)
