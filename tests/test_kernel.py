import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import kernel as K
from wayline.operators import robot as R


def series(spark, rows, value="v"):
    return spark.createDataFrame([("a", t, i, float(v)) for i, (t, v) in enumerate(rows)], f"log_id string, ts_us long, seq long, {value} double")


def ties(rng, n):
    return sorted((rng.randrange(40), rng.randrange(100)) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_asof_joins_equal_scans(spark, seed):
    rng = random.Random(seed)
    left, right = ties(rng, rng.choice([1, 20])), ties(rng, rng.choice([0, 1, 15]))
    a, b = series(spark, left), series(spark, right, "r")
    got = lambda frame: [r["r"] for r in frame.orderBy("seq").collect()]
    before = [([None] + [v for t, v in right if t <= at])[-1] for at, _ in left]
    assert got(K.asof_backward(a, b, ["log_id"], ["r"])) == before
    assert got(K.asof_backward(a, b, ["log_id"], ["r"], strict=True)) == [([None] + [v for t, v in right if t < at])[-1] for at, _ in left]
    assert got(K.asof_backward(a, b, ["log_id"], ["r"], clamp=True)) == [x if x is not None or not right else right[0][1] for x in before]
    assert got(K.asof_forward(a, b, ["log_id"], ["r"])) == [([v for t, v in right if t >= at] + ([right[-1][1]] if right else [None]))[0] for at, _ in left]
    nearest = []
    for at, _ in left:
        old, new = [x for x in right if x[0] < at], [x for x in right if x[0] >= at]
        pick = new[0] if new and (not old or new[0][0] - at <= at - old[-1][0]) else old[-1] if old else None
        nearest.append(pick[1] if pick and abs(pick[0] - at) <= 5 else None)
    assert got(K.asof_nearest(a, b, ["log_id"], ["r"], 5)) == nearest


@pytest.mark.parametrize("seed", range(2))
def test_range_join_equals_pairs(spark, seed):
    rng = random.Random(seed)
    left, right = ties(rng, 25), ties(rng, 25)
    b = series(spark, right, "r").select("log_id", F.col("ts_us").alias("r_ts_us"), F.col("seq").alias("r_seq"))
    found = sorted((r.seq, r.r_seq) for r in K.range_join(series(spark, left), b, ["log_id"], 3, 4).collect())
    assert found == sorted((i, j) for i, (s, _) in enumerate(left) for j, (t, _) in enumerate(right) if s - 3 <= t <= s + 4)


def test_interpolation_clamps_and_wraps(spark):
    path = spark.createDataFrame([("a", 10, 0, 0.0, 170.0), ("a", 20, 1, 10.0, -170.0)], "log_id string, ts_us long, seq long, x double, h double")
    found = K.interpolate_join(series(spark, [(5, 0), (10, 0), (15, 0), (20, 0), (30, 0)]), path, ["log_id"], ["x"], "h").orderBy("seq").collect()
    assert [r.p_x for r in found] == [0, 0, 5, 10, 10] and [round(r.p_h) % 360 for r in found] == [170, 170, 180, 190, 190]


def test_intervals_and_folds(spark):
    rows = series(spark, [(1, 0), (2, 90), (3, 50), (4, 10), (5, 85), (6, 90)])
    on, off = F.col("v") >= 80, F.col("v") < 30
    assert [(r.start_us, r.end_us) for r in K.hysteresis(rows, ["log_id"], on, off).orderBy("start_us").collect()] == [(2, 4), (5, 6)]
    assert [(r.start_us, r.end_us) for r in K.merge_close(K.hysteresis(rows, ["log_id"], on, off), ["log_id"], 2).collect()] == [(2, 6)]
    assert [(r.start_us, r.end_us, r.n, r.peak) for r in K.threshold_runs(rows, ["log_id"], F.col("v") > 40, "v", 1).orderBy("start_us").collect()] == [(2, 4, 2, 90.0), (5, 6, 2, 90.0)]
    times = series(spark, [(0, 1), (50, 9), (90, 3), (160, 2), (170, 8)])
    assert [r.ts_us for r in K.anchored_dedup(times, ["log_id"], 80).orderBy("ts_us").collect()] == [0, 90]
    assert [(r.ts_us, r.grp) for r in K.anchored_groups(times, ["log_id"], 80).orderBy("ts_us").collect()] == [(0, 1), (50, 1), (90, 2), (160, 2), (170, 2)]
    assert [(r.ts_us, r.score) for r in K.peak_groups(times, ["log_id"], 60, "v").orderBy("ts_us").collect()] == [(50, 9.0), (170, 8.0)]


def scan_launches(values, at=55, drop=8, floor=30, recovery=5, gap=80_000, window=5):
    """The automaton, one row after the other, as its description reads."""
    out, last, detecting, low, base, when = [], 0, False, None, 0, 0
    if len(values) < 3:
        return out
    tops = [max(v for _, v in values[max(0, i - window) : i + 1]) for i in range(len(values))]
    for i in range(1, len(values)):
        t, v = values[i]
        if not detecting:
            detecting = v >= at
        elif v < floor:
            detecting, low = False, None
        elif low is None:
            if tops[max(0, i - 2)] >= at and tops[max(0, i - 2)] - v >= drop:
                low, when, base = v, t, tops[max(0, i - 2)]
        else:
            if v < low:
                low, when = v, t
            if v - low >= recovery:
                if when - last >= gap:
                    out.append((when, low, base))
                    last = when
                low = None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_launches_equal_automaton(spark, seed):
    rng = random.Random(seed)
    values = [(20_000 * (i + 1), float(rng.choice([60, 62, 58, 50, 45, 40, 61, 29 if i % 17 == 0 else 57]))) for i in range(120)]
    frame = spark.createDataFrame([(1, "s", t, i, v) for i, (t, v) in enumerate(values)], "log_id long, signal string, ts_us long, seq long, v_double double")
    assert [(r.ts_us, r.dip, r.baseline) for r in R.launches(frame).orderBy("ts_us").collect()] == scan_launches(values)
    assert R.launches(frame.limit(2)).collect() == [] and R.launches(frame.limit(0)).collect() == []


def test_phases_drop_jitter_but_keep_the_gap(spark):
    words = [(1_000_000, 3), (16_000_000, 0), (16_050_000, 1), (30_000_000, 0), (30_020_000, 1), (60_000_000, 8 | 1)]
    modes = spark.createDataFrame([(1, t, i, w) for i, (t, w) in enumerate(words)], "log_id long, ts_us long, seq long, v_long long")
    ranges = spark.createDataFrame([(1, 0, 70_000_000)], "log_id long, first_us long, last_us long")
    found = [(r.phase, r.start_us, r.end_us) for r in R.match_phases(modes, ranges).orderBy("idx").collect()]
    assert found == [
        ("disabled", 0, 1_000_000), ("auto", 1_000_000, 16_000_000), ("disabled", 16_000_000, 16_050_000), ("teleop", 16_050_000, 30_020_000), ("teleop", 30_020_000, 60_000_000), ("disabled", 60_000_000, 70_000_000),
    ]


def test_asof_joins_of_a_long_log_are_linear(spark):
    n = 200_000
    left = spark.range(n).selectExpr("'a' as log_id", "id * 10 as ts_us", "id as seq", "id * 1.0D as v")
    right = spark.range(n).selectExpr("'a' as log_id", "id * 10 + 4 as ts_us", "id as seq", "id * 1.0D as r")
    near = K.asof_nearest(left, right, ["log_id"], ["r"], 5).agg(F.sum("r"), F.count("r")).first()
    assert tuple(near) == (sum(range(n)), n)
    ahead = K.asof_forward(left, right, ["log_id"], ["r"]).agg(F.sum("r")).first()[0]
    assert ahead == sum(range(n))
    path = right.select("log_id", "ts_us", "seq", F.col("r").alias("x"))
    assert K.interpolate_join(left, path, ["log_id"], ["x"]).where("abs(p_x - (seq - .4D)) > 1e-6 and seq > 0").count() == 0


def test_folds_work_by_stretches(spark):
    rng = random.Random(4)
    rows = sorted((rng.randrange(2000), rng.randrange(50)) for _ in range(300))
    kept, groups, last, anchor = [], [], None, None
    for t, _ in rows:
        if last is None or t - last > 7:
            kept.append(t)
            last = t
        if anchor is None or t - anchor > 7:
            anchor = t
            groups.append(t)
    frame = series(spark, rows)
    assert sorted(r.ts_us for r in K.anchored_dedup(frame, ["log_id"], 7).collect()) == kept
    found = K.anchored_groups(frame, ["log_id"], 7).collect()
    assert max(r.grp for r in found) == len(groups) and len(found) == 300
