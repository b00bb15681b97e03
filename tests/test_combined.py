import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.operators import basic as B
from wayline.operators import kernel as K
from wayline.operators import robot as R
from wayline.plans import more, reports, robots


@pytest.mark.parametrize("seed", range(3))
def test_many_streams_equal_scans(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: sorted((rng.randrange(60), i) for i in range(n))
    left, streams = draw(25), {n: draw(k) for n, k in (("a", 12), ("b", 1), ("c", 0))}
    frame = lambda rows, column: spark.createDataFrame([("k", t, i, float(i)) for t, i in rows] + [("other", 5, 99, 99.0)], f"log_id string, ts_us long, seq long, {column} double")
    found = K.asof_many(frame(left, "x").where("log_id = 'k'"), {n: (frame(rows, "v"), ["v"], 6) for n, rows in streams.items()}, ["log_id"])
    got = {r.seq: r for r in found.collect()}
    for t, i in left:
        for name, rows in streams.items():
            before, after = [r for r in rows if r[0] <= t][-1:], [r for r in rows if r[0] > t]
            after = [min(after, key=lambda r: (r[0], r[1]))] if after else []
            pick = after[0] if after and (not before or after[0][0] - t <= t - before[0][0]) else before[0] if before else None
            assert got[i][f"{name}_v"] == (float(pick[1]) if pick and abs(pick[0] - t) <= 6 else None), (name, t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def calibration(n, rng, offset, spread=True):
    rows = []
    for i in range(n):
        th, d = rng.uniform(-3, 3), rng.uniform(1, 4) if spread else 2.0
        f, left, yaw, pitch = offset
        a = th + 0.7
        rows.append((d, th, f * math.cos(th) - left * math.sin(th) - d * yaw * math.sin(a) + d * pitch * math.cos(a), f * math.sin(th) + left * math.cos(th) + d * yaw * math.cos(a) + d * pitch * math.sin(a)))
    return rows


def test_fit_recovers_known_offsets(spark):
    rng, offset = random.Random(1), (0.05, -0.02, 0.03, -0.01)
    rows = [("good", *r) for r in calibration(80, rng, offset)] + [("few", *r) for r in calibration(29, rng, offset)] + [("flat", *r) for r in calibration(60, rng, offset, spread=False)] + [(None, *r) for r in calibration(30, rng, offset)] + [("good", None, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "camera string, d double, th double, bx double, b_y double").withColumn("at", F.col("th") + 0.7)
    d, th, at = F.col("d"), F.col("th"), F.col("at")
    equations = [([F.cos(th), -F.sin(th), -d * F.sin(at), d * F.cos(at)], F.col("bx")), ([F.sin(th), F.cos(th), d * F.cos(at), d * F.sin(at)], F.col("b_y"))]
    found = {r.camera: r for r in B.fitted(frame, ["camera"], equations, 30).collect()}
    for key in ("good", None):
        assert found[key].rank == 4 and found[key].status == "success" and np.allclose(found[key].fit, offset, atol=1e-9) and found[key].rms_after < 1e-6 < found[key].rms_before
    assert found["few"].status == "insufficient" and found["few"].fit is None and found["few"].n == 29 and found["good"].n == 80
    # At one distance yaw and pitch can't be told from place: the fit says so and still explains the residuals.
    assert found["flat"].rank == 2 and found["flat"].rms_after < 1e-6
    assert B.fitted(frame.limit(0), ["camera"], equations, 30).collect() == []


def test_widest_separation_equals_all_pairs(spark):
    rng = random.Random(2)
    frames = [[rng.uniform(0, 360) for _ in range(rng.randint(0, 7))] for _ in range(200)] + [[350.0, 10.0], [0.0, 180.0, 181.0], [5.0], [], [359.0, 1.0, 0.0]]
    frame = spark.createDataFrame(list(enumerate(frames)), "i int, b array<double>")
    found = {r.i: r.w for r in frame.select("i", G.widest_separation_deg(frame.b).alias("w")).collect()}
    for i, b in enumerate(frames):
        pairs = [min((x - y) % 360, (y - x) % 360) for x, y in itertools.combinations(b, 2)]
        assert found[i] == pytest.approx(max(pairs, default=0.0))


def test_sigma_is_left_out_where_a_picture_is_not_to_be_used(spark):
    rows = [(1, 1.9, 0.1), (1, 2.1, 0.1), (2, 2.1, 0.1), (2, 1.0, 0.4)]
    found = spark.createDataFrame(rows, "n int, d double, w double").select(G.single_sigma(F.col("n"), F.col("d"), F.col("w"), F.col("d")).alias("s")).collect()
    assert [r.s is None for r in found] == [False, True, False, True] and found[0].s == pytest.approx(0.09 * 1.9 / 0.81)


SIGNALS = "log_id long, ts_us long, seq long, signal string, type string, v_bool boolean, v_long long, v_string string"


def phases(spark, rows, last=100_000_000):
    signals = spark.createDataFrame([(1, t, i, s, k, v if k == "boolean" else None, v if k == "int64" else None, v if k == "string" else None) for i, (t, s, k, v) in enumerate(rows)], SIGNALS)
    ranges = spark.createDataFrame([(1, 0, last)], "log_id long, first_us long, last_us long")
    found = R.timeline(R.mode_states(signals), ranges)
    return [(r.phase, r.start_us // 1_000_000, r.end_us // 1_000_000) for r in found.orderBy("idx").collect()], found


S = 1_000_000


@pytest.mark.parametrize(
    "rows, want",
    [
        # Enabled alone means teleop; auto and test say which; emergency stop and not being enabled end all.
        ([(5 * S, "DS:enabled", "boolean", True), (5 * S, "DSAutonomous", "boolean", True), (20 * S, "DSAutonomous", "boolean", False), (60 * S, "DS:enabled", "boolean", False)], [("disabled", 0, 5), ("auto", 5, 20), ("teleop", 20, 60), ("disabled", 60, 100)]),
        ([(5 * S, "DS:enabled", "boolean", True), (9 * S, "NT:/FMSInfo/Test", "boolean", True), (30 * S, "DS:e-stop", "boolean", True), (40 * S, "DS:e-stop", "boolean", False)], [("disabled", 0, 5), ("teleop", 5, 9), ("test", 9, 30), ("disabled", 30, 40), ("test", 40, 100)]),
        # Without a signal for enabled, the flags count by themselves.
        ([(5 * S, "DS:auto", "boolean", True), (20 * S, "DS:auto", "boolean", False), (21 * S, "DS:teleop", "boolean", True)], [("disabled", 0, 5), ("auto", 5, 20), ("disabled", 20, 21), ("teleop", 21, 100)]),
        # Booleans come before the word, the word before the name.
        ([(5 * S, "DS:auto", "boolean", True), (7 * S, "NT:/FMSInfo/FMSControlData", "int64", 1), (8 * S, "RobotMode", "string", "Test")], [("disabled", 0, 5), ("auto", 5, 100)]),
        ([(5 * S, "NT:/FMSInfo/FMSControlData", "int64", 3), (8 * S, "RobotMode", "string", "Test"), (20 * S, "NT:/FMSInfo/FMSControlData", "int64", 9)], [("disabled", 0, 5), ("auto", 5, 20), ("disabled", 20, 100)]),
        ([(5 * S, "RobotMode", "string", " Teleop"), (8 * S, "RobotMode", "string", "what"), (9 * S, "RobotMode", "string", None)], [("disabled", 0, 5), ("teleop", 5, 8), ("disabled", 8, 100)]),
        # A number that is called like a flag is none; a name that isn't the mode's neither.
        ([(5 * S, "DS:auto", "int64", 1), (6 * S, "OldRobotMode", "string", "Test")], []),
        # Only short states: disabled throughout.
        ([(0, "RobotMode", "string", "Test")], [("test", 0, 100)]),
    ],
)
def test_modes_by_source(spark, rows, want):
    assert phases(spark, rows)[0] == want


def test_short_states_only_and_flags(spark):
    ticks = [(t, "RobotMode", "string", "Teleop" if i % 2 else "Test") for i, t in enumerate(range(0, 400_000, 50_000))]
    assert [p for p, _, _ in phases(spark, ticks, 400_000)[0]] == ["disabled"]
    flags = lambda rows: R.match_flags(phases(spark, rows)[1]).first()
    whole = flags([(5 * S, "RobotMode", "string", "Autonomous"), (20 * S, "RobotMode", "string", "Teleop")])
    assert whole.has_match and whole.truncated and not whole.post_reboot and (whole.first_auto_us, whole.first_auto_end_us, whole.first_teleop_us) == (5 * S, 20 * S, 20 * S)
    half = flags([(5 * S, "RobotMode", "string", "Teleop")])
    assert half.post_reboot and not half.has_match
    assert not flags([(5 * S, "RobotMode", "string", "Test"), (9 * S, "RobotMode", "string", "Teleop")]).post_reboot


def test_running_commands_and_their_own_times(spark):
    events = spark.createDataFrame([(1, 10, 1, 0.03), (1, 20, 2, 0.05), (1, 30, 3, 0.1), (2, 5, 4, 0.1)], "log_id long, ts_us long, seq long, total_s double")
    snapshots = spark.createDataFrame([(1, 10, 1, ["Drive", "WaitCommand"]), (1, 15, 2, ["Drive"]), (1, 25, 3, []), (2, 9, 4, ["Drive"])], "log_id long, ts_us long, seq long, names array<string>")
    timings = spark.createDataFrame([(1, "Drive.execute()", 0.002), (1, "Drive.execute()", 0.004), (1, "Drive.periodic()", 9.0), (2, "Drive.execute()", 1.0)], "log_id long, component string, seconds double")
    found = {(r.log_id, r.name): r for r in R.command_correlation(events, snapshots, timings).collect()}
    assert set(found) == {(1, "Drive"), (1, "WaitCommand")}
    drive = found[1, "Drive"]
    assert (drive.overruns, drive.median_ms, drive.max_ms, drive.unnamed) == (2, 40.0, 50.0, False) and drive.execute_ms == pytest.approx(3.0) and found[1, "WaitCommand"].unnamed and found[1, "WaitCommand"].execute_ms is None


def test_categories_octants_and_epochs(spark):
    names = {
        "teleopInit()": "phase_init", "robotInit": "phase_init", "robotPeriodic()": "framework", "robotPeriodicExtra": "framework", "teleopPeriodic()": "framework", "Arm.teleopPeriodic()": "other", "LiveWindow.updateValues()": "framework",
        "SmartDashboard.updateValues()": "framework", "Shuffleboard.update()": "framework", "Arm.periodic()": "subsystem", "Drive.execute()": "command", "Drive.initialize()": "command", "LiveWindowX": "other",
    }
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", R.categorise(F.col("n")).alias("c"), R.is_top_level(F.col("n")).alias("t")).collect()
    assert {r.n: r.c for r in found} == names and {r.n for r in found if r.t} == {"teleopInit()", "robotInit", "robotPeriodic()", "teleopPeriodic()", "LiveWindow.updateValues()", "SmartDashboard.updateValues()", "Shuffleboard.update()"}
    degrees = {0.0: "N", 22.4: "N", 22.5: "NE", 90.0: "E", 135.0: "SE", 180.0: "S", -180.0: "S", -90.0: "W", -45.0: "NW", 337.5: "N", -0.5: "N"}
    assert {r.d: r.o for r in spark.createDataFrame([(d,) for d in degrees], "d double").select("d", G.octant(F.col("d")).alias("o")).collect()} == degrees
    lines = [(1, 0, 1, "Loop time of 0.02s overrun\n  a(): 0.050000s\n  a(): 0.010000s\n  b(): 0.020000s"), (1, 100, 2, "  b(): 0.010000s\n  a(): 0.005000s"), (1, 200, 3, "  b(): 0.030000s"), (1, 600_000, 4, "  a(): 0.900000s")]
    console = spark.createDataFrame(lines, "log_id long, ts_us long, seq long, text string")
    assert {r.component: r.seconds for r in R.epochs(R.overrun_messages(console)).collect()} == {"a()": 0.01, "b()": 0.03}


def test_previous_looks_over_gaps_and_partitions(spark):
    rng = random.Random(5)
    ids = sorted(rng.sample(range(10_000), 300))
    frame = spark.createDataFrame([(i, i * 2.0) for i in ids], "log_id long, m double").repartition(9)
    found = {r.log_id: r.was for r in B.previous(frame, "log_id", {"was": "m"}).collect()}
    assert found == {i: (ids[k - 1] * 2.0 if k else None) for k, i in enumerate(ids)}
    assert B.previous(frame.limit(0), "log_id", {"was": "m"}).collect() == []


def test_mean_recovery_on_a_rounding_limit_is_exact(spark, monkeypatch):
    times = [1_457_628, 1_083_388, 945_491, 468_076]  # 988.64575 ms in the mean; sums of milliseconds come out below it
    rows = [(1, "a", k * 10_000_000, k, 50.0, 100.0, k * 10_000_000 + t, 100.0) for k, t in enumerate(times)]
    rows.append((2, "a", 0, 9, 50.0, 100.0, 5, 60.0))  # never back
    near = spark.createDataFrame(rows, "log_id long, signal string, ts_us long, seq long, dip double, baseline double, r_ts_us long, v_double double")
    monkeypatch.setattr(more, "responses", lambda *_: near.drop("seq"))
    monkeypatch.setattr(robots, "launch_events", lambda *_: near.drop("r_ts_us", "v_double"))
    (row,) = reports.throughput_bottleneck(spark, "").collect()
    assert (row.n, row.recovery_ms, row.interval_ms) == (5, 988.6458, 10_000.0)
