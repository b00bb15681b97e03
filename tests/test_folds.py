import random
import time

import pytest
from pyspark.sql import functions as F

from wayline.operators import folds
from wayline.operators import robot as R


def plain_anchors(times, width):
    out, anchor = {}, None
    for t in sorted(set(times)):
        if anchor is None or t - anchor > width:
            anchor = t
        out[t] = anchor
    return out


@pytest.mark.parametrize("seed", range(5))
def test_anchors_over_chunks_equal_one_pass(spark, seed):
    rng = random.Random(seed)
    times = [rng.randrange(rng.choice([300, 5000])) for _ in range(rng.choice([1, 40, 600]))]
    frame = spark.createDataFrame([(t,) for t in times] + [(None,)], "ts_us long")
    width = rng.choice([0, 3, 17, 90])
    assert {r.ts_us: r.anchor_us for r in folds.anchors_over_all(frame, width, chunks=rng.choice([1, 7, 30])).collect()} == plain_anchors(times, width)
    assert folds.anchors_over_all(frame.limit(0), width).collect() == []


def log(spark, n, keys=1):
    """One gapless log of n rows at 20 ms (or several), as long as a match day."""
    return spark.range(n).selectExpr(f"id % {keys} as log_id", "id * 20000 as ts_us", "id as seq", "id / 50D as x", "sin(id / 10D) as y", "abs(sin(id / 300D)) * 3 as wx", "0D as wy", "(id * 7919) % 1000 / 1D as v")


def timed(frame):
    began = time.perf_counter()
    rows = frame.agg(F.count("*"), F.sum("ts_us")).first()
    return rows, time.perf_counter() - began


def test_long_logs_take_linear_time(spark):
    run = {
        "slip": lambda n: R.slip_filters(log(spark, n), 1.0, 0.5, 2.0, 1.0), "dedup": lambda n: folds.anchored_dedup(log(spark, n), ["log_id"], 100_000), "anchors": lambda n: folds.anchors(log(spark, n), ["log_id"], 100_000),
        "peaks": lambda n: folds.peak_groups(log(spark, n), ["log_id"], 300_000, "v"), "all": lambda n: folds.anchors_over_all(log(spark, n), 100_000),
    }
    for name, make in run.items():
        timed(make(1000))
        (_, small), (rows, large) = timed(make(100_000)), timed(make(400_000))
        assert large < 6 * small + 3, (name, small, large)
    assert timed(run["dedup"](400_000))[0][0] == -(-400_000 // 6) and timed(run["slip"](400_000))[0][0] == 400_000


def test_slip_carries_over_batches(spark):
    rows = log(spark, 3000)
    whole = [tuple(r) for r in R.slip_filters(rows, 1.0, 0.5, 2.0, 1.0).orderBy("seq").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert [tuple(r) for r in R.slip_filters(rows, 1.0, 0.5, 2.0, 1.0).orderBy("seq").collect()] == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # The automaton, row by row.
    fx = fy = vx = vy = 0.0
    fast, gate, before = False, 0, None
    for r, got in zip(rows.orderBy("seq").collect(), whole):
        wheel = (r.wx**2 + r.wy**2) ** 0.5
        gate = 1 if wheel > 1 else 0 if wheel <= 0.5 else gate
        if before is None:
            fx = fy = vx = vy = 0.0
            fast = False
        elif gate:
            rx, ry = (r.x - before.x) / 0.02 - r.wx, (r.y - before.y) / 0.02 - r.wy
            raw = (rx * rx + ry * ry) ** 0.5
            fast = raw > 1.0 if fast else raw > 2.0
            w = 0.4 if fast else 0.9
            fx, fy = 0.8 * fx + 0.2 * rx, 0.8 * fy + 0.2 * ry
            vx, vy = w * vx + (1 - w) * rx, w * vy + (1 - w) * ry
            size = (vx * vx + vy * vy) ** 0.5
            if size > 5:
                vx, vy = vx * 5 / size, vy * 5 / size
        before = r
        assert got[5] == pytest.approx((fx * fx + fy * fy) ** 0.5, abs=1e-9) and got[6] == pytest.approx((vx * vx + vy * vy) ** 0.5, abs=1e-9) and got[7] == fast


def test_folds_take_nulls_ties_and_no_rows(spark):
    shape = "log_id string, ts_us long, seq long, v double, extra string"
    frame = spark.createDataFrame([(None, 5, 1, 2.0, "a"), (None, 5, 1, 2.0, "a"), ("k", 1, 1, None, "b"), ("k", 2, 2, 3.0, "b"), ("k", 2, 1, 3.0, None)], shape)
    assert sorted((r.log_id or "", r.ts_us, r.seq) for r in folds.anchored_dedup(frame, ["log_id"], 3).collect()) == [("", 5, 1), ("k", 1, 1)]
    assert sorted((r.log_id or "", r.ts_us, r.score) for r in folds.peak_groups(frame, ["log_id"], 3, "v").collect()) == [("", 5, 2.0), ("k", 1, None)]
    assert folds.anchors(frame.limit(0), ["log_id"], 3).collect() == []
