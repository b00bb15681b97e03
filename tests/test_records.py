import math
import random

from pyspark.sql import functions as F

from wayline.functions import arrays as N
from wayline.functions import geometry as G
from wayline.operators import clocks as C
from wayline.operators import export as X
from wayline.operators import robot as R
from wayline.sources import ds_logs as D
from wayline.sources import files as P
from wayline.sources import raw


def test_names_tell_kind_start_bus_and_label(spark):
    hexes = "0123456789abcdefABCDEF0123456789"
    rows = [
        ("/a/FRC_20260321_140501.wpilog", "wpilog", 1774101901, "FRC", "Practice_140501"), ("/a/FRC_20261321_140501.wpilog", "wpilog", 0, "FRC", "Practice_140501"),
        ("/b c/2026_03_21 14_05_01 Sat.dslog", "dslog", 1774101901, "2026", "2026_03_21 14_05_01 Sat.dslog"), ("rio_2026-03-21_14-05-01.hoot", "hoot", 1774101901, "rio", "rio_2026-03-21_14-05-01.hoot"),
        (f"{hexes}_2026-03-21_14-05-01.hoot", "hoot", 1774101901, hexes, f"{hexes}_2026-03-21_14-05-01.hoot"), ("x_EVENT_Q12_y.WPILOG", "wpilog", None, "x", "Q12"), ("notes.txt", None, None, "notes", "notes.txt"),
    ]
    frame = spark.createDataFrame([(r[0],) for r in rows], "path string")
    path = F.col("path")
    got = frame.select("path", P.kind(path).alias("k"), P.start_s(path).alias("s"), P.bus(path).alias("b"), P.label(path, "EVENT").alias("l")).collect()
    assert [tuple(r) for r in got] == rows
    assert [r.kind for r in P.by_kind(frame).collect()] == ["dslog", "hoot", "hoot", "wpilog", "wpilog", "wpilog"]


def test_records_follow_their_entry(spark):
    starts = spark.createDataFrame([("l", 10, 1, 5, "a", "double"), ("l", 20, 2, 5, "b", "int64"), ("l", 30, 3, 6, "a", "string"), ("l", 40, 4, 7, "s", "struct:Pose2d")], "log_id string, ts_us long, seq long, entry_id long, name string, type string")
    data = spark.createDataFrame(
        [("l", 5, 10, 5, "1"), ("l", 15, 11, 5, "1.5"), ("l", 25, 12, 5, "7"), ("l", 26, 13, 5, "x"), ("l", 35, 14, 6, "2.5"), ("l", 45, 15, 7, "raw"), ("l", 50, 16, 9, "1")], "log_id string, ts_us long, seq long, entry_id long, payload string"
    )
    rows = {r.seq: r for r in raw.decode(raw.resolve(starts, data)).collect()}
    assert {s: (r.name, r.type) for s, r in rows.items()} == {11: ("a", "double"), 12: ("b", "int64"), 13: ("b", "int64"), 14: ("a", "double"), 15: ("s", "struct:Pose2d")}
    assert rows[11].v_double == 1.5 and rows[12].v_long == 7 and rows[13].v_long is None and bytes(rows[13].v_bin) == b"x" and rows[14].v_double == 2.5 and bytes(rows[15].v_bin) == b"raw"


def test_arrays_have_rules(spark):
    values = [[1.0, 2.0, 190.0], [1.0, 2.0], None, []]
    got = [r.p for r in spark.createDataFrame([(v,) for v in values], "v array<double>").select(N.pose(F.col("v")).alias("p")).collect()]
    assert got[1:] == [None] * 3 and math.isclose(got[0].theta, math.radians(-170))
    cameras = [([1.0, 2, 0, 0, 0, 90, 25, 1, 0, 4, 0], None, 0.6 * 0.8), ([1.0, 2, 0, 0, 0, 90, 25, 3, 0, 6, 0], 0.0005, 0.3 * 0.5), ([0.0] * 11, None, None), ([1.0, 2, 0, 0, 0, 90, 25], None, None), ([1.0, 2, 3], None, None)]
    frame = spark.createDataFrame([([*map(float, v)], a) for v, a, _ in cameras], "v array<double>, a double").select(N.camera_pose(F.col("v"), F.col("a")).alias("p"))
    for row, (_, _, wanted) in zip(frame.collect(), cameras):
        assert (row.p is None) == (wanted is None) and (wanted is None or math.isclose(row.p.confidence, wanted) and row.p.latency_us == 25000)
    lists = [[31, 0, 0, 1, 2, 2, 0, 99, 0, 0, 1, 2, 2, 0, 1, 0, 0, 1, 2, 2, 0, 7], [99, 0, 0, 1, 2, 2, 0], []]
    tags = spark.createDataFrame([([*map(float, v)],) for v in lists], "v array<double>")
    places = [r.p for r in tags.select(N.field_places(G.tag_structs(F.col("v"))).alias("p")).collect()]
    assert [tuple(p) for p in places[0]] == [N.TAG_PLACES[30], N.TAG_PLACES[0]] and places[1:] == [None, None]


def edge_rows(spark, rows):
    return spark.createDataFrame([(0, t, i, on) for i, (t, on) in enumerate(rows)], "set_id long, ts_us long, seq long, on_ boolean")


def test_edges_align(spark):
    a, b = edge_rows(spark, [(1100, True), (1500, False), (2000, True)]), edge_rows(spark, [(100, True), (500, False), (1000, True)])
    found = C.align(a, b, 5_000_000).first()
    assert (found.off, found.matched, found.sq, found.n) == (1000, 3, 0, 3)
    sets = spark.createDataFrame([(0, "station"), (1, "rio"), (2, "bus")], "set_id long, device string")
    clocks = spark.createDataFrame([(0, 77)], "set_id long, offset_us long")
    got = {r.set_id: (r.method, r.offset_us, r.confidence) for r in C.alignments(sets, clocks, C.align(a, b, 5_000_000)).collect()}
    assert got == {0: ("system_time", 77, 1.0), 1: ("assumed_zero", 0, 0.5)}


def test_message_text_and_commands(spark):
    texts = ["<TagVersion>1 <time>2 <message> Hi <b> there", "<details> x<flags>y", " plain ", "a<count>3<message> z"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.clean_text(F.col("t")).alias("t")).collect()]
    assert got == ["Hi <b> there", "x", "plain", "az"]
    lines = spark.createDataFrame([("l", i, i, t) for i, t in enumerate(["Command interrupted: Drive; Cause: Shoot", "Command initialized: A; Cause: b", "Command finished:  Print", "other"])], "log_id string, ts_us long, seq long, text string")
    assert [(r.kind, r.name) for r in R.commands(lines).orderBy("seq").collect()] == [("interrupted", "Drive"), ("initialized", "A; Cause: b"), ("finished", "Print")]
    near = ["DataLog: x", "CAN frame", "canopy", "ntcore", "low VOLTAGE", "Error 4", "fine"]
    kinds = [r.k for r in spark.createDataFrame([(t,) for t in near], "t string").select(R.classify_nearby(F.col("t")).alias("k")).collect()]
    assert kinds == ["datalog", "can", None, "nt", "brownout", "warning", None]


def test_slip_filters_equal_a_loop(spark):
    rng, t, rows = random.Random(2), 0, []
    for i in range(120):
        t += rng.choice([5_000, 20_000, 20_000, 50_000, 300_000])
        rows.append(("l", t, i, rng.random(), rng.random(), rng.choice([0.0, 0.2, 3.0]), rng.random()))
    frame = spark.createDataFrame(rows, "log_id string, ts_us long, seq long, x double, y double, wx double, wy double")
    got = {r.seq: r for r in R.slip_filters(frame, enter=1.0, leave=0.5, fast_enter=2.0, fast_leave=1.0).collect()}
    fx = fy = vx = vy = 0.0
    fast = gate = False
    for before, row in zip([None, *rows], rows):
        _, t, i, x, y, wx, wy = row
        dt = (t - before[1]) / 1e6 if before else None
        wheel = math.hypot(wx, wy)
        gate = wheel > 0.5 if gate else wheel > 1.0
        valid = dt is not None and 0.002 < dt < 0.1
        if not valid:
            fx = fy = vx = vy = 0.0
            fast = False
        elif gate:
            rx, ry = (x - before[3]) / dt - wx, (y - before[4]) / dt - wy
            fx, fy = 0.8 * fx + 0.2 * rx, 0.8 * fy + 0.2 * ry
            fast = math.hypot(rx, ry) > (1.0 if fast else 2.0)
            w = 0.4 if fast else 0.9
            vx, vy = w * vx + (1 - w) * rx, w * vy + (1 - w) * ry
            size = math.hypot(vx, vy)
            if size > 5:
                vx, vy = vx * 5 / size, vy * 5 / size
        assert math.isclose(got[i].slip_fixed, math.hypot(fx, fy), abs_tol=1e-9) and math.isclose(got[i].slip, math.hypot(vx, vy), abs_tol=1e-9) and got[i].fast == fast


def test_exports(spark):
    rows = spark.createDataFrame([(1, "b", 2, 'say "x", y', 7), (1, "a", 3, "z", 8), (2, "a", 1, None, 9)], "log_id long, signal string, timestamp_us long, value string, seq long")
    back = X.read_csv(spark, X.write_csv(rows, "log_id"), "signal string, timestamp_us long, value string, seq long, log_id long")
    assert sorted(map(tuple, back.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    nested = spark.createDataFrame([(1, (5, (2.5, (9,)), list(range(150))))], "log_id long, extra struct<n:long,stats:struct<mean:double,deep:struct<x:long>>,ids:array<long>>")
    text = nested.select(F.to_json(X.json_safe(F.col("extra"), nested.schema["extra"].dataType, 100)).alias("t")).first().t
    assert '"__skipped__":true' in text and '"length":150' in text and "[" not in text
    assert X.flatten(nested, "extra").columns == ["log_id", "extra.n", "extra.stats.mean"]
