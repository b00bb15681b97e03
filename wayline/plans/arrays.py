"""Queries for arrays of poses, cameras and sensors, with arrays that are too short, empty or invalid among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import arrays as N
from wayline.functions import geometry as G
from wayline.operators import robot as R
from wayline.operators.basic import r6
from wayline.plans.views_sql import over
from wayline.sources import adapters as A

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


_TURN = "6.283185307179586"


def _radians(degrees: str) -> str:
    """Degrees as radians in (-pi, pi], rounded."""
    m = f"(((radians({degrees})) % {_TURN}) + {_TURN}) % {_TURN}"
    return f"round(CASE WHEN {m} > 3.141592653589793 THEN {m} - {_TURN} ELSE {m} END, 4)"


@query("parse_pose_array", over("odometry", sql=f"SELECT seq, x, y, {_radians('theta_deg * 3')} AS theta FROM odometry WHERE seq % 5 <> 0"))
def parse_pose_array(spark, sf):
    values = F.when(F.col("seq") % 5 == 0, F.array("x", "y")).otherwise(F.array("x", "y", F.col("theta_deg") * 3, F.lit(1.0)))
    return A.odometry(spark, sf).select("seq", N.pose(values).alias("p")).where("p is not null").select("seq", "p.x", "p.y", F.round("p.theta", 4).alias("theta"))


_CAM = """SELECT v.*, seq % 4 AS tags, CAST(1 + seq % 7 AS DOUBLE) AS dist, a.area FROM vision v LEFT JOIN ar a ON v.log_id = a.log_id AND v.ts_us = a.ts_us
    WHERE seq % 11 <> 0 AND seq % 4 > 0 AND seq % 13 <> 0"""


@query("parse_botpose", over("vision", sql=f"""
    SELECT seq, x, y, {_radians('yaw_deg')} AS theta, CAST(latency_ms * 1000 AS BIGINT) AS latency_us, round(CASE WHEN tags = 1 THEN .6e0 ELSE 1e0 END * CASE WHEN area < .001e0 THEN .3e0 ELSE 1e0 END
      * CASE WHEN dist > 5 THEN .5e0 WHEN dist > 3 THEN .8e0 ELSE 1e0 END, 6) AS confidence FROM c""",
    ar="SELECT log_id, ts_us, max_by((seq % 10) / 2000e0, seq) AS area FROM vision WHERE seq % 3 = 0 GROUP BY ALL", c=_CAM))
def parse_botpose(spark, sf):
    """Arrays of eleven numbers; some are short, have no tags or hold only zeros, and a target's area is known for a part of the times."""
    v, zero = A.vision(spark, sf), F.lit(0.0)
    areas = v.where("seq % 3 = 0").groupBy("log_id", "ts_us").agg(F.max_by((F.col("seq") % 10) / 2000, "seq").alias("area"))
    live = F.when(F.col("seq") % 13 == 0, zero).otherwise(1.0)
    whole = F.array(F.col("x") * live, F.col("y") * live, zero, zero, zero, F.col("yaw_deg") * live, F.col("latency_ms"), (F.col("seq") % 4).cast("double"), zero, (1 + F.col("seq") % 7).cast("double"), zero)
    values = F.when(F.col("seq") % 11 == 0, F.slice(whole, 1, 6)).otherwise(whole)
    found = v.join(areas, ["log_id", "ts_us"], "left").select("seq", N.camera_pose(values, F.col("area")).alias("p")).where("p is not null")
    return found.select("seq", "p.x", "p.y", F.round("p.theta", 4).alias("theta"), "p.latency_us", r6("p.confidence").alias("confidence"))


@query("parse_imu_array", over("samples", sql="""
    SELECT seq, round(sqrt(ax * ax + ay * ay + 96.2361e0), 6) AS accel, round(abs(gz), 6) AS gravity FROM (SELECT seq, v_double / 50 AS ax, v_double / 100 AS ay, -9.81e0 + v_double / 1000 AS gz FROM samples WHERE seq % 9 <> 0)"""))
def parse_imu_array(spark, sf):
    v, zero = F.col("v_double"), F.lit(0.0)
    whole = F.array(v / 50, v / 100, F.lit(9.81), v / 50, zero, zero, zero, zero, zero, -9.81 + v / 1000)
    found = A.samples(spark, sf).select("seq", N.camera_accel(F.when(F.col("seq") % 9 == 0, F.slice(whole, 1, 9)).otherwise(whole)).alias("m")).where("m is not null")
    size = lambda a, b, c: r6(F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b) + F.col(c) * F.col(c)))
    return found.select("seq", size("m.ax", "m.ay", "m.az").alias("accel"), size("m.gx", "m.gy", "m.gz").alias("gravity"))


_BIN = "SELECT log_id, ts_us // 20000 * 20000 AS ts_us, signal, max_by(v_double, (ts_us, seq)) / 100 AS v, max(seq) AS seq FROM samples GROUP BY log_id, ts_us // 20000, signal"


def binned(spark, sf):
    """One value per signal and 20 ms, so that signals have times in common."""
    rows = A.samples(spark, sf).groupBy("log_id", (F.floor(F.col("ts_us") / 20_000) * 20_000).alias("ts_us"), "signal")
    return rows.agg((F.max_by("v_double", F.struct("ts_us", "seq")) / 100).alias("v"), F.max("seq").alias("seq"))


@query("parse_axis_accel", over("samples", sql="""
    SELECT x.log_id, x.ts_us, round(x.v * 9.81e0, 6) AS ax, round(y.v * 9.81e0, 6) AS ay, round(z.v * 9.81e0, 6) AS az, round(CASE WHEN c.n >= 10 THEN coalesce(g.v, 0) * 9.81e0 ELSE 0 END, 6) AS gx,
      round(CASE WHEN c.n >= 10 THEN coalesce(g.v, 0) * 9.81e0 ELSE -9.81e0 END, 6) AS gz
    FROM (SELECT *, count(*) OVER (PARTITION BY log_id) AS k FROM b WHERE signal = 'click') x JOIN (SELECT * FROM b WHERE signal = 'view') y ON x.log_id = y.log_id AND x.ts_us = y.ts_us
    JOIN (SELECT * FROM b WHERE signal = 'error') z ON x.log_id = z.log_id AND x.ts_us = z.ts_us LEFT JOIN g ON x.log_id = g.log_id AND x.ts_us = g.ts_us
    LEFT JOIN (SELECT log_id, count(*) AS n FROM g GROUP BY ALL) c ON x.log_id = c.log_id WHERE x.k >= 10""", b=_BIN, g="SELECT * FROM b WHERE signal = 'purchase' AND log_id % 2 = 0"))
def parse_axis_accel(spark, sf):
    """Three signals as axes in g; every second log has a gravity vector, the others get the usual one."""
    b = binned(spark, sf)
    axis = lambda s: b.where(F.col("signal") == s).select("log_id", "ts_us", "v")
    gravity = [axis("purchase").where("log_id % 2 = 0")] * 3
    found = R.axis_accel(axis("click"), axis("view"), axis("error"), gravity)
    return found.select("log_id", "ts_us", *[r6(c).alias(c) for c in ("ax", "ay", "az", "gx", "gz")])


_HW = "SELECT log_id, camera, 40 + latency_ms / 2 AS temperature, CAST(seq % 100 AS DOUBLE) AS cpu, CAST(seq % 50 AS DOUBLE) AS ram, 1000 / latency_ms AS fps FROM vision WHERE seq % 6 <> 0"


def hardware(spark, sf):
    whole = F.array(40 + F.col("latency_ms") / 2, (F.col("seq") % 100).cast("double"), (F.col("seq") % 50).cast("double"), 1000 / F.col("latency_ms"))
    values = F.when(F.col("seq") % 6 == 0, F.slice(whole, 1, 3)).otherwise(whole)
    return A.vision(spark, sf).select("log_id", "camera", "seq", N.hardware(values).alias("h")).where("h is not null").select("log_id", "camera", "seq", "h.*")


@query("parse_hw", over("vision", sql="SELECT seq, temperature, cpu, ram, round(1000 / latency_ms, 6) AS fps FROM (SELECT *, 40 + latency_ms / 2 AS temperature, CAST(seq % 100 AS DOUBLE) AS cpu, CAST(seq % 50 AS DOUBLE) AS ram FROM vision WHERE seq % 6 <> 0)"))
def parse_hw(spark, sf):
    return hardware(spark, sf).select("seq", "temperature", "cpu", "ram", r6("fps").alias("fps"))


@query("camera_hw", over("vision", sql="""
    SELECT log_id, camera, count(*) AS n, round(avg(fps), 6) AS mean_fps, round(min(fps), 6) AS min_fps, round(max(fps), 6) AS max_fps, round(avg(temperature), 6) AS mean_temperature, max(temperature) AS max_temperature,
      round(avg(cpu), 6) AS mean_cpu, max(cpu) AS max_cpu, round(avg(ram), 6) AS mean_ram, max(ram) AS max_ram FROM h GROUP BY ALL""", h=_HW))
def camera_hw(spark, sf):
    both = lambda c: [r6(F.avg(c)).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}")]
    frames = [r6(f("fps")).alias(f"{n}_fps") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return hardware(spark, sf).groupBy("log_id", "camera").agg(F.count("*").alias("n"), *frames, *both("temperature"), *both("cpu"), *both("ram"))


_T2D = """SELECT frame_id, n, dist * 100 AS long_side, area * 1000 AS short_side, dist * 50 AS width, ambiguity * 50 AS height, CAST(tag_id * 3 - 48 AS DOUBLE) AS skew,
    CASE WHEN area > 0 THEN dist * 100 / (area * 1000) ELSE 0 END AS aspect FROM tags WHERE n % 3 <> 0"""


def targets(spark, sf):
    """Targets of seventeen numbers; each third is marked invalid."""
    zero = F.lit(0.0)
    values = F.array((F.col("n") % 3 / 2).cast("double"), *[zero] * 11, F.col("dist") * 100, F.col("area") * 1000, F.col("dist") * 50, F.col("ambiguity") * 50, (F.col("tag_id") * 3 - 48).cast("double"))
    return A.tags(spark, sf).select("frame_id", "n", N.target(values).alias("t")).where("t is not null").select("frame_id", "n", "t.*")


@query("parse_t2d", over("tags", sql="SELECT frame_id, n, round(long_side, 6) AS long_side, round(short_side, 6) AS short_side, round(aspect, 4) AS aspect, skew FROM t", t=_T2D))
def parse_t2d(spark, sf):
    return targets(spark, sf).select("frame_id", "n", r6("long_side").alias("long_side"), r6("short_side").alias("short_side"), F.round("aspect", 4).alias("aspect"), "skew")


@query("tag_geometry_summary", over("tags", "frames", sql="""
    SELECT camera, count(*) AS n, round(avg(short_side), 4) AS short_side, round(avg(aspect) FILTER (aspect > 0), 4) AS aspect, round(100e0 * count(*) FILTER (aspect > 2) / count(*), 4) AS oblique_pct,
      round(100e0 * count(*) FILTER (short_side < 20) / count(*), 4) AS tiny_pct, round(avg(abs(skew)), 4) AS skew FROM t JOIN frames USING (frame_id) GROUP BY ALL""", t=_T2D))
def tag_geometry_summary(spark, sf):
    rows = targets(spark, sf).join(A.frames(spark, sf), "frame_id")
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    r4 = lambda c: F.round(c, 4)
    return rows.groupBy("camera").agg(
        F.count("*").alias("n"), r4(F.avg("short_side")).alias("short_side"), r4(F.avg(F.when(F.col("aspect") > 0, F.col("aspect")))).alias("aspect"),
        pct(F.col("aspect") > 2).alias("oblique_pct"), pct(F.col("short_side") < 20).alias("tiny_pct"), r4(F.avg(F.abs("skew"))).alias("skew"),
    )


_LAYOUT = "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {x}e0, {y}e0, {z}e0)" for i, (x, y, z) in enumerate(N.TAG_PLACES)) + ") AS t(id, fx, fy, fz)"


@query("tags_to_field_positions", over("tags", sql="""
    SELECT frame_id, count(*) AS known, round(sum(fx), 6) AS sum_x, round(min(fy), 6) AS least_y, round(max(fz), 6) AS top_z FROM (SELECT frame_id, n, tag_id + (l_shift % 9) AS id FROM (SELECT *, n AS l_shift FROM tags)) JOIN la USING (id) GROUP BY ALL""", la=_LAYOUT))
def tags_to_field_positions(spark, sf):
    """Arrays of seven numbers a tag, in the order of detection, to places on the field; ids beyond the layout occur."""
    value = F.array((F.col("tag_id") + F.col("n") % 9).cast("double"), F.lit(0.0), F.lit(0.0), F.col("area"), F.col("dist"), F.col("dist"), F.col("ambiguity"))
    listed = A.tags(spark, sf).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("n", value.alias("v")))).alias("all"))
    flat = listed.select("frame_id", F.flatten(F.transform("all", lambda s: s["v"])).alias("values"))
    found = flat.select("frame_id", N.field_places(G.tag_structs(F.col("values"))).alias("p")).where("p is not null")
    whole = F.aggregate("p", F.lit(0.0), lambda s, p: s + p["x"])
    return found.select("frame_id", F.size("p").cast("bigint").alias("known"), F.round(whole, 6).alias("sum_x"), r6(F.array_min("p.y")).alias("least_y"), r6(F.array_max("p.z")).alias("top_z"))
