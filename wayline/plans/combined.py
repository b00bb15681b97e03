"""Queries that match many streams at once, control for several things at once, fit, and read containers and structs."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.operators import basic as B
from wayline.operators import kernel as K
from wayline.operators.basic import r6
from wayline.operators.export import shared_path, stored
from wayline.plans.views_sql import over
from wayline.plans.vision import mod, r4, residuals, rs
from wayline.sources import adapters as A
from wayline.sources import container as C
from wayline.sources import structs as S

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# Many streams at once


def _sides(name: str, rows: str, column: str) -> dict[str, str]:
    """Tables of a stream's last row of each moment, and of its first."""
    return {f"{name}_b": f"SELECT log_id, ts_us, arg_max({column}, seq) AS v FROM {rows} GROUP BY ALL", f"{name}_a": f"SELECT log_id, ts_us, arg_min({column}, seq) AS v FROM {rows} GROUP BY ALL"}


def _near(name: str, tolerance: int) -> tuple[str, str]:
    """The value of the stream's nearest row to l, and the joins that it needs."""
    gap_b, gap_a = f"l.ts_us - {name}b.ts_us", f"{name}a.ts_us - l.ts_us"
    value = f"CASE WHEN least({gap_b}, {gap_a}) <= {tolerance} THEN CASE WHEN {name}a.ts_us IS NOT NULL AND ({name}b.ts_us IS NULL OR {gap_a} <= {gap_b}) THEN {name}a.v ELSE {name}b.v END END"
    return value, f"ASOF LEFT JOIN {name}_b {name}b ON l.log_id = {name}b.log_id AND l.ts_us >= {name}b.ts_us ASOF LEFT JOIN {name}_a {name}a ON l.log_id = {name}a.log_id AND l.ts_us < {name}a.ts_us"


def _stream(spark, sf, signal):
    return A.samples(spark, sf).where(F.col("signal") == signal).select("log_id", "ts_us", "seq", F.col("v_double").alias("v"))


_COMPANIONS = {"tv": ("click", 50_000), "tl": ("view", 50_000), "cl": ("signup", 50_000), "hw": ("purchase", 100_000), "imu": ("error", 100_000)}
_VF = {n: _near(n, w) for n, (_, w) in _COMPANIONS.items()}


@query("vision_frames", over("samples", "vision", sql=f"""
    SELECT log_id, camera, seq, tv, round(tl + cl, 6) AS latency, hw, imu, coalesce(tv >= 10, FALSE) AND tag_count >= 1 AS valid, count(*) OVER (PARTITION BY log_id, camera) AS frames FROM (
      SELECT l.*, {', '.join(f'{v} AS {n}' for n, (v, _) in _VF.items())} FROM vision l {' '.join(j for _, j in _VF.values())})""",
    **{k: v for n, (signal, _) in _COMPANIONS.items() for k, v in _sides(n, f"(SELECT * FROM samples WHERE signal = '{signal}')", "v_double").items()}))
def vision_frames(spark, sf):
    """Camera frames with their five companions, each the nearest in time: validity, two latencies, hardware and inertia; and the camera's frames in all."""
    rows = K.asof_many(A.vision(spark, sf), {n: (_stream(spark, sf, signal), ["v"], w) for n, (signal, w) in _COMPANIONS.items()}, ["log_id"])
    valid = F.coalesce(F.col("tv_v") >= 10, F.lit(False)) & (F.col("tag_count") >= 1)
    frames = F.count("*").over(Window.partitionBy("log_id", "camera"))
    return rows.select("log_id", "camera", "seq", F.col("tv_v").alias("tv"), r6(F.col("tl_v") + F.col("cl_v")).alias("latency"), F.col("hw_v").alias("hw"), F.col("imu_v").alias("imu"), valid.alias("valid"), frames.alias("frames"))


_HEADINGS = {"a": "(SELECT * FROM vision WHERE camera = 'cam-a')", "b": "(SELECT * FROM vision WHERE camera = 'cam-b')", "c": "(SELECT * FROM vision WHERE camera = 'cam-c')"}
_MH = {n: _near(n, 100_000) for n in (*_HEADINGS, "g")}
_MH_TABLES = {k: v for n, rows in _HEADINGS.items() for k, v in _sides(n, rows, "yaw_deg").items()} | _sides("g", "(SELECT * FROM samples WHERE signal = 'signup')", "v_double * 3.6e0 - 180e0")
_MH_SQL = f"SELECT l.log_id, l.seq, l.ts_us, l.theta_deg, {', '.join(f'{v} AS h_{n}' for n, (v, _) in _MH.items())} FROM odometry l {' '.join(j for _, j in _MH.values())}"


def headings(spark, sf):
    """Odometry with the nearest heading, within 100 ms, of three cameras and a gyro (h_a, h_b, h_c, h_g)."""
    camera = lambda n: A.vision(spark, sf).where(F.col("camera") == f"cam-{n}").select("log_id", "ts_us", "seq", F.col("yaw_deg").alias("v"))
    gyro = _stream(spark, sf, "signup").withColumn("v", F.col("v") * 3.6 - 180)
    streams = {n: (camera(n), ["v"], 100_000) for n in "abc"} | {"g": (gyro, ["v"], 100_000)}
    return K.asof_many(A.odometry(spark, sf), streams, ["log_id"]).withColumnsRenamed({f"{n}_v": f"h_{n}" for n in "abcg"})


@query("multi_source_heading", over("samples", "odometry", "vision", sql=f"SELECT log_id, seq, {', '.join(f'round({mod(f'h_{n} - theta_deg + 180')} - 180, 6) AS d_{n}' for n in 'abcg')}, round({mod('h_a - h_g + 180')} - 180, 6) AS d_ag FROM mh", **_MH_TABLES, mh=_MH_SQL))
def multi_source_heading(spark, sf):
    """Five headings at once: how far each of four sources is from odometry, and the first camera from the gyro."""
    rows = headings(spark, sf)
    apart = lambda a, b: r6(G.yaw_diff_deg(F.col(a), F.col(b)))
    return rows.select("log_id", "seq", *[apart(f"h_{n}", "theta_deg").alias(f"d_{n}") for n in "abcg"], apart("h_a", "h_g").alias("d_ag"))


@query("tracked_reference", over("samples", "odometry", "vision", sql=f"""
    SELECT log_id, ts_us // 500000 AS half, count(*) AS n, round(avg(da), 9) AS mean_a, round(avg(dg), 9) AS mean_g, CASE WHEN round(avg(da), 9) <= round(avg(dg), 9) THEN 'camera' ELSE 'gyro' END AS follows
    FROM (SELECT *, abs({mod('h_a - theta_deg + 180')} - 180) AS da, abs({mod('h_g - theta_deg + 180')} - 180) AS dg FROM mh WHERE abs({mod('h_a - h_g + 180')} - 180) > 30) GROUP BY ALL HAVING count(*) >= 3""", **_MH_TABLES, mh=_MH_SQL))
def tracked_reference(spark, sf):
    """Half seconds in which camera and gyro disagree by over 30 degrees in three readings or more, and which of them odometry follows."""
    apart = lambda a, b: F.abs(G.yaw_diff_deg(F.col(a), F.col(b)))
    rows = headings(spark, sf).where(apart("h_a", "h_g") > 30).withColumns({"da": apart("h_a", "theta_deg"), "dg": apart("h_g", "theta_deg")})
    found = rows.groupBy("log_id", F.floor(F.col("ts_us") / 500_000).alias("half")).agg(F.count("*").alias("n"), F.round(F.avg("da"), 9).alias("mean_a"), F.round(F.avg("dg"), 9).alias("mean_g")).where("n >= 3")
    return found.withColumn("follows", F.when(F.col("mean_a") <= F.col("mean_g"), "camera").otherwise("gyro"))


_AM = {"ox": _near("ox", 50_000), "oy": _near("oy", 50_000), "h": _near("h", 100_000), "sg": _near("sg", 100_000)}
_AM_TABLES = _sides("ox", "odometry", "x") | _sides("oy", "odometry", "y") | _sides("h", "(SELECT * FROM samples WHERE signal = 'signup')", "v_double") | _sides("sg", "(SELECT * FROM samples WHERE signal = 'click')", "v_double")


@query("accepted_measurements", over("samples", "odometry", "vision", sql="""
    SELECT camera, reason, seq, CAST(1 AS BIGINT) AS n, round(sqrt(power(x - ox, 2) + power(y - oy, 2)), 6) AS error, h AS heading, sg AS sigma FROM am WHERE reason = 'none' AND ox IS NOT NULL
    UNION ALL SELECT camera, reason, NULL, count(*), NULL, NULL, NULL FROM am WHERE reason <> 'none' GROUP BY ALL""", **_AM_TABLES, am=f"SELECT l.*, CASE WHEN tag_count >= 2 THEN 'none' WHEN latency_ms > 30 THEN 'latency' ELSE 'tags' END AS reason, {', '.join(f'{v} AS {n}' for n, (v, _) in _AM.items())} FROM vision l {' '.join(j for _, j in _AM.values())}"))
def accepted_measurements(spark, sf):
    """Accepted measurements with their error to the nearest pose, the heading and the uncertainty sent with them; the others counted by reason."""
    reason = F.when(F.col("tag_count") >= 2, "none").when(F.col("latency_ms") > 30, "latency").otherwise("tags")
    pose = A.odometry(spark, sf).select("log_id", "ts_us", "seq", F.col("x").alias("ox"), F.col("y").alias("oy"))
    rows = K.asof_many(A.vision(spark, sf).withColumn("reason", reason), {"p": (pose, ["ox", "oy"], 50_000), "h": (_stream(spark, sf, "signup"), ["v"], 100_000), "s": (_stream(spark, sf, "click"), ["v"], 100_000)}, ["log_id"])
    error = F.sqrt(F.pow(F.col("x") - F.col("p_ox"), F.lit(2.0)) + F.pow(F.col("y") - F.col("p_oy"), F.lit(2.0)))
    none = lambda kind: F.lit(None).cast(kind)
    sent = rows.where("reason = 'none' and p_ox is not null").select("camera", "reason", "seq", F.lit(1).cast("bigint").alias("n"), r6(error).alias("error"), F.col("h_v").alias("heading"), F.col("s_v").alias("sigma"))
    others = rows.where("reason <> 'none'").groupBy("camera", "reason").agg(F.count("*").alias("n"))
    return sent.unionByName(others.select("camera", "reason", none("bigint").alias("seq"), "n", none("double").alias("error"), none("double").alias("heading"), none("double").alias("sigma")))


# Controls

_LEVELS = [("d",), ("a",), ("t",), ("d", "a"), ("d", "t"), ("d", "a", "t")]
_FEATURES = """SELECT f.frame_id, f.residual_raw / 100000 AS r, CASE WHEN avg(dist) < 2 THEN 0 WHEN avg(dist) < 3 THEN 1 WHEN avg(dist) < 4 THEN 2 ELSE 3 END AS d, CASE WHEN max(ambiguity) < .3 THEN 0 WHEN max(ambiguity) < .5 THEN 1 ELSE 2 END AS a, least(count(*), 3) AS t,
    CASE WHEN count(*) FILTER (tag_id > 16) * 2 < count(*) THEN 'hub' ELSE 'station' END AS grp FROM frames f JOIN tags USING (frame_id) GROUP BY ALL"""


@query("two_group_by_band", over("tags", "frames", sql=f"""
    SELECT d, a, t, hub_n, station_n, hub_median, station_median, hub_out, station_out, CASE WHEN hub_median < station_median THEN 'hub' WHEN hub_median IS NOT NULL AND station_median IS NOT NULL THEN 'station' END AS better FROM (
      SELECT d, a, t, count(*) FILTER (grp = 'hub') AS hub_n, count(*) FILTER (grp = 'station') AS station_n, round(median(r) FILTER (grp = 'hub'), 6) AS hub_median, round(median(r) FILTER (grp = 'station'), 6) AS station_median,
        round(100e0 * count(*) FILTER (grp = 'hub' AND r > 1) / nullif(count(*) FILTER (grp = 'hub'), 0), 6) AS hub_out, round(100e0 * count(*) FILTER (grp = 'station' AND r > 1) / nullif(count(*) FILTER (grp = 'station'), 0), 6) AS station_out
      FROM ff GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(x) + ')' for x in _LEVELS)}))""", ff=_FEATURES))
def two_group_by_band(spark, sf):
    """Two groups of frames side by side, by what most of their tags are on: under one, two and three controls (distance, ambiguity, number of tags) in one pass, and which is better.

    Many frames have a mean distance of 2, 3 or 4 but for rounding, so distances are added in the order of the table's rows;
    as they arrive, a frame's band would change from run to run.
    """
    whole = Window.partitionBy("frame_id", "residual_raw").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = A.frames(spark, sf).join(A.tags(spark, sf, place=True), "frame_id").withColumn("md", F.avg("dist").over(whole))
    rows = rows.groupBy("frame_id", "residual_raw").agg(F.first("md").alias("md"), F.max("ambiguity").alias("ma"), F.count("*").alias("c"), F.count_if(F.col("tag_id") > 16).alias("far"))
    step = lambda c, *limits: sum((F.coalesce(F.col(c) >= x, F.lit(True)).cast("int") for x in limits), F.lit(0))
    rows = rows.select((F.col("residual_raw") / 100_000).alias("r"), step("md", 2, 3, 4).alias("d"), step("ma", 0.3, 0.5).alias("a"), F.least("c", F.lit(3)).alias("t"), F.when(F.col("far") * 2 < F.col("c"), "hub").otherwise("station").alias("grp"))
    rows = stored(rows, "features")  # read four times, and cheaper than four sorts of all tags
    return B.controlled(rows, ["d", "a", "t"], _LEVELS, "grp", ["hub", "station"], "r")


# Geometry and fits


def _sigma(shape: str, penalty: float) -> str:
    return f"CASE WHEN worst >= .4 OR (n = 1 AND mean_d > 2) THEN NULL ELSE .09e0 * {shape} / power(1 - worst, 2) * {penalty}e0 END"


_TG = {
    "tp": "SELECT frame_id, max(greatest(.05e0, radians(least(abs(x - y), 360 - abs(x - y))))) AS sep FROM (SELECT a.frame_id, a.tag_id * 97 % 360 AS x, b.tag_id * 97 % 360 AS y FROM tags a JOIN tags b ON a.frame_id = b.frame_id) GROUP BY ALL",
    "tg": "SELECT frame_id, count(*) AS n, sum(1 / (dist * dist)) AS harmonic, stddev_pop(dist) AS spread, avg(dist) AS mean_d, max(ambiguity) AS worst FROM tags GROUP BY ALL",
    "ts": f"SELECT *, {_sigma('power(mean_d, 1.4e0) / sqrt(harmonic)', 1.0)} AS old_s, {_sigma('mean_d / sep', 1.3)} AS new_s FROM tg JOIN tp USING (frame_id)",
}


@query("tag_geometry_terms", over("tags", sql="""
    SELECT frame_id, round(harmonic, 6) AS harmonic, round(spread, 6) AS spread, round(sep, 6) AS baseline, round(old_s, 6) AS old_sigma, round(new_s, 6) AS new_sigma, round(coalesce(.0025e0 / (.0025e0 + old_s * old_s), 0), 6) AS old_gain, round(coalesce(.0025e0 / (.0025e0 + new_s * new_s), 0), 6) AS new_gain FROM ts""", **_TG))
def tag_geometry_terms(spark, sf):
    """Terms of a frame's tags (bearings made from their ids), two models of its uncertainty, and the gain that each gives a measurement."""
    rows = A.tags(spark, sf).groupBy("frame_id").agg(
        F.count("*").alias("n"), F.sum(1 / (F.col("dist") * F.col("dist"))).alias("harmonic"), F.stddev_pop("dist").alias("spread"), F.avg("dist").alias("mean_d"), F.max("ambiguity").alias("worst"),
        F.collect_list((F.col("tag_id") * 97 % 360).cast("double")).alias("bearings"),  # a frame has a few tags
    )
    rows = rows.withColumn("sep", F.greatest(F.lit(0.05), F.radians(G.widest_separation_deg(F.col("bearings")))))
    old, new = G.single_sigma(F.col("n"), F.col("mean_d"), F.col("worst"), F.pow("mean_d", F.lit(1.4)) / F.sqrt("harmonic")), G.single_sigma(F.col("n"), F.col("mean_d"), F.col("worst"), F.col("mean_d") / F.col("sep"), penalty=1.3)
    rows = rows.withColumns({"old_s": old, "new_s": new})
    gain = lambda s: r6(F.coalesce(0.0025 / (0.0025 + F.col(s) * F.col(s)), F.lit(0.0)))
    return rows.select("frame_id", r6("harmonic").alias("harmonic"), r6("spread").alias("spread"), r6("sep").alias("baseline"), r6("old_s").alias("old_sigma"), r6("new_s").alias("new_sigma"), gain("old_s").alias("old_gain"), gain("new_s").alias("new_gain"))


_YAWS = {"cam-a": 0.0, "cam-b": 120.0, "cam-c": -120.0}
_FIT = {
    "cal": f"""SELECT camera, x - px AS bx, y - py AS b_y, radians(yaw_deg) AS th, 1 + v_seq % 5 * .5e0 AS d, radians(CASE camera {' '.join(f"WHEN '{c}' THEN {a}" for c, a in _YAWS.items())} END) AS f FROM (SELECT *, seq AS v_seq FROM res) WHERE tag_count >= 2""",
    # With two unknowns of place and two of angle the normal equations fall into four blocks, three of them multiples of one reflection.
    "nm": """SELECT camera, any_value(f) AS f, count(*) AS n, sum(d) AS s, sum(d * d) AS q, sum(cos(th) * bx + sin(th) * b_y) AS p1, sum(-sin(th) * bx + cos(th) * b_y) AS p2, sum(d * (-sin(th + f) * bx + cos(th + f) * b_y)) AS a1, sum(d * (cos(th + f) * bx + sin(th + f) * b_y)) AS a2, sum(bx * bx + b_y * b_y) AS bb FROM cal GROUP BY camera""",
    "sa": "SELECT *, (a1 - s / n * (-sin(f) * p1 + cos(f) * p2)) / (q - s * s / n) AS yaw, (a2 - s / n * (cos(f) * p1 + sin(f) * p2)) / (q - s * s / n) AS pitch FROM nm",
    "sp": "SELECT *, (p1 - s * (-sin(f) * yaw + cos(f) * pitch)) / n AS fwd, (p2 - s * (cos(f) * yaw + sin(f) * pitch)) / n AS lft FROM sa",
}


@query("grouped_least_squares", rs("""
    SELECT camera, n, CASE WHEN n >= 30 THEN 'success' ELSE 'insufficient' END AS status, CASE WHEN n >= 30 THEN 4 END AS rank, CASE WHEN n >= 30 THEN round(fwd, 6) END AS forward, CASE WHEN n >= 30 THEN round(lft, 6) END AS "left", CASE WHEN n >= 30 THEN round(degrees(yaw), 5) END AS yaw_deg, CASE WHEN n >= 30 THEN round(degrees(pitch), 5) END AS pitch_deg,
      CASE WHEN n >= 30 THEN round(sqrt(bb / (2 * n)), 6) END AS rms_before, CASE WHEN n >= 30 THEN round(sqrt(greatest(0, bb - fwd * p1 - lft * p2 - yaw * a1 - pitch * a2) / (2 * n)), 6) END AS rms_after FROM sp""", **_FIT))
def grouped_least_squares(spark, sf):
    """How far each camera seems to be off forward, left, in yaw and pitch, from both residuals of its good frames, and the residuals before and after."""
    rows = residuals(spark, sf).where("tag_count >= 2").withColumns({"d": 1 + F.col("seq") % 5 * 0.5, "th": F.radians("yaw_deg")})
    yaw = F.create_map(*[F.lit(v) for c, a in _YAWS.items() for v in (c, math.radians(a))])
    rows = rows.withColumn("at", F.col("th") + yaw[F.col("camera")])
    d, th, at = F.col("d"), F.col("th"), F.col("at")
    equations = [
        ([F.cos(th), -F.sin(th), -d * F.sin(at), d * F.cos(at)], F.col("x") - F.col("p_x")),
        ([F.sin(th), F.cos(th), d * F.cos(at), d * F.sin(at)], F.col("y") - F.col("p_y")),
    ]
    found = B.fitted(rows, ["camera"], equations, least_rows=30)
    fit = lambda i: F.get("fit", F.lit(i))
    return found.select(
        "camera", "n", "status", "rank", r6(fit(0)).alias("forward"), r6(fit(1)).alias("left"), F.round(F.degrees(fit(2)), 5).alias("yaw_deg"), F.round(F.degrees(fit(3)), 5).alias("pitch_deg"),
        r6("rms_before").alias("rms_before"), r6("rms_after").alias("rms_after"),
    )


# Trends

_DRIVERS = {"fps": 5.0, "tags": 0.5, "latency": 5.0, "distance": 0.3}
_LC = "SELECT log_id, median(res) AS m, count(*) * 1e6 / nullif(max(ts_us) - min(ts_us), 0) AS fps, avg(tag_count) AS tags, avg(latency_ms) AS latency, avg(sqrt(power(px - 8.27e0, 2) + power(py - 4.1e0, 2))) AS distance FROM res GROUP BY ALL"
_LG = f"SELECT *, lag(m) OVER w AS was_m, {', '.join(f'lag({d}) OVER w AS was_{d}' for d in _DRIVERS)} FROM lc WINDOW w AS (ORDER BY log_id)"


@query("log_change_detection", rs(f"""
    SELECT log_id, round(m, 6) AS median_r, round(100 * (m - was_m) / greatest(was_m, .001e0), 4) AS change_pct, coalesce(abs(m - was_m) > .3 * greatest(was_m, .001e0), FALSE) AS changed,
      array_to_string(list_filter([{', '.join(f"CASE WHEN abs({d} - was_{d}) > {w} THEN '{d}' END" for d, w in _DRIVERS.items())}], lambda x: x IS NOT NULL), ',') AS drivers FROM lg""", lc=_LC, lg=_LG))
def log_change_detection(spark, sf):
    """Each log against the one before: how far the median residual moved, whether that is a change, and which drivers moved beyond their limits."""
    rows = residuals(spark, sf)
    span = F.max("ts_us") - F.min("ts_us")
    far = F.sqrt(F.pow(F.col("p_x") - 8.27, F.lit(2.0)) + F.pow(F.col("p_y") - 4.1, F.lit(2.0)))
    per = rows.groupBy("log_id").agg(F.median("res").alias("m"), F.when(span > 0, F.count("*") * 1e6 / span).alias("fps"), F.avg("tag_count").alias("tags"), F.avg("latency_ms").alias("latency"), F.avg(far).alias("distance"))
    rows = B.previous(per, "log_id", {f"was_{c}": c for c in ("m", *_DRIVERS)})
    base = F.greatest("was_m", F.lit(0.001))
    moved = F.array_compact(F.array(*[F.when(F.abs(F.col(d) - F.col(f"was_{d}")) > w, F.lit(d)) for d, w in _DRIVERS.items()]))
    step = F.col("m") - F.col("was_m")
    return rows.select(
        "log_id", r6("m").alias("median_r"), F.when(F.col("was_m").isNotNull(), r4(100 * step / base)).alias("change_pct"), F.coalesce(F.abs(step) > 0.3 * base, F.lit(False)).alias("changed"), F.array_join(moved, ",").alias("drivers"),
    )


# Containers and structs

_KINDS = "CASE signal WHEN 'click' THEN 'double' WHEN 'view' THEN 'int64' WHEN 'signup' THEN 'string' WHEN 'purchase' THEN 'double[]' ELSE 'boolean' END"


@query("read_container", over("samples", sql=f"""
    SELECT log_id, signal AS name, {_KINDS} AS kind, ts_us, CASE WHEN signal = 'click' THEN v_double END AS v_double, CASE WHEN signal = 'view' THEN seq END AS v_long, CASE WHEN signal = 'signup' THEN 'v' || seq END AS v_str,
      CASE WHEN signal = 'error' THEN v_double > 50 END AS v_bool, CASE WHEN signal = 'purchase' THEN seq END AS second, CASE WHEN signal = 'purchase' THEN CAST(2 AS BIGINT) END AS items FROM samples WHERE ts_us >= 0"""))
def read_container(spark, sf):
    """The samples as one container file per log, read back in splits of 4,096 bytes, resolved and decoded by type."""
    kind = F.when(F.col("signal") == "click", "double").when(F.col("signal") == "view", "int64").when(F.col("signal") == "signup", "string").when(F.col("signal") == "purchase", "double[]").otherwise("boolean")
    seq = F.col("seq").cast("double")
    payload = (
        F.when(F.col("signal") == "click", S.packed()(F.array("v_double"))).when(F.col("signal") == "view", C.little_endian(F.col("seq"))).when(F.col("signal") == "signup", F.concat(F.lit("v"), F.col("seq").cast("string")).cast("binary"))
        .when(F.col("signal") == "purchase", S.packed()(F.array("v_double", seq))).otherwise(F.when(F.col("v_double") > 50, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))))
    )
    folder = shared_path(spark, "containers")
    # Counting the logs writes them all.
    C.write_containers(A.samples(spark, sf).where("ts_us >= 0").select("log_id", "ts_us", "seq", F.col("signal").alias("name"), kind.alias("type"), payload.alias("payload")), folder).count()
    found = C.decoded(C.named(C.read_containers(spark, folder, 4096)))
    return found.select(
        F.regexp_extract("path", r"(\d+)\.wpilog$", 1).cast("bigint").alias("log_id"), "name", C.kind_of(F.col("type")).alias("kind"), "ts_us", "v_double", "v_long", "v_str", "v_bool",
        F.get("v_doubles", F.lit(1)).cast("bigint").alias("second"), F.when(F.col("v_doubles").isNotNull(), F.size("v_doubles")).cast("bigint").alias("items"),
    )


_DECLARED = ["boolean", "int64", "float", "double", "string", "boolean[]", "int64[]", "float[]", "double[]", "string[]", "raw", "rawBytes", "struct:Pose2d", "structschema:Pose2d", "json", "odd"]


@query("classify_type", over("samples", sql=f"""
    SELECT seq, CASE WHEN d IN ('boolean', 'int64', 'float', 'double', 'string', 'boolean[]', 'int64[]', 'float[]', 'double[]', 'string[]', 'raw') THEN d WHEN d = 'rawBytes' THEN 'raw' WHEN starts_with(d, 'struct:') OR starts_with(d, 'structschema:') THEN 'struct' ELSE 'unknown' END AS type
    FROM (SELECT seq, {_DECLARED}[seq % 16 + 1] AS d FROM samples)"""))
def classify_type(spark, sf):
    declared = F.element_at(F.array(*map(F.lit, _DECLARED)), (F.col("seq") % 16 + 1).cast("int"))
    return A.samples(spark, sf).select("seq", C.kind_of(declared).alias("type"))


@query("decode_struct", over("odometry", sql=f"""
    SELECT seq, round(x, 9) AS x, round(y, 9) AS y, round({mod('theta_deg + 180')} - 180, 6) AS heading_deg, CASE WHEN seq % 5 <> 0 THEN round(x / 2, 9) END AS vx, CASE WHEN seq % 5 <> 0 THEN round(y / 2, 9) END AS vy, seq % 4 AS modules, CASE WHEN seq % 4 > 0 THEN round((seq % 4) * x, 8) END AS speed FROM odometry"""))
def decode_struct(spark, sf):
    """Poses, speeds (a fifth of them cut short) and up to three module states packed as struct payloads and read back."""
    th = F.radians("theta_deg")
    short = F.when(F.col("seq") % 5 == 0, F.array(F.col("x") / 2)).otherwise(F.array(F.col("x") / 2, F.col("y") / 2, F.lit(0.5)))
    modules = F.flatten(F.array_repeat(F.array(F.col("x"), F.lit(1.0), F.lit(0.0)), (F.col("seq") % 4).cast("int")))
    packed = A.odometry(spark, sf).select("seq", S.packed()(F.array("x", "y", F.cos(th), F.sin(th))).alias("p"), S.packed()(short).alias("s"), S.packed(counted=True)(modules).alias("m"))
    rows = packed.select("seq", S.pose2d("p").alias("p"), S.chassis_speeds("s").alias("s"), S.module_states("m").alias("m"))
    speed = F.aggregate("m", F.lit(0.0), lambda total, x: total + x["speed"])
    wrapped = F.pmod(F.col("p.heading_deg") + 180, F.lit(360.0)) - 180
    return rows.select(
        "seq", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"), r6(wrapped).alias("heading_deg"), F.round("s.vx", 9).alias("vx"), F.round("s.vy", 9).alias("vy"), F.size("m").cast("bigint").alias("modules"),
        F.when(F.size("m") > 0, F.round(speed, 8)).alias("speed"),
    )
