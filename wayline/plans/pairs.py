"""Queries for logs of one set, cameras of one log, and groups of files. Logs 2k and 2k + 1 are the robot's and the device's of set k."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.operators import basic as B
from wayline.operators import clocks as C
from wayline.operators import folds
from wayline.operators import kernel as K
from wayline.operators import quantiles as Qn
from wayline.operators import robot as R
from wayline.operators.basic import r6
from wayline.operators.export import stored
from wayline.plans import records, vision
from wayline.plans.robots import PH, phases
from wayline.plans.views_sql import over
from wayline.plans.vision import _CELL, _RS, mod, r4, residuals
from wayline.sources import adapters as A
from wayline.sources import files as N

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def set_id():
    return F.floor(F.col("log_id") / 2).alias("set_id")


def side(rows, which: int):
    """The rows of the robots' logs (0) or the devices' (1), with their set."""
    return rows.where(F.col("log_id") % 2 == which).select("*", set_id()).drop("log_id")


def edges(spark, sf, which: int):
    return side(C.edges(A.modes(spark, sf), ["log_id"]), which)


_ED = "SELECT log_id // 2 AS set_id, log_id % 2 AS side, ts_us, seq, on_ FROM (SELECT *, v_long % 2 = 1 AS on_, lag(v_long % 2 = 1) OVER (PARTITION BY log_id ORDER BY ts_us, seq) AS was FROM modes) WHERE was IS NULL OR was <> on_"
_EB = {
    "e": _ED, "ea": "SELECT * FROM e WHERE side = 0", "eb": "SELECT set_id, on_, ts_us, min(seq) AS seq FROM e WHERE side = 1 GROUP BY ALL",
    "ne": "SELECT a.set_id, a.seq, min(abs(a.ts_us - b.ts_us)) AS d, arg_min(b.seq, (abs(a.ts_us - b.ts_us), b.ts_us)) AS other FROM ea a JOIN eb b ON a.set_id = b.set_id AND a.on_ = b.on_ AND abs(a.ts_us - b.ts_us) <= 4999999 GROUP BY ALL",
}


def near_edges(spark, sf):
    found = C.nearest_edges(edges(spark, sf, 0), edges(spark, sf, 1), ["set_id"], 4_999_999)
    return found.withColumn("d", F.abs(F.col("ts_us") - F.col("other_us")))


@query("nearest_edge_join", over("modes", sql="SELECT set_id, seq, other, d FROM ne", **_EB))
def nearest_edge_join(spark, sf):
    return near_edges(spark, sf).select("set_id", "seq", "other", "d")


@query("transition_agreement", over("modes", sql="SELECT set_id, count(*) AS n, round(avg(d), 6) AS mean_us, max(d) AS max_us FROM ne GROUP BY ALL", **_EB))
def transition_agreement(spark, sf):
    return near_edges(spark, sf).groupBy("set_id").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_us"), F.max("d").alias("max_us"))


_SE = {
    "s": "SELECT *, CAST(sum(nw) OVER (PARTITION BY log_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY log_id ORDER BY ts_us, seq) <= 50000 THEN 0 ELSE 1 END AS nw FROM samples)",
    "t": "SELECT log_id // 2 AS set_id, log_id % 2 AS side, session, min(ts_us) + 3000 * (log_id % 2) AS ts_us FROM s GROUP BY log_id, session",
}


@query("session_match", over("samples", sql="""
    SELECT a.set_id, a.session, arg_min(b.session, (abs(a.ts_us - b.ts_us), b.ts_us)) AS other FROM t a JOIN t b ON a.set_id = b.set_id AND a.side = 0 AND b.side = 1 AND abs(a.ts_us - b.ts_us) <= 200000 GROUP BY ALL""", **_SE))
def session_match(spark, sf):
    """Sessions of a set's robot with the nearest of its device by start, the device's clock being 3 ms behind."""
    rows = K.gap_sessions(A.samples(spark, sf), ["log_id"], 50_000).groupBy("log_id", "session").agg(F.min("ts_us").alias("ts_us")).withColumn("seq", F.col("session"))
    right = side(rows, 1).select("set_id", (F.col("ts_us") + 3000).alias("ts_us"), "seq", F.col("session").alias("other"))
    return K.asof_nearest(side(rows, 0), right, ["set_id"], ["other"], 200_000, later=False).where("other is not null").select("set_id", "session", "other")


_AL = {
    **_EB,
    "tr": "SELECT DISTINCT a.set_id, a.ts_us - b.t AS off FROM (SELECT * FROM ea WHERE on_) a JOIN (SELECT set_id, min(ts_us) AS t FROM eb WHERE on_ GROUP BY ALL) b ON a.set_id = b.set_id",
    "mo": "SELECT t.set_id, t.off, b.seq, min(abs(a.ts_us - b.ts_us - t.off)) AS d FROM tr t JOIN (SELECT * FROM e WHERE side = 1) b ON t.set_id = b.set_id JOIN ea a ON a.set_id = b.set_id AND a.on_ = b.on_ AND abs(a.ts_us - b.ts_us - t.off) <= 50000 GROUP BY ALL",
    "al": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY matched DESC, sq, off) AS place FROM (SELECT set_id, off, count(*) AS matched, CAST(sum(d * d) AS BIGINT) AS sq FROM mo GROUP BY ALL))
        JOIN (SELECT set_id, count(*) AS n FROM e WHERE side = 1 GROUP BY ALL) USING (set_id) WHERE place = 1""",
    "cl": "SELECT log_id, list_sort(list(epoch_us(ts) - ts_us))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS offset_us FROM (SELECT user_id // 12 AS log_id, ts, CAST(floor((epoch_us(ts) - 1704067200000000) / 150000e0) AS BIGINT) AS ts_us FROM events WHERE event_type = 'signup') GROUP BY ALL",
    "am": """SELECT set_id, CASE WHEN k = 0 THEN 'system_time' WHEN k = 1 THEN 'mode_edge' ELSE 'assumed_zero' END AS method, CASE WHEN k = 0 THEN clock WHEN k = 1 THEN off ELSE 0 END AS offset_us,
          round(CASE WHEN k = 0 THEN CASE WHEN abs(off) < 1000000 THEN least(1e0, .9e0 + matched / n * .1e0) ELSE .5e0 END WHEN k = 1 THEN matched / n ELSE .5e0 END, 6) AS confidence,
          round(CASE WHEN k = 0 THEN CAST(abs(off) AS DOUBLE) WHEN k = 1 THEN sqrt(sq / matched) ELSE 0e0 END, 4) AS residual_us
        FROM (SELECT al.*, set_id % 3 AS k, cl.offset_us AS clock FROM al JOIN cl ON cl.log_id = 2 * al.set_id)""",
}


def alignment(spark, sf):
    return C.align(edges(spark, sf, 0), edges(spark, sf, 1), 50_000)


@query("align_edges", over("modes", sql="SELECT set_id, off AS offset_us, matched, round(matched / n, 6) AS confidence, round(sqrt(sq / matched), 4) AS rms_us FROM al", **{k: v for k, v in _AL.items() if k not in ("cl", "am")}))
def align_edges(spark, sf):
    rms = F.round(F.sqrt(F.col("sq") / F.col("matched")), 4).alias("rms_us")
    return alignment(spark, sf).select("set_id", F.col("off").alias("offset_us"), "matched", r6(F.col("matched") / F.col("n")).alias("confidence"), rms)


def walls(spark, sf):
    """log_id, ts_us, seq, wall_us: readings of the wall clock."""
    found = A.table(spark, sf, "events").where("event_type = 'signup'").selectExpr("event_id as seq", "unix_micros(cast(ts as timestamp)) as wall_us")
    return A.samples(spark, sf).join(found, "seq")


@query("clock_offset", over(sql="SELECT log_id, offset_us FROM cl", cl=_AL["cl"]))
def clock_offset(spark, sf):
    return C.clock_offsets(walls(spark, sf), ["log_id"])


def set_alignments(spark, sf):
    """Sets of three sorts: a station with the robot's clock, a device bus with edges, the robot's own bus without."""
    clocks = side(clock_offset(spark, sf), 0)
    device = F.when(F.col("set_id") % 3 == 0, "station").when(F.col("set_id") % 3 == 1, "bus").otherwise("rio")
    aligned = alignment(spark, sf)
    sets = aligned.select("set_id", device.alias("device"))
    return C.alignments(sets, clocks.where("set_id % 3 = 0"), aligned.where("set_id % 3 <> 2"))


@query("compute_alignments", over("modes", sql="SELECT * FROM am", **_AL))
def compute_alignments(spark, sf):
    return set_alignments(spark, sf).select("set_id", "method", "offset_us", r6("confidence").alias("confidence"), F.round("residual_us", 4).alias("residual_us"))


@query("merge_logs", over("samples", "modes", sql="""
    SELECT s.log_id // 2 AS set_id, CASE s.log_id % 2 WHEN 0 THEN 'robot/' ELSE 'device/' END || signal AS signal, CASE s.log_id % 2 WHEN 0 THEN ts_us ELSE ts_us + off END AS ts_us, seq, count(*) OVER (PARTITION BY s.log_id // 2) AS record_count
    FROM samples s JOIN al ON al.set_id = s.log_id // 2""", **{k: v for k, v in _AL.items() if k not in ("cl", "am")}))
def merge_logs(spark, sf):
    """One log per set: names with the source before them, the device's times moved to the robot's, records counted anew."""
    rows = A.samples(spark, sf).select("*", set_id()).join(alignment(spark, sf).select("set_id", "off"), "set_id")
    device = F.col("log_id") % 2 == 1
    out = rows.select("set_id", F.concat(F.when(device, "device/").otherwise("robot/"), "signal").alias("signal"), F.when(device, F.col("ts_us") + F.col("off")).otherwise(F.col("ts_us")).alias("ts_us"), "seq")
    return out.join(out.groupBy("set_id").agg(F.count("*").alias("record_count")), "set_id")


@query("log_set_report", over("samples", "modes", sql="""
    SELECT am.*, logs, start_us, logs >= 2 AS complete, agree FROM am JOIN (SELECT log_id // 2 AS set_id, count(DISTINCT log_id) AS logs, min(ts_us) AS start_us FROM samples GROUP BY ALL) USING (set_id)
    LEFT JOIN (SELECT set_id, count(*) AS agree FROM ne WHERE d <= 50000 GROUP BY ALL) USING (set_id)""", **_AL))
def log_set_report(spark, sf):
    logs = A.samples(spark, sf).groupBy(set_id()).agg(F.countDistinct("log_id").alias("logs"), F.min("ts_us").alias("start_us")).withColumn("complete", F.col("logs") >= 2)
    agree = near_edges(spark, sf).where("d <= 50000").groupBy("set_id").agg(F.count("*").alias("agree"))
    return compute_alignments(spark, sf).join(logs, "set_id").join(agree, "set_id", "left")


@query("rate_change_report", over("samples", sql="""
    SELECT set_id, signal, round(a, 4) AS before_us, round(b, 4) AS after_us, round(100 * (b - a) / a, 4) AS change_pct, CASE WHEN abs(b - a) <= .15e0 * a THEN 'unchanged' WHEN b < a THEN 'faster' ELSE 'slower' END AS verdict
    FROM (SELECT log_id // 2 AS set_id, signal, median(gap) FILTER (log_id % 2 = 0 AND gap < 2000000) AS a, median(gap) FILTER (log_id % 2 = 1 AND gap < 2000000) AS b
      FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS gap FROM samples) GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL"""))
def rate_change_report(spark, sf):
    """Signals that both logs of a set have, by the median of their active periods (gaps under 2 s)."""
    of = lambda k: F.median(F.when((F.col("log_id") % 2 == k) & (F.col("gap") < 2_000_000), F.col("gap")))
    rows = B.gaps(A.samples(spark, sf)).groupBy(set_id(), "signal").agg(of(0).alias("a"), of(1).alias("b")).where("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    verdict = F.when(F.abs(b - a) <= 0.15 * a, "unchanged").when(b < a, "faster").otherwise("slower")
    return rows.select("set_id", "signal", F.round(a, 4).alias("before_us"), F.round(b, 4).alias("after_us"), F.round(100 * (b - a) / a, 4).alias("change_pct"), verdict.alias("verdict"))


@query("find_matching_logs", over(recursive=True, sql="""
    SELECT anchor AS start_s, min(name) FILTER (form = 0) AS robot, min(name) FILTER (form = 1) AS station, count(*) FILTER (form IN (3, 4)) AS devices FROM ti JOIN f ON ti.s = f.s GROUP BY ALL HAVING count(*) FILTER (form IN (0, 1, 3, 4)) > 0""",
    fo=records._FORM, na=records._NAMES, ti="SELECT *, CAST(floor(epoch(t)) AS BIGINT) AS s FROM na WHERE form IN (0, 1, 3, 4)",
    h="SELECT s, row_number() OVER (ORDER BY s) AS i FROM (SELECT DISTINCT s FROM ti)",
    f="SELECT i, s, s AS anchor FROM h WHERE i = 1 UNION ALL SELECT h.i, h.s, CASE WHEN h.s - f.anchor > 200000 THEN h.s ELSE f.anchor END FROM f JOIN h ON h.i = f.i + 1"))
def find_matching_logs(spark, sf):
    """Files in groups by the start that their names tell; a group ends a width (here some days, as dates are days) after its first file.

    Of robot and station files the first by name counts, device files are all kept. Starts are grouped in chunks of time;
    the files are joined to their group and aggregated.
    """
    named = records.names(spark, sf).select(N.file_name(F.col("path")).alias("name"), N.kind(F.col("path")).alias("kind"), N.start_s(F.col("path")).alias("ts_us"))
    named = stored(named.where("ts_us > 0 and kind <> 'dsevents'"), "names")
    rows = named.join(folds.anchors_over_all(named, 200_000), "ts_us")
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("name")))
    found = rows.groupBy(F.col("anchor_us").alias("start_s")).agg(first("wpilog").alias("robot"), first("dslog").alias("station"), F.count_if(F.col("kind") == "hoot").alias("devices"))
    return found.where("robot is not null or station is not null or devices > 0")


# Cameras of one log

_CP = {
    **_RS,
    "pr": "SELECT a.log_id, a.camera AS a, b.camera AS b FROM (SELECT DISTINCT log_id, camera FROM vision) a JOIN (SELECT DISTINCT log_id, camera FROM vision) b ON a.log_id = b.log_id AND a.camera < b.camera",
    "l": "SELECT r.*, p.a, p.b FROM res r JOIN pr p ON r.log_id = p.log_id AND r.camera = p.a",
    "rb": "SELECT log_id, camera, ts_us, max_by(x, seq) AS x, max_by(y, seq) AS y, max_by(yaw_deg, seq) AS yaw, max_by(res, seq) AS res FROM res GROUP BY ALL",
    "ra": "SELECT log_id, camera, ts_us, min_by(x, seq) AS x, min_by(y, seq) AS y, min_by(yaw_deg, seq) AS yaw, min_by(res, seq) AS res FROM res GROUP BY ALL",
    "nn": """SELECT l.log_id, l.a, l.b, l.ts_us, l.seq, l.x, l.y, l.yaw_deg, l.res, CASE WHEN p.ts_us IS NULL OR q.ts_us - l.ts_us < l.ts_us - p.ts_us THEN {'t': q.ts_us, 'x': q.x, 'y': q.y, 'yaw': q.yaw, 'res': q.res} ELSE {'t': p.ts_us, 'x': p.x, 'y': p.y, 'yaw': p.yaw, 'res': p.res} END AS o
        FROM l ASOF LEFT JOIN rb p ON l.log_id = p.log_id AND l.b = p.camera AND l.ts_us > p.ts_us ASOF LEFT JOIN ra q ON l.log_id = q.log_id AND l.b = q.camera AND l.ts_us <= q.ts_us""",
    "cp": f"SELECT *, sqrt(power(x - o.x, 2) + power(y - o.y, 2)) AS d, abs({mod('yaw_deg - o.yaw + 180')} - 180) AS dyaw FROM nn WHERE abs(o.t - ts_us) <= 50000",
}


def cp(sql: str) -> str:
    return over("vision", "odometry", sql=sql, **_CP)


def camera_pairs(spark, sf):
    """Frames with the nearest frame within 50 ms of each other camera of the log that comes after theirs by name."""
    frames = residuals(spark, sf)
    cameras = frames.select("log_id", "camera").distinct()
    pairs = cameras.withColumnRenamed("camera", "a").join(cameras.withColumnRenamed("camera", "b"), "log_id").where("a < b")  # a log has a few cameras
    left = frames.join(pairs, (frames["log_id"] == pairs["log_id"]) & (frames["camera"] == pairs["a"])).drop(pairs["log_id"])
    right = frames.join(pairs, (frames["log_id"] == pairs["log_id"]) & (frames["camera"] == pairs["b"])).drop(pairs["log_id"])
    right = right.select("log_id", "a", "b", "ts_us", "seq", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("yaw_deg").alias("oyaw"), F.col("res").alias("ores"))
    rows = K.asof_nearest(left, right, ["log_id", "a", "b"], ["ox", "oy", "oyaw", "ores"], 50_000, later=False).where("ox is not null")
    return rows.withColumns({"d": F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2), "dyaw": F.abs(G.yaw_diff_deg(F.col("yaw_deg"), F.col("oyaw")))})


@query("camera_agreement", cp("""
    SELECT a, b, count(*) AS n, round(avg(d), 4) AS mean_d, round(quantile_cont(d, .95), 3) AS p95_d, round(avg(dyaw), 4) AS mean_yaw, count(*) FILTER (round(o.res - res, 5) > .01) AS a_better, count(*) FILTER (round(res - o.res, 5) > .01) AS b_better FROM cp GROUP BY ALL"""))
def camera_agreement(spark, sf):
    gap = F.round(F.col("ores") - F.col("res"), 5)
    rows = camera_pairs(spark, sf)
    found = rows.groupBy("a", "b").agg(F.count("*").alias("n"), r4(F.avg("d")).alias("mean_d"), r4(F.avg("dyaw")).alias("mean_yaw"), F.count_if(gap > 0.01).alias("a_better"), F.count_if(gap < -0.01).alias("b_better"))
    return Qn.with_quantiles(found, rows, ["a", "b"], "d", p95_d=Qn.at(0.95)).withColumn("p95_d", F.round("p95_d", 3))


@query("agreement_series", cp("""
    SELECT log_id, ts_us // 1000000 AS second, round(avg(d), 4) AS mean_d FROM cp JOIN (SELECT log_id, min(a) AS a, min(b) FILTER (a = lo) AS b FROM (SELECT *, min(a) OVER (PARTITION BY log_id) AS lo FROM pr) GROUP BY log_id) z USING (log_id, a, b) GROUP BY ALL"""))
def agreement_series(spark, sf):
    """The first two cameras of each log by name, second by second."""
    rows = camera_pairs(spark, sf)
    cameras = A.vision(spark, sf).select("log_id", "camera").distinct()
    both = cameras.withColumnRenamed("camera", "a").join(cameras.withColumnRenamed("camera", "b"), "log_id").where("a < b")  # a log has a few cameras
    first = both.groupBy("log_id").agg(F.min(F.struct("a", "b")).alias("p")).select("log_id", "p.a", "p.b")
    return rows.join(first, ["log_id", "a", "b"], "left_semi").groupBy("log_id", F.floor(F.col("ts_us") / 1_000_000).alias("second")).agg(r4(F.avg("d")).alias("mean_d"))


@query("camera_pair_by_band", over("tags", "frames", sql="""
    SELECT tags, band, count(*) FILTER (camera = 'cam-a') AS n_a, count(*) FILTER (camera = 'cam-b') AS n_b, round(median(residual_raw) FILTER (camera = 'cam-a'), 4) AS median_a, round(median(residual_raw) FILTER (camera = 'cam-b'), 4) AS median_b
    FROM (SELECT frame_id, camera, residual_raw, least(count(*), 4) AS tags, CAST(floor(min(dist)) AS BIGINT) AS band FROM frames JOIN tags USING (frame_id) GROUP BY frame_id, camera, residual_raw) WHERE camera IN ('cam-a', 'cam-b') GROUP BY ALL"""))
def camera_pair_by_band(spark, sf):
    """The first two cameras by name side by side, by number of tags and distance of the nearest."""
    f = A.frames(spark, sf)
    names = [r["camera"] for r in f.select("camera").distinct().orderBy("camera").limit(2).collect()]  # the feature: two columns
    rows = f.join(A.tags(spark, sf), "frame_id").groupBy("frame_id", "camera", "residual_raw").agg(F.least(F.count("*"), F.lit(4)).alias("tags"), F.floor(F.min("dist")).alias("band"))
    of = lambda c: F.when(F.col("camera") == c, F.col("residual_raw"))
    out = [x for c, s in zip(names, "ab") for x in (F.count(of(c)).alias(f"n_{s}"), r4(F.median(of(c))).alias(f"median_{s}"))]
    return rows.where(F.col("camera").isin(names)).groupBy("tags", "band").agg(*out)


# Two kinds of pose of one camera: frames of even and odd numbers stand for them

_PK = {
    **_RS,
    "k1": "SELECT * FROM res WHERE seq % 2 = 0",
    "kb": "SELECT log_id, camera, ts_us, max_by(x, seq) AS x, max_by(y, seq) AS y, max_by(yaw_deg, seq) AS yaw, max_by(res, seq) AS res FROM res WHERE seq % 2 = 1 GROUP BY ALL",
    "ka": "SELECT log_id, camera, ts_us, min_by(x, seq) AS x, min_by(y, seq) AS y, min_by(yaw_deg, seq) AS yaw, min_by(res, seq) AS res FROM res WHERE seq % 2 = 1 GROUP BY ALL",
    "kn": """SELECT l.log_id, l.camera, l.ts_us, l.seq, l.x, l.y, l.yaw_deg, l.res, CASE WHEN p.ts_us IS NULL OR q.ts_us - l.ts_us <= l.ts_us - p.ts_us THEN {'t': q.ts_us, 'x': q.x, 'y': q.y, 'yaw': q.yaw, 'res': q.res} ELSE {'t': p.ts_us, 'x': p.x, 'y': p.y, 'yaw': p.yaw, 'res': p.res} END AS o
        FROM k1 l ASOF LEFT JOIN kb p ON l.log_id = p.log_id AND l.camera = p.camera AND l.ts_us > p.ts_us ASOF LEFT JOIN ka q ON l.log_id = q.log_id AND l.camera = q.camera AND l.ts_us <= q.ts_us""",
    "kk": f"SELECT *, sqrt(power(x - o.x, 2) + power(y - o.y, 2)) AS d, {mod('yaw_deg - o.yaw + 180')} - 180 AS dyaw FROM kn WHERE abs(o.t - ts_us) <= 50000",
}


def pk(sql: str, *names: str, **more: str) -> str:
    return over("vision", "odometry", *names, sql=sql, **_PK, **more)


def pose_kinds(spark, sf):
    """Frames of the first kind with the nearest of the second of the same camera within 50 ms, the later of two."""
    frames = residuals(spark, sf)
    second = frames.where("seq % 2 = 1").select("log_id", "camera", "ts_us", "seq", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("yaw_deg").alias("oyaw"), F.col("res").alias("ores"))
    rows = K.asof_nearest(frames.where("seq % 2 = 0"), second, ["log_id", "camera"], ["ox", "oy", "oyaw", "ores"], 50_000).where("ox is not null")
    return rows.withColumns({"d": F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2), "dyaw": G.yaw_diff_deg(F.col("yaw_deg"), F.col("oyaw"))})


@query("pose_kind_divergence", pk("SELECT seq, camera, round(d, 5) AS d, round(abs(dyaw), 6) AS dyaw FROM kk"))
def pose_kind_divergence(spark, sf):
    return pose_kinds(spark, sf).select("seq", "camera", F.round("d", 5).alias("d"), r6(F.abs("dyaw")).alias("dyaw"))


@query("pose_kind_summary", pk("""
    SELECT camera, count(*) AS n, round(avg(d), 4) AS mean_d, round(median(d), 4) AS median_d, round(quantile_cont(d, .95), 3) AS p95_d, round(avg(abs(dyaw)), 4) AS mean_yaw, round(avg(res), 4) AS first_r, round(avg(o.res), 4) AS second_r FROM kk GROUP BY ALL"""))
def pose_kind_summary(spark, sf):
    rows = pose_kinds(spark, sf)
    found = rows.groupBy("camera").agg(F.count("*").alias("n"), r4(F.avg("d")).alias("mean_d"), r4(F.avg(F.abs("dyaw"))).alias("mean_yaw"), r4(F.avg("res")).alias("first_r"), r4(F.avg("ores")).alias("second_r"))
    return Qn.with_quantiles(found, rows, ["camera"], "d", median_d=Qn.MEDIAN, p95_d=Qn.at(0.95)).withColumns({"median_d": r4("median_d"), "p95_d": F.round("p95_d", 3)})


@query("divergence_heatmap", pk(f"SELECT {_CELL} AS cell, count(*) AS n, round(avg(d), 4) AS mean_d FROM kk GROUP BY ALL"))
def divergence_heatmap(spark, sf):
    return pose_kinds(spark, sf).groupBy(G.field_cell(F.col("x"), F.col("y")).alias("cell")).agg(F.count("*").alias("n"), r4(F.avg("d")).alias("mean_d"))


_YE = {
    "ye": "SELECT k.log_id, k.ts_us, k.seq, round(abs(dyaw), 6) AS y, row_number() OVER (PARTITION BY k.log_id ORDER BY k.ts_us, k.seq) AS i FROM kk k ASOF JOIN phases p ON k.log_id = p.log_id AND k.ts_us >= p.start_us WHERE k.ts_us < p.end_us AND p.phase <> 'disabled'",
    "yf": "SELECT log_id, i, ts_us AS t, true AS kept, ts_us AS a FROM ye WHERE i = 1 UNION ALL SELECT h.log_id, h.i, h.ts_us, h.ts_us - f.a >= 1000000, CASE WHEN h.ts_us - f.a >= 1000000 THEN h.ts_us ELSE f.a END FROM yf f JOIN ye h ON h.log_id = f.log_id AND h.i = f.i + 1",
    "yw": "SELECT log_id, max(m) AS worst_median, arg_min(t, (-m, t)) AS worst_start_us FROM (SELECT f.log_id, f.t, round(median(y), 6) AS m FROM yf f JOIN ye h ON h.log_id = f.log_id AND h.ts_us >= f.t AND h.ts_us < f.t + 2000000 WHERE f.kept GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL",
}


@query("yaw_error_summary", over("vision", "odometry", "samples", "mode_signals", recursive=True, sql="""
    SELECT log_id, count(*) AS n, round(median(y), 6) AS median_yaw, round(avg(y), 4) AS mean_yaw, round(quantile_cont(y, .95), 4) AS p95_yaw, round(max(y), 6) AS max_yaw,
      round(100e0 * count(*) FILTER (y > 15) / count(*), 4) AS over_15, round(100e0 * count(*) FILTER (y > 30) / count(*), 4) AS over_30, round(100e0 * count(*) FILTER (y > 45) / count(*), 4) AS over_45, any_value(worst_median) AS worst_median, any_value(worst_start_us) AS worst_start_us
    FROM ye LEFT JOIN yw USING (log_id) GROUP BY log_id""", **_PK, **PH, **_YE))
def yaw_error_summary(spark, sf):
    """Yaw differences of the two kinds while the robot is enabled, and the worst of the windows of 2 s that begin at a row a second or more after the last."""
    rows = R.phase_of(pose_kinds(spark, sf), phases(spark, sf)).where("phase <> 'disabled'").withColumn("y", r6(F.abs("dyaw")))
    over_ = lambda x: r4(100.0 * F.count_if(F.col("y") > x) / F.count("*")).alias(f"over_{x}")
    found = rows.groupBy("log_id").agg(F.count("*").alias("n"), r6(F.median("y")).alias("median_yaw"), r4(F.avg("y")).alias("mean_yaw"), r4(F.percentile("y", F.lit(0.95))).alias("p95_yaw"), r6(F.max("y")).alias("max_yaw"), over_(15), over_(30), over_(45))
    starts = K.anchored_dedup(rows, ["log_id"], 999_999).select("log_id", "ts_us")
    windows = K.range_join(starts, rows.select("log_id", F.col("ts_us").alias("r_ts_us"), "y"), ["log_id"], 0, 1_999_999).groupBy("log_id", "ts_us").agg(F.count("*").alias("c"), r6(F.median("y")).alias("m")).where("c >= 3")
    worst = windows.groupBy("log_id").agg(F.max("m").alias("worst_median"), F.min_by("ts_us", F.struct(-F.col("m"), F.col("ts_us"))).alias("worst_start_us"))
    return found.join(worst, "log_id", "left")


@query("signed_residual_stats", over("vision", "odometry", sql="""
    SELECT camera, grouping, least(value, 99) AS value, count(*) AS n, round(avg(x - px), 4) AS mean_dx, round(stddev_pop(x - px), 4) AS std_dx, round(avg(y - py), 4) AS mean_dy, round(stddev_pop(y - py), 4) AS std_dy, round(median(res), 4) AS median_d
    FROM (SELECT r.*, 'tags' AS grouping, CAST(tag_count AS BIGINT) AS value FROM res r UNION ALL SELECT r.*, 'quadrant', CAST(floor(((yaw_deg % 360) + 360) % 360 / 90) AS BIGINT) FROM res r UNION ALL SELECT r.*, 'quality', CASE WHEN tag_count >= 2 THEN 1 ELSE 0 END FROM res r) GROUP BY ALL HAVING count(*) >= 3""", **_RS))
def signed_residual_stats(spark, sf):
    """Signed differences to the path per camera: by number of tags, by quarter of the heading, by quality."""
    rows = vision.residuals(spark, sf).withColumns({"dx": F.col("x") - F.col("p_x"), "dy": F.col("y") - F.col("p_y")})
    ways = {"tags": F.col("tag_count").cast("bigint"), "quadrant": F.floor(F.pmod("yaw_deg", F.lit(360.0)) / 90), "quality": (F.col("tag_count") >= 2).cast("bigint")}
    each = rows.select("camera", "dx", "dy", "res", F.explode(F.array(*[F.struct(F.lit(k).alias("grouping"), v.alias("value")) for k, v in ways.items()])).alias("g"))
    stats = [f(F.col(c)).alias(f"{n}_{c}") for c in ("dx", "dy") for n, f in (("mean", lambda c: r4(F.avg(c))), ("std", lambda c: r4(F.stddev_pop(c))))]
    each = each.select("camera", "g.grouping", "g.value", "dx", "dy", "res")
    found = each.groupBy("camera", "grouping", "value").agg(F.count("*").alias("n"), *stats).where("n >= 3")
    return Qn.with_quantiles(found, each, ["camera", "grouping", "value"], "res", median_d=Qn.MEDIAN).withColumn("median_d", r4("median_d"))


@query("phase_vision_stats", over("samples", "mode_signals", "vision", "odometry", sql="""
    SELECT phase, camera, count(*) AS n, round(avg(res), 4) AS mean_v, round(median(res), 4) AS median_v, round(list_sort(list(res))[CAST(least(floor(count(*) * .95) + 1, count(*)) AS BIGINT)], 4) AS p_floor
    FROM (SELECT v.camera, v.res, CASE WHEN v.ts_us < p.end_us THEN p.phase ELSE 'disabled' END AS phase FROM res v ASOF LEFT JOIN phases p ON v.log_id = p.log_id AND v.ts_us >= p.start_us) GROUP BY ALL""", **PH, **_RS))
def phase_vision_stats(spark, sf):
    rows = R.phase_of(residuals(spark, sf), phases(spark, sf)).select("phase", "camera", "res")
    stats = rows.groupBy("phase", "camera").agg(F.count("*").alias("n"), r4(F.avg("res")).alias("mean_v"))
    return Qn.with_quantiles(stats, rows, ["phase", "camera"], "res", median_v=Qn.MEDIAN, p_floor=Qn.floor_at(0.95)).withColumns({c: r4(c) for c in ("median_v", "p_floor")})


@query("initial_heading", over("samples", "mode_signals", "odometry", "vision", sql="""
    SELECT a.log_id, a.start_us, arg_min(o.theta_deg, (o.ts_us, o.seq)) FILTER (o.ts_us < a.start_us + 500000) AS first_deg, count(*) FILTER (o.ts_us < a.start_us + 500000) AS readings, any_value(e.y) AS early_yaw
    FROM (SELECT log_id, min(start_us) AS start_us FROM phases WHERE phase = 'auto' GROUP BY ALL) a JOIN odometry o ON o.log_id = a.log_id AND o.ts_us >= a.start_us AND o.ts_us <= a.start_us + 2000000
    LEFT JOIN (SELECT z.log_id, round(avg(abs(v.yaw_deg)), 6) AS y FROM (SELECT log_id, min(start_us) AS start_us FROM phases WHERE phase = 'auto' GROUP BY ALL) z JOIN vision v ON v.log_id = z.log_id AND v.ts_us BETWEEN z.start_us AND z.start_us + 2000000 GROUP BY ALL) e ON e.log_id = a.log_id GROUP BY a.log_id, a.start_us""", **PH))
def initial_heading(spark, sf):
    """The first heading in the half second after auto begins, and the cameras' mean yaw in its first two seconds."""
    starts = phases(spark, sf).where("phase = 'auto'").groupBy("log_id").agg(F.min("start_us").alias("ts_us"))
    right = lambda rows, *columns: K.range_join(starts, rows.select("log_id", F.col("ts_us").alias("r_ts_us"), *columns), ["log_id"], 0, 2_000_000)
    soon = F.col("r_ts_us") < F.col("ts_us") + 500_000
    odometry = right(A.odometry(spark, sf), "seq", "theta_deg").groupBy("log_id", F.col("ts_us").alias("start_us")).agg(
        F.min(F.when(soon, F.struct("r_ts_us", "seq", "theta_deg")))["theta_deg"].alias("first_deg"), F.count_if(soon).alias("readings")
    )
    early = right(A.vision(spark, sf), "yaw_deg").groupBy("log_id").agg(r6(F.avg(F.abs("yaw_deg"))).alias("early_yaw"))
    return odometry.join(early, "log_id", "left")


@query("before_after_groups", over("samples", "mode_signals", sql="""
    SELECT ['A', 'B', 'C'][log_id % 3 + 1] AS grp, phase, signal, count(*) AS n, round(median(v_double), 6) AS median_v
    FROM (SELECT s.log_id, s.signal, s.v_double, CASE WHEN s.ts_us < z.start_us AND s.ts_us >= z.start_us - 500000 THEN 'pre-auto' WHEN s.ts_us < p.end_us THEN p.phase ELSE 'disabled' END AS phase
      FROM samples s ASOF LEFT JOIN phases p ON s.log_id = p.log_id AND s.ts_us >= p.start_us LEFT JOIN (SELECT log_id, min(start_us) AS start_us FROM phases WHERE phase = 'auto' GROUP BY ALL) z ON z.log_id = s.log_id) GROUP BY ALL""", **PH))
def before_after_groups(spark, sf):
    """Groups of logs by a table of labels, per phase, with the half second before auto as a phase of its own."""
    labels = A.samples(spark, sf).select("log_id", F.element_at(F.array(*map(F.lit, "ABC")), (F.col("log_id") % 3 + 1).cast("int")).alias("grp")).distinct()
    found = phases(spark, sf)
    starts = found.where("phase = 'auto'").groupBy("log_id").agg(F.min("start_us").alias("auto_us"))
    rows = R.phase_of(A.samples(spark, sf), found).join(starts, "log_id", "left").join(labels, "log_id")
    before = (F.col("ts_us") < F.col("auto_us")) & (F.col("ts_us") >= F.col("auto_us") - 500_000)
    return rows.groupBy("grp", F.when(before, "pre-auto").otherwise(F.col("phase")).alias("phase"), "signal").agg(F.count("*").alias("n"), r6(F.median("v_double")).alias("median_v"))
