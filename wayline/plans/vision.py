"""Queries for angles, poses, cameras and maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.operators import kernel as K
from wayline.operators import quantiles as Qn
from wayline.operators import robot as R
from wayline.operators.basic import by_time, r6
from wayline.plans.robots import PH, phases
from wayline.plans.views_sql import over
from wayline.sources import adapters as A

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def r4(c):
    return F.round(c, 4)


_PI2 = "6.283185307179586"
_MOD = "((({a}) % {m}) + {m}) % {m}"


def mod(a: str, m: str = "360.0") -> str:
    return _MOD.format(a=a, m=m)


def _scalar(name, view, columns, sql):
    Q[name] = (lambda spark, sf: getattr(A, view)(spark, sf).select(*columns()), over(view, sql=f"SELECT {sql} FROM {view}"))


_scalar("normalize_angle", "odometry", lambda: ["seq", r4(G.normalize_angle(F.radians(F.col("theta_deg") * 3))).alias("a")],
        f"seq, round(CASE WHEN {mod('radians(theta_deg * 3)', _PI2)} > 3.141592653589793 THEN {mod('radians(theta_deg * 3)', _PI2)} - {_PI2} ELSE {mod('radians(theta_deg * 3)', _PI2)} END, 4) AS a")
_scalar("angle_diff", "odometry", lambda: ["seq", r4(G.angle_diff(F.radians("theta_deg"), F.lit(2.0))).alias("d")], f"seq, round({mod('radians(theta_deg) - 2.0 + 3.141592653589793', _PI2)} - 3.141592653589793, 4) AS d")
_scalar("wrap_yaw_diff", "odometry", lambda: ["seq", r6(G.yaw_diff_deg(F.col("theta_deg"), F.lit(100.0))).alias("d"), r6(F.abs(G.yaw_diff_deg(F.col("theta_deg"), F.lit(100.0)))).alias("m")],
        f"seq, round({mod('theta_deg - 100.0 + 180')} - 180, 6) AS d, round(abs({mod('theta_deg - 100.0 + 180')} - 180), 6) AS m")
_scalar("lerp", "odometry", lambda: ["seq", r6(K.lerp(F.col("x"), F.col("y"), F.lit(0.25))).alias("v")], "seq, round(x + (y - x) * 0.25, 6) AS v")
_scalar("lerp_angle", "odometry", lambda: ["seq", F.round(K.lerp_angle_deg(F.col("theta_deg"), F.lit(170.0), F.lit(0.25)), 8).alias("v")], f"seq, round(theta_deg + ({mod('170.0 - theta_deg + 180')} - 180) * 0.25, 8) AS v")
_scalar("heading_octant", "odometry", lambda: ["seq", G.octant(F.col("theta_deg")).alias("octant")], f"seq, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(({mod('theta_deg + 22.5')}) / 45) AS INT) + 1] AS octant")
_CELL = "CASE WHEN trunc(x / .5) BETWEEN 0 AND 33 AND trunc(y / .5) BETWEEN 0 AND 16 THEN CAST(trunc(y / .5) * 34 + trunc(x / .5) AS INT) END"
_scalar("field_cell", "odometry", lambda: ["seq", G.field_cell(F.col("x"), F.col("y")).alias("cell")], f"seq, {_CELL} AS cell")
_scalar("pose3d_quaternion", "vision", lambda: ["seq", r6(G.quaternion(F.lit(0.0), F.lit(10.0), F.col("yaw_deg"))["qw"]).alias("qw"), r6(G.quaternion(F.lit(0.0), F.lit(10.0), F.col("yaw_deg"))["qz"]).alias("qz")],
        "seq, round(cos(radians(10e0) / 2) * cos(radians(yaw_deg) / 2), 6) AS qw, round(cos(radians(10e0) / 2) * sin(radians(yaw_deg) / 2), 6) AS qz")


@query("parse_tag_array", over("tags", sql="SELECT frame_id, count(*) AS n, round(min(dist), 6) AS nearest FROM tags GROUP BY ALL"))
def parse_tag_array(spark, sf):
    value = F.array(F.col("tag_id").cast("double"), F.lit(0.0), F.lit(0.0), F.col("area"), F.col("dist"), F.col("dist"), F.col("ambiguity"))
    flat = A.tags(spark, sf).groupBy("frame_id").agg(F.flatten(F.collect_list(value)).alias("a"))
    found = flat.select("frame_id", G.tag_structs(F.col("a")).alias("t"))
    return found.select("frame_id", F.size("t").cast("bigint").alias("n"), r6(F.array_min("t.dist_camera")).alias("nearest"))


# Poses


@query("pose_sources", over("vision", "odometry", sql="""
    SELECT log_id, 'odometry' AS source, count(*) AS n, (max(ts_us) - min(ts_us)) / 1e6 AS span_s FROM odometry GROUP BY ALL HAVING count(*) >= 10
    UNION ALL SELECT log_id, camera, count(*), (max(ts_us) - min(ts_us)) / 1e6 FROM vision GROUP BY ALL HAVING count(*) >= 5"""))
def pose_sources(spark, sf):
    rows = A.odometry(spark, sf).select("log_id", F.lit("odometry").alias("source"), "ts_us").unionByName(A.vision(spark, sf).select("log_id", F.col("camera").alias("source"), "ts_us"))
    found = rows.groupBy("log_id", "source").agg(F.count("*").alias("n"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("span_s"))
    return found.where("n >= 10 or (source <> 'odometry' and n >= 5)")


def fused_path(spark, sf):
    """Odometry pulled towards vision within 20 ms and 2 m (weight .15 of summed confidence, at most .15), then smoothed over +-80 ms."""
    odo = A.odometry(spark, sf)
    seen = A.vision(spark, sf).select(
        "log_id", (F.col("ts_us") - F.col("latency_ms").cast("bigint") * 1000).alias("r_ts_us"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.when(F.col("tag_count") == 1, 0.6).otherwise(1.0).alias("c")
    )
    near = K.range_join(odo.select("log_id", "ts_us", "seq", "x", "y"), seen, ["log_id"], 20_000, 20_000)
    near = near.where((F.col("vx") - F.col("x")) ** 2 + (F.col("vy") - F.col("y")) ** 2 < 4)
    pull = near.groupBy("seq").agg(F.sum("c").alias("w"), (F.sum(F.col("vx") * F.col("c")) / F.sum("c")).alias("mx"), (F.sum(F.col("vy") * F.col("c")) / F.sum("c")).alias("my"))
    weight = F.coalesce(0.15 * F.least(F.col("w"), F.lit(1.0)), F.lit(0.0))
    rows = odo.join(pull, "seq", "left")
    rows = rows.withColumns({"fx": F.col("x") + weight * (F.coalesce("mx", "x") - F.col("x")), "fy": F.col("y") + weight * (F.coalesce("my", "y") - F.col("y"))})
    about = Window.partitionBy("log_id").orderBy("ts_us").rangeBetween(-80_000, 80_000)
    return rows.select("log_id", "ts_us", "seq", F.avg("fx").over(about).alias("x"), F.avg("fy").over(about).alias("y"), "theta_deg")


_PATH = {
    "seen": "SELECT log_id, ts_us - CAST(latency_ms AS BIGINT) * 1000 AS t, x AS vx, y AS vy, CASE WHEN tag_count = 1 THEN .6 ELSE 1.0 END AS c FROM vision",
    "pull": """SELECT o.seq, sum(c) AS w, sum(vx * c) / sum(c) AS mx, sum(vy * c) / sum(c) AS my FROM odometry o JOIN seen s ON o.log_id = s.log_id AND s.t BETWEEN o.ts_us - 20000 AND o.ts_us + 20000
               AND (vx - x) * (vx - x) + (vy - y) * (vy - y) < 4 GROUP BY o.seq""",
    "fused": """SELECT o.log_id, o.ts_us, o.seq, theta_deg, x + coalesce(.15 * least(w, 1.0), 0) * (coalesce(mx, x) - x) AS fx, y + coalesce(.15 * least(w, 1.0), 0) * (coalesce(my, y) - y) AS fy FROM odometry o LEFT JOIN pull USING (seq)""",
    "path": """SELECT log_id, ts_us, seq, theta_deg, avg(fx) OVER a AS x, avg(fy) OVER a AS y FROM fused WINDOW a AS (PARTITION BY log_id ORDER BY ts_us RANGE BETWEEN 80000 PRECEDING AND 80000 FOLLOWING)""",
}


def path_sql(sql: str, **more: str) -> str:
    return over("vision", "odometry", sql=sql, **_PATH, **more)


@query("reference_path", path_sql("SELECT seq, round(x, 5) AS x, round(y, 5) AS y FROM path"))
def reference_path(spark, sf):
    return fused_path(spark, sf).select("seq", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


_RES = """SELECT v.*, sqrt(power(v.x - px, 2) + power(v.y - py, 2)) AS res FROM (
    SELECT v.*, CASE WHEN b.ts_us IS NULL THEN a.x WHEN a.ts_us IS NULL OR b.ts_us = v.seen_us THEN b.x ELSE b.x + (a.x - b.x) * ((v.seen_us - b.ts_us) / (a.ts_us - b.ts_us)) END AS px,
           CASE WHEN b.ts_us IS NULL THEN a.y WHEN a.ts_us IS NULL OR b.ts_us = v.seen_us THEN b.y ELSE b.y + (a.y - b.y) * ((v.seen_us - b.ts_us) / (a.ts_us - b.ts_us)) END AS py
    FROM (SELECT *, ts_us - CAST(latency_ms * 1000 AS BIGINT) AS seen_us FROM vision) v ASOF LEFT JOIN ob b ON v.log_id = b.log_id AND v.seen_us >= b.ts_us ASOF LEFT JOIN oa a ON v.log_id = a.log_id AND v.seen_us <= a.ts_us) v"""
_RS = {
    **_PATH,
    "ob": "SELECT log_id, ts_us, max_by(x, seq) AS x, max_by(y, seq) AS y FROM path GROUP BY ALL",
    "oa": "SELECT log_id, ts_us, min_by(x, seq) AS x, min_by(y, seq) AS y FROM path GROUP BY ALL",
    "res": _RES,
}


def residuals(spark, sf):
    """Vision frames with their distance to the reference path at the time that they were taken, which is their own less the latency."""
    frames = A.vision(spark, sf).withColumns({"published_us": F.col("ts_us"), "ts_us": F.col("ts_us") - (F.col("latency_ms") * 1000).cast("bigint")})
    rows = K.interpolate_join(frames, fused_path(spark, sf), ["log_id"], ["x", "y"]).withColumn("ts_us", F.col("published_us")).drop("published_us")
    return rows.withColumn("res", F.sqrt((F.col("x") - F.col("p_x")) ** 2 + (F.col("y") - F.col("p_y")) ** 2))


def rs(sql: str, *names: str, **more: str) -> str:
    return over("vision", "odometry", *names, sql=sql, **_RS, **more)


def _by(name, keys, sql_keys, rows=residuals):
    """Count, mean, median, p95 and outlier share of residuals by some keys."""

    def run(spark, sf):
        by = [k if isinstance(k, str) else "tags" for k in keys()]
        found = rows(spark, sf).select(*keys(), "res")
        stats = found.groupBy(*by).agg(F.count("*").alias("n"), r4(F.avg("res")).alias("mean_r"), r4(F.avg(F.when(F.col("res") > 1, 100.0).otherwise(0.0))).alias("outlier_pct"))
        return Qn.with_quantiles(stats, found, by, "res", median_r=Qn.MEDIAN, p95_r=Qn.at(0.95)).withColumns({"median_r": r4("median_r"), "p95_r": F.round("p95_r", 3)})

    sql = f"SELECT {sql_keys}, count(*) AS n, round(avg(res), 4) AS mean_r, round(median(res), 4) AS median_r, round(quantile_cont(res, .95), 3) AS p95_r, round(avg(CASE WHEN res > 1 THEN 100.0 ELSE 0.0 END), 4) AS outlier_pct FROM res GROUP BY ALL"
    Q[name] = (run, rs(sql))


_by("tag_count_table", lambda: [F.least("tag_count", F.lit(4)).alias("tags")], "least(tag_count, 4) AS tags")
_by("log_accuracy_trend", lambda: ["log_id"], "log_id")


@query("vision_residuals", rs("SELECT seq, round(res, 5) AS res FROM res"))
def vision_residuals(spark, sf):
    return residuals(spark, sf).select("seq", F.round("res", 5).alias("res"))


@query("divergence_events", rs("""
    SELECT log_id, camera, min(ts_us) AS start_us, max(coalesce(nxt, ts_us)) AS end_us, count(*) AS n, round(max(res), 5) AS peak FROM (
      SELECT *, sum(c) OVER (PARTITION BY log_id, camera ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, lead(ts_us) OVER w AS nxt, CASE WHEN (res > .2) IS DISTINCT FROM lag(res > .2) OVER w THEN 1 ELSE 0 END AS c FROM res WINDOW w AS (PARTITION BY log_id, camera ORDER BY ts_us, seq)))
    WHERE res > .2 GROUP BY log_id, camera, run HAVING max(coalesce(nxt, ts_us)) - min(ts_us) >= 100000"""))
def divergence_events(spark, sf):
    found = K.threshold_runs(residuals(spark, sf), ["log_id", "camera"], F.col("res") > 0.2, "res", 100_000)
    return found.withColumn("peak", F.round("peak", 5))


@query("dropped_frames", over("vision", sql="SELECT log_id, camera, count(*) AS drops FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY log_id, camera ORDER BY ts_us, seq) AS gap FROM vision) WHERE gap > 50000 GROUP BY ALL"))
def dropped_frames(spark, sf):
    rows = A.vision(spark, sf).withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(by_time("log_id", "camera")))
    return rows.where("gap > 50000").groupBy("log_id", "camera").agg(F.count("*").alias("drops"))


@query("detection_gaps", over("vision", sql="SELECT log_id, camera, ts_us - gap AS start_us, ts_us AS end_us FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY log_id, camera ORDER BY ts_us, seq) AS gap FROM vision) WHERE gap > 500000"))
def detection_gaps(spark, sf):
    rows = A.vision(spark, sf).withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(by_time("log_id", "camera"))).where("gap > 500000")
    return rows.select("log_id", "camera", (F.col("ts_us") - F.col("gap")).alias("start_us"), F.col("ts_us").alias("end_us"))


@query("tag_id_table", over("tags", "frames", sql="""
    SELECT camera, tag_id, count(*) AS n, round(avg(dist), 6) AS mean_dist, round(avg(ambiguity), 6) AS mean_amb, round(100.0 * count(*) FILTER (ambiguity > .5) / count(*), 6) AS high_pct FROM tags JOIN frames USING (frame_id) GROUP BY ALL"""))
def tag_id_table(spark, sf):
    rows = A.tags(spark, sf).join(A.frames(spark, sf), "frame_id")
    return rows.groupBy("camera", "tag_id").agg(
        F.count("*").alias("n"), r6(F.avg("dist")).alias("mean_dist"), r6(F.avg("ambiguity")).alias("mean_amb"), r6(100.0 * F.count_if(F.col("ambiguity") > 0.5) / F.count("*")).alias("high_pct")
    )


@query("vision_by_phase", over("samples", "mode_signals", "vision", sql="""
    SELECT v.camera, CASE WHEN v.ts_us < p.end_us THEN p.phase ELSE 'disabled' END AS phase, count(*) AS n, round(avg(latency_ms), 6) AS latency FROM vision v ASOF LEFT JOIN phases p ON v.log_id = p.log_id AND v.ts_us >= p.start_us GROUP BY ALL""", **PH))
def vision_by_phase(spark, sf):
    return R.phase_of(A.vision(spark, sf), phases(spark, sf)).groupBy("camera", "phase").agg(F.count("*").alias("n"), r6(F.avg("latency_ms")).alias("latency"))


@query("field_heatmap", rs(f"""
    SELECT cell, coalesce(o.n, 0) AS path_n, coalesce(v.n, 0) AS frames, v.median_r FROM (SELECT {_CELL} AS cell, count(*) AS n FROM odometry GROUP BY ALL) o
    FULL JOIN (SELECT {_CELL.replace('x /', 'px /').replace('y /', 'py /')} AS cell, count(*) AS n, round(median(res), 4) AS median_r FROM res GROUP BY ALL) v USING (cell)"""))
def field_heatmap(spark, sf):
    path = A.odometry(spark, sf).groupBy(G.field_cell(F.col("x"), F.col("y")).alias("cell")).agg(F.count("*").alias("path_n"))
    rows = residuals(spark, sf).select(G.field_cell(F.col("p_x"), F.col("p_y")).alias("cell"), "res")
    seen = Qn.with_quantiles(rows.groupBy("cell").agg(F.count("*").alias("frames")), rows, ["cell"], "res", median_r=Qn.MEDIAN).withColumn("median_r", r4("median_r"))
    out = path.join(seen, "cell", "full")
    return out.select("cell", F.coalesce("path_n", F.lit(0)).alias("path_n"), F.coalesce("frames", F.lit(0)).alias("frames"), "median_r")


@query("preferred_camera", rs(f"""
    SELECT cell, arg_min(camera, (m, camera)) AS camera, count(*) AS cameras, round(list_sort(list(m))[2] - min(m), 4) AS advantage FROM (SELECT {_CELL.replace('x /', 'px /').replace('y /', 'py /')} AS cell, camera, round(median(res), 4) AS m FROM res GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL HAVING count(*) >= 2"""))
def preferred_camera(spark, sf):
    rows = residuals(spark, sf).select(G.field_cell(F.col("p_x"), F.col("p_y")).alias("cell"), "camera", "res")
    per = Qn.with_quantiles(rows.groupBy("cell", "camera").agg(F.count("*").alias("n")).where("n >= 5"), rows, ["cell", "camera"], "res", m=Qn.MEDIAN).withColumn("m", r4("m"))
    best = per.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("m", "camera"))).alias("c")).where(F.size("c") >= 2)  # one entry a camera
    return best.select("cell", F.col("c")[0]["camera"].alias("camera"), F.size("c").cast("bigint").alias("cameras"), r4(F.col("c")[1]["m"] - F.col("c")[0]["m"]).alias("advantage"))


@query("heading_coverage", over("odometry", sql=f"""
    SELECT o AS octant, count(k) AS n FROM (SELECT unnest(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW']) AS o) LEFT JOIN (SELECT ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(({mod('theta_deg + 22.5')}) / 45) AS INT) + 1] AS k FROM odometry) ON o = k GROUP BY ALL"""))
def heading_coverage(spark, sf):
    labels = spark.createDataFrame([(o,) for o in G.OCTANTS], "octant string")
    counts = A.odometry(spark, sf).groupBy(G.octant(F.col("theta_deg")).alias("octant")).agg(F.count("*").alias("c"))
    return labels.join(counts, "octant", "left").select("octant", F.coalesce("c", F.lit(0)).alias("n"))


_SIDE = "SELECT frame_id, count(*) FILTER (tag_id <= 16) AS low, count(*) FILTER (tag_id > 16) AS high FROM tags GROUP BY ALL"


def sides(spark, sf):
    return A.tags(spark, sf).groupBy("frame_id").agg(F.count_if(F.col("tag_id") <= 16).alias("low"), F.count_if(F.col("tag_id") > 16).alias("high"))


@query("frame_side", over("tags", sql="SELECT frame_id, CASE WHEN low > high THEN 'red' WHEN high > low THEN 'blue' ELSE 'both' END AS side FROM s", s=_SIDE))
def frame_side(spark, sf):
    return sides(spark, sf).select("frame_id", F.when(F.col("low") > F.col("high"), "red").when(F.col("high") > F.col("low"), "blue").otherwise("both").alias("side"))


@query("frame_target_class", over("tags", sql="SELECT frame_id, CASE WHEN high = 0 THEN 'hub' WHEN low = 0 THEN 'station' ELSE 'mixed' END AS target FROM s", s=_SIDE))
def frame_target_class(spark, sf):
    return sides(spark, sf).select("frame_id", F.when(F.col("high") == 0, "hub").when(F.col("low") == 0, "station").otherwise("mixed").alias("target"))


@query("log_alliance", over("tags", "frames", sql="SELECT log_id, CASE WHEN sum(low) > 1.5 * sum(high) THEN 'red' WHEN sum(high) > 1.5 * sum(low) THEN 'blue' ELSE 'unknown' END AS alliance FROM s JOIN frames USING (frame_id) GROUP BY ALL", s=_SIDE))
def log_alliance(spark, sf):
    rows = sides(spark, sf).join(A.frames(spark, sf), "frame_id").groupBy("log_id").agg(F.sum("low").alias("l"), F.sum("high").alias("h"))
    return rows.select("log_id", F.when(F.col("l") > 1.5 * F.col("h"), "red").when(F.col("h") > 1.5 * F.col("l"), "blue").otherwise("unknown").alias("alliance"))
