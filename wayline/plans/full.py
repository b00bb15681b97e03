"""Queries for power, impacts, what happens around overruns, cameras and sources, with all columns of their reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.operators import kernel as K
from wayline.operators import quantiles as Qn
from wayline.operators import robot as R
from wayline.operators.basic import SIGNAL, by_time, r6
from wayline.plans import basics as robots_basics
from wayline.plans import robots
from wayline.plans.robots import _CMD, _IM, _OV, _PHASE, _AT, _WATTS, CHANNELS, PH, ph, phases, watts
from wayline.plans.views_sql import over
from wayline.plans.vision import _PATH, fused_path, mod, r4, residuals, rs
from wayline.sources import adapters as A

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# Power: a channel that never reports is part of the list

_ALL_CHANNELS = [*CHANNELS, "spare"]
_ZERO = "coalesce(round({}, 4), 0)"


@query("channel_power", over("samples", sql=f"""
    SELECT c.log_id, c.signal, {', '.join(f'{_ZERO.format(f"{f}({v})")} AS {n}' for n, f, v in (('avg_w', 'avg', 'watts'), ('peak_w', 'max', 'watts'), ('min_w', 'min', 'watts'), ('avg_a', 'avg', 'v_double'), ('peak_a', 'max', 'v_double'), ('min_a', 'min', 'v_double')))}, count(watts) AS n
    FROM (SELECT log_id, unnest({_ALL_CHANNELS}) AS signal FROM (SELECT DISTINCT log_id FROM samples)) c LEFT JOIN w ON w.log_id = c.log_id AND w.signal = c.signal GROUP BY ALL""", w=_WATTS))
def channel_power(spark, sf):
    """Watts and amps of each channel of each log, zeros for one that never reports."""
    stats = [r4(f(c)).alias(n) for n, f, c in (("avg_w", F.avg, "watts"), ("peak_w", F.max, "watts"), ("min_w", F.min, "watts"), ("avg_a", F.avg, "v_double"), ("peak_a", F.max, "v_double"), ("min_a", F.min, "v_double"))]
    found = watts(spark, sf).groupBy(*SIGNAL).agg(*stats, F.count("watts").alias("n"))
    known = A.samples(spark, sf).select("log_id").distinct().withColumn("signal", F.explode(F.array(*map(F.lit, _ALL_CHANNELS))))
    return known.join(found, SIGNAL, "left").na.fill(0)


@query("bus_power_summary", over("samples", sql="""
    SELECT s.log_id, c.channels, round(avg(v_double) FILTER (signal = 'view'), 4) AS avg_v, round(min(v_double) FILTER (signal = 'view'), 4) AS min_v, round(avg(v_double) FILTER (signal = 'signup'), 4) AS avg_total_a, round(max(v_double) FILTER (signal = 'signup'), 4) AS peak_total_a,
      round(c.total, 4) AS total_avg_w, round(c.peak, 4) AS peak_w
    FROM samples s JOIN (SELECT log_id, count(*) AS channels, sum(a) AS total, max(p) AS peak FROM (SELECT log_id, signal, avg(watts) AS a, max(watts) AS p FROM w GROUP BY ALL) GROUP BY ALL) c ON c.log_id = s.log_id GROUP BY s.log_id, c.channels, c.total, c.peak""", w=_WATTS))
def bus_power_summary(spark, sf):
    """Bus voltage, total current and the sum of the channels' mean power of each log."""
    of = lambda name: F.when(F.col("signal") == name, F.col("v_double"))
    bus = A.samples(spark, sf).groupBy("log_id").agg(r4(F.avg(of("view"))).alias("avg_v"), r4(F.min(of("view"))).alias("min_v"), r4(F.avg(of("signup"))).alias("avg_total_a"), r4(F.max(of("signup"))).alias("peak_total_a"))
    per = watts(spark, sf).groupBy(*SIGNAL).agg(F.avg("watts").alias("a"), F.max("watts").alias("p"))
    return bus.join(per.groupBy("log_id").agg(F.count("*").alias("channels"), r4(F.sum("a")).alias("total_avg_w"), r4(F.max("p")).alias("peak_w")), "log_id")


@query("phase_power", ph(f"""
    SELECT l.log_id, l.phase, coalesce(round(avg(watts), 4), 0) AS avg_w, coalesce(round(max(watts), 4), 0) AS peak_w, coalesce(round(min(watts), 4), 0) AS min_w, count(watts) AS n
    FROM (SELECT log_id, unnest(['auto', 'teleop', 'disabled']) AS phase FROM (SELECT DISTINCT log_id FROM phases)) l LEFT JOIN (SELECT s.log_id, s.watts, {_PHASE} AS phase FROM w s {_AT}) x ON x.log_id = l.log_id AND x.phase = l.phase GROUP BY ALL""", w=_WATTS))
def phase_power(spark, sf):
    """Watts of all channels in auto, teleop and disabled of each log, zeros for a phase without samples."""
    found = phases(spark, sf)
    per = R.phase_of(watts(spark, sf), found).groupBy("log_id", "phase").agg(r4(F.avg("watts")).alias("avg_w"), r4(F.max("watts")).alias("peak_w"), r4(F.min("watts")).alias("min_w"), F.count("watts").alias("n"))
    known = found.select("log_id").distinct().withColumn("phase", F.explode(F.array(*map(F.lit, ("auto", "teleop", "disabled")))))
    return known.join(per, ["log_id", "phase"], "left").na.fill(0)


# Impacts

_AX = robots._AX.replace("FROM samples GROUP", ", max(v_double) FILTER (signal = 'signup') AS omega FROM samples GROUP")
_HITS = {
    **_IM, "ax": _AX,
    "lo": "SELECT *, abs(mag - 1) AS v_double, coalesce(min(mag) OVER (PARTITION BY log_id ORDER BY ts_us RANGE BETWEEN 200000 PRECEDING AND 1 PRECEDING) < .9, FALSE) AS freefall, CASE WHEN mag > 0 THEN sqrt(ax * ax + ay * ay) / mag ELSE 0 END AS lateral FROM mg",
    "hits": """SELECT p.log_id, p.ts_us, p.seq, round(p.score, 6) AS score, CASE WHEN p.score >= 2 THEN 'hard' WHEN p.score >= 1 THEN 'moderate' ELSE 'light' END AS severity,
      CASE WHEN lo.freefall AND lo.lateral < .85 THEN 'landing' WHEN abs(coalesce(lo.omega, 0)) > 50 THEN 'collision_spinning' ELSE 'collision_head_on' END AS kind, round(lo.lateral, 6) AS lateral, lo.freefall FROM pk p JOIN lo ON lo.log_id = p.log_id AND lo.seq = p.seq""",
}


def hits(spark, sf):
    rows = A.samples(spark, sf).withColumn("t", F.floor(F.col("ts_us") / 50_000) * 50_000)
    pick = lambda s: F.max(F.when(F.col("signal") == s, F.col("v_double")))
    axes = rows.groupBy("log_id", F.col("t").alias("ts_us")).agg(F.min("seq").alias("seq"), *[(pick(s) / 100).alias(c) for s, c in (("click", "ax"), ("view", "ay"), ("error", "az"))], pick("signup").alias("omega"))
    found = R.impacts(axes.na.drop(subset=["ax", "ay", "az"]), 0.5, 1.0, 2.0, fall=0.9, lateral=0.85)
    return found.withColumns({"score": r6("score"), "lateral": r6("lateral")})


@query("hard_hits_accel", over("samples", recursive=True, sql="SELECT * FROM hits", **_HITS))
def hard_hits_accel(spark, sf):
    return hits(spark, sf)


@query("hard_hits_report", over("samples", "mode_signals", recursive=True, sql="""
    SELECT h.log_id, h.ts_us, h.severity, h.kind, h.score, coalesce(p.phase, 'disabled') AS phase, round((h.ts_us - p.start_us) / 1e6, 6) AS phase_s, CASE WHEN h.ts_us >= m.match_us THEN round((h.ts_us - m.match_us) / 1e6, 6) END AS match_s, count(*) OVER (PARTITION BY h.log_id, h.severity) AS of_severity
    FROM hits h LEFT JOIN (SELECT h.log_id, h.seq, arg_min(p.phase, p.idx) AS phase, min(p.start_us) AS start_us FROM hits h JOIN phases p ON p.log_id = h.log_id AND h.ts_us BETWEEN p.start_us AND p.end_us GROUP BY ALL) p ON p.log_id = h.log_id AND p.seq = h.seq
    LEFT JOIN (SELECT log_id, coalesce(min(start_us) FILTER (phase = 'auto'), min(start_us) FILTER (phase <> 'disabled')) AS match_us FROM phases GROUP BY ALL) m ON m.log_id = h.log_id""", **PH, **_HITS))
def hard_hits_report(spark, sf):
    """Each hit with its phase, match time and phase time, and how many of its severity the log has."""
    rows = R.hits_in_match(hits(spark, sf), phases(spark, sf))
    return rows.select("log_id", "ts_us", "severity", "kind", "score", "phase", r6("phase_s").alias("phase_s"), r6("match_s").alias("match_s"), F.count("*").over(Window.partitionBy("log_id", "severity")).alias("of_severity"))


# Around overruns


@query("nearby_events", over("console", sql="""
    SELECT log_id, event, near_seq, category, offset_us, CAST(row_number() OVER (PARTITION BY log_id, event ORDER BY abs(offset_us), CASE category WHEN 'command' THEN 2 ELSE 5 END, near_seq) AS INT) AS place FROM (
      SELECT e.log_id, e.event, c.seq AS near_seq, k AS category, c.ts_us - e.event_us AS offset_us FROM ev e JOIN (SELECT *, unnest(['command', 'other']) AS k FROM c) c ON e.log_id = c.log_id AND abs(c.ts_us - e.event_us) <= CAST(floor((1 + e.total_s) * 1e6) AS BIGINT))""", **_OV, c=_CMD))
def nearby_events(spark, sf):
    console = A.console(spark, sf)
    return R.nearby_events(R.overrun_events(console), console, R.commands(console))


# Cameras and sources

_CS = """SELECT r.*, CASE WHEN tag_count >= 2 OR seq % 5 <> 0 THEN 1 ELSE 0 END AS valid, ts_us - lag(ts_us) OVER (PARTITION BY log_id, camera ORDER BY ts_us, seq) AS gap FROM res r"""


@query("camera_summary", rs("""
    SELECT log_id, camera, count(*) AS frames, CAST(sum(valid) AS BIGINT) AS valid, round(100e0 * sum(valid) / count(*), 6) AS valid_pct, round(avg(latency_ms) FILTER (valid = 1), 6) AS mean_latency, round(quantile_cont(latency_ms, .95) FILTER (valid = 1), 4) AS p95_latency,
      round(avg(res) FILTER (valid = 1), 4) AS mean_r, round(median(res) FILTER (valid = 1), 4) AS median_r, count(*) FILTER (valid = 1 AND res > .3) AS outliers, round(100e0 * count(*) FILTER (valid = 1 AND res > .3) / nullif(sum(valid), 0), 6) AS outlier_pct, count(*) FILTER (gap > 50000) AS dropped,
      count(*) FILTER (valid = 0) AS tags_0, count(*) FILTER (valid = 1 AND tag_count = 1) AS tags_1, count(*) FILTER (valid = 1 AND tag_count = 2) AS tags_2, count(*) FILTER (valid = 1 AND tag_count = 3) AS tags_3, count(*) FILTER (valid = 1 AND tag_count >= 4) AS tags_4 FROM cs GROUP BY ALL""", cs=_CS))
def camera_summary(spark, sf):
    """Each camera of each log: share of valid frames, latency, residuals, outliers, drops and how many tags its frames have."""
    rows = residuals(spark, sf).withColumns({"valid": (F.col("tag_count") >= 2) | (F.col("seq") % 5 != 0), "gap": F.col("ts_us") - F.lag("ts_us").over(by_time("log_id", "camera"))})
    rows = rows.withColumns({"lat": F.when(F.col("valid"), F.col("latency_ms")), "r": F.when(F.col("valid"), F.col("res"))})
    keys, out = ["log_id", "camera"], F.col("r") > 0.3
    n_valid = F.count_if("valid")
    tags = [F.count_if(F.col("valid") & (F.col("tag_count") == i if i < 4 else F.col("tag_count") >= 4)).alias(f"tags_{i}") for i in range(1, 5)]
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("frames"), n_valid.alias("valid"), r6(100.0 * n_valid / F.count("*")).alias("valid_pct"), r6(F.avg("lat")).alias("mean_latency"), r4(F.avg("r")).alias("mean_r"), F.count_if(out).alias("outliers"),
        r6(100.0 * F.count_if(out) / F.nullif(n_valid, F.lit(0))).alias("outlier_pct"), F.count_if(F.col("gap") > 50_000).alias("dropped"), F.count_if(~F.col("valid")).alias("tags_0"), *tags,
    )
    found = Qn.with_quantiles(found, rows, keys, "lat", p95_latency=Qn.at(0.95))
    return Qn.with_quantiles(found, rows, keys, "r", median_r=Qn.MEDIAN).withColumns({"p95_latency": r4("p95_latency"), "median_r": r4("median_r")})


_SD = {
    **_PATH,
    "hb": "SELECT log_id, ts_us, arg_max(x, seq) AS x, arg_max(y, seq) AS y, arg_max(theta_deg, seq) AS th FROM path GROUP BY ALL",
    "ha": "SELECT log_id, ts_us, arg_min(x, seq) AS x, arg_min(y, seq) AS y, arg_min(theta_deg, seq) AS th FROM path GROUP BY ALL",
    "hp": f"""SELECT v.*, CASE WHEN b.ts_us IS NULL THEN a.x WHEN a.ts_us IS NULL OR b.ts_us = v.ts_us THEN b.x ELSE b.x + (a.x - b.x) * ((v.ts_us - b.ts_us) / (a.ts_us - b.ts_us)) END AS px, CASE WHEN b.ts_us IS NULL THEN a.y WHEN a.ts_us IS NULL OR b.ts_us = v.ts_us THEN b.y ELSE b.y + (a.y - b.y) * ((v.ts_us - b.ts_us) / (a.ts_us - b.ts_us)) END AS py,
        CASE WHEN b.ts_us IS NULL THEN a.th WHEN a.ts_us IS NULL OR b.ts_us = v.ts_us THEN b.th ELSE b.th + ({mod('a.th - b.th + 180')} - 180) * ((v.ts_us - b.ts_us) / (a.ts_us - b.ts_us)) END AS pth
        FROM vision v ASOF LEFT JOIN hb b ON v.log_id = b.log_id AND v.ts_us >= b.ts_us ASOF LEFT JOIN ha a ON v.log_id = a.log_id AND v.ts_us <= a.ts_us""",
    "he": f"SELECT *, sqrt(power(x - px, 2) + power(y - py, 2)) AS te, abs({mod('yaw_deg - pth + 180')} - 180) AS dh FROM hp",
}


@query("source_divergence", over("vision", "odometry", sql="""
    SELECT log_id, camera, n, round(rms, 4) AS rms, round(worst, 4) AS worst, round(heading_rms, 7) AS heading_rms, round(heading_worst, 7) AS heading_worst, round(coverage, 6) AS coverage, CASE WHEN n >= 100 AND coverage > .5 THEN 'high' WHEN n >= 20 AND coverage > .2 THEN 'medium' ELSE 'low' END AS confidence FROM (
      SELECT h.log_id, camera, count(*) AS n, sqrt(avg(te * te)) AS rms, max(te) AS worst, sqrt(avg(dh * dh)) AS heading_rms, max(dh) AS heading_worst, greatest(0, least(max(ts_us), any_value(z)) - greatest(min(ts_us), any_value(a))) / greatest(any_value(z) - any_value(a), 1) AS coverage
      FROM he h JOIN (SELECT log_id, min(ts_us) AS a, max(ts_us) AS z FROM odometry GROUP BY ALL) o ON o.log_id = h.log_id GROUP BY h.log_id, camera)""", **_SD))
def source_divergence(spark, sf):
    """Each camera's poses against the reference path: place and heading, the part of the path's time that they span, and a grade."""
    path = fused_path(spark, sf)
    rows = K.interpolate_join(A.vision(spark, sf), path, ["log_id"], ["x", "y"], "theta_deg")
    rows = rows.withColumns({"te": F.sqrt(F.pow(F.col("x") - F.col("p_x"), F.lit(2.0)) + F.pow(F.col("y") - F.col("p_y"), F.lit(2.0))), "dh": F.abs(G.yaw_diff_deg(F.col("yaw_deg"), F.col("p_theta_deg")))})
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    per = rows.groupBy("log_id", "camera").agg(F.count("*").alias("n"), rms("te").alias("rms"), F.max("te").alias("worst"), rms("dh").alias("heading_rms"), F.max("dh").alias("heading_worst"), F.min("ts_us").alias("b"), F.max("ts_us").alias("e"))
    span = A.odometry(spark, sf).groupBy("log_id").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
    coverage = F.greatest(F.lit(0), F.least("e", "z") - F.greatest("b", "a")) / F.greatest(F.col("z") - F.col("a"), F.lit(1))
    found = per.join(span, "log_id").withColumn("coverage", coverage)
    grade = F.when((F.col("n") >= 100) & (F.col("coverage") > 0.5), "high").when((F.col("n") >= 20) & (F.col("coverage") > 0.2), "medium").otherwise("low")
    return found.select("log_id", "camera", "n", *[r4(c).alias(c) for c in ("rms", "worst")], *[F.round(c, 7).alias(c) for c in ("heading_rms", "heading_worst")], r6("coverage").alias("coverage"), grade.alias("confidence"))


# Logs and cameras in pairs

_PARTS = "SELECT DISTINCT log_id // 2 AS set_id, log_id % 2 AS side, signal, ts_us % 50 AS k FROM samples"


def _only(side: int):
    def run(spark, sf):
        rows = A.samples(spark, sf).selectExpr("log_id div 2 as set_id", "log_id % 2 as side", "signal", "ts_us % 50 as k").distinct()
        return rows.where(F.col("side") == side).join(rows.where(F.col("side") == 1 - side), ["set_id", "signal", "k"], "left_anti").select("set_id", "signal", "k")

    return run


for _name, _side in (("signals_only_in_a", 0), ("signals_only_in_b", 1)):
    query(_name, over("samples", sql=f"SELECT set_id, signal, k FROM p WHERE side = {_side} EXCEPT SELECT set_id, signal, k FROM p WHERE side = {1 - _side}", p=_PARTS))(_only(_side))


@query("nearest_pair_join", over("vision", sql="""
    SELECT l.seq, l.b, CASE WHEN x.ts_us IS NOT NULL AND (y.ts_us IS NULL OR l.ts_us - x.ts_us <= y.ts_us - l.ts_us) THEN CASE WHEN l.ts_us - x.ts_us <= 50000 THEN x.seq END WHEN y.ts_us - l.ts_us <= 50000 THEN y.seq END AS other
    FROM (SELECT v.*, p.b FROM vision v JOIN pr p ON p.log_id = v.log_id AND p.a = v.camera) l ASOF LEFT JOIN vb x ON l.log_id = x.log_id AND l.b = x.camera AND l.ts_us > x.ts_us ASOF LEFT JOIN vf y ON l.log_id = y.log_id AND l.b = y.camera AND l.ts_us <= y.ts_us""",
    pr="SELECT x.log_id, x.camera AS a, y.camera AS b FROM (SELECT DISTINCT log_id, camera FROM vision) x JOIN (SELECT DISTINCT log_id, camera FROM vision) y ON x.log_id = y.log_id AND x.camera < y.camera",
    vb="SELECT log_id, camera, ts_us, max(seq) AS seq FROM vision GROUP BY ALL", vf="SELECT log_id, camera, ts_us, min(seq) AS seq FROM vision GROUP BY ALL"))
def nearest_pair_join(spark, sf):
    """Each camera's frames with the nearest frame, within 50 ms, of each camera of the log that comes after it by name."""
    frames = A.vision(spark, sf)
    cameras = frames.select("log_id", "camera").distinct()
    pairs = cameras.withColumnRenamed("camera", "a").join(cameras.withColumnRenamed("camera", "b"), "log_id").where("a < b")  # a log has a few cameras
    left = frames.withColumnRenamed("camera", "a").join(pairs, ["log_id", "a"])
    right = frames.select("log_id", F.col("camera").alias("b"), "ts_us", "seq", F.col("seq").alias("other")).join(pairs, ["log_id", "b"])
    return K.asof_nearest(left, right, ["log_id", "a", "b"], ["other"], 50_000, later=False).select("seq", "b", "other")


# Overruns

_PERIOD = "SELECT log_id, coalesce(arg_min(CAST(regexp_extract(text, '[Ll]oop time of ([0-9.]+)s', 1) AS DOUBLE), (ts_us, seq)), .02) AS period FROM console WHERE text LIKE '%overrun%' AND text LIKE '%oop time%' GROUP BY ALL"


def ov(sql: str, **more: str) -> str:
    return over("console", sql=sql, **_OV, **more)


@query("overrun_summary", ov("""
    SELECT c.log_id, n AS overruns, scheduler, m.markers - scheduler AS orphans, p.period AS period_s, CAST(floor(d / (p.period * 1e6)) AS BIGINT) AS loops, round(100e0 * n / floor(d / (p.period * 1e6)), 6) AS pct
    FROM (SELECT log_id, count(*) AS n, CAST(sum(scheduler) AS BIGINT) AS scheduler FROM ev GROUP BY ALL) c JOIN (SELECT log_id, max(ts_us) - min(ts_us) AS d FROM console GROUP BY ALL) r USING (log_id)
    JOIN (SELECT log_id, count(*) FILTER (text = 'CommandScheduler loop overrun') AS markers FROM console GROUP BY ALL) m USING (log_id) JOIN pe p USING (log_id)""", pe=_PERIOD))
def overrun_summary(spark, sf):
    """Overruns of each log beside its loops at the period that it tells, and scheduler markers that belong to no overrun."""
    console = A.console(spark, sf)
    found = R.overrun_events(console).groupBy("log_id").agg(F.count("*").alias("overruns"), F.sum("scheduler").alias("scheduler"))
    span = console.groupBy("log_id").agg((F.max("ts_us") - F.min("ts_us")).alias("d"), F.count_if(F.col("text") == "CommandScheduler loop overrun").alias("markers"))
    rows = found.join(span, "log_id").join(robots.detect_loop_period(spark, sf), "log_id").withColumn("loops", F.floor(F.col("d") / (F.col("period_s") * 1e6)))
    return rows.select("log_id", "overruns", "scheduler", (F.col("markers") - F.col("scheduler")).alias("orphans"), "period_s", "loops", r6(100.0 * F.col("overruns") / F.col("loops")).alias("pct"))


@query("overrun_distribution", ov("SELECT log_id, " + ", ".join(f"round(quantile_cont(total_s * 1000, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", round(max(total_s * 1000), 4) AS worst FROM ev GROUP BY ALL"))
def overrun_distribution(spark, sf):
    rows = R.overrun_events(A.console(spark, sf)).withColumn("ms", F.col("total_s") * 1000)
    found = rows.groupBy("log_id").agg(r4(F.max("ms")).alias("worst"))
    return Qn.with_quantiles(found, rows, ["log_id"], "ms", p50=Qn.at(0.5), p90=Qn.at(0.9), p95=Qn.at(0.95), p99=Qn.at(0.99)).withColumns({c: r6(c) for c in ("p50", "p90", "p95", "p99")})


_TOP = "SELECT log_id, event, array_to_string(list(component ORDER BY seconds DESC, component)[1:3], ',') AS top FROM ex GROUP BY ALL"


def top_components(timings, keys, n=3):
    """The slowest components of each group, by time and then by name, joined by commas."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seconds"), "component"))
    rows = timings.withColumn("place", place).where(F.col("place") <= n)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "component"))), lambda x: x["component"]), ",").alias("top"))


@query("worst_k_overruns", ov("SELECT ev.log_id, ev.event, ev.total_s, t.top FROM ev LEFT JOIN t ON t.log_id = ev.log_id AND t.event = ev.event ORDER BY ev.total_s DESC, ev.log_id, ev.event LIMIT 5", t=_TOP))
def worst_k_overruns(spark, sf):
    """The five longest overruns with their three slowest components."""
    console = A.console(spark, sf)
    worst = R.overrun_events(console).select("log_id", "event", "total_s").orderBy(F.desc("total_s"), "log_id", "event").limit(5)
    timings = R.epochs(R.overrun_messages(console)).join(F.broadcast(worst.select("log_id", "event")), ["log_id", "event"], "left_semi")  # five rows
    return worst.join(top_components(timings, ["log_id", "event"]), ["log_id", "event"], "left")


@query("tracer_component_rollup", ov("SELECT component, count(*) AS n, round(avg(seconds), 8) AS mean_s, round(list_sort(list(seconds))[CAST(least(floor(count(*) * .95) + 1, count(*)) AS BIGINT)], 6) AS p95_s, round(max(seconds), 6) AS max_s FROM ex GROUP BY ALL ORDER BY max_s DESC, component LIMIT 30"))
def tracer_component_rollup(spark, sf):
    timings = R.epochs(R.overrun_messages(A.console(spark, sf)))
    rows = timings.groupBy("component").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 8).alias("mean_s"), r6(F.max("seconds")).alias("max_s"))
    return Qn.with_quantiles(rows, timings, ["component"], "seconds", p95_s=Qn.floor_at(0.95)).withColumn("p95_s", r6("p95_s")).orderBy(F.desc("max_s"), "component").limit(30)


@query("phase_overrun_stats", over("samples", "mode_signals", "console", sql="""
    SELECT d.log_id, d.phase, d.seconds, coalesce(o.n, 0) AS overruns, round(coalesce(o.n, 0) / d.seconds, 6) AS rate, coalesce(o.worst, 0) AS worst_s, t.top
    FROM (SELECT log_id, phase, sum(end_us - start_us) / 1e6 AS seconds FROM phases GROUP BY ALL) d
    LEFT JOIN (SELECT log_id, ph AS phase, count(*) AS n, max(total_s) AS worst FROM pe GROUP BY ALL) o USING (log_id, phase)
    LEFT JOIN (SELECT log_id, phase, array_to_string(list(component ORDER BY s DESC, component)[1:3], ',') AS top FROM (SELECT x.log_id, pe.ph AS phase, component, round(sum(x.seconds), 6) AS s FROM ex x JOIN pe ON pe.log_id = x.log_id AND pe.event = x.event GROUP BY ALL) GROUP BY ALL) t USING (log_id, phase)""",
    **PH, **_OV, pe="SELECT e.log_id, e.event, e.total_s, CASE WHEN e.event_us < p.end_us THEN p.phase ELSE 'disabled' END AS ph FROM ev e ASOF LEFT JOIN phases p ON e.log_id = p.log_id AND e.event_us >= p.start_us"))
def phase_overrun_stats(spark, sf):
    """Overruns of each phase: rate, worst, and the components that took most time in them."""
    console, found = A.console(spark, sf), phases(spark, sf)
    rows = R.phase_of(R.overrun_events(console).withColumns({"ts_us": F.col("event_us"), "seq": F.col("event")}), found)
    per = rows.groupBy("log_id", "phase").agg(F.count("*").alias("overruns"), F.max("total_s").alias("worst_s"))
    timings = R.epochs(R.overrun_messages(console)).join(rows.select("log_id", "event", "phase"), ["log_id", "event"]).groupBy("log_id", "phase", "component").agg(r6(F.sum("seconds")).alias("seconds"))
    spans = found.groupBy("log_id", "phase").agg((F.sum(F.col("end_us") - F.col("start_us")) / 1e6).alias("seconds"))
    out = spans.join(per, ["log_id", "phase"], "left").join(top_components(timings, ["log_id", "phase"]), ["log_id", "phase"], "left").withColumns({"overruns": F.coalesce("overruns", F.lit(0)), "worst_s": F.coalesce("worst_s", F.lit(0.0))})
    return out.withColumn("rate", r6(F.col("overruns") / F.col("seconds")))


# Signals

_SW = "PARTITION BY log_id ORDER BY ts_us RANGE BETWEEN 80000 PRECEDING AND 80000 FOLLOWING"


@query("smooth_time_window", over("odometry", sql=f"""
    SELECT seq, round(CASE WHEN count(*) OVER w < 3 THEN x ELSE avg(x) OVER w END, 6) AS x, round({mod(f"CASE WHEN count(*) OVER w < 3 THEN theta_deg ELSE degrees(atan2(avg(sin(radians(theta_deg))) OVER w, avg(cos(radians(theta_deg))) OVER w)) END + 180.00001")} - 180.00001, 7) AS theta_deg FROM odometry WINDOW w AS ({_SW})"""))
def smooth_time_window(spark, sf):
    """Means over 80 ms to either side, headings round the circle; rows with fewer than three in reach stay as they are."""
    w = Window.partitionBy("log_id").orderBy("ts_us").rangeBetween(-80_000, 80_000)
    few, th = F.count("*").over(w) < 3, F.radians("theta_deg")
    heading = F.degrees(F.atan2(F.avg(F.sin(th)).over(w), F.avg(F.cos(th)).over(w)))
    rows = A.odometry(spark, sf).select("seq", F.when(few, F.col("x")).otherwise(F.avg("x").over(w)).alias("x"), F.when(few, F.col("theta_deg")).otherwise(heading).alias("th"))
    return rows.select("seq", r6("x").alias("x"), F.round(F.pmod(F.col("th") + 180.00001, F.lit(360.0)) - 180.00001, 7).alias("theta_deg"))


@query("second_difference_accel", over("odometry", sql="""
    SELECT seq, round(least(30e0, greatest(-30e0, CASE WHEN t2 - t0 > 2000 AND t2 > ts_us AND ts_us > t0 THEN ((x2 - x) / ((t2 - ts_us) / 1e6) - (x - x0) / ((ts_us - t0) / 1e6)) / ((t2 - t0) / 2e6) ELSE 0 END)), 4) AS ax
    FROM (SELECT *, lag(ts_us, 5) OVER w AS t0, lead(ts_us, 5) OVER w AS t2, lag(x, 5) OVER w AS x0, lead(x, 5) OVER w AS x2 FROM odometry WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq)) WHERE t0 IS NOT NULL AND t2 IS NOT NULL"""))
def second_difference_accel(spark, sf):
    """Acceleration along x: the change of the slope from five rows back to five rows ahead over half their time, at most 30 either way."""
    w = by_time("log_id")
    rows = A.odometry(spark, sf).withColumns({"t0": F.lag("ts_us", 5).over(w), "t2": F.lead("ts_us", 5).over(w), "x0": F.lag("x", 5).over(w), "x2": F.lead("x", 5).over(w)}).where("t0 is not null and t2 is not null")
    t0, t, t2 = (F.col(c) for c in ("t0", "ts_us", "t2"))
    a = ((F.col("x2") - F.col("x")) / ((t2 - t) / 1e6) - (F.col("x") - F.col("x0")) / ((t - t0) / 1e6)) / ((t2 - t0) / 2e6)
    return rows.select("seq", r4(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.when((t2 - t0 > 2000) & (t2 > t) & (t > t0), a).otherwise(0.0)))).alias("ax"))


_SIX = ["round(x, 0)", "round(y, 0)", "tag_count % 2", "round(latency_ms / 20, 0)", "round(yaw_deg / 90, 0)", "tag_count // 3"]


@query("stale_repeats", over("vision", sql=f"""
    SELECT log_id, camera, count(*) AS frames, count(*) FILTER (v = was) AS repeats, round(count(*) FILTER (v = was) / count(*), 6) AS ratio FROM (SELECT *, lag(v) OVER (PARTITION BY log_id, camera ORDER BY ts_us, seq) AS was FROM (SELECT *, [{', '.join(f'CAST({c} AS DOUBLE)' for c in _SIX)}] AS v FROM vision)) GROUP BY ALL"""))
def stale_repeats(spark, sf):
    """Frames whose six values, rounded, are those of the frame before, and their share."""
    six = F.array(F.round("x", 0), F.round("y", 0), (F.col("tag_count") % 2).cast("double"), F.round(F.col("latency_ms") / 20, 0), F.round(F.col("yaw_deg") / 90, 0), F.floor(F.col("tag_count") / 3).cast("double"))
    rows = A.vision(spark, sf).withColumn("v", six).withColumn("same", F.coalesce(F.col("v") == F.lag("v").over(by_time("log_id", "camera")), F.lit(False)))
    return rows.groupBy("log_id", "camera").agg(F.count("*").alias("frames"), F.count_if("same").alias("repeats"), r6(F.count_if("same") / F.count("*")).alias("ratio"))


_MEMORY = "SELECT *, v_double - lag(v_double) OVER w AS d, row_number() OVER w AS i FROM samples WINDOW w AS (PARTITION BY log_id, signal ORDER BY ts_us, seq)"


@query("running_memory_events", over("samples", sql="""
    SELECT m.log_id, m.signal, count(*) FILTER (d >= 10) AS reclaims, round(sum(d) FILTER (d >= 10), 6) AS reclaimed, round((arg_max(v_double, i) FILTER (i < f) - arg_min(v_double, i)) / nullif((arg_max(ts_us, i) FILTER (i < f) - min(ts_us)) / 1e6, 0), 4) AS decline_per_s
    FROM m JOIN (SELECT log_id, signal, coalesce(min(i) FILTER (d >= 10), max(i) + 1) AS f FROM m GROUP BY ALL) USING (log_id, signal) GROUP BY ALL""", m=_MEMORY))
def running_memory_events(spark, sf):
    """Rises of ten or more, and how fast a signal falls before the first of them."""
    w = by_time(*SIGNAL)
    rows = A.samples(spark, sf).withColumns({"d": F.col("v_double") - F.lag("v_double").over(w), "i": F.row_number().over(w)})
    rise = F.col("d") >= 10
    rows = rows.withColumn("before", F.max(F.when(rise, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).isNull())
    last = F.max(F.when(F.col("before"), F.struct("i", "ts_us", "v_double")))
    found = rows.groupBy(*SIGNAL).agg(F.count_if(rise).alias("reclaims"), r6(F.sum(F.when(rise, F.col("d")))).alias("reclaimed"), F.min(F.struct("i", "ts_us", "v_double")).alias("a"), last.alias("z"))
    seconds = (F.col("z.ts_us") - F.col("a.ts_us")) / 1e6
    return found.select(*SIGNAL, "reclaims", "reclaimed", r4(F.when(seconds != 0, (F.col("z.v_double") - F.col("a.v_double")) / seconds)).alias("decline_per_s"))


@query("top_k_peaks", over("samples", sql="""
    SELECT log_id, signal, ts_us, seq, v_double, before_v, after_v FROM (SELECT *, lag(v_double) OVER w AS before_v, lead(v_double) OVER w AS after_v, max(v_double) OVER (PARTITION BY log_id, signal ORDER BY ts_us RANGE BETWEEN 200000 PRECEDING AND 200000 FOLLOWING) AS top FROM samples WINDOW w AS (PARTITION BY log_id, signal ORDER BY ts_us, seq))
    WHERE v_double = top ORDER BY v_double DESC, seq LIMIT 20"""))
def top_k_peaks(spark, sf):
    """The twenty highest values that none within 200 ms exceeds, with their neighbours."""
    w = by_time(*SIGNAL)
    about = Window.partitionBy(*SIGNAL).orderBy("ts_us").rangeBetween(-200_000, 200_000)
    rows = A.samples(spark, sf).withColumns({"before_v": F.lag("v_double").over(w), "after_v": F.lead("v_double").over(w), "top": F.max("v_double").over(about)})
    return rows.where("v_double = top").drop("top").orderBy(F.desc("v_double"), "seq").limit(20)


@query("current_spikes", over("samples", recursive=True, sql="SELECT log_id, signal, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM f WHERE kept GROUP BY ALL",
    h=f"SELECT *, row_number() OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS i FROM (SELECT s.*, v_double > 1.5 * m AS hi, lag(v_double > 1.5 * m) OVER (PARTITION BY s.log_id, s.signal ORDER BY ts_us, seq) AS was FROM samples s JOIN ({robots._SP}) m USING (log_id, signal)) WHERE hi AND was = false",
    f="""SELECT log_id, signal, i, ts_us, ts_us AS a, true AS kept FROM h WHERE i = 1
      UNION ALL SELECT h.log_id, h.signal, h.i, h.ts_us, CASE WHEN h.ts_us - f.a > 50000 THEN h.ts_us ELSE f.a END, h.ts_us - f.a > 50000 FROM f JOIN h ON h.log_id = f.log_id AND h.signal = f.signal AND h.i = f.i + 1"""))
def current_spikes(spark, sf):
    """Rises over one and a half times a signal's median, at most one in 50 ms."""
    s = A.samples(spark, sf)
    rows = s.join(s.groupBy(*SIGNAL).agg(F.median(F.abs("v_double")).alias("m")), SIGNAL).withColumn("hi", F.col("v_double") > 1.5 * F.col("m"))
    rows = rows.withColumn("was", F.lag("hi").over(by_time(*SIGNAL))).where("hi and not was")
    return K.anchored_dedup(rows, SIGNAL, 50_000).groupBy(*SIGNAL).agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query("feeder_health", over("samples", sql="SELECT s.log_id, s.signal, start_us, count(*) AS n, " + ", ".join(f"round(quantile_cont(v_double, {q}), 6) AS q{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", max(v_double) AS peak, round(avg(abs(v_double - 80)), 6) AS mean_error FROM samples s JOIN i ON s.log_id = i.log_id AND s.signal = i.signal AND s.ts_us >= start_us AND s.ts_us < end_us GROUP BY ALL",
                              h=robots_basics._HYST, e=robots_basics._EDGES, i=robots_basics._INTERVALS))
def feeder_health(spark, sf):
    """Values while a feeder is commanded: their quantiles, peak and mean distance from what is asked."""
    found = robots_basics.hysteresis_intervals(spark, sf).select(*SIGNAL, F.col("start_us").alias("ts_us"), F.col("start_us").alias("seq"), "start_us", "end_us")
    rows = K.asof_backward(A.samples(spark, sf), found, SIGNAL, ["start_us", "end_us"]).where("ts_us < end_us")
    keys, shares = [*SIGNAL, "start_us"], (0.05, 0.25, 0.5, 0.75, 0.95)
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("v_double").alias("peak"), r6(F.avg(F.abs(F.col("v_double") - 80))).alias("mean_error"))
    names = [f"q{int(q * 100):02d}" for q in shares]
    return Qn.with_quantiles(stats, rows, keys, "v_double", **dict(zip(names, map(Qn.at, shares)))).withColumns({c: r6(c) for c in names})


# Over logs


@query("group_delta", over("samples", sql="""
    SELECT signal, round(a, 6) AS even, round(b, 6) AS odd, round(b - a, 6) AS delta, CASE WHEN abs(b - a) <= .05 * abs(a) THEN 'same' WHEN b > a THEN 'higher' ELSE 'lower' END AS verdict
    FROM (SELECT signal, median(v_double) FILTER (log_id % 2 = 0) AS a, median(v_double) FILTER (log_id % 2 = 1) AS b FROM samples GROUP BY ALL)"""))
def group_delta(spark, sf):
    """Medians of two groups of logs, their difference, and whether it is one."""
    per = Qn.quantiles(A.samples(spark, sf).withColumn("grp", F.col("log_id") % 2), ["signal", "grp"], "v_double", m=Qn.MEDIAN)
    rows = per.groupBy("signal").pivot("grp", [0, 1]).agg(F.first("m")).toDF("signal", "a", "b")
    a, b = F.col("a"), F.col("b")
    verdict = F.when(F.abs(b - a) <= 0.05 * F.abs(a), "same").when(b > a, "higher").otherwise("lower")
    return rows.select("signal", r6(a).alias("even"), r6(b).alias("odd"), r6(b - a).alias("delta"), verdict.alias("verdict"))


@query("log_ranking", rs("""
    SELECT log_id, row_number() OVER (ORDER BY m, log_id) AS place, m AS median_r, mark, CASE WHEN row_number() OVER (ORDER BY m, log_id) = 1 THEN 'best' WHEN row_number() OVER (ORDER BY m DESC, log_id DESC) = 1 THEN 'worst' END AS extreme
    FROM (SELECT log_id, round(median(res), 4) AS m, CASE WHEN round(median(res), 4) < .15 THEN 'good' WHEN round(median(res), 4) < .3 THEN 'fair' ELSE 'poor' END AS mark FROM res GROUP BY ALL)"""))
def log_ranking(spark, sf):
    """Logs by their median residual, with a mark, the best and the worst told; one row per log goes through one task."""
    m = residuals(spark, sf).groupBy("log_id").agg(r4(F.median("res")).alias("median_r"))
    up, n = Window.orderBy("median_r", "log_id"), F.count("*").over(Window.partitionBy())
    rows = m.withColumns({"place": F.row_number().over(up), "n": n})
    mark = F.when(F.col("median_r") < 0.15, "good").when(F.col("median_r") < 0.3, "fair").otherwise("poor")
    return rows.select("log_id", "place", "median_r", mark.alias("mark"), F.when(F.col("place") == 1, "best").when(F.col("place") == F.col("n"), "worst").alias("extreme"))


def _rollup(name: str, key: str, column) -> None:
    def run(spark, sf):
        rows = A.tags(spark, sf).join(A.frames(spark, sf), "frame_id").withColumn("k", column())
        per = rows.groupBy("k", "log_id").agg(F.count("*").alias("n"), F.avg("ambiguity").alias("m")).where("m <> 0")
        return per.groupBy(F.col("k").alias(name.split("_")[0] if name == "band_rollup" else "tag_id")).agg(r6(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean_v"), F.sum("n").alias("n"), F.count("*").alias("logs"))

    out = "band" if name == "band_rollup" else "tag_id"
    Q[name] = (run, over("tags", "frames", sql=f"SELECT {out}, CAST(sum(n) AS BIGINT) AS n, round(sum(m * n) / sum(n), 6) AS mean_v, count(*) AS logs FROM (SELECT {key} AS {out}, log_id, count(*) AS n, avg(ambiguity) AS m FROM tags JOIN frames USING (frame_id) GROUP BY ALL) WHERE m <> 0 GROUP BY ALL"))


_rollup("tag_rollup", "tag_id", lambda: F.col("tag_id"))
_rollup("band_rollup", "CAST(floor(dist) AS BIGINT)", lambda: F.floor("dist"))


_WE = """SELECT log_id, camera, 'divergence' AS kind, min(ts_us) AS start_us, round(max(res), 5) AS size FROM (
      SELECT *, sum(c) OVER (PARTITION BY log_id, camera ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, lead(ts_us) OVER w AS nxt, CASE WHEN (res > .2) IS DISTINCT FROM lag(res > .2) OVER w THEN 1 ELSE 0 END AS c FROM res WINDOW w AS (PARTITION BY log_id, camera ORDER BY ts_us, seq)))
    WHERE res > .2 GROUP BY log_id, camera, run HAVING max(coalesce(nxt, ts_us)) - min(ts_us) >= 100000
    UNION ALL SELECT log_id, camera, 'gap', ts_us - gap, gap / 1e6 FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY log_id, camera ORDER BY ts_us, seq) AS gap FROM vision) WHERE gap > 500000"""


@query("worst_events_per_log", rs("SELECT log_id, camera, kind, start_us, size FROM (SELECT *, row_number() OVER (PARTITION BY log_id, kind ORDER BY size DESC, camera, start_us) AS i FROM we) WHERE i <= 5", we=_WE))
def worst_events_per_log(spark, sf):
    """Each log's five largest divergences from the path and its five longest gaps without a frame."""
    apart = K.threshold_runs(residuals(spark, sf), ["log_id", "camera"], F.col("res") > 0.2, "res", 100_000)
    rows = A.vision(spark, sf).withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(by_time("log_id", "camera"))).where("gap > 500000")
    events = apart.select("log_id", "camera", F.lit("divergence").alias("kind"), "start_us", F.round("peak", 5).alias("size")).unionByName(
        rows.select("log_id", "camera", F.lit("gap").alias("kind"), (F.col("ts_us") - F.col("gap")).alias("start_us"), (F.col("gap") / 1e6).alias("size"))
    )
    order = Window.partitionBy("log_id", "kind").orderBy(F.desc("size"), "camera", "start_us")
    return events.withColumn("i", F.row_number().over(order)).where("i <= 5").drop("i")


@query("frame_features", over("tags", "frames", "vision", "odometry", sql="""
    SELECT f.frame_id, f.camera, count(*) AS tags, round(avg(ambiguity), 6) AS mean_amb, round(max(ambiguity), 6) AS max_amb, round(min(dist), 6) AS nearest, round(avg(dist), 6) AS mean_dist, round(any_value(f.residual_raw) / 100000, 8) AS residual,
      CASE WHEN count(*) FILTER (tag_id > 16) = 0 THEN 'hub' WHEN count(*) FILTER (tag_id <= 16) = 0 THEN 'station' ELSE 'mixed' END AS target, round(sum(1 / (dist * dist)), 6) AS harmonic, round(coalesce(stddev_pop(dist), 0), 6) AS spread FROM frames f JOIN tags USING (frame_id) GROUP BY ALL"""))
def frame_features(spark, sf):
    """One row per frame with its tags' ambiguity, distance and geometry, its residual and what it looks at."""
    rows = A.frames(spark, sf).join(A.tags(spark, sf), "frame_id")
    target = F.when(F.count_if(F.col("tag_id") > 16) == 0, "hub").when(F.count_if(F.col("tag_id") <= 16) == 0, "station").otherwise("mixed")
    return rows.groupBy("frame_id", "camera").agg(
        F.count("*").alias("tags"), r6(F.avg("ambiguity")).alias("mean_amb"), r6(F.max("ambiguity")).alias("max_amb"), r6(F.min("dist")).alias("nearest"), r6(F.avg("dist")).alias("mean_dist"),
        F.round(F.first("residual_raw") / 100_000, 8).alias("residual"), target.alias("target"), r6(F.sum(1 / (F.col("dist") * F.col("dist")))).alias("harmonic"), r6(F.stddev_pop("dist")).alias("spread"),
    )
