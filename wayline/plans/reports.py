"""Queries for reports over many sources: consistency of accelerations, sticking wheels, jitter, uncertainty models, sessions and bottlenecks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import basic as B
from wayline.operators import kernel as K
from wayline.operators import quantiles as Qn
from wayline.operators import robot as R
from wayline.operators.basic import SIGNAL, by_time, r6
from wayline.plans import robots, studies, vision
from wayline.plans.launch_sql import SLIP
from wayline.plans.views_sql import over
from wayline.plans.vision import r4
from wayline.sources import adapters as A

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def _runs(table: str, flag: str, peak: str, least_us: int, kind: str) -> str:
    """Runs of rows of a table with a flag: kind, start, end, n, peak."""
    return f"""SELECT log_id, '{kind}' AS kind, min(ts_us) AS start_us, max(coalesce(nxt, ts_us)) AS end_us, count(*) AS n, round(max({peak}), 4) AS peak FROM (
      SELECT *, sum(c) OVER (PARTITION BY log_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, lead(ts_us) OVER w AS nxt, CASE WHEN ({flag}) IS DISTINCT FROM lag({flag}) OVER w THEN 1 ELSE 0 END AS c FROM {table} WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq)))
    WHERE {flag} GROUP BY log_id, run HAVING max(coalesce(nxt, ts_us)) - min(ts_us) >= {least_us}"""


# Accelerations

_NAMES = {"click": "NT:/limelight-a/imu", "view": "Phoenix6/Pigeon2-10/AccelerationX", "error": "Phoenix6/Pigeon2-10/AccelerationY", "purchase": "Phoenix6/Pigeon2-10/AccelerationZ", "signup": "NT:/Drive/mode"}


@query("accel_sources", over("samples", sql="""
    SELECT log_id, CASE signal WHEN 'click' THEN 'limelight-a' ELSE 'Pigeon2-10' END AS source, CASE signal WHEN 'click' THEN 'camera' ELSE 'device' END AS kind, count(*) AS n, round(1e6 / median(gap), 4) AS rate_hz
    FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS gap FROM samples) WHERE signal IN ('click', 'view') GROUP BY log_id, signal HAVING count(*) >= 10"""))
def accel_sources(spark, sf):
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    return R.accel_sources(A.samples(spark, sf).withColumn("signal", names[F.col("signal")])).withColumn("rate_hz", r4("rate_hz"))


_AC = {
    "im": "SELECT log_id, ts_us, seq, v_double / 20 AS accel, (seq % 97) / 50e0 AS gravity FROM samples WHERE signal = 'error'",
    "p0": """SELECT log_id, ts_us, seq, CASE WHEN t2 - t0 > 2000 AND t2 > ts_us AND ts_us > t0 THEN ((x2 - x) / ((t2 - ts_us) / 1e6) - (x - x0) / ((ts_us - t0) / 1e6)) / ((t2 - t0) / 2e6) ELSE 0 END AS ax,
        CASE WHEN t2 - t0 > 2000 AND t2 > ts_us AND ts_us > t0 THEN ((y2 - y) / ((t2 - ts_us) / 1e6) - (y - y0) / ((ts_us - t0) / 1e6)) / ((t2 - t0) / 2e6) ELSE 0 END AS ay
        FROM (SELECT *, lag(ts_us, 5) OVER w AS t0, lead(ts_us, 5) OVER w AS t2, lag(x, 5) OVER w AS x0, lead(x, 5) OVER w AS x2, lag(y, 5) OVER w AS y0, lead(y, 5) OVER w AS y2 FROM odometry WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq)) WHERE t0 IS NOT NULL AND t2 IS NOT NULL""",
    "p1": "SELECT log_id, ts_us, max_by(sqrt(power(greatest(-30, least(30, ax)), 2) + power(greatest(-30, least(30, ay)), 2)), seq) AS path FROM p0 GROUP BY ALL",
    "ra": "SELECT i.*, CASE WHEN i.ts_us - p.ts_us <= 50000 THEN abs(i.accel - p.path) END AS residual FROM im i ASOF LEFT JOIN p1 p ON i.log_id = p.log_id AND i.ts_us >= p.ts_us",
}


@query("accel_consistency", over("samples", "odometry", sql=f"""
    {_runs('ra', 'gravity < .3', '-gravity', 20000, 'airborne')} UNION ALL {_runs('(SELECT * FROM ra WHERE residual IS NOT NULL) rr', 'residual > 4', 'residual', 100000, 'skid')}
    UNION ALL SELECT log_id, 'impact', ts_us, ts_us, 1, round(residual, 4) FROM ra WHERE residual > 15""", **_AC))
def accel_consistency(spark, sf):
    imu = A.samples(spark, sf).where("signal = 'error'").select("log_id", "ts_us", "seq", (F.col("v_double") / 20).alias("accel"), (F.col("seq") % 97 / 50).alias("gravity"))
    return R.accel_events(imu, R.path_accel(A.odometry(spark, sf))).withColumn("peak", r4("peak"))


# Wheels and targets

_STUCK = {**{k: v for k, v in SLIP.items() if k in ("wc", "wv", "po")}, "sp": "SELECT *, sqrt(wx * wx + wy * wy) AS wheel, sqrt(dx * dx + dy * dy) / dt AS pose FROM po WHERE dt > .001e0"}


@query("stuck_events", over("samples", "odometry", sql="""
    SELECT log_id, kind, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY log_id, kind ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY log_id, kind ORDER BY ts_us, seq) <= 200000 THEN 0 ELSE 1 END AS nw FROM (
        SELECT log_id, ts_us, seq, 'stuck' AS kind FROM sp WHERE wheel > .3e0 AND pose < .1e0 UNION ALL SELECT log_id, ts_us, seq, 'mismatch' FROM sp WHERE wheel > .3e0 AND pose < .3e0 * wheel))) GROUP BY log_id, kind, g""", **_STUCK))
def stuck_events(spark, sf):
    """Turning wheels while the pose stands still, or moves at under a third of their speed, in groups without gaps of 200 ms."""
    rows = studies.wheels(spark, sf)
    w = by_time("log_id")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    rows = rows.withColumns({"dt": step("ts_us") / 1e6, "dx": step("x"), "dy": step("y")}).where("dt > .001D")
    rows = rows.withColumns({"wheel": F.sqrt(F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy")), "pose": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.col("dt")}).where("wheel > .3D")
    kinds = F.array(F.when(F.col("pose") < 0.1, "stuck"), F.when(F.col("pose") < 0.3 * F.col("wheel"), "mismatch"))
    each = rows.select("log_id", "ts_us", "seq", F.explode(F.array_compact(kinds)).alias("kind"))
    found = K.gap_sessions(each, ["log_id", "kind"], 200_000).groupBy("log_id", "kind", "session")
    return found.agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n")).drop("session")


_JIT = {
    "ta": "SELECT log_id, ts_us, max_by(v_double, seq) AS target FROM samples WHERE signal = 'purchase' GROUP BY ALL", "cu": "SELECT log_id, ts_us, max_by(v_double, seq) AS current FROM samples WHERE signal = 'error' GROUP BY ALL",
    "jj": """SELECT o.log_id, CAST(round(sqrt(power(o.x - 4.6e0, 2) + power(o.y - 4e0, 2))) AS BIGINT) AS bin, c.current, t.target, abs(t.target - o.theta_deg) AS tracking, sqrt(power(o.x - lag(o.x) OVER w, 2) + power(o.y - lag(o.y) OVER w, 2)) AS jump,
        CASE WHEN (o.ts_us - lag(o.ts_us) OVER w) / 1e6 > .001e0 AND (o.ts_us - lag(o.ts_us) OVER w) / 1e6 < .1e0 THEN abs(t.target - lag(t.target) OVER w) END AS jitter
        FROM odometry o ASOF LEFT JOIN ta t ON o.log_id = t.log_id AND o.ts_us >= t.ts_us ASOF LEFT JOIN cu c ON o.log_id = c.log_id AND o.ts_us >= c.ts_us WINDOW w AS (PARTITION BY o.log_id ORDER BY o.ts_us, o.seq)""",
}


@query("jitter_by_distance", over("samples", "odometry", sql="""
    SELECT bin, count(*) AS n, round(avg(current), 4) AS current, round(max(current), 4) AS peak, round(avg(jitter), 4) AS jitter, round(stddev_samp(jitter), 4) AS jitter_std, round(avg(tracking), 4) AS tracking, round(avg(jump), 6) AS jump, round(max(jump), 6) AS max_jump FROM jj GROUP BY ALL""", **_JIT))
def jitter_by_distance(spark, sf):
    """By whole metres from the target: current, jitter and tracking error of the aim, jumps of the pose."""
    s = A.samples(spark, sf)
    of = lambda signal, name: s.where(F.col("signal") == signal).select("log_id", "ts_us", "seq", F.col("v_double").alias(name))
    rows = K.asof_backward(K.asof_backward(A.odometry(spark, sf), of("purchase", "target"), ["log_id"], ["target"]), of("error", "current"), ["log_id"], ["current"])
    w = by_time("log_id")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    dt = step("ts_us") / 1e6
    rows = rows.withColumns(
        {
            "bin": F.round(F.sqrt(F.pow(F.col("x") - 4.6, F.lit(2.0)) + F.pow(F.col("y") - 4.0, F.lit(2.0)))).cast("bigint"), "tracking": F.abs(F.col("target") - F.col("theta_deg")),
            "jump": F.sqrt(F.pow(step("x"), F.lit(2.0)) + F.pow(step("y"), F.lit(2.0))), "jitter": F.when((dt > 0.001) & (dt < 0.1), F.abs(step("target"))),
        }
    )
    return rows.groupBy("bin").agg(
        F.count("*").alias("n"), r4(F.avg("current")).alias("current"), r4(F.max("current")).alias("peak"), r4(F.avg("jitter")).alias("jitter"), r4(F.stddev_samp("jitter")).alias("jitter_std"),
        r4(F.avg("tracking")).alias("tracking"), r6(F.avg("jump")).alias("jump"), r6(F.max("jump")).alias("max_jump"),
    )


_SIG = {
    "s": "SELECT f.camera, f.frame_id, f.ts_us, f.residual_raw, count(*) AS tags, max(ambiguity) AS worst, min(dist) * min(dist) / count(*) AS old_s, 1 / sqrt(sum(1 / (dist * dist))) AS new_s FROM frames f JOIN tags t ON f.frame_id = t.frame_id GROUP BY ALL",
    "rc": "SELECT *, row_number() OVER (PARTITION BY camera ORDER BY ts_us) AS i FROM (SELECT DISTINCT camera, ts_us FROM s WHERE tags >= 2 AND worst < .35e0)",
    "rf": "SELECT camera, i, ts_us AS last, TRUE AS kept FROM rc WHERE i = 1 UNION ALL SELECT c.camera, c.i, CASE WHEN c.ts_us - f.last > 86400000000 THEN c.ts_us ELSE f.last END, c.ts_us - f.last > 86400000000 FROM rf f JOIN rc c ON c.camera = f.camera AND c.i = f.i + 1",
}


@query("sigma_model_compare", over("tags", "frames", recursive=True, sql="""
    SELECT camera, any_value(resets) AS resets, count(*) AS n, round(median(new_s / old_s), 4) AS median_ratio, round(quantile_cont(new_s / old_s, .95), 4) AS p95_ratio, round(avg(new_s * new_s / (new_s * new_s + .25e0)), 6) AS mean_gain,
      round(sum(residual_raw / 1e6 * new_s * new_s / (new_s * new_s + .25e0)), 3) AS new_correction, round(sum(residual_raw / 1e6 * old_s * old_s / (old_s * old_s + .25e0)), 3) AS old_correction FROM s LEFT JOIN (SELECT camera, count(*) AS resets FROM rf WHERE kept GROUP BY ALL) USING (camera) GROUP BY camera""", **_SIG))
def sigma_model_compare(spark, sf):
    """Two uncertainty models side by side: ratios of their sigmas, and the corrections they would let through (gain s2 / (s2 + .25)).

    resets counts sure frames (two tags or more, little ambiguity) that come more than a cooldown after the last reset.
    """
    near = F.min("dist")
    rows = A.frames(spark, sf).join(A.tags(spark, sf), "frame_id").groupBy("camera", "frame_id", "ts_us", "residual_raw").agg(
        F.count("*").alias("tags"), F.max("ambiguity").alias("worst"), (near * near / F.count("*")).alias("old_s"), (1 / F.sqrt(F.sum(1 / (F.col("dist") * F.col("dist"))))).alias("new_s"))
    gain = lambda s: F.col(s) * F.col(s) / (F.col(s) * F.col(s) + 0.25)
    ratio = F.col("new_s") / F.col("old_s")
    moved = lambda s: F.round(F.sum(F.col("residual_raw") / 1e6 * gain(s)), 3)
    sure = rows.where("tags >= 2 and worst < .35D").select("camera", "ts_us", F.col("ts_us").alias("seq")).distinct()
    resets = K.anchored_dedup(sure, ["camera"], 86_400_000_000).groupBy("camera").agg(F.count("*").alias("resets"))
    found = rows.groupBy("camera").agg(F.count("*").alias("n"), r6(F.avg(gain("new_s"))).alias("mean_gain"), moved("new_s").alias("new_correction"), moved("old_s").alias("old_correction"))
    found = Qn.with_quantiles(found, rows, ["camera"], ratio, median_ratio=Qn.MEDIAN, p95_ratio=Qn.at(0.95)).withColumns({c: r4(c) for c in ("median_ratio", "p95_ratio")})
    return found.join(resets, "camera", "left")


# Sessions

_MEM = {
    "me": "SELECT log_id, ts_us, max_by(v_double, seq) AS memory FROM samples WHERE signal = 'view' GROUP BY ALL",
    "mm": """SELECT s.log_id, s.seq, s.ts_us, m.memory, s.v_double > 60 AS overrun FROM (SELECT * FROM samples WHERE signal = 'error') s ASOF JOIN me m ON s.log_id = m.log_id AND s.ts_us + 50000 >= m.ts_us""",
}


@query("memory_overrun_rates", over("samples", sql="""
    SELECT log_id, n, low_n, round(low_pct, 4) AS low_pct, round(high_pct, 4) AS high_pct, coalesce(abs(pct - lag(pct) OVER (ORDER BY log_id)) > 5, FALSE) AS changed
    FROM (SELECT log_id, count(*) AS n, count(*) FILTER (memory < 50) AS low_n, 100e0 * count(*) FILTER (overrun AND memory < 50) / nullif(count(*) FILTER (memory < 50), 0) AS low_pct, 100e0 * count(*) FILTER (overrun AND memory >= 50) / nullif(count(*) FILTER (memory >= 50), 0) AS high_pct,
      100e0 * count(*) FILTER (overrun) / count(*) AS pct FROM mm GROUP BY ALL)""", **_MEM))
def memory_overrun_rates(spark, sf):
    """Overruns with little and with much memory free, as of 50 ms later, per log, and whether the rate differs from the log before."""
    s = A.samples(spark, sf)
    memory = s.where("signal = 'view'").select("log_id", "ts_us", "seq", F.col("v_double").alias("memory"))
    rows = K.asof_backward(s.where("signal = 'error'").withColumn("ts_us", F.col("ts_us") + 50_000), memory, ["log_id"], ["memory"]).where("memory is not null").withColumn("overrun", F.col("v_double") > 60)
    low, hit = F.col("memory") < 50, F.col("overrun")
    pct = lambda a, b: 100.0 * F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    per = rows.groupBy("log_id").agg(F.count("*").alias("n"), F.count_if(low).alias("low_n"), r4(pct(hit & low, low)).alias("low_pct"), r4(pct(hit & ~low, ~low)).alias("high_pct"), (100.0 * F.count_if(hit) / F.count("*")).alias("pct"))
    return B.previous(per, "log_id", {"was": "pct"}).withColumn("changed", F.coalesce(F.abs(F.col("pct") - F.col("was")) > 5, F.lit(False))).drop("pct", "was")


@query("session_health", over("samples", "modes", "console", sql="""
    SELECT log_id, round(avg(v_double) FILTER (signal = 'click'), 4) AS cpu_mean, max(v_double) FILTER (signal = 'click') AS cpu_max, count(*) FILTER (signal = 'click' AND v_double > 90) AS cpu_high, round(avg(v_double) FILTER (signal = 'view'), 4) AS can_mean,
      round(min(v_double) FILTER (signal = 'purchase'), 4) AS volts_min, count(*) FILTER (signal = 'purchase' AND v_double < 7) AS brownouts, max(peak) AS transition_peak, any_value(o.overruns) AS overruns, any_value(m.phases) AS phases
    FROM (SELECT *, CASE WHEN edge THEN max(v_double) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq ROWS BETWEEN 25 PRECEDING AND 49 FOLLOWING) END AS peak FROM (SELECT *, signal = 'click' AND (v_double > 50) IS DISTINCT FROM lag(v_double > 50) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS edge FROM samples)) s
    LEFT JOIN (SELECT log_id, count(*) AS overruns FROM console WHERE text LIKE '%overrun%' GROUP BY ALL) o USING (log_id) LEFT JOIN (SELECT log_id, count(DISTINCT v_long) AS phases FROM modes GROUP BY ALL) m USING (log_id) GROUP BY log_id"""))
def session_health(spark, sf):
    """Load, bus, battery, overruns and modes of a log, with the highest load from 25 rows before to 49 after each of its transitions."""
    w = by_time(*SIGNAL)
    s = A.samples(spark, sf)
    busy = F.col("v_double") > 50
    edge = (F.col("signal") == "click") & ~busy.eqNullSafe(F.lag(busy).over(w))
    rows = s.withColumn("edge", edge).withColumn("peak", F.when(F.col("edge"), F.max("v_double").over(w.rowsBetween(-25, 49))))
    of = lambda name: F.when(F.col("signal") == name, F.col("v_double"))
    found = rows.groupBy("log_id").agg(
        r4(F.avg(of("click"))).alias("cpu_mean"), F.max(of("click")).alias("cpu_max"), F.count_if(of("click") > 90).alias("cpu_high"), r4(F.avg(of("view"))).alias("can_mean"), r4(F.min(of("purchase"))).alias("volts_min"),
        F.count_if(of("purchase") < 7).alias("brownouts"), F.max("peak").alias("transition_peak"),
    )
    overruns = A.console(spark, sf).where("text like '%overrun%'").groupBy("log_id").agg(F.count("*").alias("overruns"))
    return found.join(overruns, "log_id", "left").join(A.modes(spark, sf).groupBy("log_id").agg(F.countDistinct("v_long").alias("phases")), "log_id", "left")


@query("throughput_bottleneck", over("samples", recursive=True, sql="""
    SELECT signal, n, round(recovery_ms, 4) AS recovery_ms, round(interval_ms, 4) AS interval_ms, CASE WHEN recovery_ms > 150 THEN 'slow' WHEN recovery_ms > 80 THEN 'moderate' ELSE 'quick' END AS recovery,
      CASE WHEN interval_ms > 2 * recovery_ms THEN 'feeder' WHEN interval_ms < 1.2e0 * recovery_ms THEN 'flywheel' ELSE 'undecided' END AS bottleneck, dip_pct > 20 AS deep_dips
    FROM (SELECT r.signal, count(*) AS n, avg(recovery_ms) AS recovery_ms, any_value(g.m) AS interval_ms, avg(100 * (baseline - dip) / baseline) AS dip_pct
      FROM (SELECT log_id, signal, ts_us, dip, baseline, (min(r_ts_us) FILTER (r_ts_us > ts_us AND v_double >= .95e0 * baseline) - ts_us) / 1000 AS recovery_ms FROM near GROUP BY log_id, signal, ts_us, dip, baseline) r
      JOIN (SELECT signal, median(gap) / 1000 AS m FROM (SELECT signal, ts_us - lag(ts_us) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS gap FROM le) GROUP BY ALL) g USING (signal) GROUP BY r.signal)""", **robots.LAUNCHES))
def throughput_bottleneck(spark, sf):
    """What limits the rate of launches, pooled over logs: recovery against the time between launches, and deep dips."""
    from wayline.plans.more import recoveries

    launches = robots.launch_events(spark, sf)
    # Whole microseconds add up exactly in any order; a mean of milliseconds may fall to either side of a rounding limit.
    mean_ms = F.sum("recovery_us") / (1000 * F.count("recovery_us"))
    per = recoveries(spark, sf).groupBy("signal").agg(F.count("*").alias("n"), mean_ms.alias("r"), F.avg(100 * (F.col("baseline") - F.col("dip")) / F.col("baseline")).alias("d"))
    gaps = launches.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(by_time(*SIGNAL)))
    gaps = Qn.quantiles(gaps, ["signal"], "gap", m=Qn.MEDIAN).withColumn("m", F.col("m") / 1000)
    r, m = F.col("r"), F.col("m")
    return per.join(gaps, "signal").select(
        "signal", "n", r4("r").alias("recovery_ms"), r4("m").alias("interval_ms"), F.when(r > 150, "slow").when(r > 80, "moderate").otherwise("quick").alias("recovery"),
        F.when(m > 2 * r, "feeder").when(m < 1.2 * r, "flywheel").otherwise("undecided").alias("bottleneck"), (F.col("d") > 20).alias("deep_dips"),
    )


@query("pose_report", over("vision", "odometry", sql="""
    SELECT p.log_id, p.sources, p.kinds, CASE WHEN kinds >= 3 THEN 'high' WHEN kinds = 2 THEN 'medium' ELSE 'low' END AS confidence, round(r.rms, 4) AS rms, round(r.worst, 4) AS worst, r.n AS frames, round(100e0 * r.n / nullif(o.n, 0), 4) AS coverage_pct
    FROM (SELECT log_id, count(DISTINCT source) AS sources, count(DISTINCT kind) AS kinds FROM (SELECT log_id, 'odometry' AS source, 'odometry' AS kind FROM odometry UNION ALL SELECT log_id, camera, 'vision' FROM vision UNION ALL SELECT log_id, 'companion', 'accel' FROM vision WHERE log_id % 2 = 1) GROUP BY ALL) p
    LEFT JOIN (SELECT log_id, count(*) AS n, sqrt(avg(res * res)) AS rms, max(res) AS worst FROM res GROUP BY ALL) r USING (log_id) LEFT JOIN (SELECT log_id, count(*) AS n FROM odometry GROUP BY ALL) o USING (log_id)""", **vision._RS))
def pose_report(spark, sf):
    """Sources of pose per log with their kinds, a companion's acceleration in every second log among them, and how far the cameras are from the path."""
    v, o = A.vision(spark, sf), A.odometry(spark, sf)
    named = [(o, F.lit("odometry"), "odometry"), (v, F.col("camera"), "vision"), (v.where("log_id % 2 = 1"), F.lit("companion"), "accel")]
    rows = None
    for frame, source, kind in named:
        part = frame.select("log_id", source.alias("source"), F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    found = rows.groupBy("log_id").agg(F.countDistinct("source").alias("sources"), F.countDistinct("kind").alias("kinds"))
    apart = vision.residuals(spark, sf).groupBy("log_id").agg(F.count("*").alias("frames"), r4(F.sqrt(F.avg(F.col("res") * F.col("res")))).alias("rms"), r4(F.max("res")).alias("worst"))
    out = found.join(apart, "log_id", "left").join(o.groupBy("log_id").agg(F.count("*").alias("path")), "log_id", "left")
    confidence = F.when(F.col("kinds") >= 3, "high").when(F.col("kinds") == 2, "medium").otherwise("low")
    return out.withColumns({"confidence": confidence, "coverage_pct": r4(100.0 * F.col("frames") / F.col("path"))}).drop("path")
