"""Queries for files, alignments, recoveries and the remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F


from wayline.operators import folds
from wayline.operators import kernel as K
from wayline.operators.basic import SIGNAL, by_time, percentile_cont, r6
from wayline.plans import basics, robots
from wayline.plans.launch_sql import DIPS, THROUGHPUT
from wayline.plans.views_sql import over
from wayline.sources import adapters as A
from wayline.sources import ds_logs as D

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# Files


@query("decode_pd_currents", over("samples", sql="""
    SELECT log_id || '_' || (ts_us // 2000000) || '.dslog' AS path, row_number() OVER (PARTITION BY log_id, ts_us // 2000000 ORDER BY ts_us, seq) - 1 AS seq, (id % 256) / 8 AS ch0, ((((id + 1) % 256) >> 2) + (((id + 2) % 256) & 3) * 64) / 8 AS ch1, ((id + 8) % 256) / 8 AS ch6
    FROM (SELECT *, seq AS id FROM samples WHERE signal = 'error')"""))
def decode_pd_currents(spark, sf):
    """Records with a block of 16 channels, made from the samples and decoded again."""
    byte = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    block = F.concat(F.lit("00"), *[byte((F.col("seq") + k) % 256) for k in range(21)], F.lit("000000"))
    rows = A.samples(spark, sf).where("signal = 'error'").withColumn("record", F.concat(F.lit("00" * 13 + "19"), block))
    listed = rows.groupBy(D.stem()).agg(F.array_sort(F.collect_list(F.struct("ts_us", "seq", "record"))).alias("r"))
    header = F.lit(f"00000004{D.EPOCH_SHIFT_S:016X}{'0' * 16}")
    files = listed.select(F.concat("stem", F.lit(".dslog")).alias("path"), F.unhex(F.concat(header, F.array_join("r.record", ""))).alias("content"))
    return D.telemetry(files).select("path", "seq", F.col("currents")[0].alias("ch0"), F.col("currents")[1].alias("ch1"), F.col("currents")[6].alias("ch6"))


@query("ingest_dsevents", over("console", sql="SELECT log_id || '_' || (ts_us // 2000000) || '.dsevents' AS path, row_number() OVER (PARTITION BY log_id, ts_us // 2000000 ORDER BY ts_us, seq) - 1 AS seq, ts_us // 1000000 * 1000000 AS relative_us, text FROM console"))
def ingest_dsevents(spark, sf):
    """Event files made from the console lines, at whole seconds, and read again."""
    return D.events(D.event_files(A.console(spark, sf))).select("path", "seq", "relative_us", "text")


# Sessions and clocks

@query("logging_pause_sessions", over("console", sql="""
    SELECT log_id, session, count(*) AS n, count(*) FILTER (text LIKE '%overrun%') AS overruns, min(ts_us) AS start_us FROM (
      SELECT *, CAST(sum(nw) OVER (PARTITION BY log_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY log_id ORDER BY ts_us, seq) <= 50000 THEN 0 ELSE 1 END AS nw FROM console))
    GROUP BY ALL HAVING count(*) FILTER (text LIKE '%overrun%') > 0"""))
def logging_pause_sessions(spark, sf):
    rows = K.gap_sessions(A.console(spark, sf), ["log_id"], 50_000)
    found = rows.groupBy("log_id", "session").agg(F.count("*").alias("n"), F.count_if(F.col("text").like("%overrun%")).alias("overruns"), F.min("ts_us").alias("start_us"))
    return found.where("overruns > 0")


# Windows and events


@query("anchored_sliding_windows", over("samples", recursive=True, sql="""
    SELECT f.log_id, f.t AS start_us, count(*) AS n, round(median(v_double), 6) AS median_v FROM f JOIN h ON h.log_id = f.log_id AND h.ts_us >= f.t AND h.ts_us < f.t + 500000 WHERE f.kept GROUP BY ALL HAVING count(*) >= 3""",
    h="SELECT log_id, ts_us, seq, v_double, row_number() OVER (PARTITION BY log_id ORDER BY ts_us, seq) AS i FROM samples WHERE signal = 'error'",
    f="SELECT log_id, i, ts_us AS t, true AS kept, ts_us AS a FROM h WHERE i = 1 UNION ALL SELECT h.log_id, h.i, h.ts_us, h.ts_us - f.a >= 250000, CASE WHEN h.ts_us - f.a >= 250000 THEN h.ts_us ELSE f.a END FROM f JOIN h ON h.log_id = f.log_id AND h.i = f.i + 1"))
def anchored_sliding_windows(spark, sf):
    rows = A.samples(spark, sf).where("signal = 'error'")
    starts = K.anchored_dedup(rows, ["log_id"], 249_999).select("log_id", "ts_us")
    found = K.range_join(starts, rows.select("log_id", F.col("ts_us").alias("r_ts_us"), "v_double"), ["log_id"], 0, 499_999)
    return found.groupBy("log_id", F.col("ts_us").alias("start_us")).agg(F.count("*").alias("n"), r6(F.median("v_double")).alias("median_v")).where("n >= 3")


_RE = {
    "r": "SELECT *, v_double - avg(v_double) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS err FROM samples",
    "h": "SELECT *, coalesce(last_value(CASE WHEN err < -30 THEN 1 WHEN err > -10 THEN 0 END IGNORE NULLS) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM r",
    "e": basics._EDGES, "i": basics._INTERVALS,
}


@query("recovery_events", over("samples", sql="SELECT log_id, signal, start_us, end_us, (end_us - start_us) / 1000 AS ms FROM i", **_RE))
def recovery_events(spark, sf):
    rows = A.samples(spark, sf).withColumn("err", F.col("v_double") - F.avg("v_double").over(by_time(*SIGNAL).rowsBetween(-9, 0)))
    found = K.hysteresis(rows, SIGNAL, F.col("err") < -30, F.col("err") > -10)
    return found.withColumn("ms", (F.col("end_us") - F.col("start_us")) / 1000)


def responses(spark, sf):
    """Rows up to 300 ms before and 1.5 s after each launch."""
    right = A.samples(spark, sf).select(*SIGNAL, F.col("ts_us").alias("r_ts_us"), "v_double")
    return K.range_join(robots.launch_events(spark, sf), right, SIGNAL, 300_000, 1_500_000)


def recoveries(spark, sf):
    """Time from each launch to the first row back at 95 % of its baseline, in whole microseconds."""
    back = (F.col("r_ts_us") > F.col("ts_us")) & (F.col("v_double") >= 0.95 * F.col("baseline"))
    return responses(spark, sf).groupBy(*SIGNAL, "ts_us", "dip", "baseline").agg((F.min(F.when(back, F.col("r_ts_us"))) - F.col("ts_us")).alias("recovery_us"))


@query("launch_response", robots.la("""
    SELECT log_id, signal, ts_us, dip, baseline, (min(r_ts_us) FILTER (r_ts_us > ts_us AND v_double >= .95e0 * baseline) - ts_us) / 1000 AS recovery_ms FROM near GROUP BY log_id, signal, ts_us, dip, baseline"""))
def launch_response(spark, sf):
    return recoveries(spark, sf).withColumn("recovery_ms", F.col("recovery_us") / 1000).drop("recovery_us")


@query("shot_windows", robots.la("""
    SELECT log_id, signal, ts_us, dip, round(pre - dip, 6) AS drop FROM (SELECT log_id, signal, ts_us, dip, median(v_double) FILTER (r_ts_us < ts_us) AS pre FROM near GROUP BY log_id, signal, ts_us, dip) WHERE pre - dip >= 8"""))
def shot_windows(spark, sf):
    before = F.when(F.col("r_ts_us") < F.col("ts_us"), F.col("v_double"))
    found = responses(spark, sf).groupBy(*SIGNAL, "ts_us", "dip").agg(F.median(before).alias("pre"))
    return found.where(F.col("pre") - F.col("dip") >= 8).withColumn("drop", r6(F.col("pre") - F.col("dip"))).drop("pre")


@query("throughput_launches", over("samples", recursive=True, sql="SELECT log_id, signal, ts_us, seq FROM ft WHERE kept", **THROUGHPUT))
def throughput_launches(spark, sf):
    s = A.samples(spark, sf)
    fast = s.join(s.groupBy(*SIGNAL).agg(percentile_cont("v_double", 0.95).alias("p95")), SIGNAL)
    mean = F.avg(F.abs("v_double")).over(by_time(*SIGNAL).rowsBetween(-4, 4))
    rows = fast.withColumn("low", (F.col("v_double") < 0.8 * mean) & (F.col("v_double") > 0.2 * F.col("p95")))
    rows = rows.withColumn("was", F.lag("low").over(by_time(*SIGNAL))).where("low and not was")
    return K.anchored_dedup(rows, SIGNAL, 150_000)


@query("dip_recover_events", over("samples", recursive=True, sql="SELECT log_id, signal, e_start AS start_us, e_end AS end_us, e_low AS low, round(e_top - e_low, 6) AS depth FROM fe WHERE e_start IS NOT NULL AND e_top - e_low > 30", **DIPS))
def dip_recover_events(spark, sf):
    """Within stretches without pauses: a fall of over 20 from one row to the next opens an event, a rise of over 20 from its lowest closes it; kept if over 30 deep."""
    rows = K.gap_sessions(A.samples(spark, sf), SIGNAL, 100_000).withColumn("was_v", F.lag("v_double").over(by_time(*SIGNAL)))
    found = folds.dips(rows, SIGNAL, 20.0)
    return found.where("top - low > 30").select(*SIGNAL, "start_us", "end_us", "low", r6(F.col("top") - F.col("low")).alias("depth"))


# Reports


_SPEED = """SELECT log_id, ts_us, seq, CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / (dt / 1e6) ELSE 0 END AS speed FROM (
    SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, coalesce(lead(ts_us) OVER w, ts_us) - coalesce(lag(ts_us) OVER w, ts_us) AS dt
    FROM odometry WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq))"""


@query("residual_vs_speed", over("vision", "odometry", sql="""
    SELECT v.seq, round(coalesce(a.speed, z.speed), 3) AS speed FROM vision v ASOF LEFT JOIN sa a ON v.log_id = a.log_id AND v.ts_us <= a.ts_us
    LEFT JOIN (SELECT log_id, arg_max(speed, (ts_us, seq)) AS speed FROM sp GROUP BY ALL) z ON z.log_id = v.log_id WHERE coalesce(a.speed, z.speed) <= 8""",
    sp=_SPEED, sa="SELECT log_id, ts_us, min_by(speed, seq) AS speed FROM sp GROUP BY ALL"))
def residual_vs_speed(spark, sf):
    w = by_time("log_id")
    change = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    path = A.odometry(spark, sf).withColumns({"dx": change("x"), "dy": change("y"), "dt": change("ts_us")})
    path = path.withColumn("speed", F.when(F.col("dt") > 0, F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) / (F.col("dt") / 1e6)).otherwise(0.0))
    return K.asof_forward(A.vision(spark, sf), path, ["log_id"], ["speed"]).where("speed <= 8").select("seq", F.round("speed", 3).alias("speed"))
