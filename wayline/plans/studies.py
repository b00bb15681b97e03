"""Queries for sources, clock alignment and studies over many logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import kernel as K
from wayline.operators import quantiles as Qn
from wayline.operators.basic import SIGNAL, by_time, r6
from wayline.operators import robot as R
from wayline.plans.launch_sql import SLIP
from wayline.plans.views_sql import over
from wayline.sources import adapters as A
from wayline.sources import ds_logs as D

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# Sources


def ds_files(spark, sf):
    """Driver-station files made from the samples of one signal, one per log and two seconds: a record of 14 bytes each, without a power block."""
    byte = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    v = F.col("v_double")
    record = F.concat(byte(F.floor(v) % 200), byte(F.col("seq") % 20), byte(F.lit(12)), byte(F.floor(v) % 256), byte(F.floor(v) % 200), byte(F.col("seq") % 256), byte(F.lit(80)), byte(F.lit(60)), byte(F.lit(3)), byte(F.lit(128)), F.lit("00000000"))
    header = F.concat(F.lit("00000004"), F.lpad(F.hex(F.lit(1_704_067_200 + D.EPOCH_SHIFT_S)), 16, "0"), F.lit("0" * 16))
    rows = A.samples(spark, sf).where("signal = 'error'").withColumn("record", record)
    listed = rows.groupBy(D.stem()).agg(F.array_sort(F.collect_list(F.struct("ts_us", "seq", "record"))).alias("r"))
    return listed.select(F.concat("stem", F.lit(".dslog")).alias("path"), F.unhex(F.concat(header, F.array_join("r.record", ""))).alias("content"))


_DS = "SELECT log_id || '_' || (ts_us // 2000000) AS stem, row_number() OVER (PARTITION BY log_id, ts_us // 2000000 ORDER BY ts_us, seq) - 1 AS i, seq AS id, CAST(floor(v_double) AS BIGINT) AS f FROM samples WHERE signal = 'error'"


@query("ingest_dslog", over("samples", sql="""
    SELECT stem || '.dslog' AS path, 1704067200000000 + 20000 * i AS ts_us, i AS seq, (f % 200) * .5e0 AS trip_ms, round(least(1e0, (id % 20) * .04e0), 6) AS loss, 12 + (f % 256) / 256 AS volts, round((f % 200) * .005e0, 6) AS cpu, id % 2 = 0 AS robot_disabled FROM d""", d=_DS))
def ingest_dslog(spark, sf):
    found = D.telemetry(ds_files(spark, sf))
    return found.select("path", "ts_us", "seq", "trip_ms", r6("loss").alias("loss"), "volts", r6("cpu").alias("cpu"), "robot_disabled")


@query("dslog_header_time", over("samples", sql="SELECT DISTINCT stem || '.dslog' AS path, 1704067200 AS start_s FROM d", d=_DS))
def dslog_header_time(spark, sf):
    head = F.hex(F.substring("content", 1, 20))
    seconds = F.conv(F.substring(head, 9, 16), 16, 10).cast("bigint") - D.EPOCH_SHIFT_S
    return ds_files(spark, sf).where(F.substring(head, 1, 8) == "00000004").select("path", seconds.alias("start_s"))


@query("clean_event_text", over("console", sql="SELECT seq, trim(text) AS text FROM console"))
def clean_event_text(spark, sf):
    marked = F.concat(F.lit("<TagVersion>1 <time>3 <message> "), F.col("text"))
    return A.console(spark, sf).select("seq", D.clean_text(marked).alias("text"))


# Clocks


@query("battery_agreement", over("samples", sql="""
    SELECT s.log_id, count(*) AS n, round(avg(abs(s.v_double - coalesce(v.v, f.v))), 6) AS mean_v, round(max(abs(s.v_double - coalesce(v.v, f.v))), 6) AS max_v FROM (SELECT * FROM samples WHERE signal = 'error') s
    ASOF LEFT JOIN (SELECT log_id, ts_us, max_by(v_double, seq) AS v FROM samples WHERE signal = 'view' GROUP BY ALL) v ON s.log_id = v.log_id AND s.ts_us >= v.ts_us
    LEFT JOIN (SELECT log_id, arg_min(v_double, (ts_us, seq)) AS v FROM samples WHERE signal = 'view' GROUP BY ALL) f ON f.log_id = s.log_id GROUP BY ALL"""))
def battery_agreement(spark, sf):
    s = A.samples(spark, sf)
    right = s.where("signal = 'view'").select("log_id", "ts_us", "seq", F.col("v_double").alias("v"))
    rows = K.asof_backward(s.where("signal = 'error'"), right, ["log_id"], ["v"], clamp=True).withColumn("d", F.abs(F.col("v_double") - F.col("v")))
    return rows.groupBy("log_id").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_v"), r6(F.max("d")).alias("max_v"))


@query("signal_offset_by_first_move", over("samples", sql="""
    SELECT log_id, min(ts_us) FILTER (signal = 'click') - min(ts_us) FILTER (signal = 'view') AS offset_us FROM (SELECT *, abs(v_double - lag(v_double) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq)) AS d FROM samples) WHERE d > .001 GROUP BY ALL"""))
def signal_offset_by_first_move(spark, sf):
    rows = A.samples(spark, sf).withColumn("d", F.abs(F.col("v_double") - F.lag("v_double").over(by_time(*SIGNAL)))).where("d > .001")
    first = lambda s: F.min(F.when(F.col("signal") == s, F.col("ts_us")))
    return rows.groupBy("log_id").agg((first("click") - first("view")).alias("offset_us"))


# Studies


@query("session_overrun_summary", over("samples", sql="""
    SELECT log_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n, round(max(p95), 6) AS worst_p95 FROM (SELECT log_id, signal, session, count(*) AS n, quantile_cont(v_double, .95) AS p95 FROM s GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL""",
    s="SELECT *, sum(nw) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) <= 100000 THEN 0 ELSE 1 END AS nw FROM samples)"))
def session_overrun_summary(spark, sf):
    per = K.gap_sessions(A.samples(spark, sf), SIGNAL, 100_000).groupBy(*SIGNAL, "session").agg(F.count("*").alias("c"), F.percentile("v_double", F.lit(0.95)).alias("p95")).where("c >= 5")
    return per.groupBy("log_id").agg(F.count("*").alias("sessions"), F.sum("c").alias("n"), r6(F.max("p95")).alias("worst_p95"))


_SEG = "SELECT *, CAST(sum(nw) OVER (PARTITION BY log_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY log_id ORDER BY ts_us, seq) <= 50000 THEN 0 ELSE 1 END AS nw FROM samples)"
_ACT = "SELECT log_id, session, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n FROM s GROUP BY log_id, session HAVING max(ts_us) - min(ts_us) >= 100000"


@query("active_segments", over("samples", sql=_ACT, s=_SEG))
def active_segments(spark, sf):
    rows = K.gap_sessions(A.samples(spark, sf), ["log_id"], 50_000)
    found = rows.groupBy("log_id", "session").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n"))
    return found.where("end_us - start_us >= 100000")


@query("rate_by_group", over("samples", sql="SELECT log_id % 2 AS grp, round(avg(n * 1e6 / (end_us - start_us)), 4) AS rate FROM a GROUP BY ALL", s=_SEG, a=_ACT))
def rate_by_group(spark, sf):
    return active_segments(spark, sf).groupBy((F.col("log_id") % 2).alias("grp")).agg(F.round(F.avg(F.col("n") * 1e6 / (F.col("end_us") - F.col("start_us"))), 4).alias("rate"))


@query("hour_bucket_rollup", "SELECT hour(ts) AS hour, count(*) AS n, round(avg(value), 6) AS mean_v FROM events GROUP BY ALL")
def hour_bucket_rollup(spark, sf):
    return A.table(spark, sf, "events").groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_v"))


@query("early_late_compare", over("samples", sql="SELECT signal, round(median(m) FILTER (2 * log_id <= z), 6) AS early, round(median(m) FILTER (2 * log_id > z), 6) AS late FROM (SELECT log_id, signal, median(v_double) AS m FROM samples GROUP BY ALL), (SELECT max(log_id) AS z FROM samples) GROUP BY ALL"))
def early_late_compare(spark, sf):
    """The first half of the logs against the second, by the medians of their signals."""
    m = A.samples(spark, sf).groupBy(*SIGNAL).agg(F.median("v_double").alias("m"))
    last = A.samples(spark, sf).agg(F.max("log_id")).first()[0] or 0
    halves = m.withColumn("half", F.when(2 * F.col("log_id") <= last, "early").otherwise("late"))
    per = Qn.quantiles(halves, ["signal", "half"], "m", m=Qn.MEDIAN)
    return per.groupBy("signal").pivot("half", ["early", "late"]).agg(r6(F.first("m")))


@query("event_window_extract", over("samples", sql="SELECT s.seq, s.ts_us - a AS rel_us FROM samples s JOIN (SELECT log_id, min(ts_us) AS a FROM samples WHERE signal = 'error' GROUP BY ALL) z ON s.log_id = z.log_id AND s.ts_us BETWEEN a - 100000 AND a + 500000"))
def event_window_extract(spark, sf):
    s = A.samples(spark, sf)
    anchors = s.where("signal = 'error'").groupBy("log_id").agg(F.min("ts_us").alias("a"))
    return s.join(anchors, "log_id").where("ts_us between a - 100000 and a + 500000").select("seq", (F.col("ts_us") - F.col("a")).alias("rel_us"))


_DW = """SELECT l.*, abs(l.v_double - v.r) AS d FROM (SELECT * FROM samples WHERE signal = 'click') l
    ASOF JOIN (SELECT log_id, ts_us, max_by(v_double, seq) AS r FROM samples WHERE signal = 'view' GROUP BY ALL) v ON l.log_id = v.log_id AND l.ts_us >= v.ts_us"""


@query("discrepancy_windows", over("samples", sql="""
    SELECT log_id, min(ts_us) AS start_us, max(coalesce(nxt, ts_us)) AS end_us, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY log_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, lead(ts_us) OVER w AS nxt, CASE WHEN (d > 30) IS DISTINCT FROM lag(d > 30) OVER w THEN 1 ELSE 0 END AS c FROM dw WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq))) WHERE d > 30 GROUP BY log_id, run HAVING max(coalesce(nxt, ts_us)) - min(ts_us) >= 50000""", dw=_DW))
def discrepancy_windows(spark, sf):
    s = A.samples(spark, sf)
    right = s.where("signal = 'view'").select("log_id", "ts_us", "seq", F.col("v_double").alias("r"))
    rows = K.asof_backward(s.where("signal = 'click'"), right, ["log_id"], ["r"]).where("r is not null").withColumn("d", F.abs(F.col("v_double") - F.col("r")))
    return K.threshold_runs(rows, ["log_id"], F.col("d") > 30, "d", 50_000).drop("peak")


def wheels(spark, sf):
    """The odometry with two signals as the wheels' velocity as of then."""
    s = A.samples(spark, sf)
    wheel = lambda name, out: s.where(F.col("signal") == name).select("log_id", "ts_us", "seq", (F.col("v_double") / 100).alias(out))
    rows = K.asof_backward(K.asof_backward(A.odometry(spark, sf), wheel("purchase", "wx"), ["log_id"], ["wx"]), wheel("error", "wy"), ["log_id"], ["wy"])
    return rows.na.fill(0.0, ["wx", "wy"])


def slips(spark, sf):
    """Both slip filters over the odometry."""
    return R.slip_filters(wheels(spark, sf), enter=1.0, leave=0.5, fast_enter=2.0, fast_leave=1.0, fixed=0.8, slow=0.9, fast=0.4, cap=5.0, least_s=0.002, most_s=0.1)


def sf_sql(sql: str) -> str:
    return over("samples", "odometry", recursive=True, sql=sql, **SLIP)


@query("gated_ema", sf_sql("SELECT log_id, seq, round(slip_fixed, 4) AS slip_fixed, round(slip, 4) AS slip, fast FROM ef"))
def gated_ema(spark, sf):
    return slips(spark, sf).select("log_id", "seq", F.round("slip_fixed", 4).alias("slip_fixed"), F.round("slip", 4).alias("slip"), "fast")


@query("filter_comparison", sf_sql("""
    SELECT log_id, count(*) AS n, count(*) FILTER (NOT valid) AS resets, round(avg(abs(slip_fixed - pf)), 4) AS jitter_fixed, round(avg(abs(slip - pv)), 4) AS jitter,
      count(*) FILTER (abs(slip_fixed - pf) > 1) AS spikes_fixed, count(*) FILTER (abs(slip - pv) > 1) AS spikes, count(*) FILTER (fast) AS fast_rows, count(*) FILTER (fast AND was = FALSE) AS fast_episodes,
      round(avg(slip_fixed) FILTER (wheel < 1), 4) AS stale_fixed, round(avg(slip) FILTER (wheel < 1), 4) AS stale
    FROM (SELECT *, lag(slip_fixed) OVER w AS pf, lag(slip) OVER w AS pv, lag(fast) OVER w AS was FROM ef WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq)) GROUP BY ALL"""))
def filter_comparison(spark, sf):
    """Per log, of the filter with one weight and of that with two: row-to-row jitter, spikes, slip left at low wheel speed, and how often the quick weight is taken."""
    w = by_time("log_id")
    rows = slips(spark, sf).withColumns({"df": F.abs(F.col("slip_fixed") - F.lag("slip_fixed").over(w)), "dv": F.abs(F.col("slip") - F.lag("slip").over(w)), "was": F.lag("fast").over(w)})
    r4 = lambda c: F.round(c, 4)
    still = lambda c: r4(F.avg(F.when(F.col("wheel") < 1, F.col(c))))
    return rows.groupBy("log_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("resets"), r4(F.avg("df")).alias("jitter_fixed"), r4(F.avg("dv")).alias("jitter"),
        F.count_if(F.col("df") > 1).alias("spikes_fixed"), F.count_if(F.col("dv") > 1).alias("spikes"), F.count_if("fast").alias("fast_rows"), F.count_if(F.col("fast") & ~F.col("was")).alias("fast_episodes"),
        still("slip_fixed").alias("stale_fixed"), still("slip").alias("stale"),
    )
