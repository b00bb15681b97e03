"""Queries for filters, joins, statistics and windows (name: function, SQL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.operators import basic as B
from wayline.operators import kernel as K
from wayline.operators import quantiles as Qn
from wayline.operators.basic import SIGNAL, by_time, r6
from wayline.plans.views_sql import over
from wayline.sources import adapters as A

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# Filters and projections


@query("filter_by_type", over("samples", sql="SELECT log_id, ts_us, seq, v_double FROM samples WHERE signal = 'click'"))
def filter_by_type(spark, sf):
    return A.samples(spark, sf).where("signal = 'click'").select("log_id", "ts_us", "seq", "v_double")


@query("filter_by_prefix", over("samples", sql="SELECT log_id, signal, ts_us, seq, v_double FROM samples WHERE starts_with(signal, 'p')"))
def filter_by_prefix(spark, sf):
    return A.samples(spark, sf).where(F.col("signal").startswith("p"))


@query("slice_by_time", over("samples", sql="SELECT * FROM samples WHERE ts_us BETWEEN 2500000 AND 7250000"))
def slice_by_time(spark, sf):
    return B.slice_by_time(A.samples(spark, sf), 2.5, 7.25)


@query("signal_lookup", over("samples", sql="SELECT DISTINCT log_id, signal FROM samples WHERE signal = 'view'"))
def signal_lookup(spark, sf):
    return A.samples(spark, sf).where("signal = 'view'").select("log_id", "signal").distinct()


@query("signal_subset_scan", over("samples", sql="SELECT log_id, signal, count(*) AS n FROM samples WHERE signal IN ('click', 'error') GROUP BY ALL"))
def signal_subset_scan(spark, sf):
    return A.samples(spark, sf).where(F.col("signal").isin("click", "error")).groupBy(*SIGNAL).agg(F.count("*").alias("n"))


@query("project_seconds", over("samples", sql="SELECT seq, ts_us / 1e6 AS ts_s, v_double FROM samples"))
def project_seconds(spark, sf):
    return A.samples(spark, sf).select("seq", (F.col("ts_us") / 1e6).alias("ts_s"), "v_double")


@query("signal_discovery", over("samples", sql="""
    SELECT log_id, role, signal FROM (
      SELECT log_id, role, signal, row_number() OVER (PARTITION BY log_id, role ORDER BY priority, signal) AS i
      FROM (SELECT DISTINCT log_id, signal FROM samples) s
      JOIN (VALUES ('power', 1, '^zz'), ('power', 2, 'i'), ('mode', 1, 'up$'), ('mode', 2, '.')) p(role, priority, pattern) ON regexp_matches(signal, pattern)
    ) WHERE i = 1"""))
def signal_discovery(spark, sf):
    return B.discover(A.samples(spark, sf), [("power", 1, "^zz"), ("power", 2, "i"), ("mode", 1, "up$"), ("mode", 2, ".")])


@query("camera_discovery", over("vision", sql="SELECT log_id, camera, count(*) AS n FROM vision GROUP BY ALL HAVING count(*) >= 10"))
def camera_discovery(spark, sf):
    return A.vision(spark, sf).groupBy("log_id", "camera").agg(F.count("*").alias("n")).where("n >= 10")


@query("valid_frame_filter", over("vision", sql="SELECT seq, camera FROM vision WHERE tag_count >= 1 AND NOT (abs(x) < .001 AND abs(y) < .001)"))
def valid_frame_filter(spark, sf):
    return A.vision(spark, sf).where("tag_count >= 1 and not (abs(x) < .001 and abs(y) < .001)").select("seq", "camera")


@query("quality_frame_filter", over("tags", sql="""
    SELECT frame_id, count(*) AS n, round(max(ambiguity), 6) AS worst FROM tags GROUP BY frame_id HAVING count(*) >= 2 OR (min(dist) < 3.5 AND max(ambiguity) < .35)"""))
def quality_frame_filter(spark, sf):
    found = A.tags(spark, sf).groupBy("frame_id").agg(F.count("*").alias("n"), F.min("dist").alias("near"), r6(F.max("ambiguity")).alias("worst"))
    return found.where("n >= 2 or (near < 3.5 and worst < .35)").select("frame_id", "n", "worst")


@query("imu_validity_filter", over("samples", sql="SELECT seq, v_double FROM samples WHERE v_double > 1 AND v_double < 80"))
def imu_validity_filter(spark, sf):
    return A.samples(spark, sf).where("v_double > 1 and v_double < 80").select("seq", "v_double")


# Joins


def _pair(spark, sf, left="click", right="view"):
    s = A.samples(spark, sf)
    return s.where(F.col("signal") == left).drop("signal"), s.where(F.col("signal") == right).select("log_id", "ts_us", "seq", F.col("v_double").alias("r"))


def _lr(sql: str) -> str:
    return over("samples", sql=sql, l="SELECT * FROM samples WHERE signal = 'click'", r="SELECT log_id, ts_us, seq, v_double AS r FROM samples WHERE signal = 'view'",
                rl="SELECT log_id, ts_us, max_by(r, seq) AS r FROM r GROUP BY ALL", rf="SELECT log_id, ts_us, min_by(r, seq) AS r, min(seq) AS seq FROM r GROUP BY ALL")


@query("asof_backward", _lr("SELECT l.seq, rl.r FROM l ASOF LEFT JOIN rl ON l.log_id = rl.log_id AND l.ts_us >= rl.ts_us"))
def asof_backward(spark, sf):
    left, right = _pair(spark, sf)
    return K.asof_backward(left, right, ["log_id"], ["r"]).select("seq", "r")


@query("preceding_event_join", _lr("""
    SELECT l.seq, CASE WHEN l.ts_us - rl.ts_us <= 50000 THEN l.ts_us - rl.ts_us END AS transit_us FROM l ASOF LEFT JOIN rl ON l.log_id = rl.log_id AND l.ts_us > rl.ts_us"""))
def preceding_event_join(spark, sf):
    left, right = _pair(spark, sf)
    found = K.asof_backward(left, right, ["log_id"], ["r"], strict=True, time="r_us")
    gap = F.col("ts_us") - F.col("r_us")
    return found.select("seq", F.when(gap <= 50_000, gap).alias("transit_us"))


@query("asof_backward_clamped", _lr("""
    SELECT l.seq, coalesce(rl.r, f.r) AS r FROM l ASOF LEFT JOIN rl ON l.log_id = rl.log_id AND l.ts_us >= rl.ts_us
    LEFT JOIN (SELECT log_id, arg_min(r, (ts_us, seq)) AS r FROM r GROUP BY ALL) f ON f.log_id = l.log_id"""))
def asof_backward_clamped(spark, sf):
    left, right = _pair(spark, sf)
    return K.asof_backward(left, right, ["log_id"], ["r"], clamp=True).select("seq", "r")


_NEAREST = """
    SELECT l.seq, CASE WHEN b.ts_us IS NULL OR a.ts_us - l.ts_us <= l.ts_us - b.ts_us THEN CASE WHEN a.ts_us - l.ts_us <= {w} THEN a.r END
                       WHEN l.ts_us - b.ts_us <= {w} THEN b.r END AS r
    FROM l ASOF LEFT JOIN rl b ON l.log_id = b.log_id AND l.ts_us > b.ts_us ASOF LEFT JOIN rf a ON l.log_id = a.log_id AND l.ts_us <= a.ts_us"""


@query("asof_nearest", _lr(_NEAREST.format(w=20000)))
def asof_nearest(spark, sf):
    left, right = _pair(spark, sf)
    return K.asof_nearest(left, right, ["log_id"], ["r"], tolerance_us=20_000).select("seq", "r")


@query("asof_forward", _lr("""
    SELECT l.seq, coalesce(a.r, z.r) AS r FROM l ASOF LEFT JOIN rf a ON l.log_id = a.log_id AND l.ts_us <= a.ts_us
    LEFT JOIN (SELECT log_id, arg_max(r, (ts_us, seq)) AS r FROM r GROUP BY ALL) z ON z.log_id = l.log_id"""))
def asof_forward(spark, sf):
    left, right = _pair(spark, sf)
    return K.asof_forward(left, right, ["log_id"], ["r"]).select("seq", "r")


@query("equi_ts_join", over("samples", sql="""
    SELECT log_id, ts_us // 100000 AS t, max(v_double) FILTER (signal = 'click') AS ax, max(v_double) FILTER (signal = 'view') AS ay, max(v_double) FILTER (signal = 'error') AS az
    FROM samples GROUP BY ALL HAVING ax IS NOT NULL AND ay IS NOT NULL"""))
def equi_ts_join(spark, sf):
    rows = A.samples(spark, sf).withColumn("t", F.floor(F.col("ts_us") / 100_000))
    axes = rows.groupBy("log_id", "t").pivot("signal", ["click", "view", "error"]).agg(F.max("v_double"))
    return axes.toDF("log_id", "t", "ax", "ay", "az").where("ax is not null and ay is not null")


@query("interpolate_join", over("vision", "odometry", sql="""
    SELECT v.seq, round(CASE WHEN b.ts_us IS NULL THEN a.x WHEN a.ts_us IS NULL OR b.ts_us = v.ts_us THEN b.x
                             ELSE b.x + (a.x - b.x) * ((v.ts_us - b.ts_us) / (a.ts_us - b.ts_us)) END, 6) AS p_x
    FROM vision v ASOF LEFT JOIN odl b ON v.log_id = b.log_id AND v.ts_us >= b.ts_us ASOF LEFT JOIN odf a ON v.log_id = a.log_id AND v.ts_us <= a.ts_us""",
    odl="SELECT log_id, ts_us, max_by(x, seq) AS x FROM odometry GROUP BY ALL", odf="SELECT log_id, ts_us, min_by(x, seq) AS x FROM odometry GROUP BY ALL"))
def interpolate_join(spark, sf):
    found = K.interpolate_join(A.vision(spark, sf), A.odometry(spark, sf), ["log_id"], ["x"])
    return found.select("seq", r6("p_x").alias("p_x"))


@query("range_join_window", over("samples", sql="""
    SELECT a.seq, b.seq AS r_seq FROM samples a JOIN samples b ON a.log_id = b.log_id AND a.signal = 'error' AND b.signal = 'signup' AND b.ts_us BETWEEN a.ts_us - 20000 AND a.ts_us + 20000"""))
def range_join_window(spark, sf):
    s = A.samples(spark, sf)
    right = s.where("signal = 'signup'").select("log_id", F.col("ts_us").alias("r_ts_us"), F.col("seq").alias("r_seq"))
    return K.range_join(s.where("signal = 'error'"), right, ["log_id"], 20_000, 20_000).select("seq", "r_seq")


@query("not_near_event", over("samples", sql="""
    SELECT seq FROM samples a WHERE signal = 'click' AND NOT EXISTS (
      SELECT 1 FROM samples b WHERE a.log_id = b.log_id AND b.signal = 'signup' AND b.ts_us BETWEEN a.ts_us - 20000 AND a.ts_us + 20000)"""))
def not_near_event(spark, sf):
    s = A.samples(spark, sf)
    left = s.where("signal = 'click'")
    right = s.where("signal = 'signup'").select("log_id", F.col("ts_us").alias("r_ts_us"))
    return left.join(K.range_join(left, right, ["log_id"], 20_000, 20_000, how="left_semi").select("seq"), "seq", "left_anti").select("seq")


# Aggregations


@query("numeric_stats", over("samples", sql="""
    SELECT log_id, signal, min(v_double) AS min_v, max(v_double) AS max_v, round(avg(v_double), 6) AS mean_v, count(*) AS n, min(ts_us) / 1e6 AS first_s, max(ts_us) / 1e6 AS last_s
    FROM samples GROUP BY ALL"""))
def numeric_stats(spark, sf):
    return B.numeric_stats(A.samples(spark, sf))


@query("log_time_range", over("samples", sql="SELECT log_id, min(ts_us) AS first_us, max(ts_us) AS last_us FROM samples GROUP BY ALL"))
def log_time_range(spark, sf):
    return A.samples(spark, sf).groupBy("log_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query("log_summary", over("samples", sql="SELECT log_id, count(DISTINCT signal) AS signals, count(*) AS n, (max(ts_us) - min(ts_us)) / 1e6 AS duration_s FROM samples GROUP BY ALL"))
def log_summary(spark, sf):
    return A.samples(spark, sf).groupBy("log_id").agg(
        F.countDistinct("signal").alias("signals"), F.count("*").alias("n"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_s")
    )


@query("percentile_linear", over("samples", sql="SELECT log_id, signal, round(quantile_cont(v_double, .95), 6) AS p95 FROM samples GROUP BY ALL"))
def percentile_linear(spark, sf):
    return A.samples(spark, sf).groupBy(*SIGNAL).agg(r6(F.percentile("v_double", F.lit(0.95))).alias("p95"))


@query("percentile_floor", over("samples", sql="""
    SELECT log_id, signal, list_sort(list(v_double))[CAST(least(floor(count(*) * .95) + 1, count(*)) AS BIGINT)] AS p_floor FROM samples GROUP BY ALL"""))
def percentile_floor(spark, sf):
    return B.percentile_floor(A.samples(spark, sf), SIGNAL, 0.95)


_GAPS = "SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS gap FROM samples"


@query("median_rate_hz", over("samples", sql="SELECT log_id, signal, round(CASE WHEN median(gap) > 0 THEN 1e6 / median(gap) END, 6) AS rate_hz FROM g WHERE gap IS NOT NULL GROUP BY ALL", g=_GAPS))
def median_rate_hz(spark, sf):
    return B.median_rate(A.samples(spark, sf))


@query("mean_rate_hz", over("samples", sql="SELECT log_id, signal, round((count(*) - 1) * 1e6 / nullif(max(ts_us) - min(ts_us), 0), 6) AS rate_hz FROM samples GROUP BY ALL"))
def mean_rate_hz(spark, sf):
    return B.mean_rate(A.samples(spark, sf))


@query("active_rate_profile", over("samples", sql="""
    SELECT log_id, signal, round(median(gap), 6) AS median_us, list_sort(list(gap))[CAST(least(floor(count(*) * .1) + 1, count(*)) AS BIGINT)] AS p10_us, list_sort(list(gap))[CAST(least(floor(count(*) * .9) + 1, count(*)) AS BIGINT)] AS p90_us,
      round(median(gap) FILTER (gap < 100000), 6) AS active_us, count(*) FILTER (gap >= 100000) AS pauses FROM g WHERE gap IS NOT NULL GROUP BY ALL""", g=_GAPS))
def active_rate_profile(spark, sf):
    return B.active_rate(A.samples(spark, sf))


@query("circular_mean", over("odometry", sql="SELECT log_id, round(degrees(atan2(sum(sin(radians(theta_deg))), sum(cos(radians(theta_deg))))), 4) AS mean_deg FROM odometry GROUP BY ALL"))
def circular_mean(spark, sf):
    a = F.radians("theta_deg")
    return A.odometry(spark, sf).groupBy("log_id").agg(F.round(F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))), 4).alias("mean_deg"))


@query("weighted_mean_by_count", over("frames", sql="""
    SELECT camera, round(sum(m * n) / sum(n), 6) AS mean_v, round(median(m), 6) AS median_of_means, max(p) AS peak
    FROM (SELECT log_id, camera, avg(residual_raw) AS m, count(*) AS n, max(residual_raw) AS p FROM frames GROUP BY ALL) GROUP BY ALL"""))
def weighted_mean_by_count(spark, sf):
    per_log = A.frames(spark, sf).groupBy("log_id", "camera").agg(F.avg("residual_raw").alias("m"), F.count("*").alias("n"), F.max("residual_raw").alias("p"))
    found = per_log.groupBy("camera").agg(r6(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean_v"), F.max("p").alias("peak"))
    return Qn.with_quantiles(found, per_log, ["camera"], "m", median_of_means=Qn.MEDIAN).withColumn("median_of_means", r6("median_of_means"))


@query("pairwise_agreement_rollup", over("tags", sql="""
    SELECT least(a.tag_id, b.tag_id) AS t1, greatest(a.tag_id, b.tag_id) AS t2, count(*) AS n, round(avg(abs(a.dist - b.dist)), 6) AS mean_gap
    FROM tags a JOIN tags b ON a.frame_id = b.frame_id AND a.n < b.n GROUP BY ALL"""))
def pairwise_agreement_rollup(spark, sf):
    # Detections of one frame are at most seven here; pairs are made inside the gathered frame.
    per = A.tags(spark, sf).groupBy("frame_id").agg(F.collect_list(F.struct("n", "tag_id", "dist")).alias("d"))
    a = per.select("d", F.explode("d").alias("a"))
    pairs = a.select("a", F.explode("d").alias("b")).where("a.n < b.n")
    return pairs.groupBy(F.least("a.tag_id", "b.tag_id").alias("t1"), F.greatest("a.tag_id", "b.tag_id").alias("t2")).agg(
        F.count("*").alias("n"), r6(F.avg(F.abs(F.col("a.dist") - F.col("b.dist")))).alias("mean_gap")
    )


_BANDS = [0.0, 1.0, 2.0, 3.0, 4.0, 100.0]
_BAND_SQL = "CASE WHEN dist < 1 THEN 0 WHEN dist < 2 THEN 1 WHEN dist < 3 THEN 2 WHEN dist < 4 THEN 3 ELSE 4 END"
_BANDED = "count(*) AS n, round(avg(ambiguity * 4), 6) AS mean_v, round(median(ambiguity * 4), 6) AS median_v, round(list_sort(list(ambiguity * 4))[CAST(least(floor(count(*) * .95) + 1, count(*)) AS BIGINT)], 6) AS p95_floor, round(max(ambiguity * 4), 6) AS max_v, round(avg(CASE WHEN ambiguity * 4 > 1 THEN 100.0 ELSE 0.0 END), 6) AS outlier_pct"


@query("banded_stats", over("tags", sql=f"SELECT {_BAND_SQL} AS band, {_BANDED} FROM tags GROUP BY ALL"))
def banded_stats(spark, sf):
    return B.banded(A.tags(spark, sf).withColumn("v", F.col("ambiguity") * 4), F.col("dist"), _BANDS, "v")


@query("distance_band_table", over("tags", "frames", sql=f"SELECT camera, {_BAND_SQL} AS band, {_BANDED} FROM tags JOIN frames USING (frame_id) GROUP BY ALL"))
def distance_band_table(spark, sf):
    rows = A.tags(spark, sf).join(A.frames(spark, sf), "frame_id").withColumn("v", F.col("ambiguity") * 4)
    return B.banded(rows, F.col("dist"), _BANDS, "v", ["camera"])


@query("distinct_payloads", over("samples", sql="""
    SELECT log_id, signal, count(*) AS n, count(DISTINCT floor(v_double)) AS kinds, arg_min(v_double, (ts_us, seq)) AS first_v, arg_max(v_double, (ts_us, seq)) AS last_v, count(DISTINCT floor(v_double)) = 1 AS constant
    FROM samples GROUP BY ALL"""))
def distinct_payloads(spark, sf):
    at = F.struct("ts_us", "seq")
    found = A.samples(spark, sf).groupBy(*SIGNAL).agg(
        F.count("*").alias("n"), F.countDistinct(F.floor("v_double")).alias("kinds"), F.min_by("v_double", at).alias("first_v"), F.max_by("v_double", at).alias("last_v")
    )
    return found.withColumn("constant", F.col("kinds") == 1)


@query("descriptive_stats", over("samples", sql="""
    SELECT log_id, signal, count(*) AS n, min(v_double) AS min_v, max(v_double) AS max_v, round(avg(v_double), 6) AS mean_v, round(stddev_pop(v_double), 6) AS std_v, round(quantile_cont(v_double, .01), 6) AS p1, round(quantile_cont(v_double, .05), 6) AS p5,
      round(quantile_cont(v_double, .95), 6) AS p95, round(quantile_cont(v_double, .99), 6) AS p99 FROM samples GROUP BY ALL"""))
def descriptive_stats(spark, sf):
    s = A.samples(spark, sf)
    found = s.groupBy(*SIGNAL).agg(F.count("*").alias("n"), F.min("v_double").alias("min_v"), F.max("v_double").alias("max_v"), r6(F.avg("v_double")).alias("mean_v"), r6(F.stddev_pop("v_double")).alias("std_v"))
    out = Qn.with_quantiles(found, s, SIGNAL, "v_double", p1=Qn.at(0.01), p5=Qn.at(0.05), p95=Qn.at(0.95), p99=Qn.at(0.99))
    return out.withColumns({c: r6(c) for c in ("p1", "p5", "p95", "p99")})


@query("quantile_profile", over("samples", sql="""
    SELECT signal, round(quantile_cont(v_double, .05), 6) AS q05, round(quantile_cont(v_double, .25), 6) AS q25, round(quantile_cont(v_double, .5), 6) AS q50, round(quantile_cont(v_double, .75), 6) AS q75 FROM samples GROUP BY ALL"""))
def quantile_profile(spark, sf):
    found = Qn.quantiles(A.samples(spark, sf), ["signal"], "v_double", q05=Qn.at(0.05), q25=Qn.at(0.25), q50=Qn.at(0.5), q75=Qn.at(0.75))
    return found.select("signal", *[r6(n).alias(n) for n in ("q05", "q25", "q50", "q75")])


@query("per_offset_window_stats", over("samples", sql="""
    SELECT s.log_id, CAST(floor((ts_us - a) / 1e6) AS BIGINT) AS second, count(*) AS n, round(avg(v_double), 6) AS mean_v
    FROM samples s JOIN (SELECT log_id, min(ts_us) AS a FROM samples WHERE signal = 'error' GROUP BY ALL) z ON s.log_id = z.log_id
    WHERE signal = 'click' AND ts_us >= a AND ts_us < a + 5000000 GROUP BY ALL"""))
def per_offset_window_stats(spark, sf):
    s = A.samples(spark, sf)
    anchor = s.where("signal = 'error'").groupBy("log_id").agg(F.min("ts_us").alias("a"))
    rows = s.where("signal = 'click'").join(anchor, "log_id").where("ts_us >= a and ts_us < a + 5000000")
    return rows.groupBy("log_id", F.floor((F.col("ts_us") - F.col("a")) / 1e6).alias("second")).agg(F.count("*").alias("n"), r6(F.avg("v_double")).alias("mean_v"))


# Windows

_W = "OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq"


def _window(name: str, sql: str, column):
    """A query that returns one computed column for each sample."""
    Q[name] = (lambda spark, sf: A.samples(spark, sf).select("seq", column().alias("v")), over("samples", sql=f"SELECT seq, {sql} AS v FROM samples"))


_window("rolling_max_rows", f"max(v_double) {_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)", lambda: F.max("v_double").over(by_time(*SIGNAL).rowsBetween(-5, 0)))
_window("moving_average_rows", f"round(sum(abs(v_double)) {_W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9, 6)", lambda: r6(F.sum(F.abs("v_double")).over(by_time(*SIGNAL).rowsBetween(-4, 4)) / 9))
_window("lookback_min", "min(v_double) OVER (PARTITION BY log_id, signal ORDER BY ts_us RANGE BETWEEN 200000 PRECEDING AND 1 PRECEDING)",
        lambda: F.min("v_double").over(Window.partitionBy(*SIGNAL).orderBy("ts_us").rangeBetween(-200_000, -1)))
_window("lookback_max", "max(v_double) OVER (PARTITION BY log_id, signal ORDER BY ts_us RANGE BETWEEN 2000000 PRECEDING AND 1 PRECEDING)",
        lambda: F.max("v_double").over(Window.partitionBy(*SIGNAL).orderBy("ts_us").rangeBetween(-2_000_000, -1)))
_window("row_pair_jump", f"round(abs(v_double - lag(v_double) {_W})), 6)", lambda: r6(F.abs(F.col("v_double") - F.lag("v_double").over(by_time(*SIGNAL)))))
_window("finite_difference_velocity", f"""round(CASE WHEN coalesce(lead(ts_us) {_W}), ts_us) - coalesce(lag(ts_us) {_W}), ts_us) > 0 THEN
        (coalesce(lead(v_double) {_W}), v_double) - coalesce(lag(v_double) {_W}), v_double)) / ((coalesce(lead(ts_us) {_W}), ts_us) - coalesce(lag(ts_us) {_W}), ts_us)) / 1e6) ELSE 0 END, 4)""",
        lambda: F.round(_slope(1), 4))


def _slope(k: int):
    w = by_time(*SIGNAL)
    rise = F.coalesce(F.lead("v_double", k).over(w), F.col("v_double")) - F.coalesce(F.lag("v_double", k).over(w), F.col("v_double"))
    time = F.coalesce(F.lead("ts_us", k).over(w), F.col("ts_us")) - F.coalesce(F.lag("ts_us", k).over(w), F.col("ts_us"))
    return F.when(time > 0, rise / (time / 1e6)).otherwise(F.lit(0.0))


@query("edge_detect", over("modes", sql="""
    SELECT log_id, ts_us, seq, on_ FROM (SELECT *, v_long % 2 = 1 AS on_, lag(v_long % 2 = 1) OVER (PARTITION BY log_id ORDER BY ts_us, seq) AS was FROM modes) WHERE was IS NULL OR was <> on_"""))
def edge_detect(spark, sf):
    rows = A.modes(spark, sf).withColumn("on_", F.col("v_long") % 2 == 1)
    was = F.lag("on_").over(by_time("log_id"))
    return rows.withColumn("was", was).where("was is null or was <> on_").select("log_id", "ts_us", "seq", "on_")


@query("rising_edges", over("samples", sql=f"SELECT seq FROM (SELECT seq, v_double > 60 AS hi, lag(v_double > 60) {_W}) AS was FROM samples) WHERE hi AND was = false"))
def rising_edges(spark, sf):
    rows = A.samples(spark, sf).withColumn("hi", F.col("v_double") > 60).withColumn("was", F.lag(F.col("v_double") > 60).over(by_time(*SIGNAL)))
    return rows.where("hi and not was").select("seq")


_HYST = f"""SELECT *, coalesce(last_value(CASE WHEN v_double >= 80 THEN 1 WHEN v_double < 20 THEN 0 END IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS on_ FROM samples"""
_EDGES = f"SELECT * FROM (SELECT *, coalesce(lag(on_) {_W}), 0) AS was, max(ts_us) OVER (PARTITION BY log_id, signal) AS z FROM h) WHERE on_ <> was"
_INTERVALS = f"SELECT log_id, signal, ts_us AS start_us, coalesce(nxt, z) AS end_us FROM (SELECT *, lead(ts_us) {_W}) AS nxt FROM e) WHERE on_ = 1"


@query("hysteresis_intervals", over("samples", sql="SELECT * FROM i", h=_HYST, e=_EDGES, i=_INTERVALS))
def hysteresis_intervals(spark, sf):
    return K.hysteresis(A.samples(spark, sf), SIGNAL, F.col("v_double") >= 80, F.col("v_double") < 20)


@query("merge_close_intervals", over("samples", sql="""
    SELECT log_id, signal, min(start_us) AS start_us, max(end_us) AS end_us FROM (
      SELECT *, sum(nw) OVER (PARTITION BY log_id, signal ORDER BY start_us) AS g FROM (
        SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY log_id, signal ORDER BY start_us) < 100000 THEN 0 ELSE 1 END AS nw FROM i)) GROUP BY log_id, signal, g""", h=_HYST, e=_EDGES, i=_INTERVALS))
def merge_close_intervals(spark, sf):
    return K.merge_close(hysteresis_intervals(spark, sf), SIGNAL, 100_000)


@query("values_in_intervals", over("samples", sql="SELECT s.log_id, s.signal, s.seq FROM samples s WHERE EXISTS (SELECT 1 FROM i WHERE i.log_id = s.log_id AND i.signal = s.signal AND s.ts_us BETWEEN start_us AND end_us)", h=_HYST, e=_EDGES, i=_INTERVALS))
def values_in_intervals(spark, sf):
    # Intervals of one signal don't overlap: the last one begun is the only one that can hold a row, or the one that ended then.
    found = hysteresis_intervals(spark, sf).select(*SIGNAL, F.col("start_us").alias("ts_us"), F.col("start_us").alias("seq"), "end_us")
    return K.asof_backward(A.samples(spark, sf), found, SIGNAL, ["end_us"]).where("ts_us <= end_us").select(*SIGNAL, "seq")


_SESS = f"SELECT *, sum(nw) {_W} ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) {_W}) <= 100000 THEN 0 ELSE 1 END AS nw FROM samples)"


@query("gap_sessions", over("samples", sql="SELECT log_id, signal, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n FROM s GROUP BY log_id, signal, session HAVING count(*) >= 2", s=_SESS))
def gap_sessions(spark, sf):
    rows = K.gap_sessions(A.samples(spark, sf), SIGNAL, 100_000)
    return rows.groupBy(*SIGNAL, "session").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n")).where("n >= 2").drop("session")


@query("threshold_runs", over("samples", sql=f"""
    SELECT log_id, signal, min(ts_us) AS start_us, max(coalesce(nxt, ts_us)) AS end_us, count(*) AS n, max(v_double) AS peak FROM (
      SELECT *, sum(c) {_W} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lead(ts_us) {_W}) AS nxt, CASE WHEN (v_double > 60) IS DISTINCT FROM lag(v_double > 60) {_W}) THEN 1 ELSE 0 END AS c FROM samples))
    WHERE v_double > 60 GROUP BY log_id, signal, run HAVING max(coalesce(nxt, ts_us)) - min(ts_us) >= 50000"""))
def threshold_runs(spark, sf):
    return K.threshold_runs(A.samples(spark, sf), SIGNAL, F.col("v_double") > 60, "v_double", 50_000)


_HIGH = "SELECT log_id, ts_us, seq, v_double, row_number() OVER (PARTITION BY log_id ORDER BY ts_us, seq) AS i FROM samples WHERE signal = 'error' AND v_double > 100"


@query("anchored_dedup", over("samples", recursive=True, sql="SELECT log_id, ts_us, seq FROM f WHERE kept", h=_HIGH, f="""
    SELECT log_id, ts_us, seq, i, ts_us AS anchor, true AS kept FROM h WHERE i = 1
    UNION ALL SELECT h.log_id, h.ts_us, h.seq, h.i, CASE WHEN h.ts_us - f.anchor > 500000 THEN h.ts_us ELSE f.anchor END, h.ts_us - f.anchor > 500000 FROM f JOIN h ON h.log_id = f.log_id AND h.i = f.i + 1"""))
def anchored_dedup(spark, sf):
    return K.anchored_dedup(A.samples(spark, sf).where("signal = 'error' and v_double > 100"), ["log_id"], 500_000)


@query("anchored_groups", over("samples", recursive=True, sql="SELECT log_id, ts_us, seq, g AS grp FROM f", h=_HIGH, f="""
    SELECT log_id, ts_us, seq, i, ts_us AS anchor, 1 AS g FROM h WHERE i = 1
    UNION ALL SELECT h.log_id, h.ts_us, h.seq, h.i, CASE WHEN h.ts_us - f.anchor > 500000 THEN h.ts_us ELSE f.anchor END, CASE WHEN h.ts_us - f.anchor > 500000 THEN f.g + 1 ELSE f.g END
    FROM f JOIN h ON h.log_id = f.log_id AND h.i = f.i + 1"""))
def anchored_groups(spark, sf):
    return K.anchored_groups(A.samples(spark, sf).where("signal = 'error' and v_double > 100"), ["log_id"], 500_000)


@query("peak_group", over("samples", recursive=True, sql="""
    SELECT log_id, arg_max(rt, i) AS ts_us, arg_max(rs, i) AS seq, max(sc) AS score FROM f GROUP BY log_id, g""", h=_HIGH, f="""
    SELECT log_id, i, ts_us AS rt, seq AS rs, v_double AS sc, 1 AS g FROM h WHERE i = 1
    UNION ALL SELECT h.log_id, h.i, CASE WHEN h.ts_us - f.rt > 300000 OR h.v_double > f.sc THEN h.ts_us ELSE f.rt END, CASE WHEN h.ts_us - f.rt > 300000 OR h.v_double > f.sc THEN h.seq ELSE f.rs END,
      CASE WHEN h.ts_us - f.rt > 300000 OR h.v_double > f.sc THEN h.v_double ELSE f.sc END, CASE WHEN h.ts_us - f.rt > 300000 THEN f.g + 1 ELSE f.g END
    FROM f JOIN h ON h.log_id = f.log_id AND h.i = f.i + 1"""))
def peak_group(spark, sf):
    return K.peak_groups(A.samples(spark, sf).where("signal = 'error' and v_double > 100"), ["log_id"], 300_000, "v_double")


@query("sliding_window_stats", over("samples", sql="""
    SELECT log_id, signal, w AS start_us, count(*) AS n, round(avg(v_double), 6) AS mean_v, max(v_double) AS max_v FROM (
      SELECT s.*, o, z, unnest(range(greatest(0, CAST(floor((ts_us - o - 500000) / 250000.0) AS BIGINT) + 1), (ts_us - o) // 250000 + 1)) * 250000 + o AS w
      FROM samples s JOIN (SELECT log_id, signal, min(ts_us) AS o, max(ts_us) AS z FROM samples GROUP BY ALL) USING (log_id, signal))
    WHERE ts_us >= w AND ts_us < w + 500000 AND w + 500000 <= z GROUP BY ALL HAVING count(*) >= 3"""))
def sliding_window_stats(spark, sf):
    s = A.samples(spark, sf)
    ends = s.groupBy(*SIGNAL).agg(F.min("ts_us").alias("o"), F.max("ts_us").alias("z"))
    rows = s.join(ends, SIGNAL).withColumn("t", F.col("ts_us") - F.col("o"))
    last = F.floor(F.col("t") / 250_000)
    rows = rows.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), last - 1), last))).withColumn("start_us", F.col("k") * 250_000 + F.col("o"))
    rows = rows.where("ts_us >= start_us and ts_us < start_us + 500000 and start_us + 500000 <= z")
    return rows.groupBy(*SIGNAL, "start_us").agg(F.count("*").alias("n"), r6(F.avg("v_double")).alias("mean_v"), F.max("v_double").alias("max_v")).where("n >= 3")


# Sort and limit, sets


@query("sort_rows_desc", over("samples", sql="SELECT signal, row_number() OVER (ORDER BY m DESC, signal) AS place FROM (SELECT signal, round(avg(v_double), 6) AS m FROM samples GROUP BY ALL)"))
def sort_rows_desc(spark, sf):
    means = A.samples(spark, sf).groupBy("signal").agg(r6(F.avg("v_double")).alias("m"))  # one row per signal name
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("m"), "signal"))).select("signal", "place")


@query("subsample_every_k", over("samples", sql=f"SELECT seq FROM (SELECT seq, row_number() {_W}) AS i FROM samples) WHERE i % 5 = 1"))
def subsample_every_k(spark, sf):
    return A.samples(spark, sf).withColumn("i", F.row_number().over(by_time(*SIGNAL))).where("i % 5 = 1").select("seq")


@query("union_signals", over("samples", sql="""
    SELECT log_id, signal, source, n FROM (SELECT *, row_number() OVER (PARTITION BY log_id, signal ORDER BY source DESC) AS i FROM (
      SELECT log_id, signal, 1 AS source, count(*) AS n FROM samples WHERE signal <> 'view' GROUP BY ALL
      UNION ALL SELECT log_id, signal, 2, count(*) FROM samples WHERE v_double > 50 AND signal <> 'click' GROUP BY ALL)) WHERE i = 1"""))
def union_signals(spark, sf):
    s = A.samples(spark, sf)
    one = s.where("signal <> 'view'").groupBy(*SIGNAL).agg(F.count("*").alias("n")).withColumn("source", F.lit(1))
    two = s.where("v_double > 50 and signal <> 'click'").groupBy(*SIGNAL).agg(F.count("*").alias("n")).withColumn("source", F.lit(2))
    return one.unionByName(two).groupBy(*SIGNAL).agg(F.max("source").alias("source"), F.max_by("n", "source").alias("n"))


@query("tag_set_intersect", over("tags", sql="""
    SELECT frame_id, CASE WHEN hub = n THEN 'hub' WHEN hub = 0 THEN 'other' ELSE 'mixed' END AS kind FROM (SELECT frame_id, count(DISTINCT tag_id) AS n, count(DISTINCT tag_id) FILTER (tag_id <= 8) AS hub FROM tags GROUP BY ALL)"""))
def tag_set_intersect(spark, sf):
    found = A.tags(spark, sf).groupBy("frame_id").agg(F.collect_set("tag_id").alias("ids"))
    hub = F.size(F.array_intersect("ids", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: x.cast("bigint"))))
    return found.select("frame_id", F.when(hub == F.size("ids"), "hub").when(hub == 0, "other").otherwise("mixed").alias("kind"))
