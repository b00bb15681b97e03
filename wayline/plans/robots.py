"""Queries for phases, power, overruns, commands, hits and launches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.operators import kernel as K
from wayline.operators import quantiles as Qn
from wayline.operators import robot as R
from wayline.operators.basic import SIGNAL, by_time, percentile_floor, r6
from wayline.plans.launch_sql import LAUNCHES, ROTATIONAL
from wayline.plans.views_sql import over
from wayline.sources import adapters as A

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def ranges(spark, sf):
    return A.samples(spark, sf).groupBy("log_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def phases(spark, sf):
    return R.timeline(R.mode_states(A.mode_signals(spark, sf)), ranges(spark, sf))


def _role(kind: str, pattern: str) -> str:
    return f"arg_min(signal, (t, s, signal)) FILTER (type = '{kind}' AND regexp_matches(signal, '{pattern}'))"


def _value(column: str, condition: str) -> str:
    return f"arg_max({column}, seq) FILTER ({condition} AND {column} IS NOT NULL)"


_ROLES = ", ".join(f"{_role('boolean', p)} AS n_{m}" for m, p in R.MODE_NAMES.items())
_NO_FLAGS = "coalesce(" + ", ".join(f"n_{m}" for m in R.MODE_NAMES) + ") IS NULL"
_FLAGS = ", ".join(f"{_value('v_bool', f'signal = n_{m}')} AS a_{m}" for m in R.MODE_NAMES)
_HELD = ", ".join(f"coalesce(last_value(a_{m} IGNORE NULLS) OVER w, FALSE) AS i_{m}" for m in R.MODE_NAMES)
PH = {
    "rg": "SELECT log_id, min(ts_us) AS first_us, max(ts_us) AS last_us FROM samples GROUP BY ALL",
    "mn": f"""SELECT log_id, {_ROLES}, {_role('int64', R.CONTROL_WORD)} AS n_word, {_role('string', R.ROBOT_MODE)} AS n_mode
             FROM (SELECT log_id, signal, type, min(ts_us) AS t, arg_min(seq, (ts_us, seq)) AS s FROM mode_signals GROUP BY ALL) GROUP BY log_id""",
    "ma": f"""SELECT log_id, ts_us, {_FLAGS}, {_value('v_long', f'{_NO_FLAGS} AND signal = n_word')} AS a_word, {_value('v_string', f'{_NO_FLAGS} AND n_word IS NULL AND signal = n_mode')} AS a_mode,
             any_value(n_enabled) AS n_enabled, bool_or(NOT ({_NO_FLAGS})) AS flags FROM mode_signals JOIN mn USING (log_id) GROUP BY log_id, ts_us""",
    "mh": f"SELECT *, {_HELD} FROM ma WINDOW w AS (PARTITION BY log_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING)",
    "st": """SELECT log_id, ts_us, 1 AS seq, phase FROM (SELECT log_id, ts_us, CASE
               WHEN flags THEN CASE WHEN coalesce(a_autonomous, a_teleop, a_enabled, a_test, a_estop) IS NULL THEN NULL WHEN i_estop OR (n_enabled IS NOT NULL AND NOT i_enabled) THEN 'disabled' WHEN i_autonomous THEN 'auto' WHEN i_teleop THEN 'teleop'
                 WHEN i_test THEN 'test' WHEN i_enabled THEN 'teleop' ELSE 'disabled' END
               WHEN a_word IS NOT NULL THEN CASE WHEN a_word & 8 <> 0 OR a_word & 1 = 0 THEN 'disabled' WHEN a_word & 2 <> 0 THEN 'auto' WHEN a_word & 4 <> 0 THEN 'test' ELSE 'teleop' END
               WHEN a_mode IS NOT NULL THEN CASE lower(trim(a_mode)) WHEN 'autonomous' THEN 'auto' WHEN 'teleop' THEN 'teleop' WHEN 'test' THEN 'test' ELSE 'disabled' END END AS phase FROM mh) WHERE phase IS NOT NULL
             UNION ALL SELECT log_id, first_us, 0, 'disabled' FROM rg WHERE log_id IN (SELECT log_id FROM mode_signals)""",
    "ch": "SELECT * FROM (SELECT *, lag(phase) OVER (PARTITION BY log_id ORDER BY ts_us, seq) AS was FROM st) WHERE was IS NULL OR was <> phase",
    "iv": """SELECT * FROM (SELECT log_id, phase, ts_us AS start_us, coalesce(lead(ts_us) OVER (PARTITION BY log_id ORDER BY ts_us, seq), last_us) AS end_us FROM ch JOIN rg USING (log_id)) WHERE end_us > start_us""",
    "kp": """SELECT * FROM (SELECT *, lag(phase) OVER w AS p, lead(phase) OVER w AS n FROM iv WINDOW w AS (PARTITION BY log_id ORDER BY start_us))
             WHERE end_us - start_us >= 100000 OR (phase = 'disabled' AND p = 'auto' AND n = 'teleop')""",
    "phases": """SELECT log_id, row_number() OVER w AS idx, phase, start_us, coalesce(lead(start_us) OVER w, last_us) AS end_us FROM kp JOIN rg USING (log_id) WINDOW w AS (PARTITION BY log_id ORDER BY start_us)
             UNION ALL SELECT log_id, 1, 'disabled', first_us, last_us FROM rg WHERE log_id IN (SELECT log_id FROM st) AND log_id NOT IN (SELECT log_id FROM kp) AND last_us > first_us""",
}


def ph(sql: str, *names: str, **more: str) -> str:
    return over("samples", "mode_signals", *names, sql=sql, **PH, **more)


_AT = "ASOF LEFT JOIN phases p ON s.log_id = p.log_id AND s.ts_us >= p.start_us"
_PHASE = "CASE WHEN s.ts_us < p.end_us THEN p.phase ELSE 'disabled' END"

query("match_phases", ph("SELECT * FROM phases"))(phases)


@query("control_word_phase", over("modes", sql="""
    SELECT seq, CASE WHEN v_long & 8 <> 0 OR v_long & 1 = 0 THEN 'disabled' WHEN v_long & 2 <> 0 THEN 'auto' WHEN v_long & 4 <> 0 THEN 'test' ELSE 'teleop' END AS phase FROM modes"""))
def control_word_phase(spark, sf):
    return A.modes(spark, sf).select("seq", R.control_word_phase(F.col("v_long")).alias("phase"))


@query("phase_durations", ph("SELECT log_id, phase, sum(end_us - start_us) / 1e6 AS seconds, count(*) AS n FROM phases GROUP BY ALL"))
def phase_durations(spark, sf):
    return phases(spark, sf).groupBy("log_id", "phase").agg((F.sum(F.col("end_us") - F.col("start_us")) / 1e6).alias("seconds"), F.count("*").alias("n"))


@query("match_flags", ph("""
    SELECT log_id, has_match, truncated, coalesce(began = 'teleop' AND NOT has_match, FALSE) AS post_reboot, first_auto_us, first_auto_end_us, first_teleop_us, first_teleop_end_us FROM (
      SELECT log_id, bool_or(phase = 'auto') AND bool_or(phase = 'teleop') AS has_match, coalesce(sum(end_us - start_us) FILTER (phase <> 'disabled'), 0) < 120000000 AS truncated, arg_min(phase, start_us) FILTER (phase <> 'disabled') AS began,
        min(start_us) FILTER (phase = 'auto') AS first_auto_us, arg_min(end_us, start_us) FILTER (phase = 'auto') AS first_auto_end_us, min(start_us) FILTER (phase = 'teleop') AS first_teleop_us, arg_min(end_us, start_us) FILTER (phase = 'teleop') AS first_teleop_end_us
      FROM phases GROUP BY ALL)"""))
def match_flags(spark, sf):
    return R.match_flags(phases(spark, sf))


@query("phase_slice", ph("SELECT seq FROM samples s WHERE EXISTS (SELECT 1 FROM phases p WHERE p.log_id = s.log_id AND p.phase = 'auto' AND s.ts_us >= p.start_us AND s.ts_us < p.end_us + 50000)"))
def phase_slice(spark, sf):
    auto = phases(spark, sf).where("phase = 'auto'").select("log_id", F.col("start_us").alias("ts_us"), F.col("start_us").alias("seq"), "end_us")
    return K.asof_backward(A.samples(spark, sf), auto, ["log_id"], ["end_us"]).where("ts_us < end_us + 50000").select("seq")


@query("interval_join", ph(f"SELECT s.seq, {_PHASE} AS phase FROM samples s {_AT}"))
def interval_join(spark, sf):
    return R.phase_of(A.samples(spark, sf), phases(spark, sf)).select("seq", "phase")


@query("interval_join_grace", ph(f"""
    SELECT seq, CASE WHEN phase <> 'disabled' THEN phase ELSE coalesce((SELECT arg_min(g.phase, g.idx) FROM phases g WHERE g.log_id = x.log_id AND g.phase <> 'disabled' AND x.ts_us BETWEEN g.end_us AND g.end_us + 50000), 'disabled') END AS phase
    FROM (SELECT s.log_id, s.seq, s.ts_us, {_PHASE} AS phase FROM samples s {_AT}) x"""))
def interval_join_grace(spark, sf):
    found = phases(spark, sf)
    rows = R.phase_of(A.samples(spark, sf), found)
    ended = found.where("phase <> 'disabled'").select("log_id", F.col("end_us").alias("r_ts_us"), F.col("phase").alias("late"), "idx")
    late = K.range_join(rows.where("phase = 'disabled'").select("log_id", "ts_us", "seq"), ended, ["log_id"], 50_000, 0)
    late = late.groupBy("seq").agg(F.min_by("late", "idx").alias("late"))
    return rows.join(late, "seq", "left").select("seq", F.coalesce("late", "phase").alias("phase"))


@query("interval_join_closed", ph("""
    SELECT seq, (SELECT arg_min(p.phase, p.idx) FROM phases p WHERE p.log_id = s.log_id AND s.ts_us BETWEEN p.start_us AND p.end_us) AS phase FROM samples s"""))
def interval_join_closed(spark, sf):
    # An interval that ends where the row is comes first: its start is strictly before the row.
    p = phases(spark, sf).select("log_id", F.col("start_us").alias("ts_us"), F.col("start_us").alias("seq"), "phase", "end_us")
    s = A.samples(spark, sf)
    before = K.asof_backward(s, p, ["log_id"], ["phase", "end_us"], strict=True)
    own = p.select("log_id", "ts_us", F.col("phase").alias("own"))
    rows = before.join(own, ["log_id", "ts_us"], "left")
    return rows.select("seq", F.when(F.col("ts_us") <= F.col("end_us"), F.col("phase")).otherwise(F.col("own")).alias("phase"))


# Power

_WATTS = """SELECT s.log_id, s.signal, s.ts_us, s.seq, s.v_double, s.v_double * coalesce(v.volts, f.volts) AS watts FROM (SELECT * FROM samples WHERE signal IN ('click', 'error', 'purchase')) s
    ASOF LEFT JOIN (SELECT log_id, ts_us, max_by(v_double, seq) AS volts FROM samples WHERE signal = 'view' GROUP BY ALL) v ON s.log_id = v.log_id AND s.ts_us >= v.ts_us
    LEFT JOIN (SELECT log_id, arg_min(v_double, (ts_us, seq)) AS volts FROM samples WHERE signal = 'view' GROUP BY ALL) f ON f.log_id = s.log_id"""
CHANNELS = ["click", "error", "purchase"]


def watts(spark, sf):
    return R.channel_power(A.samples(spark, sf), "view", CHANNELS)


# Overruns

_OV = {
    "mk": "SELECT *, CAST(regexp_matches(text, '(?i)loop time of [0-9.]+s overrun') AS INT) AS anchor FROM console",
    "me": """SELECT * FROM (SELECT *, CAST(sum(anchor) OVER w AS BIGINT) AS event, last_value(CASE WHEN anchor = 1 THEN ts_us END IGNORE NULLS) OVER w AS event_us FROM mk WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING))
             WHERE event > 0 AND ts_us - event_us <= 500000""",
    "ex": r"""SELECT log_id, event, event_us, component, greatest(arg_max(CAST(s AS DOUBLE), place) FILTER (anchor = 1), max(CAST(s AS DOUBLE)) FILTER (anchor = 0)) AS seconds FROM (
             SELECT log_id, event, event_us, anchor, unnest(range(len(regexp_extract_all(text, '(?m)^\s*(\S.*?):\s*([0-9]+\.[0-9]+)s\s*$', 1)))) AS place, unnest(regexp_extract_all(text, '(?m)^\s*(\S.*?):\s*([0-9]+\.[0-9]+)s\s*$', 1)) AS component, unnest(regexp_extract_all(text, '(?m)^\s*(\S.*?):\s*([0-9]+\.[0-9]+)s\s*$', 2)) AS s FROM me) GROUP BY ALL""",
    "ev": """SELECT h.log_id, h.event, h.event_us, h.scheduler, coalesce(round(t.s, 6), 0) AS total_s, coalesce(t.n, 0) AS components
             FROM (SELECT log_id, event, event_us, count(*) FILTER (text = 'CommandScheduler loop overrun') AS scheduler FROM me GROUP BY ALL) h
             LEFT JOIN (SELECT log_id, event, sum(seconds) AS s, count(*) AS n FROM ex GROUP BY ALL) t ON h.log_id = t.log_id AND h.event = t.event""",
}


def ov(sql: str, **more: str) -> str:
    return over("console", sql=sql, **_OV, **more)


@query("overrun_events", ov("SELECT * FROM ev"))
def overrun_events(spark, sf):
    return R.overrun_events(A.console(spark, sf))


@query("parse_epochs", ov("SELECT log_id, event, component, round(seconds, 6) AS seconds FROM ex"))
def parse_epochs(spark, sf):
    return R.epochs(R.overrun_messages(A.console(spark, sf))).select("log_id", "event", "component", r6("seconds").alias("seconds"))


@query("component_stats", ov("""
    SELECT component, any_value(top_level) AS top_level, count(*) AS n, round(median(ms), 4) AS median_ms, round(avg(ms), 4) AS mean_ms, round(quantile_cont(ms, .95), 2) AS p95_ms, round(max(ms), 4) AS max_ms, round(avg(share), 4) AS share
    FROM (SELECT component, tl AS top_level, seconds * 1000 AS ms, seconds / nullif(sum(seconds) FILTER (tl) OVER (PARTITION BY log_id, event), 0) AS share FROM (
      SELECT *, component IN ('robotPeriodic()', 'LiveWindow.updateValues()', 'SmartDashboard.updateValues()', 'Shuffleboard.update()', 'autonomousPeriodic()', 'teleopPeriodic()', 'disabledPeriodic()', 'testPeriodic()') OR component LIKE '%Init()' OR component LIKE '%Init' AS tl FROM ex))
    GROUP BY ALL HAVING avg(ms) >= .1"""))
def component_stats(spark, sf):
    """Times of components over all overruns, with their share of the main loop's stages; means under a tenth of a millisecond are left out."""
    rows = R.epochs(R.overrun_messages(A.console(spark, sf))).withColumn("top_level", R.is_top_level(F.col("component")))
    whole = F.sum(F.when(F.col("top_level"), F.col("seconds"))).over(Window.partitionBy("log_id", "event"))
    rows = rows.withColumn("share", F.when(whole != 0, F.col("seconds") / whole)).withColumn("ms", F.col("seconds") * 1000)
    r4 = lambda c: F.round(c, 4)
    found = rows.groupBy("component", "top_level").agg(F.count("*").alias("n"), r4(F.avg("ms")).alias("mean_ms"), r4(F.max("ms")).alias("max_ms"), r4(F.avg("share")).alias("share")).where("mean_ms >= .1D")
    out = Qn.with_quantiles(found, rows, ["component"], "ms", median_ms=Qn.MEDIAN, p95_ms=Qn.at(0.95))
    return out.withColumns({"median_ms": r4("median_ms"), "p95_ms": F.round("p95_ms", 2)})


@query("categorise_component", ov(r"""
    SELECT DISTINCT component, CASE WHEN component LIKE '%Init()' OR component LIKE '%Init' THEN 'phase_init' WHEN component IN ('autonomousPeriodic()', 'teleopPeriodic()', 'disabledPeriodic()', 'testPeriodic()')
        OR starts_with(component, 'robotPeriodic') OR starts_with(component, 'LiveWindow.') OR starts_with(component, 'SmartDashboard.') OR starts_with(component, 'Shuffleboard.') THEN 'framework'
      WHEN component LIKE '%.periodic()' THEN 'subsystem' WHEN component LIKE '%.execute()' OR component LIKE '%.initialize()' THEN 'command' ELSE 'other' END AS category FROM ex"""))
def categorise_component(spark, sf):
    return parse_epochs(spark, sf).select("component", R.categorise(F.col("component")).alias("category")).distinct()


@query("overrun_bursts", ov("""
    SELECT log_id, min(event_us) AS start_us, max(event_us) AS end_us, count(*) AS n FROM (
      SELECT *, sum(nw) OVER (PARTITION BY log_id ORDER BY event_us, event ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN event_us - lag(event_us) OVER (PARTITION BY log_id ORDER BY event_us, event) <= 100000 THEN 0 ELSE 1 END AS nw FROM ev)) GROUP BY log_id, g HAVING count(*) >= 2"""))
def overrun_bursts(spark, sf):
    rows = K.gap_sessions(overrun_events(spark, sf).select("log_id", F.col("event_us").alias("ts_us"), F.col("event").alias("seq")), ["log_id"], 100_000)
    return rows.groupBy("log_id", "session").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n")).where("n >= 2").drop("session")


@query("detect_loop_period", over("console", sql="SELECT log_id, coalesce(arg_min(CAST(regexp_extract(text, '[Ll]oop time of ([0-9.]+)s', 1) AS DOUBLE), (ts_us, seq)), .02) AS period_s FROM console WHERE text LIKE '%overrun%' AND text LIKE '%oop time%' GROUP BY ALL"))
def detect_loop_period(spark, sf):
    rows = A.console(spark, sf).where("text like '%overrun%' and text like '%oop time%'")
    period = F.regexp_extract("text", "[Ll]oop time of ([0-9.]+)s", 1).cast("double")
    return rows.groupBy("log_id").agg(F.coalesce(F.min_by(period, F.struct("ts_us", "seq")), F.lit(0.02)).alias("period_s"))


_CMD = "SELECT log_id, ts_us, seq, regexp_extract(text, '^Command (initialized|interrupted|finished): (.*)$', 1) AS kind, regexp_extract(text, '^Command (initialized|interrupted|finished): (.*)$', 2) AS name FROM console WHERE text LIKE 'Command %: %'"
_DEFAULTS = "('" + "', '".join(R.DEFAULT_COMMANDS) + "')"


@query("unnamed_commands", over("samples", "mode_signals", "console", sql=f"""
    SELECT log_id, name, count(*) FILTER (kind = 'initialized') AS initialized, count(*) FILTER (kind = 'interrupted') AS interrupted, count(*) FILTER (kind = 'finished') AS finished, count(*) AS total, count(DISTINCT phase) AS phases, min(phase) AS first_phase
    FROM (SELECT c.*, CASE WHEN c.ts_us < p.end_us THEN p.phase ELSE 'disabled' END AS phase FROM c ASOF LEFT JOIN phases p ON c.log_id = p.log_id AND c.ts_us >= p.start_us) WHERE name IN {_DEFAULTS} GROUP BY ALL ORDER BY total DESC, log_id, name""", c=_CMD, **PH))
def unnamed_commands(spark, sf):
    """Commands that nobody named: how often they began, were interrupted and ended, and in how many phases, the busiest first."""
    rows = R.phase_of(R.commands(A.console(spark, sf)).where(F.col("name").isin(R.DEFAULT_COMMANDS)), phases(spark, sf))
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    found = rows.groupBy("log_id", "name").agg(of("initialized"), of("interrupted"), of("finished"), F.count("*").alias("total"), F.countDistinct("phase").alias("phases"), F.min("phase").alias("first_phase"))
    return found.orderBy(F.desc("total"), "log_id", "name")


@query("named_minus_default", over("console", sql=f"SELECT log_id, count(DISTINCT name) AS named FROM c WHERE name NOT IN {_DEFAULTS} GROUP BY ALL", c=_CMD))
def named_minus_default(spark, sf):
    return R.commands(A.console(spark, sf)).where(~F.col("name").isin(R.DEFAULT_COMMANDS)).groupBy("log_id").agg(F.countDistinct("name").alias("named"))


@query("command_correlation", over("console", "scheduler_names", sql=f"""
    SELECT log_id, name, overruns, round(median_ms, 8) AS median_ms, round(mean_ms, 8) AS mean_ms, round(max_ms, 8) AS max_ms, round(execute_ms, 8) AS execute_ms, name IN {_DEFAULTS} AS unnamed FROM (
      SELECT log_id, name, count(*) AS overruns, median(ms) AS median_ms, avg(ms) AS mean_ms, max(ms) AS max_ms FROM (
        SELECT e.log_id, e.total_s * 1000 AS ms, unnest(k.names) AS name FROM ev e ASOF JOIN (SELECT log_id, ts_us, arg_max(names, seq) AS names FROM scheduler_names GROUP BY ALL) k ON e.log_id = k.log_id AND e.event_us >= k.ts_us) GROUP BY ALL) c
    LEFT JOIN (SELECT log_id, replace(component, '.execute()', '') AS name, avg(seconds * 1000) AS execute_ms FROM ex WHERE component LIKE '%.execute()' GROUP BY ALL) x USING (log_id, name)""", **_OV))
def command_correlation(spark, sf):
    """Overruns by the commands that ran at them."""
    console = A.console(spark, sf)
    events = R.overrun_events(console).withColumns({"ts_us": F.col("event_us"), "seq": F.col("event")})
    found = R.command_correlation(events, A.scheduler_names(spark, sf), R.epochs(R.overrun_messages(console)))
    return found.withColumns({c: F.round(c, 8) for c in ("median_ms", "mean_ms", "max_ms", "execute_ms")})


@query("phase_transition_overruns", over("samples", "mode_signals", "console", sql="""
    SELECT p.log_id, p.start_us, p.phase, count(*) AS overruns, round(sum(total_s), 6) AS total_s FROM phases p JOIN ev e ON p.log_id = e.log_id AND p.phase <> 'disabled' AND e.event_us BETWEEN p.start_us - 500000 AND p.start_us + 500000 GROUP BY ALL""", **PH, **_OV))
def phase_transition_overruns(spark, sf):
    left = phases(spark, sf).where("phase <> 'disabled'").withColumn("ts_us", F.col("start_us"))
    right = overrun_events(spark, sf).select("log_id", F.col("event_us").alias("r_ts_us"), "total_s")
    rows = K.range_join(left, right, ["log_id"], 500_000, 500_000)
    return rows.groupBy("log_id", "start_us", "phase").agg(F.count("*").alias("overruns"), r6(F.sum("total_s")).alias("total_s"))


# Hits

_AX = """SELECT log_id, ts_us // 50000 * 50000 AS ts_us, min(seq) AS seq, max(v_double) FILTER (signal = 'click') / 100 AS ax, max(v_double) FILTER (signal = 'view') / 100 AS ay, max(v_double) FILTER (signal = 'error') / 100 AS az
    FROM samples GROUP BY log_id, ts_us // 50000 HAVING ax IS NOT NULL AND ay IS NOT NULL AND az IS NOT NULL"""
_IM = {
    "ax": _AX,
    "mg": "SELECT *, sqrt(ax * ax + ay * ay + az * az) AS mag FROM ax",
    "lo": "SELECT *, abs(mag - 1) AS v_double, min(mag) OVER (PARTITION BY log_id ORDER BY ts_us RANGE BETWEEN 200000 PRECEDING AND 1 PRECEDING) AS low FROM mg",
    "h": "SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ts_us, seq) AS i FROM lo WHERE v_double >= .5",
    "f": """SELECT log_id, i, ts_us AS rt, seq AS rs, v_double AS sc, 1 AS g FROM h WHERE i = 1
    UNION ALL SELECT h.log_id, h.i, CASE WHEN h.ts_us - f.rt > 300000 OR h.v_double > f.sc THEN h.ts_us ELSE f.rt END, CASE WHEN h.ts_us - f.rt > 300000 OR h.v_double > f.sc THEN h.seq ELSE f.rs END,
      CASE WHEN h.ts_us - f.rt > 300000 OR h.v_double > f.sc THEN h.v_double ELSE f.sc END, CASE WHEN h.ts_us - f.rt > 300000 THEN f.g + 1 ELSE f.g END
    FROM f JOIN h ON h.log_id = f.log_id AND h.i = f.i + 1""",
    "pk": "SELECT log_id, g, arg_max(rt, i) AS ts_us, arg_max(rs, i) AS seq, max(sc) AS score FROM f GROUP BY log_id, g",
    "hits": """SELECT p.log_id, p.ts_us, p.seq, round(p.score, 6) AS score, CASE WHEN p.score >= 2 THEN 'hard' WHEN p.score >= 1 THEN 'moderate' ELSE 'light' END AS severity,
      CASE WHEN lo.low < .3 THEN 'landing' ELSE 'contact' END AS kind FROM pk p JOIN lo ON lo.log_id = p.log_id AND lo.seq = p.seq""",
}


def axes(spark, sf):
    rows = A.samples(spark, sf).withColumn("t", F.floor(F.col("ts_us") / 50_000) * 50_000)
    pick = lambda s: (F.max(F.when(F.col("signal") == s, F.col("v_double"))) / 100)
    return rows.groupBy("log_id", F.col("t").alias("ts_us")).agg(F.min("seq").alias("seq"), pick("click").alias("ax"), pick("view").alias("ay"), pick("error").alias("az")).na.drop()


_LB = """SELECT *, (SELECT arg_max(b.v_double, (b.ts_us, b.seq)) FROM s b WHERE b.log_id = a.log_id AND b.ts_us <= a.ts_us - {w}) AS o, (SELECT arg_max(b.ts_us, (b.ts_us, b.seq)) FROM s b WHERE b.log_id = a.log_id AND b.ts_us <= a.ts_us - {w}) AS ou,
    first_value(v_double) OVER w AS fv, first_value(ts_us) OVER w AS fu FROM s a WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq)"""


@query("lookback_derivative", over("samples", sql="SELECT seq, round(v_double - coalesce(o, fv), 6) AS rise, ts_us - coalesce(ou, fu) AS age_us FROM x",
                                   s="SELECT * FROM samples WHERE signal = 'error'", x=_LB.format(w=20000)))
def lookback_derivative(spark, sf):
    rows = R.lookback(A.samples(spark, sf).where("signal = 'error'"), SIGNAL, "v_double", 20_000, "a")
    return rows.select("seq", r6(F.col("v_double") - F.col("a_v")).alias("rise"), (F.col("ts_us") - F.col("a_us")).alias("age_us"))


@query("hard_hits_rotational", over("samples", recursive=True, sql="SELECT log_id, signal, arg_max(rt, i) AS ts_us, arg_max(rs, i) AS seq, round(max(sc), 6) AS score FROM fr GROUP BY log_id, signal, g", **ROTATIONAL))
def hard_hits_rotational(spark, sf):
    return R.rotational_hits(A.samples(spark, sf).where("signal = 'error'"), 2000.0, 80.0).withColumn("score", r6("score"))


@query("severity_impact", over("samples", sql="SELECT seq, CASE WHEN v_double >= 100 THEN 'hard' WHEN v_double >= 50 THEN 'moderate' WHEN v_double >= 20 THEN 'light' END AS severity FROM samples"))
def severity_impact(spark, sf):
    v = F.col("v_double")
    return A.samples(spark, sf).select("seq", F.when(v >= 100, "hard").when(v >= 50, "moderate").when(v >= 20, "light").alias("severity"))


# Launches and motors


def la(sql: str) -> str:
    return over("samples", recursive=True, sql=sql, **LAUNCHES)


@query("launch_events", la("SELECT * FROM le"))
def launch_events(spark, sf):
    return R.launches(A.samples(spark, sf), at_speed=40.0, drop=8.0, floor=10.0)


@query("launch_summary", la("""
    SELECT log_id, signal, count(*) AS n, round(min(d), 6) AS least_drop, round(list_sort(list(d))[CAST(count(*) // 2 AS BIGINT) + 1], 6) AS median_drop, round(max(d), 6) AS most_drop, count(*) FILTER (gap < 2000000) AS in_bursts,
      min(gap) FILTER (gap < 2000000) / 1000 AS least_gap_ms, max(gap) FILTER (gap < 2000000) / 1000 AS most_gap_ms, round(1e6 / min(gap) FILTER (gap < 2000000 AND gap > 0), 6) AS peak_rate_hz
    FROM (SELECT *, baseline - dip AS d, ts_us - lag(ts_us) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS gap FROM le) GROUP BY ALL"""))
def launch_summary(spark, sf):
    rows = launch_events(spark, sf).withColumns({"gap": F.col("ts_us") - F.lag("ts_us").over(by_time(*SIGNAL)), "d": F.col("baseline") - F.col("dip")})
    burst = F.when(F.col("gap") < 2_000_000, F.col("gap"))
    found = rows.groupBy(*SIGNAL).agg(
        F.count("*").alias("n"), r6(F.min("d")).alias("least_drop"), r6(F.max("d")).alias("most_drop"), F.count(burst).alias("in_bursts"),
        (F.min(burst) / 1000).alias("least_gap_ms"), (F.max(burst) / 1000).alias("most_gap_ms"), r6(1e6 / F.min(F.when(burst > 0, burst))).alias("peak_rate_hz"),
    )
    middle = percentile_floor(rows, SIGNAL, 0.5, "d").select(*SIGNAL, r6("p_floor").alias("median_drop"))
    return found.join(middle, SIGNAL)


@query("launches_per_log", over("samples", "mode_signals", recursive=True, sql="""
    SELECT log_id, count(*) AS n, round(count(*) / 2.5e0, 6) AS per_minute, count(*) FILTER (phase = 'auto') AS auto, count(*) FILTER (phase = 'teleop') AS teleop
    FROM (SELECT l.log_id, CASE WHEN l.ts_us < p.end_us THEN p.phase ELSE 'disabled' END AS phase FROM le l ASOF LEFT JOIN phases p ON l.log_id = p.log_id AND l.ts_us >= p.start_us) GROUP BY ALL""", **PH, **LAUNCHES))
def launches_per_log(spark, sf):
    """Launches, those a minute of a match of two and a half, and those in either phase of it."""
    rows = R.phase_of(launch_events(spark, sf), phases(spark, sf))
    during = lambda p: F.count_if(F.col("phase") == p).alias(p)
    return rows.groupBy("log_id").agg(F.count("*").alias("n"), r6(F.count("*") / 2.5).alias("per_minute"), during("auto"), during("teleop"))


@query("interval_histogram", la("""
    SELECT CAST(least(floor(gap / 100000), 9) AS BIGINT) AS bin, count(*) AS n FROM (SELECT ts_us - lag(ts_us) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS gap FROM le) WHERE gap IS NOT NULL GROUP BY ALL"""))
def interval_histogram(spark, sf):
    rows = launch_events(spark, sf).withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(by_time(*SIGNAL))).where("gap is not null")
    return rows.groupBy(F.least(F.floor(F.col("gap") / 100_000), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"))


@query("spin_periods", over("samples", sql="""
    SELECT log_id, signal, min(start_us) AS start_us, max(end_us) AS end_us FROM (SELECT *, sum(nw) OVER (PARTITION BY log_id, signal ORDER BY start_us) AS g FROM (
      SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY log_id, signal ORDER BY start_us) < 200000 THEN 0 ELSE 1 END AS nw FROM i)) GROUP BY log_id, signal, g""",
    h="SELECT *, coalesce(last_value(CASE WHEN v_double > 55 THEN 1 WHEN v_double <= 22 THEN 0 END IGNORE NULLS) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM samples",
    e="SELECT * FROM (SELECT *, coalesce(lag(on_) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq), 0) AS was, max(ts_us) OVER (PARTITION BY log_id, signal) AS z FROM h) WHERE on_ <> was",
    i="SELECT log_id, signal, ts_us AS start_us, coalesce(nxt, z) AS end_us FROM (SELECT *, lead(ts_us) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS nxt FROM e) WHERE on_ = 1"))
def spin_periods(spark, sf):
    return K.merge_close(K.hysteresis(A.samples(spark, sf), SIGNAL, F.col("v_double") > 55, F.col("v_double") <= 22), SIGNAL, 200_000)


_SP = "SELECT log_id, signal, median(abs(v_double)) AS m FROM samples GROUP BY ALL"


@query("velocity_dips", over("samples", sql="""
    SELECT seq FROM (SELECT *, lag(low) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS was FROM (
      SELECT *, abs(v_double) < .5 * avg(abs(v_double)) OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AND abs(v_double) > 5 AS low FROM samples)) WHERE low AND was = false"""))
def velocity_dips(spark, sf):
    mean = F.avg(F.abs("v_double")).over(by_time(*SIGNAL).rowsBetween(-4, 4))
    rows = A.samples(spark, sf).withColumn("low", (F.abs("v_double") < 0.5 * mean) & (F.abs("v_double") > 5))
    return rows.withColumn("was", F.lag("low").over(by_time(*SIGNAL))).where("low and not was").select("seq")


@query("motor_window_stats", ph("""
    SELECT s.log_id, s.signal, p.idx, count(*) AS n, min(v_double) AS min_v, max(v_double) AS max_v, round(avg(v_double), 6) AS mean_v FROM samples s
    JOIN phases p ON s.log_id = p.log_id AND s.ts_us >= p.start_us AND s.ts_us < p.end_us AND p.phase <> 'disabled' GROUP BY ALL"""))
def motor_window_stats(spark, sf):
    p = phases(spark, sf).where("phase <> 'disabled'").select("log_id", F.col("start_us").alias("ts_us"), F.col("start_us").alias("seq"), "end_us", "idx")
    rows = K.asof_backward(A.samples(spark, sf), p, ["log_id"], ["end_us", "idx"]).where("ts_us < end_us")
    return rows.groupBy(*SIGNAL, "idx").agg(F.count("*").alias("n"), F.min("v_double").alias("min_v"), F.max("v_double").alias("max_v"), r6(F.avg("v_double")).alias("mean_v"))


@query("enable_window_stats", ph("""
    SELECT s.log_id, s.signal, p.idx, count(*) AS n, round(avg(v_double), 6) AS mean_v FROM samples s JOIN phases p ON s.log_id = p.log_id AND p.phase <> 'disabled' AND s.ts_us BETWEEN p.start_us - 100000 AND p.start_us + 400000 GROUP BY ALL"""))
def enable_window_stats(spark, sf):
    starts = phases(spark, sf).where("phase <> 'disabled'").select("log_id", F.col("start_us").alias("ts_us"), "idx")
    right = A.samples(spark, sf).withColumnRenamed("ts_us", "r_ts_us")
    return K.range_join(starts, right, ["log_id"], 100_000, 400_000).groupBy(*SIGNAL, "idx").agg(F.count("*").alias("n"), r6(F.avg("v_double")).alias("mean_v"))
