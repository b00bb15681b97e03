"""Queries for raw records, file names, exports and console texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import export as X
from wayline.operators import robot as R
from wayline.operators.basic import SIGNAL, r6
from wayline.plans import studies
from wayline.plans.views_sql import over
from wayline.sources import adapters as A
from wayline.sources import ds_logs as D
from wayline.sources import files as N
from wayline.sources import raw

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# File names. Orders stand for files, their dates for the starts.

_FORM = """SELECT o_orderkey, o_custkey, o_orderkey % 6 AS form, o_orderdate AS t, lpad(lower(printf('%x', o_custkey)), 32, '0') AS hex FROM orders"""
_NAMES = """SELECT *, CASE form WHEN 0 THEN strftime(t, 'FRC_%Y%m%d_%H%M%S.wpilog') WHEN 1 THEN strftime(t, '%Y_%m_%d %H_%M_%S Sat.dslog') WHEN 2 THEN strftime(t, '%Y_%m_%d %H_%M_%S Sat.DSEVENTS')
    WHEN 3 THEN strftime(t, 'rio_%Y-%m-%d_%H-%M-%S.hoot') WHEN 4 THEN hex || strftime(t, '_%Y-%m-%d_%H-%M-%S.hoot') ELSE strftime(t, 'FRC_%Y13%d_%H%M%S.wpilog') END AS name FROM fo"""


def names(spark, sf):
    o = A.table(spark, sf, "orders").withColumn("form", F.col("o_orderkey") % 6)
    at = lambda form: F.date_format("o_orderdate", form)
    forms = [
        at("'FRC_'yyyyMMdd_HHmmss'.wpilog'"), at("yyyy_MM_dd HH_mm_ss' Sat.dslog'"), at("yyyy_MM_dd HH_mm_ss' Sat.DSEVENTS'"), at("'rio_'yyyy-MM-dd_HH-mm-ss'.hoot'"),
        F.concat(F.lpad(F.lower(F.hex("o_custkey")), 32, "0"), at("'_'yyyy-MM-dd_HH-mm-ss'.hoot'")), at("'FRC_'yyyy'13'dd_HHmmss'.wpilog'"),
    ]
    name = forms[-1]
    for i, form in enumerate(forms[:-1]):
        name = F.when(F.col("form") == i, form).otherwise(name)
    return o.select("o_orderkey", F.concat(F.lit("/logs/"), name).alias("path"))


@query("filename_timestamp", over(sql="""
    SELECT o_orderkey, CASE form WHEN 5 THEN 0 WHEN 2 THEN NULL ELSE CAST(floor(epoch(t)) AS BIGINT) END AS start_s, CASE WHEN form = 4 THEN hex WHEN form = 3 THEN 'rio' ELSE split_part(regexp_replace(name, '[.][^.]*$', ''), '_', 1) END AS bus FROM na""", fo=_FORM, na=_NAMES))
def filename_timestamp(spark, sf):
    """Names of four forms, one with a month that doesn't exist, and one whose ending in capitals no form takes."""
    return names(spark, sf).select("o_orderkey", N.start_s(F.col("path")).alias("start_s"), N.bus(F.col("path")).alias("bus"))


@query("scan_log_files", over(sql="""
    SELECT CASE form WHEN 1 THEN 'dslog' WHEN 2 THEN 'dsevents' WHEN 3 THEN 'hoot' WHEN 4 THEN 'hoot' ELSE 'wpilog' END AS kind, '/logs/' || name AS path FROM na ORDER BY ALL""", fo=_FORM, na=_NAMES))
def scan_log_files(spark, sf):
    """The paths of the four kinds of log files, sorted within each kind; others are left out."""
    return N.by_kind(names(spark, sf))


@query("match_label", over(sql="""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Q' || o_custkey % 90 WHEN form IN (0, 5) THEN 'Practice_' || strftime(t, '%H%M%S') ELSE name END AS label FROM na""", fo=_FORM, na=_NAMES))
def match_label(spark, sf):
    named = names(spark, sf).join(A.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    path = F.when(F.col("o_orderkey") % 4 == 0, F.concat("path", F.lit("_EVENT_Q"), (F.col("o_custkey") % 90).cast("string"), F.lit("_x"))).otherwise(F.col("path"))
    return named.select("o_orderkey", N.label(path, "EVENT").alias("label"))


@query("read_by_extension", over("samples", "console", sql="""
    SELECT log_id || '_' || (ts_us // 2000000) || '.DSLOG' AS path, 'dslog' AS kind, count(*) AS records FROM samples WHERE signal = 'error' GROUP BY ALL
    UNION ALL SELECT log_id || '_' || (ts_us // 2000000) || '.DsEvents', 'dsevents', count(*) FROM console GROUP BY ALL
    UNION ALL SELECT DISTINCT log_id || '_' || (ts_us // 2000000) || '.txt', 'unsupported', CAST(0 AS BIGINT) FROM samples WHERE signal = 'error'"""))
def read_by_extension(spark, sf):
    """Files of two readable kinds and one that isn't, each sent to its reader by its ending; the last kind is reported."""
    renamed = lambda files, name: files.withColumn("path", F.concat(F.split("path", r"\.")[0], F.lit(name)))
    telemetry, events = renamed(studies.ds_files(spark, sf), ".DSLOG"), renamed(D.event_files(A.console(spark, sf)), ".DsEvents")
    other = renamed(studies.ds_files(spark, sf), ".txt").withColumn("content", F.lit(None).cast("binary"))
    files = telemetry.unionByName(events).unionByName(other).withColumn("kind", F.coalesce(N.kind(F.col("path")), F.lit("unsupported")))
    of = lambda k: files.where(F.col("kind") == k).select("path", "content")
    read = D.telemetry(of("dslog")).select("path").unionByName(D.events(of("dsevents")).select("path")).groupBy("path").agg(F.count("*").alias("records"))
    return files.select("path", "kind").join(read, "path", "left").select("path", "kind", F.coalesce("records", F.lit(0)).alias("records"))


@query("ds_pair_merge", over("samples", "console", sql="""
    SELECT log_id || '_' || (ts_us // 2000000) AS stem, 'volts' AS signal, (row_number() OVER (PARTITION BY log_id, ts_us // 2000000 ORDER BY ts_us, seq) - 1) * 20000 AS relative_us, 12 + (CAST(floor(v_double) AS BIGINT) % 256) / 256 AS v_double, NULL AS text FROM samples WHERE signal = 'error'
    UNION ALL SELECT log_id || '_' || (ts_us // 2000000), 'events', ts_us // 1000000 * 1000000, NULL, text FROM console"""))
def ds_pair_merge(spark, sf):
    """Telemetry and event files of one stem as one log, times since the start of either."""
    stem = lambda c: F.split(c, r"\.")[0].alias("stem")
    records = D.telemetry(studies.ds_files(spark, sf)).select(stem("path"), F.lit("volts").alias("signal"), (F.col("seq") * D.STEP_US).alias("relative_us"), F.col("volts").alias("v_double"))
    events = D.events(D.event_files(A.console(spark, sf))).select(stem("path"), F.lit("events").alias("signal"), "relative_us", "text")
    return records.unionByName(events, allowMissingColumns=True)


# Records. Samples stand for a stream of records: every fourth sign-up starts an entry of its log.

_ST = """SELECT log_id, ts_us, seq, CAST(seq % 8 AS BIGINT) AS entry_id, 'signal' || (seq % 5) AS name, ['double', 'int64', 'string', 'boolean', 'struct:Pose2d'][CAST(seq % 5 AS INT) + 1] AS type FROM samples WHERE signal = 'signup'"""
_FIRST = "SELECT log_id, name, arg_min(type, (ts_us, seq)) AS type, min(seq) AS first_seq FROM st GROUP BY ALL"
_DATA = """SELECT d.log_id, d.ts_us, d.seq, s.name, f.type, d.v_double FROM (SELECT *, CAST(seq % 8 AS BIGINT) AS entry_id FROM samples WHERE signal <> 'signup') d
    ASOF JOIN (SELECT log_id, entry_id, ts_us, max_by(name, seq) AS name FROM st GROUP BY ALL) s ON d.log_id = s.log_id AND d.entry_id = s.entry_id AND d.ts_us >= s.ts_us JOIN fi f ON f.log_id = d.log_id AND f.name = s.name"""
_REC = {"st": _ST, "fi": _FIRST, "da": _DATA}


def records(spark, sf):
    """Start records (entry_id, name, type) and data records (entry_id, payload) from the samples; every seventh payload can't be read as its type."""
    s = A.samples(spark, sf).withColumn("entry_id", F.col("seq") % 8)
    types = F.array(*map(F.lit, ("double", "int64", "string", "boolean", "struct:Pose2d")))
    starts = s.where("signal = 'signup'").select("log_id", "ts_us", "seq", "entry_id", F.concat(F.lit("signal"), (F.col("seq") % 5).cast("string")).alias("name"), F.get(types, (F.col("seq") % 5).cast("int")).alias("type"))
    payload = F.when(F.col("seq") % 7 == 0, F.lit("?")).otherwise(F.floor("v_double").cast("string"))
    return starts, s.where("signal <> 'signup'").select("log_id", "ts_us", "seq", "entry_id", payload.alias("payload"))


@query("resolve_records", over("samples", sql="SELECT log_id, seq, name, type FROM da", **_REC))
def resolve_records(spark, sf):
    """Data records with the signal of their entry as of then; the first start of a name settles its type, data without a start are dropped."""
    return raw.resolve(*records(spark, sf)).select("log_id", "seq", "name", "type")


@query("decode_value", over("samples", sql="""
    SELECT seq, raw_kind AS kind, CASE WHEN raw_kind = 'double' AND seq % 7 <> 0 THEN floor(v_double) END AS v_double, CASE WHEN raw_kind = 'int64' AND seq % 7 <> 0 THEN CAST(floor(v_double) AS BIGINT) END AS v_long,
      CASE WHEN raw_kind = 'string' THEN CASE WHEN seq % 7 = 0 THEN '?' ELSE CAST(CAST(floor(v_double) AS BIGINT) AS VARCHAR) END END AS v_str, CASE WHEN raw_kind = 'boolean' AND seq % 7 <> 0 AND floor(v_double) IN (0, 1) THEN floor(v_double) = 1 END AS v_bool,
      raw_kind = 'struct' OR (raw_kind IN ('double', 'int64') AND seq % 7 = 0) OR (raw_kind = 'boolean' AND (seq % 7 = 0 OR floor(v_double) NOT IN (0, 1))) AS kept_raw
    FROM (SELECT *, CASE WHEN type = 'struct:Pose2d' THEN 'struct' ELSE type END AS raw_kind FROM da)""", **_REC))
def decode_value(spark, sf):
    """Payloads read as their signal's type; what can't be read so, and structs, stay as bytes."""
    return raw.decode(raw.resolve(*records(spark, sf))).select("seq", "kind", "v_double", "v_long", "v_str", "v_bool", F.col("v_bin").isNotNull().alias("kept_raw"))


# Exports


@query("csv_export", over("samples", sql="""SELECT log_id, seq, signal || ',' || ts_us || ',' || CAST(CAST(floor(v_double) AS BIGINT) AS VARCHAR) AS line FROM samples"""))
def csv_export(spark, sf):
    """Every log written as CSV (signal, timestamp_us, value) below the shared folder, read again and shown as lines."""
    rows = A.samples(spark, sf).select("log_id", "seq", "signal", F.col("ts_us").alias("timestamp_us"), F.floor("v_double").alias("value"))
    back = X.read_csv(spark, X.write_csv(rows, "log_id"), "signal string, timestamp_us long, value long, seq long, log_id long")
    return back.select("log_id", "seq", F.concat_ws(",", "signal", "timestamp_us", "value").alias("line"))


_RES = """SELECT log_id, signal, count(*) AS n, round(avg(v_double), 6) AS mean, list(seq ORDER BY seq) AS ids FROM samples GROUP BY ALL"""


def results(spark, sf):
    """A nested result per log and signal: numbers, a struct in a struct, a list that may be long."""
    found = A.samples(spark, sf).groupBy(*SIGNAL).agg(F.count("*").alias("n"), r6(F.avg("v_double")).alias("mean"), F.max("ts_us").alias("last"), F.array_sort(F.collect_list("seq")).alias("ids"))
    return found.select(*SIGNAL, F.struct("n", F.struct("mean", F.struct("last").alias("deep")).alias("stats"), "ids").alias("extra"))


@query("results_json", over("samples", sql="""
    SELECT log_id, signal, n, round(mean, 6) AS mean, CASE WHEN n > 100 THEN n END AS skipped, CASE WHEN n <= 100 THEN ids[1] END AS first_id FROM r""", r=_RES))
def results_json(spark, sf):
    """Results as JSON text, read back: lists of over 100 items give way to a mark with their length."""
    text = results(spark, sf).select(*SIGNAL, F.to_json(X.json_safe(F.col("extra"), results(spark, sf).schema["extra"].dataType, 100)).alias("body"))
    of = lambda path, kind: F.get_json_object("body", path).cast(kind)
    return text.select(*SIGNAL, of("$.n", "bigint").alias("n"), r6(of("$.stats.mean", "double")).alias("mean"), of("$.ids.length", "bigint").alias("skipped"), of("$.ids[0]", "bigint").alias("first_id"))


@query("results_csv_flatten", over("samples", sql="""
    SELECT log_id, signal, n AS "extra.n", mean AS "extra.stats.mean", NULL AS "extra.duration" FROM r UNION ALL SELECT DISTINCT log_id, 'all', NULL, NULL, 5 FROM samples""", r=_RES))
def results_csv_flatten(spark, sf):
    """Two sorts of results as one flat table: scalars of two levels with dotted names, and the union of both sorts' columns."""
    other = A.samples(spark, sf).select("log_id").distinct().select("log_id", F.lit("all").alias("signal"), F.struct(F.lit(5).cast("bigint").alias("duration")).alias("extra"))
    return X.flatten(results(spark, sf), "extra").unionByName(X.flatten(other, "extra"), allowMissingColumns=True)


@query("export_results", over("samples", sql="SELECT log_id, signal, n, mean AS mean_v FROM r", r=_RES))
def export_results(spark, sf):
    """One analysis of all logs, written as one JSON-lines table partitioned by log below the shared folder, and read again."""
    rows = results(spark, sf).select(*SIGNAL, "extra.n", F.col("extra.stats.mean").alias("mean_v"))
    return spark.read.schema("signal string, n long, mean_v double, log_id long").json(X.write_json(rows, "log_id"))


# Console texts


@query("parse_command_message", over("console", sql="SELECT seq, kind, name FROM c", c="""
    SELECT seq, regexp_extract(text, '^Command (initialized|interrupted|finished): (.*)$', 1) AS kind, regexp_extract(text, '^Command (initialized|interrupted|finished): (.*)$', 2) AS name FROM console WHERE text LIKE 'Command %: %'"""))
def parse_command_message(spark, sf):
    """Command lines; interrupted ones name a cause, which isn't part of the name."""
    cause = F.when(F.col("text").startswith("Command interrupted"), F.lit("; Cause: Other")).otherwise("")
    return R.commands(A.console(spark, sf).withColumn("text", F.concat("text", cause))).select("seq", "kind", "name")


_NEAR = """SELECT seq, ['DataLog: flushed', 'CANbus timed out', 'NetworkTables restarted', 'low voltage', 'a warning', 'nothing'][CAST(seq % 6 AS INT) + 1] || ' ' || text AS line, seq % 6 AS k FROM console WHERE text LIKE 'Command %: %'"""


@query("classify_nearby", over("console", sql="SELECT seq, ['datalog', 'can', 'nt', 'brownout', 'warning', NULL][CAST(k AS INT) + 1] AS kind FROM n", n=_NEAR))
def classify_nearby(spark, sf):
    """Lines of each category and of none before the text of commands."""
    heads = F.array(*map(F.lit, ("DataLog: flushed", "CANbus timed out", "NetworkTables restarted", "low voltage", "a warning", "nothing")))
    rows = A.console(spark, sf).where("text like 'Command %: %'")
    return rows.select("seq", R.classify_nearby(F.concat_ws(" ", F.get(heads, (F.col("seq") % 6).cast("int")), "text")).alias("kind"))


@query("parse_memory_message", over("samples", sql="SELECT seq, CASE WHEN seq % 3 <> 0 THEN CAST(floor(v_double * 10) AS BIGINT) END AS disk_mb, CASE WHEN seq % 3 <> 0 THEN CAST(floor(v_double) AS BIGINT) END AS memory_mb FROM samples"))
def parse_memory_message(spark, sf):
    number = lambda c: F.floor(c).cast("string")
    report = F.concat(F.lit("<message> roboRIO:  Disk Free "), number(F.col("v_double") * 10), F.lit(" MB, Memory Free "), number("v_double"), F.lit(" MB"))
    rows = A.samples(spark, sf).select("seq", R.memory_report(F.when(F.col("seq") % 3 == 0, F.lit("Memory low")).otherwise(report)).alias("m"))
    return rows.select("seq", "m.disk_mb", "m.memory_mb")


@query("is_tag_dependent", over("samples", sql="SELECT seq, seq % 3 <> 2 AS dependent FROM samples"))
def is_tag_dependent(spark, sf):
    """Signals of a camera, of the pose filter and of a motor."""
    names_ = F.array(F.lit("NT:/limelight-a/botpose_wpiblue"), F.lit("NT:/Pose/Mt1 STD"), F.lit("NT:/limelight/Shooter/velocity"))
    return A.samples(spark, sf).select("seq", R.is_tag_dependent(F.get(names_, (F.col("seq") % 3).cast("int"))).alias("dependent"))


@query("severity_angular", over("samples", sql="""
    SELECT seq, ['hard', 'moderate', 'light', NULL][CAST(least(CASE WHEN a >= 4000 THEN 1 WHEN a >= 2500 THEN 2 WHEN a >= 1500 THEN 3 ELSE 4 END, CASE WHEN d >= 150 THEN 1 WHEN d >= 100 THEN 2 WHEN d >= 50 THEN 3 ELSE 4 END) AS INT)] AS severity
    FROM (SELECT seq, abs(v_double - p) / ((ts_us - t) / 1e6) AS a, abs(v_double - p) AS d FROM (SELECT *, lag(v_double) OVER w AS p, lag(ts_us) OVER w AS t FROM samples WINDOW w AS (PARTITION BY log_id, signal ORDER BY ts_us, seq)) WHERE ts_us > t)"""))
def severity_angular(spark, sf):
    """The worse of the two severities of each step of a signal: by change per second and by change."""
    from wayline.operators.basic import by_time

    w = by_time(*SIGNAL)
    rows = A.samples(spark, sf).withColumns({"p": F.lag("v_double").over(w), "t": F.lag("ts_us").over(w)}).where("ts_us > t")
    step = F.abs(F.col("v_double") - F.col("p"))
    return rows.select("seq", R.severity_angular(step / ((F.col("ts_us") - F.col("t")) / 1e6), step).alias("severity"))
