"""Match phases, power, control-loop overruns, impacts and launches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators import folds
from wayline.operators import kernel as K
from wayline.operators.basic import by_time

SHORT_US = 100_000
# What names of boolean mode signals look like, by mode, what a control word and a mode's name are called, and the modes that names say.
MODE_NAMES = {
    "autonomous": "(?i)(DS[:/]?auto|DSAutonomous|FMSInfo.*Auto)",
    "teleop": "(?i)(DS[:/]?teleop|FMSInfo.*Teleop)",
    "enabled": "(?i)^DS[:/]enabled$",
    "test": "(?i)(DS[:/]?test|FMSInfo.*Test)",
    "estop": "(?i)(DS[:/]?e-?stop|DSEStop)",
}
CONTROL_WORD = "(?i)FMSInfo/FMSControlData$"
ROBOT_MODE = "^RobotMode$"
MODES = {"autonomous": "auto", "teleop": "teleop", "test": "test"}
# Texts of epochs, overruns, commands and memory.
OVERRUN = "(?i)loop time of [0-9.]+s overrun"
EPOCH = r"(?m)^\s*(\S.*?):\s*([0-9]+\.[0-9]+)s\s*$"
COMMAND = r"Command (initialized|interrupted|finished):\s*(.+)"
# The names that commands have if nobody names them.
DEFAULT_COMMANDS = [
    "ConditionalCommand", "DeferredCommand", "FunctionalCommand", "InstantCommand", "MecanumControllerCommand", "NotifierCommand", "PIDCommand", "ParallelCommandGroup",
    "ParallelDeadlineGroup", "ParallelRaceGroup", "PrintCommand", "ProfiledPIDCommand", "ProxyCommand", "RamseteCommand", "RepeatCommand", "RunCommand", "ScheduleCommand",
    "SelectCommand", "SequentialCommandGroup", "StartEndCommand", "SwerveControllerCommand", "TrapezoidProfileCommand", "WaitCommand", "WaitUntilCommand", "WrapperCommand",
]
# Categories of what is said near an overrun, in the order they are tried.
NEARBY = {"datalog": "DataLog:", "can": r"CAN\b|CANbus|timeout|timed out", "nt": "NT:|NetworkTables|ntcore", "brownout": "brownout|brown-out|voltage", "warning": "Warning|Error"}
# Components of the framework, by name and by the beginning of the name, and the stages of the main loop.
PHASE_PERIODICS = ["autonomousPeriodic()", "teleopPeriodic()", "disabledPeriodic()", "testPeriodic()"]
FRAMEWORK = ["robotPeriodic", "LiveWindow.", "SmartDashboard.", "Shuffleboard."]
TOP_LEVEL = [
    "robotPeriodic()", "LiveWindow.updateValues()", "SmartDashboard.updateValues()", "Shuffleboard.update()", "autonomousPeriodic()", "teleopPeriodic()", "disabledPeriodic()", "testPeriodic()",
]
MEMORY = r"roboRIO:\s+Disk Free\s+(\d+)\s+MB,\s+Memory Free\s+(\d+)\s+MB"
# Parts of the names of signals that are published only while tags are seen.
TAG_NAMES = [
    "limelight-a/botpose", "limelight-b/botpose", "limelight-a/targetpose", "limelight-b/targetpose", "limelight-a/camerapose", "limelight-b/camerapose", "limelight-a/rawfiducials",
    "limelight-b/rawfiducials", "limelight-a/stddevs", "limelight-b/stddevs", "limelight-a/ta", "limelight-b/ta", "limelight-a/tv", "limelight-b/tv", "limelight-a/tx", "limelight-b/tx",
    "limelight-a/ty", "limelight-b/ty", "limelight-a/txnc", "limelight-b/txnc", "limelight-a/tync", "limelight-b/tync", "limelight-a/tid", "limelight-b/tid", "limelight-a/t2d", "limelight-b/t2d",
    "limelight-a/tc", "limelight-b/tc", "limelight-a/tl", "limelight-b/tl", "limelight-a/cl", "limelight-b/cl", "limelight-a/hb", "limelight-b/hb", "limelight-a/imu", "limelight-b/imu",
    "limelight-a/hw", "limelight-b/hw", "limelight-a/botpose_orb", "limelight-b/botpose_orb", "vision/rawFieldPose3d", "vision/fieldPose3d", "vision/compBot", "Field/RawVision", "_rejectReason",
    "_visionError", "_tagSpread", "Mt1 STD", "Mt2 STD", "_Num targets", "_Last timestamp", "_time since last",
]
# Limits of hard, moderate and light hits, by degrees/s2 and by degrees/s within the window.
ANGULAR = {"hard": (4000.0, 150.0), "moderate": (2500.0, 100.0), "light": (1500.0, 50.0)}


def control_word_phase(word: Column) -> Column:
    """Bits: 1 enabled, 2 autonomous, 4 test, 8 emergency stop."""
    bit = lambda b: word.bitwiseAND(b) != 0
    return F.when(bit(8) | ~bit(1), "disabled").when(bit(2), "auto").when(bit(4), "test").otherwise("teleop")


def mode_states(signals: DataFrame) -> DataFrame:
    """Rows (log_id, ts_us, phase): a log's mode after each moment at which one of its mode signals has a value.

    signals has log_id, ts_us, seq, signal, type and v_bool, v_long or v_string. A log's boolean signals count if it has
    any: for each mode the first, in the order of their first values, whose name fits; then the control word; then the
    mode's name. Of several values of a signal at one moment the last by seq counts, null values don't. Emergency stop
    comes before all; then, if there is a signal for it, not being enabled; then auto, teleop, test, and being enabled alone
    means teleop.
    """
    named = signals.groupBy("log_id", "signal", "type").agg(F.min(F.struct("ts_us", "seq")).alias("first"))
    wanted = [(m, "boolean", p) for m, p in MODE_NAMES.items()] + [("word", "int64", CONTROL_WORD), ("mode", "string", ROBOT_MODE)]
    fits = F.array_compact(F.array(*[F.when((F.col("type") == kind) & F.col("signal").rlike(pattern), F.lit(role)) for role, kind, pattern in wanted]))
    chosen = named.withColumn("role", F.explode(fits)).groupBy("log_id", "role").agg(F.min_by(F.struct("signal", "type"), F.struct("first", "signal")).alias("s")).select("log_id", "role", "s.signal", "s.type")
    source = F.when(F.col("role").isin("word", "mode"), F.col("role")).otherwise("flags")
    rank = F.when(source == "flags", 1).when(source == "word", 2).otherwise(3)
    best = chosen.groupBy("log_id").agg(F.min(rank).alias("best"), F.bool_or(F.col("role") == "enabled").alias("has_enabled"))  # one row for each log
    roles = chosen.join(best, "log_id").where(rank == F.col("best")).drop("best")
    said, by_name = F.lower(F.trim("v_string")), F.lit("disabled")
    for key, phase in MODES.items():
        by_name = F.when(said == key, phase).otherwise(by_name)
    told = F.when(F.col("role") == "word", F.when(F.col("v_long").isNotNull(), control_word_phase(F.col("v_long")))).when(F.col("role") == "mode", F.when(F.col("v_string").isNotNull(), by_name)).otherwise(F.col("v_bool").cast("string"))
    rows = signals.join(roles, ["log_id", "signal", "type"]).withColumn("told", told).where("told is not null").select("log_id", "ts_us", "seq", "role", "told", "has_enabled")
    order = Window.partitionBy("log_id").orderBy("ts_us", "seq", "role")
    held = {f"is_{m}": F.coalesce(F.last(F.when(F.col("role") == m, F.col("told")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("false")) == "true" for m in MODE_NAMES}
    rows = rows.withColumns({**held, "next_us": F.lead("ts_us").over(order)}).where("next_us is null or next_us > ts_us")
    by_flags = (
        F.when(F.col("is_estop") | (F.col("has_enabled") & ~F.col("is_enabled")), "disabled").when(F.col("is_autonomous"), "auto").when(F.col("is_teleop"), "teleop").when(F.col("is_test"), "test")
        .when(F.col("is_enabled"), "teleop").otherwise("disabled")
    )
    return rows.select("log_id", "ts_us", F.when(F.col("role").isin("word", "mode"), F.col("told")).otherwise(by_flags).alias("phase"))


def timeline(states: DataFrame, ranges: DataFrame) -> DataFrame:
    """Half-open intervals (log_id, idx, phase, start_us, end_us) of logs with states (log_id, ts_us, phase), one a moment.

    ranges has first_us and last_us of each log; until its first state a log is disabled. Intervals under 100 ms go to the
    one before, but for a disabled gap between auto and teleop; a log that has no longer one is disabled throughout. A log
    whose samples are all of one moment has no interval.
    """
    none = F.lit(None).cast("bigint")
    begin = ranges.select("log_id", F.col("first_us").alias("ts_us"), F.lit("disabled").alias("phase"), F.lit(0).alias("seq"), "first_us", "last_us")
    log, order = Window.partitionBy("log_id"), Window.partitionBy("log_id").orderBy("ts_us", "seq")
    rows = states.select("log_id", "ts_us", "phase", F.lit(1).alias("seq"), none.alias("first_us"), none.alias("last_us")).unionByName(begin)
    rows = rows.withColumns({"known": F.max("seq").over(log), "first_us": F.max("first_us").over(log), "last_us": F.max("last_us").over(log), "was": F.lag("phase").over(order)}).where("known = 1 and (was is null or was <> phase)")
    rows = rows.withColumn("end_us", F.coalesce(F.lead("ts_us").over(order), F.col("last_us"))).where("end_us > ts_us")
    gap = (F.col("phase") == "disabled") & (F.lag("phase").over(order) == "auto") & (F.lead("phase").over(order) == "teleop")
    rows = rows.withColumn("keep", (F.col("end_us") - F.col("ts_us") >= SHORT_US) | F.coalesce(gap, F.lit(False))).withColumns({"any": F.max("keep").over(log), "nr": F.row_number().over(order)})
    rows = rows.where("keep or (not any and nr = 1)").withColumns({"phase": F.when(F.col("any"), F.col("phase")).otherwise("disabled"), "start_us": F.when(F.col("any"), F.col("ts_us")).otherwise(F.col("first_us"))})
    return rows.select("log_id", F.row_number().over(order).alias("idx"), "phase", "start_us", F.coalesce(F.lead("start_us").over(order), F.col("last_us")).alias("end_us"))


def match_phases(modes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The timeline of control words (log_id, ts_us, seq, v_long); of several words at one microsecond the last counts."""
    states = modes.groupBy("log_id", "ts_us").agg(F.max_by("v_long", "seq").alias("w"))
    return timeline(states.select("log_id", "ts_us", control_word_phase(F.col("w")).alias("phase")), ranges)


def match_flags(phases: DataFrame) -> DataFrame:
    """Per log: whether it has a match (auto and teleop), looks cut off (under two minutes enabled), looks like the second half of one (its first enabled phase is teleop and it has no match), and the first auto and teleop."""
    is_ = lambda p: F.col("phase") == p
    enabled = F.when(~is_("disabled"), F.col("end_us") - F.col("start_us")).otherwise(0)
    first = lambda p: F.min(F.when(is_(p), F.struct("start_us", "end_us")))
    found = phases.groupBy("log_id").agg(
        (F.bool_or(is_("auto")) & F.bool_or(is_("teleop"))).alias("has_match"), (F.sum(enabled) < 120_000_000).alias("truncated"), F.min_by(F.when(~is_("disabled"), F.col("phase")), F.when(~is_("disabled"), F.col("start_us"))).alias("began"),
        first("auto").alias("a"), first("teleop").alias("t"),
    )
    return found.select(
        "log_id", "has_match", "truncated", F.coalesce((F.col("began") == "teleop") & ~F.col("has_match"), F.lit(False)).alias("post_reboot"),
        F.col("a.start_us").alias("first_auto_us"), F.col("a.end_us").alias("first_auto_end_us"), F.col("t.start_us").alias("first_teleop_us"), F.col("t.end_us").alias("first_teleop_end_us"),
    )


def phase_of(rows: DataFrame, phases: DataFrame) -> DataFrame:
    """Adds the phase of the interval that holds each row, disabled outside all of them: an as-of join on interval starts."""
    starts = phases.select("log_id", F.col("start_us").alias("ts_us"), F.col("start_us").alias("seq"), "phase", "end_us")
    found = K.asof_backward(rows, starts, ["log_id"], ["phase", "end_us"])
    return found.withColumn("phase", F.when(F.col("ts_us") < F.col("end_us"), F.col("phase")).otherwise("disabled")).drop("end_us")


def channel_power(samples: DataFrame, volts: str, channels: list[str]) -> DataFrame:
    """Every channel sample in watts: amps times the volts as of then (the first volts before any)."""
    amps = samples.where(F.col("signal").isin(channels))
    source = samples.where(F.col("signal") == volts).select("log_id", "ts_us", "seq", F.col("v_double").alias("volts"))
    return K.asof_backward(amps, source, ["log_id"], ["volts"], clamp=True).withColumn("watts", F.col("v_double") * F.col("volts"))


def overrun_messages(console: DataFrame, window_us: int = 500_000) -> DataFrame:
    """Console lines of overrun events: event numbers an anchor and the lines up to half a second after it, until the next anchor."""
    order = by_time("log_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = console.withColumn("anchor", F.col("text").rlike(OVERRUN).cast("int")).withColumn("event", F.sum("anchor").over(order))
    rows = rows.withColumn("event_us", F.last(F.when(F.col("anchor") == 1, F.col("ts_us")), ignorenulls=True).over(order))
    return rows.where((F.col("event") > 0) & (F.col("ts_us") - F.col("event_us") <= window_us))


def epochs(messages: DataFrame) -> DataFrame:
    """Rows (log_id, event, event_us, component, seconds): the last time that the overrun's own text gives a component, or a larger one of the lines after it."""
    names, times = (F.regexp_extract_all("text", F.lit(EPOCH), F.lit(i)) for i in (1, 2))
    rows = messages.select("log_id", "event", "event_us", "anchor", F.posexplode(F.arrays_zip(names.alias("name"), times.alias("s"))).alias("place", "e"))
    seconds, own = F.col("e.s").cast("double"), F.col("anchor") == 1
    last = F.max(F.when(own, F.struct("place", seconds.alias("s"))))["s"]
    return rows.groupBy("log_id", "event", "event_us", F.col("e.name").alias("component")).agg(F.greatest(last, F.max(F.when(~own, seconds))).alias("seconds"))


def overrun_events(console: DataFrame) -> DataFrame:
    """One row per overrun: its time, scheduler markers, components and the sum of their times (nested ones count twice)."""
    messages = overrun_messages(console)
    totals = epochs(messages).groupBy("log_id", "event").agg(F.round(F.sum("seconds"), 6).alias("total_s"), F.count("*").alias("components"))
    heads = messages.groupBy("log_id", "event", "event_us").agg(F.count_if(F.col("text") == "CommandScheduler loop overrun").alias("scheduler"))
    joined = heads.join(totals, ["log_id", "event"], "left")
    return joined.withColumns({"total_s": F.coalesce("total_s", F.lit(0.0)), "components": F.coalesce("components", F.lit(0))})


def categorise(component: Column) -> Column:
    """phase_init, framework, subsystem, command or other, by a component's name; the first rule that fits."""
    framework = component.isin(PHASE_PERIODICS) | component.rlike("^(" + "|".join(p.replace(".", r"\.") for p in FRAMEWORK) + ")")
    return (
        F.when(component.endswith("Init()") | component.endswith("Init"), "phase_init").when(framework, "framework").when(component.endswith(".periodic()"), "subsystem")
        .when(component.endswith(".execute()") | component.endswith(".initialize()"), "command").otherwise("other")
    )


def is_top_level(component: Column) -> Column:
    """Whether a component is a stage of the main loop, which holds the others."""
    return component.isin(TOP_LEVEL) | (categorise(component) == "phase_init")


def commands(console: DataFrame) -> DataFrame:
    """Command lines: kind and name; the cause of an interruption isn't part of the name."""
    name = F.regexp_extract("text", COMMAND, 2)
    rows = console.withColumn("kind", F.regexp_extract("text", COMMAND, 1))
    rows = rows.withColumn("name", F.when(F.col("kind") == "interrupted", F.regexp_replace(name, r";\s*Cause:.*$", "")).otherwise(name))
    return rows.where("kind <> ''").drop("text")


def running_commands(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A row (events' columns, name) for each command that runs at an event (log_id, ts_us, seq): those of the last snapshot (names) at or before it."""
    return K.asof_backward(events, snapshots, ["log_id"], ["names"]).withColumn("name", F.explode("names")).drop("names")


def command_correlation(events: DataFrame, snapshots: DataFrame, timings: DataFrame) -> DataFrame:
    """Per log and command: overruns while it ran, their median, mean and largest time, the mean of its own .execute() epoch, whether nobody named it.

    events has log_id, ts_us, seq and total_s, timings (epochs) log_id, component and seconds.
    """
    rows = running_commands(events, snapshots).withColumn("ms", F.col("total_s") * 1000)
    per = rows.groupBy("log_id", "name").agg(F.count("*").alias("overruns"), F.percentile("ms", F.lit(0.5)).alias("median_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))
    own = timings.where(F.col("component").endswith(".execute()")).groupBy("log_id", F.regexp_replace("component", r"\.execute\(\)$", "").alias("name")).agg(F.avg(F.col("seconds") * 1000).alias("execute_ms"))
    return per.join(own, ["log_id", "name"], "left").withColumn("unnamed", F.col("name").isin(DEFAULT_COMMANDS))


def classify_nearby(text: Column) -> Column:
    """The first category that a console line belongs to, null if none."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(NEARBY.items()):
        found = F.when(text.rlike(f"(?i){pattern}"), kind).otherwise(found)
    return found


# Which of two equally near events comes first.
NEARBY_ORDER = {"datalog": 0, "can": 1, "brownout": 1, "command": 2, "nt": 3, "warning": 4, "other": 5}


def nearby_events(events: DataFrame, console: DataFrame, commands_: DataFrame, reach_us: int = 1_000_000) -> DataFrame:
    """What is said and which commands change within a second and an overrun's own length around it: log_id, event, near_seq, category, offset_us, place.

    events has log_id, event, event_us and total_s. Overruns, epochs and scheduler markers themselves don't count. Events
    come by distance, of equally far ones by category. Time is cut into buckets of reach_us, which a wider window visits more of.
    """
    own = F.col("text").rlike(OVERRUN) | F.col("text").rlike(EPOCH) | (F.col("text") == "CommandScheduler loop overrun")
    said = console.where(~own).select("log_id", "ts_us", F.col("seq").alias("near_seq"), F.coalesce(classify_nearby(F.col("text")), F.lit("other")).alias("category"))
    right = said.unionByName(commands_.select("log_id", "ts_us", F.col("seq").alias("near_seq"), F.lit("command").alias("category"))).withColumn("bucket", F.floor(F.col("ts_us") / reach_us))
    width = F.floor((reach_us / 1e6 + F.col("total_s")) * 1e6).cast("bigint")
    left = events.select("log_id", "event", "event_us", width.alias("width"))
    left = left.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("event_us") - F.col("width")) / reach_us), F.floor((F.col("event_us") + F.col("width")) / reach_us))))
    rows = left.join(right, ["log_id", "bucket"]).withColumn("offset_us", F.col("ts_us") - F.col("event_us")).where("abs(offset_us) <= width")
    rank = F.lit(9)
    for category, place in NEARBY_ORDER.items():
        rank = F.when(F.col("category") == category, place).otherwise(rank)
    order = Window.partitionBy("log_id", "event").orderBy(F.abs("offset_us"), rank, "near_seq")
    return rows.select("log_id", "event", "near_seq", "category", "offset_us", F.row_number().over(order).alias("place"))


def memory_report(text: Column) -> Column:
    """struct(disk_mb, memory_mb) of a memory message, nulls for other texts."""
    return F.struct(*[F.regexp_extract(text, MEMORY, i).try_cast("bigint").alias(n) for i, n in ((1, "disk_mb"), (2, "memory_mb"))])


def is_tag_dependent(name: Column) -> Column:
    """Whether a signal's name says that it depends on tags being seen."""
    return name.rlike("|".join(TAG_NAMES))


def severity_angular(alpha: Column, step: Column) -> Column:
    """hard, moderate or light, the worse by either measure, null below both."""
    found = F.lit(None).cast("string")
    for name, (a, b) in reversed(ANGULAR.items()):
        found = F.when((alpha >= a) | (step >= b), name).otherwise(found)
    return found


def impacts(axes: DataFrame, light: float, moderate: float, hard: float, group_us: int = 300_000, fall: float = 0.3, lateral: float = 0.5, spin: float = 50.0) -> DataFrame:
    """Hits (log_id, ts_us, seq, score, severity, kind, lateral, freefall) from three axes (ax, ay, az) and omega: |magnitude - 1| of at least light, the largest of each group.

    A landing follows a fall (a magnitude under fall in the 200 ms before) and is mostly upright; other hits are
    collisions, spinning where omega, 0 if unknown, is over spin, head-on otherwise.
    """
    rows = axes.withColumn("mag", F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)).withColumn("impact", F.abs(F.col("mag") - 1))
    before = Window.partitionBy("log_id").orderBy("ts_us").rangeBetween(-200_000, -1)
    share = F.when(F.col("mag") > 0, F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2) / F.col("mag")).otherwise(0.0)
    rows = rows.withColumns({"freefall": F.coalesce(F.min("mag").over(before) < fall, F.lit(False)), "lateral": share}).where(F.col("impact") >= light)
    best = K.peak_groups(rows, ["log_id"], group_us, "impact")
    found = best.join(rows.select("log_id", "seq", "freefall", "lateral", "omega"), ["log_id", "seq"])
    severity = F.when(F.col("score") >= hard, "hard").when(F.col("score") >= moderate, "moderate").otherwise("light")
    kind = F.when(F.col("freefall") & (F.col("lateral") < lateral), "landing").when(F.abs(F.coalesce("omega", F.lit(0.0))) > spin, "collision_spinning").otherwise("collision_head_on")
    return found.select("log_id", "ts_us", "seq", "score", severity.alias("severity"), kind.alias("kind"), "lateral", "freefall")


def closed_phase_of(rows: DataFrame, phases: DataFrame) -> DataFrame:
    """Adds phase and phase_us, its start, of the first interval that holds each row, ends included; disabled and null outside all."""
    p = phases.select("log_id", F.col("start_us").alias("ts_us"), F.col("start_us").alias("seq"), "phase", "end_us", F.col("start_us").alias("phase_us"))
    before = K.asof_backward(rows, p, ["log_id"], ["phase", "end_us", "phase_us"], strict=True)
    found = before.join(p.select("log_id", "ts_us", F.col("phase").alias("own")), ["log_id", "ts_us"], "left")
    inside = F.coalesce(F.col("ts_us") <= F.col("end_us"), F.lit(False))
    return found.withColumns({"phase": F.when(inside, F.col("phase")).otherwise(F.coalesce("own", F.lit("disabled"))), "phase_us": F.when(inside, F.col("phase_us")).when(F.col("own").isNotNull(), F.col("ts_us"))}).drop("own", "end_us")


def hits_in_match(hits: DataFrame, phases: DataFrame) -> DataFrame:
    """Hits with their phase, the seconds since it began and those since the match did (auto, or else the first enabled phase), null outside and before."""
    on = F.col("phase") != "disabled"
    begun = phases.groupBy("log_id").agg(F.coalesce(F.min(F.when(F.col("phase") == "auto", F.col("start_us"))), F.min(F.when(on, F.col("start_us")))).alias("match_us"))
    rows = closed_phase_of(hits, phases).join(begun, "log_id", "left")
    since = lambda c: (F.col("ts_us") - F.col(c)) / 1e6
    return rows.withColumns({"match_s": F.when(F.col("ts_us") >= F.col("match_us"), since("match_us")), "phase_s": since("phase_us")}).drop("match_us", "phase_us")


def axis_accel(x: DataFrame, y: DataFrame, z: DataFrame, gravity: list[DataFrame] | None = None, least: int = 10) -> DataFrame:
    """Rows (log_id, ts_us, ax, ay, az, gx, gy, gz) in m/s2 from axes in g with columns log_id, ts_us, v, one value a time.

    Times are those that all three axes have; a log needs so many values of x. Gravity counts in logs that have as many
    values of its first axis, missing ones as 0; elsewhere it points down.
    """
    of = lambda frame, name: frame.select("log_id", "ts_us", F.col("v").alias(name))
    enough = lambda frame: frame.groupBy("log_id").count().where(F.col("count") >= least).select("log_id")
    rows = of(x, "ax").join(enough(x), "log_id", "left_semi").join(of(y, "ay"), ["log_id", "ts_us"]).join(of(z, "az"), ["log_id", "ts_us"])
    names = ("gx", "gy", "gz")
    if gravity:
        rows = rows.join(enough(gravity[0]).withColumn("own", F.lit(True)), "log_id", "left")
        for frame, name in zip(gravity, names):
            rows = rows.join(of(frame, name), ["log_id", "ts_us"], "left")
    else:
        rows = rows.withColumns({n: F.lit(None).cast("double") for n in names} | {"own": F.lit(None).cast("boolean")})
    usual = {"gx": 0.0, "gy": 0.0, "gz": -1.0}
    scaled = [(F.col(c) * 9.81).alias(c) for c in ("ax", "ay", "az")]
    down = [(F.when(F.col("own"), F.coalesce(n, F.lit(0.0))).otherwise(usual[n]) * 9.81).alias(n) for n in names]
    return rows.select("log_id", "ts_us", *scaled, *down)


def path_accel(path: DataFrame, reach: int = 5) -> DataFrame:
    """Size of the acceleration along a path (log_id, ts_us, seq, path): second differences over so many rows to either side, each axis cut to 30."""
    w = by_time("log_id")
    before, after = (lambda c: F.lag(c, reach).over(w)), (lambda c: F.lead(c, reach).over(w))
    rows = path.withColumns({f"{c}{i}": f(c) for c in ("ts_us", "x", "y") for i, f in ((0, before), (2, after))}).where("ts_us0 is not null and ts_us2 is not null")
    t0, t, t2 = (F.col(c) for c in ("ts_us0", "ts_us", "ts_us2"))
    usable = (t2 - t0 > 2000) & (t2 > t) & (t > t0)

    def axis(c: str) -> Column:
        a = ((F.col(f"{c}2") - F.col(c)) / ((t2 - t) / 1e6) - (F.col(c) - F.col(f"{c}0")) / ((t - t0) / 1e6)) / ((t2 - t0) / 2e6)
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.when(usable, a).otherwise(0.0)))

    return rows.select("log_id", "ts_us", "seq", F.sqrt(F.pow(axis("x"), F.lit(2.0)) + F.pow(axis("y"), F.lit(2.0))).alias("path"))


def accel_events(imu: DataFrame, path: DataFrame) -> DataFrame:
    """Events (log_id, kind, start_us, end_us, n, peak) where an inertial unit and the path disagree, from imu (log_id, ts_us, seq, accel, gravity).

    airborne: gravity, as a part of the usual, under .3 for 20 ms or more (peak is its least, negative); skid: accelerations
    apart by over 4 for 100 ms or more, impact: each sample apart by over 15. The path counts as of at most 50 ms before.
    """
    rows = K.asof_backward(imu, path, ["log_id"], ["path"], time="path_us")
    rows = rows.withColumn("residual", F.when(F.col("ts_us") - F.col("path_us") <= 50_000, F.abs(F.col("accel") - F.col("path"))))
    air = K.threshold_runs(rows.withColumn("up", -F.col("gravity")), ["log_id"], F.col("gravity") < 0.3, "up", 20_000).withColumn("kind", F.lit("airborne"))
    known = rows.where("residual is not null")
    skid = K.threshold_runs(known, ["log_id"], F.col("residual") > 4, "residual", 100_000).withColumn("kind", F.lit("skid"))
    hit = known.where("residual > 15").select("log_id", F.col("ts_us").alias("start_us"), F.col("ts_us").alias("end_us"), F.lit(1).cast("bigint").alias("n"), F.col("residual").alias("peak"), F.lit("impact").alias("kind"))
    return air.unionByName(skid).unionByName(hit)


def accel_sources(samples: DataFrame, least: int = 10) -> DataFrame:
    """Sources of acceleration per log: cameras with an inertial unit, and devices with all three axes; n, rate_hz by the first axis."""
    w = by_time("log_id", "signal")
    camera, device = F.regexp_extract("signal", r"([^/]+)/imu$", 1), F.regexp_extract("signal", r"Phoenix6/(Pigeon2-\d+)/Acceleration[XYZ]$", 1)
    axis = F.regexp_extract("signal", r"Acceleration([XYZ])$", 1)
    rows = samples.withColumns({"gap": F.col("ts_us") - F.lag("ts_us").over(w), "kind": F.when(camera != "", "camera").when(device != "", "device"), "source": F.when(camera != "", camera).otherwise(device), "axis": axis})
    lead = F.col("axis").isin("X", "")
    found = rows.where("kind is not null").groupBy("log_id", "source", "kind").agg(
        F.count_if(lead).alias("n"), (1e6 / F.median(F.when(lead, F.col("gap")))).alias("rate_hz"), F.countDistinct("axis").alias("axes")
    )
    return found.where((F.col("n") >= least) & ((F.col("kind") == "camera") | (F.col("axes") == 3))).drop("axes")


def lookback(rows: DataFrame, keys: list[str], value: str, window_us: int, name: str) -> DataFrame:
    """Adds name_v and name_us: the last row at least window_us old, else the first row."""
    times = Window.partitionBy(*keys).orderBy("ts_us")
    old = F.max(F.struct("ts_us", "seq", value)).over(times.rangeBetween(Window.unboundedPreceding, -window_us))
    first = F.first(F.struct("ts_us", "seq", value)).over(by_time(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_o", F.coalesce(old, first))
    return rows.withColumns({f"{name}_v": F.col(f"_o.{value}"), f"{name}_us": F.col("_o.ts_us")}).drop("_o")


def rotational_hits(samples: DataFrame, alpha: float, step: float, group_us: int = 300_000) -> DataFrame:
    """Hits from one rate signal: change per second over 20 ms or change over 50 ms beyond a limit; the larger is the score."""
    rows = lookback(lookback(samples, ["log_id", "signal"], "v_double", 20_000, "a"), ["log_id", "signal"], "v_double", 50_000, "b")
    dt_a, dt_b = (F.col("ts_us") - F.col("a_us")) / 1e6, (F.col("ts_us") - F.col("b_us")) / 1e6
    rows = rows.withColumn("alpha", F.when(dt_a > 0.005, F.abs((F.col("v_double") - F.col("a_v")) / dt_a)).otherwise(0.0))
    rows = rows.withColumn("jump", F.when(dt_b > 0.02, F.abs(F.col("v_double") - F.col("b_v"))).otherwise(0.0))
    found = rows.where((F.col("alpha") >= alpha) | (F.col("jump") >= step)).withColumn("score", F.greatest("alpha", "jump"))
    return K.peak_groups(found, ["log_id", "signal"], group_us, "score")


def launches(samples: DataFrame, at_speed: float = 55.0, drop: float = 8.0, floor: float = 30.0, recovery: float = 5.0, debounce_us: int = 80_000, window: int = 5) -> DataFrame:
    """Velocity dips (keys, ts_us, dip, baseline): a drop below the recent maximum and a recovery.

    The gate is native: it opens at speed, closes under the floor, and its opening row does nothing. A fold over the rows
    at speed finds the dips and keeps those far enough from the last one kept.
    """
    keys = ["log_id", "signal"]
    order = by_time(*keys)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("top", F.max("v_double").over(order.rowsBetween(-window, 0)))
    rows = rows.withColumn("base", F.coalesce(F.lag("top", 2).over(order), F.first("top").over(upto)))
    opens = (F.col("v_double") >= at_speed) & (F.col("i") > 1)
    rows = rows.withColumn("gate", F.coalesce(F.last(F.when(opens, 1).when(F.col("v_double") < floor, 0), ignorenulls=True).over(upto), F.lit(0)))
    rows = rows.withColumn("was", F.coalesce(F.lag("gate").over(order), F.lit(0)))
    rows = rows.withColumn("episode", F.sum(F.when((F.col("gate") == 1) & (F.col("was") == 0), 1).otherwise(0)).over(upto))
    rows = rows.where("n >= 3 and gate = 1 and was = 1")
    return folds.launch_dips(rows, keys, at_speed, drop, recovery, debounce_us)


def slip_filters(
    rows: DataFrame, enter: float, leave: float, fast_enter: float, fast_leave: float, fixed: float = 0.8, slow: float = 0.9, fast: float = 0.4, cap: float = 5.0, least_s: float = 0.002, most_s: float = 0.1
) -> DataFrame:
    """Slip between pose and wheels, smoothed by one weight (slip_fixed) and by two (slip, fast), from log_id, ts_us, seq, x, y, wx, wy.

    A hysteresis on wheel speed gates the update. The weight of the second filter turns fast where the raw slip exceeds
    fast_enter and back where it falls to fast_leave; its result is cut to cap. A step in time outside (least_s, most_s)
    sets both back to nothing.
    """
    order = by_time("log_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    dt = (F.col("ts_us") - F.lag("ts_us").over(order)) / 1e6
    rows = rows.withColumns({"wheel": F.sqrt(F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy")), "dt": dt, "dx": F.col("x") - F.lag("x").over(order), "dy": F.col("y") - F.lag("y").over(order)})
    speed = lambda d: F.when(F.col("dt") > 0.001, F.col(d) / F.col("dt")).otherwise(0.0)
    rows = rows.withColumns({"valid": F.coalesce((F.col("dt") > least_s) & (F.col("dt") < most_s), F.lit(False)), "rx": speed("dx") - F.col("wx"), "ry": speed("dy") - F.col("wy")})
    gate = F.coalesce(F.last(F.when(F.col("wheel") > enter, 1).when(F.col("wheel") <= leave, 0), ignorenulls=True).over(upto), F.lit(0))
    rows = rows.withColumn("gate", gate)
    rows = rows.withColumn("raw", F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry")))
    return folds.slip(rows, ["log_id"], fast_enter, fast_leave, fixed, slow, fast, cap)
