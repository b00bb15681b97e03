"""Telemetry views over the tables at hand: samples, modes, console, odometry, vision, frames, tags.

Every view is a projection of one table, so filters and column pruning reach its Parquet scan. Times are whole
microseconds; a log is twelve users, so logs grow in number with the tables and not in size; a signal is an event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TIME = "cast(floor((unix_micros(cast(ts as timestamp)) - 1704067200000000) / 150000D) as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, signal, ts_us, seq, v_double."""
    return table(spark, sf_dir, "events").selectExpr("user_id div 12 as log_id", "event_type as signal", f"{_TIME} as ts_us", "event_id as seq", "value as v_double")


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts_us, seq, v_long: control words."""
    word = "cast(case when event_id % 7 < 2 then 0 when event_id % 7 = 2 then 3 when event_id % 7 < 6 then 1 else 5 end as bigint)"
    return table(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr("user_id div 12 as log_id", f"{_TIME} as ts_us", "event_id as seq", f"{word} as v_long")


def mode_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts_us, seq, signal, type, v_bool, v_long, v_string: booleans in every fourth log, a control word, a mode's name, and all of them."""
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr("user_id div 12 as log_id", f"{_TIME} as ts_us", "event_id as seq")
    names = "array('DS:enabled', 'DSAutonomous', 'DS:teleop', 'NT:/FMSInfo/Test', 'DS:estop')"
    kind = "case log_id % 4 when 0 then 'boolean' when 1 then 'int64' when 2 then 'string' else element_at(array('boolean', 'int64', 'string'), cast(seq % 3 as int) + 1) end"
    rows = rows.selectExpr("*", f"{kind} as type").selectExpr("*", f"case type when 'boolean' then element_at({names}, cast(seq div 3 % 5 as int) + 1) when 'int64' then 'NT:/FMSInfo/FMSControlData' else 'RobotMode' end as signal")
    word = "case when seq % 7 < 2 then 0 when seq % 7 = 2 then 3 when seq % 7 < 6 then 1 else 5 end"
    return rows.selectExpr(
        "log_id", "ts_us", "seq", "signal", "type", "case when type = 'boolean' then case when signal = 'DS:estop' then seq % 11 = 0 when signal = 'DS:enabled' then seq % 7 < 5 else seq % 2 = 0 end end as v_bool",
        f"cast(case when type = 'int64' then {word} end as bigint) as v_long", "case when type = 'string' then element_at(array('Disabled', 'Autonomous', ' teleop', 'Test', 'odd'), cast(seq % 5 as int) + 1) end as v_string",
    )


def scheduler_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts_us, seq, names: the commands that run from then on."""
    names = "filter(array('InstantCommand', 'Drive', 'RunCommand', 'Shoot', 'Aim'), (x, i) -> (event_id div (cast(1 as bigint) << i)) % 2 = 1)"
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr("user_id div 12 as log_id", f"{_TIME} as ts_us", "event_id as seq", f"{names} as names")


def console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts_us, seq, text: console lines."""
    text = """
        case event_type
          when 'error' then concat('Warning at IterativeRobotBase: Loop time of 0.02s overrun', if(event_id % 4 = 0, concat(chr(10), '  robotPeriodic(): 0.031000s', chr(10), '  robotPeriodic(): 0.012000s'), ''))
          when 'click' then concat('  teleopPeriodic(): 0.', lpad(cast(cast(floor(value * 100) as bigint) as string), 6, '0'), 's')
          when 'view' then concat('  robotPeriodic(): 0.', lpad(cast(cast(floor(value * 100) as bigint) as string), 6, '0'), 's', chr(10),
                                  '  ', element_at(array('Arm.periodic()', 'LiveWindow.updateValues()', 'SmartDashboard.updateValues()', 'Drive.execute()', 'Shoot.initialize()', 'teleopInit()'), cast(event_id % 6 as int) + 1), ': 0.', lpad(cast(cast(floor(value * 10) as bigint) as string), 6, '0'), 's')
          when 'purchase' then 'CommandScheduler loop overrun'
          else concat('Command ', case event_id % 3 when 0 then 'initialized: ' when 1 then 'finished: ' else 'interrupted: ' end,
                      case user_id % 4 when 0 then 'InstantCommand' when 1 then 'Drive' when 2 then 'RunCommand' else 'Shoot' end)
        end"""
    return table(spark, sf_dir, "events").selectExpr("user_id div 12 as log_id", f"{_TIME} as ts_us", "event_id as seq", f"{text} as text")


def odometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts_us, seq, x, y, theta_deg: a smooth path."""
    return samples(spark, sf_dir).where("signal in ('click', 'view')").selectExpr(
        "log_id", "ts_us", "seq", "8.27D + 6D * sin(ts_us / 5e6D) as x", "4.1D + 3D * cos(ts_us / 7e6D) as y", "(ts_us % 36000000) / 1e5D - 180D as theta_deg"
    )


def vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts_us, seq, camera, x, y, yaw_deg, tag_count, latency_ms: noisy poses around the path."""
    return samples(spark, sf_dir).where("signal in ('purchase', 'error')").selectExpr(
        "log_id", "ts_us", "seq", "case seq % 3 when 0 then 'cam-a' when 1 then 'cam-b' else 'cam-c' end as camera",
        "8.27D + 6D * sin(ts_us / 5e6D) + (v_double - 50D) / 200D as x", "4.1D + 3D * cos(ts_us / 7e6D) + (v_double - 50D) / 400D as y",
        "(ts_us % 36000000) / 1e5D - 180D as yaw_deg", "1 + seq % 4 as tag_count", "cast(10 + seq % 30 as double) as latency_ms",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, log_id, camera, ts_us, residual_raw: one row per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as frame_id", "o_orderkey % 10 as log_id", "case o_custkey % 3 when 0 then 'cam-a' when 1 then 'cam-b' else 'cam-c' end as camera",
        "unix_micros(cast(o_orderdate as timestamp)) as ts_us", "o_totalprice as residual_raw",
    )


def tags(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """frame_id, n, tag_id, dist, ambiguity, area: one row per detection; with place also file and row, where it stands in the table."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as frame_id", "l_linenumber as n", "1 + l_partkey % 32 as tag_id", "0.2D + l_quantity / 10D as dist", "l_discount * 8D as ambiguity", "l_tax as area",
        *(["_metadata.file_path as file", "_metadata.row_index as row"] if place else []),
    )
