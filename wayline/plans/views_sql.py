"""The adapter views as SQL for the oracle."""

from __future__ import annotations

_TIME = "CAST(floor((epoch_us(ts) - 1704067200000000) / 150000e0) AS BIGINT)"

VIEWS = {
    "samples": f"SELECT user_id // 12 AS log_id, event_type AS signal, {_TIME} AS ts_us, event_id AS seq, value AS v_double FROM events",
    "modes": f"""SELECT user_id // 12 AS log_id, {_TIME} AS ts_us, event_id AS seq,
        CAST(CASE WHEN event_id % 7 < 2 THEN 0 WHEN event_id % 7 = 2 THEN 3 WHEN event_id % 7 < 6 THEN 1 ELSE 5 END AS BIGINT) AS v_long
        FROM events WHERE event_type = 'signup'""",
    "mode_signals": f"""SELECT log_id, ts_us, seq, signal, type,
        CASE WHEN type = 'boolean' THEN CASE WHEN signal = 'DS:estop' THEN seq % 11 = 0 WHEN signal = 'DS:enabled' THEN seq % 7 < 5 ELSE seq % 2 = 0 END END AS v_bool,
        CAST(CASE WHEN type = 'int64' THEN CASE WHEN seq % 7 < 2 THEN 0 WHEN seq % 7 = 2 THEN 3 WHEN seq % 7 < 6 THEN 1 ELSE 5 END END AS BIGINT) AS v_long,
        CASE WHEN type = 'string' THEN ['Disabled', 'Autonomous', ' teleop', 'Test', 'odd'][seq % 5 + 1] END AS v_string
        FROM (SELECT *, CASE type WHEN 'boolean' THEN ['DS:enabled', 'DSAutonomous', 'DS:teleop', 'NT:/FMSInfo/Test', 'DS:estop'][seq // 3 % 5 + 1] WHEN 'int64' THEN 'NT:/FMSInfo/FMSControlData' ELSE 'RobotMode' END AS signal
          FROM (SELECT user_id // 12 AS log_id, {_TIME} AS ts_us, event_id AS seq,
            CASE user_id // 12 % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'int64' WHEN 2 THEN 'string' ELSE ['boolean', 'int64', 'string'][event_id % 3 + 1] END AS type FROM events WHERE event_type = 'signup'))""",
    "scheduler_names": f"""SELECT user_id // 12 AS log_id, {_TIME} AS ts_us, event_id AS seq,
        list_filter(['InstantCommand', 'Drive', 'RunCommand', 'Shoot', 'Aim'], lambda x, i: (event_id >> (i - 1)) % 2 = 1) AS names FROM events WHERE event_type = 'purchase'""",
    "console": f"""SELECT user_id // 12 AS log_id, {_TIME} AS ts_us, event_id AS seq,
        CASE event_type
          WHEN 'error' THEN 'Warning at IterativeRobotBase: Loop time of 0.02s overrun' || CASE WHEN event_id % 4 = 0 THEN chr(10) || '  robotPeriodic(): 0.031000s' || chr(10) || '  robotPeriodic(): 0.012000s' ELSE '' END
          WHEN 'click' THEN '  teleopPeriodic(): 0.' || lpad(CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), 6, '0') || 's'
          WHEN 'view' THEN '  robotPeriodic(): 0.' || lpad(CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), 6, '0') || 's' || chr(10)
                           || '  ' || ['Arm.periodic()', 'LiveWindow.updateValues()', 'SmartDashboard.updateValues()', 'Drive.execute()', 'Shoot.initialize()', 'teleopInit()'][event_id % 6 + 1] || ': 0.' || lpad(CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR), 6, '0') || 's'
          WHEN 'purchase' THEN 'CommandScheduler loop overrun'
          ELSE 'Command ' || CASE event_id % 3 WHEN 0 THEN 'initialized: ' WHEN 1 THEN 'finished: ' ELSE 'interrupted: ' END
               || CASE user_id % 4 WHEN 0 THEN 'InstantCommand' WHEN 1 THEN 'Drive' WHEN 2 THEN 'RunCommand' ELSE 'Shoot' END
        END AS text FROM events""",
    "odometry": """SELECT log_id, ts_us, seq, 8.27e0 + 6e0 * sin(ts_us / 5e6) AS x, 4.1e0 + 3e0 * cos(ts_us / 7e6) AS y,
        (ts_us % 36000000) / 1e5 - 180e0 AS theta_deg FROM samples WHERE signal IN ('click', 'view')""",
    "vision": """SELECT log_id, ts_us, seq, CASE seq % 3 WHEN 0 THEN 'cam-a' WHEN 1 THEN 'cam-b' ELSE 'cam-c' END AS camera,
        8.27e0 + 6e0 * sin(ts_us / 5e6) + (v_double - 50e0) / 200e0 AS x, 4.1e0 + 3e0 * cos(ts_us / 7e6) + (v_double - 50e0) / 400e0 AS y,
        (ts_us % 36000000) / 1e5 - 180e0 AS yaw_deg, 1 + seq % 4 AS tag_count, CAST(10 + seq % 30 AS DOUBLE) AS latency_ms
        FROM samples WHERE signal IN ('purchase', 'error')""",
    "frames": """SELECT o_orderkey AS frame_id, o_orderkey % 10 AS log_id,
        CASE o_custkey % 3 WHEN 0 THEN 'cam-a' WHEN 1 THEN 'cam-b' ELSE 'cam-c' END AS camera,
        epoch_us(o_orderdate) AS ts_us, o_totalprice AS residual_raw FROM orders""",
    "tags": """SELECT l_orderkey AS frame_id, l_linenumber AS n, 1 + l_partkey % 32 AS tag_id, 0.2e0 + l_quantity / 10e0 AS dist,
        l_discount * 8e0 AS ambiguity, l_tax AS area FROM lineitem""",
}
_NEEDS = {"odometry": ["samples"], "vision": ["samples"]}


def over(*names: str, sql: str, recursive: bool = False, **more: str) -> str:
    """A query over the named views; more are further common tables, in order."""
    wanted: list[str] = []
    for name in names:
        for x in [*_NEEDS.get(name, []), name]:
            if x not in wanted:
                wanted.append(x)
    tables = [f"{n} AS ({VIEWS[n]})" for n in wanted] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(tables)} {sql}"
