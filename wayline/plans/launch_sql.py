"""SQL twins of the folds behind launches, dips, rotational hits and slip filters: recursive tables that step from row to row."""

from __future__ import annotations

_W = "PARTITION BY log_id, signal ORDER BY ts_us, seq"

LAUNCHES = {
    "hw": f"""SELECT log_id, signal, ts_us, seq, v_double AS v, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY log_id, signal) AS n,
        max(v_double) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS top FROM samples""",
    "hb": f"SELECT *, coalesce(lag(top, 2) OVER ({_W}), first_value(top) OVER ({_W})) AS base FROM hw",
    "fa": """SELECT log_id, signal, i, n, FALSE AS on_, CAST(NULL AS DOUBLE) AS low, CAST(0 AS BIGINT) AS at_us, CAST(0 AS BIGINT) AS at_seq, 0e0 AS b, FALSE AS emit, CAST(NULL AS DOUBLE) AS dip FROM hb WHERE i = 1
        UNION ALL SELECT log_id, signal, i, n, g,
          CASE WHEN NOT (g AND was) THEN NULL WHEN low IS NULL THEN CASE WHEN base >= 40 AND base - v >= 8 THEN v END WHEN v - least(low, v) >= 5 THEN NULL ELSE least(low, v) END,
          CASE WHEN g AND was AND (low IS NULL OR v < low) THEN ts_us ELSE at_us END, CASE WHEN g AND was AND (low IS NULL OR v < low) THEN seq ELSE at_seq END,
          CASE WHEN low IS NULL THEN base ELSE b END, g AND was AND low IS NOT NULL AND v - least(low, v) >= 5, least(low, v)
        FROM (SELECT h.*, f.at_us, f.at_seq, f.b, f.on_ AS was, CASE WHEN f.on_ THEN f.low END AS low, CASE WHEN h.v >= 40 THEN TRUE WHEN h.v < 10 THEN FALSE ELSE f.on_ END AS g
              FROM fa f JOIN hb h ON h.log_id = f.log_id AND h.signal = f.signal AND h.i = f.i + 1)""",
    "dk": f"""SELECT *, row_number() OVER ({_W}) AS j FROM (SELECT log_id, signal, at_us AS ts_us, at_seq AS seq, dip, b AS baseline FROM fa WHERE emit AND n >= 3 AND at_us >= 80000)""",
    "fd": """SELECT log_id, signal, j, ts_us AS last, TRUE AS kept FROM dk WHERE j = 1
        UNION ALL SELECT k.log_id, k.signal, k.j, CASE WHEN k.ts_us - f.last > 79999 THEN k.ts_us ELSE f.last END, k.ts_us - f.last > 79999 FROM fd f JOIN dk k ON k.log_id = f.log_id AND k.signal = f.signal AND k.j = f.j + 1""",
    "le": "SELECT d.log_id, d.signal, d.ts_us, d.seq, d.dip, d.baseline FROM dk d JOIN fd f ON d.log_id = f.log_id AND d.signal = f.signal AND d.j = f.j WHERE f.kept",
    "near": "SELECT l.log_id, l.signal, l.ts_us, l.dip, l.baseline, s.ts_us AS r_ts_us, s.v_double FROM le l JOIN samples s ON l.log_id = s.log_id AND l.signal = s.signal AND s.ts_us BETWEEN l.ts_us - 300000 AND l.ts_us + 1500000",
}

THROUGHPUT = {
    "lo": f"""SELECT s.*, s.v_double < .8e0 * avg(abs(s.v_double)) OVER (PARTITION BY s.log_id, s.signal ORDER BY s.ts_us, s.seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AND s.v_double > .2e0 * p.p95 AS low
        FROM samples s JOIN (SELECT log_id, signal, quantile_cont(v_double, .95) AS p95 FROM samples GROUP BY ALL) p ON s.log_id = p.log_id AND s.signal = p.signal""",
    "hi": f"SELECT *, row_number() OVER ({_W}) AS i FROM (SELECT *, lag(low) OVER ({_W}) AS was FROM lo) WHERE low AND was = FALSE",
    "ft": """SELECT log_id, signal, i, ts_us, seq, ts_us AS last, TRUE AS kept FROM hi WHERE i = 1
        UNION ALL SELECT h.log_id, h.signal, h.i, h.ts_us, h.seq, CASE WHEN h.ts_us - f.last > 150000 THEN h.ts_us ELSE f.last END, h.ts_us - f.last > 150000 FROM ft f JOIN hi h ON h.log_id = f.log_id AND h.signal = f.signal AND h.i = f.i + 1""",
}

DIPS = {
    "sd": f"""SELECT *, lag(v_double) OVER ({_W}) AS was_v, sum(nw) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS session, row_number() OVER ({_W}) AS i
        FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER ({_W}) <= 100000 THEN 0 ELSE 1 END AS nw FROM samples)""",
    "fe": """SELECT log_id, signal, i, session, CAST(NULL AS BIGINT) AS start_us, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS top, CAST(NULL AS BIGINT) AS e_start, CAST(NULL AS BIGINT) AS e_end, CAST(NULL AS DOUBLE) AS e_low, CAST(NULL AS DOUBLE) AS e_top FROM sd WHERE i = 1
        UNION ALL SELECT log_id, signal, i, session,
          CASE WHEN start_us IS NULL THEN CASE WHEN was_v - v_double > 20 THEN ts_us END WHEN v_double - least(low, v_double) > 20 THEN NULL ELSE start_us END,
          CASE WHEN start_us IS NULL THEN CASE WHEN was_v - v_double > 20 THEN v_double END WHEN v_double - least(low, v_double) > 20 THEN NULL ELSE least(low, v_double) END,
          CASE WHEN start_us IS NULL THEN was_v ELSE top END,
          CASE WHEN start_us IS NOT NULL AND v_double - least(low, v_double) > 20 THEN start_us END, CASE WHEN start_us IS NOT NULL AND v_double - least(low, v_double) > 20 THEN ts_us END,
          CASE WHEN start_us IS NOT NULL AND v_double - least(low, v_double) > 20 THEN least(low, v_double) END, CASE WHEN start_us IS NOT NULL AND v_double - least(low, v_double) > 20 THEN top END
        FROM (SELECT d.log_id, d.signal, d.i, d.session, d.ts_us, d.v_double, d.was_v, CASE WHEN d.session = f.session THEN f.start_us END AS start_us, f.low, f.top FROM fe f JOIN sd d ON d.log_id = f.log_id AND d.signal = f.signal AND d.i = f.i + 1)""",
}

_OLD = "(SELECT arg_max({c}, (b.ts_us, b.seq)) FROM se b WHERE b.log_id = a.log_id AND b.ts_us <= a.ts_us - {w})"
ROTATIONAL = {
    "se": "SELECT * FROM samples WHERE signal = 'error'",
    "lk": f"""SELECT a.*, coalesce({_OLD.format(c='b.v_double', w=20000)}, first_value(v_double) OVER w) AS av, coalesce({_OLD.format(c='b.ts_us', w=20000)}, first_value(ts_us) OVER w) AS au,
        coalesce({_OLD.format(c='b.v_double', w=50000)}, first_value(v_double) OVER w) AS bv, coalesce({_OLD.format(c='b.ts_us', w=50000)}, first_value(ts_us) OVER w) AS bu FROM se a WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq)""",
    "ra": """SELECT *, CASE WHEN (ts_us - au) / 1e6 > .005e0 THEN abs((v_double - av) / ((ts_us - au) / 1e6)) ELSE 0 END AS alpha, CASE WHEN (ts_us - bu) / 1e6 > .02e0 THEN abs(v_double - bv) ELSE 0 END AS jump FROM lk""",
    "rh": "SELECT log_id, signal, ts_us, seq, greatest(alpha, jump) AS sc, row_number() OVER (PARTITION BY log_id, signal ORDER BY ts_us, seq) AS i FROM ra WHERE alpha >= 2000 OR jump >= 80",
    "fr": """SELECT log_id, signal, i, ts_us AS rt, seq AS rs, sc, 1 AS g FROM rh WHERE i = 1
        UNION ALL SELECT h.log_id, h.signal, h.i, CASE WHEN h.ts_us - f.rt > 300000 OR h.sc > f.sc THEN h.ts_us ELSE f.rt END, CASE WHEN h.ts_us - f.rt > 300000 OR h.sc > f.sc THEN h.seq ELSE f.rs END,
          CASE WHEN h.ts_us - f.rt > 300000 OR h.sc > f.sc THEN h.sc ELSE f.sc END, CASE WHEN h.ts_us - f.rt > 300000 THEN f.g + 1 ELSE f.g END
        FROM fr f JOIN rh h ON h.log_id = f.log_id AND h.signal = f.signal AND h.i = f.i + 1""",
}

_SLIP = """SELECT log_id, i, 0e0 AS fx, 0e0 AS fy, 0e0 AS vx, 0e0 AS vy, FALSE AS fast FROM sl WHERE i = 1
    UNION ALL SELECT log_id, i, CASE WHEN NOT valid THEN 0 WHEN gate = 1 THEN .8e0 * fx + (1 - .8e0) * rx ELSE fx END, CASE WHEN NOT valid THEN 0 WHEN gate = 1 THEN .8e0 * fy + (1 - .8e0) * ry ELSE fy END,
      CASE WHEN NOT valid THEN 0 WHEN gate = 1 THEN nx * least(1e0, 5e0 / greatest(sqrt(nx * nx + ny * ny), 1e-12)) ELSE vx END, CASE WHEN NOT valid THEN 0 WHEN gate = 1 THEN ny * least(1e0, 5e0 / greatest(sqrt(nx * nx + ny * ny), 1e-12)) ELSE vy END,
      CASE WHEN NOT valid THEN FALSE WHEN gate = 1 THEN quick ELSE fast END
    FROM (SELECT *, (CASE WHEN quick THEN .4e0 ELSE .9e0 END) * vx + (1 - CASE WHEN quick THEN .4e0 ELSE .9e0 END) * rx AS nx, (CASE WHEN quick THEN .4e0 ELSE .9e0 END) * vy + (1 - CASE WHEN quick THEN .4e0 ELSE .9e0 END) * ry AS ny
      FROM (SELECT s.log_id, s.i, s.valid, s.gate, s.rx, s.ry, f.fx, f.fy, f.vx, f.vy, f.fast, CASE WHEN f.fast THEN s.raw > 1 ELSE s.raw > 2 END AS quick FROM fs f JOIN sl s ON s.log_id = f.log_id AND s.i = f.i + 1))"""
SLIP = {
    "wc": "SELECT log_id, ts_us, max_by(v_double, seq) / 100 AS w FROM samples WHERE signal = 'purchase' GROUP BY ALL",
    "wv": "SELECT log_id, ts_us, max_by(v_double, seq) / 100 AS w FROM samples WHERE signal = 'error' GROUP BY ALL",
    "po": """SELECT o.log_id, o.ts_us, o.seq, row_number() OVER w AS i, (o.ts_us - lag(o.ts_us) OVER w) / 1e6 AS dt, o.x - lag(o.x) OVER w AS dx, o.y - lag(o.y) OVER w AS dy, coalesce(c.w, 0) AS wx, coalesce(v.w, 0) AS wy
        FROM odometry o ASOF LEFT JOIN wc c ON o.log_id = c.log_id AND o.ts_us >= c.ts_us ASOF LEFT JOIN wv v ON o.log_id = v.log_id AND o.ts_us >= v.ts_us WINDOW w AS (PARTITION BY o.log_id ORDER BY o.ts_us, o.seq)""",
    "sl": """SELECT *, coalesce(last_value(CASE WHEN wheel > 1 THEN 1 WHEN wheel <= .5e0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING), 0) AS gate, sqrt(rx * rx + ry * ry) AS raw
        FROM (SELECT *, sqrt(wx * wx + wy * wy) AS wheel, coalesce(dt > .002e0 AND dt < .1e0, FALSE) AS valid, CASE WHEN dt > .001e0 THEN dx / dt ELSE 0 END - wx AS rx, CASE WHEN dt > .001e0 THEN dy / dt ELSE 0 END - wy AS ry FROM po)""",
    "fs": _SLIP,
    "ef": """SELECT s.log_id, s.ts_us, s.seq, s.wheel, s.valid, f.fast, sqrt(f.fx * f.fx + f.fy * f.fy) AS slip_fixed, sqrt(f.vx * f.vx + f.vy * f.vy) AS slip FROM sl s JOIN fs f ON s.log_id = f.log_id AND s.i = f.i""",
}
