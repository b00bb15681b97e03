"""Queries whose doubles lie on a limit, against their SQL on one thread, which adds rows in the order of the table."""

import os
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wayline.operators import basic as B
from wayline.plans import registry


def answers(spark, folder, name):
    """Rows of the query and of its SQL over a folder's tables, columns by name."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect(config={"threads": 1})
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}{'/*' if os.path.isdir(folder / t) else ''}')")
    frame, found = registry.QUERIES[name](spark, str(folder)), con.execute(registry.ORACLE_SQL[name])
    names = sorted(frame.columns)
    places = [[d[0] for d in found.description].index(c) for c in names]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr), sorted((tuple(r[i] for i in places) for r in found.fetchall()), key=repr)


def test_mean_distances_on_a_band_limit_equal_sql(spark, tmp_path):
    rng, frames = random.Random(1), 200
    tags = []
    for k in range(frames):
        parts = [rng.randint(2, 50) for _ in range(6)]
        last = 7 * 18 - sum(parts)  # a mean of 2 but for rounding
        tags += [(k, q) for q in [*parts, last]]
    tags += [(frames, None), (frames, None)]
    rng.shuffle(tags)
    (tmp_path / "lineitem.parquet").mkdir()
    # The larger file is read first by Spark, and partial sums meet; in the table it is the second.
    for name, part in (("a", tags[:500]), ("b", tags[500:])):
        columns = {"l_orderkey": pa.array([k for k, _ in part], pa.int64()), "l_linenumber": pa.array([1] * len(part), pa.int32()), "l_partkey": pa.array([k % 5 * 8 for k, _ in part], pa.int64()), "l_quantity": pa.array([q for _, q in part], pa.float64())}
        columns |= {"l_discount": pa.array([None if q is None else 0.01 for _, q in part], pa.float64()), "l_tax": pa.array([0.0] * len(part), pa.float64())}
        pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet" / f"{name}.parquet")
    n = frames + 1
    orders = {"o_orderkey": list(range(n)), "o_custkey": [1] * n, "o_totalprice": [round(rng.uniform(1e3, 5e5), 2) for _ in range(n)], "o_orderdate": pa.array([datetime(2000, 1, 1)] * n, pa.timestamp("us"))}
    pq.write_table(pa.table(orders), tmp_path / "orders.parquet")
    got, want = answers(spark, tmp_path, "two_group_by_band")
    assert got == want
    assert {r[2] for r in want} == {0, 1, 3, None}  # bands: sums on both sides of the limit, and no distance


def test_medians_on_a_rounding_limit_equal_sql(spark):
    rows = spark.createDataFrame([("hub", 1, 1.0256355), ("station", 1, 4.4940904999999995)], "grp string, d int, r double")
    (row,) = B.controlled(rows, ["d"], [("d",)], "grp", ["hub", "station"], "r").collect()
    assert (row.hub_median, row.station_median) == (1.025635, 4.494091)


def test_percentiles_on_a_limit_equal_sql(spark, tmp_path):
    # The dip is a fifth of the 95th percentile but for the last digit, on either side of it by how that is interpolated.
    logs = [[low] * 5 + [dip] + [low] * 3 + [high] for low, high, dip in ((28.3, 32.3, 6.1), (29.9, 31.9, 6.2))]
    logs += [[None] * 4, [5.0], [20.0] * 4 + [None, 20.0, 6.0] + [20.0] * 5, [20.0] * 5 + [6.0] + [20.0] * 30 + [float("inf")]]
    rows = [(k * 12, i, v) for k, log in enumerate(logs) for i, v in enumerate(log)]
    events = {"event_id": list(range(len(rows))), "user_id": [u for u, _, _ in rows], "event_type": ["click"] * len(rows), "value": pa.array([v for _, _, v in rows], pa.float64())}
    events["ts"] = pa.array([datetime(2024, 1, 1) + timedelta(hours=i) for _, i, _ in rows], pa.timestamp("us"))
    pq.write_table(pa.table(events), tmp_path / "events.parquet")
    got, want = answers(spark, tmp_path, "throughput_launches")
    assert got == want and {r[0] for r in want} == {1, 4, 5}
