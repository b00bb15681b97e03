import random

import numpy as np
import pytest

from wayline.operators import quantiles as Q


def plain(values, rank):
    v = sorted(values)
    if not v:
        return None
    if not rank.linear:
        return v[min(int(len(v) * rank.share), len(v) - 1)]
    return float(np.quantile(v, rank.share))


RANKS = {"lowest": Q.at(0.0), "q25": Q.at(0.25), "median": Q.MEDIAN, "p95": Q.at(0.95), "floor": Q.floor_at(0.95), "highest": Q.at(1.0)}


@pytest.mark.parametrize("kind", ["even", "long tail", "few values", "huge"])
def test_histograms_equal_sorting(spark, kind):
    rng = random.Random(kind)
    draw = {"even": lambda: rng.random(), "long tail": lambda: rng.random() ** -8, "few values": lambda: float(rng.randrange(3)), "huge": lambda: rng.choice([-1, 1]) * 1.7e308 * rng.random()}[kind]
    rows = [(rng.choice(["a", "a", "a", "b", None]), draw()) for _ in range(3000)] + [("c", 5.0), ("d", None), ("b", float("nan")), ("a", float("inf"))]
    frame = spark.createDataFrame(rows, "k string, v double")
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([v] if v is not None and abs(v) < float("inf") else [])
    for gather in (50, Q.GATHER):
        found = {r.k: r for r in Q.quantiles(frame, ["k"], "v", gather=gather, **RANKS).collect()}
        assert set(found) == set(groups)
        for k, values in groups.items():
            for name, rank in RANKS.items():
                want = plain(values, rank)
                assert found[k][name] is None if want is None else found[k][name] == pytest.approx(want, rel=1e-9), (k, name)


def test_no_rows_and_no_keys(spark):
    frame = spark.createDataFrame([], "k string, v double")
    assert Q.quantiles(frame, ["k"], "v", m=Q.MEDIAN).collect() == []
    some = spark.range(500).selectExpr("id * 1D as v")
    assert [r.m for r in Q.quantiles(some, [], "v", gather=10, m=Q.MEDIAN).collect()] == [249.5]


def test_no_task_gets_a_group(spark):
    rows = spark.range(200_000).selectExpr("'one' as k", "pow(id % 77777, 1.5) as v")
    values = rows.selectExpr("k", "v as _v")
    sizes = spark.createDataFrame([("one", 100_000, 100_000, 0.0, 77776.0**1.5, 200_000)], "k string, rank long, r long, low double, high double, n long")
    bins = Q._narrowed(values, sizes, ["k"]).first()
    assert bins.n < 200_000 / Q.BINS * 3 and bins.low <= sorted((i % 77777) ** 1.5 for i in range(200_000))[99_999] <= bins.high
