"""Projections, filters, statistics and rates of signals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators import quantiles as Qn
from wayline.operators.export import stored

SIGNAL = ["log_id", "signal"]


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def r6_double(c: Column | str) -> Column:
    """To six digits in doubles, as SQL engines round: times a million, to a whole number, and back. round() goes by the shortest decimal text, which may lie on the other side of a tie."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def by_time(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts_us", "seq")


def slice_by_time(samples: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Rows between two times in seconds, both ends included, bounds cut to whole microseconds."""
    return samples.where(F.col("ts_us").between(int(start_s * 1e6), int(end_s * 1e6)))


def discover(signals: DataFrame, patterns: list[tuple[str, int, str]]) -> DataFrame:
    """For each log and role the first signal that matches the role's patterns in their order, names in alphabetical order."""
    spark = signals.sparkSession
    table = spark.createDataFrame(patterns, "role string, priority int, pattern string")
    hits = signals.select("log_id", "signal").distinct().join(F.broadcast(table), F.expr("signal rlike pattern"))
    order = Window.partitionBy("log_id", "role").orderBy("priority", "signal")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("log_id", "role", "signal")


def numeric_stats(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*SIGNAL).agg(
        F.min("v_double").alias("min_v"), F.max("v_double").alias("max_v"), r6(F.avg("v_double")).alias("mean_v"), F.count("*").alias("n"),
        (F.min("ts_us") / 1e6).alias("first_s"), (F.max("ts_us") / 1e6).alias("last_s"),
    )


def percentile_floor(samples: DataFrame, keys: list[str], q: float, value: str = "v_double") -> DataFrame:
    """The value at place floor(n * q) of the sorted values, without interpolation, as a double; no group is sorted in one task."""
    return Qn.quantiles(samples, keys, value, p_floor=Qn.floor_at(q))


def percentile_cont(value: str, share: float) -> Column:
    """Aggregate: the linear percentile to the last digit of DuckDB's quantile_cont, which adds the product with the lower value unrounded; percentile() rounds both products. For a log's signal: a group's values meet in one task."""
    values = F.array_sort(F.collect_list(value))
    place = (F.size(values) - 1) * F.lit(share)
    part = place - F.floor(place)
    low, high = (F.get(values, f(place).cast("int")) for f in (F.floor, F.ceil))
    between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")
    return F.when((part == 0) | (F.size(values) == 0), low).otherwise(between)


def gaps(samples: DataFrame, keys: list[str] = SIGNAL) -> DataFrame:
    """Rows with the microseconds since the one before; the first row of each key is left out."""
    return samples.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(by_time(*keys))).where("gap is not null")


def median_rate(samples: DataFrame) -> DataFrame:
    found = gaps(samples).groupBy(*SIGNAL).agg(F.median("gap").alias("m"))
    return found.select(*SIGNAL, r6(F.when(F.col("m") > 0, 1e6 / F.col("m"))).alias("rate_hz"))


def mean_rate(samples: DataFrame) -> DataFrame:
    found = samples.groupBy(*SIGNAL).agg(F.count("*").alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("d"))
    return found.select(*SIGNAL, r6(F.when(F.col("d") > 0, (F.col("n") - 1) * 1e6 / F.col("d"))).alias("rate_hz"))


def active_rate(samples: DataFrame, pause_us: int = 100_000) -> DataFrame:
    """Median period, its tenth and ninetieth percent (by floor), that of active stretches (gaps under the pause), and the number of pauses."""
    rows = gaps(samples)
    active = F.when(F.col("gap") < pause_us, F.col("gap"))
    found = rows.groupBy(*SIGNAL).agg(r6(F.median("gap")).alias("median_us"), r6(F.median(active)).alias("active_us"), F.count_if(F.col("gap") >= pause_us).alias("pauses"))
    return Qn.with_quantiles(found, rows, SIGNAL, "gap", p10_us=Qn.floor_at(0.1), p90_us=Qn.floor_at(0.9)).withColumns({c: F.col(c).cast("bigint") for c in ("p10_us", "p90_us")})


def banded(rows: DataFrame, key: Column, limits: list[float], value: str, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, median, p95 (by floor), largest and share over 1 of a value in half-open bands of a key; rows outside all bands are left out."""
    band = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(limits, limits[1:])):
        band = F.when((key >= a) & (key < b), F.lit(i)).otherwise(band)
    rows, by = rows.withColumn("band", band).where("band is not null"), [*(keys or []), "band"]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), r6(F.avg(value)).alias("mean_v"), r6(F.max(value)).alias("max_v"), r6(F.avg(F.when(F.col(value) > 1, 100.0).otherwise(0.0))).alias("outlier_pct"))
    return Qn.with_quantiles(found, rows, by, value, median_v=Qn.MEDIAN, p95_floor=Qn.floor_at(0.95)).withColumns({c: r6(c) for c in ("median_v", "p95_floor")})


def controlled(rows: DataFrame, controls: list[str], levels: list[tuple[str, ...]], group: str, groups: list[str], value: str) -> DataFrame:
    """Two groups side by side under each set of controls: the controls (null where not held), <group>_n, _median and _out (percent over 1), and better, the group with the smaller median.

    Rows are dealt out once to all sets of controls; medians are exact and don't gather a cell's values in one task.
    """
    ways = [F.struct(F.lit(i).alias("level"), *[(F.col(c) if c in held else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in controls]) for i, held in enumerate(levels)]
    each = rows.select(group, value, F.inline(F.array(*ways)))
    keys = ["level", *controls, group]
    cells = each.groupBy(*keys).agg(F.count("*").alias("n"), r6_double(100.0 * F.count_if(F.col(value) > 1) / F.count("*")).alias("out"))
    cells = Qn.with_quantiles(cells, each, keys, value, median=Qn.MEDIAN)
    side = cells.groupBy("level", *controls).pivot(group, groups).agg(F.first("n").alias("n"), r6_double(F.first("median")).alias("median"), F.first("out").alias("out"))
    a, b = (F.col(f"{g}_median") for g in groups)
    side = side.withColumn("better", F.when(a < b, groups[0]).when(a.isNotNull() & b.isNotNull(), groups[1]))
    return side.withColumns({f"{g}_n": F.coalesce(f"{g}_n", F.lit(0)) for g in groups}).drop("level")


def previous(rows: DataFrame, order: str, columns: dict[str, str]) -> DataFrame:
    """Adds columns (new name: old name) of the row before in the order of a unique column, null in the first.

    Rows are range-partitioned, written to the shared folder, and each range looks back by itself; only the last row of
    each range goes to the one task that hands it on.
    """
    ranged = stored(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_part").orderBy(order)
    here = ranged.withColumns({**{f"_p_{k}": F.lag(v).over(w) for k, v in columns.items()}, "_nr": F.row_number().over(w)})
    ends = here.groupBy("_part").agg(F.max_by(F.struct(*columns.values()), order).alias("_last"))
    ends = ends.select(F.lead("_part").over(Window.orderBy("_part")).alias("_part"), "_last")
    joined = here.join(F.broadcast(ends), "_part", "left")  # a row for each partition
    return joined.select(*rows.columns, *[F.when(F.col("_nr") == 1, F.col("_last")[v]).otherwise(F.col(f"_p_{k}")).alias(k) for k, v in columns.items()])


def _solved(inputs: int, least_rows: int):
    """Solve the normal equations of each key: Cholesky's rows in the order of the largest remaining pivot, as far as pivots tell from rounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, ranks, fits, before, after = [], [], [], [], []
            for n, rows, square, moments, target in zip(*(batch.column(c).to_pylist() for c in ("n", "rows", "square", "moments", "target"))):
                a, t = np.zeros((inputs, inputs)), np.array(moments)
                a[np.triu_indices(inputs)] = square
                a = a + np.triu(a, 1).T
                enough = n >= least_rows
                fit, rank = _cholesky(a, t) if enough else (None, None)
                status.append("success" if enough else "insufficient")
                ranks.append(rank)
                fits.append(None if fit is None else fit.tolist())
                before.append(math.sqrt(target / rows) if enough else None)
                after.append(math.sqrt(max(0.0, target - float(fit @ t)) / rows) if enough else None)
            for name, values, kind in (("status", status, pa.string()), ("rank", ranks, pa.int32()), ("fit", fits, pa.list_(pa.float64())), ("rms_before", before, pa.float64()), ("rms_after", after, pa.float64())):
                batch = batch.append_column(name, pa.array(values, kind))
            yield batch.drop_columns(["rows", "square", "moments", "target"])

    return run


def _cholesky(a: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, int]:
    """A solution of a @ x = t for a positive semidefinite a, unknowns that it can't tell being 0, and its rank."""
    d, left, order = len(t), np.zeros_like(a), []
    rest = a.copy()
    for k in range(d):
        free = [i for i in range(d) if i not in order]
        p = max(free, key=lambda i: rest[i, i])
        if rest[p, p] <= 1e-10 * max(a.diagonal().max(), 1e-300):
            break
        order.append(p)
        left[:, k] = rest[:, p] / math.sqrt(rest[p, p])
        rest -= np.outer(left[:, k], left[:, k])
    rank = len(order)
    triangle = left[order, :rank]
    x = np.zeros(d)
    y = np.zeros(rank)
    for i in range(rank):
        y[i] = (t[order[i]] - triangle[i, :i] @ y[:i]) / triangle[i, i]
    for i in range(rank - 1, -1, -1):
        x[order[i]] = (y[i] - triangle[i + 1 :, i] @ x[order[i + 1 :]]) / triangle[i, i]
    return x, rank


def fitted(rows: DataFrame, keys: list[str], equations: list[tuple[list[Column], Column]], least_rows: int) -> DataFrame:
    """Per key a least-squares fit of unknowns that several equations of each row share: n, status, rank, fit, rms_before, rms_after.

    An equation is its coefficients of the unknowns and its target. Only sums of products are added up, one small row for
    each key; residuals after the fit follow from them. Keys with fewer than least_rows rows are insufficient and have
    no fit; unknowns that the rows can't tell apart from others are 0, and rank says how many were told. A row with a
    null coefficient or target is left out.
    """
    count = len(equations[0][0])
    parts = F.array(*[F.struct(F.array(*[c.cast("double") for c in left]).alias("a"), right.cast("double").alias("b")) for left, right in equations])
    whole = rows.select(*keys, parts.alias("_e")).where(F.forall("_e", lambda e: e["b"].isNotNull() & F.forall(e["a"], lambda c: c.isNotNull())))
    dot = lambda f: F.sum(F.aggregate("_e", F.lit(0.0), lambda s, e: s + f(e)))
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    sums = whole.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.count("*") * len(equations)).alias("rows"), F.array(*[dot(lambda e, i=i, j=j: e["a"][i] * e["a"][j]) for i, j in pairs]).alias("square"),
        F.array(*[dot(lambda e, i=i: e["a"][i] * e["b"]) for i in range(count)]).alias("moments"), dot(lambda e: e["b"] * e["b"]).alias("target"),
    )
    schema = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInArrow(_solved(count, least_rows), f"{schema}, n long, status string, rank int, fit array<double>, rms_before double, rms_after double")
