"""Time-series joins and intervals that every analysis is built from.

All take rows of many logs at once: keys say what belongs together, ts_us orders it, seq parts rows of one microsecond.
As-of joins are one union and running windows over the shared key: one shuffle, a sort for each direction in time, no
nested loops. Running frames start at one end of a key and keep one row, so the work grows with the rows, not their
square; frames that reach ahead of the current row are written as running frames in descending order for that reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.folds import anchored_dedup, anchors, peak_groups

__all__ = [
    "anchored_dedup", "anchored_groups", "anchors", "asof_backward", "asof_forward", "asof_many", "asof_nearest", "gap_sessions", "hysteresis", "interpolate_join", "lerp", "lerp_angle_deg", "merge_close", "peak_groups",
    "range_join", "runs", "threshold_runs",
]


def _merged(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], right_first: bool) -> DataFrame:
    """Both sides in one table; right rows carry their values in _r, left rows all columns in _l."""
    l_side, r_side = (1, 0) if right_first else (0, 1)
    a = left.select(*keys, "ts_us", F.col("seq").alias("_seq"), F.lit(l_side).alias("_side"), F.struct(*left.columns).alias("_l"))
    b = right.select(*keys, "ts_us", F.col("seq").alias("_seq"), F.lit(r_side).alias("_side"), F.struct(F.col("ts_us").alias("ts_us"), *values).alias("_r"))
    return a.unionByName(b, allowMissingColumns=True)


_ORDER = ("ts_us", "_side", "_seq")


def _last_before(keys: list[str]) -> Column:
    """The right row last in order up to the current row."""
    return F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _first_after(keys: list[str]) -> Column:
    """The right row first in order from the current row on."""
    return F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in _ORDER]).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _unpacked(rows: DataFrame, left: DataFrame, **extra: Column) -> DataFrame:
    return rows.where("_l is not null").select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[v.alias(k) for k, v in extra.items()])


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], strict: bool = False, clamp: bool = False, time: str | None = None) -> DataFrame:
    """Left rows with the values of the last right row at or before them (before them if strict), null if none.

    Right rows of one microsecond count by seq, the last wins. With clamp, left rows before the first right row get that
    row. time names a column for the matched row's ts_us.
    """
    rows = _merged(left, right, keys, values, right_first=not strict)
    found = F.coalesce(_last_before(keys), _first_after(keys)) if clamp else _last_before(keys)
    rows = rows.withColumn("_f", found)
    extra = {v: F.col(f"_f.{v}") for v in values} | ({time: F.col("_f.ts_us")} if time else {})
    return _unpacked(rows, left, **extra)


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left rows with the values of the first right row at or after them; the last right row if there is none."""
    rows = _merged(left, right, keys, values, right_first=False)
    rows = rows.withColumn("_f", F.coalesce(_first_after(keys), _last_before(keys)))
    return _unpacked(rows, left, **{v: F.col(f"_f.{v}") for v in values})


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance_us: int = 100_000, later: bool = True, time: str | None = None) -> DataFrame:
    """Left rows with the values of the nearest right row within the tolerance, null if none.

    Of two equally near rows the later wins (the earlier if later is false); of right rows at one microsecond the first.
    """
    rows = _merged(left, right, keys, values, right_first=False).withColumns({"_b": _last_before(keys), "_a": _first_after(keys)})
    gap_b, gap_a = F.col("ts_us") - F.col("_b.ts_us"), F.col("_a.ts_us") - F.col("ts_us")
    wins = gap_a <= gap_b if later else gap_a < gap_b
    pick = F.when(F.col("_b").isNull() | wins, F.col("_a")).otherwise(F.col("_b"))
    rows = rows.withColumn("_f", F.when(F.col("_a").isNull(), F.col("_b")).otherwise(pick))
    near = F.abs(F.col("ts_us") - F.col("_f.ts_us")) <= tolerance_us
    extra = {v: F.when(near, F.col(f"_f.{v}")) for v in values} | ({time: F.when(near, F.col("_f.ts_us"))} if time else {})
    return _unpacked(rows, left, **extra)


def asof_many(left: DataFrame, streams: dict[str, tuple[DataFrame, list[str], int]], keys: list[str]) -> DataFrame:
    """Left rows with, for each stream (rows, columns, tolerance in us), the columns of its nearest row within the tolerance, as <stream>_<column>, null if none.

    All streams and the left rows are one union, dealt and sorted once each way for all streams together. Of two equally
    near rows the later wins; of rows at one microsecond before or at the left row the last by seq, after it the first.
    """
    columns = lambda side: [*keys, "ts_us", F.col("seq").alias("_seq"), F.lit(side).alias("_side")]
    rows = left.select(*columns(1), F.struct(*left.columns).alias("_l"))
    for name, (stream, values, _) in streams.items():
        rows = rows.unionByName(stream.select(*columns(0), F.struct(F.col("ts_us").alias("ts_us"), *values).alias(f"_r_{name}")), allowMissingColumns=True)
    upto = Window.unboundedPreceding, Window.currentRow
    back = Window.partitionBy(*keys).orderBy(*_ORDER).rowsBetween(*upto)
    ahead = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in _ORDER]).rowsBetween(*upto)
    rows = rows.withColumns({f"_b_{n}": F.last(f"_r_{n}", ignorenulls=True).over(back) for n in streams})
    rows = rows.withColumns({f"_a_{n}": F.last(f"_r_{n}", ignorenulls=True).over(ahead) for n in streams}).where("_l is not null")
    out = {}
    for name, (_, values, tolerance) in streams.items():
        b, a = F.col(f"_b_{name}"), F.col(f"_a_{name}")
        gap_b, gap_a = F.col("ts_us") - b["ts_us"], a["ts_us"] - F.col("ts_us")
        later = gap_b.isNull() | (gap_a <= gap_b)
        near = F.least(gap_b, gap_a) <= tolerance
        out |= {f"{name}_{v}": F.when(near, F.when(F.coalesce(later & a.isNotNull(), F.lit(False)), a[v]).otherwise(b[v])) for v in values}
    return rows.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[c.alias(n) for n, c in out.items()])


def lerp(a: Column, b: Column, part: Column) -> Column:
    return a + (b - a) * part


def lerp_angle_deg(a: Column, b: Column, part: Column) -> Column:
    """Along the shorter arc, in degrees."""
    return a + (F.pmod(b - a + 180, F.lit(360.0)) - 180) * part


def interpolate_join(left: DataFrame, path: DataFrame, keys: list[str], linear: list[str], angle: str | None = None, prefix: str = "p_", clamp: bool = True) -> DataFrame:
    """Left rows with the path's columns interpolated at their time; outside the path its ends, or null without clamp."""
    values = [*linear, *([angle] if angle else [])]
    rows = _merged(left, path, keys, values, right_first=True).withColumns({"_b": _last_before(keys), "_a": _first_after(keys)})
    exact = F.col("_b.ts_us") == F.col("ts_us")
    span = F.col("_a.ts_us") - F.col("_b.ts_us")
    part = F.when(exact | (span <= 0), F.lit(0.0)).otherwise((F.col("ts_us") - F.col("_b.ts_us")) / span)
    inside = F.col("_b").isNotNull() & (F.col("_a").isNotNull() | exact)

    def at(name: str, mix) -> Column:
        a, b = F.col(f"_b.{name}"), F.col(f"_a.{name}")
        between = F.when(exact, a).otherwise(mix(a, b, part))
        return F.when(inside, between).otherwise(F.coalesce(a, b) if clamp else F.lit(None).cast("double"))

    extra = {f"{prefix}{c}": at(c, lerp) for c in linear}
    if angle:
        extra[f"{prefix}{angle}"] = at(angle, lerp_angle_deg)
    return _unpacked(rows, left, **extra)


def range_join(left: DataFrame, right: DataFrame, keys: list[str], before_us: int, after_us: int, right_time: str = "r_ts_us", how: str = "inner") -> DataFrame:
    """Pairs with left.ts_us - before_us <= right_time <= left.ts_us + after_us.

    Time is cut into buckets as wide as the window; a left row visits the two or three that its window touches, so the
    pairs are found by an equi-join.
    """
    width = max(1, before_us + after_us)
    low, high = F.floor((F.col("ts_us") - before_us) / width), F.floor((F.col("ts_us") + after_us) / width)
    a = left.withColumn("_bucket", F.explode(F.sequence(low, high)))
    b = right.withColumn("_bucket", F.floor(F.col(right_time) / width))
    if how == "left_semi":
        joined = a.join(b, [*[a[k] == b[k] for k in keys], a["_bucket"] == b["_bucket"], b[right_time].between(a["ts_us"] - before_us, a["ts_us"] + after_us)], "left_semi")
        return joined.drop("_bucket").distinct()
    return a.join(b, [*keys, "_bucket"]).where(F.col(right_time).between(F.col("ts_us") - before_us, F.col("ts_us") + after_us)).drop("_bucket")


def runs(rows: DataFrame, keys: list[str], state: Column) -> DataFrame:
    """Adds run: a number that grows with each change of state within the keys (nulls are a state)."""
    order = Window.partitionBy(*keys).orderBy("ts_us", "seq")
    rows = rows.withColumn("_s", state)
    changed = F.when(F.lag("seq").over(order).isNull() | ~F.col("_s").eqNullSafe(F.lag("_s").over(order)), 1).otherwise(0)
    rows = rows.withColumn("_c", changed)
    return rows.withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_c").withColumnRenamed("_s", "state")


def hysteresis(rows: DataFrame, keys: list[str], enter: Column, leave: Column) -> DataFrame:
    """Intervals (keys, start_us, end_us) from the first row that enters to the next that leaves; an open one ends at the last row."""
    order = Window.partitionBy(*keys).orderBy("ts_us", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_on", F.coalesce(F.last(F.when(enter, 1).when(leave, 0), ignorenulls=True).over(upto), F.lit(0)))
    rows = rows.withColumn("_was", F.coalesce(F.lag("_on").over(order), F.lit(0)))
    rows = rows.withColumn("_end", F.max("ts_us").over(Window.partitionBy(*keys)))
    edges = rows.where("_on <> _was")
    closing = F.lead("ts_us").over(order)
    return edges.withColumn("_next", closing).where("_on = 1").select(*keys, F.col("ts_us").alias("start_us"), F.coalesce("_next", "_end").alias("end_us"))


def merge_close(intervals: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Join intervals whose gap to the one before is under gap_us."""
    order = Window.partitionBy(*keys).orderBy("start_us")
    rows = intervals.withColumn("_new", F.when(F.col("start_us") - F.lag("end_us").over(order) < gap_us, 0).otherwise(1))
    rows = rows.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_g").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_g")


def gap_sessions(rows: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Adds session: rows within gap_us of the one before share it."""
    order = Window.partitionBy(*keys).orderBy("ts_us", "seq")
    rows = rows.withColumn("_new", F.when(F.col("ts_us") - F.lag("ts_us").over(order) <= gap_us, 0).otherwise(1))
    return rows.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def threshold_runs(rows: DataFrame, keys: list[str], over: Column, value: str, least_us: int) -> DataFrame:
    """Runs of rows over a threshold: start_us, end_us (the first row back under, or the last row), n, peak; kept from least_us on."""
    order = Window.partitionBy(*keys).orderBy("ts_us", "seq")
    marked = runs(rows.withColumn("_next", F.lead("ts_us").over(order)), keys, over)
    found = marked.where("state").groupBy(*keys, "run").agg(
        F.min("ts_us").alias("start_us"), F.max(F.coalesce("_next", "ts_us")).alias("end_us"), F.count("*").alias("n"), F.max(value).alias("peak")
    )
    return found.where(F.col("end_us") - F.col("start_us") >= least_us).drop("run")


def anchored_groups(rows: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """Group number of each row (ts_us, seq, grp), from 1: a new group begins more than width_us after its first row."""
    return anchors(rows, keys, width_us).drop("anchor_us")
