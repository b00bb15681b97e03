"""Clocks of logs that belong together: each set has a robot's log (side a) and a device's (side b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators import kernel as K
from wayline.operators.basic import by_time, percentile_floor


def edges(modes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows where enabled (bit 1 of v_long) changes, the first row of each key among them: keys, ts_us, seq, on_."""
    rows = modes.withColumn("on_", F.col("v_long").bitwiseAND(1) == 1)
    return rows.withColumn("was", F.lag("on_").over(by_time(*keys))).where("was is null or was <> on_").select(*keys, "ts_us", "seq", "on_")


def nearest_edges(a: DataFrame, b: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """Edges of a with the nearest of b in the same direction (other, other_us) within the tolerance, the earlier of two."""
    right = b.groupBy(*keys, "on_", "ts_us").agg(F.min("seq").alias("seq")).withColumn("other", F.col("seq"))
    found = K.asof_nearest(a, right, [*keys, "on_"], ["other"], tolerance_us, later=False, time="other_us")
    return found.where("other is not null")


def align(a: DataFrame, b: DataFrame, tolerance_us: int) -> DataFrame:
    """Per set the shift of b that fits a best: set_id, off, matched, sq, n (edges of b).

    Each enabling edge of a is tried as b's first one; a trial counts edges of b with an edge of a in the same direction
    within the tolerance, then the squares of their distances, then the smaller shift. Work is the product of a set's
    edges, which a match has some tens of; trials are dealt by set and shift, and each is a linear join.
    """
    first = b.where("on_").groupBy("set_id").agg(F.min("ts_us").alias("t"))
    trials = a.where("on_").select("set_id", "ts_us").distinct().join(first, "set_id").select("set_id", (F.col("ts_us") - F.col("t")).alias("off"))
    moved = b.join(trials, "set_id").withColumn("ts_us", F.col("ts_us") + F.col("off"))
    near = nearest_edges(moved, a.join(trials, "set_id"), ["set_id", "off"], tolerance_us).withColumn("d", F.abs(F.col("ts_us") - F.col("other_us")))
    scored = near.groupBy("set_id", "off").agg(F.count("*").alias("matched"), F.sum(F.col("d") * F.col("d")).alias("sq"))
    best = Window.partitionBy("set_id").orderBy(F.desc("matched"), "sq", "off")
    total = b.groupBy("set_id").agg(F.count("*").alias("n"))
    return scored.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place").join(total, "set_id")


def clock_offsets(walls: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median of wall clock less log clock (wall_us - ts_us) per key: offset_us."""
    # Whole microseconds up to 2 ** 53, some 285 years, are exact as doubles.
    found = percentile_floor(walls.select(*keys, (F.col("wall_us") - F.col("ts_us")).alias("d")), keys, 0.5, "d")
    return found.select(*keys, F.col("p_floor").cast("bigint").alias("offset_us"))


def alignments(sets: DataFrame, clocks: DataFrame, aligned: DataFrame) -> DataFrame:
    """Per set: method, offset_us, confidence, residual_us.

    sets has set_id and device ('station', 'bus' or 'rio'), clocks the robot's clock offset where it has one, aligned
    the result of align for the device's edges in the robot's time as far as it is known. A station's log with a robot's
    clock is placed by it, with a confidence that the edges raise or, a second or more apart, halve; others by edges
    alone; a log of the robot's own bus without edges is taken as it is, and others without edges have no row.
    """
    share, rms = F.col("matched") / F.col("n"), F.sqrt(F.col("sq") / F.col("matched"))
    rows = sets.join(clocks.select("set_id", F.col("offset_us").alias("clock")), "set_id", "left").join(aligned, "set_id", "left")
    timed = (F.col("device") == "station") & F.col("clock").isNotNull()
    method = F.when(timed, "system_time").when(F.col("off").isNotNull(), "mode_edge").when(F.col("device") == "rio", "assumed_zero")
    agrees = F.when(F.col("off").isNull(), F.lit(0.9)).when(F.abs("off") < 1_000_000, F.least(F.lit(1.0), 0.9 + share * 0.1)).otherwise(0.5)
    sign = F.when(F.col("device") == "station", -1).otherwise(1)
    return rows.select(
        "set_id", method.alias("method"), F.when(timed, F.col("clock")).otherwise(F.coalesce(F.col("off") * sign, F.lit(0))).alias("offset_us"),
        F.when(timed, agrees).otherwise(F.coalesce(share, F.lit(0.5))).alias("confidence"), F.when(timed, F.coalesce(F.abs("off").cast("double"), F.lit(0.0))).otherwise(F.coalesce(rms, F.lit(0.0))).alias("residual_us"),
    ).where("method is not null")
