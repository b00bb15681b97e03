"""Exact quantiles of groups of any size, by refined histograms.

No group's values meet in one task. A first pass counts each group; while a wanted rank lies among more than GATHER
values, another pass counts the values between that rank's bounds in BINS bins, and the bin that holds the rank gives the
next bounds. What travels is one row for each task, rank and bin. The last pass sorts the few values that are left.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.export import stored

GATHER = 1 << 16
BINS = 1024


@dataclass(frozen=True)
class Rank:
    """Which value is wanted: share of the way through the sorted values; linear between two values, or the value at place floor(n * share)."""

    share: float
    linear: bool = True

    def lower(self, n: Column) -> Column:
        """Number, from 1, of the value at or below the wanted place."""
        if self.linear:
            return F.floor((n - 1) * self.share).cast("bigint") + 1
        return F.least(F.floor(n * self.share).cast("bigint") + 1, n)

    def part(self, n: Column) -> Column:
        """How far the wanted place lies towards the next value."""
        place = (n - 1) * self.share
        return place - F.floor(place) if self.linear else F.lit(0.0)


def at(share: float) -> Rank:
    return Rank(share)


def floor_at(share: float) -> Rank:
    return Rank(share, linear=False)


MEDIAN = Rank(0.5)


def with_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a and b joined on keys, nulls being equal; the keys once."""
    renamed = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    return a.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _narrowed(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, rank, r, low, high, n) with closer bounds: those of the bin that holds the r-th value between them."""
    inside = with_keys(values, wanted, keys).where("_v between low and high")
    # Halves, so that the span of two huge values of either sign is still a number.
    place = F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS)
    bins = inside.withColumn("bin", F.least(place, F.lit(BINS - 1))).groupBy(*keys, "rank", "r", "bin").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    order = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where("before < r and r <= before + n")
    return bins.select(*keys, "rank", (F.col("r") - F.col("before")).alias("r"), "low", "high", "n")


def _ranked(values: DataFrame, wanted: DataFrame, keys: list[str], gather: int) -> DataFrame:
    """(keys, rank, v): the rank-th smallest value of each wanted rank."""
    done = []
    while True:
        wanted = stored(wanted, "ranks")
        open_ = (F.col("n") > gather) & (F.col("low") < F.col("high"))
        done.append(wanted.where(~open_))
        wanted = wanted.where(open_)
        if wanted.isEmpty():
            break
        wanted = _narrowed(values, wanted, keys)
    few = reduce(DataFrame.unionByName, done)
    listed = with_keys(values, few.where("low < high"), keys).where("_v between low and high").groupBy(*keys, "rank", "r").agg(F.array_sort(F.collect_list("_v")).alias("vs"))
    alike = few.where("low = high").select(*keys, "rank", F.col("low").alias("v"))
    return alike.unionByName(listed.select(*keys, "rank", F.get("vs", (F.col("r") - 1).cast("int")).alias("v")))


def quantiles(rows: DataFrame, keys: list[str], value: Column | str, gather: int = GATHER, **ranks: Rank) -> DataFrame:
    """Keys and one column per rank: the exact quantile of a group's values that are neither null nor infinite nor NaN.

    Linear ranks equal percentile() and quantile_cont; a group without such values has nulls. Groups of at most gather
    values are done by the built-in aggregate, whose buffer that bounds; larger ones by histograms, from values written
    once to the shared folder. Equal keys may be null.
    """
    value = F.col(value) if isinstance(value, str) else value
    usable = F.when(F.abs(value.cast("double")) < float("inf"), value.cast("double"))
    values = rows.select(*keys, usable.alias("_v"))
    sizes = values.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= gather:
        listed = values.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(r.share) for r in ranks.values()])).alias("p"), *([F.array_sort(F.collect_list("_v")).alias("vs")] if not all(r.linear for r in ranks.values()) else []))
        pick = {n: F.get("p", F.lit(i)) if r.linear else F.get("vs", (r.lower(F.size("vs").cast("bigint")) - 1).cast("int")) for i, (n, r) in enumerate(ranks.items())}
        return listed.select(*keys, *[c.alias(n) for n, c in pick.items()])
    values, sizes = stored(values.where("_v is not null"), "values"), stored(sizes, "sizes")
    n = F.col("n")
    lowest = {name: r.lower(n) for name, r in ranks.items()}
    places = F.array_distinct(F.array(*lowest.values(), *[F.least(lowest[name] + 1, n) for name, r in ranks.items() if r.linear]))
    wanted = sizes.where("n > 0").select(*keys, F.explode(places).alias("rank"), "low", "high", "n").withColumn("r", F.col("rank"))
    found = _ranked(values, wanted.select(*keys, "rank", "r", "low", "high", "n"), keys, gather)
    table = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_m"))  # two values a rank at most
    joined = with_keys(sizes, table, keys, "left")

    def pick(name: str, r: Rank) -> Column:
        a, b = F.try_element_at("_m", lowest[name]), F.try_element_at("_m", F.least(lowest[name] + 1, n))
        return (a * (1 - r.part(n)) + b * r.part(n) if r.linear else a).alias(name)

    return joined.select(*keys, *[pick(name, r) for name, r in ranks.items()])


def with_quantiles(grouped: DataFrame, rows: DataFrame, keys: list[str], value: Column | str, **ranks: Rank) -> DataFrame:
    """The aggregates of a grouping by keys with quantiles of the same rows beside them."""
    return with_keys(grouped, quantiles(rows, keys, value, **ranks), keys, "left")
