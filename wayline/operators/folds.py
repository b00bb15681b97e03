"""Folds over rows in order of time, for answers that depend on what was decided before.

Rows are dealt by key, sorted within their partition and streamed through a state of a few numbers, which carries over
Arrow batches. No key, stretch or episode is gathered: memory doesn't grow with a log, and time grows with its rows.
Where all rows share one key, anchors_over_all() works on time-ordered chunks side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}


class Fold:
    """A state; step() takes a row's values, step() and end() return a row to give out or None."""

    def step(self, *values):
        raise NotImplementedError

    def end(self):
        return None


def _streamed(keys: int, types: list[pa.DataType], names: list[str], make: Callable[[], Fold]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, key_types = None, None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*key_types, *types])], names)

        for batch in batches:
            key_types = key_types or [batch.schema.field(i).type for i in range(keys)]
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or row[:keys] != key:
                    if fold is not None and (last := fold.end()) is not None:
                        out.append(key + last)
                    key, fold = row[:keys], make()
                if (found := fold.step(*row[keys:])) is not None:
                    out.append(key + found)
            if out:
                yield batch_of(out)
        if fold is not None and (last := fold.end()) is not None:
            yield batch_of([key + last])

    return run


def fold(rows: DataFrame, keys: list[str], columns: list[Column | str], shape: str, make: Callable[[], Fold]) -> DataFrame:
    """Stream each key's (ts_us, seq, *columns), in order of ts_us and seq, through a fold of its own; shape names what comes out.

    Rows of one ts_us and seq follow the order of their other columns, so that a repeated run gives the same.
    """
    given = rows.select(*keys, "ts_us", "seq", *columns)
    out = StructType.fromDDL(shape)
    types = [_ARROW[f.dataType.simpleString()] for f in out]
    schema = StructType([*[given.schema[k] for k in keys], *out])
    ordered = given.repartition(*keys).sortWithinPartitions(*given.columns)
    return ordered.mapInArrow(_streamed(len(keys), types, schema.names, make), schema)


class _Dedup(Fold):
    def __init__(self, gap: int):
        self.gap, self.last = gap, None

    def step(self, ts, seq, *carried):
        if self.last is None or ts - self.last > self.gap:
            self.last = ts
            return (ts, seq, *carried)
        return None


def anchored_dedup(rows: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Keep a row (ts_us, seq) if it is more than gap_us after the last one kept."""
    return fold(rows, keys, [], "ts_us bigint, seq bigint", lambda: _Dedup(gap_us))


class _Anchors(Fold):
    def __init__(self, width: int):
        self.width, self.anchor, self.number = width, None, 0

    def step(self, ts, seq):
        if self.anchor is None or ts - self.anchor > self.width:
            self.anchor, self.number = ts, self.number + 1
        return ts, seq, self.anchor, self.number


def anchors(rows: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """Rows (ts_us, seq, anchor_us, grp): the first row's time and the number, from 1, of each row's group; a group ends more than width_us after its first row."""
    return fold(rows, keys, [], "ts_us bigint, seq bigint, anchor_us bigint, grp bigint", lambda: _Anchors(width_us))


class _Peaks(Fold):
    def __init__(self, width: int):
        self.width, self.best = width, None

    def step(self, ts, seq, score):
        best = self.best
        if best is None or ts - best[0] > self.width:
            self.best = (ts, seq, score)
            return best
        if score is not None and best[2] is not None and score > best[2]:
            self.best = (ts, seq, score)
        return None

    def end(self):
        return self.best


def peak_groups(rows: DataFrame, keys: list[str], width_us: int, score: str) -> DataFrame:
    """One row (ts_us, seq, score) per group: within width_us of a group's representative a larger score replaces it."""
    return fold(rows, keys, [F.col(score).cast("double").alias("score")], "ts_us bigint, seq bigint, score double", lambda: _Peaks(width_us))


class _Launches(Fold):
    def __init__(self, at_speed: float, drop: float, recovery: float, debounce: int):
        self.at_speed, self.drop, self.recovery, self.debounce = at_speed, drop, recovery, debounce
        self.episode, self.low, self.when, self.base, self.last = None, None, None, None, 0

    def step(self, ts, seq, episode, v, base):
        if episode != self.episode:
            self.episode, self.low = episode, None
        if v is None:
            return None
        if self.low is None:
            if base >= self.at_speed and base - v >= self.drop:
                self.low, self.when, self.base = v, (ts, seq), base
            return None
        if v < self.low:
            self.low, self.when = v, (ts, seq)
        if v - self.low < self.recovery:
            return None
        found = (*self.when, self.low, self.base)
        self.low = None
        if found[0] - self.last < self.debounce:
            return None
        self.last = found[0]
        return found


def launch_dips(gated: DataFrame, keys: list[str], at_speed: float, drop: float, recovery: float, debounce_us: int) -> DataFrame:
    """Dips (ts_us, seq, dip, baseline) from rows (episode, v_double, base) at speed; a new episode forgets a dip that is open, not the last one kept.

    Rows without a value change nothing.
    """
    return fold(gated, keys, ["episode", "v_double", "base"], "ts_us bigint, seq bigint, dip double, baseline double", lambda: _Launches(at_speed, drop, recovery, debounce_us))


class _Dips(Fold):
    def __init__(self, fall: float):
        self.fall, self.session, self.start, self.low, self.top = fall, None, None, None, None

    def step(self, ts, seq, session, v, was):
        if session != self.session:
            self.session, self.start = session, None
        if v is None:
            return None
        if self.start is None:
            if was is not None and was - v > self.fall:
                self.start, self.low, self.top = ts, v, was
            return None
        self.low = min(self.low, v)
        if v - self.low <= self.fall:
            return None
        found = (self.start, ts, self.low, self.top)
        self.start = None
        return found


def dips(rows: DataFrame, keys: list[str], fall: float) -> DataFrame:
    """Events (start_us, end_us, low, top) from rows (session, v_double, was_v): a fall of more than fall opens one, such a rise from its lowest closes it; a new session forgets an open one."""
    return fold(rows, keys, ["session", "v_double", "was_v"], "start_us bigint, end_us bigint, low double, top double", lambda: _Dips(fall))


class _Slip(Fold):
    def __init__(self, enter: float, leave: float, fixed: float, slow: float, fast: float, cap: float):
        self.enter, self.leave, self.fixed, self.slow, self.fast, self.cap = enter, leave, fixed, slow, fast, cap
        self.fx = self.fy = self.vx = self.vy = 0.0
        self.quick = False

    def step(self, ts, seq, wheel, valid, gate, rx, ry, raw):
        if not valid:
            self.fx = self.fy = self.vx = self.vy = 0.0
            self.quick = False
        elif gate == 1 and rx is not None and ry is not None:
            self.quick = raw > self.leave if self.quick else raw > self.enter
            weight, fixed = self.fast if self.quick else self.slow, self.fixed
            self.fx, self.fy = fixed * self.fx + (1 - fixed) * rx, fixed * self.fy + (1 - fixed) * ry
            nx, ny = weight * self.vx + (1 - weight) * rx, weight * self.vy + (1 - weight) * ry
            scale = min(1.0, self.cap / max(math.sqrt(nx * nx + ny * ny), 1e-12))
            self.vx, self.vy = nx * scale, ny * scale
        return ts, seq, wheel, valid, math.sqrt(self.fx * self.fx + self.fy * self.fy), math.sqrt(self.vx * self.vx + self.vy * self.vy), self.quick


def slip(rows: DataFrame, keys: list[str], enter: float, leave: float, fixed: float, slow: float, fast: float, cap: float) -> DataFrame:
    """Both smoothed slips of rows (wheel, valid, gate, rx, ry, raw); a row without slip leaves them as they are."""
    shape = "ts_us bigint, seq bigint, wheel double, valid boolean, slip_fixed double, slip double, fast boolean"
    return fold(rows, keys, ["wheel", "valid", "gate", "rx", "ry", "raw"], shape, lambda: _Slip(enter, leave, fixed, slow, fast, cap))


# One key for all rows


def _last_of_chain(ts: np.ndarray, width: int) -> np.ndarray:
    """For each of the ascending times, the last time kept if it is kept: successor pointers, doubled until all point at an end."""
    after = np.searchsorted(ts, ts + width, "right")
    jump = np.where(after < len(ts), after, np.arange(len(ts)))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return ts[jump]


def _kept(ts: np.ndarray, width: int, entering: int | None) -> np.ndarray:
    """Places of the times that begin a group, given the time that began the group before."""
    at = 0 if entering is None else int(np.searchsorted(ts, entering + width, "right"))
    kept = []
    while at < len(ts):
        kept.append(at)
        at = int(np.searchsorted(ts, ts[at] + width, "right"))
    return np.array(kept, np.int64)


def _borders(width: int):
    """What a chunk does to the group that is open before it: where the chains of the times that may begin its first own group end, equal ends once."""

    def run(rows: pa.Table) -> pa.Table:
        ts = np.sort(rows.column("ts_us").to_numpy())
        ends = _last_of_chain(ts, width)
        # A group open before the chunk began before its first time: its successor is at most the first time beyond a width from there.
        reach = min(len(ts), int(np.searchsorted(ts, ts[0] + width, "right")) + 1)
        last = np.flatnonzero(np.concatenate([ends[1:reach] != ends[: reach - 1], [True]]))
        same = lambda v: pa.array([int(v)] * len(last), pa.int64())
        return pa.table({"chunk": same(rows.column("chunk")[0].as_py()), "until": ts[last], "ends": ends[last], "last": same(ts[-1])})

    return run


def _assigned(width: int, entering: dict[int, int | None]):
    def run(rows: pa.Table) -> pa.Table:
        open_, ts = entering[rows.column("chunk")[0].as_py()], np.sort(rows.column("ts_us").to_numpy())
        begins = ts[_kept(ts, width, open_)]
        known = begins if open_ is None else np.concatenate([[open_], begins])
        return pa.table({"ts_us": ts, "anchor_us": known[np.searchsorted(known, ts, "right") - 1]})

    return run


def anchors_over_all(times: DataFrame, width_us: int, chunks: int = 64) -> DataFrame:
    """Distinct (ts_us, anchor_us) of all non-null ts_us, as anchors() gives them for one key, without a task that sees all rows.

    Time is cut into so many chunks. A chunk follows successor pointers from each time that may begin its first own group,
    which lies within a width of its first time, and tells where these chains end. The driver, which sees only these ends,
    threads the groups through the chunks; then each chunk assigns its own times, held as one array of longs.
    """
    distinct = times.where("ts_us is not null").select(F.col("ts_us").cast("long").alias("ts_us")).distinct()
    low, high = distinct.agg(F.min("ts_us"), F.max("ts_us")).first()
    if low is None:
        return distinct.withColumn("anchor_us", F.col("ts_us"))
    span = max(width_us + 1, (high - low) // chunks + 1)
    cut = distinct.withColumn("chunk", F.floor((F.col("ts_us") - low) / span)).groupBy("chunk")
    borders: dict[int, list] = {}
    for r in cut.applyInArrow(_borders(width_us), "chunk long, until long, ends long, last long").collect():
        borders.setdefault(r.chunk, []).append(r)
    entering, open_ = {}, None
    for chunk in sorted(borders):
        entering[chunk] = open_
        rows = sorted(borders[chunk], key=lambda r: r.until)
        if open_ is None or open_ + width_us < rows[0].last:
            open_ = next(r.ends for r in rows if open_ is None or r.until > open_ + width_us)
    return cut.applyInArrow(_assigned(width_us, entering), "ts_us long, anchor_us long")
