"""Whitening of embeddings by a bidiagonal qd solver.

Each task reduces its centred rows to a triangle by blockwise QR, a few tasks reduce the triangles as they stream by, and
one last triangle, as wide as a vector is long, goes to the driver. There Householder reflections make it bidiagonal,
dqds finds the singular values and twisted factorisations the directions. Rows never leave their tasks, and the
covariance is never formed, so small variances keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.qd_solver import principal_axes

ROWS = 2048
MERGERS = 16
_EXACT = 2.0**53


def whole_numbers(vector: Column, scale: float = 1024.0, offset: int = 100_000) -> Column:
    """floor(scale * x) + offset of each component as longs; null for a null vector or one with null or non-finite components.

    Products are cut to plus or minus 2 ** 53 before the offset is added.
    """
    usable = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    cut = lambda x: F.greatest(F.lit(-_EXACT), F.least(F.lit(_EXACT), x.cast("double") * scale))
    return F.when(vector.isNotNull() & usable, F.transform(vector, lambda x: F.floor(cut(x)).cast("bigint") + F.lit(offset)))


@dataclass(frozen=True)
class Axes:
    """The fit list's size, its sums and, per component, unit direction (a column) and variance; trace is the whole variance."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _parts(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _triangles(dim: int, mean: np.ndarray):
    """One triangle for all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle, seen = np.zeros((0, dim)), False
        for batch in batches:
            for part in _parts(batch):
                triangle, seen = np.linalg.qr(np.vstack([triangle, _matrix(part.column("x"), dim) - mean]), mode="r"), True
        if seen:
            yield pa.RecordBatch.from_pydict({"triangle": [np.ascontiguousarray(triangle, "<f8").tobytes()]})

    return run


def _merged(dim: int):
    """One triangle for all triangles of a task, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle, seen = np.zeros((0, dim)), False
        for batch in batches:
            for raw in batch.column("triangle"):
                triangle, seen = np.linalg.qr(np.vstack([triangle, np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, dim)]), mode="r"), True
        if seen:
            yield pa.RecordBatch.from_pydict({"triangle": [np.ascontiguousarray(triangle, "<f8").tobytes()]})

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and exact sums per dimension of a task; sums travel as text, so they may be larger than longs."""
    n, sums = 0, None
    for batch in batches:
        for part in _parts(batch):
            x = _matrix(part.column("x"), part.column("x").value_lengths()[0].as_py())
            # Halves of 32 bits: neither their sums nor those of a task overflow.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            now = [int(h) * 2**32 + int(b) for h, b in zip(high, low)]
            n, sums = n + len(x), now if sums is None else [a + b for a, b in zip(sums, now)]
    if n:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})


def _usable(rows: DataFrame, vector_col: str, *columns: Column) -> tuple[DataFrame, int]:
    """Rows whose vector has the commonest length (of equally common ones the largest), and that length; 0 if there is none."""
    x = rows.select(F.col(vector_col).cast("array<bigint>").alias("x"), *columns).where("x is not null and size(x) > 0 and forall(x, v -> v is not null)")
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = lengths[0].d if lengths else 0
    return x.where(F.size("x") == dim), dim


def fit(rows: DataFrame, vector_col: str = "x", components: int = 8) -> Axes | None:
    """The principal axes of whole-numbered vectors, at most so many; None if no row has a vector.

    Rows with a null or empty vector, one with null components or one of another than the commonest length take no
    part; repeated rows count for each row. Directions without variance, within rounding, are not among the axes.
    The driver gets one row of sums for each dimension and one triangle.
    """
    usable, dim = _usable(rows, vector_col)
    if not dim:
        return None
    counted = usable.mapInArrow(_sums, "n long, sums array<string>")
    totals = counted.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()
    n, sums = totals[0].n, tuple(int(r.total) for r in sorted(totals, key=lambda r: r.pos))
    mean = np.array([s / n for s in sums])
    shape = "triangle binary"
    triangles = usable.mapInArrow(_triangles(dim, mean), shape).repartition(MERGERS).mapInArrow(_merged(dim), shape)
    last = triangles.coalesce(1).mapInArrow(_merged(dim), shape).first()
    triangle = np.frombuffer(bytes(last.triangle), "<f8").reshape(-1, dim)
    square = np.zeros((dim, dim))
    square[: len(triangle)] = triangle
    squares, directions = principal_axes(square, components)
    return Axes(n, sums, directions, squares[: directions.shape[1]] / n, float(squares.sum()) / n)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[str]:
    """The exact sum over the dimensions of (n * x - sum) ** 2, as text."""
    reach = max(abs(n * int(x.max(initial=0)) - min(sums)), abs(n * int(x.min(initial=0)) - max(sums)))
    if n * int(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, sums)) < 2**62 and reach * reach * len(sums) < 2**63:
        y = n * x - np.array(sums, np.int64)
        return [str(v) for v in (y * y).sum(axis=1).tolist()]
    return [str(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums))) for row in x.tolist()]


def _whiten(axes: Axes):
    matrix, mean = axes.directions / np.sqrt(axes.variances), axes.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                x = _matrix(part.column("x"), axes.dim)
                white = (x - mean) @ matrix
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_deviations(x, axes.n, axes.sums)), lists], ["id", "deviation", "white"])

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, mean and summed products about that mean of a task's whitened rows."""
    n, mean, products = 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        w = _matrix(batch.column("white"), batch.column("white").value_lengths()[0].as_py())
        m, own = len(w), w.mean(axis=0)
        c = (w - own).T @ (w - own)
        if n:
            gap = own - mean
            products, mean = products + c + np.outer(gap, gap) * (n * m / (n + m)), mean + gap * (m / (n + m))
        else:
            products, mean = c, own
        n += m
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "products": [products.ravel().tolist()]})


def identity_error(white: DataFrame, n: int) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n) minus the identity, from moments of tasks."""
    shape = "n long, mean array<double>, products array<double>"
    parts = white.mapInArrow(_moments, shape)
    total = parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg(F.sum(F.col("m") * F.col("n")).alias("s")).collect()
    mean = [r.s / n for r in sorted(total, key=lambda r: r.i)]
    k = len(mean)
    # Products about each task's mean, brought to the mean of all.
    centre = F.array(*[F.lit(m) for m in mean])
    moved = parts.withColumn("gap", F.zip_with("mean", centre, lambda a, b: a - b))
    pairs = moved.select("n", "gap", F.posexplode("products").alias("p", "v")).withColumn("v", F.col("v") + F.col("n") * F.get("gap", F.floor(F.col("p") / k).cast("int")) * F.get("gap", F.col("p") % k))
    entries = pairs.groupBy("p").agg((F.sum("v") / n).alias("v"))
    return float(entries.agg(F.max(F.abs(F.col("v") - F.when(F.floor(F.col("p") / k) == F.col("p") % k, 1.0).otherwise(0.0)))).first()[0])


def transform(rows: DataFrame, axes: Axes | None, id_col: str = "vec_id", vector_col: str = "x") -> DataFrame:
    """A row (id, component, n, deviation, whitened, explained, identity_error) for each usable row and axis.

    deviation is a decimal(38, 0), exact. Rows that fit() leaves out, and all rows if there are no axes (no vectors, or
    all of them equal), have none. Null and repeated ids are kept as they are; other columns are ignored.
    """
    shape = "id long, deviation string, white array<double>"
    schema = f"{id_col} long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if axes is None or not len(axes.variances):
        return rows.sparkSession.createDataFrame([], schema)
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("x")).where(f"x is not null and size(x) = {axes.dim} and forall(x, v -> v is not null)")
    white = usable.mapInArrow(_whiten(axes), shape)
    error = identity_error(white.select("white"), axes.n)
    shares = F.array(*[F.lit(float(v / axes.trace)) for v in axes.variances])
    return white.select(F.col("id").alias(id_col), "deviation", F.posexplode("white").alias("i", "whitened")).select(
        id_col, (F.col("i") + 1).cast("int").alias("component"), F.lit(axes.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"),
    )
