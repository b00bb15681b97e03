"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in blocks with one row per dimension. Products are summed some dimensions at a time; after each step the
mass that remains in the other dimensions (the product of both remainders' norms) bounds what a candidate can still
reach, and those below the k-th best score so far are compacted away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_CELLS = 1 << 17
QUERY_CELLS = 1 << 14
LANE_BLOCKS = 16
STEP = 16
GROUP = 16


def _blocks(cells: int):
    """Gather vectors of one length into blocks: their ids and, one dimension after the other, their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            lists = batch.column("vector")
            sizes = lists.value_lengths().to_numpy()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            rows = []
            for dim in np.unique(sizes):
                places = np.flatnonzero(sizes == dim)
                matrix = flat[(ends - sizes)[places][:, None] + np.arange(dim)[None, :]]
                # Large norms first, so that good thresholds come early.
                order = np.argsort(-np.square(matrix).sum(axis=1), kind="stable")
                places, matrix = places[order], matrix[order]
                step = max(1, cells // max(1, int(dim)))
                for at in range(0, len(places), step):
                    part = matrix[at : at + step]
                    rows.append((int(dim), ids[places[at : at + step]].astype("<i8").tobytes(), np.ascontiguousarray(part.T).astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["dim", "ids", "columns"]
            )

    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _as_long(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def _scan(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, best: list, k: int) -> None:
    """Bring the best (scores, ids) of each query up to date with one block of candidates."""
    dim, n = columns.shape
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(1, dim)
    if not top < 2**53:  # beyond what doubles add up exactly
        exact = [[int(x) for x in col] for col in columns.T]
        for j, q in enumerate(queries):
            whole = [int(x) for x in q]
            pairs = [(_as_long(sum(x * y for x, y in zip(whole, col))), int(i)) for col, i in zip(exact, ids) if i != query_ids[j]]
            merged = sorted([*pairs, *zip(map(int, best[j][0]), map(int, best[j][1]))], key=lambda x: (-x[0], x[1]))[:k]
            best[j] = (np.array([s for s, _ in merged], object), np.array([i for _, i in merged], np.int64))
        return
    marks = list(range(0, dim, STEP)) + [dim]
    rest = [np.sqrt(np.square(columns[a:]).sum(axis=0)) for a in marks]
    rest_q = [np.sqrt(np.square(queries[:, a:]).sum(axis=1)) for a in marks]
    for first in range(0, len(queries), GROUP):
        group = slice(first, min(first + GROUP, len(queries)))
        limit = np.array([float(b[0][-1]) if len(b[0]) == k else -np.inf for b in best[group]])
        alive, sums = np.arange(n), np.zeros((group.stop - first, n))
        for step, (a, b) in enumerate(zip(marks, marks[1:])):
            sums += queries[group, a:b] @ (columns[a:b] if len(alive) == n else columns[a:b][:, alive])
            reach = sums + rest_q[step + 1][group, None] * rest[step + 1][alive][None, :] * (1 + 1e-9) + 1e-6
            open_ = (reach >= limit[:, None]).any(axis=0)
            if not open_.all():
                alive, sums = alive[open_], sums[:, open_]
            if not len(alive):
                break
        found = ids[alive]
        for j in range(first, group.stop):
            row = sums[j - first]
            keep = (found != query_ids[j]) & (row >= limit[j - first])
            if keep.any():
                best[j] = _best(np.concatenate([best[j][0], row[keep]]), np.concatenate([best[j][1], found[keep]]), k)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query_ids, queries, best = None, None, None, []

        def result() -> pa.RecordBatch:
            rows = [(now, j, int(query_ids[j]), int(i), int(s)) for j, (scores, ids) in enumerate(best) for s, i in zip(scores, ids)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], ["block", "place", "query_id", "vec_id", "score"])

        for batch in batches:
            for block, dim, q_ids, q_columns, ids, columns in zip(*(batch.column(c) for c in ("block", "dim", "query_ids", "query_columns", "ids", "columns"))):
                if block.as_py() != now:
                    if now is not None:
                        yield result()
                    now, query_ids = block.as_py(), np.frombuffer(q_ids.as_buffer(), "<i8")
                    queries = np.ascontiguousarray(np.frombuffer(q_columns.as_buffer(), "<f8").reshape(dim.as_py(), len(query_ids)).T)
                    best = [(np.empty(0), np.empty(0, np.int64)) for _ in query_ids]
                own = np.frombuffer(ids.as_buffer(), "<i8")
                _scan(queries, query_ids, np.frombuffer(columns.as_buffer(), "<f8").reshape(dim.as_py(), len(own)), own, best, k)
        if now is not None:
            yield result()

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """Each query's k highest inner products: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Vectors have whole-numbered double components; scores are exact (one beyond a long is cut to its range first). A
    vector takes part if it and its id are not null and all components are finite; vectors of different lengths are not
    compared. Candidates with the query's own id are left out; a repeated query row is answered once for each row, and a
    repeated candidate row counts for each row. Fewer than k candidates give all of them, none no rows. Other columns
    are ignored.

    Candidates stay in blocks of BLOCK_CELLS components, dealt to lanes; each block of queries visits every lane and
    keeps its best over the lane, so the final ranking gets k rows per query and lane.
    """

    def usable(frame: DataFrame) -> DataFrame:
        rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return rows.where("id is not null and vector is not null and forall(vector, x -> x is not null and abs(x) < double('infinity'))")

    shape = "dim int, ids binary, columns binary"
    right = usable(candidates)
    cells = right.agg(F.coalesce(F.sum(F.size("vector") + 1), F.lit(0))).first()[0]
    lanes = max(8, cells // (BLOCK_CELLS * LANE_BLOCKS) + 1)
    right = right.mapInArrow(_blocks(BLOCK_CELLS), shape).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)))
    left = (
        usable(queries).mapInArrow(_blocks(QUERY_CELLS), shape)
        .withColumnsRenamed({"ids": "query_ids", "columns": "query_columns"})
        .withColumn("block", F.monotonically_increasing_id())
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)).cast("array<long>")))
    )
    pairs = left.join(right, ["lane", "dim"]).select("block", "dim", "query_ids", "query_columns", "ids", "columns")
    found = pairs.mapInArrow(_search(k), "block long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
