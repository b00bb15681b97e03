"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; if it is unset, one made here where all is one machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The same rows, written as compressed Parquet in the shared folder and read back."""
    path = shared_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of a text column, or of one row, so that few texts are Python objects at a time."""
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def mix64(values: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash, vectorised."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
    return x


_BASE = 0x5851F42D4C957F2D
_PIECE = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for one piece of text."""
    return powers(_BASE, _PIECE + 1), powers(pow(_BASE, -1, 2**64), _PIECE + 1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _piece_hashes(raw: np.ndarray, blank: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text: A-Z in lower case, words parted by space and \\t\\n\\v\\f\\r only.

    A word's hash is a polynomial over its UTF-8 bytes, made from running sums over the text, so the work is a few
    array operations, whatever the number of words. Long texts are done in pieces cut at white space, so memory
    besides the text is bounded (a single longer word gets tables of its own length).
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = _BLANK[raw]
    out, at = [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        up, down = _tables()
        if end < len(raw):
            gaps = np.flatnonzero(blank[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(blank[end:])
                end = end + int(rest[0]) if len(rest) else len(raw)
                up, down = powers(_BASE, end - at + 1), powers(pow(_BASE, -1, 2**64), end - at + 1)
        out.append(_piece_hashes(raw[at:end], blank[at:end], up, down))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Ascending distinct int64 hashes of the word shingles of a text; fewer words than the width form one shingle."""
    words = word_hashes(text or "")
    if not len(words):
        return words.view(np.int64)
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        mixed = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k]
    values = np.sort(mix64(mixed + np.uint64(width)).view(np.int64))
    return values[np.concatenate([[True], values[1:] != values[:-1]])]
