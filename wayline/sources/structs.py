"""Struct payloads: poses, chassis speeds and counted arrays of module states, as packed little-endian doubles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _numbers(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


POSE, SPEEDS = _numbers("x", "y", "heading_deg"), _numbers("vx", "vy", "omega")
STATES = T.ArrayType(_numbers("speed", "angle_deg"))


def _doubles(raw: bytes | None, n: int, at: int = 0) -> np.ndarray | None:
    return np.frombuffer(raw, "<f8", n, at) if raw is not None and len(raw) >= at + 8 * n else None


@F.pandas_udf(POSE)
def pose2d(raw: pd.Series) -> pd.DataFrame:
    """Place and heading (from cosine and sine) of a pose of four doubles; null for a null or shorter payload."""
    rows = [(None,) * 3 if (d := _doubles(r, 4)) is None else (d[0], d[1], math.degrees(math.atan2(d[3], d[2]))) for r in raw]
    return pd.DataFrame(rows, columns=["x", "y", "heading_deg"], dtype=float)


@F.pandas_udf(SPEEDS)
def chassis_speeds(raw: pd.Series) -> pd.DataFrame:
    """Three speeds; null for a null or shorter payload."""
    rows = [(None,) * 3 if (d := _doubles(r, 3)) is None else tuple(d) for r in raw]
    return pd.DataFrame(rows, columns=["vx", "vy", "omega"], dtype=float)


@F.pandas_udf(STATES)
def module_states(raw: pd.Series) -> pd.Series:
    """Speed and angle of each module of a counted array; modules that the payload has no bytes for are left out, null for a null payload."""

    def one(r: bytes | None) -> list | None:
        if r is None:
            return None
        if len(r) < 4:
            return []
        n = min(int(np.frombuffer(r, "<u4", 1)[0]), (len(r) - 4) // 24)
        d = np.frombuffer(r, "<f8", 3 * n, 4).reshape(n, 3)
        return [{"speed": float(s), "angle_deg": math.degrees(math.atan2(q, c))} for s, c, q in d]

    return pd.Series([one(r) for r in raw], dtype=object)


def packed(counted: bool = False):
    """A function that packs an array of doubles, for counted arrays of threes with their number in front."""

    @F.pandas_udf(T.BinaryType())
    def pack(values: pd.Series) -> pd.Series:
        def one(v) -> bytes | None:
            if v is None:
                return None
            d = np.asarray(v, "<f8")
            return (np.uint32(len(d) // 3).astype("<u4").tobytes() if counted else b"") + d.tobytes()

        return pd.Series([one(v) for v in values], dtype=object)

    return pack
