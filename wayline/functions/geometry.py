"""Angles, grids and array decoding as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
# Eight directions of 45 degrees, the first around 0.
OCTANTS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
CELL_M, CELLS_X, CELLS_Y = 0.5, 34, 17


def normalize_angle(a: Column) -> Column:
    """Radians in (-pi, pi]."""
    m = F.pmod(a, F.lit(TWO_PI))
    return F.when(m > math.pi, m - TWO_PI).otherwise(m)


def angle_diff(a: Column, b: Column) -> Column:
    """a - b in radians in [-pi, pi)."""
    return F.pmod(a - b + math.pi, F.lit(TWO_PI)) - math.pi


def yaw_diff_deg(a: Column, b: Column) -> Column:
    """a - b in degrees in [-180, 180)."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def octant(degrees: Column) -> Column:
    place = F.floor(F.pmod(degrees + 22.5, F.lit(360.0)) / 45).cast("int")
    return F.element_at(F.array(*map(F.lit, OCTANTS)), place + 1)


def widest_separation_deg(bearings: Column) -> Column:
    """The largest angle between two of a few bearings in degrees, the shorter way round the circle; 0 for fewer than two, null for null."""
    apart = lambda a, b: F.least(F.pmod(a - b, F.lit(360.0)), F.pmod(b - a, F.lit(360.0)))
    return F.coalesce(F.array_max(F.transform(bearings, lambda a: F.array_max(F.transform(bearings, lambda b: apart(a, b))))), F.when(bearings.isNotNull(), F.lit(0.0)))


def single_sigma(n: Column, mean_dist: Column, worst_ambiguity: Column, shape: Column, base: float = 0.09, penalty: float = 1.0) -> Column:
    """Uncertainty of a measurement from one picture: base * shape, blown up by ambiguity; null where it isn't to be used, that is too ambiguous (0.4) or a single tag too far away (2 m)."""
    usable = (worst_ambiguity < 0.4) & ((n > 1) | (mean_dist <= 2))
    return F.when(usable, base * shape / F.pow(1 - worst_ambiguity, F.lit(2.0)) * penalty)


def field_cell(x: Column, y: Column) -> Column:
    """Number of the half-metre cell, truncated toward zero; null off the grid."""
    cx, cy = (x / CELL_M).cast("int"), (y / CELL_M).cast("int")
    return F.when((cx >= 0) & (cx < CELLS_X) & (cy >= 0) & (cy < CELLS_Y), cy * CELLS_X + cx)


def quaternion(roll: Column, pitch: Column, yaw: Column) -> Column:
    """struct(qw, qx, qy, qz) of ZYX angles in degrees."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(F.radians(a) / 2), F.sin(F.radians(a) / 2)) for a in (roll, pitch, yaw))
    return F.struct(
        (cr * cp * cy + sr * sp * sy).alias("qw"), (sr * cp * cy - cr * sp * sy).alias("qx"),
        (cr * sp * cy + sr * cp * sy).alias("qy"), (cr * cp * sy - sr * sp * cy).alias("qz"),
    )


def tag_structs(values: Column) -> Column:
    """Groups of seven numbers as structs; ids outside 0..100 and a partial last group are left out."""
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(values) / 7).cast("int"), F.lit(1)) - 1), lambda i: F.slice(values, i * 7 + 1, 7))
    whole = F.filter(groups, lambda g: (F.size(g) == 7) & (g[0] >= 0) & (g[0] <= 100))
    names = ["id", "tx", "ty", "area", "dist_camera", "dist_robot", "ambiguity"]
    return F.transform(whole, lambda g: F.struct(*[g[i].alias(n) for i, n in enumerate(names)]))
