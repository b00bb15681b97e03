"""Numeric arrays of poses, cameras and sensors as columns; an array that is too short gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions.geometry import normalize_angle

GRAVITY = 9.81
LEAST_TAG_AREA = 0.001

# Places (x, y, z in metres) of the tags 1 to 32 on the field.
TAG_PLACES = [
    (11.8779798, 7.4247756, 0.889),
    (11.9154194, 4.63804, 1.12395),
    (11.3118646, 4.3902376, 1.12395),
    (11.3118646, 4.0346376, 1.12395),
    (11.9154194, 3.4312352, 1.12395),
    (11.8779798, 0.6444996, 0.889),
    (11.9528844, 0.6444996, 0.889),
    (12.2710194, 3.4312352, 1.12395),
    (12.5191774, 3.6790376, 1.12395),
    (12.5191774, 4.0346376, 1.12395),
    (12.2710194, 4.63804, 1.12395),
    (11.9528844, 7.4247756, 0.889),
    (16.5333172, 7.4033126, 0.55245),
    (16.5333172, 6.9715126, 0.55245),
    (16.5329616, 4.3235626, 0.55245),
    (16.5329616, 3.8917626, 0.55245),
    (4.6630844, 0.6444996, 0.889),
    (4.6256194, 3.4312352, 1.12395),
    (5.2291742, 3.6790376, 1.12395),
    (5.2291742, 4.0346376, 1.12395),
    (4.6256194, 4.63804, 1.12395),
    (4.6630844, 7.4247756, 0.889),
    (4.5881798, 7.4247756, 0.889),
    (4.2700194, 4.63804, 1.12395),
    (4.0218614, 4.3902376, 1.12395),
    (4.0218614, 4.0346376, 1.12395),
    (4.2700194, 3.4312352, 1.12395),
    (4.5881798, 0.6444996, 0.889),
    (0.007747, 0.6659626, 0.55245),
    (0.007747, 1.0977626, 0.55245),
    (0.0080772, 3.7457126, 0.55245),
    (0.0080772, 4.1775126, 0.55245),
]


def _of(values: Column, least: int, **fields: Column) -> Column:
    return F.when(F.size(values) >= least, F.struct(*[c.alias(n) for n, c in fields.items()]))


def pose(values: Column) -> Column:
    """[x, y, degrees, ...] as struct(x, y, theta), theta in radians in (-pi, pi]."""
    return _of(values, 3, x=values[0], y=values[1], theta=normalize_angle(F.radians(values[2])))


def camera_pose(values: Column, area: Column) -> Column:
    """[x, y, z, roll, pitch, yaw, latency ms, tags, span, distance, area] as struct(x, y, theta, latency_us, confidence).

    Null without tags and for a pose of zeros. Confidence is .6 for a single tag, less for tags that are far away or
    small (area is that of the target at the same time, null if unknown). Tags and distance may be missing.
    """
    tags, distance = F.coalesce(F.get(values, F.lit(7)), F.lit(0.0)), F.get(values, F.lit(9))
    zero = (F.abs(values[0]) < 0.01) & (F.abs(values[1]) < 0.01) & (F.abs(values[5]) < 0.01)
    confidence = (
        F.when(tags < 1.5, F.lit(0.6)).otherwise(1.0) * F.when(area < LEAST_TAG_AREA, F.lit(0.3)).otherwise(1.0)
        * F.when(distance > 5, F.lit(0.5)).when(distance > 3, F.lit(0.8)).otherwise(1.0)
    )
    found = _of(values, 7, x=values[0], y=values[1], theta=normalize_angle(F.radians(values[5])), latency_us=(values[6] * 1000).cast("bigint"), confidence=confidence)
    return F.when(~zero & (tags >= 0.5), found)


def camera_accel(values: Column) -> Column:
    """Ten numbers of a camera's inertial unit as struct(ax, ay, az, gx, gy, gz), accelerations and gravity in m/s2."""
    return _of(values, 10, **{n: values[i] for n, i in zip(("ax", "ay", "az", "gx", "gy", "gz"), (0, 1, 2, 7, 8, 9))})


def hardware(values: Column) -> Column:
    """[temperature, CPU %, RAM %, frames a second] as a struct."""
    return _of(values, 4, temperature=values[0], cpu=values[1], ram=values[2], fps=values[3])


def target(values: Column) -> Column:
    """Seventeen numbers of a target as struct(long_side, short_side, width, height, skew, aspect); null if they aren't valid."""
    aspect = F.when(values[13] > 0, values[12] / values[13]).otherwise(0.0)
    found = _of(values, 17, long_side=values[12], short_side=values[13], width=values[14], height=values[15], skew=values[16], aspect=aspect)
    return F.when(values[0] >= 0.5, found)


def field_places(tags: Column) -> Column:
    """Places on the field of tag structs, in their order; unknown ids are left out, null if none is known."""
    layout = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", place)]) for place in TAG_PLACES])
    known = F.filter(F.transform(tags, lambda t: F.round(t["id"]).cast("int")), lambda i: (i >= 1) & (i <= len(TAG_PLACES)))
    return F.when(F.size(known) > 0, F.transform(known, lambda i: F.element_at(layout, i)))
