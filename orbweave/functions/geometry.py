"""Column expressions of a periodic box: image distances, spheres, cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[float]
AXES = ("x", "y", "z")
#: Keeps a point on a face in the upper cell in spite of rounding; for reported cells only, never for join keys.
FACE = 1e-12


def nearest(d: Column, length: float) -> Column:
    """Image of a separation within half a box; exactly half stays."""
    half = F.lit(length / 2)
    return F.when(d > half, d - length).when(d < -half, d + length).otherwise(d)


def apart(d: Column, length: float) -> Column:
    """Size of the nearest image of a separation: |nearest(d)|, without branches."""
    a = F.abs(d)
    return F.least(a, F.abs(F.lit(float(length)) - a))


def distance2(a: Sequence[Column], b: Sequence[Column], box: Box) -> Column:
    return squares([apart(p - q, length) for p, q, length in zip(a, b, box, strict=True)])


def in_sphere(r2: Column, radius: float) -> Column:
    """The surface belongs to the sphere."""
    return r2 <= F.lit(radius * radius)


def wrapped(x: Column, length: float) -> Column:
    return F.pmod(x, F.lit(float(length)))


def cell_axis(x: Column, length: float, cells: int, face: float = 0.0) -> Column:
    at = F.floor(wrapped(x, length) * F.lit(cells / length) + F.lit(face))
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), at)).cast("int")


def cell_number(ijk: Sequence[Column], cells: Sequence[int]) -> Column:
    i, j, k = (c.cast("long") for c in ijk)
    return i * (cells[1] * cells[2]) + j * cells[2] + k


def point_cell(p: Sequence[Column], box: Box, cells: Sequence[int], face: float = FACE) -> Column:
    return cell_number([cell_axis(x, length, n, face) for x, length, n in zip(p, box, cells, strict=True)], cells)


def bucket_number(p: Sequence[Column], box: Box, cells: Sequence[int]) -> Column:
    """The converter's cell: no wrap, clipped into the grid."""
    axis = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x / F.lit(length / n)))) for x, length, n in zip(p, box, cells, strict=True)]
    return cell_number(axis, cells)


def inside_box(p: Sequence[Column], box: Box, low: float = 0.0) -> Column:
    """Half-open on every axis."""
    out = F.lit(True)
    for x, length in zip(p, box, strict=True):
        out = out & (x >= F.lit(low)) & (x < F.lit(float(length)))
    return out


def clamped(x: Column, length: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(math.nextafter(length, -math.inf))))


def to_centre(i: Column, point: Column, cells: int, length: float) -> Column:
    """Distance on one axis from a point to the middle of cell i, to rounding."""
    half = F.lit(length / 2)
    return half - F.abs(half - F.abs((i + 0.5) * F.lit(length / cells) - point))


def cell_gaps(centre: Sequence[Column], cells: Sequence[int], box: Box) -> tuple[Column, Column]:
    """Squares of the least and greatest distance to any place of a cell, from those to its middle; rounded outwards."""
    near, far = [], []
    for d, n, length in zip(centre, cells, box, strict=True):
        reach, slack = length / n / 2 + length * 1e-12, length * 1e-12
        near.append(F.greatest(d - reach, F.lit(0.0)))
        far.append(F.least(d + reach, F.lit(length / 2 + slack)))
    return squares(near), squares(far)


def squares(v: Sequence[Column]) -> Column:
    return v[0] * v[0] + v[1] * v[1] + v[2] * v[2]


def spheres_beyond(r2: Column, radii: Sequence[float]) -> Column:
    """How many of ascending radii a squared distance is beyond: the number of the first sphere that holds it, or their number."""
    return sum((~in_sphere(r2, r)).cast("int") for r in radii)
