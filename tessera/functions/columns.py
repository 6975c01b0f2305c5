"""Geometry and time as Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]

NANOS = 1_000_000_000


def vector(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def literal(values: Sequence[float]) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(add, (x * y for x, y in zip(a, b, strict=True)))


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Vector, b: Vector) -> Column:
    return reduce(add, ((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def box_distance(p: Vector, low: Vector, high: Vector) -> Column:
    """Squared distance of a point to a closed box, 0 inside."""
    gaps = [F.greatest(lo - x, x - hi, F.lit(0.0)) for x, lo, hi in zip(p, low, high, strict=True)]
    return dot(gaps, gaps)


def finite(a: Vector) -> Column:
    """True if no component is null, NaN or infinite."""
    each = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in a]
    return reduce(lambda x, y: x & y, each)


def in_box(p: Vector, low: Sequence[float], high: Sequence[float]) -> Column:
    """True within the closed box."""
    return reduce(lambda x, y: x & y, (c.between(float(lo), float(hi)) for c, lo, hi in zip(p, low, high, strict=True)))


def skew(v: Vector) -> list[list[Column]]:
    """The matrix whose product with w is v x w."""
    zero = F.lit(0.0)
    return [[zero, -v[2], v[1]], [v[2], zero, -v[0]], [-v[1], v[0], zero]]


def rotation(rows: Sequence[Sequence[float]]) -> list[list[Column]]:
    return [literal(r) for r in rows]


def rigid(matrix: Sequence[Vector], p: Vector, shift: Vector) -> list[Column]:
    """matrix p + shift."""
    return [dot(r, p) + t for r, t in zip(matrix, shift, strict=True)]


# --- quaternions (w, x, y, z) ----------------------------------------------------------------------------------


def quat_multiply(a: Vector, b: Vector) -> list[Column]:
    c = cross(a[1:], b[1:])
    return [a[0] * b[0] - dot(a[1:], b[1:]), *(a[0] * y + b[0] * x + z for x, y, z in zip(a[1:], b[1:], c, strict=True))]


def quat_rotate(q: Vector, v: Vector) -> list[Column]:
    """v turned by the unit quaternion q."""
    t = [2.0 * c for c in cross(q[1:], v)]
    return [x + q[0] * y + z for x, y, z in zip(v, t, cross(q[1:], t), strict=True)]


def quat_conjugate(q: Vector) -> list[Column]:
    return [q[0], *(-c for c in q[1:])]


def quat_normalise(q: Vector) -> list[Column]:
    n = norm(q)
    return [c / n for c in q]


def quat_slerp(a: Vector, b: Vector, alpha: Column) -> list[Column]:
    """The shorter great arc from a to b; near-equal ends are interpolated linearly."""
    cosine = dot(a, b)
    sign = F.when(cosine < 0, -1.0).otherwise(1.0)
    c = F.least(F.abs(cosine), F.lit(1.0))
    angle = F.acos(c)
    sine = F.sin(angle)
    near = c > 1.0 - 1e-12
    wa = F.when(near, 1.0 - alpha).otherwise(F.sin((1.0 - alpha) * angle) / sine)
    wb = F.when(near, alpha).otherwise(F.sin(alpha * angle) / sine) * sign
    return [wa * x + wb * y for x, y in zip(a, b, strict=True)]


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    return a + alpha * (b - a)


# --- directions ------------------------------------------------------------------------------------------------

#: Fixed value: a direction is seeded with the x axis where its z share reaches this.
SEED_SWITCH = 0.9


def tangent_basis(g: Vector) -> tuple[list[Column], list[Column]]:
    """Two unit vectors that span the plane across g: Gram-Schmidt from the z axis, or x where g is near z."""
    n = norm(g)
    u = [c / n for c in g]
    steep = F.abs(u[2]) >= SEED_SWITCH
    seed = [F.when(steep, 1.0).otherwise(0.0), F.lit(0.0), F.when(steep, 0.0).otherwise(1.0)]
    along = dot(seed, u)
    raw = [s - along * c for s, c in zip(seed, u, strict=True)]
    m = norm(raw)
    first = [c / m for c in raw]
    return first, cross(u, first)


# --- time ------------------------------------------------------------------------------------------------------


def nanos_of(ts: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp with or without time zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def nanos(secs: Column, nsecs: Column) -> Column:
    return secs.cast("long") * NANOS + nsecs.cast("long")


def seconds(stamp: Column) -> Column:
    return F.floor(stamp / NANOS).cast("long")


def seconds_of(stamp: Column) -> Column:
    """Floating-point seconds of a nanosecond stamp."""
    return stamp / float(NANOS)


def remainder_nanos(stamp: Column) -> Column:
    return F.pmod(stamp, F.lit(NANOS))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


# --- voxels ----------------------------------------------------------------------------------------------------

#: Bits of a packed voxel coordinate and the bias that makes it non-negative.
PACK_BITS, PACK_BIAS = 21, 1 << 20


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def packed_cell(cells: Vector) -> Column:
    """Three cell numbers in one long, x lowest; numbers beyond 2**20 wrap around."""
    parts = [(c + PACK_BIAS).bitwiseAND(F.lit((1 << PACK_BITS) - 1)) for c in cells]
    return F.shiftleft(parts[2], 2 * PACK_BITS).bitwiseOR(F.shiftleft(parts[1], PACK_BITS)).bitwiseOR(parts[0])


# --- colours ---------------------------------------------------------------------------------------------------

#: Heights at the ends of the colour ramp.
RAMP = (-2.0, 30.0)


def hue_colour(share: Column) -> list[Column]:
    """Red, green, blue (0 to 255, fractions cut off) along the ramp blue, cyan, green, yellow, red for a share of 0 to 1."""
    s = clamp(share, 0.0, 1.0) * 4.0
    up = lambda at: clamp(s - at, 0.0, 1.0)
    return [(255.0 * c).cast("int") for c in (up(2.0), F.when(s < 2.0, up(0.0)).otherwise(1.0 - up(3.0)), 1.0 - up(1.0))]


def height_colour(z: Column) -> list[Column]:
    return hue_colour((z - RAMP[0]) / (RAMP[1] - RAMP[0]))
