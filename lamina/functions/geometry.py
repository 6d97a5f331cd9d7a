"""Column helpers: vectors, affine maps, angles, cells, colours, kernels.

All stay inside generated code; none is a UDF. A vector is a triple of columns, an affine map
(a, b, c, d, e, f) takes (x, y) to (a x + b y + c, d x + e y + f).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]
Affine = Sequence[Column]


def cols(names: str, prefix: str = "", suffix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{n}{suffix}") for n in names.split()]


def sub(p: Vec, q: Vec) -> list[Column]:
    return [x - y for x, y in zip(p, q, strict=True)]


def dot(p: Vec, q: Vec) -> Column:
    first, *rest = [x * y for x, y in zip(p, q, strict=True)]
    for r in rest:
        first = first + r
    return first


def cross(p: Vec, q: Vec) -> list[Column]:
    (a, b, c), (x, y, z) = p, q
    return [b * z - c * y, c * x - a * z, a * y - b * x]


def length(p: Vec) -> Column:
    return F.sqrt(dot(p, p).cast("double"))


def normalised(p: Vec) -> list[Column]:
    """The unit vector; null (not NaN) for the zero vector."""
    n = F.nullif(length(p), F.lit(0.0))
    return [x / n for x in p]


def distance(p: Vec, q: Vec) -> Column:
    return length(sub(q, p))


def angle_between(p: Vec, q: Vec) -> Column:
    c = dot(p, q) / F.nullif(length(p) * length(q), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def compose(m: Affine, n: Affine) -> list[Column]:
    """The map that applies ``n`` first, then ``m``."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * s, a * q + b * t, a * r + b * u + c, d * p + e * s, d * q + e * t, d * r + e * u + f]


def apply(m: Affine, x: Column, y: Column) -> list[Column]:
    a, b, c, d, e, f = m
    return [a * x + b * y + c, d * x + e * y + f]


def rigid_inverse(m: Affine) -> list[Column]:
    """The inverse of a rotation and translation: the transposed rotation, and the translation turned back."""
    a, b, c, d, e, f = m
    return [a, d, -(a * c + d * f), b, e, -(b * c + e * f)]


def placement(m: Affine) -> list[Column]:
    """(x, y, angle) of a rigid map."""
    a, _, c, d, _, f = m
    return [c, f, F.atan2(d, a)]


def from_placement(x: Column, y: Column, angle: Column) -> list[Column]:
    return [F.cos(angle), -F.sin(angle), x, F.sin(angle), F.cos(angle), y]


def add_angle(a: Column, b: Column) -> Column:
    """The sum of two angles of at most half a turn each, in (-pi, pi]."""
    s = a + b
    return F.when(s > math.pi, s - 2 * math.pi).when(s <= -math.pi, s + 2 * math.pi).otherwise(s)


def half_up(x: Column) -> Column:
    """Rounds half up for x >= 0 and towards zero for x < 0, as patch lattices expect."""
    whole = x.cast("long")
    return F.when(x - whole < 0.5, whole).otherwise(whole + 1)


def div(x: Column, n: int) -> Column:
    """Integer division towards zero."""
    return F.try_divide(x - x % n, F.lit(n)).cast("long")


def cell(x: Column, size: int) -> Column:
    """The index of the cell of a coordinate; cells are alike on both sides of zero."""
    return F.floor(x / size).cast("long")


def project(p: Vec, plane: Sequence[Sequence[int]], unit: int = 1000) -> list[Column]:
    """Fixed-point coordinates in the frame of three integer vectors of length ``unit``."""
    return [div(p[0] * v[0] + p[1] * v[1] + p[2] * v[2], unit) for v in plane]


def plane_basis(u: Sequence[float], v: Sequence[float], unit: int = 1000) -> list[list[int]]:
    """Two vectors scaled to ``unit`` and their cross product, as integers."""

    def scaled(w):
        n = math.sqrt(sum(x * x for x in w))
        return [int(x * unit / n) for x in w]

    a, b = scaled(u), scaled(v)
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return [a, b, scaled(c)]


def unproject(local: Vec, plane: Sequence[Sequence[int]], unit: int = 1000) -> list[Column]:
    """The point with given coordinates in the frame of three vectors of length ``unit``: the inverse of the exact projection."""
    a, b, c = plane
    minor = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    rows = [minor(b, c), minor(c, a), minor(a, b)]
    volume = sum(x * y for x, y in zip(a, rows[0], strict=True))
    return [dot(local, [F.lit(unit * r[k] / volume) for r in rows]) for k in range(3)]


def rotation_between(p: Vec, q: Vec) -> list[list[Column]]:
    """The rotation matrix that turns the direction of p to that of q by the least angle; the identity for equal ones, null for opposite ones."""
    u, w = normalised(p), normalised(q)
    v, c = cross(u, w), dot(u, w)
    zero = F.lit(0.0)
    k = [[zero, -v[2], v[1]], [v[2], zero, -v[0]], [-v[1], v[0], zero]]
    turn = F.nullif(1 + c, F.lit(0.0))
    square = [[dot(k[i], [k[n][j] for n in range(3)]) for j in range(3)] for i in range(3)]
    return [[(1.0 if i == j else 0.0) + k[i][j] + square[i][j] / turn for j in range(3)] for i in range(3)]


def pack(x: Column, y: Column, z: Column, side: int = 1024) -> Column:
    """One long for a lattice point; coordinates from -1 to side - 2."""
    return ((y + 1) * side + x + 1) * side + z + 1


def unpack(key: Column, side: int = 1024) -> list[Column]:
    return [div(key, side) % side - 1, div(key, side * side) - 1, key % side - 1]


def patch_colour(pid: Column) -> list[Column]:
    """Display colour of a patch number; the factors are fixed values."""
    k = div(pid, 105)
    return [255 - 80 * (pid % 3) - k % 79, 255 - 40 * ((3 * pid) % 5) - k % 37, 255 - 26 * ((5 * pid) % 7) - k % 23]


def coordinate_colour(n: Column) -> list[Column]:
    """Three triangle waves over a running coordinate; the periods are fixed values."""
    out = []
    for period, shift in ((2000, 0), (2500, 1250), (3000, 1500)):
        m = (n + shift) % period
        half = period // 2
        out.append(96 + div(F.when(m >= half, period - m).otherwise(m) * 159, half))
    return out


def grey(v: Column, gain: int, base: int, scale: int) -> Column:
    """(gain * v + base) / scale, clamped to a byte."""
    return F.least(F.greatest(div(gain * v + base, scale), F.lit(0)), F.lit(255))


def barycentric(p: Vec, a: Vec, b: Vec, c: Vec) -> list[Column]:
    """Weights of three corners at a point of the plane; null for a flat triangle."""
    area = F.nullif((b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1]), F.lit(0))
    u = ((b[1] - c[1]) * (p[0] - c[0]) + (c[0] - b[0]) * (p[1] - c[1])) / area
    v = ((c[1] - a[1]) * (p[0] - c[0]) + (a[0] - c[0]) * (p[1] - c[1])) / area
    return [u, v, 1 - u - v]


def kernel(dist: Column, h: float, scale: float = 1.0) -> Column:
    """Quadratic smoothing kernel of support 2 h."""
    s = dist / h
    return F.when(s >= 2, 0.0).otherwise(scale * (0.25 * s * s - s + 1))


def kernel_slope(dist: Column, h: float, scale: float = 1.0) -> Column:
    """The factor of the separation vector in the kernel's gradient."""
    s = dist / h
    return F.when((s >= 2) | (dist == 0), 0.0).otherwise(scale * (0.5 * s - 1) / (h * dist))


def gaussian(radius: int, sigma: float) -> list[tuple[int, int, int, float]]:
    """(dz, dy, dx, weight) of a cubic Gaussian that sums to 1."""
    span = range(-radius, radius + 1)
    raw = [(z, y, x, math.exp(-(z * z + y * y + x * x) / (2 * sigma * sigma))) for z in span for y in span for x in span]
    total = sum(r[3] for r in raw)
    return [(z, y, x, w / total) for z, y, x, w in raw]
