"""Geometry as column expressions, in doubles. Integer pixel coordinates are pixel centres."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = Sequence[Column]


def vec(*names: str, of: str = "") -> list[Column]:
    return [F.col(f"{of}{n}") for n in names]


def minus(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(add, [x * y for x, y in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(minus(a, b))


def cosine(a: Vec, b: Vec) -> Column:
    """Clamped, so that acos is safe; null for a zero vector."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b))))


def rotate(r: Sequence, p: Vec) -> list[Column]:
    """The row-major 3 x 3 matrix r, of numbers or columns, times p."""
    return [F.lit(r[3 * i]) * p[0] + F.lit(r[3 * i + 1]) * p[1] + F.lit(r[3 * i + 2]) * p[2] for i in range(3)]


def posed(cameras: DataFrame) -> DataFrame:
    """Cameras whose rotation from world to camera, R if they have one, is named so that a row number r can stand beside
    it."""
    return cameras.withColumnRenamed("R", "rotation") if "R" in cameras.columns else cameras


def rotation(columns: Sequence[str]) -> list[Column] | None:
    """The entries of a posed camera's rotation; None if it has none, which is no turn."""
    return [F.get("rotation", F.lit(i)) for i in range(9)] if "rotation" in columns else None


def to_camera(p: Vec, centre: Vec, r: Sequence | None = None) -> list[Column]:
    return minus(p, centre) if r is None else rotate(r, minus(p, centre))


def project(q: Vec, f: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """Pixel of a point in camera coordinates; null in the plane of the centre."""
    return px + F.try_divide(f * q[0], q[2]), py + F.try_divide(f * q[1], q[2])


def back_project(u: Column, v: Column, depth: Column, f: Column, px: Column, py: Column, centre: Vec, r: Sequence | None = None) -> list[Column]:
    """World point of a pixel and its depth; without r for a camera that looks along z."""
    q = [(u - px) * depth / f, (v - py) * depth / f, depth]
    if r is not None:
        q = rotate([r[3 * j + i] for i in range(3) for j in range(3)], q)
    return [a + b for a, b in zip(q, centre, strict=True)]


def ray(u: Column, v: Column, f: Column, px: Column, py: Column, r: Sequence | None = None) -> list[Column]:
    """Direction in the world from a camera through its pixel, 1 along its axis."""
    return back_project(u, v, F.lit(1.0), f, px, py, [F.lit(0.0)] * 3, r)


def to_pixel(x: Column) -> Column:
    """Rounding to integers as pixels need it: floor(x + 0.5)."""
    return F.floor(x + 0.5)


def inside_image(u: Column, v: Column, width: Column, height: Column) -> Column:
    return (u >= 0) & (v >= 0) & (u < width) & (v < height)


def depth_similar(reference: Column, other: Column, threshold: float = 0.01) -> Column:
    """Relative to the first argument: not symmetric."""
    return F.abs(reference - other) / reference < threshold


def normal_similar(a: Vec, b: Vec, least_cosine: float = 0.996194698) -> Column:
    return dot(a, b) > least_cosine


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) / 2


def signed_volume(a: Vec, b: Vec, c: Vec) -> Column:
    """Of the tetrahedron with the origin."""
    return dot(a, cross(b, c)) / 6


def triangle_quality(a: Vec, b: Vec, c: Vec) -> Column:
    e1, e2, e3 = minus(b, a), minus(c, a), minus(c, b)
    return F.try_divide(norm(cross(e1, e2)), F.greatest(dot(e1, e1), dot(e2, e2), dot(e3, e3)))


def barycentric(p: tuple[Column, Column], a: tuple, b: tuple, c: tuple) -> list[Column]:
    """Weights of a, b, c at p, in the plane."""
    det = (a[0] - c[0]) * (b[1] - c[1]) - (b[0] - c[0]) * (a[1] - c[1])
    wa = ((b[1] - c[1]) * (p[0] - c[0]) - (b[0] - c[0]) * (p[1] - c[1])) / det
    wb = ((a[0] - c[0]) * (p[1] - c[1]) - (a[1] - c[1]) * (p[0] - c[0])) / det
    return [wa, wb, 1 - wa - wb]


def perspective(weights: Vec, z: Vec) -> list[Column]:
    """Barycentric weights in space from those in the image, and the three depths."""
    w = [weights[0] * z[1] * z[2], weights[1] * z[0] * z[2], weights[2] * z[0] * z[1]]
    total = w[0] + w[1] + w[2]
    return [x / total for x in w]


def plane_distance(p: Vec, normal: Vec, offset: Column) -> Column:
    """Signed distance to the plane normal . x + offset = 0; the normal has length 1."""
    return dot(normal, p) + offset


def on_plane(p: Vec, normal: Vec, offset: Column) -> list[Column]:
    """The point of the plane that is closest to p."""
    d = plane_distance(p, normal, offset)
    return [x - n * d for x, n in zip(p, normal, strict=True)]


def ray_plane(origin: Vec, direction: Vec, normal: Vec, offset: Column) -> Column:
    """How far along the ray it meets the plane, in lengths of direction; null for a parallel ray."""
    return F.try_divide(-plane_distance(origin, normal, offset), dot(normal, direction))


def in_box(p: Vec, low: Sequence, high: Sequence) -> Column:
    tests = [(x >= a) & (x <= b) for x, a, b in zip(p, low, high, strict=True)]
    return tests[0] & tests[1] & tests[2]


def boxes_meet(low: Vec, high: Vec, low_2: Vec, high_2: Vec) -> Column:
    """Of two boxes; the second's upper faces don't belong to it."""
    tests = [(b >= c) & (a < d) for a, b, c, d in zip(low, high, low_2, high_2, strict=True)]
    return tests[0] & tests[1] & tests[2]


def enlarged(low: Vec, high: Vec, factor: float = 1.0, by: float = 0.0) -> tuple[list[Column], list[Column]]:
    """A box whose size is factor times as much and then `by` more on every side, about the same middle."""
    out = [((a + b) / 2, (b - a) * factor / 2 + by) for a, b in zip(low, high, strict=True)]
    return [m - h for m, h in out], [m + h for m, h in out]


def in_oriented_box(p: Vec, r: Sequence[float], centre: Sequence[float], half: Sequence[float]) -> Column:
    q = rotate(r, [x - F.lit(c) for x, c in zip(p, centre, strict=True)])
    return (F.abs(q[0]) <= half[0]) & (F.abs(q[1]) <= half[1]) & (F.abs(q[2]) <= half[2])


def in_cone(p: Vec, apex: Vec, direction: Vec, cos_angle: Column, low: Column, high: Column) -> Column:
    """direction has length 1; low and high bound the height."""
    d = minus(p, apex)
    t = dot(direction, d)
    return (t >= low) & (t <= high) & (t * t > cos_angle * cos_angle * dot(d, d))


def field_of_view(size: Column, f: Column) -> Column:
    return 2 * F.atan(size / (2 * f))


def max_resolution(width: Column, height: Column, level: int, least: int, cap: int) -> Column:
    """The greater side halved `level` times, fewer if it fell below `least`, and capped."""
    side = F.greatest(width, height)
    if level == 0:
        return F.least(side, F.lit(cap))
    tries = [F.when(F.shiftright(side, k) >= least, F.shiftright(side, k)) for k in range(level, 0, -1)]
    return F.least(F.coalesce(*tries, side), F.lit(cap))


def to_angles(n: Vec) -> tuple[Column, Column]:
    """A direction as two angles, and back."""
    return F.atan2(n[1], n[0]), F.acos(n[2])


def from_angles(a: Column, b: Column) -> list[Column]:
    return [F.cos(a) * F.sin(b), F.sin(a) * F.sin(b), F.cos(b)]


def texture_share(x: Column, y: Column, width: Column, height: Column, flip: bool = True) -> tuple[Column, Column]:
    """Texture coordinates from pixels of a texture, whose integers are pixel centres; with flip from the lower edge."""
    v = (y + 0.5) / height
    return (x + 0.5) / width, 1 - v if flip else v


def texture_pixel(u: Column, v: Column, width: Column, height: Column, flip: bool = True) -> tuple[Column, Column]:
    """Back from texture_share."""
    return u * width - 0.5, (1 - v if flip else v) * height - 0.5


def luma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """RGB to Y, Cb, Cr (BT.601 weights, centred chroma)."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, 128 + 0.564 * (b - y), 128 + 0.713 * (r - y)


def robust_norm(kind: str, r: Column, s: float = 1.0) -> Column:
    """The residual that stands for r in least squares, at threshold s."""
    size, square = F.abs(r), r * r
    if kind == "l1":
        return r / (F.sqrt(size) + 1e-12)
    if kind == "exponential":
        return r * F.exp(-square / (2 * s * s))
    if kind == "blake_zisserman":
        return -F.log(F.exp(-square / s) + math.exp(-s * s))
    if kind == "huber":
        return F.when(size <= s, r).otherwise(F.signum(r) * F.sqrt(F.greatest(s * (2 * size - s), F.lit(0.0))))
    if kind == "pseudo_huber":
        return F.sqrt(2 * s * s * (F.sqrt(1 + square / (s * s)) - 1))
    if kind == "geman_mcclure":
        return r * F.sqrt(s * s / (s * s + square))
    if kind == "cauchy":
        return F.sqrt(s * s * F.log(1 + square / (s * s)))
    if kind == "tukey":
        most = s**3 / 6
        return F.when(size < s, F.sqrt(most * (1 - F.pow(1 - square / (s * s), 3)))).otherwise(math.sqrt(most))
    raise ValueError(kind)


def sub_pixel(kind: str, before: Column, here: Column, after: Column) -> Column:
    """Offset of a cost minimum from the costs around it."""
    left, right = before - here, after - here
    x = F.try_divide(F.least(left, right), F.greatest(left, right))
    shape = {"linear": lambda x: x / 2, "poly4": lambda x: (F.pow(x, 4) + x) / 4, "parabola": lambda x: x / (x + 1), "sine": lambda x: (F.sin(F.lit(3.141592653589793 / 2) * (x - 1)) + 1) / 2, "cosine": lambda x: (1 - F.cos(x * (3.141592653589793 / 3)))}[kind](x)
    return F.coalesce((shape - 0.5) * F.when(left < right, 1.0).otherwise(-1.0), F.lit(0.0))
