"""Whole scenes: similarity transforms, normalisation, regions of interest, planes, chunks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geom as g
from tessera.operators.cloud import ranged


def transformed(points: DataFrame, scale: float, rotation: tuple, shift: tuple) -> DataFrame:
    """scale * rotation * p + shift; rotation is row-major."""
    q = g.rotate(list(rotation), g.vec("x", "y", "z"))
    return points.withColumns({n: F.lit(scale) * c + F.lit(t) for n, c, t in zip("xyz", q, shift, strict=True)})


def transformed_34(points: DataFrame, m: list[float]) -> DataFrame:
    """By a row-major 3 x 4 matrix, which has to scale all axes alike."""
    a = np.array(m, dtype=float).reshape(3, 4)
    s = np.linalg.norm(a[:, :3], axis=0)
    if not np.allclose(s, s[0], rtol=1e-6):
        raise ValueError("scales differ between axes")
    return transformed(points, float(s[0]), tuple(float(v) for v in (a[:, :3] / s[0]).reshape(-1)), tuple(float(v) for v in a[:, 3]))


def normalised(points: DataFrame) -> DataFrame:
    """Centred at the box's middle, the longest side of the box 1."""
    ends = points.agg(*[((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in "xyz"], F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("side"))
    rows = points.join(F.broadcast(ends))  # one row
    return rows.select("point_id", *[((F.col(c) - F.col(f"m{c}")) / F.col("side")).alias(c) for c in "xyz"])


def region_of_interest(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """The box of points before the median camera, nearer than twice the camera spread."""
    middle = cameras.agg(*[F.median(c).alias(f"m{c[1]}") for c in ("cx", "cy", "cz")])
    d = [F.col(f"c{c}") - F.col(f"m{c}") for c in "xyz"]
    radius = cameras.join(F.broadcast(middle)).groupBy("mx", "my", "mz").agg(F.max(g.norm(d)).alias("radius"))
    depth = F.col("z") - F.col("mz")
    near = points.join(F.broadcast(radius)).filter((depth > 0) & (depth < 2 * F.col("radius")))
    return near.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


def split_by_cells(points: DataFrame, size: float, most: int) -> DataFrame:
    """(gx, gy, n, chunk): grid cells in row order, cut into chunks of about `most` points; cells are summed range by range."""
    cells = points.groupBy(F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy")).agg(F.count(F.lit(1)).alias("n"))
    before = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("gy", "gx")) - F.col("n")
    return ranged(cells, "gy", "gx", weight=F.col("n")).select("gx", "gy", "n", F.floor(before / most).alias("chunk"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """scale, r00 .. r22, tx, ty, tz that take a(point_id, x, y, z) to b(point_id, x2, y2, z2) with least squares: one
    aggregate of sums and a 3 x 3 decomposition on the driver."""
    n1, n2 = ("x", "y", "z"), ("x2", "y2", "z2")
    sums = a.join(b, "point_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in (*n1, *n2)], *[F.covar_pop(p, q).alias(f"c_{p}_{q}") for p in n1 for q in n2], *[F.var_pop(p).alias(f"v_{p}") for p in n1]).collect()[0]
    if not sums["n"]:
        raise ValueError("no point is in both")
    cross = np.array([[sums[f"c_{p}_{q}"] for p in n1] for q in n2])
    u, d, vt = np.linalg.svd(cross)
    sign = np.diag([1, 1, math.copysign(1, np.linalg.det(u) * np.linalg.det(vt))])
    r = u @ sign @ vt
    s = float(np.trace(np.diag(d) @ sign) / sum(sums[f"v_{p}"] for p in n1))
    t = np.array([sums[f"m_{q}"] for q in n2]) - s * r @ np.array([sums[f"m_{p}"] for p in n1])
    row = [round(float(v), 6) + 0.0 for v in (s, *r.reshape(-1), *t)]
    return a.sparkSession.createDataFrame([tuple(row)], ["scale", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"])


def plane(points: DataFrame) -> DataFrame:
    """nx, ny, nz, d of the plane through the points with least squares, nz not negative: the eigenvector of the
    covariance with the least eigenvalue."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    m = points.agg(*[F.avg(c).alias(c) for c in "xyz"], *[F.covar_pop(p, q).alias(p + q) for p, q in pairs]).collect()[0]
    c = np.array([[m["xx"], m["xy"], m["xz"]], [m["xy"], m["yy"], m["yz"]], [m["xz"], m["yz"], m["zz"]]])
    n = np.linalg.eigh(c)[1][:, 0]
    n = n if n[2] >= 0 else -n
    d = -float(n @ np.array([m["x"], m["y"], m["z"]]))
    return points.sparkSession.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in (*n, d))], ["nx", "ny", "nz", "d"])


def robust_plane(points: DataFrame, threshold: float, tries: int = 64, seed: int = 5) -> DataFrame:
    """A plane by random hypotheses: triples of a bounded sample, all scored in one pass over the points, the best one
    refined on its inliers."""
    sample = points.orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(3 * tries).select("x", "y", "z").collect()
    p = np.array([tuple(r) for r in sample], dtype=float)
    p = p[: len(p) // 3 * 3].reshape(-1, 3, 3)
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    length = np.linalg.norm(n, axis=1)
    n, p = n[length > 1e-12] / length[length > 1e-12, None], p[length > 1e-12]
    d = -(n * p[:, 0]).sum(axis=1)
    off = lambda k: F.abs(F.lit(float(n[k, 0])) * F.col("x") + F.lit(float(n[k, 1])) * F.col("y") + F.lit(float(n[k, 2])) * F.col("z") + F.lit(float(d[k])))
    counts = points.agg(*[F.count_if(off(k) < threshold).alias(str(k)) for k in range(len(n))]).collect()[0]
    best = max(range(len(n)), key=lambda k: (counts[str(k)], -k))
    return plane(points.filter(off(best) < threshold))
