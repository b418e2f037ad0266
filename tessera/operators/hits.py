"""Nearest hits of rays with faces and nearest faces of points, by cells of a grid.

Faces (f_id, ax .. cz) are listed in the cells that they touch. A ray is the sequence of cells it crosses, looked at in
shells of growing length: a ray that has hit something in one is in none of the later ones. A point looks at the cells
about it, of growing size. All of it is equi-joins on cells and what a row says; only bounds and counts come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geom as g
from tessera.operators.cloud import _around
from tessera.operators.iterate import checkpointed

CELL = ["gx", "gy", "gz"]
#: Cells of a ray's first shell; the next are twice as long each.
SHELL = 16
#: Hits and distances are compared in steps of this, so that equal ones go to the lower id.
EQUAL = 1e-9


def corners_of(row: str = "") -> list[list[Column]]:
    return [[F.col(f"{row}{k}{c}") for c in "xyz"] for k in "abc"]


def listed(faces: DataFrame, cell: float) -> DataFrame:
    """faces with a row for each cell (gx, gy, gz) that holds some of its box and that its plane crosses."""
    p = corners_of()
    low, high = [F.least(*[q[i] for q in p]) for i in range(3)], [F.greatest(*[q[i] for q in p]) for i in range(3)]
    n = g.cross(g.minus(p[1], p[0]), g.minus(p[2], p[0]))
    rows = faces.withColumns({"nx": n[0], "ny": n[1], "nz": n[2]})
    for name, a, b in zip(CELL, low, high, strict=True):
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor(a / cell - EQUAL), F.floor(b / cell + EQUAL))))
    centre = [(F.col(c) + 0.5) * cell for c in CELL]
    normal = g.vec("nx", "ny", "nz")
    reach = reduce(lambda x, y: x + y, [F.abs(c) for c in normal]) * (cell / 2)
    return rows.filter(F.abs(g.dot(normal, g.minus(centre, p[0]))) <= reach * (1 + EQUAL) + EQUAL).drop("nx", "ny", "nz")


def crossed(start: Column, end: Column, cell: float) -> Column:
    """The cells, as (gx, gy, gz), that a ray (ox .. dz) is in between two of its parameters: those at the middles between
    successive crossings of cell borders. Where it runs along a border, those on both sides of it are given."""
    reached = lambda o, d: lambda k: F.try_divide(k * cell - o, d)
    ts = []
    for c in "xyz":
        o, d = F.col(f"o{c}"), F.col(f"d{c}")
        a, b = (o + start * d) / cell, (o + end * d) / cell
        borders = F.sequence(F.ceil(F.least(a, b)), F.greatest(F.floor(F.greatest(a, b)), F.ceil(F.least(a, b))))
        ts.append(F.when(d == 0, F.array().cast("array<double>")).otherwise(F.transform(borders, reached(o, d))))
    every = F.array_sort(F.filter(F.concat(F.array(start, end), *ts), lambda t: (t >= start) & (t <= end)))
    places = F.zip_with(F.slice(every, 1, F.size(every) - 1), F.slice(every, 2, F.size(every) - 1), lambda s, t: (s + t) / 2)
    at = lambda t, c, e: F.floor((F.col(f"o{c}") + t * F.col(f"d{c}")) / cell + e).alias(f"g{c}")
    return F.array_distinct(F.flatten(F.transform(places, lambda t: F.array(*[F.struct(*[at(t, c, e) for c, e in zip("xyz", es, strict=True)]) for es in ((-EQUAL,) * 3, (EQUAL,) * 3)]))))


def hit(o: g.Vec, d: g.Vec, p: list[list[Column]]) -> Column:
    """The parameter at which the ray o + t d meets the face p, null if it doesn't; edges belong to the face."""
    e1, e2 = g.minus(p[1], p[0]), g.minus(p[2], p[0])
    n = g.cross(d, e2)
    det = g.dot(e1, n)
    s = g.minus(o, p[0])
    m = g.cross(s, e1)
    u, v, t = (F.try_divide(x, det) for x in (g.dot(s, n), g.dot(d, m), g.dot(e2, m)))
    return F.when((u >= -EQUAL) & (v >= -EQUAL) & (u + v <= 1 + EQUAL) & (t >= 0), t)


def nearest_hits(rays: DataFrame, faces: DataFrame, cell: float) -> DataFrame:
    """(ray_id, f_id, t): the first face that each of rays(ray_id, ox .. dz) meets, at o + t d with t >= 0; the lower f_id
    of those at the same place. Rays that meet none, that have no direction, or a null, have no row."""
    names = [f"{k}{c}" for k in "od" for c in "xyz"]
    left = rays.select("ray_id", *[F.col(n).cast("double").alias(n) for n in names]).dropna().filter("dx <> 0 or dy <> 0 or dz <> 0")
    faces = faces.select("f_id", *[f"{k}{c}" for k in "abc" for c in "xyz"]).dropna()
    faces = checkpointed(faces)
    box = faces.agg(*[f(g_(F.col(f"a{c}"), F.col(f"b{c}"), F.col(f"c{c}"))).alias(f"{n}{c}") for c in "xyz" for n, f, g_ in (("low", F.min, F.least), ("high", F.max, F.greatest))]).collect()[0]
    if box["lowx"] is None:
        return left.select("ray_id", F.lit(0).cast("long").alias("f_id"), F.lit(0.0).alias("t")).limit(0)
    # where a ray enters and leaves the faces' box
    enter, leave = [F.lit(0.0)], []
    for c in "xyz":
        o, d, low, high = F.col(f"o{c}"), F.col(f"d{c}"), F.lit(box[f"low{c}"] - cell), F.lit(box[f"high{c}"] + cell)
        a, b = F.try_divide(low - o, d), F.try_divide(high - o, d)
        beside = (d == 0) & ((o < low) | (o > high))
        enter.append(F.when(d == 0, F.lit(0.0)).otherwise(F.least(a, b)))
        leave.append(F.when(beside, F.lit(-1.0)).when(d == 0, F.lit(math.inf)).otherwise(F.greatest(a, b)))
    pace = cell / g.norm(g.vec("dx", "dy", "dz"))
    left = checkpointed(left.withColumns({"start": F.greatest(*enter), "stop": F.least(*leave), "pace": pace}).filter("start <= stop"))
    cells = listed(faces, cell).hint("merge")  # Spark takes rays for as few as before they are spread over their cells
    out, length = None, SHELL
    while not left.isEmpty():
        shell = left.withColumn("end", F.least(F.col("start") + length * F.col("pace"), F.col("stop")))
        at = shell.select("ray_id", *names, "end", F.inline(crossed(F.col("start"), F.col("end"), cell)))
        t = hit(g.vec("ox", "oy", "oz"), g.vec("dx", "dy", "dz"), corners_of())
        met = at.join(cells, CELL).withColumn("t", t).filter(F.col("t") <= F.col("end") * (1 + EQUAL))
        found = checkpointed(met.groupBy("ray_id").agg(F.min(F.struct(F.floor(F.col("t") / EQUAL + 0.5).alias("k"), F.col("f_id"), F.col("t"))).alias("m")).select("ray_id", "m.f_id", "m.t"))
        out = found if out is None else out.unionByName(found)
        left = checkpointed(shell.join(found.hint("merge"), "ray_id", "left_anti").withColumn("start", F.col("end")).drop("end").filter("start < stop"))
        length *= 2
    return out if out is not None else left.select("ray_id", F.lit(0).cast("long").alias("f_id"), F.lit(0.0).alias("t"))


def _squared_to_faces(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The squared distances of points (row, axis) and faces (row, corner, axis): to a face's plane if the foot lies in the
    face, else to the nearest edge."""
    dot = lambda a, b: (a * b).sum(axis=1)
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    within, edges = dot(n, n) > 0, np.full(len(q), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(3):
            along, off = p[:, (i + 1) % 3] - p[:, i], q - p[:, i]
            within &= dot(n, np.cross(along, off)) >= 0
            length = dot(along, along)
            t = np.where(length > 0, np.clip(dot(off, along) / length, 0.0, 1.0), 0.0)
            rest = off - t[:, None] * along
            edges = np.minimum(edges, dot(rest, rest))
        return np.where(within, dot(n, q - p[:, 0]) ** 2 / dot(n, n), edges)


def nearest_faces(points: DataFrame, faces: DataFrame, cell: float) -> DataFrame:
    """(id, f_id, distance): the face nearest to each of points(id, x, y, z); the lower f_id of those at the same distance.
    A point looks at the faces in the cells about its own, of half the side at first; where none is within a cell's side,
    at those of twice the side. Rows with a null have no row; without faces there is none."""
    left = points.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).dropna()
    faces = faces.select("f_id", *[f"{k}{c}" for k in "abc" for c in "xyz"]).dropna()
    none = left.select("id", F.lit(0).cast("long").alias("f_id"), F.lit(0.0).alias("distance")).limit(0)
    faces = checkpointed(faces)
    if faces.isEmpty():
        return none

    def measured(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(k).to_numpy() for k in range(2, 14)], axis=1)
            d = np.sqrt(_squared_to_faces(values[:, :3], values[:, 3:].reshape(-1, 3, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["id", "f_id", "d"])

    kinds = dict(left.dtypes) | dict(faces.dtypes)
    out, left, cell = none, checkpointed(left), cell / 2
    while not left.isEmpty():
        at = _around(left.withColumns({f"g{c}": F.floor(F.col(c) / cell) for c in "xyz"}))
        pairs = at.join(listed(faces, cell).hint("merge"), CELL).select("id", "f_id", "x", "y", "z", *[F.col(f"{k}{c}").cast("double") for k in "abc" for c in "xyz"])
        met = pairs.mapInArrow(measured, f"id {kinds['id']}, f_id {kinds['f_id']}, d double").filter(F.col("d") <= cell)
        found = checkpointed(met.groupBy("id").agg(F.min(F.struct(F.floor(F.col("d") / EQUAL + 0.5).alias("k"), F.col("f_id"), F.col("d"))).alias("m")).select("id", "m.f_id", F.col("m.d").alias("distance")))
        out = out.unionByName(found)
        left = checkpointed(left.join(found.hint("merge"), "id", "left_anti"))
        cell *= 2
    return out
