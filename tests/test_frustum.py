"""The frustum join and the rasteriser by force, with turned cameras and faces partly outside, beside and behind them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cloud, frustum

CAMERA = "image_id long, cx double, cy double, cz double, f double, px double, py double, width int, height int, R array<double>"
FACE = "f_id long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz")


def turned(rng):
    q = np.linalg.qr(np.array([[rng.gauss(0, 1) for _ in range(3)] for _ in range(3)]))[0]
    return q * np.sign(np.linalg.det(q))


@pytest.fixture(scope="module")
def cameras(spark):
    rng = random.Random(3)
    rows = [(k, *(rng.uniform(-5, 5) for _ in range(3)), rng.choice((20.0, 35.0)), 15.5, 11.5, 32, 24, [float(x) for x in turned(rng).reshape(-1)]) for k in range(12)]
    return spark.createDataFrame(rows, CAMERA), rows


def meets(cam, p, radius):
    _, *c, f, px, py, w, h, R = cam
    q = np.array(R).reshape(3, 3) @ (np.array(p) - c)
    sides = [(q[0] * f + (px + 0.5) * q[2], px + 0.5), ((w - 0.5 - px) * q[2] - q[0] * f, w - 0.5 - px), (q[1] * f + (py + 0.5) * q[2], py + 0.5), ((h - 0.5 - py) * q[2] - q[1] * f, h - 0.5 - py)]
    return q[2] >= -radius and all(v >= -radius * math.hypot(f, e) for v, e in sides)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("levels", [2, 5])
def test_join(spark, cameras, levels):
    rng = random.Random(4)
    items = [(k, *(rng.uniform(-8, 8) for _ in range(3)), rng.choice((0.0, 0.01, 0.3, 2.0, 30.0))) for k in range(400)]
    rows = [*items, (900, None, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 0.0, 1.0)]
    df, cams = cameras
    found = frustum.joined(spark.createDataFrame(rows, "id long, x double, y double, z double, radius double"), df, levels)
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
    got = [tuple(r) for r in found.collect()]
    want = {(i, c[0]) for i, *p, radius in items for c in cams if meets(c, p, radius)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) < 0.7 * len(items) * len(cams)
    empty = spark.createDataFrame([], "id long, x double, y double, z double, radius double")
    assert frustum.joined(empty, df).count() == 0 and frustum.joined(spark.createDataFrame(rows[:5], empty.schema), df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, 2.0, 2.0, 2.0, 0.0), (2, 2.0, 2.0, 2.0, 0.0)], empty.schema)  # no extent
    assert {tuple(r) for r in frustum.joined(one, df).collect()} == {(i, c[0]) for i in (1, 2) for c in cams if meets(c, (2, 2, 2), 0.0)}


def by_ray(cams, faces, near, whole):
    """Each pixel's ray against each face, by solving for the point it hits."""
    out = {}
    for k, *c, f, px, py, w, h, R in cams:
        R = np.array(R).reshape(3, 3)
        for f_id, *p in faces:
            q = (np.array(p).reshape(3, 3) - c) @ R.T
            if whole:
                with np.errstate(all="ignore"):
                    u, v = px + f * q[:, 0] / q[:, 2], py + f * q[:, 1] / q[:, 2]
                if not ((q[:, 2] >= near).all() and (u >= -0.5).all() and (u <= w - 0.5).all() and (v >= -0.5).all() and (v <= h - 0.5).all()):
                    continue
            for r in range(h):
                for col in range(w):
                    m = np.column_stack([q[1] - q[0], q[2] - q[0], -np.array([(col - px) / f, (r - py) / f, 1.0])])
                    if abs(np.linalg.det(m)) < 1e-12:
                        continue
                    a, b, z = np.linalg.solve(m, -q[0])
                    if a >= 0 and b >= 0 and a + b <= 1 and z >= near and z < out.get((k, r, col), (math.inf,))[0]:
                        out[k, r, col] = (z, f_id)
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_rasterised(spark, cameras, whole):
    rng = random.Random(6)
    df, cams = cameras
    faces = []
    for k in range(25):
        centre = [rng.uniform(-6, 6) for _ in range(3)]
        spread = rng.choice((0.3, 1.5, 12.0)) if not whole else 0.8
        faces.append((k, *[c + rng.uniform(-spread, spread) for _ in range(3) for c in centre]))
    rows = [*faces, (50, *[1.0] * 9), (51, *[None] * 9)]
    found = frustum.rasterised(spark.createDataFrame(rows, FACE).repartition(3), df.filter("image_id < 4"), tile=16, whole=whole)
    got = {(r.image_id, r.r, r.c): (r.depth, r.f_id) for r in found.collect()}
    want = by_ray(cams[:4], faces, 1e-3, whole)
    assert got.keys() == want.keys() and len(want) > (10 if whole else 500)
    for k, (z, f_id) in want.items():
        assert got[k][1] == f_id and got[k][0] == pytest.approx(z)


def test_vertices_behind_a_face_are_not_seen(spark):
    cams = [(k, 0.5 * k, 0.0, 0.0, 300.0, 319.5, 239.5, 640, 480, None) for k in range(3)]
    square = [(-2, -2, 4), (2, -2, 4), (2, 2, 4), (-2, 2, 4)]
    hidden = [(0.1, 0.2, 6.0), (0.3, 0.2, 6.0), (0.2, 0.4, 6.0)]
    vertices = [(k, *map(float, p)) for k, p in enumerate(square + hidden)]
    faces = [(0, 0, 1, 2), (1, 0, 2, 3), (2, 4, 5, 6)]
    corners = spark.createDataFrame([(f, *[float(x) for v in vs for x in vertices[v][1:]]) for f, *vs in faces], FACE)
    df = spark.createDataFrame(cams, CAMERA).drop("R")
    found = frustum.vertex_views(corners, spark.createDataFrame(vertices, "v_id long, x double, y double, z double"), df).collect()
    assert {r.v_id for r in found} <= {0, 1, 2, 3}
    alone = frustum.vertex_views(corners.filter("f_id = 2"), spark.createDataFrame(vertices[4:], "v_id long, x double, y double, z double"), df).collect()
    assert {(r.v_id, r.image_id) for r in alone} == {(v, i) for v in (4, 5, 6) for i in range(3)}


def test_votes_with_turned_cameras(spark):
    """Turning scene and cameras together changes no vote."""
    rng = random.Random(9)
    points = [(k, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(5, 9)) for k in range(40)]
    points += [(100 + k, x / 2, y / 2, z / 2) for k, x, y, z in points[:15]]
    cams = [(i, 0.7 * i, 0.0, 0.0, 200.0, 99.5, 99.5, 200, 200, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]) for i in range(2)]
    seen = [(k, i, 1.0) for k, *_ in points[:40] for i in range(2)]
    T = turned(rng)
    move = lambda p: [float(x) for x in T @ np.array(p)]
    other = [(k, *move(p)) for k, *p in points], [(i, *move(c[:3]), *c[3:8], [float(x) for x in T.T.reshape(-1)]) for i, *c in cams]

    def votes(points, cams):
        found = cloud.visibility_votes(spark.createDataFrame(seen, "point_id long, image_id long, weight double"), spark.createDataFrame(points, "point_id long, x double, y double, z double"), spark.createDataFrame(cams, CAMERA))
        assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
        return found

    first = votes(points, cams)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, votes(*other).collect()))
    assert min(r.votes for r in first.collect()) < 0
    kept = cloud.visible_points(spark.createDataFrame(points, "point_id long, x double, y double, z double"), first, -1)
    assert kept.count() == first.filter(F.col("votes") > -1).count()
