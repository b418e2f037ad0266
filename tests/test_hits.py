"""Nearest hits and nearest faces by force: rays along axes and borders, misses, ties, far points, nulls."""

import math
import random

import numpy as np
import pytest

from tessera.operators import hits

FACE = "f_id long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz")
RAY = "ray_id long, " + ", ".join(f"{k}{c} double" for k in "od" for c in "xyz")


@pytest.fixture(scope="module")
def faces():
    rng = random.Random(8)
    out = []
    for k in range(60):
        centre = [rng.uniform(-10, 10) for _ in range(3)]
        out.append((k, *[c + rng.uniform(-1.5, 1.5) for _ in range(3) for c in centre]))
    out += [(100, 0.0, 0.0, 5.0, 4.0, 0.0, 5.0, 0.0, 4.0, 5.0), (99, 0.0, 0.0, 5.0, 4.0, 0.0, 5.0, 0.0, 4.0, 5.0)]  # the same twice
    out.append((101, -30.0, -30.0, -12.0, 30.0, -30.0, -12.0, 0.0, 40.0, -12.0))  # large
    return out


def test_nearest_hits(spark, faces):
    rng = random.Random(1)
    rays = [(k, *(rng.uniform(-15, 15) for _ in range(3)), *(rng.gauss(0, 1) for _ in range(3))) for k in range(150)]
    rays += [(200, 1.0, 1.0, -3.0, 0.0, 0.0, 1.0), (201, 2.0, 0.5, 40.0, 0.0, 0.0, -2.0), (202, 0.0, 0.0, 9.0, 0.0, 0.0, -1.0), (203, 2.0, 2.0, 9.0, 0.0, 0.0, -0.5), (204, 1.0, 1.0, 9.0, 0.0, 0.0, 1.0), (205, 90.0, 90.0, 90.0, 1.0, 0.0, 0.0)]
    rows = [*rays, (300, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (301, None, 0.0, 0.0, 1.0, 0.0, 0.0)]
    want = {}
    for k, *v in rays:
        o, d = np.array(v[:3]), np.array(v[3:])
        found = []
        for f_id, *p in faces:
            a, b, c = np.array(p).reshape(3, 3)
            m = np.column_stack([b - a, c - a, -d])
            if abs(np.linalg.det(m)) > 1e-12:
                u, w, t = np.linalg.solve(m, o - a)
                if u >= -1e-9 and w >= -1e-9 and u + w <= 1 + 1e-9 and t >= 0:
                    found.append((round(t, 7), f_id))
        if found:
            want[k] = min(found)
    df, at = spark.createDataFrame([*faces, (500, *[None] * 9)], FACE), spark.createDataFrame(rows, RAY)
    for cell in (1.0, 7.0):
        got = {r.ray_id: (round(r.t, 7), r.f_id) for r in hits.nearest_hits(at, df, cell).collect()}
        assert got == want and want[200][1] == 99
    assert hits.nearest_hits(at, df.limit(0), 1.0).count() == 0 and hits.nearest_hits(at.limit(0), df, 1.0).count() == 0


def apart(q, p):
    """By the closest of points spread over the face, refined about the best."""
    a, b, c = np.array(p).reshape(3, 3)
    q, low, size = np.array(q), np.zeros(2), 1.0
    for _ in range(40):
        grid = np.linspace(0, size, 9)
        u, v = (x.ravel() for x in np.meshgrid(np.clip(low[0] + grid, 0, 1), np.clip(low[1] + grid, 0, 1)))
        over = u + v > 1
        u, v = np.where(over, u / (u + v + 1e-300), u), np.where(over, v / (u + v + 1e-300), v)
        d = np.linalg.norm(a + u[:, None] * (b - a) + v[:, None] * (c - a) - q, axis=1)
        k = d.argmin()
        low, size = np.maximum(np.array([u[k], v[k]]) - size / 4, 0), size / 2
    return d.min()


def test_nearest_faces(spark, faces):
    rng = random.Random(2)
    points = [(k, *(rng.uniform(-12, 12) for _ in range(3))) for k in range(40)] + [(90, 1.0, 1.0, 5.5), (91, 200.0, 0.0, 0.0)]
    got = {r.id: r for r in hits.nearest_faces(spark.createDataFrame([*points, (92, None, 0.0, 0.0)], "id long, x double, y double, z double"), spark.createDataFrame(faces, FACE), 2.0).collect()}
    assert got.keys() == {p[0] for p in points}
    place = {f[0]: f[1:] for f in faces}
    for k, *q in points:
        best = min(apart(q, p) for p in place.values())
        assert got[k].distance == pytest.approx(best, abs=1e-4) and apart(q, place[got[k].f_id]) == pytest.approx(best, abs=1e-4)
    assert got[90].f_id == 99 and got[90].distance == pytest.approx(0.5)
    assert hits.nearest_faces(spark.createDataFrame(points, "id long, x double, y double, z double"), spark.createDataFrame([], FACE), 2.0).count() == 0
    assert math.isclose(got[91].distance, apart((200.0, 0.0, 0.0), place[got[91].f_id]), abs_tol=1e-4)
