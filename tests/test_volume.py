"""The surface of a sphere and a torus from their distances, and of depth maps of a sphere."""

import math

import numpy as np
import pytest

from tessera.operators import mesh, volume


def test_tetrahedra_fill_the_cube():
    corner = lambda k: np.array(volume._offset(k), float)
    size = [abs(np.linalg.det(np.array([corner(k) - corner(t[0]) for k in t[1:]]))) / 6 for t in volume._tetrahedra()]
    assert size == pytest.approx([1 / 6] * 6)


@pytest.mark.parametrize("name, genus", [("sphere", 0), ("torus", 1)])
def test_surface(spark, name, genus):
    step, r = 0.25, range(-8, 8)
    at = lambda v: (np.array(v) + 0.5) * step
    distance = {"sphere": lambda p: np.linalg.norm(p) - 1.3, "torus": lambda p: math.hypot(math.hypot(p[0], p[1]) - 1.1, p[2]) - 0.45}[name]
    rows = [(x, y, z, float(distance(at((x, y, z))))) for x in r for y in r for z in r]
    vertices, faces = volume.surface(spark.createDataFrame(rows, "vx long, vy long, vz long, value double"), step)
    assert mesh.watertight(faces).collect()[0].watertight
    place = {v.v_id: np.array([v.x, v.y, v.z]) for v in vertices.collect()}
    found = faces.collect()
    assert len(place) == len({tuple(v) for v in place.values()}) and len(place) - len(found) / 2 == 2 - 2 * genus
    assert max(abs(distance(p)) for p in place.values()) < 0.06
    size = sum(place[f.a] @ np.cross(place[f.b], place[f.c]) for f in found) / 6
    want = 4 / 3 * math.pi * 1.3**3 if not genus else 2 * math.pi**2 * 1.1 * 0.45**2
    assert size == pytest.approx(want, rel=0.07)  # positive: faces look outwards


def test_depth_maps_of_a_sphere(spark):
    ways = [np.array(w, float) / np.linalg.norm(w) for w in [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)] + [(a, b, c) for a in (1, -1) for b in (1, -1) for c in (1, -1)]]
    cams, pixels = [], []
    for k, w in enumerate(ways):
        z = -w
        x = np.cross([0.1, 0.9, 0.3], z)
        x /= np.linalg.norm(x)
        R, C = np.stack([x, np.cross(z, x), z]), 6 * w
        cams.append((k, *map(float, C), 90.0, 19.5, 19.5, 40, 40, [float(v) for v in R.reshape(-1)]))
        for r in range(40):
            for c in range(40):
                ray = np.array([(c - 19.5) / 90, (r - 19.5) / 90, 1.0])
                d = R.T @ ray
                a, b, e = d @ d, 2 * C @ d, C @ C - 1
                if b * b > 4 * a * e:
                    pixels.append((k, r, c, float((-b - math.sqrt(b * b - 4 * a * e)) / (2 * a))))
    depth = spark.createDataFrame(pixels, "image_id long, r int, c int, depth double")
    cameras = spark.createDataFrame(cams, "image_id long, cx double, cy double, cz double, f double, px double, py double, width int, height int, R array<double>")
    vertices, faces = volume.mesh_of(depth, cameras, voxel=0.12)
    p = np.array([[v.x, v.y, v.z] for v in vertices.collect()])
    near = np.abs(np.linalg.norm(p, axis=1) - 1)
    assert faces.count() > 400 and np.quantile(near, 0.9) < 0.08
    assert volume.ground_distance(depth, cameras).collect()[0].gsd == pytest.approx(5.2 / 90, rel=0.05)
    assert volume.mesh_of(depth.limit(0), cameras)[1].count() == 0


def test_voxels_are_not_shuffled_to_pixels(spark):
    """F13, F16: only blocks and tiles meet by a shuffle, whatever the sizes; voxels are summed up before theirs."""
    import re

    depth = spark.createDataFrame([(0, r, c, 10.0 + (r + c) % 3 / 10) for r in range(20) for c in range(20)], "image_id long, r int, c int, depth double")
    cameras = spark.createDataFrame([(0, 60.0, 9.5, 9.5, 0.0, 0.0, 0.0)], "image_id long, f double, px double, py double, cx double, cy double, cz double")
    found = volume.integrated(depth, cameras, 0.5)
    assert found.count() > 100
    joins = [re.findall(r"(\w+)#", x) for x in re.findall(r"Join \w+, (.*)", found._jdf.queryExecution().optimizedPlan().toString())]
    assert joins and not any({"r", "c"} <= set(x) for x in joins)
