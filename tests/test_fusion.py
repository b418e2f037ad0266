"""Ordered fusion against the loop over all pixels that it stands for."""

import math
import random

import numpy as np
import pytest

from tessera.operators import fusion

CAMERA = "image_id long, cx double, cy double, cz double, f double, px double, py double, width int, height int, R array<double>"
PIXEL = "image_id long, r int, c int, depth double, conf double, nx double, ny double, nz double, grey double, views int"


def turned(a):
    return np.array([[math.cos(a), 0, -math.sin(a)], [0, 1, 0], [math.sin(a), 0, math.cos(a)]])


@pytest.fixture(scope="module")
def scene():
    rng = random.Random(2)
    cams = [(k, 0.4 * k, 0.1 * (k % 2), 0.0, 14.0, 6.5, 6.5, 14, 14, [float(x) for x in turned(-0.04 * k).reshape(-1)]) for k in range(5)]
    pixels = []
    for k, cx, cy, cz, f, px, py, _, _, R in cams:
        R = np.array(R).reshape(3, 3)
        for r in range(14):
            for c in range(14):
                ray = R.T @ np.array([(c - px) / f, (r - py) / f, 1.0])
                n = np.array([0.2, 0.1, -1.0]) / np.linalg.norm([0.2, 0.1, -1.0])
                d = (n @ np.array([0, 0, 5.0]) - n @ np.array([cx, cy, cz])) / (n @ ray)
                d *= rng.choice((1.0, 1.002, 0.997, 1.008, 0.6, 1.3)) if rng.random() < 0.7 else 1.0
                m = R @ n if rng.random() < 0.9 else np.array([0.8, 0.0, -0.6])
                if rng.random() < 0.9:
                    pixels.append((k, r, c, float(d), rng.random(), *map(float, m), rng.random(), 9))
    return cams, pixels, [(a, b) for a in range(5) for b in range(5) if a != b and (a, b) not in ((0, 4), (3, 1), (3, 0))]


def force(cams, pixels, pairs, least_views, threshold=0.01, degrees=25.0):
    cam = {c[0]: (np.array(c[1:4]), *c[4:7], np.array(c[9]).reshape(3, 3)) for c in cams}
    near = {k: sorted(b for a, b in pairs if a == k) for k in cam}
    depth = {p[:3]: p[3] for p in pixels}
    rest, taken, out = {p[:3]: p for p in pixels}, set(), {}

    def world(p):
        C, f, px, py, R = cam[p[0]]
        return C + R.T @ (np.array([(p[2] - px) / f, (p[1] - py) / f, 1.0]) * p[3]), R.T @ np.array(p[5:8])

    for k in sorted(cam, key=lambda k: (-len(near[k]), k)):
        for at in sorted(p[:3] for p in pixels if p[0] == k):
            if not depth[at] or at in taken:
                continue
            X, n = world(rest[at])
            mine, hidden = [at], []
            for b in near[k]:
                C, f, px, py, R = cam[b]
                q = R @ (X - C)
                if q[2] <= 0:
                    continue
                to = (b, math.floor(py + f * q[1] / q[2] + 0.5), math.floor(px + f * q[0] / q[2] + 0.5))
                if not depth.get(to) or to in taken:
                    continue
                if abs(q[2] - depth[to]) / q[2] < threshold and n @ world(rest[to])[1] > math.cos(math.radians(degrees)):
                    mine.append(to)
                elif q[2] < depth[to]:
                    hidden.append(to)
            if len(mine) >= least_views:
                taken |= set(mine)
                for to in hidden:
                    depth[to] = 0
                w = np.array([1 / (max(1 - rest[m][4], 0.03) * rest[m][3] ** 2) for m in mine])
                mean = lambda v: (w[:, None] * np.array(v)).sum(axis=0) / w.sum()
                N = mean([world(rest[m])[1] for m in mine])
                out[at] = (*mean([world(rest[m])[0] for m in mine]), *(N / np.linalg.norm(N)), mean([[rest[m][8]] for m in mine])[0], len(mine), w.sum())
    return out


@pytest.mark.parametrize("least_views", [1, 2, 4])
def test_as_in_order(spark, scene, least_views):
    cams, pixels, pairs = scene
    want = force(cams, pixels, pairs, least_views)
    rows = [*pixels, *pixels[:30], (0, 1, None, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0), (77, 1, 1, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0), (0, 50, 50, None, 1.0, 0.0, 0.0, 1.0, 0.0, 0)]
    frame = spark.createDataFrame
    found = fusion.ordered_fusion(frame(rows, PIXEL).repartition(3), frame(cams, CAMERA), frame(pairs, "ref_id long, nb_id long"), least_views=least_views, colours=("grey",))
    got = {(r.image_id, r.r, r.c): (r.x, r.y, r.z, r.nx, r.ny, r.nz, r.grey, r.views, r.weight) for r in found.collect()}
    assert got.keys() == want.keys() and len(want) > 60
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_nothing(spark, scene):
    cams, pixels, pairs = scene
    frame = spark.createDataFrame
    assert fusion.ordered_fusion(frame(pixels[:0], PIXEL), frame(cams, CAMERA), frame(pairs, "ref_id long, nb_id long")).count() == 0
    alone = fusion.ordered_fusion(frame(pixels, PIXEL).select("image_id", "r", "c", "depth"), frame(cams, CAMERA), frame(pairs[:0], "ref_id long, nb_id long"), least_views=1)
    assert alone.count() == len(pixels)
