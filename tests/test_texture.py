"""Outlier views against a loop over each face."""

import random
from collections import defaultdict

import numpy as np

from tessera.operators import texture


def kept(colours):
    """Indices of the views that stay."""
    n, x = len(colours), np.array(colours, float)
    if n <= 4:
        return set(range(n))
    inlier = np.ones(n, bool)
    for _ in range(10):
        c = np.cov(x[inlier].T)
        if np.abs(c).max() < 1e-3:
            return set(np.flatnonzero(inlier))
        if abs(np.linalg.det(c)) <= 1e-12 * np.abs(c).max() ** 3:
            return set(range(n))
        d = x - x[inlier].mean(axis=0)
        new = np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d)) > 6e-2
        if new.all() or new.sum() < 4:
            return set(range(n))
        if (new == inlier).all():
            break
        inlier = new
    return set(np.flatnonzero(inlier))


def test_outlier_views(spark):
    rng = random.Random(4)
    rows, by_face = [], defaultdict(list)
    for f in range(80):
        kind, n = f % 8, rng.choice((3, 4, 5, 8, 15, 40))
        centre = [rng.uniform(40, 200) for _ in range(3)]
        for k in range(n):
            colour = [c + rng.gauss(0, 6) for c in centre]
            if kind in (0, 1) and rng.random() < 0.15:
                colour = [rng.uniform(0, 255) for _ in range(3)]
            if kind == 2:
                colour = centre
            if kind == 3:
                colour = [centre[0] + k, centre[1], centre[2]]
            if kind == 4 and k % 2:
                colour = [c + 100 for c in colour]
            by_face[f].append(colour)
            rows.append((f, k, *map(float, colour), "x", 1))
    rows += [(1, 999, None, 1.0, 1.0, "x", 1), (None, 1, 1.0, 1.0, 1.0, "x", 1)]
    views = spark.createDataFrame(rows, "f_id long, image_id long, red double, green double, blue double, note string, area int").repartition(3)
    found = texture.inlier_views(views)
    assert found.columns == views.columns
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # the test's own and one
    got = defaultdict(set)
    for r in found.collect():
        got[r.f_id].add(r.image_id)
    assert got == {f: kept(c) for f, c in by_face.items()}
    assert sum(len(kept(c)) < len(c) for c in by_face.values()) > 8
    assert texture.inlier_views(views.limit(0)).count() == 0


