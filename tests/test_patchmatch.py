"""PatchMatch on scenes whose depths are known: a slanted plane and a sphere before a wall, seen by turned cameras."""

import math

import numpy as np
import pytest

from tessera.operators import patchmatch

F_, SIZE = 90.0, 64


def texture(p):
    """Smooth, aperiodic grey of points of a surface."""
    x, y, z = p[..., 0], p[..., 1], p[..., 2]
    v = sum(np.sin(a * x + b * y + c * z + d) for a, b, c, d in ((13.6, 3.4, 2.5, 0), (-5.5, 12.4, 4.3, 1), (19.9, -17.8, 4.6, 2), (7.9, 26.5, -6.1, 3), (-31.6, 9.1, 3.3, 4)))
    return 0.5 + 0.09 * v


def turned(angle):
    c, s = math.cos(angle), math.sin(angle)
    return np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]])


def plane(origin, d):
    n, offset = np.array([0.3, -0.2, -1.0]), -4.0
    return (offset - origin @ n) / (d @ n)


def ball(origin, d):
    """A sphere that fills the images."""
    o, radius = origin - np.array([0.0, 0.0, 7.0]), 3.2
    a, b, c = (d * d).sum(-1), 2 * d @ o, o @ o - radius**2
    return (-b - np.sqrt(np.maximum(b * b - 4 * a * c, 0))) / (2 * a)


def rendered(surface, centre, R):
    r, c = np.mgrid[:SIZE, :SIZE]
    ray = np.stack([(c - 31.5) / F_, (r - 31.5) / F_, np.ones(r.shape)], axis=-1)
    depth = surface(centre, ray @ R)
    return texture(centre + (ray @ R) * depth[..., None]), depth


@pytest.fixture(scope="module", params=[plane, ball])
def scene(spark, request):
    cameras, pixels, depths = [], [], {}
    for k, (x, y, angle) in enumerate([(0, 0, 0), (0.6, 0, -0.14), (-0.5, 0.15, 0.12), (0.1, -0.6, 0.0)]):
        centre, R = np.array([x, y, 0.0]), turned(angle)
        grey, depths[k] = rendered(request.param, centre, R)
        cameras.append((k, F_, 31.5, 31.5, *map(float, centre), SIZE, SIZE, [float(v) for v in R.reshape(-1)]))
        pixels += [(k, r, c, float(grey[r, c])) for r in range(SIZE) for c in range(SIZE)]
    frame = spark.createDataFrame
    return (
        frame(pixels, "image_id long, r int, c int, grey double"), frame(cameras, "image_id long, f double, px double, py double, cx double, cy double, cz double, width int, height int, R array<double>"),
        frame([(a, b) for a in range(4) for b in range(4) if a != b], "ref_id long, nb_id long"), frame([(k, 2.5, 6.5) for k in range(4)], "image_id long, low double, high double"), depths,
    )


def off(found, depths, image=None):
    rows = [x for x in found if image is None or x.image_id == image]
    return np.array([abs(x.depth - depths[x.image_id][x.r, x.c]) / depths[x.image_id][x.r, x.c] for x in rows])


def test_depths_are_found(spark, scene):
    pixels, cameras, pairs, ranges, depths = scene
    first = patchmatch.estimated_depth(pixels, cameras, pairs, ranges, tile=64).cache()
    found = first.collect()
    error = off(found, depths)
    assert len(error) > 0.6 * 4 * (SIZE - 8) ** 2
    assert np.median(error) < 0.006 and (error < 0.01).mean() > 0.7
    assert all(abs(x.nx**2 + x.ny**2 + x.nz**2 - 1) < 1e-6 and 0 <= x.conf <= 1 for x in found)

    again = patchmatch.estimated_depth(pixels, cameras, pairs, ranges, tile=64, known=first).collect()
    error = off(again, depths)
    assert len(error) > 0.6 * 4 * (SIZE - 8) ** 2 and np.median(error) < 0.006 and (error < 0.01).mean() > 0.7


def test_result_is_that_of_any_partitions(spark, scene):
    pixels, cameras, pairs, ranges, depths = scene
    some = pixels.filter("r < 40 and c < 40 and image_id < 2")
    one = lambda p: sorted(map(tuple, patchmatch.estimated_depth(p, cameras, pairs, ranges, rounds=1, levels=1, tile=32).collect()))
    found = one(some)
    assert found and found == one(some.unionByName(some).repartition(7)) and {x[0] for x in found} == {0, 1}


def test_nothing_to_compare(spark, scene):
    pixels, cameras, pairs, ranges, _ = scene
    none = lambda **x: patchmatch.estimated_depth(**({"pixels": pixels.filter("r < 20"), "cameras": cameras, "pairs": pairs, "ranges": ranges, "tile": 64, "rounds": 1, "levels": 0} | x)).count()
    assert none(pairs=pairs.limit(0)) == none(ranges=ranges.limit(0)) == none(cameras=cameras.limit(0)) == none(pixels=pixels.limit(0)) == 0
    assert none(pixels=pixels.filter("r < 20").selectExpr("image_id", "r", "c", "cast(null as double) as grey")) == 0
    assert none(pixels=pixels.filter("r < 20").selectExpr("image_id", "r", "c", "0.5d as grey")) == 0  # no texture


def test_scores_by_force(scene):
    """A score against one pixel's patch, texel by texel."""
    _, cameras, _, _, _ = scene
    rows = sorted(cameras.collect(), key=lambda c: c.image_id)
    surface = plane
    views = []
    for cam in rows[:2]:
        R, C = np.array(cam.R).reshape(3, 3), np.array([cam.cx, cam.cy, cam.cz])
        views.append(patchmatch.View(rendered(surface, C, R)[0], 0, 0, (F_, 31.5, 31.5), R, C))
    tile = patchmatch.Tile(0, views[0], views[1:], 2.5, 6.5)
    rng = np.random.default_rng(3)
    for _ in range(20):
        r, c, d = int(rng.integers(20, 44)), int(rng.integers(20, 44)), float(rng.uniform(3.5, 4.5))
        n = np.array([*rng.normal(0, 0.3, 2), -1.0])
        n /= np.linalg.norm(n)
        got = tile.scored((np.array([r]), np.array([c])), np.array([d]), n[None], smooth=False)[0]
        ray = lambda y, x: np.array([(x - 31.5) / F_, (y - 31.5) / F_, 1.0])
        a, b, w = [], [], []
        for i in range(-4, 5, 2):
            for j in range(-4, 5, 2):
                a.append(views[0].grey[r + i, c + j])
                w.append(math.exp(-((a[-1] - views[0].grey[r, c]) ** 2) / 0.02 - (i * i + j * j) / 18))
                p = ray(r + i, c + j)
                q = views[1].R @ (p * (d * (n @ ray(r, c)) / (n @ p)) + views[0].C - views[1].C)
                u, v = 31.5 + F_ * q[0] / q[2], 31.5 + F_ * q[1] / q[2]
                if not (0 <= u < 63 and 0 <= v < 63):
                    b.append(math.nan)
                    continue
                x, y = int(u), int(v)
                g = views[1].grey
                b.append(sum(g[y + k, x + m] * (abs(1 - k - v + y)) * (abs(1 - m - u + x)) for k in (0, 1) for m in (0, 1)))
        a, b, w = map(np.array, (a, b, w))
        mean = lambda x: (w * x).sum() / w.sum()
        cov = lambda x, y: (w * (x - mean(x)) * (y - mean(y))).sum()
        want = 1.2 if np.isnan(b).any() else 1 - cov(a, b) / math.sqrt(cov(a, a) * cov(b, b))
        assert got == pytest.approx(want, abs=1e-9)


def test_texels_on_the_border_do_not_hang_on_rounding():
    """cameras side by side map rows to rows, so texels of the fifth row and the fifth last fall on the border."""
    grey = np.random.default_rng(4).uniform(0, 1, (30, 80))
    at = [x.reshape(-1) for x in np.meshgrid((4, 25), np.arange(10, 70), indexing="ij")]
    views = [patchmatch.View(grey[:, 4 * k : 4 * k + 72], 0, 0, (60.0, 35.5, 14.5), np.eye(3), np.array([k * 4 * 10 / 60, 0, 0])) for k in (0, 1)]
    tile = patchmatch.Tile(0, views[0], views[1:], 6.0, 18.0)
    good = at[1] < 66
    score = tile.scored(at, np.full(len(at[0]), 10.0), np.tile([0.0, 0.0, -1.0], (len(at[0]), 1)), smooth=False)
    assert np.abs(score[good & (at[1] >= 14)]).max() < 1e-6
    normal = np.random.default_rng(5).normal(0, 0.2, (len(at[0]), 3)) - (0, 0, 1)
    score = tile.scored(at, np.full(len(at[0]), 10.0), normal / np.linalg.norm(normal, axis=1, keepdims=True), smooth=False)
    assert (score[(at[1] >= 20) & (at[1] < 60)] != patchmatch.UNLIKE).all()


def test_query_finds_the_walls(spark):
    from tessera.plans import catalogue

    folder = "/root/testdata/sf0.001"
    found = catalogue.queries()["patchmatch_depth"](spark, folder).collect()
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    error = np.array([abs(r.depth - 10) / 10 for r in found])
    assert len(found) > 0.8 * (vectors // 48) * 3 * 40 * 46 * 0.8 and (error < 0.02).mean() > 0.7
