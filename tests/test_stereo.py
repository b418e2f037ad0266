"""Semi-global matching against its formulas written pixel by pixel, and on pairs whose disparity is known."""

import math

import numpy as np

from tessera.operators import stereo


def texture(h, w, seed=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(float)


def test_pixel_costs_as_written_out():
    left, right = texture(9, 12), texture(9, 12, 4)
    found = stereo.pixel_costs(left, right, -2, 3)
    grey = lambda p: (0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]) / 255
    for r in range(9):
        for c in range(12):
            for d in range(-2, 3):
                want = 255
                if 3 <= r < 6 and 3 <= c < 9 and 3 <= c + d < 9:
                    rows = []
                    for i in range(-3, 4):
                        for j in range(-3, 4):
                            apart = sum((a - b) ** 2 for a, b in zip(left[r + i, c + j], left[r, c], strict=True))
                            w = math.exp(-apart / (2 * 76.5**2) - (i * i + j * j) / (2 * 2.8**2))
                            rows.append((w, grey(left[r + i, c + j]), grey(right[r + i, c + j + d])))
                    total = sum(w for w, _, _ in rows)
                    m0, m1 = sum(w * a for w, a, _ in rows) / total, sum(w * b for w, _, b in rows) / total
                    v0, v1 = sum(w * (a - m0) ** 2 for w, a, _ in rows), sum(w * (b - m1) ** 2 for w, _, b in rows)
                    ncc = sum(w * (a - m0) * (b - m1) for w, a, b in rows) / math.sqrt(v0 * v1 + 1e-3)
                    want = 255 if ncc <= 0 else round((1 - min(ncc, 1)) * 255)
                assert abs(found[r, c, d + 2] - want) <= 1e-9


def test_accumulated_as_walked_path_by_path():
    rng = np.random.default_rng(1)
    h, w, n = 5, 6, 4
    costs, grey = rng.integers(0, 256, (h, w, n)), rng.random((h, w))
    p2 = lambda step: round(4 * (1 + 14 * math.exp(-(round(255 * abs(step)) ** 2) / (2 * 38**2))))
    want = np.zeros((h, w, n), dtype=int)
    for dr, dc in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)):
        known = {}

        def path(r, c):
            if (r, c) in known:
                return known[r, c]
            if not (0 <= r - dr < h and 0 <= c - dc < w):
                out = [int(costs[r, c, d]) + p2(grey[r, c] - 0.5) for d in range(n)]
            else:
                before, big = path(r - dr, c - dc), p2(grey[r, c] - grey[r - dr, c - dc])
                step = lambda d, e: 0 if d == e else 3 if abs(d - e) == 1 else big
                out = [int(costs[r, c, d]) + min(before[e] + step(d, e) for e in range(n)) - min(before) for d in range(n)]
            known[r, c] = out
            return out

        for r in range(h):
            for c in range(w):
                want[r, c] += path(r, c)
    assert (stereo.accumulated(costs, grey) == want).all()


def rows(image_id, image, shift=0):
    return [(image_id, r, c + shift, *map(float, image[r, c])) for r in range(image.shape[0]) for c in range(image.shape[1])]


COLUMNS = ["image_id", "r", "c", "red", "green", "blue"]


def test_known_shift_ties_nulls_and_repeats(spark):
    image = texture(16, 40)
    given = [*rows(1, image), *rows(2, image, 3), *rows(1, image)[:5], (1, None, 2, 1.0, 1.0, 1.0), (3, 0, 0, None, 1.0, 1.0)]
    pixels = spark.createDataFrame(given, "image_id long, r int, c int, red double, green double, blue double").selectExpr("*", "1 AS cost", "2 AS ref_id", "3 AS nb_id")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (1, 3), (None, 1)], "ref_id long, nb_id long")
    found = stereo.matched(pixels, pairs, -5, 6).collect()
    assert {(x["ref_id"], x["nb_id"], x["disp"]) for x in found} == {(1, 2, 3), (2, 1, -3)}
    inner = {(r, c) for r in range(3, 13) for c in range(3, 37)}
    assert {(x["r"], x["c"]) for x in found if x["ref_id"] == 1} == inner
    assert {(x["r"], x["c"] - 3) for x in found if x["ref_id"] == 2} == inner
    assert len(found) == 2 * len(inner)


def test_missing_pixel_takes_its_windows_and_empty_tables_give_none(spark):
    image = texture(16, 30)
    holed = [x for x in rows(1, image) if x[1:3] != (8, 15)]
    schema = "image_id long, r int, c int, red double, green double, blue double"
    pairs = spark.createDataFrame([(1, 2)], "ref_id long, nb_id long")
    found = stereo.matched(spark.createDataFrame([*holed, *rows(2, image)], schema), pairs, -2, 3).collect()
    assert {(x["r"], x["c"]) for x in found} == {(r, c) for r in range(3, 13) for c in range(3, 27) if abs(r - 8) > 3 or abs(c - 15) > 3}
    assert {x["disp"] for x in found} == {0}
    assert stereo.matched(spark.createDataFrame([], schema), pairs, -2, 3).count() == 0


def test_queries_find_the_shift_and_the_plane(spark):
    from tessera.plans import catalogue

    folder = "/root/testdata/sf0.001"
    found = catalogue.queries()["sgm_disparity"](spark, folder).groupBy("disp").count().collect()
    assert {x["disp"] for x in found} == {2}
    plane = catalogue.queries()["ransac_plane"](spark, folder).collect()[0]
    assert abs(plane["d"] / plane["nz"] + 3) < 1e-4 and abs(plane["nx"] / plane["nz"] + 0.5) < 1e-4
