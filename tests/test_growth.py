"""What has to hold as tables grow: nothing that grows goes to all tasks, and crowds at one place cost no pairs."""

import random

import pytest

from tessera.operators import cloud, depth, frustum, hits, mesh
from tests.test_frustum import CAMERA, plan

VERTEX, FACE = "v_id long, x double, y double, z double", "f_id long, a long, b long, c long"


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    """A height field of which Spark knows the size of the file, which is small."""
    folder = str(tmp_path_factory.mktemp("grid"))
    spark.createDataFrame([(k, float(k % 20), float(k // 20), float(k % 7)) for k in range(2000)], VERTEX).write.parquet(f"{folder}/v")
    faces = [(2 * k + i, *f) for k in range(1979) if k % 20 < 19 for i, f in enumerate(((k, k + 1, k + 20), (k + 1, k + 21, k + 20)))]
    spark.createDataFrame(faces, FACE).write.parquet(f"{folder}/f")
    return spark.read.parquet(f"{folder}/v"), spark.read.parquet(f"{folder}/f")


def test_vertices_and_cameras_are_not_broadcast(spark, grid):
    vertices, faces = grid
    corners = mesh.with_corners(faces, vertices)
    assert "Broadcast" not in plan(corners) and "Broadcast" not in plan(mesh.face_neighbors(faces))
    cameras = spark.createDataFrame([(k, 10.0, 5.0 * k, -5.0, 12.0, 11.5, 11.5, 24, 24, None) for k in range(9)], CAMERA).drop("R")
    assert "Broadcast" not in plan(frustum.joined(frustum.face_spheres(corners), cameras))
    assert frustum.joined(frustum.face_spheres(corners), cameras).count() == frustum.joined(frustum.face_spheres(corners), cameras, 2).count() > 0


def test_cells_get_finer_as_a_scene_grows_long(spark, monkeypatch):
    """A long strip of small items: a camera at one end meets those about it, in tasks that share a crowded cell."""
    items = spark.createDataFrame([(k, float(k % 5), k / 5, 0.0, 0.1) for k in range(5000)], "id long, x double, y double, z double, radius double")
    cameras = spark.createDataFrame([(k, 2.0, 3.0, -2.0, 12.0, 11.5, 11.5, 24, 24, None) for k in range(20)], CAMERA).drop("R")
    want = frustum.joined(items, cameras, 2).count()
    monkeypatch.setattr(frustum, "SHARE", 3)
    assert frustum.joined(items, cameras).count() == want > 0


def test_candidates_of_nearest_faces(spark, grid):
    """What is joined on cells is sorted, never sent to all tasks, in both searches."""
    vertices, faces = grid
    listed = hits.listed(mesh.with_corners(faces, vertices), 4.0)
    assert "Broadcast" not in plan(listed)
    found = hits.nearest_faces(vertices.withColumnRenamed("v_id", "id"), mesh.with_corners(faces, vertices), 4.0)
    assert found.count() == 2000 and found.filter("distance > 1e-9").count() == 0


def test_nearest_with_crowds_at_one_place(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, *([0.5, 0.5, 0.5] if k < 400 else [rng.uniform(0, 1) for _ in range(3)])) for k in range(600)]
    rng.shuffle(rows)
    points, most, real = spark.createDataFrame(rows, "id long, x double, y double, z double"), [0], cloud.within_radius

    def watched(*args):
        out = real(*args)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(cloud, "within_radius", watched)
    got = {(r.q_id, r.rank): r.p_id for r in cloud.nearest(points, points, 5, 4.0).collect()}
    assert most[0] < 60_000  # every pair: 360,000
    for q in [*rows[:40], (1, 0.5, 0.5, 0.5)]:
        near = sorted((int(sum((a - b) ** 2 for a, b in zip(q[1:], p[1:])) * 1e9 + 0.5), p[0]) for p in rows if p[0] != q[0])
        assert [got[q[0], k] for k in range(1, 6)] == [p for _, p in near[:5]]


def test_votes_of_cameras_and_points_that_coincide(spark, monkeypatch):
    """Copies of cameras and of points multiply votes, not the pairs that are looked at."""
    rng = random.Random(5)
    base = [(rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(5, 9)) for _ in range(40)]
    base += [tuple(c / 2 for c in p) for p in base[:15]]
    points = [(k, *p) for k, p in enumerate(base * 3)]
    cams = [(i, 0.7 * (i % 2), 0.0, 0.0, 200.0, 99.5, 99.5, 200, 200, None) for i in range(8)]
    seen = [(k, i, 1.0) for k, *_ in points for i in range(8) if rng.random() < 0.4]
    views, n, want = {}, {}, {k: 0 for k, *_ in points}
    for k, _, _ in seen:
        n[k] = n.get(k, 0) + 1
    for k, i, _ in seen:
        e = [points[k][1] - cams[i][1], *points[k][2:]]
        d = sum(c * c for c in e) ** 0.5
        pixel = lambda p: [int(200 * p[j] / p[2] + 100.0 + 1000) - 1000 for j in (0, 1)]
        for other, *at in points:
            p = [at[0] - cams[i][1], *at[1:]]
            own = sum(c * c for c in p) ** 0.5
            t = sum(a * b for a, b in zip(p, e)) / d
            if other != k and t > 0 and t * t > own * own / (1 + 1 / 200**2) and all(abs(a - b) <= 1 for a, b in zip(pixel(p), pixel(e))):
                want[other] += -n[k] if own * 1.02 < d else n.get(other, 0) if own > d * 1.02 else 0
    real = frustum.joined
    monkeypatch.setattr(frustum, "joined", lambda items, cameras, *a: views.update(pairs=(items.count(), cameras.count())) or real(items, cameras, *a))
    found = cloud.visibility_votes(spark.createDataFrame(seen, "point_id long, image_id long, weight double"), spark.createDataFrame(points, "point_id long, x double, y double, z double"), spark.createDataFrame(cams, CAMERA).drop("R"))
    assert {r.point_id: r.votes for r in found.collect()} == want and min(want.values()) < 0 < max(want.values())
    assert views["pairs"] == (55, 2)


def test_windows_shuffle_once_and_send_no_pixel_twice(spark):
    rows = [(i, r, c, float((7 * r + 3 * c + i) % 11 + 1)) for i in range(2) for r in range(9) for c in range(9) if (r * c + i) % 4]
    pixels = spark.createDataFrame(rows, "image_id long, r long, c long, depth double")
    normals = pixels.selectExpr("image_id", "r", "c", "0.6 as nx", "0.0 as ny", "0.8 as nz")
    for found in (depth.windows(pixels), depth.window_moments(pixels, "depth", 9, 9), depth.normal_confidence(normals)):
        assert plan(found).count("Exchange ") == 1 and "explode" not in plan(found) and "inline" not in plan(found)
    at = {k[:3]: k[3] for k in rows}
    for x in depth.windows(pixels).collect():
        want = {(a, b, at[x.image_id, x.r + a, x.c + b]) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (x.image_id, x.r + a, x.c + b) in at}
        assert set(map(tuple, x.near)) == want and len(x.near) == len(want)
    for x in depth.window_moments(pixels, "depth", 9, 9).collect():
        near = [at.get((x.image_id, x.r + a, x.c + b), 0.0) for a in range(-3, 4) for b in range(-3, 4)]
        assert x["mean"] == pytest.approx(sum(near) / 49)


def test_flipped_disparities_are_not_multiplied_before_the_shuffle(spark):
    """a row of pixels is shuffled as one list; the last column's disparity stands, inside the image."""
    rows = [(1, 0, 0, 2), (1, 0, 1, 2), (1, 0, 3, 0), (1, 1, 0, -1), (1, 1, 5, 4), (1, 1, None, 1), (2, 0, 4, None)]
    found = depth.flipped(spark.createDataFrame(rows, "image_id long, r int, c int, disp int"), 8)
    want = {}
    for i, r, c, d in sorted((x for x in rows if None not in x), key=lambda x: x[2]):
        want |= {(i, r, x): -d for x in range(c + d - 1, c + d + 2) if 0 <= x < 8}
    assert {(r.image_id, r.r, r.c): r.disp for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and plan.index("Generate inline") < plan.index("Aggregate")


def test_views_come_in_bounded_parts_and_are_not_joined(spark, monkeypatch):
    """parts of the views grow in number, not in size; the views of a point are turned into pairs in place."""
    from tessera.operators import views
    from tessera.plans import adapters

    monkeypatch.setattr(adapters, "VIEWS", 500)
    seen = adapters.Scene(spark, "/root/testdata/sf0.001").point_views()
    assert seen.rdd.getNumPartitions() >= 12
    found = views.covisible_pairs(seen)
    assert "Join" not in plan(found)
    rows = [(1, 5), (1, 3), (1, 3), (1, 9), (2, 3), (2, 5), (3, 3), (None, 3), (None, 5), (4, None), (4, 5)]
    want = {}
    for p, a in rows:
        for q, b in rows:
            if p is not None and p == q and None not in (a, b) and a != b:
                want[a, b] = want.get((a, b), 0) + 1
    got = views.covisible_pairs(spark.createDataFrame(rows, "point_id long, image_id long")).collect()
    assert {(r.ref_id, r.nb_id): r.points for r in got} == want and len(got) == len(want)


def test_messages_are_one_row_an_edge_and_rounds_join_nothing(spark, monkeypatch):
    """against messages passed by hand, for nodes with labels of their own, without costs and without edges."""
    from tessera.operators import iterate

    rng, seen, real = random.Random(8), [], iterate.checkpointed
    monkeypatch.setattr(iterate, "checkpointed", lambda df: (seen.append(df), real(df))[1])
    costs = {(n, k): rng.uniform(0, 2) for n in range(12) for k in range(3) if n or k}
    links = {(a, b) for a in range(11) for b in range(a) if rng.random() < 0.3} | {(3, 40)}
    both = links | {(b, a) for a, b in links}
    m = {(a, b, k): 0.0 for a, b in both for k in range(3)}
    belief = lambda n, k: costs[n, k] + sum(v for (_, b, l), v in m.items() if (b, l) == (n, k))
    for _ in range(2):
        h = {(a, b, k): belief(a, k) - m[b, a, k] for a, b in both for k in range(3) if (a, k) in costs and (b, a, k) in m}
        low = {(a, b): min(v for (c, d, _), v in h.items() if (c, d) == (a, b)) for a, b, _ in h}
        m = {(a, b, k): min(v, low[a, b] + 0.4) - low[a, b] for (a, b, k), v in h.items()}
    want = {n: min((belief(n, k), k) for k in range(3) if (n, k) in costs)[1] for n in range(12)}
    found = iterate.belief_propagation(spark.createDataFrame([(n, k, c) for (n, k), c in costs.items()], "node long, label int, cost double"), spark.createDataFrame(sorted(links), "a long, b long"), 0.4, 2)
    assert {r.node: r.label for r in found.collect()} == want and found.count() == len(want)
    assert len(seen) == 4 and all("Join" not in plan(x) for x in (*seen[2:], found))


def test_mutual_matches_are_made_once(spark, monkeypatch):
    """matches of both ways meet in one grouping; only pairs matched both ways are linked."""
    from tessera.operators import iterate

    pixel = "ref_id long, r long, c long, nb_id long, r2 long, c2 long, agrees boolean"
    rows = [(1, 0, 0, 2, 0, 1, True), (2, 0, 1, 1, 0, 0, True), (1, 0, 0, 2, 0, 1, True), (1, 3, 3, 2, 3, 3, True), (1, 3, 3, 2, 3, 3, True), (1, 5, 5, 2, 5, 5, True), (2, 5, 5, 1, 5, 5, False)]
    seen, real = [], iterate.components
    monkeypatch.setattr(depth, "reprojected", lambda *a: spark.createDataFrame(rows, pixel))
    monkeypatch.setattr(iterate, "components", lambda links: (seen.append(links), real(links))[1])
    depth.fused(spark.createDataFrame([], "image_id long, r long, c long, depth double, conf double"), spark.createDataFrame([], CAMERA).drop("R"), None)
    assert "Join" not in plan(seen[0]) and [tuple(r) for r in seen[0].collect()] == [(1 << 40, (2 << 40) + 1)]


def test_cameras_that_coincide_are_rasterised_once(spark, grid, monkeypatch):
    """every camera gets the pixels that it gets alone, in parts of any size; one of those that coincide is looked at."""
    vertices, faces = grid
    corners, real, looked = mesh.with_corners(faces, vertices), frustum.joined, []
    turns = [[1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]]
    rows = [(k, 10.0, 5.0 * (k % 3), -5.0, 12.0, 11.5, 11.5, 24, 24, turns[k % 2]) for k in range(30)] + [(40, None, 0.0, -5.0, 12.0, 11.5, 11.5, 24, 24, turns[0])]
    monkeypatch.setattr(frustum, "joined", lambda items, cameras, *a: looked.append(cameras.count()) or real(items, cameras, *a))
    monkeypatch.setattr(frustum, "EACH", 2)
    monkeypatch.setattr(frustum, "ROWS", 1000)
    got = {}
    for r in frustum.rasterised(corners, spark.createDataFrame(rows, CAMERA)).collect():
        assert (r.r, r.c) not in got.setdefault(r.image_id, {})
        got[r.image_id][r.r, r.c] = (r.f_id, r.depth)
    assert looked == [6] and set(got) == set(range(30))
    for r in frustum.rasterised(corners, spark.createDataFrame(rows[:6], CAMERA)).collect():
        assert all(got[k][r.r, r.c] == (r.f_id, r.depth) for k in range(r.image_id, 30, 6))
    assert all(got[k] == got[k % 6] for k in got)


def test_a_tile_of_more_pixels_of_faces_than_are_looked_at_together(spark):
    """the nearest face stays the nearest where a tile's faces come in several parts, and in the tile after it."""
    rng = random.Random(12)
    at = [[(rng.uniform(-120, 190), rng.uniform(-120, 190)) for _ in range(3)] for _ in range(200)]
    deep = [rng.uniform(2, 9) for _ in at]
    rows = [(k, *[x for u, v in p for x in (u * z / 50, v * z / 50, z)]) for k, (p, z) in enumerate(zip(at, deep))]
    camera = [(7, 0.0, 0.0, 0.0, 50.0, 0.0, 0.0, 70, 64)]
    found = frustum.rasterised(spark.createDataFrame(rows, "f_id long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz")).repartition(2), spark.createDataFrame(camera, CAMERA.replace(", R array<double>", "")))
    side = lambda a, b, u, v: (b[0] - a[0]) * (v - a[1]) - (b[1] - a[1]) * (u - a[0])
    want = {}
    for z, k, (a, b, c) in sorted(zip(deep, range(200), at)):
        for r in range(64):
            for u in range(70):
                if (r, u) not in want and len({side(*e, u, r) > 0 for e in ((a, b), (b, c), (c, a))}) == 1:
                    want[r, u] = k
    assert frustum.PIXELS < 200 * 64 * 64 and {(x.r, x.c): x.f_id for x in found.collect()} == want


def test_views_of_vertices_are_sought_once_for_cameras_that_coincide(spark, grid, monkeypatch):
    """the views of every camera; two cameras of one place count as two that see a vertex."""
    vertices, faces = grid
    corners, real, looked = mesh.with_corners(faces, vertices), frustum.joined, []
    camera = lambda k, y: (k, 10.0, y, -5.0, 12.0, 11.5, 11.5, 24, 24, None)
    seen = lambda rows, least: {tuple(r) for r in frustum.vertex_views(corners, vertices, spark.createDataFrame(rows, CAMERA).drop("R"), least=least).collect()}
    alone = [{v for v, _ in seen([camera(k, y)], 1)} for k, y in enumerate((5.0, 60.0))]
    assert all(alone) and not alone[0] & alone[1]
    monkeypatch.setattr(frustum, "joined", lambda items, cameras, *a: looked.append(cameras.count()) or real(items, cameras, *a))
    rows = [camera(k, 5.0) for k in range(9)] + [camera(20, 60.0)]
    assert seen(rows, 2) == {(v, k) for v in alone[0] for k in range(9)} and looked == [2, 2]
    assert seen(rows, 1) == {(v, k) for v in alone[0] for k in range(9)} | {(v, 20) for v in alone[1]}


def test_only_points_that_can_meet_a_pixel_are_shuffled(spark, monkeypatch):
    """what a neighbour's pixels can't hold is dropped before the shuffle, and nothing else; matches are made once."""
    from tessera.operators import iterate

    rng, cams = random.Random(4), [(i, 0.4 * i, 0.0, 0.0, 20.0, 7.5, 7.5, 16, 16) for i in range(4)]
    rows = [(i, r, c, rng.uniform(4, 6), 0.5) for i in range(3) for r in range(i, 12) for c in range(2, 14 - i) if rng.random() < 0.6]
    rows += [(0, 20, 20, -1.0, 0.5), (1, 3, None, 5.0, 0.5), (2, None, 3, 5.0, 0.5), (None, 3, 3, 5.0, 0.5), (1, 0, 0, None, 0.5)]
    pixels = spark.createDataFrame(rows, "image_id long, r long, c long, depth double, conf double")
    cameras, pairs = spark.createDataFrame(cams, CAMERA.replace(", R array<double>", "")), [(a, b) for a in range(4) for b in range(4) if a != b]
    found = depth.reprojected(pixels, cameras, spark.createDataFrame(pairs, "ref_id long, nb_id long"), 0.2)
    at, want = {k[:3]: k[3] for k in rows if None not in k[:3]}, {}
    for (i, r, c), d in at.items():
        for a, b in pairs:
            if a == i and d is not None and d > 0:
                to = (b, r, int((((c - 7.5) * d / 20 + 0.4 * i) - 0.4 * b) * 20 / d + 8.0 + 100) - 100)
                if to in at:
                    want[(i, r, c), to] = None if at[to] is None else abs(d - at[to]) / d < 0.2
    assert {((x.ref_id, x.r, x.c), (x.nb_id, x.r2, x.c2)): x.agrees for x in found.collect()} == want and found.count() == len(want) > 100
    assert "low_r" in plan(found) and "high_c" in plan(found)
    seen, real = [], iterate.components
    monkeypatch.setattr(iterate, "components", lambda links: (seen.append(links), real(links))[1])
    fused = {r.component: (r.views, r.z) for r in depth.fused(pixels, cameras, spark.createDataFrame(pairs, "ref_id long, nb_id long"), 0.2).collect()}
    key = lambda p: (p[0] << 40) + (p[1] << 20) + p[2]
    links = {tuple(sorted((key(a), key(b)))) for (a, b), agrees in want.items() if agrees and want.get((b, a))}
    assert {tuple(r) for r in seen[0].collect()} == links and "Join" not in plan(seen[0]) and "Aggregate" not in plan(seen[0])
    assert fused and set(fused) <= {a for a, _ in links} and all(2 <= n <= 3 for n, _ in fused.values())
