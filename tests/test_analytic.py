"""Operators without SQL, and shapes whose measures are known."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import cloud, depth, iterate, mesh, scene, views

CORNERS = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
CUBE = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


@pytest.fixture
def cube(spark):
    v = spark.createDataFrame([(i, *p) for i, p in enumerate(CORNERS)], "v_id long, x double, y double, z double")
    return v, spark.createDataFrame([(i, *f) for i, f in enumerate(CUBE)], "f_id long, a long, b long, c long")


def test_cube(cube):
    v, f = cube
    row = mesh.area_and_volume(f, v).collect()[0]
    assert row["area"] == pytest.approx(6) and abs(row["volume"]) == pytest.approx(1)
    assert mesh.watertight(f).collect()[0]["watertight"] and mesh.boundary_vertices(f).count() == 0
    opened = f.filter("f_id < 10")
    assert mesh.boundary_vertices(opened).count() == 4 and not mesh.watertight(opened).collect()[0]["watertight"]


def test_subdivision_keeps_area_and_closes(cube):
    v, f = cube
    v2, f2 = mesh.subdivided(f, v, 0.1)
    assert f2.count() == 48 and v2.count() == 8 + 18
    row = mesh.area_and_volume(f2.withColumn("f_id", F.col("f_id") * 10 + F.col("part")), v2).collect()[0]
    assert row["area"] == pytest.approx(6) and abs(row["volume"]) == pytest.approx(1)
    assert mesh.watertight(f2.withColumn("f_id", F.col("f_id") * 10 + F.col("part"))).collect()[0]["watertight"]


def test_samples_lie_on_faces(cube):
    v, f = cube
    rows = mesh.sampled(f, v, 200.0).collect()
    assert 1000 < len(rows) < 1400
    assert all(min(abs(c - k) for c in (r["x"], r["y"], r["z"]) for k in (0, 1)) < 1e-9 for r in rows)


def test_similarity_and_planes(spark):
    p = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 3)) for i in range(100)], "point_id long, x double, y double, z double")
    moved = scene.transformed(p, 2.0, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1.0, 2.0, 3.0)).toDF("point_id", "x2", "y2", "z2")
    row = scene.similarity(p, moved).collect()[0]
    assert (row["scale"], row["r01"], row["tx"], row["tz"]) == pytest.approx((2.0, -1.0, 1.0, 3.0))
    flat = p.withColumn("z", F.when(F.col("point_id") % 10 == 0, 50.0).otherwise(0.5 * F.col("x") + 2))
    row = scene.robust_plane(flat, 0.01).collect()[0]
    n = math.sqrt(1.25)
    assert (row["nx"], row["ny"], row["nz"]) == pytest.approx((-0.5 / n, 0, 1 / n), abs=1e-5)


def test_gap_of_seven_is_filled_and_of_eight_is_not(spark):
    rows = [(0, 0, c, 2.0, 0.9) for c in (0, 8, 17)]
    filled = depth.gaps_filled(spark.createDataFrame(rows, "image_id long, r long, c long, depth double, conf double"))
    assert sorted(r["c"] for r in filled.collect()) == list(range(1, 8))


def test_components_and_belief(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(100, 101)], "a long, b long")
    found = dict(iterate.components(links).collect())
    assert {found[i] for i in range(11)} == {0} and found[101] == 100
    nodes = [(x * 10 + y, x, y) for x in range(3, 7) for y in range(4)]
    costs = spark.createDataFrame([(n, k, 0.0 if k == (x >= 5) else 1.0) for n, x, _ in nodes for k in (0, 1)], "node long, label long, cost double")
    edges = spark.createDataFrame([(n, n + 10) for n, x, _ in nodes if x < 6] + [(n, n + 1) for n, _, y in nodes if y < 3], "a long, b long")
    labels = iterate.belief_propagation(costs, edges, 0.4, 2)
    assert {r["node"] // 10 >= 5: r["label"] for r in labels.collect()} == {False: 0, True: 1}
    assert iterate.energy(costs, edges, labels, 0.4) == pytest.approx(4 * 0.4)


def test_conjugate_gradients(spark):
    n = 4
    matrix = spark.createDataFrame([(i, j, 2.5 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n], "i long, j long, value double")
    right = spark.createDataFrame([(i, 1.0) for i in range(n)], "i long, value double")
    x = dict(iterate.conjugate_gradients(matrix, right, tolerance=1e-9).collect())
    for i in range(n):
        assert 2.5 * x[i] - x.get(i - 1, 0) - x.get(i + 1, 0) == pytest.approx(1.0, abs=1e-6)


def test_plane_seen_by_three_cameras_fuses(spark):
    cams = spark.createDataFrame([(i, float(i), 0.0, 0.0, 10.0, 7.5, 7.5, 16, 16) for i in range(3)], "image_id long, cx double, cy double, cz double, f double, px double, py double, width int, height int")
    d = spark.createDataFrame([(i, r, c, 2.0, 0.9) for i in range(3) for r in range(8) for c in range(16)], "image_id long, r long, c long, depth double, conf double")
    pairs = spark.createDataFrame([(i, j) for i in range(3) for j in range(3) if i != j], "ref_id long, nb_id long")
    rows = depth.fused(d, cams, pairs).collect()
    assert rows and all(r["z"] == pytest.approx(2.0) and r["views"] >= 2 for r in rows)
    assert len(rows) > 50
    assert depth.speckles(d, least=10).count() == 0


def test_nearest_looks_further_where_needed(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.1, 0.0, 0.0), (2, 9.0, 0.0, 0.0)], "id long, x double, y double, z double")
    rows = cloud.nearest(p, p, 1, 0.2).collect()
    assert {(r["q_id"], r["p_id"]) for r in rows} == {(0, 1), (1, 0), (2, 1)}


def test_neighbour_text(spark):
    rows = views.neighbors_from_text(spark.createDataFrame([("3 5 7",), ("4",)], "value string")).collect()
    assert [(r["ref_id"], r["nb_id"], r["score"]) for r in rows] == [(3, 5, 3.0), (3, 7, 2.5)]
