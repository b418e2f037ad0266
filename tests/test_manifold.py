"""Repair of vertices with several fans."""

import pytest

from tessera.operators import mesh

CUBE = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]


def frames(spark, faces, vertices):
    return spark.createDataFrame([(k, *f) for k, f in enumerate(faces)], "f_id long, a long, b long, c long"), spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(vertices)], "v_id long, x double, y double, z double")


def test_two_cubes_that_share_a_vertex(spark):
    other = {0: 6} | {k: 7 + k for k in range(1, 8)}
    vertices = CORNERS + [(x + 1, y + 1, z + 1) for x, y, z in CORNERS[1:]]
    faces, points = frames(spark, CUBE + [tuple(other[v] for v in f) for f in CUBE], vertices)
    moved, repaired = mesh.manifold(faces, points)
    got = {r.v_id: (r.x, r.y, r.z) for r in moved.collect()}
    rows = {r.f_id: (r.a, r.b, r.c) for r in repaired.collect()}
    assert len(got) == 16 and 15 in got
    assert {f for f, vs in rows.items() if 15 in vs} == {f + 12 for f, vs in enumerate(CUBE) if 0 in vs} and {f for f, vs in rows.items() if 6 in vs} == {f for f, vs in enumerate(CUBE) if 6 in vs}
    near = {v for f in CUBE if 6 in f for v in f} - {6}
    want = [1 + 0.01 * (sum(CORNERS[v][i] for v in near) / len(near) - 1) for i in range(3)]
    assert got[6] == pytest.approx(want) and got[0] == (0, 0, 0)
    assert mesh.watertight(repaired).collect()[0].watertight


def test_an_edge_of_three_faces_joins_none(spark):
    faces, points = frames(spark, [(0, 1, 2), (1, 0, 3), (0, 1, 4), (5, 5, 6)], [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (9, 9, 9), (8, 8, 8)])
    moved, repaired = mesh.manifold(faces, points, 0.0)
    rows = sorted(map(tuple, repaired.collect()))
    assert [r[0] for r in rows] == [0, 1, 2] and len({v for r in rows for v in r[1:]}) == 9
    assert moved.count() == 7 + 4
    whole = frames(spark, CUBE, CORNERS)
    moved, repaired = mesh.manifold(*whole)
    assert sorted(map(tuple, repaired.collect())) == [(k, *f) for k, f in enumerate(CUBE)] and moved.count() == 8
    assert mesh.manifold(whole[0].limit(0), whole[1])[1].count() == 0
