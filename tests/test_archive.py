"""Scene archives and single files read back what was written."""

import numpy as np
import pytest

from tessera.sources import archive, files


def scene():
    camera = {"name": "left", "band_name": "rgb", "width": 640, "height": 480, "K": [500, 0.5, 320, 0, 510, 240, 0, 0, 1], "R": [0, -1, 0, 1, 0, 0, 0, 0, 1], "C": [1, 0, 0]}
    poses = np.array([(np.eye(3).ravel(), (1, 2, 3)), ((0, 1, 0, -1, 0, 0, 0, 0, 1), (4, 5, 6))], archive._POSE)
    image = {"name": "a.jpg", "mask_name": "é", "platform_id": 0, "camera_id": 0, "pose_id": 0, "id": 9, "depths": [1, 2, 3], "view_scores": np.array([(1, 5, 1.5, 0.25, 0.5, 7)], archive._SCORE)}
    views = np.array([(0, 0.5), (1, 2)], archive._VIEW)
    return {
        "platforms": [{"name": "rig", "cameras": [camera], "poses": poses}],
        "images": [image, image | {"pose_id": 1, "id": archive.NONE, "view_scores": np.array([], archive._SCORE)}, image | {"pose_id": archive.NONE}],
        "vertices": [{"X": [1, 2, 3], "views": views}, {"X": [4, 5, 6], "views": views[:0]}],
        "normals": [[0, 0, 1], [0, 1, 0]], "colours": [[1, 2, 3], [4, 5, 6]],
        "lines": [{"pt1": [1, 1, 1], "pt2": [2, 2, 2], "views": views[1:]}], "line_normals": [[1, 0, 0]], "line_colours": [[9, 8, 7]],
        "transform": np.eye(4).ravel(), "obb": np.arange(15.0),
    }


@pytest.mark.parametrize("version", range(8))
def test_bytes_of_every_version(version):
    raw = archive.pack_archive(scene(), version)
    back = archive.parse_archive(raw)
    assert back.pop("version") == version and archive.pack_archive(back, version) == raw
    assert ("lines" in back, "transform" in back, "obb" in back) == (version > 0, version > 1, version > 5)
    assert ("width" in back["platforms"][0]["cameras"][0], "id" in back["images"][0], "depths" in back["images"][0]) == (version > 0, version > 2, version > 6)


def test_layout_of_the_oldest_version():
    """Sizes by hand: texts and lists have counts of eight bytes."""
    camera, poses = 8 + 4 + 72 + 72 + 24, 8 + 2 * 96
    platform = 8 + 3 + 8 + camera + poses
    image, cloud = 8 + 5 + 12, (12 + 8 + 16) + (12 + 8)
    assert len(archive.pack_archive(scene(), 0)) == 12 + 8 + platform + 8 + 3 * image + 8 + cloud + 8 + 24 + 8 + 6


def test_not_an_archive():
    with pytest.raises(ValueError):
        archive.parse_archive(b"PK\x03\x04")
    with pytest.raises(ValueError):
        archive.parse_archive(b"MVSI" + (99).to_bytes(4, "little") + bytes(4))


def test_tables_and_back(spark, tmp_path):
    (tmp_path / "a.mvs").write_bytes(archive.pack_archive(scene()))
    tables = files.load(spark, str(tmp_path / "a.mvs"))
    images = tables["images"].orderBy("image_id").collect()
    assert [(r.file_id, r.f, r.fy, r.width, r.avg_depth) for r in images] == [(9, 500, 510, 640, 2), (1, 500, 510, 640, 2), (9, 500, 510, 640, 2)]
    assert (images[0].cx, images[0].cy, images[0].cz) == (2, 2, 3) and images[0].R == [0, -1, 0, 1, 0, 0, 0, 0, 1]
    # the second pose turns the camera's place on the rig, and undoes its turn
    assert (images[1].cx, images[1].cy, images[1].cz) == (4, 6, 6) and images[1].R == np.eye(3).ravel().tolist()
    assert images[2].R is None and images[2].cx is None
    assert [(r.x, r.nz, r.r, r.b) for r in tables["points"].orderBy("point_id").collect()] == [(1, 1, 3, 1), (4, 0, 6, 4)]
    archive.write_archive(tables, str(tmp_path / "b.mvs"))
    again = files.load(spark, str(tmp_path / "b.mvs"))
    for name, table in tables.items():
        assert sorted(map(str, again[name].drop("path").collect())) == sorted(map(str, table.drop("path").collect())), name


def test_no_points(spark, tmp_path):
    (tmp_path / "a.mvs").write_bytes(archive.pack_archive(scene() | {"vertices": [], "normals": [], "colours": []}))
    tables = files.load(spark, str(tmp_path / "a.mvs"))
    archive.write_archive(tables, str(tmp_path / "b.mvs"), 3)
    again = files.load(spark, str(tmp_path / "b.mvs"))
    assert again["points"].count() == 0 and again["view_scores"].count() == 0 and again["images"].count() == 3


def test_whole_ply_files(spark, tmp_path):
    p = spark.createDataFrame([(k, k + 0.5, 0.0, -1.0, 0.0, 0.0, 1.0, k, 2, 3, list(range(k % 3))) for k in range(30)], "point_id long, x double, y double, z double, nx double, ny double, nz double, r int, g int, b int, views array<int>")
    files.write_file(files.ply_text(p.repartition(5)), str(tmp_path / "p.ply"))
    assert sorted(map(tuple, files.read_ply_points(spark, str(tmp_path / "p.ply")).drop("path", "label").collect())) == sorted(map(tuple, p.collect()))
    v = p.select(p["point_id"].alias("v_id"), "x", "y", "z")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 2, 3, 4)], "f_id long, a long, b long, c long")
    files.write_file(files.mesh_ply_text(v, f), str(tmp_path / "m.ply"))
    assert sorted(map(tuple, files.read_ply_faces(spark, str(tmp_path / "m.ply")).drop("path").collect())) == sorted(map(tuple, f.collect()))
    files.write_file(files.obj_text(v, f), f"file://{tmp_path}/m.obj")
    assert files.load(spark, str(tmp_path / "m.obj"))[0].count() == 30
