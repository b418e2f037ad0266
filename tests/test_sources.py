"""Files read back what was written, and streams what arrived."""

import json
import struct

import numpy as np
import pytest

from tessera.plans.adapters import Scene
from tessera.sources import files
from tessera.streaming import depth_stream


def test_ply_kinds(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty list uchar uint view_indices\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    rows = [(1.0, 2.0, 3.0, 7, [4, 5]), (4.0, 5.0, 6.0, 8, [])]
    (tmp_path / "a.ply").write_bytes((head.format("ascii 1.0") + "1 2 3 7 2 4 5\n4 5 6 8 0\n3 0 1 1\n").encode())
    for name, kind, o in (("b", "binary_little_endian 1.0", "<"), ("c", "binary_big_endian 1.0", ">")):
        body = b"".join(struct.pack(o + "fffBB", x, y, z, r, len(v)) + struct.pack(f"{o}{len(v)}I", *v) for x, y, z, r, v in rows)
        (tmp_path / f"{name}.ply").write_bytes(head.format(kind).encode() + body + struct.pack(o + "Biii", 3, 0, 1, 1))
    got = files.read_ply_points(spark, f"{tmp_path}/*.ply").orderBy("path", "point_id").collect()
    assert [(r.x, r.y, r.z, r.r, r.views, r.nx) for r in got] == [(*r, None) for r in rows] * 3
    assert {(r.a, r.b, r.c) for r in files.read_ply_faces(spark, f"{tmp_path}/*.ply").collect()} == {(0, 1, 1)}


def test_ply_and_obj_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(i, i + 0.5, 0.0, -float(i)) for i in range(20)], "point_id long, x double, y double, z double")
    files.write_lines(files.ply_text(p), str(tmp_path / "p"))
    (part,) = (tmp_path / "p").glob("part-*")
    part.rename(tmp_path / "p.ply")
    assert [tuple(r)[1:5] for r in files.load(spark, str(tmp_path / "p.ply")).orderBy("point_id").collect()] == [tuple(r) for r in p.orderBy("point_id").collect()]
    v = p.withColumnRenamed("point_id", "v_id")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 2, 3, 4)], "f_id long, a long, b long, c long")
    files.write_lines(files.obj_text(v, f), str(tmp_path / "o"))
    (part,) = (tmp_path / "o").glob("part-*")
    part.rename(tmp_path / "o.obj")
    v2, f2 = files.read_obj(spark, str(tmp_path / "o.obj"))
    assert sorted(map(tuple, v2.collect())) == sorted(map(tuple, v.collect())) and sorted(map(tuple, f2.collect())) == sorted(map(tuple, f.collect()))


def test_depth_map_round_trip(spark, tmp_path):
    d = np.zeros((4, 5), np.float32)
    d[1, 2], d[3, 4] = 2.5, 4.0
    for i in range(2):
        (tmp_path / f"depth{i}.dmap").write_bytes(files.pack_depth_map("im.png", [i, 9], np.eye(3), np.eye(3), [0, 0, 0], d, conf=d / 10))
    rows = files.read_depth_maps(spark, f"{tmp_path}/*.dmap").orderBy("image_id", "r").collect()
    assert [(r.image_id, r.r, r.c, r.depth) for r in rows] == [(i, *x) for i in range(2) for x in ((1, 2, 2.5), (3, 4, 4.0))]
    assert rows[0].conf == pytest.approx(0.25) and files.parse_depth_map((tmp_path / "depth0.dmap").read_bytes())["ids"] == [0, 9]


def test_text_scenes(spark, tmp_path):
    (tmp_path / "roi.txt").write_text("1 0 0\n0 1 0\n0 0 1\n-1 -2 -3\n1 2 3\n")
    assert files.read_region(spark, str(tmp_path / "roi.txt")).collect()[0].high == [1.0, 2.0, 3.0]
    (tmp_path / "images.txt").write_text("# images\n1 1 0 0 0 1 2 3 7 a.jpg\n10.5 20.5 3\n2 0 0 0 1 1 2 3 7 b.jpg\n\n")
    rows = files.read_colmap_images(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()
    assert [(r.name, r.cx, r.cy, r.cz) for r in rows] == [("a.jpg", -1.0, -2.0, -3.0), ("b.jpg", 1.0, 2.0, -3.0)]
    (tmp_path / "points3D.txt").write_text("5 1 2 3 10 20 30 0.1 1 0 2 5\n")
    points, seen = files.read_colmap_points(spark, str(tmp_path / "points3D.txt"))
    assert tuple(points.collect()[0]) == (5, 1.0, 2.0, 3.0, 10, 20, 30) and {r.image_id for r in seen.collect()} == {1, 2}
    (tmp_path / "t.json").write_text(json.dumps({"fl_x": 500, "cx": 1, "cy": 2, "w": 10, "h": 20, "frames": [{"file_path": "x", "transform_matrix": [[1, 0, 0, 4], [0, 1, 0, 5], [0, 0, 1, 6], [0, 0, 0, 1]]}]}))
    row = files.read_json_cameras(spark, str(tmp_path / "t.json")).collect()[0]
    assert row.R == [1, 0, 0, 0, -1, 0, 0, 0, -1] and (row.cx, row.cy, row.cz) == (4, 5, 6)


def test_binary_scenes_say_what_text_says(spark, tmp_path):
    cameras = [(7, 1, 640, 480, [500.0, 510.0, 320.0, 240.0]), (8, 3, 64, 48, [50.0, 32.0, 24.0, 0.1, 0.2]), (9, 6, 9, 9, [float(k) for k in range(12)])]
    (tmp_path / "c.bin").write_bytes(struct.pack("<Q", 3) + b"".join(struct.pack(f"<iiQQ{len(p)}d", i, m, w, h, *p) for i, m, w, h, p in cameras))
    (tmp_path / "c.txt").write_text("7 PINHOLE 640 480 500 510 320 240\n8 RADIAL 64 48 50 32 24 0.1 0.2\n9 FULL_OPENCV 9 9 " + " ".join(map(str, range(12))) + "\n")
    images = [(1, (1.0, 0, 0, 0, 1, 2, 3), 7, "a b.jpg", 2), (2, (0, 0, 0, 1.0, 1, 2, 3), 8, "", 0)]
    (tmp_path / "i.bin").write_bytes(struct.pack("<Q", 2) + b"".join(struct.pack("<i7di", i, *p, c) + n.encode() + b"\0" + struct.pack("<Q", k) + struct.pack("<ddq", 1.5, 2.5, 4) * k for i, p, c, n, k in images))
    points = [(5, (1.0, 2, 3), (10, 20, 30), [1, 0, 2, 5, 1, 9]), (6, (4.0, 5, 6), (0, 0, 255), [])]
    (tmp_path / "p.bin").write_bytes(struct.pack("<Q", 2) + b"".join(struct.pack(f"<Q3d3BdQ{len(t)}i", i, *x, *c, 0.1, len(t) // 2, *t) for i, x, c, t in points))
    (tmp_path / "p.txt").write_text("5 1 2 3 10 20 30 0.1 1 0 2 5 1 9\n6 4 5 6 0 0 255 0.1\n")
    (tmp_path / "none.bin").write_bytes(struct.pack("<Q", 0))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    found = files.read_colmap_binary_cameras(spark, str(tmp_path / "c.bin"))
    assert rows(found) == rows(files.read_colmap_cameras(spark, str(tmp_path / "c.txt")))
    assert rows(files.pinhole(found).select("fx", "fy", "px", "py", "distortion")) == sorted([(500.0, 510.0, 320.0, 240.0, []), (50.0, 50.0, 32.0, 24.0, [0.1, 0.2]), (0.0, 1.0, 2.0, 3.0, [float(k) for k in range(4, 12)])], key=str)
    found = files.read_colmap_binary_images(spark, str(tmp_path / "i.bin")).orderBy("image_id").collect()
    assert [(r.name, r.camera_id, r.cx, r.cy, r.cz) for r in found] == [("a b.jpg", 7, -1.0, -2.0, -3.0), ("", 8, 1.0, 2.0, -3.0)]
    for got, want in zip(files.read_colmap_binary_points(spark, str(tmp_path / "p.bin")), files.read_colmap_points(spark, str(tmp_path / "p.txt")), strict=True):
        assert rows(got) == rows(want)
    assert files.read_colmap_binary_cameras(spark, str(tmp_path / "none.bin")).count() == 0


def test_camera_files(spark, tmp_path):
    import json

    import numpy as np

    R = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    C = np.array([2.0, -3, 4])
    t = -R @ C
    rows = "\n".join(" ".join(map(str, [*R[i], t[i]])) for i in range(3))
    (tmp_path / "00000007_cam.txt").write_text(f"extrinsic\n{rows}\n0.0 0.0 0.0 1.0\n\nintrinsic\n361.5 0.0 82.9\n0.0 360.4 66.4\n0.0 0.0 1.0\n\n425.0 2.5\n")
    (tmp_path / "broken_cam.txt").write_text("extrinsic\n1 2 3\nintrinsic\n1 x\n")
    (found,) = files.read_text_cameras(spark, f"{tmp_path}/*_cam.txt").collect()
    assert (found.name, found.f, found.fy, found.px, found.py, found.low, found.step) == ("00000007", 361.5, 360.4, 82.9, 66.4, 425.0, 2.5)
    assert found.R == R.reshape(-1).tolist() and [found.cx, found.cy, found.cz] == pytest.approx(C.tolist())

    c2w = np.eye(4)
    c2w[:3, :3], c2w[:3, 3] = R, C
    (tmp_path / "v1.json").write_text(json.dumps({"camera_data": {"width": 64, "height": 48, "intrinsics": {"fx": 50.0, "fy": 51.0, "cx": 31.0, "cy": 23.0}, "cam2world": c2w.T.tolist()}}))
    (found,) = files.read_json_camera_files(spark, f"{tmp_path}/*.json").collect()
    P = c2w.copy()
    P[2] *= -1
    P[[0, 1]] = P[[1, 0]]
    P[:, 1:3] *= -1
    assert (found.name, found.f, found.fy, found.width, found.height) == ("v1", 50.0, 51.0, 64, 48)
    assert found.R == P[:3, :3].T.reshape(-1).tolist() and [found.cx, found.cy, found.cz] == P[:3, 3].tolist()


def test_stream_counts_a_file_once(spark, tmp_path):
    cams = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0)], "image_id long, cx double, cy double, cz double, f double, px double, py double")
    pixel = lambda r: spark.createDataFrame([(0, r, 0, 2.0, 0.9), (0, r, 1, 2.0, 0.1)], depth_stream.PIXELS)
    for r in range(2):
        pixel(r).write.mode("append").parquet(f"{tmp_path}/in")
        depth_stream.merge_stream(depth_stream.new_depth_maps(spark, f"{tmp_path}/in"), cams, f"{tmp_path}/out", f"{tmp_path}/state", 0.5).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    images = spark.createDataFrame([(0,), (1,)], "image_id long")
    assert [r.image_id for r in depth_stream.missing_images(images, pixel(0)).collect()] == [1]


def test_adapters_have_unique_keys(spark):
    s = Scene(spark, "/root/testdata/sf0.001")
    for df, key in ((s.point_views(), ["point_id", "image_id"]), (s.depth(), ["image_id", "r", "c"]), (s.faces(), ["f_id"])):
        assert df.count() == df.select(*key).distinct().count()
