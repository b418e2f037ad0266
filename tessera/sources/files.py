"""Readers and writers of scene files. Text formats are parsed by Spark; binary ones come as binaryFile rows, one file a
row, and are parsed file by file in the tasks, so many files are read in parallel and no path is opened on the driver."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.archive import read_archives

PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse_ply(data: bytes) -> dict[str, dict[str, list]]:
    """Elements by name, each with its properties as lists; ascii and both binary orders, list properties too."""
    end = data.index(b"end_header")
    header = data[:end].decode("ascii", "replace").splitlines()
    body = data[data.index(b"\n", end) + 1 :]
    kind, elements = "ascii", []
    for line in header:
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append((words[-1], tuple(words[1:-1])))
    order = ">" if "big" in kind else "<"
    tokens, at = (body.split(), 0) if kind == "ascii" else ([], 0)
    out: dict[str, dict[str, list]] = {}
    for name, count, properties in elements:
        columns: dict[str, list] = {p: [] for p, _ in properties}
        fixed = all(t[0] != "list" for _, t in properties)
        if fixed and kind != "ascii":
            kinds = np.dtype([(p, order + PLY_TYPES[t[0]]) for p, t in properties])
            found = np.frombuffer(body, kinds, count, at)
            at += kinds.itemsize * count
            out[name] = {p: found[p].tolist() for p, _ in properties}
            continue
        for _ in range(count):
            for p, t in properties:
                if kind == "ascii":
                    n = int(tokens[at]) if t[0] == "list" else 1
                    at += t[0] == "list"
                    number = float if PLY_TYPES[t[-1]][0] == "f" else int
                    values = [number(v) for v in tokens[at : at + n]]
                    at += n
                else:
                    n = 1
                    if t[0] == "list":
                        size = np.dtype(order + PLY_TYPES[t[1]])
                        n = int(np.frombuffer(body, size, 1, at)[0])
                        at += size.itemsize
                    size = np.dtype(order + PLY_TYPES[t[-1]])
                    values = np.frombuffer(body, size, n, at).tolist()
                    at += size.itemsize * n
                columns[p].append(values if t[0] == "list" else values[0])
        out[name] = columns
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_ply_points(spark: SparkSession, path: str) -> DataFrame:
    """path, point_id (place in the file), x, y, z, nx, ny, nz, r, g, b, label, views: what a file lacks is null."""
    fields = [("x", "x"), ("y", "y"), ("z", "z"), ("nx", "nx"), ("ny", "ny"), ("nz", "nz")]
    colours = [("r", ("red", "diffuse_red")), ("g", ("green", "diffuse_green")), ("b", ("blue", "diffuse_blue"))]
    schema = "path string, point_id long, x double, y double, z double, nx double, ny double, nz double, r int, g int, b int, label int, views array<int>"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = parse_ply(content.as_py()).get("vertex", {})
                n = len(v.get("x", []))
                none = [None] * n
                columns = [pa.array([path] * n, pa.string()), pa.array(range(n), pa.int64()), *[pa.array(v.get(src, none), pa.float64()) for _, src in fields]]
                columns += [pa.array(next((v[s] for s in names if s in v), none), pa.int32()) for _, names in colours]
                columns += [pa.array(v.get("label", none), pa.int32()), pa.array(v.get("view_indices", none), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "point_id", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "label", "views"])

    return _files(spark, path).mapInArrow(run, schema)


def read_ply_faces(spark: SparkSession, path: str) -> DataFrame:
    """path, f_id, a, b, c."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = parse_ply(content.as_py()).get("face", {})
                corners = f.get("vertex_indices", f.get("vertex_index", []))
                n = len(corners)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int64()), *[pa.array([t[k] for t in corners], pa.int64()) for k in range(3)]], ["path", "f_id", "a", "b", "c"])

    return _files(spark, path).mapInArrow(run, "path string, f_id long, a long, b long, c long")


def _ply(head: list[str], spark: SparkSession, *bodies: DataFrame) -> DataFrame:
    lines = ["ply", "format ascii 1.0", *head, "end_header"]
    out = spark.createDataFrame([(-len(lines) + k, line) for k, line in enumerate(lines)], "place long, value string")
    for body in bodies:
        out = out.unionByName(body)
    return out


def ply_text(points: DataFrame) -> DataFrame:
    """Lines (place, value) of an ascii PLY of points(point_id, x, y, z), with normals (nx, ny, nz), colours (r, g, b) and
    views, an array of images, where there are such columns; a null counts 0, null views as none. Ids are not below 0."""
    there = set(points.columns)
    kinds = [("float", n, n) for n in "xyz"]
    kinds += [("float", n, n) for n in ("nx", "ny", "nz")] if "nx" in there else []
    kinds += [("uchar", n, m) for n, m in zip("rgb", ("red", "green", "blue"), strict=True)] if "r" in there else []
    words = [F.coalesce(F.col(n).cast("string"), F.lit("0")) for _, n, _ in kinds]
    head = [f"element vertex {points.count()}", *[f"property {kind} {m}" for kind, _, m in kinds]]
    if "views" in there:
        views = F.coalesce("views", F.array().cast("array<int>"))
        words += [F.size(views).cast("string"), F.when(F.size(views) > 0, F.array_join(views.cast("array<string>"), " "))]
        head.append("property list uint uint view_indices")
    return _ply(head, points.sparkSession, points.select(F.col("point_id").cast("long").alias("place"), F.concat_ws(" ", *words).alias("value")))


def mesh_ply_text(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Lines (place, value) of an ascii PLY; vertex ids have to count from 0 without gaps."""
    n, m = vertices.count(), faces.count()
    v = vertices.select(F.col("v_id").cast("long").alias("place"), F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"]).alias("value"))
    f = faces.select((F.col("f_id") + n).cast("long").alias("place"), F.concat_ws(" ", F.lit("3"), *[F.col(c).cast("string") for c in "abc"]).alias("value"))
    head = [f"element vertex {n}", *[f"property float {c}" for c in "xyz"], f"element face {m}", "property list uchar int vertex_indices"]
    return _ply(head, vertices.sparkSession, v, f)


def filesystem(path: str):
    """The pyarrow file system and the name there of a path or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_file(lines: DataFrame, path: str) -> None:
    """Lines (place, value) as one file, for formats that are one: tasks sort, the driver takes a range at a time."""
    store, name = filesystem(path)
    with store.open_output_stream(name) as out:
        for row in lines.orderBy("place").select("value").toLocalIterator():
            out.write(row[0].encode() + b"\n")


def write_lines(lines: DataFrame, path: str, parts: int = 1) -> None:
    """(place, value) as text files whose names sort like their places."""
    lines.repartitionByRange(parts, "place").sortWithinPartitions("place").select("value").write.text(path)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of one OBJ file; faces of more corners become fans. Ids count from 0 in file order, for which
    the file is read as a whole by one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "t"))
    words = lines.select("line", F.split(F.trim("t"), r"\s+").alias("w"))
    v = words.filter(F.get("w", F.lit(0)) == "v").select("line", *[F.get("w", F.lit(k + 1)).cast("double").alias(c) for k, c in enumerate("xyz")])
    f = words.filter(F.get("w", F.lit(0)) == "f").select("line", F.transform(F.expr("slice(w, 2, size(w))"), lambda x: F.split(x, "/")[0].cast("long") - 1).alias("k"))
    from pyspark.sql import Window

    order = Window.orderBy("line")
    vertices = v.select((F.row_number().over(order) - 1).cast("long").alias("v_id"), "x", "y", "z")
    fans = f.select("line", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("k") - 2), lambda i: F.struct(F.get("k", F.lit(0)).alias("a"), F.get("k", i).alias("b"), F.get("k", i + 1).alias("c")))).alias("part", "t"))
    faces = fans.select((F.row_number().over(Window.orderBy("line", "part")) - 1).cast("long").alias("f_id"), "t.a", "t.b", "t.c")
    return vertices, faces


def obj_text(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Lines (place, value); vertex ids have to count from 0 without gaps."""
    n = vertices.count()
    v = vertices.select(F.col("v_id").alias("place"), F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in "xyz"]).alias("value"))
    f = faces.select((F.col("f_id") + n).alias("place"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in "abc"]).alias("value"))
    return v.unionByName(f)


# ---- raw depth maps: a fixed header, names and ids, camera, then the maps that the flags name

DEPTH, NORMAL, CONFIDENCE, VIEWS = 1, 2, 4, 8


def pack_depth_map(name: str, ids: list[int], k, r, c, depth, conf=None, normal=None, image_size=None) -> bytes:
    """The bytes of a depth map; arrays are numpy, depth (h, w), normal (h, w, 3)."""
    h, w = depth.shape
    iw, ih = image_size or (w, h)
    flags = DEPTH | (NORMAL if normal is not None else 0) | (CONFIDENCE if conf is not None else 0)
    valid = depth[depth > 0]
    raw = name.encode()
    out = [b"DR", struct.pack("<BBIIII", flags, 0, iw, ih, w, h), struct.pack("<ff", valid.min() if valid.size else 0, valid.max() if valid.size else 0), struct.pack("<H", len(raw)), raw, struct.pack("<I", len(ids)), np.asarray(ids, "<u4").tobytes()]
    out += [np.asarray(x, "<f8").tobytes() for x in (k, r, c)] + [np.asarray(depth, "<f4").tobytes()]
    out += [np.asarray(x, "<f4").tobytes() for x in (normal, conf) if x is not None]
    return b"".join(out)


def parse_depth_map(data: bytes) -> dict:
    if data[:2] != b"DR":
        raise ValueError("not a depth map")
    flags, _, iw, ih, w, h = struct.unpack_from("<BBIIII", data, 2)
    low, high = struct.unpack_from("<ff", data, 20)
    (n,) = struct.unpack_from("<H", data, 28)
    at = 30 + n
    (views,) = struct.unpack_from("<I", data, at)
    at += 4
    out = {"name": data[30 : 30 + n].decode(), "ids": np.frombuffer(data, "<u4", views, at).tolist(), "size": (w, h), "image_size": (iw, ih), "range": (low, high)}
    at += 4 * views
    for key, count in (("K", 9), ("R", 9), ("C", 3)):
        out[key] = np.frombuffer(data, "<f8", count, at)
        at += 8 * count
    for flag, key, depth in ((DEPTH, "depth", 1), (NORMAL, "normal", 3), (CONFIDENCE, "conf", 1)):
        if flags & flag:
            out[key] = np.frombuffer(data, "<f4", w * h * depth, at).reshape((h, w, depth) if depth > 1 else (h, w))
            at += 4 * w * h * depth
    return out


def read_depth_maps(spark: SparkSession, path: str, conf: bool = True) -> DataFrame:
    """image_id (the first id of a map), r, c, depth, conf: valid pixels only; without conf that map is not read."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                m = parse_depth_map(content.as_py())
                r, c = np.nonzero(m["depth"] > 0)
                values = m["conf"][r, c].astype(float) if conf and "conf" in m else np.ones(len(r))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), m["ids"][0] if m["ids"] else 0, np.int64)), pa.array(r.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(m["depth"][r, c].astype(float)), pa.array(values)], ["image_id", "r", "c", "depth", "conf"])

    return _files(spark, path).mapInArrow(run, "image_id long, r long, c long, depth double, conf double")


# ---- text scenes


def read_region(spark: SparkSession, path: str) -> DataFrame:
    """One row: 15 numbers are rotation, low, high; 6 are low and high of an axis box, whose rotation is the identity."""
    numbers = F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    rows = spark.read.text(path, wholetext=True).select(numbers.alias("n"))
    eye = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])
    oriented = F.size("n") == 15
    take = lambda k: F.slice("n", F.when(oriented, k + 10).otherwise(k + 1), 3)
    return rows.select(F.when(oriented, F.slice("n", 1, 9)).otherwise(eye).alias("rotation"), take(0).alias("low"), take(3).alias("high"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("w"))


def read_colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """camera_id, model, width, height, params."""
    at = lambda k: F.get("w", F.lit(k))
    return _records(spark, path).select(at(0).cast("int").alias("camera_id"), at(1).alias("model"), at(2).cast("int").alias("width"), at(3).cast("int").alias("height"), F.transform(F.expr("slice(w, 5, size(w))"), lambda x: x.cast("double")).alias("params"))


def read_colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, camera_id, name, R (row-major, from the unit quaternion), cx, cy, cz. Of a record's two lines, the one
    with the pose has ten fields, the last a file name; lines of observations hold numbers only."""
    at = lambda k: F.get("w", F.lit(k)).cast("double")
    rows = _records(spark, path).filter((F.size("w") >= 10) & F.get("w", F.lit(9)).try_cast("double").isNull())
    return _posed(rows.select(at(0).cast("int").alias("image_id"), at(8).cast("int").alias("camera_id"), F.get("w", F.lit(9)).alias("name"), F.array(*[at(k) for k in range(1, 8)]).alias("pose")))


def _posed(rows: DataFrame) -> DataFrame:
    """Rows whose pose(quaternion, translation) is given as R and the centre."""
    w, x, y, z, *t = (F.get("pose", F.lit(k)) for k in range(7))
    r = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    c = [-(r[k] * t[0] + r[3 + k] * t[1] + r[6 + k] * t[2]) for k in range(3)]
    return rows.select("image_id", "camera_id", "name", F.array(*r).alias("R"), *[v.alias(n) for v, n in zip(c, ("cx", "cy", "cz"), strict=True)])


#: Camera models by number, and how many parameters each has.
COLMAP_MODELS = [
    ("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8),
    ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12),
]
ONE_FOCAL = ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE")


def pinhole(cameras: DataFrame) -> DataFrame:
    """Cameras (model, params) with fx, fy, px, py, and `distortion`, the parameters that are left; null for a model that
    isn't known."""
    p = lambda k: F.get("params", F.lit(k))
    one = F.col("model").isin(*ONE_FOCAL)
    known = F.col("model").isin(*[m for m, _ in COLMAP_MODELS])
    pick = lambda a, b: F.when(known & one, a).when(known, b)
    return cameras.select("*", pick(p(0), p(0)).alias("fx"), pick(p(0), p(1)).alias("fy"), pick(p(1), p(2)).alias("px"), pick(p(2), p(3)).alias("py"), pick(F.expr("slice(params, 4, size(params))"), F.expr("slice(params, 5, size(params))")).alias("distortion"))


def _binary(spark: SparkSession, path: str, records, schema: str, at_a_time: int = 100_000) -> DataFrame:
    """The records(content) of each file, in batches of rows."""
    types = spark.createDataFrame([], schema).toArrow().schema

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                held: list[tuple] = []
                for record in records(content.as_py()):
                    held.append(record)
                    if len(held) == at_a_time:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), types, strict=True)], schema=types)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), types, strict=True)], schema=types)

    return _files(spark, path).mapInArrow(run, schema)


def _camera_records(data: bytes) -> Iterator[tuple]:
    at = 8
    for _ in range(struct.unpack_from("<Q", data)[0]):
        camera_id, model, width, height = struct.unpack_from("<iiQQ", data, at)
        name, n = COLMAP_MODELS[model]
        yield camera_id, name, width, height, list(struct.unpack_from(f"<{n}d", data, at + 24))
        at += 24 + 8 * n


def _image_records(data: bytes) -> Iterator[tuple]:
    at = 8
    for _ in range(struct.unpack_from("<Q", data)[0]):
        image_id, *pose, camera_id = struct.unpack_from("<i7di", data, at)
        end = data.index(b"\0", at + 64)
        yield image_id, camera_id, data[at + 64 : end].decode("utf-8", "replace"), pose
        at = end + 9 + 24 * struct.unpack_from("<Q", data, end + 1)[0]


def _point_records(data: bytes) -> Iterator[tuple]:
    at = 8
    for _ in range(struct.unpack_from("<Q", data)[0]):
        point_id, x, y, z, r, g, b, _, n = struct.unpack_from("<Q3d3BdQ", data, at)
        yield point_id, x, y, z, r, g, b, list(struct.unpack_from(f"<{2 * n}i", data, at + 51)[::2])
        at += 51 + 8 * n


def read_colmap_binary_cameras(spark: SparkSession, path: str) -> DataFrame:
    """read_colmap_cameras() of a binary file; a file without cameras gives no row."""
    return _binary(spark, path, _camera_records, "camera_id int, model string, width int, height int, params array<double>")


def read_colmap_binary_images(spark: SparkSession, path: str) -> DataFrame:
    """read_colmap_images() of a binary file."""
    return _posed(_binary(spark, path, _image_records, "image_id int, camera_id int, name string, pose array<double>"))


def read_colmap_binary_points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """read_colmap_points() of a binary file, which one task reads."""
    rows = _binary(spark, path, _point_records, "point_id long, x double, y double, z double, r int, g int, b int, seen array<int>")
    return rows.drop("seen"), rows.select("point_id", F.explode("seen").alias("image_id")).distinct()


def read_colmap_points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points(point_id, x, y, z, r, g, b), point_views(point_id, image_id))."""
    at = lambda k: F.get("w", F.lit(k))
    rows = _records(spark, path)
    points = rows.select(at(0).cast("long").alias("point_id"), *[at(k + 1).cast("double").alias(c) for k, c in enumerate("xyz")], *[at(k + 4).cast("int").alias(c) for k, c in enumerate("rgb")])
    track = rows.select(at(0).cast("long").alias("point_id"), F.posexplode(F.expr("slice(w, 9, size(w))")).alias("k", "v"))
    return points, track.filter("k % 2 = 0").select("point_id", F.col("v").cast("int").alias("image_id")).distinct()


def read_json_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a transforms.json: name, f, px, py, width, height, R (world to camera), cx, cy, cz. The file's camera
    looks along -z with y up, so those axes are turned."""
    rows = spark.read.json(path, multiLine=True)
    frame = rows.select("*", F.explode("frames").alias("frame"))
    m = lambda i, j: F.col("frame.transform_matrix")[i][j].cast("double")
    sign = (1.0, -1.0, -1.0)
    r = [m(j, i) * sign[i] for i in range(3) for j in range(3)]
    return frame.select(F.col("frame.file_path").alias("name"), F.col("fl_x").cast("double").alias("f"), F.col("cx").cast("double").alias("px"), F.col("cy").cast("double").alias("py"), F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), F.array(*r).alias("R"), *[m(k, 3).alias(n) for k, n in enumerate(("cx", "cy", "cz"))])


def _numbers(after: str) -> Column:
    """The numbers that follow a word in column value, up to the next word."""
    found = F.trim(F.regexp_extract("value", rf"(?s)\b{after}\s+([-+.\deE\s]*)", 1))
    return F.transform(F.split(found, r"\s+"), lambda x: x.try_cast("double"))


def read_text_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Camera files <name>_cam.txt of a 4 x 4 extrinsic (world to camera), a 3 x 3 intrinsic and the least depth and its step:
    name, f, fy, px, py, R, cx, cy, cz, low, step. A file that lacks numbers of either matrix gives no row; low and step
    are null where they are missing."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(_cam)?\.txt$", 1).alias("name"), _numbers("extrinsic").alias("e"), _numbers("intrinsic").alias("k"))
    rows = rows.filter((F.size("e") >= 12) & (F.size("k") >= 9) & ~F.exists(F.slice("e", 1, 12), lambda x: x.isNull()) & ~F.exists(F.slice("k", 1, 9), lambda x: x.isNull()))
    e, k = (lambda i, n=n: F.get(n, F.lit(i)) for n in "ek")
    centre = [-sum((e(4 * i + j) * e(4 * i + 3) for i in range(1, 3)), e(j) * e(3)) for j in range(3)]
    return rows.select("name", k(0).alias("f"), k(4).alias("fy"), k(2).alias("px"), k(5).alias("py"), F.array(*[e(4 * i + j) for i in range(3) for j in range(3)]).alias("R"), *[c.alias(n) for c, n in zip(centre, ("cx", "cy", "cz"), strict=True)], k(9).alias("low"), k(10).alias("step"))


def read_json_camera_files(spark: SparkSession, path: str) -> DataFrame:
    """Files <name>.json of one camera each, with camera_data: name, f, fy, px, py, width, height, R (world to camera), cx, cy, cz.
    cam2world lists the columns of a camera that looks along -z with y up; of the world, x and y are exchanged and z turned."""
    schema = "camera_data struct<width:int, height:int, intrinsics:struct<fx:double, fy:double, cx:double, cy:double>, cam2world:array<array<double>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("name"), "camera_data.*").filter("cam2world is not null")
    axis, sign = (1, 0, 2), (1.0, 1.0, -1.0)  # row i of the new world is this row of the old one
    m = lambda i, j: F.col("cam2world")[j][axis[i]] * sign[i] * (1.0 if j in (0, 3) else -1.0)
    at = F.col("intrinsics")
    return rows.select("name", at["fx"].alias("f"), at["fy"].alias("fy"), at["cx"].alias("px"), at["cy"].alias("py"), "width", "height", F.array(*[m(i, j) for j in range(3) for i in range(3)]).alias("R"), *[m(i, 3).alias(n) for i, n in enumerate(("cx", "cy", "cz"))])


READERS = {"ply": read_ply_points, "dmap": read_depth_maps, "obj": read_obj, "mvs": read_archives}


def load(spark: SparkSession, path: str):
    """By the path's extension: a PLY's points, depth maps' pixels, an OBJ's vertices and faces, scene archives' tables,
    or a folder of Parquet tables by name."""
    found = re.search(r"\.(\w+)$", path.rstrip("*"))
    if found and found[1].lower() in READERS:
        return READERS[found[1].lower()](spark, path)
    return lambda name: spark.read.parquet(f"{path}/{name}")


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """A scene as a Parquet table per relation, zstd-compressed."""
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
