"""Scene archives: platforms with cameras and poses, images, points with their views, lines, a transform and a region.

A file is one stream of records, so one task reads a file (Spark hands it over whole, up to 2 GB), and a file is written by
the driver, which takes the points as bytes that tasks have made, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

MAGIC, LATEST, NONE = b"MVSI", 7, 0xFFFFFFFF
TEXT = "text"
BATCH = 10_000


@dataclass(frozen=True)
class Many:
    """A 64-bit count, then so many of a kind."""

    of: object


def _n(kind: str, n: int) -> np.dtype:
    return np.dtype((kind, n))


_ID, _MATRIX, _SPOT, _POINT, _RGB = np.dtype("<u4"), _n("<f8", 9), _n("<f8", 3), _n("<f4", 3), _n("u1", 3)
_VIEW = np.dtype([("image_id", "<u4"), ("confidence", "<f4")])
_SCORE = np.dtype([("id", "<u4"), ("points", "<u4"), ("scale", "<f4"), ("angle", "<f4"), ("area", "<f4"), ("score", "<f4")])

#: The fields of each record in their order, with the first version that has them.
_CAMERA = [("name", TEXT, 0), ("band_name", TEXT, 4), ("width", _ID, 1), ("height", _ID, 1), ("K", _MATRIX, 0), ("R", _MATRIX, 0), ("C", _SPOT, 0)]
_POSE = np.dtype([("R", "<f8", 9), ("C", "<f8", 3)])
_PLATFORM = [("name", TEXT, 0), ("cameras", Many(_CAMERA), 0), ("poses", Many(_POSE), 0)]
_IMAGE = [("name", TEXT, 0), ("mask_name", TEXT, 5), ("platform_id", _ID, 0), ("camera_id", _ID, 0), ("pose_id", _ID, 0), ("id", _ID, 3), ("depths", _POINT, 7), ("view_scores", Many(_SCORE), 7)]
_VERTEX = [("X", _POINT, 0), ("views", Many(_VIEW), 0)]
_LINE = [("pt1", _POINT, 0), ("pt2", _POINT, 0), ("views", Many(_VIEW), 0)]
_CLOUD = [("normals", Many(_POINT), 0), ("colours", Many(_RGB), 0)]
_HEAD = [("platforms", Many(_PLATFORM), 0), ("images", Many(_IMAGE), 0)]
_TAIL = [*_CLOUD, ("lines", Many(_LINE), 1), ("line_normals", Many(_POINT), 1), ("line_colours", Many(_RGB), 1), ("transform", _n("<f8", 16), 2), ("obb", _n("<f8", 15), 6)]
SCENE = [*_HEAD, ("vertices", Many(_VERTEX), 0), *_TAIL]


def _count(data: bytes, at: int) -> tuple[int, int]:
    return int.from_bytes(data[at : at + 8], "little"), at + 8


def _read(kind, data: bytes, at: int, version: int):
    """A value of the kind and the place behind it."""
    if isinstance(kind, np.dtype):
        return np.frombuffer(data, kind, 1, at)[0], at + kind.itemsize
    if kind is TEXT:
        n, at = _count(data, at)
        return data[at : at + n].decode(), at + n
    if isinstance(kind, Many):
        n, at = _count(data, at)
        if isinstance(kind.of, np.dtype):
            return np.frombuffer(data, kind.of, n, at), at + n * kind.of.itemsize
        out = []
        for _ in range(n):
            value, at = _read(kind.of, data, at, version)
            out.append(value)
        return out, at
    record = {}
    for name, field, since in kind:
        if version >= since:
            record[name], at = _read(field, data, at, version)
    return record, at


def _bytes(kind, value, version: int) -> bytes:
    if isinstance(kind, np.dtype):
        return np.asarray(value, kind.base).tobytes()
    if kind is TEXT:
        raw = value.encode()
        return len(raw).to_bytes(8, "little") + raw
    if isinstance(kind, Many):
        n = len(value).to_bytes(8, "little")
        if isinstance(kind.of, np.dtype):
            return n + np.asarray(value, kind.of.base).tobytes()
        return n + b"".join(_bytes(kind.of, v, version) for v in value)
    return b"".join(_bytes(field, value[name], version) for name, field, since in kind if version >= since)


def parse_archive(data: bytes) -> dict:
    """The scene of an archive's bytes, by field; what its version lacks is not there."""
    if data[:4] != MAGIC:
        raise ValueError("not a scene archive")
    version = int.from_bytes(data[4:8], "little")
    if version > LATEST:
        raise ValueError(f"version {version} of scene archives is not known")
    scene, _ = _read(SCENE, data, 12, version)
    return {"version": version, **scene}


def pack_archive(scene: dict, version: int = LATEST) -> bytes:
    return _start(version) + _bytes(SCENE, scene, version)


def _start(version: int) -> bytes:
    return MAGIC + version.to_bytes(4, "little") + bytes(4)


# ---- relations

_IDS = [("path", pa.string()), ("image_id", pa.int64())]
SCHEMAS = {
    "images": pa.schema([*_IDS, ("name", pa.string()), ("mask_name", pa.string()), ("file_id", pa.int64()), *[(n, pa.float64()) for n in ("min_depth", "avg_depth", "max_depth", "f", "fy", "skew", "px", "py")], ("width", pa.int32()), ("height", pa.int32()), ("R", pa.list_(pa.float64())), *[(n, pa.float64()) for n in ("cx", "cy", "cz")]]),
    "points": pa.schema([("path", pa.string()), ("point_id", pa.int64()), *[(n, pa.float64()) for n in ("x", "y", "z", "nx", "ny", "nz")], *[(n, pa.int32()) for n in "rgb"]]),
    "point_views": pa.schema([("path", pa.string()), ("point_id", pa.int64()), ("image_id", pa.int64()), ("weight", pa.float64())]),
    "view_scores": pa.schema([("path", pa.string()), ("ref_id", pa.int64()), ("nb_id", pa.int64()), ("points", pa.int64()), *[(n, pa.float64()) for n in ("scale", "angle", "area", "score")]]),
}


def _images(scene: dict) -> Iterator[dict]:
    for k, image in enumerate(scene["images"]):
        known = image.get("id", NONE)
        row = {"image_id": k, "name": image["name"], "mask_name": image.get("mask_name"), "file_id": k if known == NONE else int(known)}
        row |= dict(zip(("min_depth", "avg_depth", "max_depth"), map(float, image.get("depths", ())), strict=False))
        if NONE not in (image["platform_id"], image["camera_id"]):
            platform = scene["platforms"][image["platform_id"]]
            camera = platform["cameras"][image["camera_id"]]
            m = camera["K"]
            row |= {"f": float(m[0]), "fy": float(m[4]), "skew": float(m[1]), "px": float(m[2]), "py": float(m[5]), "width": int(camera["width"]) if "width" in camera else None, "height": int(camera["height"]) if "height" in camera else None}
            if image["pose_id"] != NONE:
                pose = platform["poses"][image["pose_id"]]
                turn = pose["R"].reshape(3, 3)
                centre = turn.T @ camera["C"] + pose["C"]
                row |= {"R": (camera["R"].reshape(3, 3) @ turn).ravel().tolist(), **dict(zip(("cx", "cy", "cz"), centre.tolist(), strict=True))}
        yield row


def _points(scene: dict) -> Iterator[dict]:
    normals, colours = scene["normals"], scene["colours"]
    for k, vertex in enumerate(scene["vertices"]):
        row = {"point_id": k, **dict(zip("xyz", vertex["X"].tolist(), strict=True))}
        if len(normals):
            row |= dict(zip(("nx", "ny", "nz"), normals[k].tolist(), strict=True))
        if len(colours):
            row |= dict(zip("bgr", colours[k].tolist(), strict=True))
        yield row


def _views(scene: dict) -> Iterator[dict]:
    for k, vertex in enumerate(scene["vertices"]):
        for i, weight in vertex["views"].tolist():
            yield {"point_id": k, "image_id": i, "weight": weight}


def _scores(scene: dict) -> Iterator[dict]:
    for k, image in enumerate(scene["images"]):
        for score in image.get("view_scores", ()):
            row = dict(zip(_SCORE.names, score.tolist(), strict=True))
            yield {"ref_id": k, "nb_id": row.pop("id"), **row}


_ROWS = {"images": _images, "points": _points, "point_views": _views, "view_scores": _scores}


def read_archives(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, points, point_views and view_scores of all archives at path. An image's id is its place in its archive. An
    image without camera or pose has null there, and so has a point without normal or colour. fy and skew stand beside f
    for cameras that have them."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def reader(name):
        def run(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows = ({"path": at, **row} for row in _ROWS[name](parse_archive(content.as_py())))
                    while some := list(islice(rows, BATCH)):
                        yield pa.RecordBatch.from_pylist(some, SCHEMAS[name])

        return run

    return {name: files.mapInArrow(reader(name), from_arrow_schema(schema)) for name, schema in SCHEMAS.items()}


def write_archive(tables: dict[str, DataFrame], path: str, version: int = LATEST) -> None:
    """One archive of images (as read, each image_id its place from 0) and points with point_views; view_scores where
    given. Points are written in order of point_id, so that they read back numbered from 0. The driver holds a row per
    image and streams the points."""
    from tessera.sources.files import filesystem

    images = tables["images"].orderBy("image_id").collect()
    if [r["image_id"] for r in images] != list(range(len(images))):
        raise ValueError("image ids have to count from 0 without gaps")
    scores: dict[int, list] = {}
    if "view_scores" in tables:
        for r in tables["view_scores"].orderBy("ref_id", F.desc("score"), "nb_id").toLocalIterator():
            scores.setdefault(r["ref_id"], []).append((r["nb_id"], *(r[n] for n in _SCORE.names[1:])))
    lens, cameras, poses, shots = {}, [], [], []
    for r in images:
        inner = tuple(r[n] for n in ("f", "fy", "skew", "px", "py", "width", "height"))
        camera = pose = NONE
        if r["f"] is not None:
            if inner not in lens:
                lens[inner] = len(cameras)
                f, fy, skew, px, py, width, height = inner
                cameras.append({"name": "", "band_name": "", "width": width or 0, "height": height or 0, "K": [f, skew or 0, px, 0, fy or f, py, 0, 0, 1], "R": np.eye(3), "C": np.zeros(3)})
            camera = lens[inner]
            if r["R"] is not None:
                pose = len(poses)
                poses.append((r["R"], (r["cx"], r["cy"], r["cz"])))
        depths = [0.0 if r[n] is None else r[n] for n in ("min_depth", "avg_depth", "max_depth")]
        shots.append({"name": r["name"], "mask_name": r["mask_name"] or "", "platform_id": 0, "camera_id": camera, "pose_id": pose, "id": r["file_id"], "depths": depths, "view_scores": np.array(scores.get(r["image_id"], []), _SCORE)})
    head = {"platforms": [{"name": "", "cameras": cameras, "poses": np.array(poses, _POSE)}], "images": shots}

    views = tables["point_views"].groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct(F.col("image_id").cast("long").alias("image_id"), F.col("weight").cast("double").alias("weight")))).alias("views"))
    points = tables["points"].join(views, "point_id", "left").orderBy("point_id").select("x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "views")
    found = points.agg(F.count(F.lit(1)), F.bool_and(F.col("nx").isNotNull()), F.bool_and(F.col("r").isNotNull())).collect()[0]

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            vertices = b"".join(_bytes(_VERTEX, {"X": (r["x"], r["y"], r["z"]), "views": np.array([(v["image_id"], v["weight"]) for v in r["views"] or ()], _VIEW)}, version) for r in rows)
            normals = np.array([(r["nx"], r["ny"], r["nz"]) for r in rows], "<f4").tobytes() if found[1] else b""
            colours = np.array([(r["b"], r["g"], r["r"]) for r in rows], "u1").tobytes() if found[2] else b""
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (vertices, normals, colours)], ["vertices", "normals", "colours"])

    packed = points.mapInArrow(pack, "vertices binary, normals binary, colours binary")
    empty = {"lines": [], "line_normals": [], "line_colours": [], "transform": np.eye(4).ravel(), "obb": [*np.eye(3).ravel(), *[0.0] * 6]}
    store, name = filesystem(path)
    with store.open_output_stream(name) as out:
        out.write(_start(version) + _bytes(_HEAD, head, version) + found[0].to_bytes(8, "little"))
        for column, there in (("vertices", None), ("normals", found[1]), ("colours", found[2])):
            if column != "vertices":
                out.write((found[0] if there else 0).to_bytes(8, "little"))
            if there is None or there:
                for part in packed.select(column).toLocalIterator():
                    out.write(part[0])
        out.write(_bytes([f for f in _TAIL if f[0] in empty], empty, version))
