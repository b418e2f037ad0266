"""Depth maps as a truncated signed distance volume of sparse voxels, and the surface where it changes sign.

A depth map touches the blocks of voxels near its points; those blocks meet the tiles of pixels that their voxels fall on,
by equi-join, where the voxels read their pixels, and are averaged over the maps. The surface is cut out of cubes of eight voxels, each split in six
tetrahedra in the same way, so that faces of neighbouring cubes fit.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geom as g
from tessera.operators.cloud import numbered
from tessera.operators.iterate import checkpointed

#: Voxels along a block's side, and pixels along a tile's.
BLOCK, TILE = 8, 16
VOXEL = ["vx", "vy", "vz"]


def ground_distance(depth: DataFrame, cameras: DataFrame) -> DataFrame:
    """(gsd): the mean over images of the length on the ground of a pixel at the image's mean depth; null without depths."""
    each = depth.filter("depth > 0").groupBy("image_id").agg(F.avg("depth").alias("d")).join(cameras.select("image_id", "f"), "image_id")
    return each.agg(F.avg(F.col("d") / F.col("f")).alias("gsd"))


def integrated(depth: DataFrame, cameras: DataFrame, voxel: float, truncation: float = 4.0) -> DataFrame:
    """(vx, vy, vz, value, weight): voxels with centre (v + 0.5) * voxel, their mean truncated distance to the surface, from
    -1 behind it to 1 before it, and how many maps it is of. truncation: in voxels. A voxel that lies further behind a
    map's surface than that, or not within a block that its points come near to, is not seen by that map."""
    limit = truncation * voxel
    cams = g.posed(cameras)
    turn = g.rotation(cams.columns)
    tile, tasks = ["image_id", "tr", "tc"], int(depth.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    pixels = depth.filter("depth > 0").select("image_id", r.alias("r"), c.alias("c"), "depth", F.floor(r / TILE).alias("tr"), F.floor(c / TILE).alias("tc"))
    pixels = pixels.repartition(tasks, *tile).groupBy(*tile, "r", "c").agg(F.min("depth").alias("depth"))
    in_tile = lambda r, c: ((r - F.col("tr") * TILE) * TILE + c - F.col("tc") * TILE).cast("int")
    tiles = pixels.groupBy(*tile).agg(F.map_from_entries(F.collect_list(F.struct(in_tile(F.col("r"), F.col("c")), "depth"))).alias("known"))
    tiles = tiles.select(*tile, F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), lambda k: F.try_element_at("known", k)).alias("depths"))
    p = g.back_project(F.col("c"), F.col("r"), F.col("depth"), F.col("f"), F.col("px"), F.col("py"), g.vec("cx", "cy", "cz"), turn)
    block = ["bx", "by", "bz"]
    blocks = pixels.join(cams, "image_id").select("image_id", *[x.alias(c) for c, x in zip("xyz", p, strict=True)])
    for c in "xyz":
        blocks = blocks.withColumn(f"b{c}", F.explode(F.sequence(F.floor((F.col(c) - limit) / (BLOCK * voxel)), F.floor((F.col(c) + limit) / (BLOCK * voxel)))))
    blocks = blocks.select("image_id", *block).distinct().repartition(tasks, "image_id", *block)

    def shot(rows: DataFrame, *kept: str) -> DataFrame:
        """The voxels of rows' blocks, their depth and their pixel."""
        voxels = rows
        for c, name in zip("xyz", VOXEL, strict=True):
            voxels = voxels.withColumn(name, F.explode(F.sequence(F.col(f"b{c}") * BLOCK, F.col(f"b{c}") * BLOCK + BLOCK - 1)))
        q = g.to_camera([(F.col(n) + 0.5) * voxel for n in VOXEL], g.vec("cx", "cy", "cz"), turn)
        u, v = g.project(q, F.col("f"), F.col("px"), F.col("py"))
        return voxels.join(cams, "image_id").filter(q[2] > 0).select("image_id", *kept, *VOXEL, q[2].alias("z"), g.to_pixel(v).alias("r"), g.to_pixel(u).alias("c"))

    # only blocks and tiles are shuffled: a block's voxels are made where it meets its cameras, and again where it meets a tile
    falls = shot(blocks, *block).select("image_id", *block, F.floor(F.col("r") / TILE).alias("tr"), F.floor(F.col("c") / TILE).alias("tc")).distinct()
    met = shot(falls.join(tiles.hint("merge"), tile), "tr", "tc", "depths").filter((F.floor(F.col("r") / TILE) == F.col("tr")) & (F.floor(F.col("c") / TILE) == F.col("tc")))
    seen = met.select(*VOXEL, (F.get("depths", in_tile(F.col("r"), F.col("c"))) - F.col("z")).alias("off")).filter(F.col("off") > -limit)
    return seen.groupBy(*VOXEL).agg(F.avg(F.least(F.lit(1.0), F.col("off") / limit)).alias("value"), F.count(F.lit(1)).alias("weight"))


def _offset(corner: int) -> tuple[int, int, int]:
    return corner & 1, corner >> 1 & 1, corner >> 2 & 1


def _tetrahedra() -> list[tuple[int, ...]]:
    """A cube's corners in six tetrahedra: the ways from corner 0 to corner 7 along one axis after another."""
    return [(0, 1 << a, (1 << a) | (1 << b), 7) for a, b, _ in permutations(range(3))]


def _triangles(corners: tuple[int, ...], inside: list[bool]) -> list[list[tuple[int, int]]]:
    """Triangles between the corners inside and those outside, as edges (corner inside, corner outside), anticlockwise as
    seen from outside."""
    ins, outs = [c for c, i in zip(corners, inside, strict=True) if i], [c for c, i in zip(corners, inside, strict=True) if not i]
    if not ins or not outs:
        return []
    cut = [(i, o) for i in ins for o in outs]
    found = [cut] if len(cut) == 3 else [[cut[0], cut[1], cut[3]], [cut[0], cut[3], cut[2]]]
    at = lambda e: (np.array(_offset(e[0])) + _offset(e[1])) / 2
    way = np.mean([_offset(o) for o in outs], axis=0) - np.mean([_offset(i) for i in ins], axis=0)
    return [t if np.cross(at(t[1]) - at(t[0]), at(t[2]) - at(t[0])) @ way > 0 else t[::-1] for t in found]


def _table() -> Column:
    """By tetrahedron and by the pattern of which of its corners are inside: its triangles, each three edges of two corners."""
    edge = lambda e: F.array(*[F.lit(c) for c in e])
    row = lambda ts: F.array(*[F.array(*[edge(e) for e in t]) for t in ts]).cast("array<array<array<int>>>")
    return F.array(*[F.array(*[row(_triangles(t, [bool(k >> i & 1) for i in range(4)])) for k in range(16)]) for t in _tetrahedra()])


def surface(voxels: DataFrame, voxel: float) -> tuple[DataFrame, DataFrame]:
    """(vertices(v_id, x, y, z), faces(f_id, a, b, c)) where voxels(vx, vy, vz, value) change from less than 0 to 0 and more;
    faces look to the latter. Only cubes all of whose eight voxels are there have faces, so the surface ends where
    voxels do. Vertices lie on the edges between voxels, a vertex an edge."""
    corner = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(o).alias(f"o{c}") for o, c in zip(_offset(k), "xyz", strict=True)]) for k in range(8)])
    sent = voxels.select(*VOXEL, F.col("value").cast("double").alias("value"), F.inline(corner))
    cubes = sent.groupBy(*[(F.col(n) - F.col(f"o{c}")).alias(n) for n, c in zip(VOXEL, "xyz", strict=True)]).agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("values"))
    cubes = cubes.filter("n = 8 and low < 0 and high >= 0").withColumn("values", F.array(*[F.element_at("values", k) for k in range(8)]))
    inside = lambda k: (F.get("values", F.lit(k)) < 0).cast("int")
    patterns = F.array(*[sum((inside(c) * (1 << i) for i, c in enumerate(t)), F.lit(0)) for t in _tetrahedra()])
    found = F.flatten(F.zip_with(_table(), patterns, lambda rows, pattern: F.get(rows, pattern)))
    rows = cubes.select(*VOXEL, "values", F.posexplode(found).alias("triangle", "edges")).select(*VOXEL, "values", "triangle", F.posexplode("edges").alias("k", "edge"))
    low, high = F.array_min("edge"), F.array_max("edge")  # the same way round in every cube
    place = lambda corner, axis: F.col(VOXEL[axis]) + F.call_function("shiftright", corner, F.lit(axis)).bitwiseAND(F.lit(1))
    ends = [place(e, a).alias(f"{n}{c}") for n, e in (("p", low), ("q", high)) for a, c in enumerate("xyz")]
    rows = checkpointed(rows.select(*VOXEL, "triangle", "k", *ends, F.get("values", low).alias("at_p"), F.get("values", high).alias("at_q")))
    key = [f"{n}{c}" for n in "pq" for c in "xyz"]
    share = F.col("at_p") / (F.col("at_p") - F.col("at_q"))
    spots = rows.groupBy(*key).agg(F.any_value("at_p").alias("at_p"), F.any_value("at_q").alias("at_q"))
    spots = checkpointed(numbered(spots, *key).withColumnRenamed("number", "v_id"))
    vertices = spots.select("v_id", *[((F.col(f"p{c}") + 0.5 + share * (F.col(f"q{c}") - F.col(f"p{c}"))) * voxel).alias(c) for c in "xyz"])
    faces = rows.join(spots.select(*key, "v_id"), key).groupBy(*VOXEL, "triangle").agg(*[F.max(F.when(F.col("k") == i, F.col("v_id"))).alias(c) for i, c in enumerate("abc")])
    return vertices, numbered(faces, *VOXEL, "triangle").select(F.col("number").alias("f_id"), "a", "b", "c")


def mesh_of(depth: DataFrame, cameras: DataFrame, voxel: float = 0.0, truncation: float = 4.0, least_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """surface() of the depth maps' volume, of voxels that at least `least_weight` maps see; a voxel of 0 is three ground
    distances. Without depths there is no face."""
    if not voxel:
        voxel = 3 * (ground_distance(depth, cameras).collect()[0][0] or 1.0)
    return surface(integrated(depth, cameras, voxel, truncation).filter(F.col("weight") >= least_weight), voxel)


