"""What cameras can see: a frustum join over a hierarchy of cells, and a rasteriser on it.

Items are spheres (id, x, y, z, radius). Each lies in one cell of one level, the deepest whose cells are no smaller than it;
a cell's bounds are loose by half its side, so they hold what lies in it. A camera starts from the cells of a coarse
level and goes down, level by level, into those occupied cells whose bounds its frustum meets: each step is an equi-join
on the cell. No pair is formed of a camera and an item unless all cells above the item meet the frustum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geom as g
from tessera.operators.iterate import checkpointed

#: Level at which cameras start, each with the 4 x 4 x 4 cells of the space.
START = 2
CELL = ["gx", "gy", "gz"]
#: Levels at most, where they follow from the items, and cameras of a cell that one task meets with its items.
MOST_LEVELS, SHARE = 16, 2048
#: Coinciding cameras that get their rows together, and rows that a task makes of them.
EACH, ROWS = 64, 2_000_000
#: Pixels of faces that the rasteriser looks at together.
PIXELS = 1 << 18
#: A pixel this close to an edge lies on it, and of faces this much apart in depth none is nearer, relatively.
ON_EDGE = 1e-9
WINDOW = ("left", "right", "top", "bottom")


def views(cameras: DataFrame) -> DataFrame:
    """Cameras with the window of pixels that they see, that of their image unless they have one (left, right, top, bottom),
    and their rotation as columns r0 to r8."""
    cams = g.posed(cameras)
    turn = [F.col(f"r{k}") for k in range(9)] if "r0" in cams.columns else g.rotation(cams.columns) or [F.lit(float(k in (0, 4, 8))) for k in range(9)]
    edge = {"left": F.lit(-0.5), "right": F.col("width") - 0.5, "top": F.lit(-0.5), "bottom": F.col("height") - 0.5}
    window = [(F.col(n) if n in cams.columns else c).cast("double").alias(n) for n, c in edge.items()]
    numbers = [F.col(c).cast("double").alias(c) for c in ("cx", "cy", "cz", "f", "px", "py")]
    return cams.select("image_id", *numbers, *window, *[t.cast("double").alias(f"r{k}") for k, t in enumerate(turn)])


def coinciding(cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cameras that see the same, having one place, rotation, focal length, middle and window, as one each: the rows of views()
    of the one with the least image_id, with the number n of those it stands for; and (image_id, lead) of all. Cameras
    with a null, which see nothing, are left out."""
    own = checkpointed(views(cameras).dropna().distinct())
    alike = [c for c in own.columns if c != "image_id"]
    leads = checkpointed(own.groupBy(*alike).agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("n")))
    return leads, own.join(leads.withColumnRenamed("image_id", "lead").hint("merge"), alike).select("image_id", "lead")


def of_each(found: DataFrame, leads: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Rows (image_id, ..) of cameras that stand for others, of which there are `most` in the end, for each of those cameras.
    A camera's rows meet those it stands for in parts of about EACH, which are dealt by number: their size says nothing of
    what becomes of them."""
    if leads.filter("n > 1").isEmpty():
        return found
    parts = max(found.sparkSession.sparkContext.defaultParallelism, most // ROWS + 1)
    shares = leads.select(F.col("image_id").alias("lead"), F.ceil(F.col("n") / EACH).cast("int").alias("parts"))
    left = found.withColumnRenamed("image_id", "lead").join(shares.hint("merge"), "lead").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = members.join(shares.hint("merge"), "lead").select("lead", F.pmod(F.xxhash64("image_id"), F.col("parts")).cast("int").alias("part"), F.col("image_id").cast("long").alias("image_id"))
    key = ["lead", "part"]
    return left.repartition(parts, *key).join(right.repartition(parts, *key).hint("merge"), key).select(*found.columns)


def seen_from(p: g.Vec) -> list[Column]:
    """The point in the coordinates of the camera of views() that its row holds."""
    return g.to_camera(p, g.vec("cx", "cy", "cz"), [F.col(f"r{k}") for k in range(9)])


def meets(q: g.Vec, radius: Column) -> Column:
    """Whether a sphere about q, in camera coordinates, can meet the camera's frustum: it lies wholly beyond no plane of it."""
    f = F.col("f")
    sides = [(q[axis] * f - (F.col(edge) - F.col(middle)) * q[2]) * sign >= -radius * F.sqrt(f * f + (F.col(edge) - F.col(middle)) ** 2)
             for axis, middle, edge, sign in ((0, "px", "left", 1), (0, "px", "right", -1), (1, "py", "top", 1), (1, "py", "bottom", -1))]
    return reduce(lambda a, b: a & b, sides, q[2] >= -radius)


def joined(items: DataFrame, cameras: DataFrame, levels: int | None = None) -> DataFrame:
    """(id, image_id): the items (id, x, y, z, radius) whose sphere can meet the frustum of a camera's window, once each. Items
    with a null are left out; cameras are as for views(). Without levels there are as many as the mean radius and the
    number of items ask for, so that cells don't fill up as a scene grows.

    Neither cells nor cameras are sent to all tasks. A cell that many cameras see is dealt by cameras to several tasks."""
    items = items.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "radius")]).dropna()
    box = items.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("n"), F.avg("radius").alias("radius")).collect()[0]
    cams = checkpointed(views(cameras))
    if box["low_x"] is None:
        return items.select("id").join(cams.select("image_id").limit(0))
    low = [box[f"low_{c}"] for c in "xyz"]
    size = max(*(box[f"high_{c}"] - at for c, at in zip("xyz", low, strict=True)), 1e-9) * (1 + 1e-9)
    if levels is None:
        fits = math.log2(size / (2 * box["radius"])) if box["radius"] > 0 else MOST_LEVELS
        levels = int(max(6, min(fits, math.log2(box["n"]) / 2 + 1, MOST_LEVELS)))
    levels = max(levels, START)
    side = lambda level: size / 2.0**level
    level = F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(F.log2(F.lit(size) / (2 * F.greatest("radius", F.lit(size * 2.0 ** -(levels + 2)))))))).cast("int")
    at = [F.least(F.floor((F.col(c) - v) * F.pow(F.lit(2.0), "level") / size), F.pow(F.lit(2.0), "level") - 1).cast("long").alias(n) for c, v, n in zip("xyz", low, CELL, strict=True)]
    # out of an array of one row, or Catalyst would infer from the cells' expressions through every join above
    row = F.struct("id", "x", "y", "z", "radius", "level", *at)
    placed = checkpointed(items.withColumn("level", level).select(F.inline(F.array(row))))
    own = placed.select("level", *CELL).distinct()
    above = own.withColumn("up", F.explode(F.sequence(F.lit(0), "level"))).select((F.col("level") - F.col("up")).alias("level"), *[F.call_function("shiftright", F.col(c), F.col("up")).alias(c) for c in CELL])
    nodes = checkpointed(above.distinct())

    def met(frontier: DataFrame, level: int) -> DataFrame:
        """(image_id, gx, gy, gz) where the loose bounds of the cell meet the frustum. Spheres too large for the top level reach
        beyond them, so there all cells are entered."""
        if level == 0:
            return frontier.select("image_id", *CELL)
        centre = [F.lit(v) + (F.col(c) + 0.5) * side(level) for v, c in zip(low, CELL, strict=True)]
        seen = frontier.join(cams.hint("merge"), "image_id").filter(meets(seen_from(centre), F.lit(math.sqrt(3) * side(level))))
        return seen.select("image_id", *CELL)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    entered, frontier = None, None
    for depth in range(levels + 1):
        here = nodes.filter(F.col("level") == depth).select(*CELL).hint("merge")
        if depth <= START:
            start = cams.select("image_id")
            for c in CELL:
                start = start.withColumn(c, every(2**depth))
            frontier = met(start, depth).join(here, CELL)
        else:
            below = here.select(*[F.shiftright(c, 1).alias(f"up_{c}") for c in CELL], *CELL)
            parents = frontier.withColumnsRenamed({c: f"up_{c}" for c in CELL})
            frontier = met(parents.join(below.hint("merge"), [f"up_{c}" for c in CELL]).drop(*[f"up_{c}" for c in CELL]), depth)
        if depth >= START:
            frontier = checkpointed(frontier)
        level_cells = frontier.withColumn("level", F.lit(depth))
        entered = level_cells if entered is None else entered.unionByName(level_cells)
    cell, entered = ["level", *CELL], checkpointed(entered)
    parts = entered.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("parts")).hint("merge")
    part = F.pmod(F.xxhash64("image_id"), F.col("parts")).cast("int")
    left = entered.join(parts, cell).withColumn("part", part).drop("parts").join(cams.hint("merge"), "image_id")
    right = placed.join(parts, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.join(right.hint("merge"), [*cell, "part"]).filter(meets(seen_from(g.vec("x", "y", "z")), F.col("radius"))).select("id", "image_id")


def face_spheres(corners: DataFrame) -> DataFrame:
    """(id, x, y, z, radius) about the centroids of faces (f_id, ax .. cz)."""
    points = [[F.col(f"{k}{c}") for c in "xyz"] for k in "abc"]
    centre = [sum((p[i] for p in points[1:]), points[0][i]) / 3 for i in range(3)]
    radius = F.greatest(*[g.distance(p, centre) for p in points])
    return corners.select(F.col("f_id").alias("id"), *[c.alias(n) for c, n in zip(centre, "xyz", strict=True)], (radius * (1 + 1e-9) + 1e-12).alias("radius"))


def _boxes(corners: np.ndarray, camera: np.ndarray, window: np.ndarray, near: float, whole: bool) -> np.ndarray:
    """(first u, last u, first v, last v) of the pixels of the window (left, right, top, bottom) that each face (corner, axis; in
    camera coordinates) can cover, of its part that is not nearer than `near`: about its corners there and where its edges
    cross that plane. The first is beyond the last where there are none."""
    spots = [np.where(corners[:, k, 2:] >= near, corners[:, k], np.nan) for k in range(3)]
    for i, j in ((0, 1), (1, 2), (2, 0)):
        p, q = corners[:, i], corners[:, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            met = p + ((near - p[:, 2]) / (q[:, 2] - p[:, 2]))[:, None] * (q - p)
        spots.append(np.where(((p[:, 2] >= near) != (q[:, 2] >= near))[:, None], met, np.nan))
    q = np.stack(spots, axis=1)
    uv = [camera[:, 1 + k, None] + camera[:, :1] * q[:, :, k] / q[:, :, 2] for k in (0, 1)]
    least, most = (np.stack([f(np.where(np.isnan(x), empty, x), axis=1) for x in uv], axis=1) for f, empty in ((np.min, np.inf), (np.max, -np.inf)))
    low, high = window[:, ::2], window[:, 1::2]
    first, last = np.maximum(np.ceil(least), np.ceil(low)), np.minimum(np.floor(most), np.ceil(high) - 1)
    if whole:
        out = (corners[:, :, 2].min(axis=1) < near)[:, None] | (least < low) | (most > high)
        last = np.where(out.any(axis=1)[:, None], -np.inf, last)
    return np.stack([first[:, 0], last[:, 0], first[:, 1], last[:, 1]], axis=1)


def _hits(keys: np.ndarray, values: np.ndarray, place: np.ndarray, tile: int, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixel, depth, face) where the faces of keys (image, tile_r, tile_c, f_id and the bounds of their pixels in the tile) and
    values (f, px, py and three corners) are met, in the order of the faces. Pixels are numbered through the tiles, whose
    numbers are place."""
    wide = keys[:, 5] - keys[:, 4] + 1
    times = wide * (keys[:, 7] - keys[:, 6] + 1)
    own = np.repeat(np.arange(len(keys)), times)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
    r, c = keys[own, 6] + nth // wide[own], keys[own, 4] + nth % wide[own]
    p, q, s = values[:, 3:6], values[:, 6:9], values[:, 9:12]
    edges = np.stack([np.cross(q, s), np.cross(s, p), np.cross(p, q)])
    volume = (p * edges[0]).sum(axis=1)
    edges, volume = np.where(volume[:, None] < 0, -edges, edges), np.abs(volume)
    f, px, py = values[own, :3].T
    x, y = (c + keys[own, 2] * tile - px) / f, (r + keys[own, 1] * tile - py) / f
    # a pixel's ray meets the face where it passes all edges on the side of the volume that they span with the eye
    w = [e[own, 0] * x + e[own, 1] * y + e[own, 2] for e in edges]
    volume = volume[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = volume / (w[0] + w[1] + w[2])
    met = (np.minimum(np.minimum(w[0], w[1]), w[2]) >= -ON_EDGE * volume) & (volume > 0) & (z >= near) & np.isfinite(z)
    return ((place[own] * tile + r) * tile + c)[met], z[met], keys[own[met], 3]


def _nearest(pixel: np.ndarray, depth: np.ndarray, face: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of each pixel's hits, where a hit has to be nearer than those before it by more than ON_EDGE. In round k all
    pixels take their k-th hit."""
    order = np.argsort(pixel, kind="stable")
    pixel, depth, face = pixel[order], depth[order], face[order]
    start = np.flatnonzero(np.diff(pixel, prepend=-1))
    times = np.diff(start, append=len(pixel))
    start = start[np.argsort(-times, kind="stable")]
    open_at = len(times) - np.searchsorted(np.sort(times), np.arange(1, times.max(initial=0)), "right")  # pixels with more than k hits
    best = start.copy()
    for k, n in enumerate(open_at, 1):
        closer = depth[start[:n] + k] < depth[best[:n]] * (1 - ON_EDGE)
        best[:n][closer] = start[:n][closer] + k
    return pixel[best], depth[best], face[best]


def rasterised(corners: DataFrame, cameras: DataFrame, tile: int = 64, near: float = 1e-3, whole: bool = False, levels: int | None = None) -> DataFrame:
    """(image_id, r, c, f_id, depth): the nearest face (ties to the lower id) at each pixel of each camera, of faces (f_id, ax,
    ay, az .. cz). Of a face that lies partly outside an image, or nearer than `near`, the rest counts; with `whole`, a
    face takes part in an image only where that holds all of it.

    A face goes to those tiles of an image that its bounds touch. A task holds the depths of one tile, and the hits among
    PIXELS pixels of faces, at a time; not a tile's faces, however many they are. Faces seen edge on, and rows with a null, leave no pixel. Cameras that coincide are
    rasterised once."""
    leads, members = coinciding(cameras)
    most = leads.agg(F.sum(F.col("n") * (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")))).collect()[0][0] or 0
    return of_each(_rasterised(corners, leads, tile, near, whole, levels), leads, members, int(most))


def _rasterised(corners: DataFrame, cameras: DataFrame, tile: int = 64, near: float = 1e-3, whole: bool = False, levels: int | None = None) -> DataFrame:
    """rasterised() of cameras of which each is for itself."""
    corners = corners.select("f_id", *[f"{k}{c}" for k in "abc" for c in "xyz"]).dropna()
    pairs = joined(face_spheres(corners), cameras, levels).withColumnRenamed("id", "f_id")
    named = corners.select("f_id", *[F.col(f"{k}{c}").alias(f"corner_{k}{c}") for k in "abc" for c in "xyz"])  # a camera has cx, too
    rows = pairs.join(named.hint("merge"), "f_id").join(views(cameras).hint("merge"), "image_id")
    eye = [[x.alias(f"{k}{c}") for x, c in zip(seen_from([F.col(f"corner_{k}{c}") for c in "xyz"]), "xyz", strict=True)] for k in "abc"]
    rows = rows.select("image_id", "f_id", "f", "px", "py", *WINDOW, *[x for q in eye for x in q])
    order, limits = ["image_id", "tile_r", "tile_c", "f_id"], ["first_u", "last_u", "first_v", "last_v"]
    numbers = ["f", "px", "py", *[f"{k}{c}" for k in "abc" for c in "xyz"]]

    def spread(batches) -> Iterator[pa.RecordBatch]:
        """A row for each tile that a face's box touches."""
        for batch in batches:
            ids, values = [batch.column(k).to_numpy() for k in range(2)], np.stack([batch.column(k).to_numpy() for k in range(2, 18)], axis=1)
            box = _boxes(values[:, 7:].reshape(-1, 3, 3), values[:, :3], values[:, 3:7], near, whole)
            some = np.flatnonzero((box[:, 0] <= box[:, 1]) & (box[:, 2] <= box[:, 3]))
            box = box[some].astype(np.int64)
            spans = [box[:, k + 1] // tile - box[:, k] // tile + 1 for k in (0, 2)]
            times = spans[0] * spans[1]
            own = np.repeat(np.arange(len(some)), times)
            place = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
            tiles = [box[own, 2] // tile + place // spans[0][own], box[own, 0] // tile + place % spans[0][own]]
            columns = [ids[0][some][own], *tiles, ids[1][some][own], *box[own].T, *np.delete(values, range(3, 7), axis=1)[some][own].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 8 else pa.float64()) for k, c in enumerate(columns)], [*order, *limits, *numbers])

    rows = rows.select(F.col("image_id").cast("long"), F.col("f_id").cast("long"), "f", "px", "py", *WINDOW, *numbers[3:])
    spans = rows.mapInArrow(spread, ", ".join([*[f"{c} long" for c in [*order, *limits]], *[f"{c} double" for c in numbers]]))
    dealt = spans.repartition("image_id", "tile_r", "tile_c").sortWithinPartitions(*order)

    def run(batches) -> Iterator[pa.RecordBatch]:
        """The pixels of tiles that are done come out; those of the last one are carried on as its first hits."""
        at, carried = np.zeros((0, 3), np.int64), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

        def out(tiles, pixel, depth, face):
            own, r, c = tiles[pixel // tile**2], pixel % tile**2 // tile, pixel % tile
            columns = [own[:, 0], r + own[:, 1] * tile, c + own[:, 2] * tile, face, depth]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["image_id", "r", "c", "f_id", "depth"])

        for batch in batches:
            every = np.stack([batch.column(k).to_numpy() for k in range(8)], axis=1)
            numbers_of = np.stack([batch.column(k).to_numpy() for k in range(8, 20)], axis=1)
            for k, low, most in ((4, 2, np.maximum), (5, 2, np.minimum), (6, 1, np.maximum), (7, 1, np.minimum)):
                every[:, k] = most(every[:, k] - every[:, low] * tile, 0 if most is np.maximum else tile - 1)
            ends = np.cumsum((every[:, 5] - every[:, 4] + 1) * (every[:, 7] - every[:, 6] + 1))
            first = 0
            while first < len(every):
                beyond = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIXELS, "right")))
                keys, values = every[first:beyond], numbers_of[first:beyond]
                first = beyond
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:, :3] != keys[:-1, :3]).any(axis=1)
                new[0] = not len(at) or (keys[0, :3] != at[-1]).any()
                tiles = np.concatenate([at, keys[new, :3]])
                hits = _hits(keys, values, np.cumsum(new) - 1 + len(at), tile, near)
                pixel, depth, face = _nearest(*[np.concatenate(x) for x in zip(carried, hits, strict=True)])
                last = pixel // tile**2 == len(tiles) - 1
                if not last.all():
                    yield out(tiles, pixel[~last], depth[~last], face[~last])
                at, carried = tiles[-1:], (pixel[last] % tile**2, depth[last], face[last])
        if len(carried[0]):
            yield out(at, *carried)

    return dealt.mapInArrow(run, "image_id long, r int, c int, f_id long, depth double")


def scaled(cameras: DataFrame, side: int) -> DataFrame:
    """Cameras of images whose larger side is at most `side`."""
    share = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest("width", "height"))
    new = {"width": F.floor(F.col("width") * share + 0.5).cast("int"), "height": F.floor(F.col("height") * share + 0.5).cast("int"), "f": F.col("f") * share}
    return cameras.withColumns(new | {c: (F.col(c) + 0.5) * share - 0.5 for c in ("px", "py")})


def vertex_views(corners: DataFrame, vertices: DataFrame, cameras: DataFrame, side: int = 320, factor: float = 0.985, least: int = 2) -> DataFrame:
    """(v_id, image_id): which images see a vertex of vertices(v_id, x, y, z): those at whose pixel, in images of at most `side`
    pixels, the nearest face is no nearer than `factor` of its depth. Vertices seen by fewer than `least` images have no row,
    nor have views within a pixel of the border. Cameras that coincide are looked at once."""
    small, members = coinciding(scaled(cameras, side))
    pairs = joined(vertices.select(F.col("v_id").alias("id"), "x", "y", "z", F.lit(0.0).alias("radius")), small).withColumnRenamed("id", "v_id")
    q = seen_from(g.vec("x", "y", "z"))
    u, v = g.project(q, F.col("f"), F.col("px"), F.col("py"))
    at = pairs.join(vertices.select("v_id", "x", "y", "z").hint("merge"), "v_id").join(views(small).hint("merge"), "image_id").filter(q[2] > 0)
    inside = (u >= 1) & (v >= 1) & (u < F.col("right") - 0.5) & (v < F.col("bottom") - 0.5)
    at = at.filter(inside).select("v_id", "image_id", g.to_pixel(v).cast("int").alias("r"), g.to_pixel(u).cast("int").alias("c"), q[2].alias("z"))
    nearest = _rasterised(corners, small).select("image_id", "r", "c", "depth")
    seen = at.join(nearest.hint("merge"), ["image_id", "r", "c"]).filter(F.col("z") * factor < F.col("depth"))
    seen = checkpointed(seen.select("v_id", "image_id").join(small.select("image_id", "n").hint("merge"), "image_id"))
    enough = seen.groupBy("v_id").agg(F.sum("n").alias("views")).filter(F.col("views") >= least).select("v_id")
    most = seen.agg(F.sum("n")).collect()[0][0] or 0
    return of_each(seen.join(enough.hint("merge"), "v_id", "left_semi").select("v_id", "image_id"), small, members, most)
