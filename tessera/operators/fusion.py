"""Depth maps fused to points in order: the pixels of better connected images first, each taking with it the pixels of other
images that agree with it and erasing those that it hides.

In order, that is a loop over all pixels. Here a pixel is settled as soon as nothing before it can still change its lot:
no pixel that comes earlier and is open touches one that it touches. All that are ready touch nothing in common, so a
round settles them at once, and the outcome is the loop's. Rounds are few, as most pixels are taken by the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geom as g
from tessera.operators.cloud import numbered
from tessera.operators.iterate import checkpointed

#: A confidence counts as a weight of 1 / (max(1 - conf, LEAST_DOUBT) depth^2).
LEAST_DOUBT = 0.03
#: Places of a pixel's row and of its image in the number that orders pixels.
ROW, IMAGE = 1 << 20, 1 << 40


def image_order(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """(image_id, place): images from 0 by how many others they are paired with, most first, then by id."""
    n = pairs.select("ref_id", "nb_id").distinct().groupBy(F.col("ref_id").alias("image_id")).agg(F.count(F.lit(1)).alias("n"))
    counted = images.select("image_id").distinct().join(n, "image_id", "left").select("image_id", (-F.coalesce("n", F.lit(0))).alias("fewer"))
    return numbered(counted, "fewer", "image_id").select("image_id", F.col("number").alias("place"))


def confidence_weight(conf, depth):
    return 1 / (F.greatest(1 - conf, F.lit(LEAST_DOUBT)) * depth * depth)


def touched(pixels: DataFrame, cameras: DataFrame, pairs: DataFrame, threshold: float, least_cosine: float) -> DataFrame:
    """(seed, key, agrees): the pixels that a pixel would take (agrees) or hide if a point began at it; and itself. pixels(key,
    image_id, r, c, depth, x, y, z, nx, ny, nz) in the world."""
    cams = g.posed(cameras)
    own = pixels.select(F.col("key").alias("seed"), F.col("image_id").alias("ref_id"), *[F.col(c).alias(f"own_{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    shot = own.join(pairs.select("ref_id", "nb_id").distinct(), "ref_id").join(cams.withColumnRenamed("image_id", "nb_id"), "nb_id")
    q = g.to_camera(g.vec("own_x", "own_y", "own_z"), g.vec("cx", "cy", "cz"), g.rotation(cams.columns))
    u, v = g.project(q, F.col("f"), F.col("px"), F.col("py"))
    normal = [F.col(f"own_n{c}") for c in "xyz"]
    shot = shot.filter(q[2] > 0).select("seed", "nb_id", g.to_pixel(v).alias("r"), g.to_pixel(u).alias("c"), q[2].alias("there"), *normal)
    other = pixels.select(F.col("image_id").alias("nb_id"), "r", "c", "key", "depth", "nx", "ny", "nz")
    met = shot.join(other, ["nb_id", "r", "c"])
    agrees = g.depth_similar(F.col("there"), F.col("depth"), threshold) & (g.dot(normal, g.vec("nx", "ny", "nz")) > least_cosine)
    rows = met.withColumn("agrees", agrees).filter(F.col("agrees") | (F.col("there") < F.col("depth"))).select("seed", "key", "agrees")
    return rows.unionByName(pixels.select(F.col("key").alias("seed"), "key", F.lit(True).alias("agrees")))


def settled(touches: DataFrame, least_views: int) -> DataFrame:
    """(seed, key): which pixels each accepted seed of touches(seed, key, agrees) takes, as if seeds were gone through in
    order. A seed counts only while its own pixel is neither taken nor erased, with those of its others that aren't."""
    out, left = None, checkpointed(touches)
    while not left.isEmpty():
        first = left.groupBy("key").agg(F.min("seed").alias("first"))
        ready = left.join(first, "key").groupBy("seed").agg(F.min((F.col("first") == F.col("seed")).cast("int")).alias("free"), F.sum(F.col("agrees").cast("int")).alias("views")).filter("free = 1")
        ready = checkpointed(ready.select("seed", (F.col("views") >= least_views).alias("accepted")))
        done = checkpointed(left.join(ready.filter("accepted").select("seed"), "seed"))
        taken = done.filter("agrees").select("seed", "key")
        out = taken if out is None else out.unionByName(taken)
        gone = done.select("key").distinct()
        left = left.join(ready.select("seed"), "seed", "left_anti").join(gone, "key", "left_anti").join(gone.withColumnRenamed("key", "seed"), "seed", "left_anti")
        left = checkpointed(left)
    return out if out is not None else left.select("seed", "key")


def ordered_fusion(depth: DataFrame, cameras: DataFrame, pairs: DataFrame, threshold: float = 0.01, degrees: float = 25.0, least_views: int = 2, colours: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, r, c, x, y, z, nx, ny, nz, views, weight and the colours): a point for each pixel that begins one, at the mean
    of what it takes, weighted by confidence; views are their number, weight the sum.

    depth(image_id, r, c, depth[, conf][, nx, ny, nz]) has normals in camera coordinates; without them all count as alike
    and look to the first camera's axis. pairs(ref_id, nb_id): the images that an image's pixels are looked for in. Pixels
    without depth, or of images without camera, are left out, as are further columns; a pixel given twice counts once,
    with its least values; an empty table gives no row."""
    columns = depth.columns
    has_normals = all(c in columns for c in ("nx", "ny", "nz"))
    kept = ["image_id", "r", "c", "depth", *(["conf"] if "conf" in columns else []), *(["nx", "ny", "nz"] if has_normals else []), *colours]
    rows = depth.select(*kept).filter("depth > 0 and image_id is not null and r is not null and c is not null")
    rows = rows.groupBy("image_id", "r", "c").agg(F.min(F.struct(*kept[3:])).alias("m")).select("image_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "m.*")
    cams = g.posed(cameras)
    turn = g.rotation(cams.columns)
    world = g.back_project(F.col("c"), F.col("r"), F.col("depth"), F.col("f"), F.col("px"), F.col("py"), g.vec("cx", "cy", "cz"), turn)
    normal = [F.lit(0.0), F.lit(0.0), F.lit(-1.0)]
    if has_normals:
        n = g.vec("nx", "ny", "nz")
        normal = n if turn is None else g.rotate([turn[3 * j + i] for i in range(3) for j in range(3)], n)
    conf = F.coalesce(F.col("conf"), F.lit(1.0)) if "conf" in columns else F.lit(1.0)
    at = rows.join(image_order(cams, pairs), "image_id").join(cams, "image_id")
    key = F.col("place") * IMAGE + F.col("r") * ROW + F.col("c")
    pixels = checkpointed(at.select(key.alias("key"), "image_id", "r", "c", "depth", *[v.alias(n) for v, n in zip(world, "xyz", strict=True)], *[v.alias(n) for v, n in zip(normal, ("nx", "ny", "nz"), strict=True)], confidence_weight(conf, F.col("depth")).alias("weight"), *colours))
    met = settled(touched(pixels, cameras, pairs, threshold, F.cos(F.radians(F.lit(degrees)))), least_views)
    w = F.col("weight")
    names = ["x", "y", "z", "nx", "ny", "nz", *colours]
    sums = met.join(pixels, "key").groupBy("seed").agg(F.count(F.lit(1)).alias("views"), F.sum(w).alias("weight"), *[F.sum(F.col(c) * w).alias(c) for c in names])
    length = g.norm(g.vec("nx", "ny", "nz"))
    mean = [(F.col(c) / w).alias(c) for c in ("x", "y", "z")] + [F.try_divide(F.col(c), length).alias(c) for c in ("nx", "ny", "nz")] + [(F.col(c) / w).alias(c) for c in colours]
    begun = pixels.select(F.col("key").alias("seed"), "image_id", "r", "c")
    return sums.select("seed", "views", "weight", *mean).join(begun, "seed").select("image_id", "r", "c", *names, "views", "weight")
