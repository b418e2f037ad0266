"""View graph: co-visibility, neighbour scores, selection, sub-scenes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geom as g
from tessera.operators.cloud import numbered


def covisible(point_views: DataFrame) -> DataFrame:
    """(a_id, b_id, points): unordered pairs of images, a_id the lesser, and how many points both see. A point's views are one
    row, a sorted list that is turned into pairs in place: nothing is joined or sorted, and a task holds no more than its
    pairs' counts. A view given n times counts n times with each other one."""
    views = F.array_sort(F.collect_list("image_id"))
    rows = point_views.filter("point_id is not null and image_id is not null").groupBy("point_id").agg(views.alias("views"))
    tails = rows.filter(F.size("views") > 1).select("views", F.posexplode("views").alias("at", "a_id"))
    pairs = tails.select("a_id", F.explode(F.slice("views", F.col("at") + 2, F.size("views"))).alias("b_id")).filter("a_id < b_id")
    return pairs.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("points"))


def covisible_pairs(point_views: DataFrame) -> DataFrame:
    """(ref_id, nb_id, points): ordered pairs of images and how many points both see. The unordered pairs of a point are
    summed before the shuffle and turned into two at the end; many views of a point skew only its own rows."""
    way = lambda x, y: F.struct(F.col(x).alias("ref_id"), F.col(y).alias("nb_id"))
    return covisible(point_views).select(F.inline(F.array(way("a_id", "b_id"), way("b_id", "a_id"))), "points")


def angle_weight(angle_deg, best: float = 12.0):
    """1 at the best angle; falls off faster below it than above it."""
    low, high = -1 / (2 * (0.38 * best) ** 2), -1 / (2 * (0.7 * best) ** 2)
    d = angle_deg - best
    return F.exp(d * d * F.when(angle_deg < best, low).otherwise(high))


def scale_weight(scale):
    return F.when(scale > 1.6, (1.6 / scale) ** 2).when(scale >= 1, 1.0).otherwise(scale * scale)


#: Angles, scales and weights are summed as whole parts of these, so that no order of adding shows in a mean.
MICRO, NANO = 10**6, 10**9


def _whole(x, parts: int):
    return F.floor(x * parts + 0.5)


def neighbor_scores(point_views: DataFrame, points: DataFrame, cameras: DataFrame, least_points: int = 3) -> DataFrame:
    """Scores each ordered image pair over the points that both see and that lie before both: points, mean angle
    (degrees), mean scale (the reference's footprint f / depth over the neighbour's), area (share of 16 x 16 cells of
    the reference that points inside both images cover), score (summed weights by area, 0.01 at least). Pairs of fewer
    than least_points, and pairs without a point inside both images, are left out.

    The views of a point are joined with each other once, as unordered pairs; a pair of images is summed for both
    directions in one row and turned into two at the end. Sums are of whole micro-degrees, millionths of a scale and
    billionths of a weight, so they don't depend on the order of rows."""
    cameras = g.posed(cameras)
    turn = g.rotation(cameras.columns)
    turned = [] if turn is None else [x.alias(f"r{k}") for k, x in enumerate(turn)]  # columns: an array would be indexed anew for each view
    cam = cameras.select("image_id", "cx", "cy", "cz", "f", "px", "py", "width", "height", *turned)
    seen = point_views.select("point_id", "image_id").join(cam, "image_id").join(points.select("point_id", "x", "y", "z"), "point_id")
    q = g.to_camera(g.vec("x", "y", "z"), g.vec("cx", "cy", "cz"), [F.col(f"r{k}") for k in range(9)] if turned else None)
    seen = seen.withColumn("deep", q[2]).filter("deep > 0")
    u, v = g.project(q, F.col("f"), F.col("px"), F.col("py"))
    ray = g.minus(g.vec("cx", "cy", "cz"), g.vec("x", "y", "z"))
    cell = F.floor(u / F.col("width") * 16) * 16 + F.floor(v / F.col("height") * 16)
    view = [c.alias(n) for c, n in zip(ray, ("rx", "ry", "rz"), strict=True)]
    view += [(F.col("f") / F.col("deep")).alias("foot"), F.when(g.inside_image(u, v, F.col("width"), F.col("height")), cell.cast("int")).alias("cell")]
    seen = seen.select("point_id", "image_id", *view)
    names = [c for c in seen.columns if c != "point_id"]
    left, right = (seen.select("point_id", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
    pair = left.join(right, "point_id").filter("a_image_id < b_image_id")
    angle = F.degrees(F.acos(g.cosine(g.vec("rx", "ry", "rz", of="a_"), g.vec("rx", "ry", "rz", of="b_"))))
    there = {"a": F.col("a_foot") / F.col("b_foot"), "b": F.col("b_foot") / F.col("a_foot")}
    rows = pair.select("a_image_id", "b_image_id", _whole(angle, MICRO).alias("angle"), *[_whole(there[s], MICRO).alias(f"{s}_scale") for s in "ab"], *[F.when(F.col("a_cell").isNotNull() & F.col("b_cell").isNotNull(), F.col(f"{s}_cell")).alias(f"{s}_cell") for s in "ab"])
    weight = lambda s: _whole(F.greatest(angle_weight(F.col("angle") / MICRO), F.lit(0.1)) * scale_weight(F.col(f"{s}_scale") / MICRO), NANO)
    # 256 cells are four words of bits
    bits = lambda s: [F.coalesce(F.bit_or(F.when(F.floor(F.col(f"{s}_cell") / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"{s}_cell") % 64))), F.lit(0).cast("long")) for k in range(4)]
    cells = lambda s: sum((F.bit_count(x) for x in bits(s)), F.lit(0)).alias(f"{s}_cells")
    sums = [x for s in "ab" for x in (F.sum(f"{s}_scale").alias(f"{s}_scale"), F.sum(weight(s)).alias(f"{s}_weight"), cells(s))]
    out = rows.groupBy("a_image_id", "b_image_id").agg(F.count(F.lit(1)).alias("points"), F.sum("angle").alias("angle"), *sums).filter(F.col("points") >= least_points)
    way = lambda s, o: F.struct(F.col(f"{s}_image_id").alias("ref_id"), F.col(f"{o}_image_id").alias("nb_id"), *[F.col(f"{s}_{c}").alias(c) for c in ("scale", "weight", "cells")])
    both = out.select("points", "angle", F.inline(F.array(way("a", "b"), way("b", "a")))).filter("cells > 0")
    mean = lambda c: (F.col(c) / F.col("points") / MICRO).alias(c)
    area = F.col("cells") / 256
    return both.select("ref_id", "nb_id", "points", mean("angle"), mean("scale"), area.alias("area"), (F.col("weight") / NANO * F.greatest(area, F.lit(0.01))).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """With rank, 1 for the best neighbour of a reference; ties go to the lower id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("score"), "nb_id")))


def top_neighbors(scores: DataFrame, k: int) -> DataFrame:
    return ranked(scores).filter(F.col("rank") <= k)


def filter_neighbors(scores: DataFrame, least_area: float = 0.01, scales: tuple = (0.2, 3.2), angles: tuple = (3.0, 65.0), most: int = 12) -> DataFrame:
    """Drops neighbours beyond the limits, the worst first, but leaves max(4, 3/4 of most) of them where there are so
    many; then keeps the first `most`."""
    bad = (F.col("area") < least_area) | ~F.col("scale").between(*scales) | ~F.col("angle").between(*angles)
    floor = max(4, most * 3 // 4)
    ref = Window.partitionBy("ref_id")
    rows = ranked(scores).withColumns({"bad": bad, "n": F.count(F.lit(1)).over(ref)})
    rows = rows.withColumn("bad_rank", F.when(F.col("bad"), F.sum(F.col("bad").cast("int")).over(ref.orderBy(F.desc("rank")))))
    left = rows.filter(~F.col("bad") | (F.col("bad_rank") > F.greatest(F.col("n") - floor, F.lit(0))))
    return left.withColumn("place", F.row_number().over(ref.orderBy("rank"))).filter(F.col("place") <= most).drop("bad", "n", "bad_rank", "rank")


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("ref_id", "nb_id").alias("a_id"), F.greatest("ref_id", "nb_id").alias("b_id")).distinct()


def seen_by_all(point_views: DataFrame, images: list[int]) -> DataFrame:
    """Points that every one of the images sees (relational division)."""
    hits = point_views.filter(F.col("image_id").isin(images)).select("point_id", "image_id").distinct()
    return hits.groupBy("point_id").count().filter(F.col("count") == len(set(images))).select("point_id")


def sub_scene(point_views: DataFrame, images: DataFrame, least_views: int = 2) -> DataFrame:
    """The views of the given images, of points that keep at least least_views of them."""
    rows = point_views.join(images.select("image_id"), "image_id", "left_semi")
    enough = rows.groupBy("point_id").count().filter(F.col("count") >= least_views).select("point_id")
    return rows.join(enough, "point_id", "left_semi")


def dense_ids(images: DataFrame) -> DataFrame:
    """(image_id, new_id): the distinct ids in order, from 0."""
    return numbered(images.select("image_id").distinct(), "image_id").select("image_id", F.col("number").alias("new_id"))


def renamed_scores(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """Scores between images that are in ids(image_id, new_id), under their new ids."""
    to = lambda n: ids.select(F.col("image_id").alias(n), F.col("new_id").alias(f"new_{n}"))
    met = scores.join(to("ref_id"), "ref_id").join(to("nb_id"), "nb_id").drop("ref_id", "nb_id")
    return met.withColumnsRenamed({"new_ref_id": "ref_id", "new_nb_id": "nb_id"})


def crop_to_box(points: DataFrame, point_views: DataFrame, low: tuple, high: tuple, least_points: int = 3) -> DataFrame:
    """(image_id, points): images that see at least least_points of the points in the box."""
    inside = points.filter(g.in_box(g.vec("x", "y", "z"), [F.lit(v) for v in low], [F.lit(v) for v in high])).select("point_id")
    return point_views.join(inside, "point_id", "left_semi").groupBy("image_id").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") >= least_points)


def mean_depth(point_views: DataFrame, points: DataFrame, cameras: DataFrame) -> DataFrame:
    """(image_id, points, avg_depth) over points in front of the image."""
    cameras = g.posed(cameras)
    pose = [c for c in cameras.columns if c == "rotation"]
    rows = point_views.select("point_id", "image_id").join(points.select("point_id", "x", "y", "z"), "point_id").join(cameras.select("image_id", "cx", "cy", "cz", *pose), "image_id")
    depth = g.to_camera(g.vec("x", "y", "z"), g.vec("cx", "cy", "cz"), g.rotation(pose))[2]
    return rows.withColumn("d", depth).filter("d > 0").groupBy("image_id").agg(F.count(F.lit(1)).alias("points"), F.avg("d").alias("avg_depth"))


def intrinsics(cameras: DataFrame, level: int = 1, least: int = 320, cap: int = 2560) -> DataFrame:
    """Fields of view in degrees and the side to which an image is scaled."""
    w, h, f = F.col("width"), F.col("height"), F.col("f")
    diagonal = 2 * F.atan(F.sqrt(w * w + h * h) / (2 * f))
    return cameras.select("image_id", F.degrees(g.field_of_view(w, f)).alias("fov_x"), F.degrees(g.field_of_view(h, f)).alias("fov_y"), F.degrees(diagonal).alias("fov_d"), g.max_resolution(w, h, level, least, cap).alias("side"))


def synthetic_neighbors(cameras: DataFrame, cells: int = 16, seed: int = 7) -> DataFrame:
    """Points on a grid of each image at random depths, for scenes without points; every ordered image pair gets one
    grid, so the table of cameras has to be small. Depths are 0.3 to 1.3 of the images' distance."""
    a = cameras.select(*[F.col(c).alias(f"a_{c}") for c in cameras.columns])
    pairs = a.join(F.broadcast(cameras), F.col("a_image_id") != F.col("image_id"))
    d = g.distance(g.vec("cx", "cy", "cz", of="a_"), g.vec("cx", "cy", "cz"))
    grid = pairs.select("a_image_id", "image_id", d.alias("d"), *[f"a_{c}" for c in ("f", "px", "py", "width", "height", "cx", "cy", "cz")], F.explode(F.sequence(F.lit(0), F.lit(cells * cells - 1))).alias("k"))
    u = (F.col("k") % cells + 0.5) * F.col("a_width") / cells
    v = (F.floor(F.col("k") / cells) + 0.5) * F.col("a_height") / cells
    p = g.back_project(u, v, F.col("d") * (0.3 + F.rand(seed)), F.col("a_f"), F.col("a_px"), F.col("a_py"), g.vec("cx", "cy", "cz", of="a_"))
    return grid.select(F.col("a_image_id").alias("ref_id"), F.col("image_id").alias("nb_id"), "k", *[c.alias(n) for c, n in zip(p, "xyz", strict=True)])


def neighbors_from_text(lines: DataFrame) -> DataFrame:
    """view_scores from lines `ref nb nb ...`, whose place in the line gives the score."""
    rows = lines.select(F.split(F.trim("value"), r"\s+").alias("t")).filter(F.size("t") > 1)
    out = rows.select(F.get("t", F.lit(0)).cast("int").alias("ref_id"), F.size("t").alias("n"), F.posexplode(F.expr("slice(t, 2, size(t))")).alias("i", "nb"))
    score = 2 + (F.col("n") - (F.col("i") + 1)) / 2
    return out.select("ref_id", F.col("nb").cast("int").alias("nb_id"), F.lit(0).alias("points"), F.lit(1.0).alias("scale"), F.lit(math.radians(15)).alias("angle"), F.lit(0.5).alias("area"), score.alias("score"))
