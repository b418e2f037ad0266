"""Depth maps as pixels (image_id, r, c, depth, conf); an invalid pixel is a row that is not there."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geom as g


def back_projected(depth: DataFrame, cameras: DataFrame, *carried: str) -> DataFrame:
    """(image_id, r, c, x, y, z, weight) and the carried columns: a point per pixel; a missing confidence counts 1."""
    cameras = g.posed(cameras)
    p = g.back_project(F.col("c"), F.col("r"), F.col("depth"), F.col("f"), F.col("px"), F.col("py"), g.vec("cx", "cy", "cz"), g.rotation(cameras.columns))
    return depth.filter("depth > 0").join(cameras, "image_id").select("image_id", "r", "c", *[c.alias(n) for c, n in zip(p, "xyz", strict=True)], F.coalesce("conf", F.lit(1.0)).alias("weight"), *carried)


def confident(depth: DataFrame, least: float) -> DataFrame:
    return depth.filter(F.col("conf") >= least)


def compared(a: DataFrame, b: DataFrame, threshold: float = 0.01, size: tuple[int, int] | None = None) -> DataFrame:
    """Errors, missing and extra pixels of b against a, and the mean and population deviation of the relative errors.
    With the maps' size, pixels that both lack count as equal ones."""
    rows = a.select("image_id", "r", "c", F.col("depth").alias("da")).join(b.select("image_id", "r", "c", F.col("depth").alias("db")), ["image_id", "r", "c"], "full")
    e = F.abs(F.col("da") - F.col("db")) / F.col("da")
    found = rows.groupBy("image_id").agg(F.count_if(e > threshold).alias("errors"), F.count_if(F.col("db").isNull()).alias("missing"), F.count_if(F.col("da").isNull()).alias("extra"), F.count(e).alias("both"), F.coalesce(F.sum(e), F.lit(0.0)).alias("total"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("squares"))
    n = F.col("both") if size is None else F.lit(size[0] * size[1]) - F.col("missing") - F.col("extra")
    mean = F.try_divide(F.col("total"), n)
    return found.select("image_id", "errors", "missing", "extra", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("squares"), n) - mean * mean, F.lit(0.0))).alias("std"))


def compared_normals(a: DataFrame, b: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(image_id, mean, std, median) of the angles in degrees between normals (image_id, r, c, nx, ny, nz) of maps of a
    size. Pixels that both lack count as 0, pixels that one lacks don't count. The median is the upper one; null where no
    pixel counts. One image's angles come together, which its size bounds."""
    rows = a.join(b.select("image_id", "r", "c", *[F.col(f"n{x}").alias(f"m{x}") for x in "xyz"], F.lit(1).alias("there")), ["image_id", "r", "c"], "full")
    angle = F.when(F.col("there").isNotNull() & F.col("nx").isNotNull(), F.round(F.degrees(F.acos(g.cosine(g.vec("nx", "ny", "nz"), g.vec("mx", "my", "mz")))), 6))
    found = rows.withColumn("angle", angle).groupBy("image_id").agg(F.count(F.lit(1)).alias("some"), F.sort_array(F.collect_list("angle")).alias("angles"))
    n = F.lit(size[0] * size[1]) - F.col("some") + F.size("angles")
    total = lambda f: F.aggregate("angles", F.lit(0.0), lambda s, x: s + f(x))
    mean = F.try_divide(total(lambda x: x), n)
    # those that both lack stand before all angles
    at = F.floor(n / 2) - (n - F.size("angles"))
    median = F.when(n > 0, F.when(at < 0, 0.0).otherwise(F.get("angles", at.cast("int"))))
    return found.select("image_id", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(total(lambda x: x * x), n) - mean * mean, F.lit(0.0))).alias("std"), median.alias("median"))


def range_to_depth(ranges: DataFrame, cameras: DataFrame) -> DataFrame:
    """(image_id, r, c, depth): pixels (image_id, r, c, range) whose distance is along the ray, as depths along the axis."""
    x, y = (F.col("c") - F.col("px")) / F.col("f"), (F.col("r") - F.col("py")) / F.col("f")
    return ranges.filter(F.col("range") > 0).join(cameras.select("image_id", "f", "px", "py"), "image_id").select("image_id", "r", "c", (F.col("range") / F.sqrt(x * x + y * y + 1)).alias("depth"))


def gaps_filled(depth: DataFrame, longest: int = 7, threshold: float = 0.1, along: str = "c", across: str = "r") -> DataFrame:
    """The pixels that fill runs of up to `longest` invalid ones between similar depths of a line, by linear steps; the
    confidence is the lesser."""
    line = Window.partitionBy("image_id", across).orderBy(along)
    nxt = depth.withColumns({"to": F.lead(along).over(line), "d2": F.lead("depth").over(line), "c2": F.lead("conf").over(line)})
    run = F.col("to") - F.col(along) - 1
    gap = nxt.filter(run.between(1, longest) & g.depth_similar(F.col("depth"), F.col("d2"), threshold))
    at = gap.withColumn("k", F.explode(F.sequence(F.col(along) + 1, F.col("to") - 1)))
    share = (F.col("k") - F.col(along)) / (F.col("to") - F.col(along))
    return at.select("image_id", across, F.col("k").alias(along), (F.col("depth") + share * (F.col("d2") - F.col("depth"))).alias("depth"), F.least("conf", "c2").alias("conf"))


#: More than any image's width: rows of pixels are numbered in steps of this, so that a window's row is a range of numbers.
LINE = 1 << 32


def _rows_about(pixels: DataFrame, half: int) -> list:
    """A window for each row of the square about a pixel. All have one order of an image's pixels, so one shuffle by image and
    one sort serve them, and no pixel is sent twice."""
    place = Window.partitionBy("image_id").orderBy(F.col("r").cast("long") * LINE + F.col("c"))
    return [place.rangeBetween(k * LINE - half, k * LINE + half) for k in range(-half, half + 1)]


def windows(depth: DataFrame) -> DataFrame:
    """(image_id, r, c, depth, near): each pixel with its valid neighbours of the eight, as (dr, dc, other)."""
    rows = depth.select("image_id", "r", "c", "depth")
    about = [F.collect_list(F.struct("r", "c", "depth")).over(w) for w in _rows_about(rows, 1)]
    met = rows.withColumns({f"near_{k}": a for k, a in enumerate(about)}).filter("depth is not null")
    step = lambda x: F.struct((x["r"] - F.col("r")).cast("int").alias("dr"), (x["c"] - F.col("c")).cast("int").alias("dc"), x["depth"].alias("other"))
    near = F.filter(F.transform(F.concat("near_0", "near_1", "near_2"), step), lambda x: (x["dr"] != 0) | (x["dc"] != 0))
    return met.select("image_id", "r", "c", "depth", near.alias("near"))


def with_neighbors(depth: DataFrame) -> DataFrame:
    """(image_id, r, c, depth, dr, dc, other): each pixel with its valid neighbours of the eight."""
    return windows(depth).select("image_id", "r", "c", "depth", F.inline("near"))


def confidence(depth: DataFrame, height: int, width: int, closest: int = 3, threshold: float = 0.03) -> DataFrame:
    """(image_id, r, c, conf): 0.9 of how small the `closest` least differences of a pixel to the others of its window
    are, against 0.002 of its image's range of depths, and 0.1 of how many are similar and how few are not. A pixel of
    the image without a depth counts as one of depth 0, which is not similar."""
    span = depth.groupBy("image_id").agg((F.max("depth") - F.min("depth")).alias("span"))
    side = lambda at, n: F.when((F.col(at) == 0) | (F.col(at) == n - 1), 2).otherwise(3)
    total = side("r", height) * side("c", width) - 1
    rows = windows(depth).withColumn("total", total).join(span, "image_id")
    off = F.concat(F.transform("near", lambda x: F.abs(F.col("depth") - x["other"])), F.array_repeat(F.col("depth"), (F.col("total") - F.size("near")).cast("int")))
    similar = F.size(F.filter("near", lambda x: g.depth_similar(F.col("depth"), x["other"], threshold)))
    rows = rows.withColumns({"least": F.aggregate(F.slice(F.sort_array(off), 1, closest), F.lit(0.0), lambda s, x: s + x) / F.col("total"), "similar": similar})
    by_depth = F.exp(-F.pow(F.try_divide(F.col("least"), 0.002 * F.col("span")), 2))
    by_count = 0.7 * F.least(F.col("similar") / closest, F.lit(1.0)) + 0.3 * F.coalesce(F.greatest(1 - F.try_divide(F.col("total") - F.col("similar"), F.col("similar")), F.lit(0.0)), F.lit(0.0))
    return rows.select("image_id", "r", "c", (0.9 * by_depth + 0.1 * by_count).alias("conf"))


def normal_confidence(normals: DataFrame) -> DataFrame:
    """(image_id, r, c, conf) of normals (image_id, r, c, nx, ny, nz): how little the valid normals of a pixel's window of
    nine turn from their mean."""
    rows = normals.select("image_id", "r", "c", F.struct("nx", "ny", "nz").alias("n"))
    about = [F.collect_list("n").over(w) for w in _rows_about(rows, 1)]
    met = rows.withColumns({f"near_{k}": a for k, a in enumerate(about)}).select("image_id", "r", "c", F.concat("near_0", "near_1", "near_2").alias("near"))
    mean = lambda x: F.aggregate("near", F.lit(0.0), lambda s, v: s + v[f"n{x}"]) / F.size("near")
    met = met.withColumns({f"m{x}": mean(x) for x in "xyz"})
    turn = lambda v: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(g.vec("mx", "my", "mz"), [v["nx"], v["ny"], v["nz"]]))))
    theta = F.aggregate("near", F.lit(0.0), lambda s, v: s + turn(v) * turn(v))
    return met.select("image_id", "r", "c", F.pow(1 - theta / (F.size("near") * math.pi), 2).alias("conf"))


def window_moments(image: DataFrame, value: str, height: int, width: int, half: int = 3, least: float = 0.0001) -> DataFrame:
    """(image_id, r, c, mean, variance) of value over the square window around each pixel that lies half or more from the
    border. A pixel without a row counts as 0 and gets no row."""
    n = (2 * half + 1) ** 2
    v = F.col(value).cast("double")
    pixels = image.filter(v.isNotNull()).select("image_id", "r", "c", v.alias("v"))
    lines = _rows_about(pixels, half)
    sums = {f"{name}{k}": F.sum(what).over(w) for k, w in enumerate(lines) for name, what in (("s", F.col("v")), ("q", F.col("v") * F.col("v")))}
    total = lambda name: reduce(lambda a, b: a + b, [F.coalesce(f"{name}{k}", F.lit(0.0)) for k in range(len(lines))]).alias(name)
    both = pixels.withColumns(sums).select("image_id", "r", "c", total("s"), total("q"))
    mean = F.col("s") / n
    return both.filter(F.col("r").between(half, height - half - 1) & F.col("c").between(half, width - half - 1)).select("image_id", "r", "c", mean.alias("mean"), F.greatest(F.col("q") / n - mean * mean, F.lit(least)).alias("variance"))


def zigzag(pixels: DataFrame, height: int, stride: int = 16) -> DataFrame:
    """(image_id, r, c, place): pixels of an image numbered from 0 in strips of `stride` rows, the last one with the rows
    that don't fill one; in a strip along its diagonals, each from its upper right end. One image is numbered at once."""
    strip = F.least(F.floor(F.col("r") / stride), F.lit(max(height // stride, 1) - 1))
    order = Window.partitionBy("image_id").orderBy(strip, F.col("r") + F.col("c"), "r")
    return pixels.select("image_id", "r", "c", (F.row_number().over(order) - 1).alias("place"))


def best_two(scores: DataFrame, cap: float = 1.2) -> DataFrame:
    """(image_id, r, c, score) of scores (image_id, r, c, nb_id, score), lower being better: the mean of the best two, or
    the best where the second reaches the cap or there is none. Nulls don't count."""
    two = F.slice(F.array_sort(F.collect_list("score")), 1, 2)
    rows = scores.filter("score is not null").groupBy("image_id", "r", "c").agg(two.alias("s"))
    first, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    return rows.select("image_id", "r", "c", F.when(second < cap, (first + second) / 2).otherwise(first).alias("score"))


def normals(depth: DataFrame, cameras: DataFrame, threshold: float = 0.03, least: int = 3) -> DataFrame:
    """Normals by the least-squares depth gradient over similar neighbours."""
    alike = windows(depth).withColumn("near", F.filter("near", lambda x: g.depth_similar(F.col("depth"), x["other"], threshold)))
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda s, x: s + f(x))
    dd = lambda x: x["other"] - F.col("depth")
    terms = {"xx": lambda x: x["dc"] * x["dc"], "xy": lambda x: x["dc"] * x["dr"], "yy": lambda x: x["dr"] * x["dr"], "gx": lambda x: dd(x) * x["dc"], "gy": lambda x: dd(x) * x["dr"]}
    s = alike.select("image_id", "r", "c", "depth", F.size("near").alias("n"), *[total(f).alias(name) for name, f in terms.items()])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    wx, wy = (F.col("gx") * F.col("yy") - F.col("gy") * F.col("xy")) / det, (F.col("gy") * F.col("xx") - F.col("gx") * F.col("xy")) / det
    n = [F.col("f") * wx, F.col("f") * wy, (F.col("px") - F.col("c")) * wx + (F.col("py") - F.col("r")) * wy - F.col("depth")]
    return s.filter((F.col("n") >= least) & (det != 0)).join(cameras.select("image_id", "f", "px", "py"), "image_id").select("image_id", "r", "c", *[(v / g.norm(n)).alias(f"n{x}") for v, x in zip(n, "xyz", strict=True)])


def reprojected(depth: DataFrame, cameras: DataFrame, pairs: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(ref_id, r, c, nb_id, r2, c2, z, other, other_conf, agrees): a pixel of ref_id seen at the pixel of nb_id where
    its point falls, at depth z; pairs(ref_id, nb_id). The pixel is the equi-join key, the depth test the rest.

    A pair takes along the neighbour's camera and the rows and columns that its pixels span: only points that fall between
    them are shuffled to their pixels, and pixels are shuffled to their pairs before they are points."""
    cameras = g.posed(cameras)
    p = back_projected(depth, cameras.hint("merge")).withColumnRenamed("image_id", "ref_id").drop("weight")
    span = depth.groupBy(F.col("image_id").alias("nb_id")).agg(*[f(x).alias(f"{n}_{x}") for x in "rc" for n, f in (("low", F.min), ("high", F.max))])
    near = pairs.select("ref_id", "nb_id").join(cameras.withColumnRenamed("image_id", "nb_id").join(span.hint("merge"), "nb_id").hint("merge"), "nb_id")
    shot = p.join(near.hint("merge"), "ref_id")
    q = g.to_camera(g.vec("x", "y", "z"), g.vec("cx", "cy", "cz"), g.rotation(cameras.columns))
    u, v = g.project(q, F.col("f"), F.col("px"), F.col("py"))
    met = (q[2] > 0) & g.to_pixel(v).between(F.col("low_r"), F.col("high_r")) & g.to_pixel(u).between(F.col("low_c"), F.col("high_c"))
    rows = shot.filter(met).select("ref_id", "r", "c", "nb_id", g.to_pixel(v).alias("r2"), g.to_pixel(u).alias("c2"), q[2].alias("z"))
    other = depth.select(F.col("image_id").alias("nb_id"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("depth").alias("other"), F.col("conf").alias("other_conf"))
    return rows.join(other, ["nb_id", "r2", "c2"]).withColumn("agrees", g.depth_similar(F.col("z"), F.col("other"), threshold))


def adjusted_confidence(depth: DataFrame, matches: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Confidence after neighbours: photo is the lesser of the own confidence and that of the neighbour whose depth is
    closest (no further than 1, relatively). Where it is more than the two strongest confidences together whose depths
    differ by more than threshold, 0.3 of it and 0.7 of how close that neighbour is; else a tenth of it over theirs."""
    a = matches.withColumn("diff", F.abs(F.col("z") - F.col("other")) / F.col("z"))
    nearest = F.min(F.when(F.col("diff") <= 1, F.struct("diff", (-F.col("other_conf")).alias("minus"))))
    against = F.slice(F.sort_array(F.collect_list(F.when(F.col("diff") > threshold, F.col("other_conf"))), asc=False), 1, 2)
    sums = a.groupBy(F.col("ref_id").alias("image_id"), "r", "c").agg(nearest.alias("nearest"), against.alias("against"))
    rows = depth.join(sums, ["image_id", "r", "c"], "left")
    neg = F.coalesce(F.aggregate("against", F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0))), F.lit(0.0))
    photo = F.least(F.col("conf"), F.coalesce(-F.col("nearest.minus"), F.lit(0.0)))
    good = 0.3 * photo + 0.7 * F.exp(-F.pow(F.coalesce("nearest.diff", F.lit(1.0)), 2) / (2 * 0.01**2))
    return rows.select("image_id", "r", "c", F.when(photo > neg, good).when(neg > 0, 0.1 * photo / neg).otherwise(0.0).alias("conf"))


def fused(depth: DataFrame, cameras: DataFrame, pairs: DataFrame, threshold: float = 0.01, least_views: int = 2) -> DataFrame:
    """A point per group of mutually matched pixels, at its members' medians, from at least least_views images; a group
    is named by its least pixel, and each pixel is in one group at most. Pixels that fail the depth test against the
    name-giving one are left out. Rows and columns are below 2^20."""
    from tessera.operators.iterate import checkpointed, components

    # what holds for every use of the pixels is said once, so that they can be shuffled once; no other pixel is matched both ways
    depth = depth.filter("image_id is not null and r is not null and c is not null and depth > 0")
    key = lambda i, r, c: F.col(i) * (1 << 40) + F.col(r) * (1 << 20) + F.col(c)
    m = reprojected(depth, cameras, pairs, threshold).filter("agrees").select(key("ref_id", "r", "c").alias("a"), key("nb_id", "r2", "c2").alias("b"))
    # matches of both ways meet by their pair, so matches are made once and not joined with themselves
    mutual = m.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.col("a") < F.col("b")).alias("back"), F.max(F.col("a") < F.col("b")).alias("there")).filter("there and not back").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    groups = components(checkpointed(mutual))
    # a node says its pixel, so pixels without a match are not shuffled by their node
    part = lambda shift: F.shiftright("node", shift).bitwiseAND(F.lit((1 << 20) - 1))
    groups = groups.select("node", "component", F.shiftright("node", 40).alias("image_id"), part(20).alias("r"), part(0).alias("c"))
    matched = depth.join(groups.hint("merge"), ["image_id", "r", "c"])
    rows = checkpointed(back_projected(matched, cameras, "node", "component").select("node", "component", "image_id", "x", "y", "z"))
    seed = rows.filter("node = component").select("component", F.col("z").alias("seed_z"))
    kept = rows.join(seed, "component").filter(g.depth_similar(F.col("seed_z"), F.col("z"), 10 * threshold))
    return kept.groupBy("component").agg(*[F.median(c).alias(c) for c in "xyz"], F.count_distinct("image_id").alias("views")).filter(F.col("views") >= least_views)


def speckles(depth: DataFrame, threshold: float = 0.007, least: int = 100) -> DataFrame:
    """Pixels of 4-connected regions of similar depth with fewer than least pixels."""
    from tessera.operators.iterate import components

    key = lambda r, c: F.col("image_id") * (1 << 40) + r * (1 << 20) + c
    near = with_neighbors(depth).filter((F.abs("dr") + F.abs("dc") == 1) & g.depth_similar(F.col("depth"), F.col("other"), threshold))
    found = components(near.select(key(F.col("r"), F.col("c")).alias("a"), key(F.col("r") + F.col("dr"), F.col("c") + F.col("dc")).alias("b")))
    if least <= 1:
        return depth.select("image_id", "r", "c").limit(0)
    # a pixel without links is a region of its own
    large = found.groupBy("component").count().filter(F.col("count") >= least).select("component")
    kept = found.join(large.hint("merge"), "component", "left_semi").select("node")
    return depth.select("image_id", "r", "c", key(F.col("r"), F.col("c")).alias("node")).join(kept, "node", "left_anti").select("image_id", "r", "c")


def combined_confidence(a: DataFrame, b: DataFrame) -> DataFrame:
    """The greater where both are positive, else 0."""
    rows = a.select("image_id", "r", "c", F.col("conf").alias("ca")).join(b.select("image_id", "r", "c", F.col("conf").alias("cb")), ["image_id", "r", "c"], "left")
    return rows.select("image_id", "r", "c", F.when((F.col("ca") > 0) & (F.col("cb") > 0), F.greatest("ca", "cb")).otherwise(0.0).alias("conf"))


def cross_checked(left: DataFrame, right: DataFrame, tolerance: int = 1) -> DataFrame:
    """Disparities (image_id, r, c, disp) whose counterpart at c + disp says the same with the other sign."""
    other = right.select("image_id", "r", F.col("c").alias("c2"), F.col("disp").alias("other"))
    return left.withColumn("c2", F.col("c") + F.col("disp")).join(other, ["image_id", "r", "c2"]).filter(F.abs(F.col("disp") + F.col("other")) <= tolerance).select("image_id", "r", "c", "disp")


def flipped(disp: DataFrame, width: int) -> DataFrame:
    """(image_id, r, c, disp) as the other image has it: each disparity with the other sign at the three columns around
    its counterpart, inside the image; the one from the last column stands. A row of pixels is one list, so neither the
    three columns nor a table of all of them are held by a task."""
    rows = disp.filter("c is not null and disp is not null").groupBy("image_id", "r").agg(F.collect_list(F.struct("c", "disp")).alias("row"))
    every = F.array_sort(F.flatten(F.transform("row", lambda p: F.filter(F.array(*[F.struct((p["c"] + p["disp"] + k).alias("x"), p["c"].alias("c"), p["disp"].alias("disp")) for k in (-1, 0, 1)]), lambda e: e["x"].between(0, width - 1)))))
    last = F.flatten(F.transform(F.array(every), lambda es: F.filter(es, lambda e, k: F.coalesce(F.get(es, k + 1)["x"] != e["x"], F.lit(True)))))
    return rows.select("image_id", "r", F.inline(last)).select("image_id", "r", F.col("x").alias("c"), (-F.col("disp")).alias("disp"))


def disparity_range(disp: DataFrame, reach: int = 3) -> DataFrame:
    """Least and greatest disparity in a row's window around each pixel."""
    w = Window.partitionBy("image_id", "r").orderBy("c").rangeBetween(-reach, reach)
    return disp.select("image_id", "r", "c", F.min("disp").over(w).alias("low"), F.max("disp").over(w).alias("high"))


def within_cost(disp: DataFrame, most: float) -> DataFrame:
    """Disparities (image_id, r, c, disp, cost) without those that cost more."""
    return disp.filter(F.col("cost") <= most)


def disparity_to_depth(disp: DataFrame, focal: float, baseline: float) -> DataFrame:
    return disp.filter("disp <> 0").select("image_id", "r", "c", (focal * baseline / F.abs("disp")).alias("depth"))


def interval_clusters(values: DataFrame, threshold: float = 0.05, least: int = 2) -> DataFrame:
    """Of values(r, c, source, depth) per pixel, taken by source: the first cluster whose first depth is similar takes
    it, else it begins one; the largest cluster's mean, if it has at least `least`."""
    rows = values.groupBy("r", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "depth"))), lambda x: x["depth"]).alias("d"))
    start = F.array().cast("array<struct<first:double,n:int,total:double>>")

    def add(done, x):
        fits = lambda c: F.abs(c["first"] - x) / c["first"] < threshold
        at = F.array_position(F.transform(done, fits), True)
        more = F.transform(done, lambda c, k: F.when(k + 1 == at, F.struct(c["first"].alias("first"), (c["n"] + 1).alias("n"), (c["total"] + x).alias("total"))).otherwise(c))
        return F.when(at > 0, more).otherwise(F.concat(done, F.array(F.struct(x.alias("first"), F.lit(1).alias("n"), x.alias("total")))))

    best = F.array_max(F.transform(F.aggregate("d", start, add), lambda c, k: F.struct(c["n"].alias("n"), (-k).alias("k"), (c["total"] / c["n"]).alias("mean"))))
    return rows.select("r", "c", best.alias("b")).filter(F.col("b.n") >= least).select("r", "c", F.col("b.n").alias("n"), F.col("b.mean").alias("depth"))
