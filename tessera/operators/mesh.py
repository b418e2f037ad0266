"""Meshes as vertices(v_id, x, y, z) and faces(f_id, a, b, c): adjacency is queried, never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geom as g
from tessera.operators.cloud import numbered

CORNERS = ("a", "b", "c")


def corners(faces: DataFrame) -> DataFrame:
    """(f_id, v_id), three rows per face."""
    return faces.select("f_id", F.explode(F.array(*CORNERS)).alias("v_id"))


def half_edges(faces: DataFrame) -> DataFrame:
    """(f_id, src, dst), three rows per face, in its orientation."""
    pairs = F.array(*[F.struct(F.col(s).alias("src"), F.col(d).alias("dst")) for s, d in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select("f_id", F.inline(pairs))


def edges(faces: DataFrame) -> DataFrame:
    """(lo, hi, faces): undirected edges and how many faces have them."""
    return half_edges(faces).groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.count(F.lit(1)).alias("faces"))


def vertex_neighbors(faces: DataFrame) -> DataFrame:
    """(v_id, nb_id), both directions, distinct."""
    e = edges(faces)
    return e.select(F.col("lo").alias("v_id"), F.col("hi").alias("nb_id")).unionByName(e.select(F.col("hi").alias("v_id"), F.col("lo").alias("nb_id")))


def vertex_degrees(faces: DataFrame) -> DataFrame:
    return vertex_neighbors(faces).groupBy("v_id").agg(F.count(F.lit(1)).alias("degree"))


def boundary_vertices(faces: DataFrame) -> DataFrame:
    return edges(faces).filter("faces = 1").select(F.explode(F.array("lo", "hi")).alias("v_id")).distinct()


def watertight(faces: DataFrame) -> DataFrame:
    return edges(faces).agg(F.count_if(F.col("faces") != 2).alias("open_edges"), F.bool_and(F.col("faces") == 2).alias("watertight"))


def face_neighbors(faces: DataFrame) -> DataFrame:
    """(f_id, nb_id): faces that share an edge."""
    e = half_edges(faces).select("f_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    other = e.withColumnRenamed("f_id", "nb_id")
    return e.join(other.hint("merge"), ["lo", "hi"]).filter("f_id <> nb_id").select("f_id", "nb_id").distinct()


def with_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces with ax .. cz. One shuffle of corners and one of faces, instead of a join per corner. Vertices are never sent to
    all tasks, as the size of their file says little of theirs."""
    at = faces.select("f_id", F.posexplode(F.array(*CORNERS)).alias("k", "v_id")).join(vertices.select("v_id", "x", "y", "z").hint("merge"), "v_id")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return at.groupBy("f_id").agg(*[pick(k, "v_id").alias(n) for k, n in enumerate(CORNERS)], *[pick(k, c).alias(f"{n}{c}") for k, n in enumerate(CORNERS) for c in "xyz"])


def _points() -> list[list[Column]]:
    return [g.vec("x", "y", "z", of=n) for n in CORNERS]


def face_measures(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(f_id, area, quality, nx, ny, nz): the normal is of length 1, null for a face without area."""
    p = _points()
    n = g.cross(g.minus(p[1], p[0]), g.minus(p[2], p[0]))
    return with_corners(faces, vertices).select("f_id", g.triangle_area(*p).alias("area"), g.triangle_quality(*p).alias("quality"), *[F.try_divide(c, g.norm(n)).alias(f"n{x}") for c, x in zip(n, "xyz", strict=True)])


def area_and_volume(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    p = _points()
    return with_corners(faces, vertices).agg(F.sum(g.triangle_area(*p)).alias("area"), F.sum(g.signed_volume(*p)).alias("volume"))


def centroids(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return with_corners(faces, vertices).select("f_id", *[((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3).alias(c) for c in "xyz"])


def edge_scale(faces: DataFrame, vertices: DataFrame, factor: float = 1.0) -> DataFrame:
    """(sigma): factor times the root of the median squared edge length, each edge once; of two middles the mean. Equal
    lengths are counted before they meet."""
    ends = vertices.select("v_id", "x", "y", "z")
    rows = edges(faces).join(ends.toDF("lo", "ax", "ay", "az"), "lo").join(ends.toDF("hi", "bx", "by", "bz"), "hi")
    d = g.minus(g.vec("ax", "ay", "az"), g.vec("bx", "by", "bz"))
    counts = rows.groupBy(g.dot(d, d).alias("d2")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((factor * F.sqrt(F.percentile("d2", 0.5, F.col("n")))).alias("sigma"))


def face_views(pixels: DataFrame) -> DataFrame:
    """(f_id, image_id, area, quality, red, green, blue) of pixels (f_id, image_id, quality, red, green, blue): how many
    pixels an image gives a face, their summed quality and mean colour."""
    return pixels.groupBy("f_id", "image_id").agg(F.count(F.lit(1)).alias("area"), F.sum("quality").alias("quality"), *[F.avg(c).alias(c) for c in ("red", "green", "blue")])


def best_views(faces: DataFrame, vertices: DataFrame, views: DataFrame, cameras: DataFrame, most: int, ratio: float = 0.67) -> DataFrame:
    """(f_id, image_id, score, rank): each face's best `most` of views(f_id, image_id, quality), by ratio times the cosine
    between its normal and the direction to the camera, and the rest times the share of its best quality. Ties go to the
    lower image; a face without area counts by quality alone."""
    p = _points()
    n = g.cross(g.minus(p[1], p[0]), g.minus(p[2], p[0]))
    middle = [(a + b + c) / 3 for a, b, c in zip(*p, strict=True)]
    shape = with_corners(faces, vertices).select("f_id", *[c.alias(f"n{x}") for c, x in zip(n, "xyz", strict=True)], *[c.alias(f"m{x}") for c, x in zip(middle, "xyz", strict=True)])
    top = views.groupBy("f_id").agg(F.max("quality").alias("top"))
    rows = views.select("f_id", "image_id", "quality").join(top, "f_id").join(shape, "f_id").join(cameras.select("image_id", "cx", "cy", "cz"), "image_id")
    cos = F.coalesce(g.cosine(g.minus(g.vec("cx", "cy", "cz"), g.vec("mx", "my", "mz")), g.vec("nx", "ny", "nz")), F.lit(0.0))
    score = F.round(ratio * cos + (1 - ratio) * F.coalesce(F.try_divide(F.col("quality"), F.col("top")), F.lit(0.0)), 9)
    rank = F.row_number().over(Window.partitionBy("f_id").orderBy(F.desc("score"), "image_id"))
    return rows.select("f_id", "image_id", score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= most)


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Area-weighted sums of face normals, of length 1."""
    p = _points()
    n = g.cross(g.minus(p[1], p[0]), g.minus(p[2], p[0]))
    rows = with_corners(faces, vertices).select(F.explode(F.array(*CORNERS)).alias("v_id"), *[c.alias(f"n{x}") for c, x in zip(n, "xyz", strict=True)])
    sums = rows.groupBy("v_id").agg(*[F.sum(f"n{x}").alias(f"s{x}") for x in "xyz"])
    s = g.vec("x", "y", "z", of="s")
    return sums.select("v_id", *[F.try_divide(c, g.norm(s)).alias(f"n{x}") for c, x in zip(s, "xyz", strict=True)])


def smooth_normals(faces: DataFrame, vertices: DataFrame, cos_limit: float = 0.9063, keep: float = 0.5, rounds: int = 3) -> DataFrame:
    """Face normals drawn to the mean of those neighbours whose normals are within the limit."""
    normals, near = face_measures(faces, vertices).select("f_id", "nx", "ny", "nz"), face_neighbors(faces)
    for _ in range(rounds):
        other = near.join(normals.select(F.col("f_id").alias("nb_id"), *[F.col(f"n{x}").alias(f"m{x}") for x in "xyz"]), "nb_id")
        met = other.join(normals, "f_id").filter(g.dot(g.vec("nx", "ny", "nz"), g.vec("mx", "my", "mz")) > cos_limit)
        mean = met.groupBy("f_id").agg(*[F.avg(f"m{x}").alias(f"m{x}") for x in "xyz"])
        both = normals.join(mean, "f_id", "left")
        mixed = [F.col(f"n{x}") * keep + F.coalesce(F.col(f"m{x}"), F.col(f"n{x}")) * (1 - keep) for x in "xyz"]
        normals = both.select("f_id", *[F.try_divide(c, g.norm(mixed)).alias(f"n{x}") for c, x in zip(mixed, "xyz", strict=True)])
    return normals


def _around(values: DataFrame, faces: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """values with m_<name>, the mean over a vertex's neighbours, and inv, the mean of 1 / their number of neighbours;
    null for vertices on the boundary and those without a face. Each vertex sends its values along its edges, of which
    one aggregate tells the neighbours, their number and the boundary."""
    way = lambda src, dst: F.struct(F.col(src).alias("v_id"), F.col(dst).alias("nb_id"))
    ways = edges(faces).select("faces", F.inline(F.array(way("lo", "hi"), way("hi", "lo"))))
    sent = ways.withColumn("inv", 1 / F.count(F.lit(1)).over(Window.partitionBy("v_id"))).join(values.select("v_id", *[F.col(n).alias(f"o_{n}") for n in names]), "v_id")
    met = sent.groupBy(F.col("nb_id").alias("v_id")).agg(*[F.avg(f"o_{n}").alias(f"m_{n}") for n in names], F.avg("inv").alias("inv"), F.max(F.col("faces") == 1).alias("rim"))
    return values.join(met.filter("not rim").drop("rim"), "v_id", "left")


def laplacian(values: DataFrame, faces: DataFrame, names: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The mean of a vertex's neighbours less itself, per named column; 0 on the boundary and without a face."""
    return _around(values, faces, names).select("v_id", *[F.coalesce(F.col(f"m_{n}") - F.col(n), F.lit(0.0)).alias(n) for n in names])


def laplacian_2(first: DataFrame, faces: DataFrame, names: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The second level from the first: the mean of the neighbours' first less the own one, over 1 and the mean of
    1 / their number of neighbours; 0 where the first is."""
    scale = 1 / (1 + F.col("inv"))
    return _around(first, faces, names).select("v_id", *[F.coalesce((F.col(f"m_{n}") - F.col(n)) * scale, F.lit(0.0)).alias(n) for n in names])


def smoothed(vertices: DataFrame, faces: DataFrame, step: float = 0.5) -> DataFrame:
    move = laplacian(vertices, faces).select("v_id", *[F.col(c).alias(f"d{c}") for c in "xyz"])
    return vertices.join(move, "v_id", "left").select("v_id", *[(F.col(c) + step * F.coalesce(F.col(f"d{c}"), F.lit(0.0))).alias(c) for c in "xyz"])


def subdivided(faces: DataFrame, vertices: DataFrame, most_area: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces): a face of more than twice most_area is cut in four at its edges' middles; a face beside it in
    as many parts as it has cut edges, and one more. New vertices are numbered behind the others, by edge."""
    p = _points()
    big = with_corners(faces, vertices).filter(g.triangle_area(*p) > 2 * most_area).select("f_id")
    cut = half_edges(faces).join(big, "f_id", "left_semi").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    top = vertices.agg(F.max("v_id")).collect()[0][0] or 0
    middle = numbered(cut, "lo", "hi").select("lo", "hi", (F.col("number") + top + 1).cast("long").alias("m"))
    ends = vertices.select(F.col("v_id"), "x", "y", "z")
    placed = middle.join(ends.toDF("lo", "x0", "y0", "z0"), "lo").join(ends.toDF("hi", "x1", "y1", "z1"), "hi")
    new = placed.select(F.col("m").alias("v_id"), *[((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(c) for c in "xyz"])
    sides = half_edges(faces).withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(middle, ["lo", "hi"], "left")
    of = lambda s, d: F.max(F.when((F.col("src") == F.col(s)) & (F.col("dst") == F.col(d)), F.col("m")))
    f = sides.join(faces, "f_id").groupBy("f_id", *CORNERS).agg(of("a", "b").alias("ab"), of("b", "c").alias("bc"), of("c", "a").alias("ca"))
    tri = lambda *v: F.struct(*[F.col(x).alias(n) for x, n in zip(v, CORNERS, strict=True)])
    has = [F.col(x).isNotNull() for x in ("ab", "bc", "ca")]
    one = lambda m, s, d, o: F.array(tri(s, m, o), tri(m, d, o))
    two = lambda m, k, s, d, o: F.array(tri(m, d, k), tri(s, m, k), tri(s, k, o))  # noqa: E731  edges s-d and d-o are cut
    parts = (
        F.when(has[0] & has[1] & has[2], F.array(tri("a", "ab", "ca"), tri("ab", "b", "bc"), tri("ca", "bc", "c"), tri("ab", "bc", "ca")))
        .when(has[0] & has[1], two("ab", "bc", "a", "b", "c")).when(has[1] & has[2], two("bc", "ca", "b", "c", "a")).when(has[2] & has[0], two("ca", "ab", "c", "a", "b"))
        .when(has[0], one("ab", "a", "b", "c")).when(has[1], one("bc", "b", "c", "a")).when(has[2], one("ca", "c", "a", "b")).otherwise(F.array(tri("a", "b", "c")))
    )
    rows = f.select("f_id", F.posexplode(parts).alias("part", "t")).select("f_id", "part", "t.a", "t.b", "t.c")
    return vertices.select("v_id", "x", "y", "z").unionByName(new), rows


def duplicate_vertices(vertices: DataFrame) -> DataFrame:
    """(v_id, kept_id): the first vertex at the same place."""
    first = vertices.groupBy("x", "y", "z").agg(F.min("v_id").alias("kept_id"))
    return vertices.join(first, ["x", "y", "z"]).select("v_id", "kept_id")


def unreferenced(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.join(corners(faces).select("v_id").distinct(), "v_id", "left_anti").select("v_id")


def degenerate_faces(faces: DataFrame, vertices: DataFrame, least_area: float = 1e-10) -> DataFrame:
    """Faces that repeat a vertex or have less area."""
    same = (F.col("a") == F.col("b")) | (F.col("b") == F.col("c")) | (F.col("a") == F.col("c"))
    return with_corners(faces, vertices).filter(same | (g.triangle_area(*_points()) <= least_area)).select("f_id")


def without_vertices(faces: DataFrame, removed: DataFrame) -> DataFrame:
    """Faces none of whose vertices is removed(v_id)."""
    gone = corners(faces).join(removed.select("v_id"), "v_id", "left_semi").select("f_id").distinct()
    return faces.join(gone, "f_id", "left_anti")


def inside_box(vertices: DataFrame, faces: DataFrame, low: tuple, high: tuple) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the faces all of whose corners are in the closed box; vertices are numbered anew from 0, faces
    keep their ids."""
    out = vertices.filter(~g.in_box(g.vec("x", "y", "z"), [F.lit(v) for v in low], [F.lit(v) for v in high]))
    kept = without_vertices(faces, out)
    used = numbered(vertices.join(corners(kept).select("v_id").distinct(), "v_id", "left_semi"), "v_id")
    ids = used.select("v_id", F.col("number").cast("long").alias("new_id"))
    at = kept.select("f_id", F.posexplode(F.array(*CORNERS)).alias("k", "v_id")).join(ids, "v_id")
    moved = at.groupBy("f_id").agg(*[F.max(F.when(F.col("k") == k, F.col("new_id"))).alias(n) for k, n in enumerate(CORNERS)])
    return used.select(F.col("number").cast("long").alias("v_id"), "x", "y", "z"), moved


def joined(v1: DataFrame, f1: DataFrame, v2: DataFrame, f2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both meshes as one; the second's ids are shifted behind the first's."""
    v = (v1.agg(F.max("v_id")).collect()[0][0] or 0) + 1
    f = (f1.agg(F.max("f_id")).collect()[0][0] or 0) + 1
    moved = v2.select((F.col("v_id") + v).alias("v_id"), "x", "y", "z")
    return v1.select("v_id", "x", "y", "z").unionByName(moved), f1.select("f_id", *CORNERS).unionByName(f2.select((F.col("f_id") + f).alias("f_id"), *[(F.col(c) + v).alias(c) for c in CORNERS]))


def patches(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """(f_id, patch): connected faces of one label, named by the least face."""
    from tessera.operators.iterate import components

    near = face_neighbors(faces)
    same = near.join(labels.select("f_id", F.col("label").alias("l1")), "f_id").join(labels.select(F.col("f_id").alias("nb_id"), F.col("label").alias("l2")), "nb_id").filter("l1 = l2")
    found = components(same.select(F.col("f_id").alias("a"), F.col("nb_id").alias("b")))
    return labels.select("f_id").join(found.toDF("f_id", "patch"), "f_id", "left").select("f_id", F.coalesce("patch", "f_id").alias("patch"))


def seam_vertices(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Vertices of edges between faces of different labels."""
    e = half_edges(faces).select("f_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).join(labels.select("f_id", "label"), "f_id")
    seams = e.groupBy("lo", "hi").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2")
    return seams.select(F.explode(F.array("lo", "hi")).alias("v_id")).distinct()


def sampled(faces: DataFrame, vertices: DataFrame, density: float, seed: int = 11) -> DataFrame:
    """(f_id, x, y, z): points spread evenly over the surface, about density per unit of area. What is drawn follows from
    the seed, the face and the point's number, so a task that runs again draws the same."""
    p = _points()
    area = g.triangle_area(*p) * density
    draw = lambda salt, *of: F.pmod(F.xxhash64(F.lit(seed + salt), *of), F.lit(1 << 53)) / float(1 << 53)
    rows = with_corners(faces, vertices).withColumn("n", (F.floor(area) + (draw(0, "f_id") < area - F.floor(area)).cast("int")).cast("int")).filter("n > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumns({"u": draw(1, "f_id", "k"), "w": draw(2, "f_id", "k")})
    flip = F.col("u") + F.col("w") > 1
    u, w = F.when(flip, 1 - F.col("u")).otherwise(F.col("u")), F.when(flip, 1 - F.col("w")).otherwise(F.col("w"))
    return rows.select("f_id", *[(F.col(f"a{c}") + u * (F.col(f"b{c}") - F.col(f"a{c}")) + w * (F.col(f"c{c}") - F.col(f"a{c}"))).alias(c) for c in "xyz"])


def manifold(faces: DataFrame, vertices: DataFrame, shift: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) in which the faces of a vertex form one fan. Two faces at a vertex are of one fan if they share an edge
    from it that no third face has. The fan with the face of least id keeps the vertex, each other gets a copy of it,
    numbered on from the greatest id by vertex and fan. All copies of such a vertex, and it, move by `shift` of the way to
    the mean of their fan's other vertices. A face with a null corner or the same corner twice is left out."""
    from tessera.operators.iterate import checkpointed, components

    rows = faces.select("f_id", *CORNERS).dropna().filter("a <> b and b <> c and c <> a")
    node = lambda k: F.col("f_id") * 3 + k  # noqa: E731  a corner of a face
    at = rows.select("f_id", F.posexplode(F.array(*CORNERS)).alias("k", "v_id")).withColumn("node", node(F.col("k")))
    ways = [F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"), F.when(F.col(p) < F.col(q), node(i)).otherwise(node(j)).alias("at_lo"), F.when(F.col(p) < F.col(q), node(j)).otherwise(node(i)).alias("at_hi")) for (i, p), (j, q) in (((0, "a"), (1, "b")), ((1, "b"), (2, "c")), ((2, "c"), (0, "a")))]
    shared = rows.select("f_id", F.inline(F.array(*ways))).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("at_lo", "at_hi") for name, f in (("low", F.min), ("high", F.max))]).filter("n = 2")
    links = shared.select(F.inline(F.array(*[F.struct(F.col(f"low_{c}").alias("a"), F.col(f"high_{c}").alias("b")) for c in ("at_lo", "at_hi")])))
    fans = checkpointed(at.join(components(links), "node", "left").select("f_id", "k", "v_id", F.coalesce("component", "node").alias("fan")))
    place = F.row_number().over(Window.partitionBy("v_id").orderBy("fan"))
    several = fans.select("v_id", "fan").distinct().withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("v_id"))).filter("n > 1")
    greatest = vertices.agg(F.max("v_id")).collect()[0][0] or 0
    copies = numbered(several.filter("place > 1").select("v_id", "fan"), "v_id", "fan").select("v_id", "fan", (F.col("number") + greatest + 1).alias("new_id"))
    named = checkpointed(several.join(copies, ["v_id", "fan"], "left").select("v_id", "fan", F.coalesce("new_id", "v_id").alias("new_id")))
    at = fans.join(named, ["v_id", "fan"], "left").select("f_id", "k", F.coalesce("new_id", "v_id").alias("v_id"))
    turned = at.groupBy("f_id").agg(*[F.max(F.when(F.col("k") == i, F.col("v_id"))).alias(c) for i, c in enumerate(CORNERS)])
    made = vertices.select("v_id", "x", "y", "z").join(named.select("v_id", "new_id"), "v_id", "left").select(F.coalesce("new_id", "v_id").alias("v_id"), "x", "y", "z", F.col("new_id").isNotNull().alias("moves"))
    ring = vertex_neighbors(turned).join(named.select(F.col("new_id").alias("v_id")), "v_id").join(made.select(F.col("v_id").alias("nb_id"), *[F.col(c).alias(f"o{c}") for c in "xyz"]), "nb_id")
    middle = ring.groupBy("v_id").agg(*[F.avg(f"o{c}").alias(f"m{c}") for c in "xyz"])
    moved = made.join(middle, "v_id", "left").select("v_id", *[F.when(F.col("moves"), F.col(c) + shift * (F.coalesce(F.col(f"m{c}"), F.col(c)) - F.col(c))).otherwise(F.col(c)).alias(c) for c in "xyz"])
    return moved, turned


def pair_areas(seen: DataFrame) -> DataFrame:
    """(f_id, area): of seen(f_id, image_id, area), the most over image pairs of the lesser area: the second largest."""
    rank = F.row_number().over(Window.partitionBy("f_id").orderBy(F.desc("area"), "image_id"))
    return seen.withColumn("k", rank).filter("k = 2").select("f_id", "area")
