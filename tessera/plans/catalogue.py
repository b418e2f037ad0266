"""Every query of the geometry operators over the driver's tables, with DuckDB SQL for the same rows.

A query is a function of a Scene; the SQL of the relations it stands on is in adapters.SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geom as g
from tessera.operators import cloud, depth, frustum, fusion, hits, iterate, mesh, patchmatch, scene, stereo, texture, views, volume
from tessera.plans.adapters import SQL, Scene, with_

QUERIES: dict[str, Callable[[Scene], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = _rounding(sql)
        return f

    return add


def rounded(df: DataFrame, *names: str, to: int = 4) -> DataFrame:
    """Named doubles rounded by floor(x + 0.5), which both engines compute alike, to so many places."""
    return df.withColumns({n: F.floor(F.col(n) * 10.0**to + 0.5) / 10.0**to for n in names})


def _rounding(sql: str) -> str:
    """SQL whose round(x, 4) and round(x, 9) are written as rounded() computes them."""
    for places in (4, 9):
        while f", {places})" in sql:
            end = sql.index(f", {places})")
            depth, at = 0, end
            while depth >= 0:
                at -= 1
                depth += {")": 1, "(": -1}.get(sql[at], 0)
            if sql[at - 5 : at] != "round":
                sql = sql[:end] + f",\t{places})" + sql[end + len(f", {places})") :]
                continue
            inner = sql[at + 1 : end]
            sql = f"{sql[: at - 5]}(floor(({inner}) * 1e{places} + 0.5) / 1e{places}){sql[end + len(f', {places})') :]}"
    return sql.replace("\t", " ")


def _neighbor_pairs(s: Scene) -> DataFrame:
    """(ref_id, nb_id), both ways, of every camera and the neighbours that view selection leaves it."""
    chosen = views.filter_neighbors(_scores(s)).select("ref_id", "nb_id")
    way = lambda a, b: F.struct(F.col(a).alias("ref_id"), F.col(b).alias("nb_id"))
    return chosen.select(F.inline(F.array(way("ref_id", "nb_id"), way("nb_id", "ref_id")))).distinct()


# ---- views

_SEEN = """seen AS (SELECT *, CASE WHEN u >= 0 AND v >= 0 AND u < width AND v < height THEN floor(u/width*16)*16 + floor(v/height*16) END AS cell
  FROM (SELECT *, px + f*(co*dx - si*dy)/dz AS u, py + f*(si*dx + co*dy)/dz AS v, f/dz AS foot FROM (SELECT pv.point_id, turn.*, x - cx AS dx, y - cy AS dy, z - cz AS dz FROM pv JOIN pt USING (point_id) JOIN turn USING (image_id)) WHERE dz > 0)),
pairs AS (SELECT a.image_id AS ref_id, b.image_id AS nb_id,
  floor(degrees(acos(greatest(-1.0, least(1.0, (a.dx*b.dx + a.dy*b.dy + a.dz*b.dz) / (sqrt(a.dx*a.dx + a.dy*a.dy + a.dz*a.dz) * sqrt(b.dx*b.dx + b.dy*b.dy + b.dz*b.dz)))))) * 1000000 + 0.5)::BIGINT AS angle_micro,
  floor(a.foot / b.foot * 1000000 + 0.5)::BIGINT AS scale_micro, CASE WHEN b.cell IS NOT NULL THEN a.cell END AS cell FROM seen a JOIN seen b ON a.point_id = b.point_id AND a.image_id <> b.image_id),
weighted AS (SELECT *, floor(greatest(exp((angle-12)*(angle-12) * CASE WHEN angle < 12 THEN -1/(2*power(0.38*12,2)) ELSE -1/(2*power(0.7*12,2)) END), 0.1)
    * CASE WHEN scale > 1.6 THEN power(1.6/scale, 2) WHEN scale >= 1 THEN 1.0 ELSE scale*scale END * 1000000000 + 0.5)::BIGINT AS weight_nano FROM (SELECT *, angle_micro / 1e6::DOUBLE AS angle, scale_micro / 1e6::DOUBLE AS scale FROM pairs)),
sums AS (SELECT ref_id, nb_id, count(*) AS points, sum(angle_micro)::DOUBLE / count(*)::DOUBLE / 1e6::DOUBLE AS angle, sum(scale_micro)::DOUBLE / count(*)::DOUBLE / 1e6::DOUBLE AS scale, count(DISTINCT cell) / 256.0::DOUBLE AS area,
  sum(weight_nano)::DOUBLE / 1e9::DOUBLE AS weight FROM weighted GROUP BY 1, 2),
scores AS (SELECT ref_id, nb_id, points, angle, scale, area, weight * greatest(area, 0.01) AS score FROM sums WHERE points >= 3 AND area > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, nb_id) AS rank FROM scores)"""
_PLACED = """flagged AS (SELECT *, area < 0.01 OR NOT scale BETWEEN 0.2 AND 3.2 OR NOT angle BETWEEN 3 AND 65 AS bad, count(*) OVER (PARTITION BY ref_id) AS n FROM ranked),
counted AS (SELECT *, sum(bad::INT) OVER (PARTITION BY ref_id ORDER BY rank DESC) AS bad_rank FROM flagged),
placed AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY rank) AS place FROM counted WHERE NOT bad OR bad_rank > greatest(n - 9, 0)),
near_of AS (SELECT ref_id, nb_id FROM placed WHERE place <= 12 UNION SELECT nb_id, ref_id FROM placed WHERE place <= 12)"""


def _scores(s: Scene) -> DataFrame:
    return views.neighbor_scores(s.point_views(), s.points(), s.turned_cameras())


_SCORE = "points, round(angle, 4) AS angle, round(scale, 4) AS scale, round(area, 4) AS area, round(score, 4) AS score"


@query(with_("pv pt turn", _SEEN) + f"SELECT ref_id, nb_id, {_SCORE} FROM scores")
def neighbor_scores(s):
    return rounded(_scores(s), "angle", "scale", "area", "score")


@query(with_("pv pt turn", _SEEN) + f"SELECT ref_id, nb_id, rank, {_SCORE} FROM ranked WHERE rank <= 10")
def neighbor_topk(s):
    return rounded(views.top_neighbors(_scores(s), 10), "angle", "scale", "area", "score")


@query(with_("pv pt turn", _SEEN, _PLACED) + f"SELECT ref_id, nb_id, place, {_SCORE} FROM placed WHERE place <= 12")
def neighbor_filter(s):
    return rounded(views.filter_neighbors(_scores(s)), "angle", "scale", "area", "score")


@query(with_("pv pt turn", _SEEN) + "SELECT ref_id, nb_id, round(area, 4) AS area FROM sums WHERE points >= 3 AND area > 0")
def covered_area(s):
    return rounded(_scores(s).select("ref_id", "nb_id", "area"), "area")


@query(with_("pv") + "SELECT a.image_id AS ref_id, b.image_id AS nb_id, count(*) AS points FROM pv a JOIN pv b ON a.point_id = b.point_id AND a.image_id <> b.image_id GROUP BY 1, 2")
def covisible_pairs(s):
    return views.covisible_pairs(s.point_views())


@query(with_("pv") + "SELECT DISTINCT least(a.image_id, b.image_id) AS a_id, greatest(a.image_id, b.image_id) AS b_id FROM pv a JOIN pv b ON a.point_id = b.point_id AND a.image_id <> b.image_id")
def pair_dedup(s):
    return views.covisible(s.point_views()).select("a_id", "b_id")


@query(with_("pv") + "SELECT point_id FROM pv WHERE image_id IN (3, 7) GROUP BY 1 HAVING count(*) = 2")
def view_relational_division(s):
    return views.seen_by_all(s.point_views(), [3, 7])


@query(with_("pv", "part_of AS (SELECT * FROM pv WHERE image_id < 40)") + "SELECT point_id, image_id, weight FROM part_of WHERE point_id IN (SELECT point_id FROM part_of GROUP BY 1 HAVING count(*) >= 2)")
def subscene(s):
    return views.sub_scene(s.point_views(), s.cameras().filter("image_id < 40")).select("point_id", "image_id", "weight")


@query(with_("pv pt") + "SELECT image_id, count(*) AS points FROM pv JOIN pt USING (point_id) WHERE x BETWEEN 20 AND 60 AND y BETWEEN 20 AND 60 AND z BETWEEN 15 AND 50 GROUP BY 1 HAVING count(*) >= 3")
def crop_roi(s):
    return views.crop_to_box(s.points(), s.point_views(), (20.0, 20.0, 15.0), (60.0, 60.0, 50.0))


@query(with_("pv pt turn") + "SELECT image_id, count(*) AS points, round(avg(z - cz), 4) AS avg_depth FROM pv JOIN pt USING (point_id) JOIN turn USING (image_id) WHERE z - cz > 0 GROUP BY 1")
def mean_depth_per_image(s):
    return rounded(views.mean_depth(s.point_views(), s.points(), s.turned_cameras()), "avg_depth")


@query(with_("cam") + "SELECT image_id, round(degrees(2*atan(width/(2*f))), 4) AS fov_x, round(degrees(2*atan(height/(2*f))), 4) AS fov_y, round(degrees(2*atan(sqrt(width*width + height*height)/(2*f))), 4) AS fov_d, 500 AS side FROM cam")
def image_intrinsics(s):
    return rounded(views.intrinsics(s.cameras()), "fov_x", "fov_y", "fov_d")


# ---- clouds


@query(with_("pv", "n AS (SELECT point_id, count(*) AS n FROM pv GROUP BY 1)") + "SELECT least(n, 4) AS views, count(*) AS points FROM n GROUP BY 1")
def track_hist(s):
    return cloud.track_histogram(s.point_views())


@query(with_("pv", "n AS (SELECT point_id, count(*) AS n FROM pv GROUP BY 1)") + "SELECT min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS std, count(*) AS points FROM n")
def track_stats(s):
    return rounded(cloud.track_statistics(s.point_views()), "mean", "std")


@query(with_("pv pt") + "SELECT point_id, x, y, z FROM pt WHERE point_id IN (SELECT point_id FROM pv GROUP BY 1 HAVING count(*) >= 3)")
def points_min_views(s):
    return cloud.with_least_views(s.points(), s.point_views(), 3)


@query(with_("pt") + "SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM pt")
def scene_aabb(s):
    return cloud.bounding_box(s.points())


@query(with_("pt", "n AS (SELECT *, row_number() OVER (ORDER BY point_id) - 1 AS k FROM pt)") + "SELECT median(x) AS x, median(y) AS y, median(z) AS z FROM n WHERE k % 5 = 0")
def scene_center(s):
    return cloud.centre(s.points())


@query(with_("pv pt turn") + "SELECT point_id, round(min((z - cz) / f), 4) AS scale, count(*) AS confidence FROM pv JOIN pt USING (point_id) JOIN turn USING (image_id) GROUP BY 1")
def point_scale(s):
    return rounded(cloud.point_scale(s.point_views(), s.points(), s.turned_cameras()), "scale")


@query(with_("votes", "n AS (SELECT point_id, label, count(*) AS n FROM votes GROUP BY 1, 2)", "k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY n DESC, label) AS k FROM n)") + "SELECT point_id, label, n FROM k WHERE k = 1 AND n >= 2")
def label_vote(s):
    return cloud.label_votes(s.votes())


@query(with_("votes", "d AS (SELECT DISTINCT label FROM votes)") + "SELECT label, round((dense_rank() OVER (ORDER BY label) - 1) / greatest((SELECT count(*) FROM d) - 1, 2)::DOUBLE, 4) AS tone FROM d")
def label_palette(s):
    return rounded(cloud.label_palette(s.votes()), "tone")


@query(with_("pv pt cam", "d AS (SELECT point_id, image_id, round(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)), 6) AS d FROM pv JOIN pt USING (point_id) JOIN cam USING (image_id))", "k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, image_id) AS k FROM d)") + "SELECT pt.point_id, image_id, round(d, 4) AS distance FROM pt LEFT JOIN k ON k.point_id = pt.point_id AND k.k = 1")
def color_nearest_view(s):
    return rounded(cloud.nearest_view(s.point_views(), s.points(), s.cameras()), "distance")


@query(with_("depth cam") + "SELECT r, c, round(sum(z*w)/sum(w), 4) AS z, round(sum(x*w)/sum(w), 4) AS x FROM (SELECT r, c, depth AS z, (c - px)*depth/f + cx AS x, 1/(greatest(1-conf, 0.03)*depth*depth) AS w FROM depth JOIN cam USING (image_id)) GROUP BY 1, 2")
def weighted_mean_point(s):
    rows = depth.back_projected(s.depth(), s.cameras())
    return rounded(cloud.weighted_mean(rows, ["r", "c"], ["z", "x"], cloud.fused_weight(F.col("weight"), F.col("z"))), "z", "x")


@query(with_("cloud") + "SELECT label, round(median(x), 4) AS x, round(median(y), 4) AS y, round(median(z), 4) AS z, count(*) AS n FROM cloud GROUP BY 1")
def median_point(s):
    return rounded(cloud.component_medians(s.cloud(), "label", ["x", "y", "z"]), "x", "y", "z")


_CENTS = "cents AS (SELECT round(o_totalprice * 100)::BIGINT AS v FROM orders)"


def _cents(s: Scene) -> DataFrame:
    return s.table("orders").select(F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))


@query(f"WITH {_CENTS}, m AS (SELECT list_sort(list(v))[count(*)//2 + 1] AS m FROM cents) SELECT m AS middle, round(5.2 * (SELECT list_sort(list(abs(v - m)))[count(*)//2 + 1] FROM cents), 4) AS threshold FROM m")
def x84_threshold(s):
    return rounded(cloud.x84(_cents(s), "v"), "threshold")


@query(f"WITH {_CENTS}, q AS (SELECT list_sort(list(v)) AS l, count(*) AS n FROM cents), e AS (SELECT l[n//4 + 1] AS q1, l[n//2 + 1] AS q2, l[3*n//4 + 1] AS q3 FROM q) SELECT q1, q2, q3, round(q1 - 1.5*(q3-q1), 4) AS low, round(q3 + 1.5*(q3-q1), 4) AS high FROM e")
def quartile_fences(s):
    return rounded(cloud.fences(_cents(s), "v"), "low", "high")


_BIN = "hist AS (SELECT CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 51 ELSE floor(l_extendedprice / 2000)::BIGINT + 1 END AS bin, count(*) AS n FROM lineitem GROUP BY 1)"


@query(f"WITH {_BIN} SELECT bin, n FROM hist")
def histogram_bins(s):
    return cloud.histogram(s.table("lineitem"), "l_extendedprice", 0, 100000, 50)


@query(f"WITH {_BIN}, run AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM hist WHERE bin BETWEEN 1 AND 50) SELECT min(bin) * 2000.0::DOUBLE AS value FROM run WHERE upto >= 0.95 * total")
def permille(s):
    return cloud.permille(histogram_bins(s), 0.95, 0.0, 100000.0, 50)


@query("WITH p AS (SELECT count(*) AS n, power(4/(3.0*count(*)), 0.2) * stddev_samp(c_acctbal) AS h FROM customer) SELECT k, round(sum(exp(-power((-1000 + k*550.0 - c_acctbal)/h, 2)/2)) / any_value(n*h*sqrt(2*pi())), 9) AS density FROM customer, p, range(21) t(k) GROUP BY k")
def kde_grid(s):
    return rounded(cloud.density_grid(s.table("customer"), "c_acctbal", -1000.0, 10000.0, 20), "density", to=9)


@query(with_("cloud") + "SELECT round(covar_samp(x,x),4) AS c_xx, round(covar_samp(x,y),4) AS c_xy, round(covar_samp(x,z),4) AS c_xz, round(covar_samp(y,y),4) AS c_yy, round(covar_samp(y,z),4) AS c_yz, round(covar_samp(z,z),4) AS c_zz FROM cloud")
def covariance3(s):
    return rounded(cloud.covariance(s.cloud()), "c_xx", "c_xy", "c_xz", "c_yy", "c_yz", "c_zz")


@query(with_("cloud", "d AS (SELECT a.vec_id AS q_id, b.vec_id AS p_id, round((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), 9) AS d2 FROM cloud a JOIN cloud b ON a.vec_id <> b.vec_id)", "k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, p_id) AS rank FROM d)") + "SELECT q_id, p_id, rank FROM k WHERE rank <= 8")
def knn_points(s):
    p = s.cloud().withColumnRenamed("vec_id", "id")
    return cloud.nearest(p, p, 8, 0.25).select("q_id", "p_id", "rank")


@query(with_("cloud") + "SELECT a.vec_id AS box_id, b.vec_id AS p_id FROM cloud a JOIN cloud b ON b.x BETWEEN a.x - 0.1 AND a.x + 0.1 AND b.y BETWEEN a.y - 0.1 AND a.y + 0.1 AND b.z BETWEEN a.z - 0.1 AND a.z + 0.1")
def box_range_join(s):
    p = s.cloud()
    boxes = p.select(F.col("vec_id").alias("box_id"), *[(F.col(c) + d).alias(f"{n}_{c}") for n, d in (("low", -0.1), ("high", 0.1)) for c in "xyz"])
    return cloud.in_boxes(boxes, p.withColumnRenamed("vec_id", "id"), 0.2)


@query("SELECT round(10*log10(sum(l_extendedprice*l_extendedprice)/sum(power(l_extendedprice*l_discount,2))), 4) AS snr, round(10*log10(255.0*255.0/avg(power(l_extendedprice*l_discount,2))), 4) AS psnr FROM lineitem")
def signal_to_noise(s):
    t = s.table("lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    return rounded(cloud.signal_to_noise(t, "a", "b", 255.0), "snr", "psnr")


@query(with_("pv pt cam", "nv AS (SELECT point_id, count(*) AS n FROM pv GROUP BY 1)",
    "eye AS (SELECT *, sqrt(qx*qx + qy*qy + qz*qz) AS d, floor(px + f*qx/qz + 0.5) AS u, floor(py + f*qy/qz + 0.5) AS w FROM (SELECT point_id, image_id, f, px, py, x - cx AS qx, y - cy AS qy, z - cz AS qz FROM pt, cam) WHERE qz > 0)",
    "ends AS (SELECT e.point_id, image_id, n, qx, qy, qz, d, u + i AS u, w + j AS w FROM eye e JOIN pv USING (point_id, image_id) JOIN nv ON nv.point_id = e.point_id, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))",
    "met AS (SELECT p.point_id, p.f, coalesce(nv.n, 0) AS n, e.n AS end_n, p.d, e.d AS end_d, (p.qx*e.qx + p.qy*e.qy + p.qz*e.qz) / e.d AS t FROM ends e JOIN eye p ON p.image_id = e.image_id AND p.u = e.u AND p.w = e.w AND p.point_id <> e.point_id LEFT JOIN nv ON nv.point_id = p.point_id)",
    "votes AS (SELECT point_id, sum(CASE WHEN d * 1.02 < end_d THEN -end_n WHEN d > end_d * 1.02 THEN n ELSE 0 END)::BIGINT AS votes FROM met WHERE t > 0 AND t*t > d*d / (1 + power(1/f, 2)) GROUP BY 1)") + "SELECT point_id, coalesce(votes, 0) AS votes FROM pt LEFT JOIN votes USING (point_id)")
def point_visibility_filter(s):
    """Votes by visibility rays."""
    return cloud.visibility_votes(s.point_views(), s.points(), s.cameras())


_ROI = "x BETWEEN 20 AND 60 AND y BETWEEN 20 AND 60 AND z BETWEEN 15 AND 50"


@query(with_("pv pt", "n AS (SELECT point_id, count(*) AS n FROM pv GROUP BY 1)", f"l AS (SELECT {_ROI} AS inside, coalesce(n, 0) AS n FROM pt LEFT JOIN n USING (point_id))") + "SELECT inside, count(*) AS points, min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS std FROM l GROUP BY 1")
def roi_stats(s):
    return rounded(cloud.region_statistics(s.points(), s.point_views(), (20.0, 20.0, 15.0), (60.0, 60.0, 50.0)), "mean", "std")


@query(with_("pv", "w AS (SELECT point_id, avg(weight) AS w FROM pv GROUP BY 1)") + "SELECT round(min(w), 4) AS least, round(max(w), 4) AS most, round(avg(w), 4) AS mean, round(stddev_pop(w), 4) AS std FROM w")
def weight_stats(s):
    return rounded(cloud.weight_statistics(s.point_views()), "least", "most", "mean", "std")


_TURNED = "a AS (SELECT cx - x AS dx, cy - y AS dy, cz - z AS dz, (point_id % 3 - 1)::DOUBLE AS nx, (point_id % 5 - 2)::DOUBLE AS ny, -2.0::DOUBLE AS nz FROM pv JOIN pt USING (point_id) JOIN cam USING (image_id)), k AS (SELECT degrees(acos(greatest(-1.0, least(1.0, (dx*nx + dy*ny + dz*nz) / sqrt((dx*dx + dy*dy + dz*dz) * (nx*nx + ny*ny + nz*nz)))))) AS angle FROM a)"


@query(with_("pv pt cam", _TURNED) + "SELECT CASE WHEN angle >= 90 THEN 90 WHEN angle >= 60 THEN 60 WHEN angle >= 40 THEN 40 WHEN angle >= 25 THEN 25 WHEN angle >= 10 THEN 10 WHEN angle >= 3 THEN 3 ELSE 0 END AS degrees, count(*) AS views FROM k GROUP BY 1")
def normal_view_angles(s):
    turned = s.points().withColumns({"nx": (F.col("point_id") % 3 - 1).cast("double"), "ny": (F.col("point_id") % 5 - 2).cast("double"), "nz": F.lit(-2.0)})
    return cloud.view_angles(turned, s.point_views(), s.cameras())


@query(with_("pt cam") + "SELECT point_id, round((x + 2*y + 2*z - 150) / 3, 4) + 0.0 AS distance, round(x - (x + 2*y + 2*z - 150) / 9, 4) + 0.0 AS x, round(y - 2*(x + 2*y + 2*z - 150) / 9, 4) + 0.0 AS y, round(z - 2*(x + 2*y + 2*z - 150) / 9, 4) + 0.0 AS z, round(150 / (x + 2*y + 2*z), 4) AS along FROM pt")
def plane_points(s):
    p, normal, offset = g.vec("x", "y", "z"), [F.lit(1 / 3), F.lit(2 / 3), F.lit(2 / 3)], F.lit(-50.0)
    foot = g.on_plane(p, normal, offset)
    rows = s.points().select("point_id", g.plane_distance(p, normal, offset).alias("distance"), *[c.alias(n) for c, n in zip(foot, "xyz", strict=True)], g.ray_plane([F.lit(0.0)] * 3, p, normal, offset).alias("along"))
    return rounded(rows, "distance", "x", "y", "z", "along")


@query(with_("pt") + "SELECT point_id, 0.0 + z AS height FROM pt WHERE z BETWEEN 12 AND 50 AND z*z > 0.64 * ((x-50)*(x-50) + (y-40)*(y-40) + z*z)")
def cone_points(s):
    at = g.in_cone(g.vec("x", "y", "z"), [F.lit(50.0), F.lit(40.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.lit(0.8), F.lit(12.0), F.lit(50.0))
    return s.points().filter(at).select("point_id", F.col("z").alias("height"))


@query(with_("pt") + "SELECT point_id FROM pt WHERE abs(-(y-40)) <= 10 AND abs(x-50) <= 20 AND abs(z-30) <= 15")
def oriented_box_points(s):
    return s.points().filter(g.in_oriented_box(g.vec("x", "y", "z"), _SIM[1], (50.0, 40.0, 30.0), (10.0, 20.0, 15.0))).select("point_id")


@query(with_("pt") + "SELECT point_id FROM pt WHERE x+5 >= 15 AND x-5 < 65 AND y+5 >= 15 AND y-5 < 65 AND z+5 >= 10 AND z-5 < 60")
def boxes_that_meet(s):
    p = g.vec("x", "y", "z")
    low, high = g.enlarged([F.lit(v) for v in (30.0, 30.0, 25.0)], [F.lit(v) for v in (50.0, 50.0, 45.0)], 2.0, 5.0)
    return s.points().filter(g.boxes_meet(*g.enlarged(p, p, 1.0, 5.0), low, high)).select("point_id")


@query("SELECT round(exp(avg(ln(o_totalprice::DOUBLE))), 4) AS mean FROM orders WHERE o_totalprice > 0")
def geometric_mean(s):
    return rounded(cloud.geometric_mean(s.table("orders"), "o_totalprice"), "mean")


@query(with_("pv pt turn", _SEEN, "ids AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS new_id FROM cam_of)").replace("WITH ", "WITH cam_of AS (SELECT s_suppkey AS image_id FROM supplier WHERE s_suppkey % 3 <> 1), ", 1) + "SELECT a.new_id AS ref_id, b.new_id AS nb_id, points, round(score, 4) AS score FROM scores JOIN ids a ON a.image_id = ref_id JOIN ids b ON b.image_id = nb_id")
def subscene_scores(s):
    ids = views.dense_ids(s.cameras().filter("image_id % 3 <> 1"))
    return rounded(views.renamed_scores(_scores(s), ids).select("ref_id", "nb_id", "points", "score"), "score")


# ---- depth maps


@query(with_("depth turn") + "SELECT image_id, r, c, round(co*(c-px)*depth/f + si*(r-py)*depth/f + cx, 4) AS x, round(co*(r-py)*depth/f - si*(c-px)*depth/f + cy, 4) AS y, round(depth + cz, 4) AS z, conf AS weight FROM depth JOIN turn USING (image_id)")
def depth_backproject(s):
    return rounded(depth.back_projected(s.depth(), s.turned_cameras()), "x", "y", "z")


@query(with_("depth") + "SELECT image_id, r, c, depth, conf FROM depth WHERE conf >= 0.7")
def depth_filter_conf(s):
    return depth.confident(s.depth(), 0.7)


_OTHER = "other AS (SELECT image_id, (r + 1) % 64 AS r, c, depth FROM depth)"


@query(with_("depth", _OTHER, "met AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, a.depth AS da, b.depth AS db, abs(a.depth-b.depth)/a.depth AS e FROM depth a FULL JOIN other b ON a.image_id = b.image_id AND a.r = b.r AND a.c = b.c)", "sums AS (SELECT image_id, count(*) FILTER (e > 0.01) AS errors, count(*) FILTER (db IS NULL) AS missing, count(*) FILTER (da IS NULL) AS extra, coalesce(sum(e), 0) AS s, coalesce(sum(e*e), 0) AS q FROM met GROUP BY 1)", "n AS (SELECT *, 64*64 - missing - extra AS n FROM sums)") + "SELECT image_id, errors, missing, extra, round(s/n, 4) AS mean, round(sqrt(greatest(q/n - (s/n)*(s/n), 0)), 4) AS std FROM n")
def depth_compare(s):
    d = s.depth()
    return rounded(depth.compared(d, d.withColumn("r", (F.col("r") + 1) % 64), size=(64, 64)), "mean", "std")


@query(with_("depth", "n AS (SELECT *, lead(c) OVER w AS c2, lead(depth) OVER w AS d2, lead(conf) OVER w AS f2 FROM depth WINDOW w AS (PARTITION BY image_id, r ORDER BY c))") + "SELECT image_id, r, k AS c, round(depth + (k-c)::DOUBLE/(c2-c)*(d2-depth), 4) AS depth, least(conf, f2) AS conf FROM n, LATERAL (SELECT unnest(range(c+1, c2)) AS k) WHERE c2-c-1 BETWEEN 1 AND 7 AND abs(depth-d2)/depth < 0.1")
def gap_fill_rows(s):
    return rounded(depth.gaps_filled(s.depth()), "depth")


_NEAR = "near AS (SELECT a.image_id, a.r, a.c, a.depth, b.r - a.r AS dr, b.c - a.c AS dc, b.depth AS other FROM depth a JOIN depth b ON a.image_id = b.image_id AND b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1 AND (a.r <> b.r OR a.c <> b.c))"


_ZEROES = "CASE WHEN total - n >= 3 THEN [depth, depth, depth] WHEN total - n = 2 THEN [depth, depth] WHEN total - n = 1 THEN [depth] ELSE [] END"


@query(with_("depth", _NEAR, "span AS (SELECT image_id, max(depth) - min(depth) AS span FROM depth GROUP BY 1)", "win AS (SELECT image_id, r, c, count(*) AS n, count(*) FILTER (abs(depth-other)/depth < 0.03) AS alike, list(abs(depth-other)) AS diffs FROM near GROUP BY 1, 2, 3)",
    "full_ AS (SELECT d.image_id, d.r, d.c, d.depth, span, (CASE WHEN d.r IN (0, 63) THEN 2 ELSE 3 END) * (CASE WHEN d.c IN (0, 63) THEN 2 ELSE 3 END) - 1 AS total, coalesce(n, 0) AS n, coalesce(alike, 0) AS alike, coalesce(diffs, []) AS diffs FROM depth d JOIN span USING (image_id) LEFT JOIN win ON win.image_id = d.image_id AND win.r = d.r AND win.c = d.c)",
    f"closest AS (SELECT *, list_sum(list_sort(list_concat(diffs, {_ZEROES}))[1:3]) / total AS least FROM full_)") + "SELECT image_id, r, c, round(0.9*exp(-power(least/(0.002*span), 2)) + 0.1*(0.7*least(alike/3.0::DOUBLE, 1.0) + 0.3*CASE WHEN alike = 0 THEN 0 ELSE greatest(1 - (total-alike)::DOUBLE/alike, 0) END), 4) AS conf FROM closest")
def conf_from_depth(s):
    return rounded(depth.confidence(s.depth(), 64, 64), "conf")


@query(with_("depth cam", _NEAR, "g AS (SELECT image_id, r, c, depth, count(*) AS n, sum(dc*dc)::DOUBLE AS xx, sum(dc*dr)::DOUBLE AS xy, sum(dr*dr)::DOUBLE AS yy, sum((other-depth)*dc) AS gx, sum((other-depth)*dr) AS gy FROM near WHERE abs(depth-other)/depth < 0.5 GROUP BY 1, 2, 3, 4)", "w AS (SELECT *, (gx*yy - gy*xy)/(xx*yy - xy*xy) AS wx, (gy*xx - gx*xy)/(xx*yy - xy*xy) AS wy FROM g WHERE n >= 3 AND xx*yy - xy*xy <> 0)",
    "raw AS (SELECT image_id, r, c, f*wx AS nx, f*wy AS ny, (px-c)*wx + (py-r)*wy - depth AS nz FROM w JOIN cam USING (image_id))") + "SELECT image_id, r, c, round(nx/sqrt(nx*nx+ny*ny+nz*nz), 4) + 0.0 AS nx, round(ny/sqrt(nx*nx+ny*ny+nz*nz), 4) + 0.0 AS ny, round(nz/sqrt(nx*nx+ny*ny+nz*nz), 4) + 0.0 AS nz FROM raw")
def depth_normals(s):
    return rounded(depth.normals(s.depth(), s.cameras(), threshold=0.5), "nx", "ny", "nz")


_FACING = "nor AS (SELECT image_id, r, c, (r % 5 - 2) / m AS nx, (c % 7 - 3) / m AS ny, -4 / m AS nz FROM (SELECT *, sqrt((r % 5 - 2) * (r % 5 - 2) + (c % 7 - 3) * (c % 7 - 3) + 16.0::DOUBLE) AS m FROM depth))"


def _facing(s: Scene) -> DataFrame:
    """A normal for each valid pixel."""
    n = [F.col("r") % 5 - 2, F.col("c") % 7 - 3, F.lit(-4.0)]
    return s.depth().select("image_id", "r", "c", *[(v / g.norm(n)).alias(f"n{x}") for v, x in zip(n, "xyz", strict=True)])


@query(with_("depth", _FACING, "met AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, CASE WHEN a.nx IS NOT NULL AND b.nx IS NOT NULL THEN round_even(degrees(acos(greatest(-1.0, least(1.0, a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)))), 6) END AS e FROM nor a FULL JOIN (SELECT image_id, (r + 1) % 64 AS r, c, nx, ny, nz FROM nor) b ON a.image_id = b.image_id AND a.r = b.r AND a.c = b.c)",
    "zero AS (SELECT image_id, 0.0::DOUBLE AS e FROM (SELECT image_id, 64*64 - count(*) AS n FROM met GROUP BY 1), LATERAL (SELECT unnest(range(n)) AS k))", "every AS (SELECT image_id, e FROM met WHERE e IS NOT NULL UNION ALL SELECT image_id, e FROM zero)") + "SELECT image_id, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std, round(list_sort(list(e))[count(*)//2 + 1], 4) AS median FROM every GROUP BY 1")
def normal_compare(s):
    n = _facing(s)
    return rounded(depth.compared_normals(n, n.withColumn("r", (F.col("r") + 1) % 64), (64, 64)), "mean", "std", "median")


@query(with_("depth", _FACING, "win AS (SELECT a.image_id, a.r, a.c, b.nx, b.ny, b.nz FROM nor a JOIN nor b ON a.image_id = b.image_id AND b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1)", "mean AS (SELECT image_id, r, c, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM win GROUP BY 1, 2, 3)") + "SELECT image_id, r, c, round(power(1 - sum(power(acos(greatest(-1.0, least(1.0, mx*nx + my*ny + mz*nz))), 2)) / (count(*) * pi()), 2), 4) AS conf FROM win JOIN mean USING (image_id, r, c) GROUP BY 1, 2, 3")
def conf_from_normal(s):
    return rounded(depth.normal_confidence(_facing(s)), "conf")


@query(with_("depth", "win AS (SELECT a.image_id, a.r, a.c, sum(b.depth) / 49 AS mean, sum(b.depth * b.depth) / 49 AS q FROM depth a JOIN depth b ON a.image_id = b.image_id AND b.r BETWEEN a.r-3 AND a.r+3 AND b.c BETWEEN a.c-3 AND a.c+3 WHERE a.r BETWEEN 3 AND 60 AND a.c BETWEEN 3 AND 60 GROUP BY 1, 2, 3)") + "SELECT image_id, r, c, round(mean, 4) AS mean, round(greatest(q - mean*mean, 0.0001), 4) AS variance FROM win")
def window_mean_variance(s):
    return rounded(depth.window_moments(s.depth(), "depth", 64, 64), "mean", "variance")


@query(with_("depth") + "SELECT image_id, r, c, row_number() OVER (PARTITION BY image_id ORDER BY least(r // 24, 1), r + c, r) - 1 AS place FROM depth")
def zigzag_order(s):
    return depth.zigzag(s.depth(), 64, 24)


@query(with_("depth turn") + "SELECT image_id, r, c, round((co*(c-px) + si*(r-py))/f, 4) + 0.0 AS x, round((co*(r-py) - si*(c-px))/f, 4) + 0.0 AS y, 1.0::DOUBLE AS z FROM depth JOIN turn USING (image_id)")
def pixel_rays(s):
    cameras = g.posed(s.turned_cameras())
    d = g.ray(F.col("c"), F.col("r"), F.col("f"), F.col("px"), F.col("py"), g.rotation(cameras.columns))
    return rounded(s.depth().select("image_id", "r", "c").join(cameras, "image_id").select("image_id", "r", "c", *[x.alias(n) for x, n in zip(d, "xyz", strict=True)]), "x", "y", "z")


@query(with_("depth") + "SELECT image_id, r, c, round((c + 0.5) / 64, 4) AS u, round(1 - (r + 0.5) / 64, 4) AS v, c::DOUBLE AS x, r::DOUBLE AS y FROM depth")
def texture_coordinates(s):
    u, v = g.texture_share(F.col("c"), F.col("r"), F.lit(64), F.lit(64))
    rows = s.depth().select("image_id", "r", "c", u.alias("u"), v.alias("v"))
    x, y = g.texture_pixel(F.col("u"), F.col("v"), F.lit(64), F.lit(64))
    return rounded(rows.withColumns({"x": x, "y": y}), "u", "v", "x", "y")


@query(with_("depth cam") + "SELECT image_id, r, c, round(depth / sqrt(power((c-px)/f, 2) + power((r-py)/f, 2) + 1), 4) AS depth FROM depth JOIN cam USING (image_id)")
def range_to_depth(s):
    return rounded(depth.range_to_depth(s.depth().withColumnRenamed("depth", "range"), s.cameras()), "depth")


@query("WITH sc AS (SELECT l_suppkey AS image_id, l_partkey % 64 AS r, l_orderkey % 8 AS c, l_extendedprice / 50000 AS score FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, r, c ORDER BY score) AS k FROM sc) SELECT image_id, r, c, round(CASE WHEN max(score) FILTER (k = 2) < 1.2 THEN avg(score) FILTER (k <= 2) ELSE min(score) END, 4) AS score FROM k GROUP BY 1, 2, 3")
def score_best_two(s):
    t = s.table("lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 64).alias("r"), (F.col("l_orderkey") % 8).alias("c"), (F.col("l_extendedprice") / 50000).alias("score"))
    return rounded(depth.best_two(t), "score")


_REP = """pts AS (SELECT image_id AS ref_id, r, c, co*(c-px)*depth/f + si*(r-py)*depth/f + cx AS x, co*(r-py)*depth/f - si*(c-px)*depth/f + cy AS y, depth + cz AS z FROM depth JOIN turn USING (image_id)),
rays AS (SELECT ref_id, r, c, nb_id, f, px, py, co*(x-cx) - si*(y-cy) AS qx, si*(x-cx) + co*(y-cy) AS qy, z - cz AS qz FROM pts JOIN near_of USING (ref_id) JOIN turn ON turn.image_id = nb_id),
shot AS (SELECT ref_id, r, c, nb_id, floor(py + f*qy/qz + 0.5)::BIGINT AS r2, floor(px + f*qx/qz + 0.5)::BIGINT AS c2, qz FROM rays WHERE qz > 0),
met AS (SELECT ref_id, shot.r, shot.c, nb_id, r2, c2, abs(qz-d.depth)/qz AS diff, d.conf AS other_conf FROM shot JOIN depth d ON d.image_id = nb_id AND d.r = r2 AND d.c = c2)"""


def _matches(s: Scene) -> DataFrame:
    return depth.reprojected(s.depth(), s.turned_cameras(), _neighbor_pairs(s), 0.2)


@query(with_("pv pt depth turn", _SEEN, _PLACED, _REP) + "SELECT ref_id, r, c, nb_id, r2, c2, diff < 0.2 AS agrees FROM met")
def reproject_match(s):
    return _matches(s).select("ref_id", "r", "c", "nb_id", "r2", "c2", "agrees")


@query(with_("pv pt depth turn", _SEEN, _PLACED, _REP, "best AS (SELECT ref_id AS image_id, r, c, min(diff) FILTER (diff <= 1) AS best, first(other_conf ORDER BY diff, other_conf DESC) FILTER (diff <= 1) AS best_conf, coalesce(list_sum(list_sort(list(other_conf) FILTER (diff > 0.2), 'DESC')[1:2]), 0) AS neg FROM met GROUP BY 1, 2, 3)",
    "photo AS (SELECT depth.image_id, depth.r, depth.c, least(conf, coalesce(best_conf, 0)) AS photo, coalesce(neg, 0) AS neg, coalesce(best, 1.0) AS best FROM depth LEFT JOIN best USING (image_id, r, c))") + "SELECT image_id, r, c, round(CASE WHEN photo > neg THEN 0.3*photo + 0.7*exp(-power(best, 2)/(2*0.01*0.01)) WHEN neg > 0 THEN 0.1*photo/neg ELSE 0 END, 4) AS conf FROM photo")
def adjust_conf_fast(s):
    return rounded(depth.adjusted_confidence(s.depth(), _matches(s), 0.2), "conf")


@query(with_("depth", _OTHER) + "SELECT a.image_id, a.r, a.c, CASE WHEN a.conf > 0 AND b.conf > 0 THEN greatest(a.conf, b.conf) ELSE 0 END AS conf FROM depth a LEFT JOIN (SELECT image_id, (r+1)%64 AS r, c, conf FROM depth) b ON a.image_id = b.image_id AND a.r = b.r AND a.c = b.c")
def combine_confidence(s):
    d = s.depth()
    return depth.combined_confidence(d, d.withColumn("r", (F.col("r") + 1) % 64))


_DISP = "disp AS (SELECT image_id, r, c, (floor(depth) % 8)::INT AS disp FROM depth)"


def _disp(s: Scene) -> DataFrame:
    return s.depth().select("image_id", "r", "c", (F.floor("depth") % 8).cast("int").alias("disp"))


@query(with_("depth", _DISP) + "SELECT a.image_id, a.r, a.c, a.disp FROM disp a JOIN disp b ON a.image_id = b.image_id AND a.r = b.r AND b.c = a.c + a.disp AND abs(a.disp - b.disp) <= 1")
def disparity_cross_check(s):
    d = _disp(s)
    return depth.cross_checked(d, d.withColumn("disp", -F.col("disp")))


@query(with_("depth", _DISP) + "SELECT image_id, r, x AS c, arg_max(-disp, c) AS disp FROM disp, LATERAL (SELECT unnest(range(c + disp - 1, c + disp + 2)) AS x) WHERE x BETWEEN 0 AND 63 GROUP BY 1, 2, 3")
def disparity_flip(s):
    return depth.flipped(_disp(s), 64)


@query(with_("depth", _DISP) + "SELECT image_id, r, c, min(disp) OVER w AS low, max(disp) OVER w AS high FROM disp WINDOW w AS (PARTITION BY image_id, r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def disparity_ranges(s):
    return depth.disparity_range(_disp(s))


@query(with_("depth") + "SELECT image_id, r, c, (floor(depth) % 8)::INT AS disp, (floor(conf * 255))::INT AS cost FROM depth WHERE floor(conf * 255) <= 180")
def disparity_filter_cost(s):
    return depth.within_cost(s.depth().select("image_id", "r", "c", (F.floor("depth") % 8).cast("int").alias("disp"), F.floor(F.col("conf") * 255).cast("int").alias("cost")), 180)


@query(with_("depth", _DISP) + "SELECT image_id, r, c, round(500 * 0.1 / abs(disp), 4) AS depth FROM disp WHERE disp <> 0")
def disparity_depth(s):
    return rounded(depth.disparity_to_depth(_disp(s), 500.0, 0.1), "depth")


@query(with_("depth", "seq AS (SELECT r, c, depth, row_number() OVER (PARTITION BY r, c ORDER BY image_id) AS k, count(*) OVER (PARTITION BY r, c) AS last FROM depth)",
    """fold AS (SELECT r, c, k, last, [depth] AS firsts, [1] AS sizes, [depth] AS totals FROM seq WHERE k = 1
  UNION ALL SELECT r, c, k, last, CASE WHEN place = 0 THEN list_append(firsts, depth) ELSE firsts END,
    CASE WHEN place = 0 THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda x, i: x + (i = place)::INT) END,
    CASE WHEN place = 0 THEN list_append(totals, depth) ELSE list_transform(totals, lambda x, i: CASE WHEN i = place THEN x + depth ELSE x END) END
  FROM (SELECT s.*, firsts, sizes, totals, coalesce(list_position(list_transform(firsts, lambda x: abs(x - s.depth) / x < 0.2), true), 0) AS place FROM fold JOIN seq s ON s.r = fold.r AND s.c = fold.c AND s.k = fold.k + 1))""",
    "best AS (SELECT *, list_position(sizes, list_max(sizes)) AS place FROM fold WHERE k = last)").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT r, c, sizes[place] AS n, round(totals[place] / sizes[place], 4) AS depth FROM best WHERE sizes[place] >= 2")
def interval_cluster(s):
    return rounded(depth.interval_clusters(s.depth().select("r", "c", F.col("image_id").alias("source"), "depth"), 0.2), "depth")


@query()
def dense_fuse(s):
    return rounded(depth.fused(s.depth(), s.cameras(), _neighbor_pairs(s), 0.2), "x", "y", "z")


@query()
def sgm_disparity(s):
    """The pictures, and each beside itself two columns further."""
    pixels = s.pictures()
    moved = pixels.withColumns({"image_id": -1 - F.col("image_id"), "c": F.col("c") + 2})
    return stereo.matched(pixels.unionByName(moved), pixels.select(F.col("image_id").alias("ref_id"), (-1 - F.col("image_id")).alias("nb_id")).distinct(), -4, 5)


@query()
def patchmatch_depth(s):
    """The depths of the walls of every scene; the true one is 10 everywhere."""
    pixels, cameras, pairs, ranges = s.wall()
    return patchmatch.estimated_depth(pixels, cameras, pairs, ranges, tile=64)


@query()
def ordered_fusion(s):
    """The walls, every pixel's depth off by up to 0.8%, one in sixteen by more, and without one in seven."""
    pixels, cameras, pairs, _ = s.wall()
    h = F.pmod(F.xxhash64("image_id", "r", "c"), F.lit(1 << 20))
    off = F.when(h % 16 == 0, 0.6).otherwise(1 + ((h / 16).cast("long") % 161 - 80) / 10_000)
    rows = pixels.filter(h % 7 != 0).withColumns({"depth": 10 * off, "conf": F.lit(0.2) + (h % 5) / 10})
    return fusion.ordered_fusion(rows, cameras, pairs, colours=("grey",))


# the walls, each scene 20 above the one before it, in waves of a hundredth of their depth
_WAVES = """px AS (SELECT (vec_id // 48) * 3 + k AS image_id, vec_id % 48 AS r, w - 4 * k AS c FROM embeddings, (SELECT unnest(range(62)) AS w), (SELECT unnest(range(3)) AS k) WHERE len(embedding) = 64 AND w - 4 * k BETWEEN 0 AND 53),
dm AS (SELECT *, 10 * (1 + ((r * 7 + c * 13 + image_id) % 21 - 10) / 1000.0::DOUBLE) AS depth, (image_id % 3) * (4 * 10 / 60::DOUBLE) AS ox, ((image_id // 3) * 20)::DOUBLE AS oy FROM px),
spot AS (SELECT image_id, ox, oy, (c - 26.5) * depth / 60 + ox AS x, (r - 23.5) * depth / 60 + oy AS y, depth AS z FROM dm),
span AS (SELECT image_id, ox, oy, unnest(range(floor((x-2)/4)::BIGINT, floor((x+2)/4)::BIGINT + 1)) AS bx, floor((y-2)/4)::BIGINT AS y0, floor((y+2)/4)::BIGINT AS y1, floor((z-2)/4)::BIGINT AS z0, floor((z+2)/4)::BIGINT AS z1 FROM spot),
span2 AS (SELECT image_id, ox, oy, bx, unnest(range(y0, y1 + 1)) AS \"by\", z0, z1 FROM span), blk AS (SELECT DISTINCT image_id, ox, oy, bx, \"by\", unnest(range(z0, z1 + 1)) AS bz FROM span2),
vox AS (SELECT image_id, ox, oy, bx*8 + i AS vx, \"by\"*8 + j AS vy, bz*8 + l AS vz FROM blk, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j), (SELECT unnest(range(8)) AS l)),
shot AS (SELECT image_id, vx, vy, vz, (vz + 0.5) * 0.5 AS z, floor(23.5 + 60 * ((vy + 0.5) * 0.5 - oy) / ((vz + 0.5) * 0.5) + 0.5) AS r, floor(26.5 + 60 * ((vx + 0.5) * 0.5 - ox) / ((vz + 0.5) * 0.5) + 0.5) AS c FROM vox WHERE vz + 0.5 > 0)""".replace("\\", "")


def _waves(s: Scene) -> tuple[DataFrame, DataFrame]:
    pixels, cameras, _, _ = s.wall()
    wave = (F.col("r") * 7 + F.col("c") * 13 + F.col("image_id")) % 21 - 10
    return pixels.select("image_id", "r", "c", (10 * (1 + wave / 1000)).alias("depth")), cameras.withColumn("cy", (F.floor(F.col("image_id") / 3) * 20).cast("double"))


@query("WITH " + _WAVES + """, p AS (SELECT image_id AS ref_id, r, c, x, y, z, k + (image_id // 3) * 3 AS nb_id, (k % 3) * (4 * 10 / 60::DOUBLE) AS cx, oy FROM (SELECT *, (c - 26.5) * depth / 60 + ox AS x, (r - 23.5) * depth / 60 + oy AS y, depth AS z FROM dm), (SELECT unnest(range(3)) AS k) WHERE k <> image_id % 3),
hit AS (SELECT ref_id, r, c, nb_id, z, floor(23.5 + 60 * (y - oy) / z + 0.5)::BIGINT AS r2, floor(26.5 + 60 * (x - cx) / z + 0.5)::BIGINT AS c2 FROM p)
SELECT ref_id, h.r, h.c, nb_id, r2, c2, abs(z - depth) / z < 0.01 AS agrees FROM hit h JOIN dm d ON d.image_id = nb_id AND d.r = r2 AND d.c = c2""")
def reproject_waves(s):
    """Every image's pixels in the two others of its scene; the greatest depths differ by a fiftieth."""
    depth_, cameras = _waves(s)
    found = depth.reprojected(depth_.withColumn("conf", F.lit(1.0)), cameras, s.wall()[2])
    return found.select("ref_id", "r", "c", "nb_id", "r2", "c2", "agrees")


@query("WITH " + _WAVES + " SELECT vx, vy, vz, round(avg(least(1.0, (depth - z) / 2)), 4) AS value, count(*) AS weight FROM shot JOIN dm USING (image_id, r, c) WHERE depth - z > -2 GROUP BY 1, 2, 3")
def tsdf_voxels(s):
    return rounded(volume.integrated(*_waves(s), 0.5), "value")


@query()
def tsdf_mesh(s):
    """The faces of the walls' surface, with their corners."""
    vertices, faces = volume.mesh_of(*_waves(s), 0.5)
    return mesh.with_corners(faces, vertices)


# a region of five or more pixels has five within four steps of each
@query(with_("depth", "px AS (SELECT image_id * 4096 + r * 64 + c AS node, * FROM depth)",
    "near AS (SELECT x.node AS a, y.node AS b FROM px x JOIN px y ON x.image_id = y.image_id AND abs(x.r - y.r) + abs(x.c - y.c) = 1 WHERE abs(x.depth - y.depth) / x.depth < 0.3)",
    "link AS (SELECT a, b FROM near UNION SELECT b, a FROM near)", "reach AS (SELECT node AS a, node AS b, 0 AS steps FROM px UNION SELECT reach.a, link.b, steps + 1 FROM reach JOIN link ON link.a = reach.b WHERE steps < 4)",
    "small AS (SELECT a FROM reach GROUP BY a HAVING count(DISTINCT b) < 5)").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT image_id, r, c FROM px JOIN small ON a = node")
def speckle_pixels(s):
    return depth.speckles(s.depth(), 0.3, 5)


@query(with_("depth cam") + "SELECT image_id, r, c, round((c-px)*depth/f + cx, 4) AS x, round((r-py)*depth/f + cy, 4) AS y, round(depth, 4) AS z FROM depth JOIN cam USING (image_id) WHERE conf >= 0.8")
def merge_depth_maps(s):
    return rounded(depth.back_projected(depth.confident(s.depth(), 0.8), s.cameras()).drop("weight"), "x", "y", "z")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (x/2 - 0.5) * CASE WHEN a < b THEN 1 ELSE -1 END END, 4) AS linear, round(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (x/(x+1) - 0.5) * CASE WHEN a < b THEN 1 ELSE -1 END END, 4) AS parabola FROM (SELECT *, least(a, b) / nullif(greatest(a, b), 0) AS x FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax * 600 AS b FROM lineitem))")
def subpixel_disparity(s):
    zero, a, b = F.lit(0.0), F.col("l_quantity"), F.col("l_tax") * 600
    return rounded(s.table("lineitem").select("l_orderkey", "l_linenumber", g.sub_pixel("linear", a, zero, b).alias("linear"), g.sub_pixel("parabola", a, zero, b).alias("parabola")), "linear", "parabola")


_N = "n AS (SELECT s_suppkey, s_acctbal / 1000 AS r FROM supplier)"


@query(f"WITH {_N} SELECT s_suppkey, round(r/(sqrt(abs(r)) + 1e-12), 4) AS l1, round(r*exp(-r*r/2), 4) AS exponential, round(-ln(exp(-r*r) + exp(-1.0::DOUBLE)), 4) AS blake_zisserman, round(CASE WHEN abs(r) <= 1 THEN r ELSE sign(r)*sqrt(2*abs(r) - 1) END, 4) AS huber, round(sqrt(2*(sqrt(1 + r*r) - 1)), 4) AS pseudo_huber, round(r*sqrt(1/(1 + r*r)), 4) AS geman_mcclure, round(sqrt(ln(1 + r*r)), 4) AS cauchy, round(CASE WHEN abs(r) < 1 THEN sqrt((1 - power(1 - r*r, 3))/6) ELSE sqrt(1/6.0::DOUBLE) END, 4) AS tukey FROM n")
def robust_norms(s):
    kinds = ("l1", "exponential", "blake_zisserman", "huber", "pseudo_huber", "geman_mcclure", "cauchy", "tukey")
    return rounded(s.table("supplier").select("s_suppkey", *[g.robust_norm(k, F.col("s_acctbal") / 1000).alias(k) for k in kinds]), *kinds)


# ---- meshes

_HALF = "he AS (SELECT f_id, a AS src, b AS dst FROM fc UNION ALL SELECT f_id, b, c FROM fc UNION ALL SELECT f_id, c, a FROM fc)"
_EDGE = "edge AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, count(*) AS faces FROM he GROUP BY 1, 2)"
_NB = "nb AS (SELECT lo AS v_id, hi AS nb_id FROM edge UNION ALL SELECT hi, lo FROM edge)"
_TRI = "tri AS (SELECT f_id, a, b, c, p.x AS ax, p.y AS ay, p.z AS az, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, w.x - p.x AS vx, w.y - p.y AS vy, w.z - p.z AS vz FROM fc JOIN v p ON p.v_id = a JOIN v q ON q.v_id = b JOIN v w ON w.v_id = c)"
_NORMAL = "nor AS (SELECT *, uy*vz - uz*vy AS nx, uz*vx - ux*vz AS ny, ux*vy - uy*vx AS nz FROM tri)"


@query(with_("cell fc", _HALF, _EDGE) + "SELECT lo, hi, faces FROM edge")
def mesh_edges(s):
    return mesh.edges(s.faces())


@query(with_("cell fc", _HALF, _EDGE, _NB) + "SELECT v_id, count(*) AS degree FROM nb GROUP BY 1")
def vertex_degree(s):
    return mesh.vertex_degrees(s.faces())


@query(with_("cell fc", _HALF, _EDGE) + "SELECT lo AS v_id FROM edge WHERE faces = 1 UNION SELECT hi FROM edge WHERE faces = 1")
def boundary_vertices(s):
    return mesh.boundary_vertices(s.faces())


@query(with_("cell fc", _HALF, _EDGE) + "SELECT count(*) FILTER (faces <> 2) AS open_edges, bool_and(faces = 2) AS watertight FROM edge")
def watertight(s):
    return mesh.watertight(s.faces())


@query(with_("cell fc", _HALF) + "SELECT DISTINCT x.f_id, y.f_id AS nb_id FROM he x JOIN he y ON least(x.src, x.dst) = least(y.src, y.dst) AND greatest(x.src, x.dst) = greatest(y.src, y.dst) AND x.f_id <> y.f_id")
def face_faces(s):
    return mesh.face_neighbors(s.faces())


@query(with_("v cell fc", _TRI, _NORMAL) + "SELECT f_id, round(sqrt(nx*nx+ny*ny+nz*nz)/2, 4) AS area, round(nx/sqrt(nx*nx+ny*ny+nz*nz), 4) + 0.0 AS nx, round(ny/sqrt(nx*nx+ny*ny+nz*nz), 4) + 0.0 AS ny, round(nz/sqrt(nx*nx+ny*ny+nz*nz), 4) + 0.0 AS nz FROM nor")
def face_area(s):
    return rounded(mesh.face_measures(s.faces(), s.vertices()).drop("quality"), "area", "nx", "ny", "nz")


@query(with_("v cell fc", _TRI, _NORMAL) + "SELECT round(sum(sqrt(nx*nx+ny*ny+nz*nz)/2), 4) AS area, round(sum((ax*nx + ay*ny + az*nz)/6), 4) AS volume FROM nor")
def mesh_area_volume(s):
    return rounded(mesh.area_and_volume(s.faces(), s.vertices()), "area", "volume")


@query(with_("v cell fc", _TRI) + "SELECT f_id, round(ax + (ux + vx)/3, 4) AS x, round(ay + (uy + vy)/3, 4) AS y, round(az + (uz + vz)/3, 4) AS z FROM tri")
def face_centroids(s):
    return rounded(mesh.centroids(s.faces(), s.vertices()), "x", "y", "z")


@query(with_("v cell fc", _HALF, _EDGE) + "SELECT round(sqrt(median(power(p.x-q.x, 2) + power(p.y-q.y, 2) + power(p.z-q.z, 2))), 4) AS sigma FROM edge JOIN v p ON p.v_id = lo JOIN v q ON q.v_id = hi")
def edge_scale(s):
    return rounded(mesh.edge_scale(s.faces(), s.vertices()), "sigma")


@query(with_("depth") + "SELECT (r // 8) * 8 + c // 8 AS f_id, image_id, count(*) AS area, round(sum(conf), 4) AS quality, round(avg(r), 4) AS red, round(avg(c), 4) AS green, round(avg(depth), 4) AS blue FROM depth GROUP BY 1, 2")
def face_view_data(s):
    cell = (F.floor(F.col("r") / 8) * 8 + F.floor(F.col("c") / 8)).alias("f_id")
    rows = mesh.face_views(s.depth().select(cell, "image_id", F.col("conf").alias("quality"), F.col("r").alias("red"), F.col("c").alias("green"), F.col("depth").alias("blue")))
    return rounded(rows, "quality", "red", "green", "blue")


_VIEWED = "seen AS (SELECT l_partkey AS f_id, l_suppkey AS image_id, max(l_quantity) AS quality FROM lineitem GROUP BY 1, 2), top AS (SELECT f_id, max(quality) AS top FROM seen GROUP BY 1), dir AS (SELECT nor.f_id, image_id, quality / top AS share, nx, ny, nz, cx - ax - (ux + vx)/3 AS dx, cy - ay - (uy + vy)/3 AS dy, cz - az - (uz + vz)/3 AS dz FROM nor JOIN seen USING (f_id) JOIN top USING (f_id) JOIN cam USING (image_id)), sc AS (SELECT f_id, image_id, round_even(0.67*(dx*nx + dy*ny + dz*nz) / sqrt((dx*dx + dy*dy + dz*dz) * (nx*nx + ny*ny + nz*nz)) + 0.33*share, 9) AS score FROM dir), k AS (SELECT *, row_number() OVER (PARTITION BY f_id ORDER BY score DESC, image_id) AS rank FROM sc)"


@query(with_("v cell fc cam", _TRI, _NORMAL, _VIEWED) + "SELECT f_id, image_id, rank, round(score, 4) AS score FROM k WHERE rank <= 3")
def face_best_views(s):
    seen = s.table("lineitem").groupBy(F.col("l_partkey").alias("f_id"), F.col("l_suppkey").alias("image_id")).agg(F.max("l_quantity").alias("quality"))
    return rounded(mesh.best_views(s.faces(), s.vertices(), seen, s.cameras(), 3), "score")


@query(with_("v cell fc", _TRI, _NORMAL, "vn AS (SELECT v_id, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM (SELECT a AS v_id, nx, ny, nz FROM nor UNION ALL SELECT b, nx, ny, nz FROM nor UNION ALL SELECT c, nx, ny, nz FROM nor) GROUP BY 1)") + "SELECT v_id, round(x/sqrt(x*x+y*y+z*z), 4) + 0.0 AS nx, round(y/sqrt(x*x+y*y+z*z), 4) + 0.0 AS ny, round(z/sqrt(x*x+y*y+z*z), 4) + 0.0 AS nz FROM vn")
def vertex_normals(s):
    return rounded(mesh.vertex_normals(s.faces(), s.vertices()), "nx", "ny", "nz")


_LAP = """edgy AS (SELECT lo AS v_id FROM edge WHERE faces = 1 UNION SELECT hi FROM edge WHERE faces = 1),
deg AS (SELECT v_id, count(*) AS n FROM nb GROUP BY 1),
mean1 AS (SELECT nb.v_id, avg(o.x) AS x, avg(o.y) AS y, avg(o.z) AS z, avg(1.0::DOUBLE / deg.n) AS w FROM nb JOIN v o ON o.v_id = nb_id JOIN deg ON deg.v_id = nb_id WHERE nb.v_id NOT IN (SELECT v_id FROM edgy) GROUP BY 1),
lap AS (SELECT v.v_id, coalesce(m.x - v.x, 0) AS x, coalesce(m.y - v.y, 0) AS y, coalesce(m.z - v.z, 0) AS z, w FROM v LEFT JOIN mean1 m USING (v_id)),
mean2 AS (SELECT nb.v_id, avg(o.x) AS x, avg(o.y) AS y, avg(o.z) AS z FROM nb JOIN lap o ON o.v_id = nb_id GROUP BY 1)"""


@query(with_("v cell fc", _HALF, _EDGE, _NB, _LAP) + "SELECT v_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z FROM lap")
def laplacian1(s):
    return rounded(mesh.laplacian(s.vertices(), s.faces()), "x", "y", "z")


@query(with_("v cell fc", _HALF, _EDGE, _NB, _LAP) + "SELECT lap.v_id, round(coalesce((m.x - lap.x)/(1 + w), 0), 4) + 0.0 AS x, round(coalesce((m.y - lap.y)/(1 + w), 0), 4) + 0.0 AS y, round(coalesce((m.z - lap.z)/(1 + w), 0), 4) + 0.0 AS z FROM lap LEFT JOIN mean2 m USING (v_id)")
def laplacian2(s):
    return rounded(mesh.laplacian_2(mesh.laplacian(s.vertices(), s.faces()), s.faces()), "x", "y", "z")


@query(with_("v cell fc", _HALF, "sides AS (SELECT f_id, x2 - x1 AS ux, y2 - y1 AS uy, z2 - z1 AS uz, x3 - x1 AS wx, y3 - y1 AS wy, z3 - z1 AS wz FROM fc JOIN (SELECT v_id AS a, x AS x1, y AS y1, z AS z1 FROM v) USING (a) JOIN (SELECT v_id AS b, x AS x2, y AS y2, z AS z2 FROM v) USING (b) JOIN (SELECT v_id AS c, x AS x3, y AS y3, z AS z3 FROM v) USING (c))",
    "big AS (SELECT f_id FROM sides WHERE sqrt(power(uy*wz - uz*wy, 2) + power(uz*wx - ux*wz, 2) + power(ux*wy - uy*wx, 2)) / 2 > 10)",
    "cut AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM he JOIN big USING (f_id))",
    "mid AS (SELECT lo, hi, row_number() OVER (ORDER BY lo, hi) + (SELECT max(v_id) FROM v) AS m FROM cut)",
    "split AS (SELECT fc.*, p.m AS ab, q.m AS bc, t.m AS ca FROM fc LEFT JOIN mid p ON p.lo = least(a, b) AND p.hi = greatest(a, b) LEFT JOIN mid q ON q.lo = least(b, c) AND q.hi = greatest(b, c) LEFT JOIN mid t ON t.lo = least(c, a) AND t.hi = greatest(c, a))",
    """parts AS (SELECT f_id, CASE WHEN ab + bc + ca IS NOT NULL THEN [[a, ab, ca], [ab, b, bc], [ca, bc, c], [ab, bc, ca]]
  WHEN ab + bc IS NOT NULL THEN [[ab, b, bc], [a, ab, bc], [a, bc, c]] WHEN bc + ca IS NOT NULL THEN [[bc, c, ca], [b, bc, ca], [b, ca, a]] WHEN ca + ab IS NOT NULL THEN [[ca, a, ab], [c, ca, ab], [c, ab, b]]
  WHEN ab IS NOT NULL THEN [[a, ab, c], [ab, b, c]] WHEN bc IS NOT NULL THEN [[b, bc, a], [bc, c, a]] WHEN ca IS NOT NULL THEN [[c, ca, b], [ca, a, b]] ELSE [[a, b, c]] END AS tri FROM split)""",
    "each AS (SELECT f_id, tri, unnest(range(len(tri))) AS part FROM parts)") + "SELECT f_id, part::INT AS part, tri[part + 1][1] AS a, tri[part + 1][2] AS b, tri[part + 1][3] AS c FROM each")
def subdivide_faces(s):
    return mesh.subdivided(s.faces(), s.vertices(), 5.0)[1]


_FLAT = "flat AS (SELECT v_id, floor(x/2) AS x, floor(y/2) AS y, 0::DOUBLE AS z FROM v)"


@query(with_("v", _FLAT) + "SELECT v_id, min(v_id) OVER (PARTITION BY x, y, z) AS kept_id FROM flat")
def dup_vertices(s):
    return mesh.duplicate_vertices(s.vertices().select("v_id", *[F.floor(F.col(c) / 2).alias(c) for c in "xy"], F.lit(0.0).alias("z")))


@query(with_("v cell fc") + "SELECT v_id FROM v WHERE v_id NOT IN (SELECT a FROM fc UNION SELECT b FROM fc UNION SELECT c FROM fc)")
def unref_vertices(s):
    return mesh.unreferenced(s.vertices(), s.faces())


@query(with_("v cell fc", _TRI, _NORMAL) + "SELECT f_id FROM nor WHERE sqrt(nx*nx+ny*ny+nz*nz)/2 <= 0.75")
def degenerate_faces(s):
    return mesh.degenerate_faces(s.faces(), s.vertices(), 0.75)


_BOXED = "outside AS (SELECT v_id FROM v WHERE NOT (x BETWEEN 2 AND 15 AND y BETWEEN 1 AND 60 AND z BETWEEN 3 AND 50)), kept AS (SELECT * FROM fc WHERE a NOT IN (FROM outside) AND b NOT IN (FROM outside) AND c NOT IN (FROM outside)), ids AS (SELECT v_id, row_number() OVER (ORDER BY v_id) - 1 AS new_id FROM (SELECT a AS v_id FROM kept UNION SELECT b FROM kept UNION SELECT c FROM kept))"


@query(with_("v cell fc", _BOXED) + "SELECT f_id, p.new_id AS a, q.new_id AS b, w.new_id AS c FROM kept JOIN ids p ON p.v_id = a JOIN ids q ON q.v_id = b JOIN ids w ON w.v_id = c")
def faces_in_box(s):
    return mesh.inside_box(s.vertices(), s.faces(), (2.0, 1.0, 3.0), (15.0, 60.0, 50.0))[1]


@query(with_("cell fc") + "SELECT f_id, a, b, c FROM fc UNION ALL SELECT f_id + (SELECT max(f_id) + 1 FROM fc), a + (SELECT max(p_partkey) + 1 FROM part), b + (SELECT max(p_partkey) + 1 FROM part), c + (SELECT max(p_partkey) + 1 FROM part) FROM fc")
def join_meshes(s):
    return mesh.joined(s.vertices(), s.faces(), s.vertices(), s.faces())[1]


def _labels(s: Scene) -> DataFrame:
    return s.faces().select("f_id", (F.floor(F.col("f_id") / 10) % 3).alias("label"))


_LABEL = "lab AS (SELECT f_id, (f_id // 10) % 3 AS label FROM fc)"


@query(with_("cell fc", _HALF, _LABEL, "sides AS (SELECT he.f_id, least(src,dst) AS lo, greatest(src,dst) AS hi, label FROM he JOIN lab USING (f_id))") + "SELECT lo AS v_id FROM sides GROUP BY lo, hi HAVING min(label) <> max(label) UNION SELECT hi FROM sides GROUP BY lo, hi HAVING min(label) <> max(label)")
def seam_vertices(s):
    return mesh.seam_vertices(s.faces(), _labels(s))


@query("WITH RECURSIVE " + with_("cell fc", _HALF, _LABEL, "sides AS (SELECT he.f_id, least(src,dst) AS lo, greatest(src,dst) AS hi, label FROM he JOIN lab USING (f_id))", "link AS (SELECT x.f_id AS a, y.f_id AS b FROM sides x JOIN sides y USING (lo, hi, label) WHERE x.f_id <> y.f_id)", "reach AS (SELECT f_id AS a, f_id AS b FROM fc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)")[5:] + "SELECT a AS f_id, min(b) AS patch FROM reach GROUP BY 1")
def patch_components(s):
    return mesh.patches(s.faces(), _labels(s))


@query("WITH seen AS (SELECT l_partkey AS f_id, l_suppkey AS image_id, max(l_quantity) AS area FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY f_id ORDER BY area DESC, image_id) AS k FROM seen) SELECT f_id, area FROM k WHERE k = 2")
def face_pair_area(s):
    seen = s.table("lineitem").groupBy(F.col("l_partkey").alias("f_id"), F.col("l_suppkey").alias("image_id")).agg(F.max("l_quantity").alias("area"))
    return mesh.pair_areas(seen)


@query()
def surface_samples(s):
    return mesh.sampled(s.faces(), s.vertices(), 0.5)


@query()
def lbp_labels(s):
    faces = s.faces()
    costs = faces.select(F.col("f_id").alias("node"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("label")).withColumn("cost", ((F.col("node") * 7 + F.col("label") * 3) % 5).cast("double"))
    return iterate.belief_propagation(costs, mesh.face_neighbors(faces).select(F.col("f_id").alias("a"), F.col("nb_id").alias("b")), 0.7, 5)


# ---- scenes

_SIM = (2.0, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1.0, 2.0, 3.0))


@query(with_("pt") + "SELECT point_id, 2*(-y) + 1 AS x, 2*x + 2 AS y, 2*z + 3 AS z FROM pt")
def transform_apply(s):
    return scene.transformed(s.points(), *_SIM)


@query(with_("pt", "b AS (SELECT (min(x)+max(x))/2 AS mx, (min(y)+max(y))/2 AS my, (min(z)+max(z))/2 AS mz, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS side FROM pt)") + "SELECT point_id, round((x-mx)/side, 4) + 0.0 AS x, round((y-my)/side, 4) + 0.0 AS y, round((z-mz)/side, 4) + 0.0 AS z FROM pt, b")
def normalize_transform(s):
    return rounded(scene.normalised(s.points()), "x", "y", "z")


@query(with_("pt cam", "m AS (SELECT median(cx) AS mx, median(cy) AS my, median(cz) AS mz FROM cam)", "rad AS (SELECT max(sqrt((cx-mx)*(cx-mx)+(cy-my)*(cy-my)+(cz-mz)*(cz-mz))) AS radius FROM cam, m)", "near AS (SELECT x, y, z FROM pt, m, rad WHERE z - mz > 0 AND z - mz < 2*radius)") + "SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM near")
def roi_estimate(s):
    return scene.region_of_interest(s.points(), s.cameras())


@query(with_("pt", "c AS (SELECT floor(x/16)::BIGINT AS gx, floor(y/16)::BIGINT AS gy, count(*) AS n FROM pt GROUP BY 1, 2)", "run AS (SELECT *, sum(n) OVER (ORDER BY gy, gx) AS upto FROM c)") + "SELECT gx, gy, n, floor((upto - n) / 1000)::BIGINT AS chunk FROM run")
def split_cells(s):
    return scene.split_by_cells(s.points(), 16.0, 1000)


@query()
def similarity_recovered(s):
    return scene.similarity(s.points(), scene.transformed(s.points(), *_SIM).toDF("point_id", "x2", "y2", "z2"))


@query()
def ground_plane(s):
    return scene.plane(s.points().withColumn("z", 0.5 * F.col("x") + 0.25 * F.col("y") + 3.0))


@query()
def ransac_plane(s):
    """Every fourth point lies off the plane."""
    off = F.when(F.col("point_id") % 4 == 0, F.col("point_id") % 31 + 5.0).otherwise(0.0)
    return scene.robust_plane(s.points().withColumn("z", 0.5 * F.col("x") + 0.25 * F.col("y") + 3.0 + off), 0.01)


# every third face is missing, which leaves vertices with several fans
_FANS = """part_of AS (SELECT * FROM fc WHERE f_id % 3 <> 0),
co AS (SELECT 3*f_id AS node, f_id, 0 AS k, a AS v_id FROM part_of UNION ALL SELECT 3*f_id + 1, f_id, 1, b FROM part_of UNION ALL SELECT 3*f_id + 2, f_id, 2, c FROM part_of),
ed AS (SELECT p.f_id, least(p.v_id, q.v_id) AS lo, greatest(p.v_id, q.v_id) AS hi, CASE WHEN p.v_id < q.v_id THEN p.node ELSE q.node END AS nlo, CASE WHEN p.v_id < q.v_id THEN q.node ELSE p.node END AS nhi FROM co p JOIN co q ON p.f_id = q.f_id AND q.k = (p.k + 1) % 3),
two AS (SELECT min(nlo) AS x1, max(nlo) AS x2, min(nhi) AS y1, max(nhi) AS y2 FROM ed GROUP BY lo, hi HAVING count(*) = 2),
link AS (SELECT x1 AS a, x2 AS b FROM two UNION SELECT x2, x1 FROM two UNION SELECT y1, y2 FROM two UNION SELECT y2, y1 FROM two),
reach AS (SELECT node AS a, node AS b FROM co UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
fan AS (SELECT f_id, k, v_id, min(b) AS fan FROM co JOIN reach ON a = node GROUP BY 1, 2, 3),
grp AS (SELECT v_id, fan, row_number() OVER (PARTITION BY v_id ORDER BY fan) AS place FROM (SELECT DISTINCT v_id, fan FROM fan)),
extra AS (SELECT v_id, fan, (SELECT max(v_id) FROM v) + row_number() OVER (ORDER BY v_id, fan) AS id FROM grp WHERE place > 1),
named AS (SELECT f_id, k, coalesce(id, v_id) AS id FROM fan LEFT JOIN extra USING (v_id, fan))"""


@query(with_("v cell fc", _FANS).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT f_id, max(CASE k WHEN 0 THEN id END) AS a, max(CASE k WHEN 1 THEN id END) AS b, max(CASE k WHEN 2 THEN id END) AS c FROM named GROUP BY f_id")
def manifold_faces(s):
    return mesh.manifold(s.faces().filter("f_id % 3 <> 0"), s.vertices())[1]


# ---- what views show of faces: parts as faces, suppliers as images; every thirteenth line shows something else

_SHOWN = "r0 AS (SELECT *, count(*) OVER (PARTITION BY f_id) AS n FROM (SELECT l_partkey AS f_id, l_suppkey AS image_id, avg(100 + l_quantity + o)::DOUBLE AS red, avg(80 + l_extendedprice % 20 + o)::DOUBLE AS green, avg(60 + 100 * l_discount + o)::DOUBLE AS blue FROM (SELECT *, CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN 90 ELSE 0 END AS o FROM lineitem) GROUP BY 1, 2)), s0 AS (SELECT *, true AS inl, n > 4 AS open, n <= 4 AS every FROM r0)"


def _shown_rounds(rounds: int) -> str:
    """CTEs t<k> and s<k>: the rounds of texture.inlier_views."""
    ch = ("red", "green", "blue")
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    minor = lambda i, j: f"({c((i + 1) % 3, (j + 1) % 3)}*{c((i + 2) % 3, (j + 2) % 3)} - {c((i + 1) % 3, (j + 2) % 3)}*{c((i + 2) % 3, (j + 1) % 3)})"
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    form = " + ".join(f"({ch[i]}-m{i})*({ch[j]}-m{j})*{minor(i, j)}" for i in range(3) for j in range(3))
    det = f"{c(0, 0)}*{minor(0, 0)} + {c(0, 1)}*{minor(0, 1)} + {c(0, 2)}*{minor(0, 2)}"
    out = []
    for k in range(rounds):
        means = ", ".join(f"avg({ch[i]}) FILTER (inl) OVER w AS m{i}" for i in range(3))
        covs = ", ".join(f"covar_samp({ch[i]}, {ch[j]}) FILTER (inl) OVER w AS {c(i, j)}" for i, j in pairs)
        most = f"greatest({', '.join(f'abs({c(i, j)})' for i, j in pairs)})"
        out.append(f"""t{k} AS (SELECT *, {most} AS most, {det} AS det FROM (SELECT *, {means}, {covs} FROM s{k} WINDOW w AS (PARTITION BY f_id))),
u{k} AS (SELECT *, coalesce(most < 1e-3, false) AS flat, coalesce(abs(det) > 1e-12 * power(most, 3), false) AS fine FROM t{k}),
v{k} AS (SELECT *, CASE WHEN open AND NOT flat AND fine THEN exp(-0.5 * ({form}) / det) > 0.06 ELSE inl END AS new FROM u{k}),
x{k} AS (SELECT *, sum(new::INT) OVER w AS left_in, max((new <> inl)::INT) OVER w AS moved FROM v{k} WINDOW w AS (PARTITION BY f_id)),
s{k + 1} AS (SELECT f_id, image_id, red, green, blue, n, new AS inl, open AND NOT flat AND NOT (NOT fine OR left_in = n OR left_in < 4) AND moved = 1 AS open, every OR (open AND NOT flat AND (NOT fine OR left_in = n OR left_in < 4)) AS every FROM x{k})""")
    return ", ".join(out)


@query("WITH " + _SHOWN + ", " + _shown_rounds(10) + " SELECT f_id, image_id, round(red, 4) AS red FROM s10 WHERE inl OR every")
def face_inlier_views(s):
    o = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0, 90).otherwise(0)
    mean = lambda c, n: F.avg(c + o).cast("double").alias(n)
    views_ = s.table("lineitem").groupBy(F.col("l_partkey").alias("f_id"), F.col("l_suppkey").alias("image_id")).agg(mean(100 + F.col("l_quantity"), "red"), mean(80 + F.col("l_extendedprice") % 20, "green"), mean(60 + 100 * F.col("l_discount"), "blue"))
    return rounded(texture.inlier_views(views_).select("f_id", "image_id", "red"), "red")


# ---- what cameras see; small images, as SQL tries every face at every pixel

_CORNERS = "tri AS (SELECT f_id, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS \"by\", q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM fc JOIN v p ON p.v_id = a JOIN v q ON q.v_id = b JOIN v r ON r.v_id = c)"
_SMALL = "small AS (SELECT image_id, cx AS ox, cy AS oy, cz AS oz, f * 0.024 AS f, 11.5 AS px, 11.5 AS py, co, si FROM turn)"
_SPHERE = """ball AS (SELECT f_id, x, y, z, greatest(sqrt((ax-x)*(ax-x)+(ay-y)*(ay-y)+(az-z)*(az-z)), sqrt((bx-x)*(bx-x)+("by"-y)*("by"-y)+(bz-z)*(bz-z)), sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z))) * (1 + 1e-9) + 1e-12 AS radius
  FROM (SELECT *, (ax+bx+cx)/3 AS x, (ay+"by"+cy)/3 AS y, (az+bz+cz)/3 AS z FROM tri)),
eye AS (SELECT f_id, image_id, f, px, py, radius, co*(x-ox) - si*(y-oy) AS qx, si*(x-ox) + co*(y-oy) AS qy, z - oz AS qz FROM ball, small),
held AS (SELECT f_id, image_id FROM eye WHERE qz >= -radius AND qx*f + 12.0*qz >= -radius*sqrt(f*f + 144.0) AND 12.0*qz - qx*f >= -radius*sqrt(f*f + 144.0) AND qy*f + 12.0*qz >= -radius*sqrt(f*f + 144.0) AND 12.0*qz - qy*f >= -radius*sqrt(f*f + 144.0))"""
_RASTER = """shot AS (SELECT image_id, f_id, f, co*(ax-ox) - si*(ay-oy) AS ax, si*(ax-ox) + co*(ay-oy) AS ay, az-oz AS az, co*(bx-ox) - si*("by"-oy) AS bx, si*(bx-ox) + co*("by"-oy) AS "by", bz-oz AS bz, co*(cx-ox) - si*(cy-oy) AS cx, si*(cx-ox) + co*(cy-oy) AS cy, cz-oz AS cz FROM tri JOIN held USING (f_id) JOIN small USING (image_id)),
sides AS (SELECT *, ax*(\"by\"*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - \"by\"*cx) AS vol, \"by\"*cz - bz*cy AS n0x, bz*cx - bx*cz AS n0y, bx*cy - \"by\"*cx AS n0z, cy*az - cz*ay AS n1x, cz*ax - cx*az AS n1y, cx*ay - cy*ax AS n1z, ay*bz - az*\"by\" AS n2x, az*bx - ax*bz AS n2y, ax*\"by\" - ay*bx AS n2z FROM shot),
rays AS (SELECT s.*, r, c, n0x*(c-11.5)/f + n0y*(r-11.5)/f + n0z AS w0, n1x*(c-11.5)/f + n1y*(r-11.5)/f + n1z AS w1, n2x*(c-11.5)/f + n2y*(r-11.5)/f + n2z AS w2 FROM sides s, (SELECT unnest(range(24)) AS r), (SELECT unnest(range(24)) AS c) WHERE vol <> 0),
near_face AS (SELECT image_id, r, c, min(vol / (w0 + w1 + w2)) AS depth FROM rays WHERE least(w0*sign(vol), w1*sign(vol), w2*sign(vol)) >= -1e-9*abs(vol) AND w0 + w1 + w2 <> 0 AND vol / (w0 + w1 + w2) >= 1e-3 GROUP BY 1, 2, 3)""".replace("\\", "")


def _corners(s: Scene) -> DataFrame:
    return mesh.with_corners(s.faces(), s.vertices())


@query(with_("v cell fc turn", _CORNERS, _SMALL, _SPHERE) + "SELECT f_id, image_id FROM held")
def frustum_faces(s):
    return frustum.joined(frustum.face_spheres(_corners(s)), frustum.scaled(s.turned_cameras(), 24)).select(F.col("id").alias("f_id"), "image_id")


@query(with_("v cell fc turn", _CORNERS, _SMALL, _SPHERE, _RASTER) + "SELECT image_id, r, c, round(depth, 9) AS depth FROM near_face")
def mesh_depth_maps(s):
    return rounded(frustum.rasterised(_corners(s), frustum.scaled(s.turned_cameras(), 24)).drop("f_id"), "depth", to=9)


@query(with_("v cell fc turn", _CORNERS, _SMALL, _SPHERE, _RASTER, """spot AS (SELECT v_id, image_id, 11.5 + f*qx/qz AS u, 11.5 + f*qy/qz AS w, qz FROM (SELECT v_id, image_id, f, co*(x-ox) - si*(y-oy) AS qx, si*(x-ox) + co*(y-oy) AS qy, z - oz AS qz FROM v, small) WHERE qz > 0),
views AS (SELECT v_id, spot.image_id FROM spot JOIN near_face n ON n.image_id = spot.image_id AND n.r = floor(w + 0.5) AND n.c = floor(u + 0.5) WHERE u >= 1 AND w >= 1 AND u < 23 AND w < 23 AND qz * 0.985 < depth)""") + "SELECT v_id, image_id FROM views WHERE v_id IN (SELECT v_id FROM views GROUP BY 1 HAVING count(*) >= 2)")
def mesh_vertex_views(s):
    return frustum.vertex_views(_corners(s), s.vertices(), s.turned_cameras(), side=24)


# a ray from above each vertex, and a point near it
_RAYS = "rays AS (SELECT v_id AS ray_id, 0.93*x + 0.37 AS ox, 0.9*y + 0.21 AS oy, 60.0::DOUBLE AS oz, 0.1*(v_id % 5 - 2) AS dx, 0.07*(v_id % 3 - 1) AS dy, -1.0::DOUBLE AS dz FROM v)"
_HIT = """e AS (SELECT f_id, ax, ay, az, bx-ax AS e1x, "by"-ay AS e1y, bz-az AS e1z, cx-ax AS e2x, cy-ay AS e2y, cz-az AS e2z FROM tri),
n AS (SELECT *, dy*e2z - dz*e2y AS nx, dz*e2x - dx*e2z AS ny, dx*e2y - dy*e2x AS nz, ox-ax AS sx, oy-ay AS sy, oz-az AS sz FROM rays, e),
m AS (SELECT *, e1x*nx + e1y*ny + e1z*nz AS det, sy*e1z - sz*e1y AS mx, sz*e1x - sx*e1z AS my, sx*e1y - sy*e1x AS mz FROM n),
hit AS (SELECT ray_id, f_id, (e2x*mx + e2y*my + e2z*mz)/det AS t FROM m WHERE det <> 0 AND (sx*nx + sy*ny + sz*nz)/det >= -1e-9 AND (dx*mx + dy*my + dz*mz)/det >= -1e-9 AND (sx*nx + sy*ny + sz*nz + dx*mx + dy*my + dz*mz)/det <= 1 + 1e-9 AND (e2x*mx + e2y*my + e2z*mz)/det >= 0),
first_hit AS (SELECT ray_id, min({'k': floor(t / 1e-9 + 0.5), 'f_id': f_id, 't': t}) AS h FROM hit GROUP BY ray_id)"""


def _segment(i: str, j: str) -> str:
    """The squared distance of (x, y, z) and the edge from corner i to corner j."""
    d = {c: f'("{j}{c}" - "{i}{c}")' for c in "xyz"}
    q = {c: f'({c} - "{i}{c}")' for c in "xyz"}
    t = "greatest(0.0, least(1.0, coalesce(" + f"({' + '.join(q[c] + '*' + d[c] for c in 'xyz')}) / nullif({' + '.join(d[c] + '*' + d[c] for c in 'xyz')}, 0), 0.0)))"
    return " + ".join(f"power({q[c]} - {t}*{d[c]}, 2)" for c in "xyz")


def _side(i: str, j: str) -> str:
    """Whether (x, y, z) is on the inner side of the edge from corner i to corner j."""
    d, q = {c: f'("{j}{c}" - "{i}{c}")' for c in "xyz"}, {c: f'({c} - "{i}{c}")' for c in "xyz"}
    return f"nx*({d['y']}*{q['z']} - {d['z']}*{q['y']}) + ny*({d['z']}*{q['x']} - {d['x']}*{q['z']}) + nz*({d['x']}*{q['y']} - {d['y']}*{q['x']}) >= 0"


_NEAR = f"""spots AS (SELECT v_id AS id, 0.93*x + 0.37 AS x, 0.9*y + 0.21 AS y, z + v_id % 7 - 3.0 AS z FROM v),
flat AS (SELECT *, ("by"-ay)*(cz-az) - (bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay) - ("by"-ay)*(cx-ax) AS nz FROM tri),
apart AS (SELECT id, f_id, sqrt(CASE WHEN {_side('a', 'b')} AND {_side('b', 'c')} AND {_side('c', 'a')} AND nx*nx + ny*ny + nz*nz > 0
  THEN power(nx*(x-ax) + ny*(y-ay) + nz*(z-az), 2) / (nx*nx + ny*ny + nz*nz) ELSE least({_segment('a', 'b')}, {_segment('b', 'c')}, {_segment('c', 'a')}) END) AS d FROM spots, flat),
closest AS (SELECT id, min({{'k': floor(d / 1e-9 + 0.5), 'f_id': f_id, 'd': d}}) AS m FROM apart GROUP BY id)"""


@query(with_("v cell fc", _CORNERS, _RAYS, _HIT) + "SELECT ray_id, h.f_id AS f_id, round(h.t, 9) AS t FROM first_hit")
def nearest_hit(s):
    v = s.vertices()
    k = F.col("v_id")
    origin = [(0.93 * F.col("x") + 0.37).alias("ox"), (0.9 * F.col("y") + 0.21).alias("oy"), F.lit(60.0).alias("oz")]
    rays = v.select(k.alias("ray_id"), *origin, (0.1 * (k % 5 - 2)).alias("dx"), (0.07 * (k % 3 - 1)).alias("dy"), F.lit(-1.0).alias("dz"))
    return rounded(hits.nearest_hits(rays, _corners(s), 4.0), "t", to=9)


@query(with_("v cell fc", _CORNERS, _NEAR) + "SELECT id, round(m.d, 9) AS distance FROM closest")
def nearest_surface(s):
    k = F.col("v_id")
    spots = s.vertices().select(k.alias("id"), (0.93 * F.col("x") + 0.37).alias("x"), (0.9 * F.col("y") + 0.21).alias("y"), (F.col("z") + k % 7 - 3.0).alias("z"))
    return rounded(hits.nearest_faces(spots, _corners(s), 4.0).drop("f_id"), "distance", to=9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Scene(spark, folder))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["SQL", "oracle_sql", "queries"]
