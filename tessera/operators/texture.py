"""What views show of faces: views whose colour doesn't fit the others', as rounds of window aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least value of the Gaussian for an inlier, rounds, least inliers, covariances below which all colours are one.
LEAST_GAUSS, ROUNDS, LEAST_INLIERS, LEAST_COVARIANCE = 6e-2, 10, 4, 1e-3
#: A covariance is singular whose determinant is no more than this part of the cube of its greatest entry.
SINGULAR = 1e-12
CHANNELS = ("red", "green", "blue")


def _gauss(at: list[Column], mean: list[Column], cov: dict[tuple[int, int], Column], det: Column) -> Column:
    """exp(-1/2 d' C^-1 d), by the adjugate of the symmetric C."""
    d = [x - m for x, m in zip(at, mean, strict=True)]
    entry = lambda i, j: cov[min(i, j), max(i, j)]
    minor = lambda i, j: entry((i + 1) % 3, (j + 1) % 3) * entry((i + 2) % 3, (j + 2) % 3) - entry((i + 1) % 3, (j + 2) % 3) * entry((i + 2) % 3, (j + 1) % 3)
    return F.exp(-0.5 * sum((d[i] * d[j] * minor(i, j) for i in range(3) for j in range(3)), F.lit(0.0)) / det)


def inlier_views(views: DataFrame, least_gauss: float = LEAST_GAUSS, rounds: int = ROUNDS, least_inliers: int = LEAST_INLIERS) -> DataFrame:
    """The rows of views(f_id, image_id, red, green, blue, ...) whose colour fits those of the face's other views: in rounds,
    a Gaussian is laid through the inliers' colours, and those of all views are inliers where it is more than
    `least_gauss`, until none changes. All views of a face stay if it has no more than `least_inliers`, if fewer would be
    left, if all fit, or if its colours have no spread in some direction of the three; where they have none in any, the
    inliers so far stay.

    All rounds take one shuffle, by face: a face's views are the images that see it. A face stops on its own. A view with
    a null colour is out."""
    rows = views.dropna(subset=["f_id", *CHANNELS]).withColumns({"_in": F.lit(True), "_open": F.lit(True), "_all": F.lit(False)})
    face = Window.partitionBy("f_id")
    at = [F.col(c).cast("double") for c in CHANNELS]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(face))
    rows = rows.withColumns({"_open": F.col("_n") > least_inliers, "_all": F.col("_n") <= least_inliers})
    for _ in range(rounds):
        inner = [F.when(F.col("_in"), x) for x in at]
        rows = rows.withColumns({f"_m{i}": F.avg(inner[i]).over(face) for i in range(3)} | {f"_c{i}{j}": F.covar_samp(inner[i], inner[j]).over(face) for i, j in pairs})
        cov = {(i, j): F.col(f"_c{i}{j}") for i, j in pairs}
        det = cov[0, 0] * (cov[1, 1] * cov[2, 2] - cov[1, 2] * cov[1, 2]) - cov[0, 1] * (cov[0, 1] * cov[2, 2] - cov[1, 2] * cov[0, 2]) + cov[0, 2] * (cov[0, 1] * cov[1, 2] - cov[1, 1] * cov[0, 2])
        rows = rows.withColumns({"_most": F.greatest(*[F.abs(c) for c in cov.values()]), "_det": det})
        flat, fine = F.col("_most") < LEAST_COVARIANCE, F.abs("_det") > SINGULAR * F.pow("_most", F.lit(3.0))
        value = F.when(F.col("_open") & ~flat & fine, _gauss(at, [F.col(f"_m{i}") for i in range(3)], cov, F.col("_det")) > least_gauss)
        rows = rows.withColumn("_new", F.coalesce(value, F.col("_in")))
        rows = rows.withColumns({"_left": F.sum(F.col("_new").cast("int")).over(face), "_moved": F.max((F.col("_new") != F.col("_in")).cast("int")).over(face)})
        every = F.col("_open") & ~flat & (~fine | (F.col("_left") == F.col("_n")) | (F.col("_left") < least_inliers))
        rows = rows.withColumns({"_all": F.col("_all") | every, "_in": F.col("_new"), "_open": F.col("_open") & ~flat & ~every & (F.col("_moved") == 1)})
        rows = rows.select(*views.columns, "_in", "_open", "_all", "_n")
    return rows.filter("_in or _all").select(*views.columns)
