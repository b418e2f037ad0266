"""Semi-global matching of rectified image pairs over pixel tables, a pair per task at a time.

Images are rows (image_id, r, c, red, green, blue), 0 to 255, of any pixels; a window with a pixel that is not there has
the greatest cost. A pair takes memory in proportion to its pixels times the disparities tried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Half a matching window, and the greatest cost of a pixel.
HALF, MOST = 3, 255
#: Spread of colour and space in a window's weights, noise, penalties of small and large steps, and by how
#: much the latter rises between pixels of like grey.
COLOUR, SPACE, NOISE, SMALL_STEP, LARGE_STEP, RISE, FALL = 0.3 * 255, 0.4 * 7, 1e-3, 3, 4, 14, 38
#: Paths: one line back, so many pixels aside; each is walked both ways, the last of each pair along the rows.
PATHS = ((1, 0), (0, 1), (1, 1), (1, -1))

SCHEMA = "ref_id long, nb_id long, r int, c int, disp int, cost int"


def large_step(grey_step: np.ndarray) -> np.ndarray:
    """Penalty of a step of more than one disparity between pixels whose grey, 0 to 1, differs by so much."""
    step = np.rint(255 * np.abs(np.nan_to_num(grey_step)))
    return np.rint(LARGE_STEP * (1 + RISE * np.exp(-(step**2) / (2 * FALL**2)))).astype(np.int64)


def grey_of(colours: np.ndarray) -> np.ndarray:
    return colours @ np.array([0.299, 0.587, 0.114]) / 255


def _shifted(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The image read so many rows and columns further; nan outside."""
    out = np.full_like(image, np.nan)
    h, w = image.shape[:2]
    if abs(rows) < h and abs(columns) < w:
        out[max(0, -rows) : h - max(0, rows), max(0, -columns) : w - max(0, columns)] = image[max(0, rows) : h + min(0, rows), max(0, columns) : w + min(0, columns)]
    return out


def pixel_costs(left: np.ndarray, right: np.ndarray, low: int, high: int) -> np.ndarray:
    """(row, column, disparity - low): (1 - correlation) * 255 of the windows about (r, c) on the left and (r, c + d) on
    the right, of images (row, column, colour), weighted by likeness to the centre and nearness; d in [low, high)."""
    grey, other = grey_of(left), grey_of(right)
    places = [(i, j) for i in range(-HALF, HALF + 1) for j in range(-HALF, HALF + 1)]
    texel = np.stack([_shifted(grey, i, j) for i, j in places])
    weight = np.stack([np.exp(-((_shifted(left, i, j) - left) ** 2).sum(axis=2) / (2 * COLOUR**2) - (i * i + j * j) / (2 * SPACE**2)) for i, j in places])
    total = weight.sum(axis=0)
    centred = texel - (weight * texel).sum(axis=0) / total
    variance = (weight * centred**2).sum(axis=0)
    weighted = weight * centred
    costs = np.empty((*grey.shape, high - low), dtype=np.int64)
    for d in range(low, high):
        sums, squares, common = (np.zeros(grey.shape) for _ in range(3))
        for n, (i, j) in enumerate(places):
            f = _shifted(other, i, j + d)
            sums += f * weight[n]
            squares += f * f * weight[n]
            common += f * weighted[n]
        correlation = common / np.sqrt(variance * np.maximum(squares - sums**2 / total, 0) + NOISE)
        costs[:, :, d - low] = np.where(correlation > 0, np.rint((1 - np.minimum(np.nan_to_num(correlation), 1)) * MOST), MOST)
    return costs


def along(costs: np.ndarray, grey: np.ndarray, aside: int) -> np.ndarray:
    """Costs summed up along paths from the first line to the last, so many columns aside at each line: a pixel's cost and
    the least of its predecessor's, with the penalty of a step between them, less the predecessor's least of all."""
    out = np.empty_like(costs)
    out[0] = costs[0] + large_step(grey[0] - 0.5)[:, None]
    for y in range(1, len(costs)):
        before, grey_before = np.roll(out[y - 1], aside, axis=0), np.roll(grey[y - 1], aside)
        large = large_step(grey[y] - grey_before)
        least = before.min(axis=1)
        best = np.minimum(before, (least + large)[:, None])
        best[:, 1:] = np.minimum(best[:, 1:], before[:, :-1] + SMALL_STEP)
        best[:, :-1] = np.minimum(best[:, :-1], before[:, 1:] + SMALL_STEP)
        out[y] = costs[y] + best - least[:, None]
        if aside:  # paths that begin here
            at = 0 if aside > 0 else -1
            out[y, at] = costs[y, at] + large_step(grey[y, at] - 0.5)
    return out


def accumulated(costs: np.ndarray, grey: np.ndarray, pairs: int = 4) -> np.ndarray:
    """The sum over two or four pairs of opposite paths."""
    total = np.zeros_like(costs)
    for down, aside in PATHS[:pairs]:
        c, g, t = (costs, grey, total) if down else (costs.swapaxes(0, 1), grey.T, total.swapaxes(0, 1))
        aside = aside if down else 0
        t += along(c, g, aside)
        t[::-1] += along(c[::-1], g[::-1], -aside)
    return total


def disparities(left: np.ndarray, right: np.ndarray, low: int, high: int, pairs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(disparity, cost) of each left pixel: the least summed cost, the first of equals."""
    total = accumulated(pixel_costs(left, right, low, high), grey_of(left), pairs)
    best = total.argmin(axis=2)
    return best + low, np.take_along_axis(total, best[:, :, None], axis=2)[:, :, 0]


def _image(pixels: pd.DataFrame, top: int, side: int, shape: tuple[int, int]) -> np.ndarray:
    out = np.full((*shape, 3), np.nan)
    out[pixels["r"] - top, pixels["c"] - side] = pixels[["red", "green", "blue"]]
    return out


def matched(pixels: DataFrame, pairs: DataFrame, low: int, high: int, tolerance: int = 1) -> DataFrame:
    """(ref_id, nb_id, r, c, disp, cost): for each of pairs(ref_id, nb_id) of rectified images, the pixels (r, c) of the
    first with their counterpart at (r, c + disp) of the second, disp in [low, high), where matching the other way round
    says the same to within `tolerance`, and whose window lies inside both images.

    Rows with a null key or colour are left out; a pixel given twice counts with its greatest colours; pairs given twice
    count once; a pair without pixels of both has no row."""
    here = pixels.select("image_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *[F.col(k).cast("double").alias(k) for k in ("red", "green", "blue")]).dropna()
    here = here.groupBy("image_id", "r", "c").agg(*[F.max(k).alias(k) for k in ("red", "green", "blue")])
    both = pairs.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("nb_id").cast("long").alias("nb_id")).dropna().distinct()
    side = lambda k: both.join(here.withColumnRenamed("image_id", k), k).select("ref_id", "nb_id", "r", "c", "red", "green", "blue").toDF(*[f"{k}_{x}" for x in ("ref", "nb", "r", "c", "red", "green", "blue")])  # noqa: E731  names of its own

    def match(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        names = ["ref_id", "nb_id", "r", "c", "disp", "cost"]
        one.columns = two.columns = ["ref_id", "nb_id", "r", "c", "red", "green", "blue"]
        if one.empty or two.empty:
            return pd.DataFrame({n: [] for n in names})
        top, edge = min(one["r"].min(), two["r"].min()), min(one["c"].min(), two["c"].min())
        shape = (max(one["r"].max(), two["r"].max()) - top + 1, max(one["c"].max(), two["c"].max()) - edge + 1)
        left, right = _image(one, top, edge, shape), _image(two, top, edge, shape)
        disp, cost = disparities(left, right, low, high)
        back, _ = disparities(right, left, 1 - high, 1 - low)
        r, c = np.indices(shape)
        at = c + disp
        window = lambda image: np.isfinite(sum(_shifted(image[:, :, 0], i, j) for i in range(-HALF, HALF + 1) for j in range(-HALF, HALF + 1)))
        whole_left, whole_right, inside = window(left), window(right), (at >= 0) & (at < shape[1])
        at = np.clip(at, 0, shape[1] - 1)
        keep = inside & whole_left & whole_right[r, at] & (np.abs(disp + back[r, at]) <= tolerance)
        return pd.DataFrame({"ref_id": one["ref_id"].iloc[0], "nb_id": one["nb_id"].iloc[0], "r": r[keep] + top, "c": c[keep] + edge, "disp": disp[keep], "cost": cost[keep]}, columns=names)

    of = lambda k: side(k).groupBy(f"{k}_ref", f"{k}_nb")
    return of("ref_id").cogroup(of("nb_id")).applyInPandas(match, SCHEMA)
