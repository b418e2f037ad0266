"""Dense depth by PatchMatch: a plane per pixel, propagated and refined against the neighbour views.

Images are rows (image_id, r, c, grey), grey 0 to 1. The work is dealt by tiles of a reference image. A tile gets, in one
shuffle, the pixel blocks of its image that it and its halo lie in, and of each neighbour view the blocks that the
tile's view volume between the least and the greatest depth can fall on. In a task pixels are taken in two colours of a
checkerboard: all of one colour look at the planes of the other. What is random is a hash of image, pixel and try, so a
result depends neither on partitions nor on the order of rows. A task holds a tile's blocks and some 25 values a pixel.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geom as g

BLOCK = 32
#: Half a patch and the step between its texels, spread of a weight's grey and space, least variance of a
#: patch, scores from which a view counts as unlike, and a pixel as lost; spreads and bonus of smoothness (depth relative,
#: angles in radians); ranges of a refinement; weight and cap of the geometric term; spread of the texture for the prior.
HALF, STEP, SIGMA_GREY, SIGMA_SPACE, LEAST_VARIANCE = 4, 2, 0.1, 3.0, 0.02**2
UNLIKE, KEPT = 1.2, 0.9
SMOOTH_DEPTH, SMOOTH_ANGLE, BONUS_DEPTH, BONUS_ANGLE = 0.02, np.radians(13), 0.07, 0.07 * 0.96
DEPTH_RANGE, ANGLE_RANGES, TRIES = 0.003, (np.radians(16), np.radians(10)), 6
GEOMETRIC, FARTHEST, SIMILAR, TEXTURE = 0.1, 4.0, 0.03, 0.02
#: Texels are moved inwards by up to so many pixels, so that rounding doesn't put those on an image's border outside.
EDGE = 1e-9

PATCH = np.array(list(product(range(-HALF, HALF + 1, STEP), repeat=2)))
CROSS = ((-1, 0), (1, 0), (0, -1), (0, 1))
TILE_KEY = ["image_id", "tile_r", "tile_c"]
CAMERA = ("f", "px", "py", "cx", "cy", "cz")


@dataclass(frozen=True)
class View:
    """grey: pixels from (top, left) on, nan where there is none; camera: f, px, py; R, C: world to camera. depth: of another
    estimate, nan where there is none."""

    grey: np.ndarray
    top: int
    left: int
    camera: tuple
    R: np.ndarray
    C: np.ndarray
    depth: np.ndarray | None = None

    def halved(self) -> View:
        """At half the resolution: means of four pixels. top and left are even."""
        h, w = self.grey.shape[0] // 2 * 2, self.grey.shape[1] // 2 * 2
        four = self.grey[:h, :w].reshape(h // 2, 2, w // 2, 2)
        f, px, py = self.camera
        return replace(self, grey=four.mean(axis=(1, 3)), top=self.top // 2, left=self.left // 2, camera=(f / 2, (px - 0.5) / 2, (py - 0.5) / 2))

    def rays(self, r, c) -> np.ndarray:
        f, px, py = self.camera
        return np.stack([(c - px) / f, (r - py) / f, np.ones(np.broadcast(r, c).shape)], axis=-1)


def uniform(image_id: int, r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of image, pixel and n as numbers from 0 to 1."""
    mask = (1 << 64) - 1
    x = r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64((image_id * 0x165667B19E3779F9 + n * 0xD6E8FEB86659FD93) & mask)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def sampled(image: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Between pixels, linearly; nan where one of the four is not there."""
    h, w = image.shape
    good = (r >= 0) & (c >= 0) & (r < h - 1) & (c < w - 1)
    r, c = np.where(good, r, 0), np.where(good, c, 0)
    i, j = r.astype(np.int64), c.astype(np.int64)
    if h < 2 or w < 2:
        return np.full(r.shape, np.nan)
    i, j = np.minimum(i, h - 2), np.minimum(j, w - 2)
    a, b, flat, at = r - i, c - j, image.reshape(-1), i * w + j
    value = (flat[at] * (1 - b) + flat[at + 1] * b) * (1 - a) + (flat[at + w] * (1 - b) + flat[at + w + 1] * b) * a
    return np.where(good, value, np.nan)


def bent(image: np.ndarray) -> tuple[int, int, list[np.ndarray]]:
    """For looked_up(): height, width and, for each square of four pixels, the value at its first corner and how that
    changes along columns, along rows and along both. Squares that stick out of the image are nan."""
    p = np.pad(image, ((1, 2), (1, 2)), constant_values=np.nan)
    a, b, c, d = p[:-1, :-1], p[:-1, 1:], p[1:, :-1], p[1:, 1:]
    return *image.shape, [x.reshape(-1) for x in (a.copy(), b - a, c - a, d - c - b + a)]


def looked_up(image: tuple, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """sampled() of an image given as bent(), at r - 1 and c - 1. r and c are overwritten."""
    h, w, (value, along, down, both) = image
    for x, most in ((r, h), (c, w)):
        np.minimum(np.maximum(x, 0, out=x), most, out=x)
    i, j = r.astype(np.intp), c.astype(np.intp)
    r -= i
    c -= j
    i *= w + 2
    i += j
    out, slope, along, value = (x.take(i, mode="clip") for x in (both, down, along, value))
    out *= c
    out += slope
    out *= r
    along *= c
    out += along
    out += value
    return out


class Tile:
    """Planes (depth along the axis, normal in camera coordinates) of the pixels of a reference view, and their scores."""

    def __init__(self, image_id: int, view: View, others: list[View], low: float, high: float, prior: np.ndarray | None = None):
        self.id, self.view, self.others, self.low, self.high, self.prior = image_id, view, others, low, high, prior
        h, w = view.grey.shape
        self.r, self.c = np.indices((h, w))
        self.rays = view.rays(self.r + view.top, self.c + view.left)
        padded = np.pad(view.grey, HALF, constant_values=np.nan)
        texel = np.stack([padded[HALF + i : HALF + i + h, HALF + j : HALF + j + w] for i, j in PATCH], axis=-1)
        weight = np.exp(-((texel - view.grey[..., None]) ** 2) / (2 * SIGMA_GREY**2) - (PATCH**2).sum(axis=1) / (2 * SIGMA_SPACE**2))
        self.total = weight.sum(axis=-1)
        centred = texel - ((weight * texel).sum(axis=-1) / self.total)[..., None]
        self.variance = (weight * centred * centred).sum(axis=-1)
        # texels by pixels: sums over texels then go along whole rows
        self.weight, self.centred = (np.ascontiguousarray(x.reshape(h * w, -1).T) for x in (weight, weight * centred))
        self.share = None if prior is None else np.where(prior > 0, np.exp(-self.variance / TEXTURE), 0)
        self.bent = [bent(v.grey) for v in others]
        enough = self.variance >= LEAST_VARIANCE
        self.open = np.isfinite(self.variance) & (enough if prior is None else enough | (prior > 0))
        self.depth, self.normal, self.score = np.full((h, w), np.nan), np.zeros((h, w, 3)), np.full((h, w), 2.0)

    def begin(self, depth: np.ndarray | None = None, normal: np.ndarray | None = None) -> None:
        """The given planes, and random ones where there are none."""
        at = [x[self.open] for x in (self.r, self.c)]
        self.depth[self.open], self.normal[self.open] = self.anywhere(at, 0)
        if depth is not None:
            known = self.open & np.isfinite(depth)
            self.depth[known], self.normal[known] = np.clip(depth[known], self.low, self.high), normal[known]
            at = [x[known] for x in (self.r, self.c)]
            self.normal[known] = self.facing(at, self.normal[known])
        at = [x[self.open] for x in (self.r, self.c)]
        self.score[self.open] = self.scored(at, self.depth[self.open], self.normal[self.open])

    def numbers(self, at, n: int) -> np.ndarray:
        return uniform(self.id, at[0] + self.view.top, at[1] + self.view.left, n)

    def facing(self, at, normal: np.ndarray) -> np.ndarray:
        """Normals turned to the camera."""
        away = (normal * self.rays[at[0], at[1]]).sum(axis=-1) > 0
        return np.where(away[:, None], -normal, normal)

    def anywhere(self, at, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Random planes: roots of depths are spread evenly, and normals over the half sphere."""
        root = np.sqrt(self.low) + self.numbers(at, 3 * n) * (np.sqrt(self.high) - np.sqrt(self.low))
        z, turn = 2 * self.numbers(at, 3 * n + 1) - 1, 2 * np.pi * self.numbers(at, 3 * n + 2)
        flat = np.sqrt(1 - z * z)
        return root**2, self.facing(at, np.stack([flat * np.cos(turn), flat * np.sin(turn), z], axis=-1))

    def bonus(self, at, depth: np.ndarray, normal: np.ndarray, faced: np.ndarray) -> np.ndarray:
        """What planes like those of the four nearest pixels take off a score. faced: normal times ray."""
        (h, w), f = self.depth.shape, self.view.camera[0]
        i, j = np.array(CROSS).T[:, :, None]
        r, c = at[0] + i, at[1] + j
        there = (r >= 0) & (r < h) & (c >= 0) & (c < w)
        flat = np.where(there, r * w + c, 0)
        d, n = self.depth.reshape(-1).take(flat), self.normal.reshape(-1, 3).take(flat, axis=0)
        apart = (faced + (normal[:, 1] * i + normal[:, 0] * j) / f) * (d / depth) - faced
        angle = np.arccos(np.minimum(np.maximum(np.einsum("pk,cpk->cp", normal, n), -1), 1))
        factor = (1 - BONUS_DEPTH * np.exp(apart * apart * (-1 / (2 * SMOOTH_DEPTH**2)))) * (1 - BONUS_ANGLE * np.exp(angle * angle * (-1 / (2 * SMOOTH_ANGLE**2))))
        return np.where(there & np.isfinite(d), factor, 1).prod(axis=0)

    def patch(self, at) -> tuple[np.ndarray, np.ndarray]:
        """Weights and weighted differences from the mean of pixels' texels."""
        flat = at[0] * self.depth.shape[1] + at[1]
        return self.weight.take(flat, axis=1), self.centred.take(flat, axis=1)

    def scored(self, at, depth: np.ndarray, normal: np.ndarray, smooth: bool = True, patch: tuple | None = None) -> np.ndarray:
        """0 for planes under which the patches of the best two other views look the same, to 2. A plane maps pixels to another
        view by three linear forms of row and column, so a texel costs their sums and one division. patch: that of the
        pixels, where it is known."""
        r, c = at
        n, (weight, centred) = len(depth), patch or self.patch(at)
        total, variance = self.total[r, c], self.variance[r, c]
        ray, f = self.rays[r, c], self.view.camera[0]
        faced = np.einsum("pk,pk->p", normal, ray)
        step = np.arange(-HALF, HALF + 1, STEP, dtype=np.float64)[:, None]
        linear = lambda base, down, right: ((base + down * step)[:, None, :] + (right * step)[None, :, :]).reshape(len(PATCH), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = [normal[:, k] / (f * faced * depth) for k in (1, 0)]  # of one over depth, by row and column
            lean = faced * faced - np.abs(faced) * (HALF / f) * (np.abs(normal[:, 0]) + np.abs(normal[:, 1]))
            front = (lean > 0) & (depth * faced != 0)  # the plane meets the rays of all texels before the camera
        bonus = self.bonus(at, depth, normal, faced) if smooth else 1.0
        found = []
        for v, image in zip(self.others, self.bent, strict=True):
            turn, move = v.R @ self.view.R.T, v.R @ (self.view.C - v.C)
            g, px, py = v.camera
            # column and row, as looked_up() takes them, times z, and z, of what a texel's ray meets, over its depth
            inner = [1 - 2 * EDGE / max(x - 1, 1) for x in v.grey.shape]
            form = np.array([[g * inner[1], 0, (px - v.left) * inner[1] + 1 + EDGE], [0, g * inner[0], (py - v.top) * inner[0] + 1 + EDGE], [0, 0, 1]])
            turn, move = form @ turn, form @ move
            with np.errstate(divide="ignore", invalid="ignore"):
                u, w, z = (linear(ray @ turn[k] + move[k] / depth, turn[k, 1] / f + move[k] * slope[0], turn[k, 0] / f + move[k] * slope[1]) for k in range(3))
                ahead = z > 0
                np.divide(1, z, out=z)
                u *= z
                w *= z
                if not ahead.all():
                    u[~ahead], w[~ahead] = 0, 0
                value = looked_up(image, w, u)
                mean, like = np.einsum("kp,kp->p", value, weight), np.einsum("kp,kp->p", value, centred)
                value *= value
                spread = variance * np.maximum(np.einsum("kp,kp->p", value, weight) - mean * mean / total, 0)
                score = 1 - np.minimum(np.maximum(like / np.sqrt(spread), -1), 1)
            score = np.where(spread > 1e-16, score, np.nan) * bonus
            if v.depth is not None:
                score = score + GEOMETRIC * self.inconsistent(v, at, depth)
            if self.prior is not None:
                before, share = self.prior[r, c], self.share[r, c]
                score = (1 - share) * score + share * np.minimum(np.abs(np.where(before > 0, before, 1) - depth) / np.where(before > 0, before, 1), 0.5)
            found.append(np.where(np.isfinite(score), np.minimum(score, 2), UNLIKE))
        best = np.sort(np.stack(found), axis=0)
        out = best[0] if len(best) < 2 else np.where(best[1] < UNLIKE, (best[0] + best[1]) / 2, best[0])
        return np.where((depth >= self.low) & (depth <= self.high) & front, out, 2.0)

    def inconsistent(self, v: View, at, depth: np.ndarray) -> np.ndarray:
        """How far a pixel comes back from where it started, by the depth that another view has where it falls: sqrt(d (d + 2))
        pixels, FARTHEST at most and where that view says otherwise."""
        q = (self.rays[at[0], at[1]] * depth[:, None]) @ (v.R @ self.view.R.T).T + v.R @ (self.view.C - v.C)
        f, px, py = v.camera
        with np.errstate(divide="ignore", invalid="ignore"):
            u, w = px + f * q[:, 0] / q[:, 2], py + f * q[:, 1] / q[:, 2]
            fine = (q[:, 2] > 0) & np.isfinite(u) & np.isfinite(w)
            other = sampled(v.depth, np.where(fine, w - v.top, -1), np.where(fine, u - v.left, -1))
            there = np.stack([(u - px) / f * other, (w - py) / f * other, other], axis=-1)
            back = there @ (self.view.R @ v.R.T).T + self.view.R @ (v.C - self.view.C)
            f, px, py = self.view.camera
            off = np.hypot(px + f * back[:, 0] / back[:, 2] - (at[1] + self.view.left), py + f * back[:, 1] / back[:, 2] - (at[0] + self.view.top))
            known = fine & (np.abs(q[:, 2] - other) / q[:, 2] < SIMILAR)
            return np.where(known, np.minimum(np.sqrt(off * (off + 2)), FARTHEST), FARTHEST)

    def take(self, at, depth: np.ndarray, normal: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Keeps the planes that score better than those there."""
        better = score < self.score[at[0], at[1]]
        here = at[0][better], at[1][better]
        self.depth[here], self.normal[here], self.score[here] = depth[better], normal[better], score[better]
        return better

    def round(self, number: int) -> None:
        """Each colour takes planes of its four neighbours, then tries others near its own, or any where it has no good one."""
        h, w = self.depth.shape
        for colour in (0, 1):
            mine = self.open & ((self.r + self.c + self.view.top + self.view.left) % 2 == colour)
            at = self.r[mine], self.c[mine]
            if not len(at[0]):
                continue
            ray = self.rays[at]
            for i, j in CROSS:
                r, c = np.clip(at[0] + i, 0, h - 1), np.clip(at[1] + j, 0, w - 1)
                d, n = self.depth[r, c], self.facing(at, self.normal[r, c])
                with np.errstate(divide="ignore", invalid="ignore"):
                    here = d * (n * self.rays[r, c]).sum(axis=-1) / (n * ray).sum(axis=-1)
                here = np.where((here >= self.low) & (here <= self.high), here, d)
                some = np.isfinite(here) & (self.score[r, c] < KEPT)
                if some.any():
                    sub = at[0][some], at[1][some]
                    self.take(sub, here[some], n[some], self.scored(sub, here[some], n[some]))
            score = self.score[at]
            patch = self.patch(at)
            narrow = np.where(score <= 0.66 * KEPT, 2, np.where(score <= 0.9 * KEPT, 1, 0))
            for k in range(TRIES):
                n = ((number * 2 + colour) * TRIES + k + 1) * 4
                lost = self.score[at] >= 1.1 * KEPT
                spread = 0.5**narrow
                centre, own = self.depth[at], self.normal[at]
                depth = centre * (1 + DEPTH_RANGE * spread * (2 * self.numbers(at, 3 * n) - 1))
                (x, y, z), low = own.T, np.abs(own[:, 0]) < 0.9  # across the normal and an axis that it isn't near
                side = np.stack([np.where(low, 0, -z), np.where(low, z, 0), np.where(low, -y, x)], axis=-1)
                side /= np.sqrt(np.einsum("pk,pk->p", side, side))[:, None]
                a, b, c = side.T
                across = np.stack([y * c - z * b, z * a - x * c, x * b - y * a], axis=-1)
                turns = [np.tan(a * spread * (2 * self.numbers(at, 3 * n + 1 + m) - 1))[:, None] for m, a in enumerate(ANGLE_RANGES)]
                normal = own + turns[0] * side + turns[1] * across
                normal /= np.sqrt(np.einsum("pk,pk->p", normal, normal))[:, None]
                if lost.any():
                    depth[lost], normal[lost] = self.anywhere((at[0][lost], at[1][lost]), n + 1)
                fine = np.einsum("pk,pk->p", normal, ray) < 0
                found = np.where(fine, self.scored(at, depth, np.where(fine[:, None], normal, own), patch=patch), 2.0)
                narrow = narrow + (self.take(at, depth, normal, found) & ~lost)


def estimated(image_id: int, view: View, others: list[View], low: float, high: float, rounds: int, levels: int) -> Tile:
    """From the coarsest of `levels` halvings to the full resolution, each from the planes of the one before."""
    pyramid = [(view, others)]
    for _ in range(levels):
        pyramid.append((pyramid[-1][0].halved(), [o.halved() for o in pyramid[-1][1]]))
    coarse: Tile | None = None
    for level in range(levels, -1, -1):
        view, others = pyramid[level]
        if coarse is None:
            tile = Tile(image_id, view, others, low, high)
            tile.begin()
        else:
            r, c = (np.minimum(x // 2, n - 1) for x, n in zip(np.indices(view.grey.shape), coarse.depth.shape, strict=True))
            good = coarse.score[r, c] < KEPT
            normal = coarse.normal[r, c]
            with np.errstate(divide="ignore", invalid="ignore"):
                slope = (normal * coarse.rays[r, c]).sum(axis=-1) / (normal * view.rays(*[x + o for x, o in zip(np.indices(view.grey.shape), (view.top, view.left), strict=True)])).sum(axis=-1)
                depth = np.where(good, coarse.depth[r, c] * slope, np.nan)
            tile = Tile(image_id, view, others, low, high, prior=np.nan_to_num(depth))
            tile.begin(np.where(depth > 0, depth, np.nan), normal)
        for k in range(rounds):
            tile.round(level * rounds + k)
        coarse = tile
    return coarse


def blocks(pixels: DataFrame, *values: str) -> DataFrame:
    """(image_id, block_r, block_c, pixels): the pixels (r, c and the values) of each square of BLOCK. A pixel given twice
    counts with its greatest values; rows with a null are left out."""
    rows = pixels.select("image_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *[F.col(v).cast("float").alias(v) for v in values]).dropna()
    rows = rows.groupBy("image_id", "r", "c").agg(*[F.max(v).alias(v) for v in values])
    at = [F.floor(F.col(x) / BLOCK).cast("int").alias(f"block_{x}") for x in "rc"]
    return rows.groupBy("image_id", *at).agg(F.collect_list(F.struct("r", "c", *values)).alias("pixels"))


def needed(cells: DataFrame, cameras: DataFrame, pairs: DataFrame, ranges: DataFrame, tile: int, halo: int, margin: int = 12) -> DataFrame:
    """For each tile of cells(image_id, block_r, block_c) the blocks that it needs: (image_id, tile_r, tile_c, view_id,
    block_r, block_c, camera, low, high). Its own are those within the halo; a neighbour's those in the box of the eight
    corners of the tile's view volume, cut to what the view has, or all of that if a corner lies behind it."""
    cams = g.posed(cameras)
    turn = g.rotation(cams.columns) or [F.lit(float(k in (0, 4, 8))) for k in range(9)]
    cams = cams.select(F.col("image_id").cast("long").alias("image_id"), F.array(*[F.col(c).cast("double") for c in CAMERA], *[F.lit(t).cast("double") for t in turn]).alias("camera"))
    tiles = cells.select("image_id", *[F.floor(F.col(f"block_{x}") * BLOCK / tile).cast("int").alias(f"tile_{x}") for x in "rc"]).distinct()
    tiles = tiles.join(cams, "image_id").join(ranges.select("image_id", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")).dropna().filter("low > 0 and high >= low").groupBy("image_id").agg(F.min("low").alias("low"), F.max("high").alias("high")), "image_id")
    span = lambda x: F.explode(F.sequence(F.floor((F.col(f"tile_{x}") * tile - halo) / BLOCK), F.floor((F.col(f"tile_{x}") * tile + tile + halo - 1) / BLOCK)).cast("array<int>")).alias(f"block_{x}")
    own = tiles.select("*", F.col("image_id").alias("view_id"), span("r")).select("*", span("c"))
    corner = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(d).alias("d")) for a, b in product((-halo, tile + halo - 1), repeat=2) for d in ("low", "high")])
    near = pairs.select(F.col("ref_id").cast("long").alias("image_id"), F.col("nb_id").cast("long").alias("view_id")).dropna().filter("image_id <> view_id").distinct()
    met = tiles.withColumn("corner", F.explode(corner)).join(near, "image_id").join(cams.select(F.col("image_id").alias("view_id"), F.col("camera").alias("other")), "view_id")
    cam = lambda name: ([F.get(name, F.lit(k)) for k in range(3)], [F.get(name, F.lit(k)) for k in range(3, 6)], [F.get(name, F.lit(k)) for k in range(6, 15)])
    (intrinsic, centre, r), (other, other_centre, other_r) = cam("camera"), cam("other")
    p = g.back_project(F.col("tile_c") * tile + F.col("corner.b"), F.col("tile_r") * tile + F.col("corner.a"), F.col("corner.d"), *intrinsic, centre, r)
    q = g.to_camera(p, other_centre, other_r)
    u, v = g.project(q, *other)
    box = met.select(*TILE_KEY, "view_id", "other", "low", "high", q[2].alias("z"), u.alias("u"), v.alias("v")).groupBy(*TILE_KEY, "view_id").agg(
        *[F.any_value(x).alias(x) for x in ("other", "low", "high")], F.min("z").alias("z"), *[f(x).alias(f"{n}_{x}") for x in "uv" for n, f in (("min", F.min), ("max", F.max))])
    extent = cells.groupBy(F.col("image_id").alias("view_id")).agg(*[f(f"block_{x}").alias(f"{n}_block_{x}") for x in "rc" for n, f in (("first", F.min), ("last", F.max))])
    behind = F.col("z") <= 0
    for x, v in (("r", "v"), ("c", "u")):
        first, last = F.col(f"first_block_{x}").cast("double"), F.col(f"last_block_{x}").cast("double")
        low = F.when(behind, first).otherwise(F.greatest(first, (F.col(f"min_{v}") - margin) / BLOCK))
        high = F.when(behind, last).otherwise(F.least(last, (F.col(f"max_{v}") + margin) / BLOCK))
        extent_of = {f"low_{x}": F.floor(low).cast("int"), f"high_{x}": F.floor(high).cast("int")}
        box = (box.join(extent, "view_id") if x == "r" else box).withColumns(extent_of).filter(f"low_{x} <= high_{x}").withColumn(f"block_{x}", F.explode(F.sequence(f"low_{x}", f"high_{x}")))
    reach = box
    names = [*TILE_KEY, "view_id", "block_r", "block_c", "camera", "low", "high"]
    return own.select(*names).unionByName(reach.withColumnRenamed("other", "camera").select(*names))


def _assembled(rows: list[dict], camera: list[float], fields: tuple[str, ...], window: tuple | None = None) -> tuple[View, dict]:
    """The view of a tile's blocks, and the fields' arrays; `window`: top, left, bottom, right, else what the blocks span."""
    pixels = {k: np.concatenate([np.asarray(b[k]) for b in rows]) for k in ("r", "c", *fields)}
    even = 16  # so that halving keeps pixels together
    r, c = pixels["r"].astype(np.int64), pixels["c"].astype(np.int64)
    top, left, bottom, right = window or (r.min() // even * even, c.min() // even * even, r.max() + 1, c.max() + 1)
    inside = (r >= top) & (r < bottom) & (c >= left) & (c < right)
    out = {k: np.full((bottom - top, right - left), np.nan) for k in fields}
    for k in fields:
        out[k][r[inside] - top, c[inside] - left] = pixels[k][inside]
    return View(out["grey"], int(top), int(left), tuple(camera[:3]), np.array(camera[6:]).reshape(3, 3), np.array(camera[3:6])), out


def estimated_depth(pixels: DataFrame, cameras: DataFrame, pairs: DataFrame, ranges: DataFrame, rounds: int = 3, levels: int = 2, tile: int = 128, halo: int = 16, kept: float = KEPT, known: DataFrame | None = None) -> DataFrame:
    """(image_id, r, c, depth, conf, nx, ny, nz): a plane for each pixel of pixels(image_id, r, c, grey) that has one which its
    neighbour views confirm; the normal is in camera coordinates, conf is 1 less the score. cameras(image_id, f, px, py, cx,
    cy, cz[, R]); pairs(ref_id, nb_id): which views an image is compared with; ranges(image_id, low, high): its depths.

    With known(image_id, r, c, depth, nx, ny, nz), an estimate of all images, one round refines that instead, and a plane
    is also held against the depths that the other views have where it falls.

    Rows with a null are left out, a pixel, pair or range given twice counts once (the greatest grey, the widest range), an
    image without camera, range or other view has no rows, nor has a pixel within 4 of the border or without texture; other
    columns are not looked at. tile and halo are multiples of 16."""
    again = known is not None
    values = ("grey", "depth", "nx", "ny", "nz") if again else ("grey",)
    rows = pixels.select(F.col("image_id").cast("long").alias("image_id"), "r", "c", "grey")
    if again:
        filled = known.select(F.col("image_id").cast("long").alias("image_id"), "r", "c", "depth", "nx", "ny", "nz")
        rows = rows.join(filled, ["image_id", "r", "c"], "left").fillna(-1.0, subset=["depth"]).fillna(0.0, subset=["nx", "ny", "nz"])
    held = blocks(rows, *values)
    wanted = needed(held.select("image_id", "block_r", "block_c"), cameras, pairs, ranges, tile, halo)
    dealt = wanted.join(held.withColumnRenamed("image_id", "view_id"), ["view_id", "block_r", "block_c"]).select(*TILE_KEY, "view_id", "camera", "low", "high", *[F.col(f"pixels.{k}").alias(k) for k in ("r", "c", *values)])

    def run(table: pa.Table) -> pa.Table:
        parts: dict[int, list[dict]] = {}
        found = sorted(table.to_pylist(), key=lambda b: (b["view_id"], b["r"][0], b["c"][0]))
        for b in found:
            parts.setdefault(b["view_id"], []).append(b)
        image_id, tile_r, tile_c = (found[0][k] for k in TILE_KEY)
        names = ["image_id", "r", "c", "depth", "conf", "nx", "ny", "nz"]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 5]
        if image_id not in parts or len(parts) < 2:
            return pa.table([pa.array([], t) for t in types], names)
        mine = parts.pop(image_id)
        window = (tile_r * tile - halo, tile_c * tile - halo, (tile_r + 1) * tile + halo, (tile_c + 1) * tile + halo)
        view, own = _assembled(mine, mine[0]["camera"], values, window)
        others = []
        for bs in parts.values():
            v, there = _assembled(bs, bs[0]["camera"], values)
            others.append(replace(v, depth=np.where(there["depth"] > 0, there["depth"], np.nan)) if again else v)
        low, high = found[0]["low"], found[0]["high"]
        if not again:
            done = estimated(image_id, view, others, low, high, rounds, levels)
        else:
            done = Tile(image_id, view, others, low, high)
            done.begin(np.where(own["depth"] > 0, own["depth"], np.nan), np.stack([own[k] for k in ("nx", "ny", "nz")], axis=-1))
            done.round((levels + 1) * rounds)
        good = done.open & (done.score < kept)
        good[:halo], good[-halo:], good[:, :halo], good[:, -halo:] = False, False, False, False
        r, c = np.nonzero(good)
        columns = [np.full(len(r), image_id), r + view.top, c + view.left, done.depth[good], np.maximum(1 - done.score[good], 0), *done.normal[good].T]
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    return dealt.groupBy(*TILE_KEY).applyInArrow(run, "image_id long, r int, c int, depth double, conf double, nx double, ny double, nz double")
