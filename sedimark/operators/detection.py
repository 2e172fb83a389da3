"""Geometry of text detection and recognition: from a map of text likelihood to boxes, and from boxes to line images."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .images import hull, regions

# What counts as text in a map, how sure a box must be, how far it is widened, its least side, and how many regions are looked at.
PIXEL, BOX, UNCLIP, LEAST_SIDE, MOST_REGIONS = 0.3, 0.6, 1.5, 3, 1000
# Mean and spread by channel for the detector; height, least and most width for the recogniser.
MEAN, SPREAD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
HEIGHT, LEAST_WIDTH, MOST_WIDTH = 48, 320, 3200
# Under which confidence a line is read again, by how much its box grows for that, and the cubic kernel's sharpness.
WEAK, MARGIN, LEAST_CROP, CUBIC = 0.90, 0.10, 4, -0.75


@dataclass
class Rectangle:
    """Along an axis (x, y) from u0 to u1, across it from v0 to v1."""

    axis: np.ndarray
    u0: float
    u1: float
    v0: float
    v1: float

    def corners(self) -> np.ndarray:
        """Top left, top right, bottom right, bottom left (y down)."""
        x, y = self.axis
        p = np.array([(u * x - v * y, u * y + v * x) for u, v in ((self.u0, self.v0), (self.u1, self.v0), (self.u1, self.v1), (self.u0, self.v1))])
        p = p[np.argsort(p[:, 0], kind="stable")]
        left, right = p[:2][np.argsort(p[:2, 1], kind="stable")], p[2:][np.argsort(p[2:, 1], kind="stable")]
        return np.array([left[0], right[0], right[1], left[1]])

    def holds(self, points: np.ndarray) -> np.ndarray:
        u, v = points @ self.axis, points @ np.array([-self.axis[1], self.axis[0]])
        e = 1e-6
        return (u >= self.u0 - e) & (u <= self.u1 + e) & (v >= self.v0 - e) & (v <= self.v1 + e)


def smallest_rectangle(points: np.ndarray) -> Rectangle:
    """The rectangle of least area around points: one of its sides lies on an edge of their hull, or it is upright."""
    edge = hull(points)
    along = np.roll(edge, -1, axis=0) - edge
    length = np.hypot(along[:, 0], along[:, 1])
    axes = np.concatenate([[[1.0, 0.0]], along[length > 0] / length[length > 0][:, None]])
    u, v = edge @ axes.T, edge @ np.stack([-axes[:, 1], axes[:, 0]])
    sizes = np.ptp(u, axis=0) * np.ptp(v, axis=0)
    k = int(sizes.argmin())
    return Rectangle(axes[k], float(u[:, k].min()), float(u[:, k].max()), float(v[:, k].min()), float(v[:, k].max()))


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def boxes(chances: np.ndarray, source_width: int, source_height: int) -> list[dict]:
    """Text boxes of a map of likelihoods: corners (4 x 2, on the source image), x0, y0, x1, y1, score.

    8-connected regions above PIXEL, in reading order; thin and unsure ones go; the others are
    widened by UNCLIP times area over perimeter.
    """
    height, width = chances.shape
    row, first, last, region = regions(chances > PIXEL, diagonal=True)
    scale = np.array([source_width / width, source_height / height])
    out = []
    for k in range(min(MOST_REGIONS, int(region.max()) + 1 if len(region) else 0)):
        own = region == k
        points = np.concatenate([np.stack([first[own], row[own]], 1), np.stack([last[own] - 1, row[own]], 1)]).astype(float)
        r = smallest_rectangle(points)
        long, thick = r.u1 - r.u0, r.v1 - r.v0
        if min(long, thick) < LEAST_SIDE:
            continue
        p = r.corners()
        low, high = np.maximum(np.floor(p.min(0)), 0).astype(int), np.minimum(np.ceil(p.max(0)), [width - 1, height - 1]).astype(int)
        ys, xs = np.mgrid[low[1] : high[1] + 1, low[0] : high[0] + 1]
        inside = r.holds(np.stack([xs.ravel(), ys.ravel()], 1).astype(float)).reshape(xs.shape)
        score = float(chances[ys, xs][inside].mean()) if inside.any() else 0.0
        far = long * thick * UNCLIP / (2 * (long + thick))
        if score < BOX or min(long, thick) + 2 * far < LEAST_SIDE + 2:
            continue
        wide = Rectangle(r.axis, r.u0 - far, r.u1 + far, r.v0 - far, r.v1 + far)
        corners = np.clip(_half_up(wide.corners() * scale), 0, [source_width, source_height])
        (x0, y0), (x1, y1) = corners.min(0), corners.max(0)
        out.append({"corners": corners, "x0": int(x0), "y0": int(y0), "x1": int(x1), "y1": int(y1), "score": score})
    return out


def detector_tensor(grey: np.ndarray) -> np.ndarray:
    """3 x height x width, each channel standardised."""
    x = grey.astype(np.float32) / 255
    return np.stack([(x - m) / s for m, s in zip(MEAN, SPREAD, strict=True)]).astype(np.float32)


def resize(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixels at their centres, edges continued."""
    if (height, width) == grey.shape:
        return grey

    def places(new: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(new) + 0.5) * old / new - 0.5
        low = np.floor(at).astype(int)
        part = np.where((low < 0) | (low >= old - 1), 0.0, at - low)
        low = np.clip(low, 0, old - 1)
        return low, np.minimum(low + 1, old - 1), part

    (y0, y1, fy), (x0, x1, fx) = places(height, grey.shape[0]), places(width, grey.shape[1])
    g = grey.astype(float)
    top, bottom = (g[y][:, x0] * (1 - fx) + g[y][:, x1] * fx for y in (y0, y1))
    return _half_up(top * (1 - fy)[:, None] + bottom * fy[:, None]).astype(np.uint8)


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    a = CUBIC
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    w = [far(t + 1), near(t), near(1 - t)]
    return [*w, 1 - sum(w)]


def crop(grey: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The content of a quadrilateral (top left first, clockwise) set upright, bicubic."""
    a, b, c, d = np.asarray(corners, float)
    side = lambda p, q: float(np.hypot(*(q - p)))
    width, height = max(1, int(max(side(a, b), side(d, c)))), max(1, int(max(side(a, d), side(b, c))))
    v, u = np.mgrid[0:height, 0:width] / np.array([height, width]).reshape(2, 1, 1)
    x, y = (a[k] + u * (b[k] - a[k]) + v * (d[k] - a[k]) for k in (0, 1))
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    wx, wy = _cubic(x - x0), _cubic(y - y0)
    g = grey.astype(float)
    out = np.zeros(x.shape)
    for j in range(4):
        line = sum(wx[i] * g[np.clip(y0 - 1 + j, 0, g.shape[0] - 1), np.clip(x0 - 1 + i, 0, g.shape[1] - 1)] for i in range(4))
        out += wy[j] * line
    return _half_up(np.clip(out, 0, 255)).astype(np.uint8)


def quarter_turn(grey: np.ndarray) -> np.ndarray:
    """Counter-clockwise."""
    return np.rot90(grey)


def recogniser_widths(width: Column, height: Column) -> Column:
    """struct(resized, total): the width of a line at the recogniser's height, and with its padding."""
    total = F.floor(HEIGHT * F.greatest(F.lit(LEAST_WIDTH / HEIGHT), width / height)).cast("int")
    long = total > MOST_WIDTH
    resized = F.when(long, MOST_WIDTH).otherwise(F.least(total, F.ceil(HEIGHT * width / height).cast("int")))
    return F.struct(resized.cast("int").alias("resized"), F.when(long, MOST_WIDTH).otherwise(total).cast("int").alias("total"))


def recogniser_tensor(lines: list[np.ndarray]) -> np.ndarray:
    """lines x 3 x HEIGHT x the widest: values from -1 to 1, zeros where a line ends."""
    sizes = []
    for g in lines:
        ratio = g.shape[1] / g.shape[0]
        total = int(HEIGHT * max(LEAST_WIDTH / HEIGHT, ratio))
        sizes.append((MOST_WIDTH, MOST_WIDTH) if total > MOST_WIDTH else (min(total, int(np.ceil(HEIGHT * ratio))), total))
    out = np.zeros((len(lines), 3, HEIGHT, max(t for _, t in sizes)), np.float32)
    for k, (g, (w, _)) in enumerate(zip(lines, sizes, strict=True)):
        out[k, :, :, :w] = resize(g, w, HEIGHT).astype(np.float32) / 127.5 - 1
    return out


def second_boxes(lines: DataFrame, width: int, height: int) -> DataFrame:
    """Upright boxes of weak lines (conf under WEAK), MARGIN of their height taller above and below, cut to the image and to whole pixels: the columns of
    ``lines`` with other x, y, w, h. Boxes of less than LEAST_CROP pixels either way aren't read again.
    """
    edge = lambda at, most: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), at)))
    more = F.col("h") * MARGIN
    x, y = edge(F.col("x"), width), edge(F.col("y") - more, height)
    w, h = edge(F.col("x") + F.col("w"), width) - x, edge(F.col("y") + F.col("h") + more, height) - y
    weak = lines.where(F.col("conf") < WEAK).withColumns({c: v.cast("double") for c, v in (("x", x), ("y", y), ("w", w), ("h", h))})
    return weak.where((F.col("w") >= LEAST_CROP) & (F.col("h") >= LEAST_CROP))


def best_reading(readings: DataFrame, keys: list[str], turn: str = "turn") -> DataFrame:
    """Of several readings of a line (``turn`` 0 first) the surest text and conf, the earlier one at equal confidence."""
    best = F.max_by(F.struct("text", "conf"), F.struct("conf", (-F.col(turn)).alias("early")))
    return readings.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.text", "b.conf")


def detect(maps: DataFrame) -> DataFrame:
    """k, box, x0, y0, x1, y1, score of maps: k, width, height, source_width, source_height, chances (array of float by rows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                found = boxes(np.asarray(r.chances, np.float32).reshape(r.height, r.width), r.source_width, r.source_height)
                rows += [(r.k, n, x["x0"], x["y0"], x["x1"], x["y1"], x["score"]) for n, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["k", "box", "x0", "y0", "x1", "y1", "score"])

    ship(maps.sparkSession)
    return maps.select("k", "width", "height", "source_width", "source_height", "chances").mapInPandas(run, "k bigint, box bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, score double")
