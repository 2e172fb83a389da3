"""Pixel kernels on numpy arrays; reading image files needs a codec of the user's.

``on_images`` applies one to a column of raw grey images in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def otsu(grey: np.ndarray) -> int:
    """Threshold with the greatest variance between the classes up to it and above it; 128 for a picture of one tone."""
    counts = np.bincount(grey.ravel().astype(np.uint8), minlength=256).astype(float)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = counts.sum() - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    parted = (below > 0) & (above > 0)
    return int(np.argmax(np.where(parted, between, -1))) if parted.any() else 128


def local_mean(grey: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the square around each pixel, cut at the border, from sums over rectangles."""
    h, w = grey.shape
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = grey.astype(float).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    return (sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]) / area


def paper_score(rgb: np.ndarray) -> np.ndarray:
    """Bright and colourless is paper: the greatest channel less the spread."""
    most, least = rgb.max(-1).astype(float), rgb.min(-1).astype(float)
    return most * (1 - np.where(most > 0, (most - least) / np.maximum(most, 1), 0))


#: Spread of the blur before sharpness is measured, and of the blur that tests it. Fixed values, as are the two limits.
SMOOTH, REBLUR = 2.0, 2.0
TOO_BLURRED, SHARP = 0.1, 0.25


def blur(grey: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, edges continued, rounded to whole values."""
    r = max(1, round(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()
    g = grey.astype(float)
    for axis in (0, 1):
        padded = np.pad(g, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        g = sum(w * np.take(padded, np.arange(k, k + grey.shape[axis]), axis) for k, w in enumerate(weights))
    return np.floor(g + 0.5)


def sharpness(grey: np.ndarray) -> float:
    """Share of the variation between neighbours, to the left and above, that a further blur takes from the smoothed image."""
    variation = lambda a: np.abs(a[1:, 1:] - a[1:, :-1]).sum() + np.abs(a[1:, 1:] - a[:-1, 1:]).sum()
    smooth = blur(grey, SMOOTH)
    before = variation(smooth)
    return float((before - variation(blur(smooth, REBLUR))) / before) if before else 0.0


def sharpness_verdict(score: Column) -> Column:
    """struct(note, error): how sharp, at most 1; ``blurred`` under TOO_BLURRED."""
    return F.struct(F.least(F.lit(1.0), score / SHARP).alias("note"), F.when(score < TOO_BLURRED, "blurred").alias("error"))


# Shares of an image that a document may take, of a border beyond which it leaves the photo, and of its hull that it must fill; notes.
LEAST_AREA, MOST_AREA, LEAVES, CONVEX = 0.12, 0.985, 0.08, 0.85
NO_DOCUMENT, ONLY_CUT, DOUBTFUL = 0.6, 0.8, 0.5


def document_decision(area: Column, convexity: Column, borders: Column, quadrilateral: Column) -> Column:
    """struct(frame, note) of a photo: ``none`` (as it is), ``box`` (cut only) or ``perspective``.

    area: share of the image that the found region takes (null without one); convexity: share of its hull that it
    fills; borders: array of the shares of the four borders it covers; quadrilateral: whether its outline is one.
    """
    none = area.isNull() | (area < LEAST_AREA) | (area > MOST_AREA)
    doubtful = convexity < CONVEX
    leaves = F.exists(borders, lambda b: b >= LEAVES)
    made = lambda frame, note: F.struct(F.lit(frame).alias("frame"), F.lit(note).cast("double").alias("note"))
    return F.when(none, made("none", NO_DOCUMENT)).when(doubtful, made("box", DOUBTFUL)).when(leaves | ~quadrilateral, made("box", ONLY_CUT)).otherwise(made("perspective", None))


def simplified(polygon: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed polygon with the corners that matter.

    It begins at the point farthest from the centre, which is a corner. A stretch keeps its point farthest from the segment between its ends
    if that is beyond ``tolerance``, and so on for both parts.
    """
    p = np.asarray(polygon, float)
    begin = int(np.hypot(*(p - p.mean(0)).T).argmax())
    ring = np.roll(p, -begin, axis=0)
    ring = np.concatenate([ring, ring[:1]])
    kept, stretches = {0}, [(0, len(ring) - 1)]
    while stretches:
        a, b = stretches.pop()
        if b - a < 2:
            continue
        chord, off = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        square = chord @ chord
        along = np.clip(off @ chord / square, 0, 1) if square else np.zeros(len(off))
        gap = np.hypot(*(off - along[:, None] * chord).T)
        if gap.max() > tolerance:
            cut = a + 1 + int(gap.argmax())
            kept.add(cut)
            stretches += [(a, cut), (cut, b)]
    return ring[sorted(kept)]


def four_corners(polygon: np.ndarray, diagonal: float) -> np.ndarray | None:
    """The polygon as a quadrilateral: simplified ever more, from 0.2 % of the image's diagonal by steps of 15 %, below 25 %; None if it skips four."""
    p = np.asarray(polygon, float)
    share = 0.002
    while len(p) > 4 and share < 0.25:
        fewer = simplified(polygon, share * diagonal)
        if len(fewer) <= 4:
            p = fewer
        share *= 1.15
    return order_corners(p) if len(p) == 4 else None


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the leftmost point (monotone chain)."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def area(polygon: np.ndarray) -> float:
    x, y = np.asarray(polygon, float).T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes four points to four others; an error where three lie on a line."""
    rows, right = [], []
    for (x, y), (u, v) in zip(np.asarray(source, float), np.asarray(target, float), strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.array(rows)
    if abs(np.linalg.det(m)) < 1e-10:
        raise ValueError("points on a line")
    return np.append(np.linalg.solve(m, np.array(right)), 1).reshape(3, 3)


def move(points: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Points under a homography: how boxes follow a simulated photo."""
    p = np.column_stack([np.asarray(points, float), np.ones(len(points))]) @ h.T
    return p[:, :2] / p[:, 2:]


def warp(grey: np.ndarray, h: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image seen through the inverse map, bilinear, white outside."""
    ys, xs = np.mgrid[0:height, 0:width]
    back = move(np.column_stack([xs.ravel(), ys.ravel()]), np.linalg.inv(h))
    x, y = back[:, 0], back[:, 1]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    ok = (x0 >= 0) & (y0 >= 0) & (x <= grey.shape[1] - 1) & (y <= grey.shape[0] - 1)
    x0, y0 = np.clip(x0, 0, grey.shape[1] - 2), np.clip(y0, 0, grey.shape[0] - 2)
    fx, fy = x - x0, y - y0
    g = grey.astype(float)
    out = g[y0, x0] * (1 - fx) * (1 - fy) + g[y0, x0 + 1] * fx * (1 - fy) + g[y0 + 1, x0] * (1 - fx) * fy + g[y0 + 1, x0 + 1] * fx * fy
    return np.where(ok, out, 255.0).reshape(height, width)


def order_corners(corners: np.ndarray) -> np.ndarray:
    """Four corners clockwise (y down) from the one nearest to the origin."""
    p = np.asarray(corners, float)
    turn = np.argsort(np.arctan2(*(p - p.mean(0)).T[::-1]))
    p = p[turn]
    return np.roll(p, -int(p.sum(1).argmin()), axis=0)


def regions(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a mask by rows and the connected region of each: row, first column, column after the last, region.

    Regions are numbered by their first pixel in reading order. Runs of neighbouring rows join where
    they overlap (or touch at a corner, with ``diagonal``); labels then spread over these pairs.
    """
    height, width = mask.shape
    steps = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(steps == 1)
    last = np.nonzero(steps == -1)[1]
    g, span = int(diagonal), width + 2
    low = np.searchsorted(row * span + last, (row + 1) * span + first - g, side="right")
    high = np.searchsorted(row * span + first, (row + 1) * span + last + g, side="left")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    label = np.arange(len(row))
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)  # the roots of both runs
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return row, first, last, np.unique(label, return_inverse=True)[1]


def largest_component(mask: np.ndarray, filled: bool = False) -> np.ndarray:
    """The largest 4-connected part of a mask, with its holes filled on demand."""
    row, first, last, region = regions(mask)
    out = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int8)
    if len(row):
        own = region == np.bincount(region, last - first).argmax()
        np.add.at(out, (row[own], first[own]), 1)
        np.add.at(out, (row[own], last[own]), -1)
    out = np.cumsum(out, axis=1)[:, :-1] > 0
    if not filled:
        return out
    ground = np.pad(~out, 1, constant_values=True)
    row, first, last, region = regions(ground)
    holes = np.zeros((ground.shape[0], ground.shape[1] + 1), np.int8)
    own = region != region[0]  # the first run is the frame outside
    np.add.at(holes, (row[own], first[own]), 1)
    np.add.at(holes, (row[own], last[own]), -1)
    return out | (np.cumsum(holes, axis=1)[1:-1, 1:-2] > 0)


def border_share(mask: np.ndarray) -> float:
    """Share of the image's border that a mask covers."""
    edge = np.concatenate([mask[0], mask[-1], mask[1:-1, 0], mask[1:-1, -1]])
    return float(edge.mean()) if len(edge) else 0.0


def bounding_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, width, height of what a mask covers; None where it covers nothing."""
    y, x = np.nonzero(mask)
    return (int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)) if len(y) else None


#: Shares of a page that ink takes if it is text, and points of it that are looked at.
LEAST_INK, MOST_INK, INK_POINTS = 0.002, 0.4, 40_000


def skew(ink: np.ndarray, most: float = 10.0) -> float:
    """Degrees of the text lines: the slope along which row sums vary most, to a tenth; 0 below a fifth and where ink is too little or too much for text.

    Of more than INK_POINTS points every n-th is looked at.
    """
    y, x = np.nonzero(ink)
    if not LEAST_INK <= len(y) / max(1, ink.size) <= MOST_INK:
        return 0.0
    step = -(-len(y) // INK_POINTS)
    y, x = y[::step], x[::step]

    def spread(angle: float) -> float:
        rows = np.floor(y - x * np.tan(np.deg2rad(angle)) + 0.5).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    best = max(np.arange(-most, most + 1), key=spread)
    best = max((a for a in np.arange(best - 1, best + 1.01, 0.1) if abs(a) <= most + 1e-9), key=spread)
    return 0.0 if abs(best) < 0.2 else round(float(best), 1)


def detector_size(width: int, height: int, most: int = 2016) -> tuple[int, int]:
    """Sides of the detector's input: multiples of 32 (halves to even), the longer at most ``most``."""
    scale = min(1.0, most / max(width, height))
    return tuple(max(32, int(np.round(int(side * scale) / 32)) * 32) for side in (width, height))


def detector_sides(width: Column, height: Column, most: int = 2016) -> Column:
    """``detector_size`` as a column: struct(width, height)."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda c: F.greatest(F.lit(32), F.bround(F.floor(c * scale) / 32).cast("int") * 32).cast("bigint")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def on_images(images: DataFrame, kernel: Callable[[np.ndarray], float]) -> DataFrame:
    """path, value of a kernel over grey images: path, width, height, pixels (bytes by rows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "value": [float(kernel(np.frombuffer(p, np.uint8).reshape(h, w))) for p, w, h in zip(b["pixels"], b["width"], b["height"], strict=True)]})

    ship(images.sparkSession)
    return images.select("path", "width", "height", "pixels").mapInPandas(run, "path string, value double")
