"""From a photo to the page in it: frame, sharpness, tilt and margins, one Arrow pass for all stages that are asked for.

A photo is a row of path, width, height and pixels (bytes by rows, one a pixel, or three for colour). A stage takes the
grey picture and gives another with its figures; the rules that turn figures into notes and errors are columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from . import images

# Width of the picture that is segmented, share by which corners move inwards, margin of a box that is only cut, greatest sides of a page laid flat.
SEGMENTED, TIGHTER, BOX_MARGIN, MOST_WIDTH, MOST_HEIGHT = 384, 0.008, 0.01, 2000, 6000
# Width of the picture whose tilt is measured, share of it that a window takes, how much darker than its window ink is.
MEASURED, WINDOW, DARKER = 800, 0.05, 0.15
# How far from white a pixel is content, margin around content, share of the picture that must be left.
TOLERANCE, MARGIN, LEAST_LEFT = 40, 12, 0.5
#: Bytes of pixels that a task holds before it hands rows on.
HELD = 64 << 20

Step = tuple[np.ndarray, dict]


def reduced(picture: np.ndarray, width: int) -> np.ndarray:
    """The picture at most ``width`` wide, each pixel the mean of those it stands for."""
    h, w = picture.shape[:2]
    if w <= width:
        return picture
    height = max(1, round(h * width / w))
    rows, columns = np.arange(height) * h // height, np.arange(width) * w // width
    sums = np.add.reduceat(np.add.reduceat(picture.astype(np.int64), rows, axis=0), columns, axis=1)
    counts = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(columns, w))[None, :]
    return np.floor(sums / (counts if picture.ndim == 2 else counts[..., None]) + 0.5).astype(np.uint8)


def greyed(picture: np.ndarray) -> np.ndarray:
    return picture if picture.ndim == 2 else np.floor(picture @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def border_shares(mask: np.ndarray) -> list[float]:
    """Shares of the upper, right, lower and left border that a mask covers."""
    return [float(edge.mean()) for edge in (mask[0], mask[:, -1], mask[-1], mask[:, 0])]


def outline(mask: np.ndarray) -> np.ndarray:
    """Hull of a mask, from the first and last pixel of each row."""
    y = np.flatnonzero(mask.any(axis=1))
    first, last = mask[y].argmax(axis=1), mask.shape[1] - 1 - mask[y][:, ::-1].argmax(axis=1)
    return images.hull(np.column_stack([np.concatenate([first, last]), np.concatenate([y, y])]))


def flat_size(corners: np.ndarray) -> tuple[int, int]:
    """Width and height of a page laid flat: means of opposite sides, within the greatest ones."""
    sides = np.hypot(*(corners - np.roll(corners, -1, axis=0)).T)
    width, height = (sides[0] + sides[2]) / 2, (sides[1] + sides[3]) / 2
    scale = min(1.0, MOST_WIDTH / max(width, 1e-9), MOST_HEIGHT / max(height, 1e-9))
    return max(1, int(np.floor(width * scale + 0.5))), max(1, int(np.floor(height * scale + 0.5)))


FRAME = "threshold int, area double, convexity double, borders array<double>, corners array<double>, frame string"


def frame(picture: np.ndarray) -> Step:
    """The page cut out of a photo and laid flat.

    Pixels as bright and colourless as the threshold are candidates; their largest part, holes filled, is the page. Its area decides whether there is
    one, its share of its hull whether it is whole, the borders it covers whether it leaves the photo; a hull of four corners is laid flat, any other only cut.
    """
    grey, small = greyed(picture), reduced(picture, SEGMENTED)
    score = small if small.ndim == 2 else np.floor(images.paper_score(small) + 0.5).astype(np.uint8)
    threshold = images.otsu(score)
    page = images.largest_component(score >= threshold, filled=True)
    share = float(page.mean())
    figures = {"threshold": threshold, "area": share, "convexity": None, "borders": None, "corners": None, "frame": "none"}
    if not images.LEAST_AREA <= share <= images.MOST_AREA:
        return grey, figures
    polygon = outline(page)
    figures |= {"convexity": float(page.sum() / max(1.0, images.area(polygon))), "borders": border_shares(page), "frame": "box"}
    scale, inside = grey.shape[1] / small.shape[1], max(figures["borders"]) < images.LEAVES
    corners = images.four_corners(polygon, float(np.hypot(*page.shape))) if inside and figures["convexity"] >= images.CONVEX else None
    if corners is not None:
        centre = corners.mean(axis=0)
        corners = (centre + (corners - centre) * (1 - TIGHTER)) * scale
        width, height = flat_size(corners)
        try:
            flat = images.homography(corners, np.array([[0, 0], [width, 0], [width, height], [0, height]]))
            figures |= {"frame": "perspective", "corners": [float(c) for c in corners.ravel()]}
            return _bytes(images.warp(grey, flat, width, height)), figures
        except (ValueError, np.linalg.LinAlgError):  # three corners on a line: nothing lays them flat
            pass
    x, y, w, h = images.bounding_box(page)
    at = lambda v: int(np.floor(v * scale + 0.5))
    margin = int(np.floor(BOX_MARGIN * max(grey.shape) + 0.5))
    return grey[max(0, at(y) - margin) : at(y + h - 1) + margin + 1, max(0, at(x) - margin) : at(x + w - 1) + margin + 1], figures


SHARPNESS = "sharpness double"


def sharp(grey: np.ndarray) -> Step:
    """How sharp the picture is; it stays as it is."""
    return grey, {"sharpness": images.sharpness(grey) if min(grey.shape) > 1 else 0.0}


STRAIGHTEN = "ink double, tilt double"


def straighten(grey: np.ndarray) -> Step:
    """The picture turned back by the tilt of its text lines, white around it; ink is what is darker than its surroundings, whatever the light."""
    small = reduced(grey, MEASURED)
    mean = images.local_mean(small, max(1, int(np.floor(small.shape[1] * WINDOW / 2 + 0.5))))
    ink = small < mean * (1 - DARKER) - 1e-9
    tilt = images.skew(ink)
    return (turned(grey, tilt) if tilt else grey), {"ink": float(ink.mean()), "tilt": tilt}


def turned(grey: np.ndarray, tilt: float) -> np.ndarray:
    """The picture turned counter-clockwise by ``tilt`` degrees, on a canvas that holds all of it."""
    h, w = grey.shape
    c, s = np.cos(np.deg2rad(tilt)), np.sin(np.deg2rad(tilt))
    width, height = int(np.floor(w * c + h * abs(s) + 0.5)), int(np.floor(w * abs(s) + h * c + 0.5))
    back = np.array([[c, s], [-s, c]])
    shift = np.array([(width - 1) / 2, (height - 1) / 2]) - back @ np.array([(w - 1) / 2, (h - 1) / 2])
    return _bytes(images.warp(grey, np.vstack([np.column_stack([back, shift]), [0, 0, 1]]), width, height)) if min(h, w) > 1 else grey


TRIM = "trimmed boolean, content array<int>"


def trim(grey: np.ndarray) -> Step:
    """The picture without its white borders, but for a margin.

    Content is what most pixels of a square of three differ from white in, so that specks don't count. A picture of which less than half would be left, and
    one without content, stays as it is. ``content`` is x, y, width and height of what is left.
    """
    dark = np.pad(255 - grey.astype(int) > TOLERANCE, 1, mode="edge").astype(int)
    h, w = grey.shape
    box = images.bounding_box(sum(dark[y : y + h, x : x + w] for y in range(3) for x in range(3)) >= 5)
    if box is None:
        return grey, {"trimmed": False, "content": None}
    x, y, bw, bh = box
    x0, y0, x1, y1 = max(0, x - MARGIN), max(0, y - MARGIN), min(w, x + bw + MARGIN), min(h, y + bh + MARGIN)
    kept = (x1 - x0) * (y1 - y0) >= LEAST_LEFT * w * h
    return (grey[y0:y1, x0:x1] if kept else grey), {"trimmed": kept, "content": [x0, y0, x1 - x0, y1 - y0]}


STAGES = {"frame": (frame, FRAME), "sharp": (sharp, SHARPNESS), "straighten": (straighten, STRAIGHTEN), "trim": (trim, TRIM)}


def _bytes(picture: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(picture + 0.5), 0, 255).astype(np.uint8)


def _picture(w: int | None, h: int | None, raw: bytes | None) -> np.ndarray | None:
    if not w or not h or raw is None or w < 0 or h < 0 or len(raw) not in (w * h, 3 * w * h):
        return None
    return np.frombuffer(raw, np.uint8).reshape((h, w) if len(raw) == w * h else (h, w, 3))


def through(photos: DataFrame, stages: Sequence[str] = ("frame", "sharp", "straighten", "trim"), pixels: bool = True) -> DataFrame:
    """path, width, height, pixels (grey, after the last stage), readable and the figures of the stages, in the order given.

    A picture that comes again within a task, byte for byte, is not worked out again. Without ``pixels`` that column is null: then no picture comes back from the workers.
    A photo without pixels, or whose number of bytes doesn't fit its sides, is not readable: it has no picture and no figures. Other columns are left out.
    """
    steps = [STAGES[s][0] for s in stages]
    schema = ", ".join(["path string, width int, height int, pixels binary, readable boolean", *(STAGES[s][1] for s in stages)])

    def one(picture: np.ndarray | None) -> dict:
        if picture is None:
            return {"readable": False}
        figures: dict = {}
        for step in steps:
            picture, new = step(greyed(picture) if step is not frame else picture)
            figures |= new
        picture = greyed(picture)
        return figures | {"readable": True, "width": picture.shape[1], "height": picture.shape[0], "pixels": picture.tobytes() if pixels else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict] = {}
        weight = 0
        for batch in batches:
            rows, held = [], 0
            path, width, height, raw = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                key = (width[i].as_py(), height[i].as_py(), raw[i].as_py())
                if (done := known.get(key)) is None:
                    done = one(_picture(*key))
                    weight += len(key[2] or b"") + len(done.get("pixels") or b"")
                    if weight > HELD:
                        known, weight = {}, 0
                    known[key] = done
                rows.append(done | {"path": path[i].as_py()})
                held += len(done.get("pixels") or b"")
                if held > HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    spark = photos.sparkSession
    ship(spark)
    arrow = _arrow(StructType.fromDDL(schema))
    read = photos.select(F.col("path").cast("string"), F.col("width").cast("int"), F.col("height").cast("int"), F.col("pixels").cast("binary"))
    return read.mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def noted(done: DataFrame) -> DataFrame:
    """Photos that went ``through`` all stages, with note (the worst of the frame's and the sharpness's, 1 without any) and error (unreadable or blurred)."""
    seen = images.document_decision(F.col("area"), F.col("convexity"), F.col("borders"), F.col("corners").isNotNull())
    verdict = images.sharpness_verdict(F.col("sharpness"))
    return done.withColumn("note", F.when(F.col("readable"), worst_note(seen["note"], verdict["note"]))).withColumn("error", F.when(~F.col("readable"), "unreadable").otherwise(verdict["error"]))


def worst_note(*notes: Column) -> Column:
    """The least of the notes that there are, 1 without any."""
    return F.least(*[F.coalesce(n, F.lit(1.0)) for n in notes], F.lit(1.0))
