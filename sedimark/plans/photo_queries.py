"""Photos and pages drawn for every part, from which the stages take the page; SQL knows the drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images, photos
from ..sources.receipts import table

DARK, SPECK, BRIGHT, WHITE, PALE, GREY = "1E", "28", "DC", "FF", "D8", "64"


def _run(colour: str, n: Column) -> Column:
    return F.repeat(F.lit(colour), n.cast("int"))


def _band(ground: str, width: int, at: Column, *runs: tuple[str, Column]) -> Column:
    """A row of the picture: runs of colours from ``at`` on a ground."""
    used = sum((n for _, n in runs), at)
    return F.concat(_run(ground, at), *[_run(c, n) for c, n in runs], _run(ground, width - used))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' keys, spread before a picture is drawn for each: few bytes of a file give many of pixels."""
    return table(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _drawn(spark: SparkSession, sf_dir: str, width: int, height: int, pixels: Column, *marks: Column) -> DataFrame:
    return _parts(spark, sf_dir).select(F.col("p_partkey").cast("bigint").alias("k"), *marks).select(F.col("k").cast("string").alias("path"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.unhex(pixels).alias("pixels"))


def framed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the photo of every part: upright, leaving the photo on the left, merged with its ground, too far away, with a hole, beside another, not
    to be told from its ground, or slanted, at a place that comes from the key."""
    x, y, kind = F.col("x"), F.col("y"), F.col("kind")
    row = lambda *runs: _band(DARK, 80, x, *runs)
    wide, n = row((BRIGHT, F.lit(50))), F.lit
    hole = row((BRIGHT, n(20)), (DARK, n(10)), (BRIGHT, n(20)))
    slanted = F.array_join(F.transform(F.sequence(n(0), n(29)), lambda j: _band(DARK, 80, x + j, (BRIGHT, n(30)))), "")
    body = (
        F.when(kind == 2, F.concat(F.repeat(wide, n(10)), F.repeat(row((BRIGHT, n(20))), n(30))))
        .when(kind == 3, F.repeat(row((BRIGHT, n(20))), n(20)))
        .when(kind == 4, F.concat(F.repeat(wide, n(15)), F.repeat(hole, n(5)), F.repeat(wide, n(20))))
        .when(kind == 5, F.repeat(row((BRIGHT, n(50)), (DARK, n(4)), (BRIGHT, n(12))), n(40)))
        .when(kind == 7, slanted)
        .otherwise(F.repeat(wide, n(40)))
    )
    rows = F.when(kind == 3, 20).when(kind == 7, 30).otherwise(40)
    picture = F.concat(_run(DARK, 80 * y), body, _run(DARK, 80 * (60 - y - rows) - 4), _run(SPECK, n(4)))
    drawn = _drawn(spark, sf_dir, 80, 60, F.when(kind == 6, _run(BRIGHT, n(4800))).otherwise(picture), (F.col("p_partkey") % 8).alias("kind"), F.when(F.col("p_partkey") % 8 == 1, 0).otherwise(8 + F.floor(F.col("p_partkey") / 8) % 5).alias("x"), (6 + F.floor(F.col("p_partkey") / 40) % 4).alias("y"))
    done = photos.through(drawn, ["frame"])
    seen = images.document_decision(F.col("area"), F.col("convexity"), F.col("borders"), F.col("corners").isNotNull())
    # A hole's edge and a slanted one are mixed from both sides.
    thousandths = lambda i: F.round(F.element_at("corners", i) * 1000).cast("bigint")
    bright = F.when(~(F.col("path").cast("bigint") % 8).isin(4, 7), F.regexp_count(F.hex("pixels"), F.lit(BRIGHT))).cast("bigint")
    return done.select(
        F.col("path").cast("bigint").alias("k"), "frame", seen["frame"].alias("decided"), seen["note"].alias("note"), F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"),
        F.round(F.col("area") * 4800).cast("bigint").alias("pixels"), F.round(F.col("convexity") * 1000).cast("bigint").alias("convexity"), F.round(F.element_at("borders", 4) * 60).cast("bigint").alias("on_left"),
        thousandths(1).alias("x0"), thousandths(2).alias("y0"), thousandths(5).alias("x2"), thousandths(6).alias("y2"), bright.alias("bright"),
    )


# Corners lie on the outermost pixels and move inwards by 0.8 % of their distance to the centre; sides of 49 and 39, of the slanted page 29 and 29 times the root of 2.
FRAMED = """with p as (select cast(p_partkey as bigint) as k, p_partkey % 8 as kind, 8 + p_partkey // 8 % 5 as x, 6 + p_partkey // 40 % 4 as y from part),
t as (select *, kind in (0, 4, 5, 7) as whole, case when kind = 7 then 58 else 49 end as dx, case when kind = 7 then 29 else 39 end as dy from p)
select k, case when whole then 'perspective' when kind in (1, 2) then 'box' else 'none' end as frame, frame as decided,
  cast(case when kind = 1 then 0.8 when kind = 2 then 0.5 when kind in (3, 6) then 0.6 end as double) as note,
  cast(case when kind = 7 then round(29 * 0.992) when whole then round(49 * 0.992) when kind = 1 then 51 when kind = 2 then 52 else 80 end as bigint) as width,
  cast(case when kind = 7 then round(29 * sqrt(2) * 0.992) when whole then round(39 * 0.992) when kind in (1, 2) then 42 else 60 end as bigint) as height,
  cast(case kind when 2 then 10 * 50 + 30 * 20 when 3 then 400 when 6 then 4800 when 7 then 900 else 2000 end as bigint) as pixels,
  cast(round(1000 * case when kind = 2 then 1100 / (49 * 39 - 30 * 30 / 2) when kind = 7 then 900 / (29 * 29) when kind not in (3, 6) then 2000 / (49 * 39) end) as bigint) as convexity,
  cast(case when kind = 1 then 40 when kind not in (3, 6) then 0 end as bigint) as on_left,
  case when whole then cast(round(1000 * (x + 0.004 * dx)) as bigint) end as x0, case when whole then cast(round(1000 * (y + 0.004 * dy)) as bigint) end as y0,
  case when whole then cast(round(1000 * (x + 0.996 * dx)) as bigint) end as x2, case when whole then cast(round(1000 * (y + 0.996 * dy)) as bigint) end as y2,
  case when kind not in (4, 7) then case when whole then width * height else pixels end end as bright from t"""


def straightened_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tilt of every part's page of four lines, from -4 to 4 degrees by its key, and the size of the page turned back."""
    part = _parts(spark, sf_dir).select(F.col("p_partkey").cast("bigint").alias("k"), (F.col("p_partkey") % 21).cast("bigint").alias("tilted"))
    slope = F.tan(F.radians((F.col("tilted") - 10) * 0.4))
    inked = lambda i: F.pmod(F.floor(i / 400) - F.floor(10 + slope * (i % 400) + 0.5), F.lit(20)) == 0
    page = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(400 * 80 - 1)), lambda i: F.when(inked(i), DARK).otherwise(BRIGHT)), ""))
    pages = part.select("tilted").distinct().select("tilted", page.alias("pixels"))  # 21 pages at most
    drawn = part.join(F.broadcast(pages), "tilted").select(F.col("k").cast("string").alias("path"), F.lit(400).alias("width"), F.lit(80).alias("height"), "pixels")
    done = photos.through(drawn, ["straighten"], pixels=False)
    return done.select(F.col("path").cast("bigint").alias("k"), F.round(F.col("tilt") * 10).cast("bigint").alias("tenths"), F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))


STRAIGHT = """with p as (select cast(p_partkey as bigint) as k, cast((p_partkey % 21 - 10) * 4 as bigint) as tenths from part), t as (select *, radians(tenths / 10.0) as a from p)
select k, tenths, cast(floor(400 * cos(a) + 80 * abs(sin(a)) + 0.5) as bigint) as width, cast(floor(400 * abs(sin(a)) + 80 * cos(a) + 0.5) as bigint) as height from t"""


def trimmed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every part's page without its white borders: content in a pale frame, too little of it, none, or near the left edge; a speck lies in the corner."""
    x, y, kind = F.col("x"), F.col("y"), F.col("kind")
    w, h = F.when(kind == 1, 20).otherwise(60), F.when(kind == 1, 20).otherwise(45)
    pale = lambda n: F.repeat(_band(WHITE, 100, x - 2, (PALE, w + 4)), F.lit(n))
    inside = F.concat(_run(WHITE, 100 * (y - 2) - 1), pale(2), F.repeat(_band(WHITE, 100, x - 2, (PALE, F.lit(2)), (GREY, w), (PALE, F.lit(2))), h.cast("int")), pale(2), _run(WHITE, 100 * (80 - y - h - 2)))
    drawn = _drawn(spark, sf_dir, 100, 80, F.concat(F.lit(DARK), F.when(kind == 2, _run(WHITE, F.lit(7999))).otherwise(inside)), (F.col("p_partkey") % 4).alias("kind"), F.when(F.col("p_partkey") % 4 == 3, 3).otherwise(20 + F.col("p_partkey") % 7).alias("x"), (15 + F.col("p_partkey") % 5).alias("y"))
    done = photos.through(drawn, ["trim"])
    side = lambda i: F.element_at("content", i).cast("bigint")
    grey = F.regexp_count(F.hex("pixels"), F.lit(GREY)).cast("bigint")
    return done.select(F.col("path").cast("bigint").alias("k"), "trimmed", side(1).alias("x"), side(2).alias("y"), side(3).alias("w"), side(4).alias("h"), F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"), grey.alias("grey"))


TRIMMED = """with p as (select cast(p_partkey as bigint) as k, p_partkey % 4 as kind, case when p_partkey % 4 = 3 then 3 else 20 + p_partkey % 7 end as x0, 15 + p_partkey % 5 as y0,
  case when p_partkey % 4 = 1 then 20 else 60 end as w0, case when p_partkey % 4 = 1 then 20 else 45 end as h0 from part),
t as (select *, greatest(0, x0 - 12) as xa, greatest(0, y0 - 12) as ya, least(100, x0 + w0 + 12) as xb, least(80, y0 + h0 + 12) as yb from p),
u as (select *, kind <> 2 and 2 * (xb - xa) * (yb - ya) >= 8000 as left_over from t)
select k, left_over as trimmed, case when kind <> 2 then cast(xa as bigint) end as x, case when kind <> 2 then cast(ya as bigint) end as y,
  case when kind <> 2 then cast(xb - xa as bigint) end as w, case when kind <> 2 then cast(yb - ya as bigint) end as h,
  cast(case when left_over then xb - xa else 100 end as bigint) as width, cast(case when left_over then yb - ya else 80 end as bigint) as height, cast(case when kind = 2 then 0 else w0 * h0 end as bigint) as grey from u"""

QUERIES = {"framed_photos": (framed_photos, FRAMED), "straightened_pages": (straightened_pages, STRAIGHT), "trimmed_pages": (trimmed_pages, TRIMMED)}
