import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimark.operators import images, photos

SCHEMA = "path string, width int, height int, pixels binary, extra string"


def _row(path, picture):
    return (path, picture.shape[1], picture.shape[0], picture.astype(np.uint8).tobytes(), "x")


def _page(angle, width=500, height=300):
    """A white page with lines that fall by an angle."""
    y, x = np.mgrid[0:height, 0:width]
    return np.where((y - np.floor(np.tan(np.deg2rad(angle)) * x + 0.5)).astype(int) % 24 < 2, 40, 230).astype(np.uint8)


def test_unreadable_photos(spark):
    rows = [("a", 3, 2, b"12345", "x"), ("b", None, 2, b"", "x"), ("c", 2, 2, None, "x"), ("d", 0, 0, b"", "x"), (None, 2, 1, b"\x01\x02", "x"), ("e", -2, -2, b"1234", "x"), ("f", 1, 1, b"1", "x"), ("f", 1, 1, b"1", "x")]
    got = photos.noted(photos.through(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((str(r.path), r.readable, r.error) for r in got) == [("None", True, "blurred"), *((k, False, "unreadable") for k in "abcde"), ("f", True, "blurred"), ("f", True, "blurred")]
    assert "extra" not in got[0].asDict() and all(r.pixels is None and r.note is None for r in got if not r.readable)
    assert photos.through(spark.createDataFrame([], SCHEMA)).count() == 0


def test_page_in_a_photo_of_colours(spark):
    photo = np.zeros((400, 800, 3), np.uint8)
    photo[...] = (200, 90, 20)  # bright, but coloured
    photo[:8] = (210, 100, 40)
    photo[100:300, 200:600] = (225, 222, 220)
    done = photos.through(spark.createDataFrame([_row("p", photo)], SCHEMA).withColumn("width", F.lit(800)), ["frame"]).first()
    assert done.frame == "perspective" and len(done.pixels) == done.width * done.height
    corners = np.array(done.corners).reshape(4, 2)
    assert np.abs(corners - [[200, 100], [600, 100], [600, 300], [200, 300]]).max() < 6  # segmented at 384 of 800 pixels
    assert np.frombuffer(done.pixels, np.uint8).min() > 200


def test_slanted_page_is_laid_flat():
    corners = np.array([[60.0, 40], [330, 70], [300, 260], [40, 230]])
    y, x = np.mgrid[0:300, 0:380]
    inside = np.ones(x.shape, bool)
    for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    photo = np.where(inside, 220, 30).astype(np.uint8)
    photo[-1, -3:] = 40
    flat, figures = photos.frame(photo)
    assert figures["frame"] == "perspective" and np.abs(np.array(figures["corners"]).reshape(4, 2) - corners).max() < 4
    assert abs(flat.shape[1] - 264) < 6 and abs(flat.shape[0] - 190) < 6 and (flat > 200).mean() > 0.99


def test_photos_that_are_only_cut():
    photo = np.full((100, 200), 30, np.uint8)
    photo[-1, -2:] = 40
    photo[20:80, 0:120] = 220
    cut, figures = photos.frame(photo)
    assert figures["frame"] == "box" and figures["borders"] == [0, 0, 0, 0.6] and cut.shape == (64, 122)
    disc = np.full((200, 200), 30, np.uint8)
    y, x = np.mgrid[0:200, 0:200]
    disc[(y - 100) ** 2 + (x - 100) ** 2 < 80**2] = 220
    disc[-1, -2:] = 40
    assert photos.frame(disc)[1]["area"] == pytest.approx(0.5, abs=0.01) and photos.frame(np.full((9, 9), 200, np.uint8))[1]["frame"] == "none"


@pytest.mark.parametrize("angle", [-7.3, -2.5, -0.4, 0.0, 0.3, 1.8, 6.9])
def test_tilt(angle):
    page = _page(angle)
    page[:, 250:] = (page[:, 250:] * 0.45).astype(np.uint8)  # half of it in the shade
    level, figures = photos.straighten(page)
    assert figures["tilt"] == pytest.approx(angle, abs=0.1 + 1e-9)
    assert abs(photos.straighten(level[60:-60, 60:-60])[1]["tilt"]) <= 0.2


def test_no_tilt_without_text():
    for page in (np.full((60, 60), 255, np.uint8), np.zeros((60, 60), np.uint8), np.full((1, 1), 9, np.uint8)):
        same, figures = photos.straighten(page)
        assert figures["tilt"] == 0.0 and (same == page).all()


def test_trim():
    page = np.full((100, 100), 255, np.uint8)
    page[20:80, 15:90] = 100
    page[50, 3] = 0  # a speck
    cut, figures = photos.trim(page)
    assert figures == {"trimmed": True, "content": [3, 8, 97, 84]} and cut.shape == (84, 97)
    page[20:80, 15:90] = 215  # as far from white as paper may be
    assert photos.trim(page)[1] == {"trimmed": False, "content": None}
    page[40:60, 40:60] = 214
    assert photos.trim(page)[1] == {"trimmed": False, "content": [28, 28, 44, 44]}


def test_rules_of_the_pass_are_those_of_the_columns(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in range(40):
        photo = rng.integers(20, 40, (48, 64)).astype(np.uint8)
        h, w = rng.integers(5, 48), rng.integers(5, 64)
        y, x = rng.integers(0, 49 - h), rng.integers(0, 65 - w)
        photo[y : y + h, x : x + w] = rng.integers(180, 250, (h, w))
        if n % 3 == 0:
            photo[y : y + h // 2, x : x + w // 2] = 25
        rows.append(_row(str(n), photo))
    done = photos.through(spark.createDataFrame(rows, SCHEMA), ["frame"])
    seen = images.document_decision(F.col("area"), F.col("convexity"), F.col("borders"), F.col("corners").isNotNull())
    got = done.select("frame", seen["frame"].alias("decided")).collect()
    assert all(r.frame == r.decided for r in got) and {r.frame for r in got} == {"none", "box", "perspective"}


def test_worst_note(spark):
    got = spark.createDataFrame([(0.8, None), (None, None), (0.5, 0.2)], "a double, b double").select(photos.worst_note(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0.8, 1.0, 0.2]


def test_pictures_that_come_again_are_worked_out_once(spark, monkeypatch):
    """Each worker counts the pages it straightens: two different ones among sixty, in one task."""
    page = lambda n: bytes(30 if (i // 40 + n * i % 40 // 8) % 10 == 0 else 220 for i in range(1600))
    rows = spark.createDataFrame([(str(i), 40, 40, page(i % 2) if i % 3 else None) for i in range(60)], "path string, width int, height int, pixels binary").coalesce(1)
    monkeypatch.setattr(photos, "STAGES", photos.STAGES | {"straighten": (_counting(photos.STAGES["straighten"][0]), "ink double, tilt double, seen int")})
    got = photos.through(rows, ["straighten"], pixels=False).collect()
    assert len(got) == 60 and sum(not r.readable for r in got) == 20 and max(r.seen for r in got if r.readable) == 2
    assert all(r.pixels is None for r in got) and len({(r.tilt, r.ink) for r in got if r.readable}) == 2


def _counting(step):
    calls = []

    def counted(grey):
        calls.append(1)
        picture, figures = step(grey)
        return picture, figures | {"seen": len(calls)}

    return counted
