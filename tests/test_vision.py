"""Word detection on drawn pages."""

import numpy as np
import pytest

from sparrowgrid.operators import lines, vision

TEXT = "the quick brown fox jumps over the lazy dog while many other words fill this page and make several lines of text to read from left to right"


def page(text=TEXT, width=480):
    h, px, n = vision.draw(text, width)
    return np.frombuffer(px, np.uint8).reshape(h, width).copy(), n


def test_every_word_is_found_in_reading_order():
    gray, n = page()
    boxes, seen = vision.detect_words(gray)
    assert len(boxes) == n and [b["chars"] for b in boxes] == [len(w) for w in TEXT.split()]
    assert seen["contrast"] == 175 and seen["threshold"] == 14 and seen["height_x2"] == 18
    assert all(b["flags"] & 128 == 0 for b in boxes) and boxes == sorted(boxes, key=lambda b: (b["line"], b["ink_x1"]))


def test_rules_punctuation_and_edges():
    gray, n = page()
    gray[-9:-7, 5:475] = 30  # a rule under the text
    boxes, seen = vision.detect_words(gray)
    assert seen["rules"] == 1
    gray, n = page()
    gray[-8:-5, 200:212] = 40  # a speck
    boxes, _ = vision.detect_words(gray)
    assert sum(bool(b["flags"] & 128) for b in boxes) == 1
    gray, _ = page()
    gray[40:49, 0:6] = 40
    assert any(b["flags"] & 1 for b in vision.detect_words(gray)[0])


@pytest.mark.parametrize("gray", [np.full((20, 30), 200, np.uint8), np.zeros((5, 5), np.uint8), np.full((1, 1), 9, np.uint8)])
def test_blank_frames_have_no_boxes(gray):
    assert vision.detect_words(gray)[0] == []


def test_wrong_frames_are_passed_over(spark):
    h, px, _ = vision.draw("one two", 480)
    rows = [(1, 480, h, px), (2, 480, h, px[:-1]), (3, None, h, px), (4, 481, h, px), (5, 480, h, None)]
    assert {r.frame for r in vision.detect(spark.createDataFrame(rows, "frame long, w int, h int, pixels binary")).collect()} == {1}


def test_kernel_sums_to_one():
    assert vision.kernel(4096 * 5, 15).sum() == 32768 and (vision.kernel(4096, 3) == vision.kernel(4096, 3)[::-1]).all()


def tilted(gray, degrees, size=480):
    t, (h, w) = np.radians(degrees), gray.shape
    out = np.full((size, size), 215, np.uint8)
    y, x = np.mgrid[0:size, 0:size] - size // 2
    sx, sy = np.rint(x * np.cos(t) + y * np.sin(t) + w // 2).astype(int), np.rint(-x * np.sin(t) + y * np.cos(t) + h // 2).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out[ok] = gray[sy[ok], sx[ok]]
    return out


@pytest.mark.parametrize("degrees", [0, 7, -12])
@pytest.mark.parametrize("inverted", [False, True])
def test_lines_of_any_angle_and_polarity(degrees, inverted):
    gray, n = page()
    gray = tilted(gray, degrees)
    words, seen = lines.detect_lines(255 - gray if inverted else gray)
    assert len(words) == n and [w["chars"] for w in words] == [len(w) for w in TEXT.split()]
    assert {w["polarity"] for w in words} == {2 if inverted else 1} and abs(seen["angle"] - degrees) < 1


def test_line_detector_edges(spark):
    assert lines.detect_lines(np.full((20, 30), 200, np.uint8))[0] == []
    h, px, _ = vision.draw("one two", 480)
    rows = [(1, 480, h, px), (2, 480, h, px[:-1]), (3, None, h, px)]
    got = lines.detect(spark.createDataFrame(rows, "frame long, w int, h int, pixels binary")).collect()
    assert [(r.frame, r.chars) for r in got] == [(1, 3), (1, 3)] and len(got[0].quad) == 8


def test_gap_threshold_matches_the_plan():
    assert lines.gap_threshold(np.array([0.1, 0.1, 0.9]), lines.Rules()) == 0.4
    assert lines.gap_threshold(np.array([0.1, 0.1, 0.12, 0.9, 1.0]), lines.Rules()) == pytest.approx(0.51)
    assert lines.gap_threshold(np.array([0.5, 0.5, 0.5, 0.5]), lines.Rules()) == 0.4


def test_recognition_counts_letters(spark):
    from pyspark.sql import functions as F

    from sparrowgrid.operators import ocr
    from sparrowgrid.plans.vision import ink_model

    h, px, _ = vision.draw("one three fifteen seventeenletters", 480)
    frame = spark.createDataFrame([(1, 480, h, px)], "frame long, w int, h int, pixels binary")
    boxes = vision.detect(frame).join(frame, "frame").withColumn("page_height", F.lit(9))
    got = sorted(ocr.recognize(boxes, ink_model, ["|"] * 84).collect(), key=lambda r: r.box)
    assert [len(r.text) for r in got if not r.fallback] == [3, 5, 7] and {r.status for r in got} == {"ok"} and got[3].fallback
    bad = boxes.withColumn("x2", F.lit(999))
    assert {r.status for r in ocr.recognize(bad, ink_model, ["|"] * 84).collect()} == {"ocr_error"}
    flat = ocr.recognize(boxes, lambda b: np.zeros((len(b), 80, 85), np.int8), ["|"] * 84)
    assert {r.status for r in flat.collect()} == {"runtime_saturated"}


def test_resizing_and_stretching():
    from sparrowgrid.operators import ocr

    c = ocr.Contract()
    assert ocr.resized(np.array([[0, 100], [100, 200]]), 1, 1)[0, 0] == 100
    assert ocr.resized(np.array([[0, 100]]), 4, 1)[0].tolist() == [0, 25, 75, 100]
    assert ocr.quantised(c)[[0, 128, 255]].tolist() == [-128, -16, 127]
    lut, span = ocr.stretched(np.full((10, 10), 90), c)
    assert span == 0 and (lut == ocr.quantised(c)).all()


def test_whole_texts_are_drawn_and_found(spark):
    """A thousand words take many pages, and a long word several places; every one is found."""
    words = [f"{'abcdefghij'[: 1 + k % 10]}" for k in range(1000)] + ["x" * 95]
    pages = vision.drawn(spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "frame long, text string"))
    rows = pages.collect()
    assert {r.frame for r in rows} == {1, 2, 3} and all(r.h <= 640 for r in rows) and len([r for r in rows if r.frame == 1]) > 5
    want = [len(w) for w in words[:-1]] + [40, 40, 15]
    for detect in (vision.detect, lines.detect):
        got = sorted(detect(pages).collect(), key=lambda r: (r.page, r.ink_y1, r.ink_x1))
        assert [r.chars for r in got] == want and {r.frame for r in got} == {1}


@pytest.mark.parametrize("specs", [((30, 9, 6), (70, 10, 6), (110, 11, 7), (150, 9, 6)), ((30, 9, 6), (80, 12, 8), (130, 9, 6), (180, 12, 8))])
def test_lines_of_unequal_x_heights_keep_their_order(specs):
    gray, letters = np.full((300, 480), 215, np.uint8), []
    for top, tall, wide in specs:
        at = 14
        for k in range(5):
            letters.append(2 + (k + top // 10) % 4)
            for _ in range(letters[-1]):
                gray[top : top + tall, at : at + wide] = 40
                at += wide + 2
            at += tall
    words, _ = lines.detect_lines(gray)
    assert [w["chars"] for w in words] == letters and len({w["xh_x16"] for w in words}) > 1


def test_frames_of_full_size_are_filtered_in_time(spark):
    """480 x 640 pixels against plain loops at some places."""
    import time

    from sparrowgrid.operators import arrays

    px = np.random.default_rng(1).integers(0, 256, (640, 480))
    frames = spark.createDataFrame([(7, px.ravel().tolist()), (8, [1, 2])], "frame long, px array<int>")
    began = time.time()
    got = {(r.y, r.x): r.total for r in arrays.box_sums(frames, (640, 480), 15).where("y % 71 = 0 and x % 53 = 0").collect()}
    low = {(r.y, r.x): (r.least, r.most) for r in arrays.extremes(frames, (640, 480), 3).where("y % 71 = 0 and x % 53 = 0").collect()}
    assert time.time() - began < 30 and len(got) == len(low) > 80
    pad, near = np.pad(px, 15, mode="edge"), np.pad(px, 3, mode="edge")
    for (y, x), total in got.items():
        assert total == pad[y : y + 31, x : x + 31].sum() and low[y, x] == (near[y : y + 7, x : x + 7].min(), near[y : y + 7, x : x + 7].max())


def test_lines_are_ordered_by_steps_rounded_half_to_even():
    """Bases 2.5 and 3.5 steps down go to steps 2 and 4; within a step words go along the line, whatever their own height."""
    assert [lines.line_key(b * 7.0, 10.0) for b in (0.5, 1.5, 2.5, 3.5, 2.49, 2.51, -0.5)] == [0, 2, 2, 4, 2, 3, 0]
    assert lines.line_key(2.5, 1.0) == 2  # a step is at least a pixel
    page = np.full((90, 200), 215, dtype=np.uint8)
    for at, y in ((120, 22), (20, 20), (70, 21), (20, 60), (120, 61)):  # two lines, words a pixel up or down
        for k in range(4):
            page[y : y + 9, at + 8 * k : at + 8 * k + 6] = 40
    found, _ = lines.detect_lines(page)
    assert [(o["ink_x1"], o["ink_y1"]) for o in found] == [(20, 20), (70, 21), (120, 22), (20, 60), (120, 61)]
