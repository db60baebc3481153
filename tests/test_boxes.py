"""Geometry, suppression and decoding on small hand-made boxes."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions.boxes import Box, adaptive_pad, detect_scale, is_sane, resized
from veilframe.operators import detections as det

FACE = [(0.30, 0.35), (0.70, 0.35), (0.50, 0.55), (0.35, 0.78), (0.65, 0.78)]
POINTS = "array<struct<x:double,y:double>>"


def rows(spark, boxes, w=480, h=360, points=False):
    data = []
    for i, (x1, y1, x2, y2, score) in enumerate(boxes):
        face = [(x1 + (x2 - x1) * a, y1 + (y2 - y1) * b) for a, b in FACE] if points else None
        data.append(("v", 0, i, float(x1), float(y1), float(x2), float(y2), score, face, w, h))
    return spark.createDataFrame(data, f"video_id string, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, landmarks {POINTS}, width int, height int")


@pytest.mark.parametrize(
    ("box", "points", "sane"),
    [
        ((10, 10, 470, 340, 0.30), False, False),
        ((160, 145, 327, 364, 0.21), False, False),
        ((200, 80, 280, 180, 0.9), False, True),
        ((200, 80, 300, 220, 0.85), False, True),
        ((10, 10, 470, 350, 0.40), False, False),
        ((8, 4, 472, 356, 0.91), False, True),
        ((8, 4, 472, 356, 0.40), True, True),
        ((12, 8, 468, 350, 0.88), False, True),
        ((100, 140, 104, 144, 0.90), False, False),
    ],
)
def test_sane(spark, box, points, sane):
    df = rows(spark, [box], points=points)
    got = df.select(is_sane(Box.of(), F.col("score"), F.col("landmarks"), F.col("width"), F.col("height"), 6.0)).first()[0]
    assert got is sane


def test_pad(spark):
    df = rows(spark, [(8, 4, 472, 356, 1.0), (220, 140, 250, 178, 1.0), (220, 140, 236, 158, 1.0)])
    pads = [r[0] for r in df.orderBy("det_idx").select(adaptive_pad(Box.of(), F.col("width"), F.col("height"), F.lit(0.42))).collect()]
    assert pads[0] <= 0.08 and pads[1] == 0.42 and pads[2] > 0.42


def test_nms_keeps_two_and_ties_keep_the_first(spark):
    kept = det.nms(rows(spark, [(10, 10, 40, 40, 0.9), (12, 12, 42, 42, 0.4), (80, 80, 110, 110, 0.8)])).collect()
    assert sorted(r.score for r in kept) == [0.8, 0.9]
    tied = det.nms(rows(spark, [(10, 10, 40, 40, 0.3), (11, 10, 41, 40, 0.3)]).repartition(3)).collect()
    assert [r.det_idx for r in tied] == [0]


def test_resize(spark):
    def size(w, h, side):
        df = spark.createDataFrame([(w, h, side)], "w int, h int, s int")
        scale = detect_scale(F.col("s"), F.col("w"), F.col("h"))
        return df.select(scale, resized(F.col("w"), scale), resized(F.col("h"), scale)).first()

    assert tuple(size(480, 360, 960)) == (2.0, 960, 720)
    assert size(1920, 1080, 640)[0] == pytest.approx(1 / 3)
    assert size(480, 360, 640)[2] in (480, 482)


def test_priors(spark):
    sizes = spark.createDataFrame([(640, 640)], "net_h int, net_w int")
    priors = det.prior_boxes(sizes)
    assert priors.count() == 16800
    assert priors.select("anchor_idx").distinct().count() == 16800
    assert priors.filter("cx < 0 or cx > 1 or cy < 0 or cy > 1").count() == 0


def test_nms_against_a_plain_loop(spark):
    import random

    rnd = random.Random(4)
    boxes = [(x := rnd.uniform(0, 80), y := rnd.uniform(0, 80), x + rnd.uniform(5, 40), y + rnd.uniform(5, 40), rnd.randrange(8) / 8) for _ in range(60)]

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    left = []
    for i in sorted(range(60), key=lambda i: (-boxes[i][4], i)):
        if all(iou(boxes[i], boxes[k]) < 0.4 for k in left):
            left.append(i)
    assert sorted(r.det_idx for r in det.nms(rows(spark, boxes).repartition(4)).collect()) == sorted(left)
