"""Pixels: redaction, visibility and brightness."""

import numpy as np
import pandas as pd

from veilframe.jobs.frame_queries import draw
from veilframe.operators import frames as fr
from veilframe.sources.store import config_key, merged_config

POINTS = "array<struct<x:double,y:double>>"


def frame(spark, array):
    h, w = array.shape[:2]
    image = {"origin": "", "height": h, "width": w, "nChannels": 3, "mode": 16, "data": array.tobytes()}
    return spark.createDataFrame([("v", 0, image)], fr.FRAME_SCHEMA)


def box(spark, *xyxy):
    return spark.createDataFrame([("v", 0, 0, *map(float, xyxy), None)], f"video_id string, frame_idx long, order int, x1 double, y1 double, x2 double, y2 double, landmarks {POINTS}")


def redacted(spark, array, xyxy, *args, **more):
    return fr.pixels(fr.redact_frames(frame(spark, array), box(spark, *xyxy), *args, **more).first()["image"].asDict())


def test_blackout(spark):
    out = redacted(spark, np.full((80, 80, 3), 200, np.uint8), (10, 10, 70, 70), "blackout", "rect", pad=0.0)
    assert (out[20:60, 20:60] == 0).all() and (out[:8] == 200).all()


def test_hybrid_flattens_a_grid(spark):
    img = np.full((200, 200, 3), 200, np.uint8)
    img[60:140:8, 60:140] = 20
    out = redacted(spark, img, (50, 50, 150, 150), "hybrid", "ellipse", pad=0.05, pixel_blocks=8)
    assert out.shape == img.shape and out[80:120, 80:120].var() < 0.35 * img[80:120, 80:120].var()


def test_visible_before_and_not_after():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:120, :100]
    img = np.clip((x + y)[..., None] + rng.integers(-25, 26, (120, 100, 3)), 0, 255).astype(np.uint8)
    plan = [{"rx1": 5, "ry1": 5, "rx2": 95, "ry2": 115, "kernel": 61, "blocks": 8, "shape": "ellipse", "angle": 0.0}]
    assert fr.visibility(img)[0] and not fr.visibility(fr.paint(img, plan, "hybrid", "ellipse")[5:115, 5:95])[0]


def test_dark_corner(spark):
    img = np.full((80, 80, 3), 180, np.uint8)
    assert not fr.frame_stats(frame(spark, img)).select(fr.any_tile_dark("tiles")).first()[0]
    img[60:, 60:] = 20
    assert fr.frame_stats(frame(spark, img)).select(fr.any_tile_dark("tiles")).first()[0]


def test_frames_without_boxes_pass_through(spark):
    img = np.full((24, 32, 3), (30, 40, 20), np.uint8)
    out = fr.redact_frames(frame(spark, img), box(spark, 0, 0, 20, 20).filter("false"))
    assert out.count() == 1 and (fr.pixels(out.first()["image"].asDict()) == img).all()


def test_config():
    base = {"detector": {"name": "a", "score": 0.18}, "keep": 1, "_path": "x"}
    out = merged_config(base, {"detector": {"score": 0.22}})
    assert out["detector"] == {"name": "a", "score": 0.22} and base["detector"]["score"] == 0.18
    assert config_key(base) == config_key({**base, "_path": "y"}) != config_key(out)


def test_maps_hold_few_frames_at_once(spark):
    pixels = np.zeros((128, 128, 3), np.uint8)
    many = frame(spark, pixels).crossJoin(spark.range(400).withColumnRenamed("id", "n")).drop("n").coalesce(1)

    def count(batches):
        for batch in batches:
            yield pd.DataFrame({"rows": [len(batch)]})

    rows = [r.rows for r in fr.map_frames(many, count, "rows long").collect()]
    assert sum(rows) == 400 and max(rows) * pixels.nbytes <= fr.STEP_BYTES


def test_frames_are_drawn_a_few_at_a_time():
    batch = pd.DataFrame({"video_id": "v", "frame_idx": range(1000), "embedding": [np.zeros(64, np.float32)] * 1000})
    sizes = [len(out) for out in draw(iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= 64
