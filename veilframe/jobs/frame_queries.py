"""Registered queries on pixels: frames are drawn from embeddings as 8 x 8 gray blocks of 16 pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.operators import frames as fr
from veilframe.operators.redaction import crop_region
from veilframe.sources.derived import FACE

from .redaction import Schedule, Settings, redact_and_audit, retry_schedule


def draw(batches: Iterator[pd.DataFrame], step: int = 64) -> Iterator[pd.DataFrame]:
    """Frames of embeddings, `step` (3 MB of pixels) at a time: a batch of embeddings is 180 times as large as frames."""
    for batch in (b.iloc[i : i + step] for b in batches for i in range(0, len(b), step)):
        images = []
        for e in batch["embedding"]:
            block = np.clip(np.floor(128 + 400 * np.asarray(e, np.float64)), 0, 255).astype(np.uint8).reshape(8, 8)
            data = np.repeat(np.repeat(np.repeat(block, 16, 0), 16, 1)[..., None], 3, 2)
            images.append({"origin": "", "height": 128, "width": 128, "nChannels": 3, "mode": fr.BGR_MODE, "data": data.tobytes()})
        yield pd.DataFrame({"video_id": batch["video_id"], "frame_idx": batch["frame_idx"], "image": images})


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("v"), "label").alias("video_id"), F.col("vec_id").cast("long").alias("frame_idx"), "embedding")

    return rows.mapInPandas(draw, fr.FRAME_SCHEMA)


_BLOCKS = "select concat('v', label) as video_id, vec_id as frame_idx, list_transform(embedding, lambda x: least(greatest(floor(128 + 400 * x::double), 0), 255)) as b from embeddings"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes in every frame."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = (F.col("vec_id") % 60).cast("double")
    points = F.lit(None).cast("array<struct<x:double,y:double>>")
    two = F.explode(F.array(F.lit(0), F.lit(1))).alias("order")
    rows = e.select(F.concat(F.lit("v"), "label").alias("video_id"), F.col("vec_id").cast("long").alias("frame_idx"), x.alias("x"), two)
    return rows.select("video_id", "frame_idx", "order", F.col("order").alias("det_idx"), (F.col("x") + F.col("order") * 8).alias("x1"), F.col("x").alias("y1"), (F.col("x") + 40).alias("x2"), (F.col("x") + 60).alias("y2"), points.alias("landmarks"))


def frame_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fr.frame_stats(frames(spark, sf_dir))
    tiles = [F.round(F.get("tiles", F.lit(i)), 6).alias(f"tile{i}") for i in (0, 5, 15)]
    return s.select("video_id", "frame_idx", F.round("luma", 6).alias("luma"), *tiles, fr.any_tile_dark(F.col("tiles"), 115.0).alias("dark"))


def frame_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.frame_motion(fr.frame_stats(frames(spark, sf_dir))).select("video_id", "frame_idx", F.round("motion", 6).alias("motion"))


def redact_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blackout of rectangles: what is left of each frame's brightness."""
    out = fr.redact_frames(frames(spark, sf_dir), boxes(spark, sf_dir), "blackout", "rect", pad=0.0)
    return out.select("video_id", "frame_idx", F.sha2("image.data", 256).alias("sha"), F.length("image.data").alias("bytes"))


def redact_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fr.redact_frames(frames(spark, sf_dir), boxes(spark, sf_dir))
    return fr.frame_stats(out).select("video_id", "frame_idx", F.round("luma", 3).alias("luma"))


def residual_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes(spark, sf_dir).withColumns({"width": F.lit(128), "height": F.lit(128)})
    out = fr.redact_frames(frames(spark, sf_dir), boxes(spark, sf_dir).filter("det_idx = 0"))
    return fr.residual_visibility(out, crop_region(found)).select("video_id", "frame_idx", "det_idx", "visible", F.round("mae", 3).alias("mae"))


def detect_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in detector: the bright part of a frame as one box, scored by its brightness."""

    def factory():  # noqa: ANN202
        def detect(f: np.ndarray) -> np.ndarray:
            ys, xs = np.nonzero(f[..., 0] > 170)
            return np.array([[xs.min(), ys.min(), xs.max() + 1, ys.max() + 1, f[ys, xs, 0].mean() / 255]]) if len(ys) else np.zeros((0, 5))

        return detect

    return fr.detect_frames(frames(spark, sf_dir), factory, 0.7)


def redaction_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with stand-in detectors: what each video's report and metrics say, and how many frames came out.

    A video's frames are numbered on. The first pass looks for very bright blocks, the retry for less bright ones, too.
    """

    def spots(level: int) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
        def factory() -> Callable[[np.ndarray], np.ndarray]:
            def detect(f: np.ndarray) -> np.ndarray:
                k = f.shape[0] // 8  # blocks are an eighth of a side, at any scale
                ys, xs = np.nonzero(f[k // 2 :: k, k // 2 :: k, 0] > level)
                boxes = [(x * k - k / 2, y * k - k / 2, x * k + 1.5 * k, y * k + 1.5 * k, int(f[y * k + k // 2, x * k + k // 2, 0]) / 255) for y, x in zip(ys, xs, strict=True)]
                eyes = [(x1 + u * (x2 - x1), y1 + v * (y2 - y1)) for x1, y1, x2, y2, _ in boxes for u, v in FACE]
                return np.hstack([np.array(boxes), np.array(eyes).reshape(len(boxes), 10)]) if boxes else np.zeros((0, 15))

            return detect

        return factory

    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("v"), "label").alias("video_id"), F.col("vec_id").cast("long").alias("frame_idx"))
    numbers = found.withColumn("nth", (F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1).cast("long"))
    every = frames(spark, sf_dir).join(numbers, ["video_id", "frame_idx"]).select("video_id", F.col("nth").alias("frame_idx"), "image")
    videos = found.select("video_id").distinct().select("video_id", F.lit(25.0).alias("fps"), F.lit(128).alias("width"), F.lit(128).alias("height"), F.lit(None).cast("long").alias("nframes"))
    schedule = Schedule(long_side=128, threshold=0.95, extra_long_side=256, extra_every=3, strong_every=10, strong_threshold=0.97)
    retry = retry_schedule(schedule, threshold=0.9, long_side=128, strong_every=1)
    out = redact_and_audit(every, videos, spots(240), spots(230), Settings(schedule, method="blackout", shape="rect", interval=0.2, retry=retry))
    left = out.frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames_out"))
    report = out.report.select("video_id", "status", "frames_checked", "leak_count", "retried", "retry_rejected")
    return report.join(out.metrics.select("video_id", "frames", "frames_with_faces", "faces_painted", "detect_calls"), "video_id").join(left, "video_id", "left")


def enhance_dark_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fr.enhance_dark_frames(frames(spark, sf_dir), threshold=110.0)
    return fr.frame_stats(out).select("video_id", "frame_idx", F.round("luma", 3).alias("luma"))


def _tile(i: int) -> str:
    at = (i // 4) * 16 + i % 4 * 2
    return f"(b[{at + 1}] + b[{at + 2}] + b[{at + 9}] + b[{at + 10}]) / 4"


QUERIES = {
    "frame_luma": frame_luma, "frame_motion": frame_motion, "redact_frames": redact_frames, "redact_hybrid": redact_hybrid,
    "residual_visibility": residual_visibility, "detect_frames": detect_frames, "enhance_dark_frames": enhance_dark_frames,
    "redaction_job": redaction_job,
}

ORACLES = {
    "frame_luma": f"select video_id, frame_idx, round(list_avg(b), 6) as luma, {', '.join(f'round({_tile(i)}, 6) as tile{i}' for i in (0, 5, 15))}, {' or '.join(f'{_tile(i)} < 115 - 1e-9' for i in range(16))} as dark from ({_BLOCKS})",
    "frame_motion": f"""select video_id, frame_idx, round(list_stddev_pop(list_transform(list_zip(b, p), lambda z: z[1] - z[2])), 6) as motion
      from (select *, lag(b) over (partition by video_id order by frame_idx) as p from ({_BLOCKS}))""",
    # both boxes lie within the first one: 60 rows and 40 columns from the frame's number modulo 60 on
    "redact_frames": f"""select video_id, frame_idx, sha256(unhex(array_to_string(list_transform(range(0, 16384), lambda p: repeat(case when p // 128 between v and v + 59 and p % 128 between v and v + 39
        then '00' else h[p // 2048 * 8 + p % 128 // 16 + 1] end, 3)), ''))) as sha, 49152 as bytes
      from (select video_id, frame_idx, frame_idx % 60 as v, list_transform(b, lambda x: printf('%02x', x::int)) as h from ({_BLOCKS}))""",
    "detect_frames": f"""select video_id, frame_idx, 0 as det_idx, x1, y1, x2, y2, score from (select video_id, frame_idx,
        min((i - 1) % 8) * 16::double as x1, min((i - 1) // 8) * 16::double as y1, (max((i - 1) % 8) + 1) * 16::double as x2, (max((i - 1) // 8) + 1) * 16::double as y2, avg(v) / 255 as score
      from (select video_id, frame_idx, unnest(b) as v, generate_subscripts(b, 1) as i from ({_BLOCKS})) where v > 170 group by 1, 2) where score >= cast(0.7 as double)""",
}
