"""The audit of redacted videos: sampled frames, leaks, reports, the choice after a retry, and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.boxes import Box

from .frames import small_side
from .sampling import DEFAULT_FPS

FRAME = ["video_id", "frame_idx"]


def qc_frames(frames: DataFrame, sample: DataFrame) -> DataFrame:
    """The sampled frames that really exist; the sample is ids only, and moves to the frames while it is small."""
    lists = sample.select(*FRAME).distinct().withColumn("ids", F.array("frame_idx"))
    return frames.join(small_side(lists, "ids").drop("ids"), FRAME, "left_semi")


def find_leaks(hits: DataFrame, videos: DataFrame, min_face: float = 12) -> DataFrame:
    """Hits (score, corners, visible) of at least min_face pixels, with t_sec (of an unlisted video, at the default rate); leak: still visible."""
    box = Box.of()
    large = hits.filter((box.width >= min_face) & (box.height >= min_face))
    return large.join(videos.select("video_id", "fps"), "video_id", "left").withColumn("t_sec", F.col("frame_idx") / F.coalesce("fps", F.lit(DEFAULT_FPS))).withColumn("leak", F.col("visible")).drop("fps")


def until_first_leak(frames: DataFrame, hits: DataFrame) -> DataFrame:
    """Fail fast: each video's frames up to its first one with a leak."""
    first = hits.filter("leak").groupBy("video_id").agg(F.min("frame_idx").alias("first"))
    return frames.join(first, "video_id", "left").filter(F.col("first").isNull() | (F.col("frame_idx") <= F.col("first"))).drop("first")


def qc_report(checked: DataFrame, hits: DataFrame, videos: DataFrame, sampled: DataFrame, interval: float, cap: int) -> DataFrame:
    """One row per video: status, frames_checked, hits, suppressed, leak_count, leak_rate, leaks (by time), notes.

    checked: frames that were looked at, also those without a hit; hits: from find_leaks, within them.
    """
    frames = checked.groupBy("video_id").agg(F.countDistinct("frame_idx").alias("frames_checked"))
    leak = F.struct("frame_idx", "t_sec", "score", "x1", "y1", "x2", "y2")
    found = hits.groupBy("video_id").agg(F.count(F.lit(1)).alias("hits"), F.count_if("leak").alias("leak_count"), F.array_sort(F.collect_list(F.when(F.col("leak"), leak))).alias("leaks"))
    want = sampled.groupBy("video_id").agg(F.count(F.lit(1)).alias("sampled"))
    rows = videos.select("video_id", "nframes").join(frames, "video_id", "left").join(found, "video_id", "left").join(want, "video_id", "left")
    rows = rows.na.fill(0, ["frames_checked", "hits", "leak_count", "sampled"])
    suppressed = F.col("hits") - F.col("leak_count")
    part = F.when((F.col("nframes") > 0) & (F.col("sampled") < F.col("nframes")), F.format_string(f"%d of %d frames looked at: one every {interval} s, {cap} at most", "sampled", "nframes"))
    seen = F.format_string("%d faces found, %d still visible, %d covered", "hits", "leak_count", suppressed)
    return rows.select(
        "video_id", F.when(F.col("leak_count") > 0, "needs_review").otherwise("pass").alias("status"), "frames_checked", "hits", suppressed.alias("suppressed"), "leak_count",
        F.when(F.col("frames_checked") > 0, F.col("leak_count") / F.col("frames_checked")).otherwise(F.lit(0.0)).alias("leak_rate"), "leaks", F.array_compact(F.array(part, seen)).alias("notes"),
    )


def choose_retry(first: DataFrame, retry: DataFrame, enabled: bool = True) -> DataFrame:
    """Per video, which pass counts: a retry of a video that needs review, if it leaks no more than the first pass.

    first, retry: video_id, status, leak_count (null counts as 1).
    """
    second = retry.select("video_id", F.col("status").alias("retry_status"), F.coalesce("leak_count", F.lit(1)).alias("retry_leaks"))
    tried = (F.col("status") == "needs_review") & F.col("retry_leaks").isNotNull() & F.lit(enabled)
    better = tried & (F.col("retry_leaks") <= F.coalesce("leak_count", F.lit(1)))
    rows = first.join(second, "video_id", "left")
    return rows.select(
        "video_id", F.when(better, F.col("retry_status")).otherwise(F.col("status")).alias("status"), F.when(better, F.col("retry_leaks")).otherwise(F.col("leak_count")).alias("leak_count"),
        tried.alias("retried"), (tried & ~better).alias("retry_rejected"),
    )


def run_metrics(frames: DataFrame, painted: DataFrame, timings: DataFrame) -> DataFrame:
    """Per video: frames, seconds, throughput, frames with faces, faces painted, detector calls and milliseconds each.

    frames: video_id, frame_idx; painted: one row for each emitted box; timings: video_id, seconds, detect_seconds, calls.
    """
    n = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"))
    faces = painted.groupBy("video_id").agg(F.count(F.lit(1)).alias("faces_painted"), F.countDistinct("frame_idx").alias("frames_with_faces"))
    rows = n.join(faces, "video_id", "left").join(timings, "video_id", "left").na.fill(0, ["faces_painted", "frames_with_faces", "seconds", "detect_seconds", "calls"])
    speed = F.when((F.col("frames") > 0) & (F.col("seconds") > 0), F.col("frames") / F.col("seconds")).otherwise(F.lit(0.0))
    ms = F.lit(1000.0) * F.col("detect_seconds") / F.greatest(F.lit(1), F.col("calls"))
    return rows.select("video_id", "frames", "seconds", speed.alias("throughput"), "frames_with_faces", "faces_painted", F.col("calls").alias("detect_calls"), ms.alias("ms_per_call"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON record per video, in a folder for each video."""
    metrics.withColumn("video", F.col("video_id")).write.partitionBy("video").json(path)


def frame_hints(stats: DataFrame, lost: DataFrame, most: int = 80, dark_under: float = 72.0, motion_over: float = 18.0) -> DataFrame:
    """video_id, frame_idx, hint: the first `most` dark and the first `most` moving frames of a video, and all track losses.

    stats: video_id, frame_idx, luma, tiles (array), motion (null if not comparable).
    """
    dark = (F.col("luma") < dark_under) | F.exists("tiles", lambda t: t < dark_under)
    parts = [stats.filter(dark).select(*FRAME, F.lit("dark").alias("hint")), stats.filter(F.col("motion") > motion_over).select(*FRAME, F.lit("motion").alias("hint"))]
    both = parts[0].unionByName(parts[1])
    rank = F.row_number().over(Window.partitionBy("video_id", "hint").orderBy("frame_idx"))
    capped = both.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
    return capped.unionByName(lost.select(*FRAME, F.lit("track_loss").alias("hint")).distinct())
