"""Videos, schedules and budgets: small tables that say which frames get which work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.boxes import resized

#: Frames per second of a video that states none, and the least rate that counts as stated.
DEFAULT_FPS, LEAST_FPS = 25.0, 1e-3


def normalize_videos(videos: DataFrame) -> DataFrame:
    """video_id, fps, width, height, nframes: a missing or zero rate becomes 25, a missing length 0."""
    fps = F.when(F.col("fps") > LEAST_FPS, F.col("fps")).otherwise(F.lit(DEFAULT_FPS))
    return videos.select("video_id", fps.alias("fps"), "width", "height", F.coalesce("nframes", F.lit(0).cast("long")).alias("nframes"))


def letterbox_geometry(videos: DataFrame, side: int) -> DataFrame:
    """Network inputs: never enlarged and padded to multiples of 32, and scaled to an even size within a square."""
    w, h = F.col("width"), F.col("height")
    fit = F.lit(side) / F.greatest(w, h)
    s = F.least(F.lit(1.0), fit)
    nw, nh = F.rint(w * s).cast("int"), F.rint(h * s).cast("int")

    def padded(n: F.Column) -> F.Column:
        return (F.ceil(n / 32) * 32).cast("int")

    return videos.select("video_id", s.alias("scale"), nw.alias("net_w"), nh.alias("net_h"), padded(nw).alias("pad_w"), padded(nh).alias("pad_h"), fit.alias("square_scale"), resized(w, fit).alias("square_w"), resized(h, fit).alias("square_h"))


def detection_schedule(frames: DataFrame, extra_every: int, strong_every: int) -> DataFrame:
    """Which frames get the extra scale and the strong detector; 0 means never."""

    def due(every: int) -> F.Column:
        return F.col("frame_idx") % every == 0 if every > 0 else F.lit(False)

    return frames.select("video_id", "frame_idx", due(extra_every).alias("extra_scale"), due(strong_every).alias("strong"))


def qc_budget(settings: DataFrame) -> DataFrame:
    """Interval and cap of the audit: a cpu device has its own where they are set."""
    cpu = F.col("device") == "cpu"

    def use(name: str) -> F.Column:
        return F.when(cpu, F.coalesce(f"cpu_{name}", name)).otherwise(F.col(name)).alias(f"use_{name}")

    return settings.select("video_id", use("interval"), use("max_frames"))


def frame_time(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Seconds from the start: video_id, frame_idx, t_sec; of an unlisted video at the default rate."""
    return frames.join(videos.select("video_id", "fps"), "video_id", "left").select("video_id", "frame_idx", (F.col("frame_idx") / F.coalesce("fps", F.lit(DEFAULT_FPS))).alias("t_sec"))


def select_qc_frames(videos: DataFrame, hints: DataFrame, interval: float, cap: int) -> DataFrame:
    """Frames to audit: every interval seconds and the hints within the video, thinned evenly to at most cap.

    videos: video_id, fps, nframes; hints: video_id, frame_idx. Only ids are shuffled; a thinned video keeps the ranks
    nearest to cap evenly spaced ones.
    """
    step = F.greatest(F.lit(1), F.rint(F.lit(interval) * F.col("fps")).cast("long"))
    live = videos.filter("nframes > 0").select("video_id", "nframes", step.alias("step"))
    regular = live.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nframes") - 1, "step")).alias("frame_idx"))
    hinted = hints.select("video_id", F.col("frame_idx").cast("long")).join(live, "video_id").filter((F.col("frame_idx") >= 0) & (F.col("frame_idx") < F.col("nframes"))).select("video_id", "frame_idx")
    chosen = regular.unionByName(hinted).distinct()
    per_video = Window.partitionBy("video_id")
    ranked = chosen.withColumn("rank", F.row_number().over(per_video.orderBy("frame_idx")) - 1).withColumn("n", F.count(F.lit(1)).over(per_video))
    if cap <= 0:
        return ranked.filter("n <= 0").select("video_id", "frame_idx")
    # rank r stays if some i of 0 ... cap-1 rounds to it: the nearest i's at either side decide
    unit = (F.col("n") - 1) / F.lit(max(cap - 1, 1))
    near = F.floor(F.col("rank") / unit)
    hit = F.exists(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i <= cap - 1) & (F.rint(i * unit) == F.col("rank")))
    keep = (F.col("n") <= cap) | (F.col("rank") == 0 if cap == 1 else hit)
    return ranked.filter(keep).select("video_id", "frame_idx")
