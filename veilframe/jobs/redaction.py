"""The whole redaction job: detect, track, paint, audit a sample, and paint again where faces are left."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators import audit, frames as fr, sampling
from veilframe.operators.detecting import Factory, Schedule, merged_boxes, scan
from veilframe.operators.redaction import crop_region
from veilframe.operators.tracking import TWO_STAGE, Rules, track, track_loss_frames
from veilframe.sources.store import kept

#: Two-stage tracking that skips frames in long stretches without faces.
SKIPPING = replace(TWO_STAGE, skip_after=36, skip_every=4)


@dataclass(frozen=True)
class Settings:
    """What a job does; retry None: no second pass."""

    schedule: Schedule = field(default_factory=Schedule)
    rules: Rules = SKIPPING
    method: str = "hybrid"
    shape: str = "ellipse"
    pad: float = 0.42
    pixel_blocks: int = 10
    audit_threshold: float = 0.5
    interval: float = 1.5
    cap: int = 120
    fail_fast: bool = False
    #: Most dark and most moving frames of a video that are hints, and from which standard deviation a frame moves.
    hints: int = 80
    motion_over: float = 18.0
    retry: Schedule | None = None


def retry_schedule(first: Schedule, threshold: float = 0.22, long_side: int = 960, strong_every: int = 0) -> Schedule:
    """A second pass's schedule: a lower threshold, larger inputs, the extra side on each frame."""
    return replace(first, threshold=threshold, long_side=long_side, extra_long_side=long_side, extra_every=1, strong_every=strong_every, min_face=6.0)


@dataclass
class Outcome:
    """Painted frames, what was painted, each video's report (with retried and retry_rejected) and metrics."""

    frames: DataFrame
    painted: DataFrame
    report: DataFrame
    metrics: DataFrame


@dataclass
class Pass:
    """What a painting pass leaves: painted frames, tracks in frames that exist, hints for the audit, and timings."""

    frames: DataFrame
    tracks: DataFrame
    hints: DataFrame
    timings: DataFrame


def known_lengths(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """videos with a length: where none is stated, that of the frames there are."""
    last = frames.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("_end"))
    length = F.when(F.col("nframes") > 0, F.col("nframes")).otherwise(F.coalesce("_end", F.lit(0).cast("long")))
    return videos.join(last, "video_id", "left").withColumn("nframes", length).drop("_end")


def detect_calls(ids: DataFrame, tracks: DataFrame, moving: DataFrame, rules: Rules) -> DataFrame:
    """(video_id, calls): the frames whose detections count, which are all but those that skipping leaves out.

    A frame is skipped if the last frame with a track is long past; with min_hits above 1, where live tracks may not
    show, the number is not known (null).
    """
    if rules.skip_after is None:
        return ids.groupBy("video_id").agg(F.count(F.lit(1)).alias("calls"))
    faces = tracks.select("video_id", "frame_idx").distinct().withColumn("face", F.lit(True))
    marked = ids.join(faces, ["video_id", "frame_idx"], "left").join(moving.select("video_id", "frame_idx").distinct().withColumn("moves", F.lit(True)), ["video_id", "frame_idx"], "left")
    before = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    streak = F.col("frame_idx") - 1 - F.coalesce(F.max(F.when(F.col("face"), F.col("frame_idx"))).over(before), F.lit(-1))
    used = (streak < rules.skip_after) | (F.col("frame_idx") % rules.skip_every == 0) | F.coalesce("moves", F.lit(False))
    calls = F.when(F.lit(rules.min_hits <= 1), F.count_if("used"))
    return marked.withColumn("used", used).groupBy("video_id").agg(calls.alias("calls"))


def paint_pass(frames: DataFrame, videos: DataFrame, detector: Factory, strong: Factory | None, schedule: Schedule, s: Settings) -> Pass:
    """Detections become tracks, whose boxes are painted in the order of their births, turned as their landmarks are.

    The pixels are read twice: for statistics and detections, and to be painted.
    """
    scanned = kept(scan(frames, detector, strong, schedule))
    ids = scanned.select("video_id", "frame_idx")
    stats = kept(fr.frame_motion(scanned.select("video_id", "frame_idx", "luma", "tiles", "thumb", "thumb_h", "thumb_w")).drop("thumb"))
    early = kept(audit.frame_hints(stats, ids.limit(0), s.hints, schedule.dark_below, s.motion_over))
    moving = early.filter("hint = 'motion'")
    found = merged_boxes(scanned, schedule.min_face)
    tracks = kept(track(found, videos, s.rules, motion=moving if s.rules.skip_after is not None else None).join(ids, ["video_id", "frame_idx"], "left_semi"))
    boxes = tracks.select("video_id", "frame_idx", F.col("track_id").alias("order"), "x1", "y1", "x2", "y2", "landmarks")
    painted = kept(fr.redact_frames(frames, boxes, s.method, s.shape, s.pad, s.pixel_blocks, videos, timed=True))
    lost = track_loss_frames(tracks, s.rules.max_age).withColumn("hint", F.lit("track_loss"))
    spent = scanned.groupBy("video_id").agg(F.sum("seconds").alias("detect_seconds")).join(painted.groupBy("video_id").agg(F.sum("seconds").alias("paint_seconds")), "video_id")
    timings = spent.select("video_id", (F.col("detect_seconds") + F.col("paint_seconds")).alias("seconds"), "detect_seconds").join(detect_calls(ids, tracks, moving, s.rules), "video_id")
    return Pass(painted.drop("seconds"), tracks, early.unionByName(lost), kept(timings))


def audit_pass(painted: DataFrame, videos: DataFrame, auditor: Factory, hints: DataFrame, min_face: float, s: Settings) -> DataFrame:
    """The report of painted frames: an independent detector's faces on a sample of them that are still visible."""
    sample = kept(sampling.select_qc_frames(videos, hints.select("video_id", "frame_idx"), s.interval, s.cap))
    checked = kept(audit.qc_frames(painted, sample))
    faces = kept(fr.detect_frames(checked, auditor, s.audit_threshold, "gt"))
    crops = crop_region(faces.join(videos.select("video_id", "width", "height"), "video_id"))
    seen = faces.join(fr.residual_visibility(checked, crops), ["video_id", "frame_idx", "det_idx"])
    hits, looked = kept(audit.find_leaks(seen, videos, min_face)), checked.select("video_id", "frame_idx")
    if s.fail_fast:
        hits, looked = audit.until_first_leak(hits, hits), audit.until_first_leak(looked, hits)
    return audit.qc_report(looked, hits, videos, sample, s.interval, s.cap)


def redact_and_audit(frames: DataFrame, videos: DataFrame, detector: Factory, auditor: Factory, s: Settings | None = None) -> Outcome:
    """Paint all frames, audit them, and (with s.retry) paint and audit once more the videos that need review.

    frames: video_id, frame_idx, image; videos: video_id, fps, width, height, nframes (null or 0: taken from the frames),
    all frames of one size within a video. The auditor is the second detector where the schedule asks for one. As many
    frames come out as went in; tracks are painted and counted in frames that exist. A second pass doesn't skip frames,
    and counts if it leaks no more than the first (see choose_retry). Seconds are those that workers spent on a video.
    Pixels move only where boxes are too many to be broadcast (see small_side); frames are stored after each pass.
    Frames of a video that is not listed come out unpainted; listed videos without frames have a report of 0 frames.
    """
    s = s or Settings()
    videos = kept(known_lengths(videos, frames))
    one = paint_pass(frames, videos, detector, auditor, s.schedule, s)
    painted, tracks, timings = one.frames, one.tracks, one.timings
    first = kept(audit_pass(painted, videos, auditor, one.hints, s.schedule.min_face, s))
    choice = kept(first.select("video_id", "status", "leak_count", F.lit(False).alias("retried"), F.lit(False).alias("retry_rejected")))
    again = first.filter("status = 'needs_review'").select("video_id")
    if s.retry is not None and not again.isEmpty():
        few = F.broadcast(again) if again.count() <= fr.MAX_BOXES else again
        tried = replace(s, rules=replace(s.rules, skip_after=None))
        own = videos.join(again, "video_id", "left_semi")
        two = paint_pass(frames.join(few, "video_id", "left_semi"), own, detector, auditor, s.retry, tried)
        second = kept(audit_pass(two.frames, own, auditor, two.hints, s.retry.min_face, tried))
        choice = kept(audit.choose_retry(first, second))
        better = kept(choice.filter("retried and not retry_rejected").select("video_id"))
        near = F.broadcast(better) if better.count() <= fr.MAX_BOXES else better

        def chosen(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.join(near, "video_id", "left_anti").unionByName(b.join(near, "video_id", "left_semi"))

        painted, tracks, timings = chosen(painted, two.frames), chosen(tracks, two.tracks), chosen(timings, two.timings)
    report = first.select("video_id", "frames_checked", "notes").join(choice, "video_id")
    return Outcome(painted, tracks, report, audit.run_metrics(frames.select("video_id", "frame_idx"), tracks, timings))
