"""Scores of detectors and trackers: one-to-one matching per frame, recall by size, precision-recall curves, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.boxes import BUCKETS, Box, iou, size_bucket

FRAME = ["video_id", "frame_idx"]
#: Score thresholds of a curve: 0.05, 0.10 ... 0.95.
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]
BUCKET_NAMES = [*(n for n, _ in BUCKETS), "large"]


def sample_every(df: DataFrame, every: int = 15) -> DataFrame:
    return df.filter(F.col("frame_idx") % every == 0)


def sample_common(source: DataFrame, output: DataFrame, videos: DataFrame, max_frames: int, in_step: bool = False) -> DataFrame:
    """Frames (video_id, frame_idx) that both have, at every nframes // max_frames-th index, the first max_frames of them.

    With in_step, for tables of all frames of two videos, a video counts up to its first frame that only one side has;
    without, for tables that list some frames, those of one side alone are passed over.
    """
    most = max(1, max_frames)
    step = F.greatest(F.lit(1), F.floor(F.col("nframes") / most)).cast("long")
    both = source.select(*FRAME).distinct().join(output.select(*FRAME).distinct(), FRAME)
    due = both.join(videos.select("video_id", step.alias("step")), "video_id").filter(F.col("frame_idx") % F.col("step") == 0)
    if in_step:
        sides = source.select(*FRAME, F.lit(1).alias("side")).unionByName(output.select(*FRAME, F.lit(2).alias("side"))).groupBy(*FRAME).agg(F.min("side").alias("a"), F.max("side").alias("b"))
        stop = sides.filter("a = b").groupBy("video_id").agg(F.min("frame_idx").alias("stop"))
        due = due.join(stop, "video_id", "left").filter("stop is null or frame_idx < stop")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx"))
    return due.withColumn("rank", rank).filter(F.col("rank") <= most).select(*FRAME)


def greedy_match(truth: DataFrame, pred: DataFrame, threshold: float = 0.2, configs: Sequence[str] | None = None) -> DataFrame:
    """Truth boxes with what they matched: config, frame, gt_idx, corners, hit, pred_idx, pred_score.

    In each (config, frame), truth in the order of det_idx takes the first unused prediction, by descending score then
    det_idx, whose IoU is at least threshold. pred has a config column; truth repeats for every config of pred, also in
    frames without a prediction; configs names them, or else pred is read for them first: store it if it is dear. One
    shuffle of each side by frame; a frame's boxes meet in one row.
    """
    names = sorted(r["config"] for r in pred.select("config").distinct().collect()) if configs is None else configs
    every = F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("config")
    gts = truth.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("det_idx", "x1", "y1", "x2", "y2"))).alias("gts")).select("*", every)
    preds = pred.groupBy("config", *FRAME).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "det_idx", "x1", "y1", "x2", "y2"))).alias("preds"))
    both = gts.join(preds, ["config", *FRAME], "left")
    none = F.array().cast("array<int>")
    indexes = F.when(F.size("preds") > 0, F.sequence(F.lit(0), F.size("preds") - 1)).otherwise(none)

    def take(acc: Column, g: Column) -> Column:
        free = F.filter(indexes, lambda j: ~F.array_contains(acc, j) & (iou(Box.of(g), Box.of(F.get("preds", j))) >= threshold))
        return F.array_append(acc, F.coalesce(F.get(free, F.lit(0)), F.lit(-1)))

    matched = both.withColumn("taken", F.aggregate("gts", none, take))
    rows = matched.select("config", *FRAME, F.posexplode("gts").alias("i", "g"), "preds", "taken").withColumn("j", F.get("taken", F.col("i")))
    p = F.when(F.col("j") >= 0, F.get("preds", F.col("j")))
    return rows.select("config", *FRAME, F.col("g.det_idx").alias("gt_idx"), "g.x1", "g.y1", "g.x2", "g.y2", (F.col("j") >= 0).alias("hit"), p["det_idx"].alias("pred_idx"), (-p["s"]).alias("pred_score"))


def score_configs(matches: DataFrame, pred: DataFrame, timings: DataFrame) -> DataFrame:
    """Recall, precision and speed for each config; timings: config, seconds, one row for each frame."""
    hits = matches.groupBy("config").agg(F.count(F.lit(1)).alias("gt_faces"), F.count_if("hit").alias("matched"))
    preds = pred.groupBy("config").agg(F.count(F.lit(1)).alias("pred_faces"))
    times = timings.groupBy("config").agg(F.count(F.lit(1)).alias("frames"), F.sum("seconds").alias("seconds"))
    rows = times.join(hits, "config", "left").join(preds, "config", "left").na.fill(0, ["gt_faces", "matched", "pred_faces"])
    ms = F.lit(1000.0) * F.col("seconds") / F.greatest(F.lit(1), F.col("frames"))
    return rows.select(
        "config", (F.col("matched") / F.greatest(F.lit(1), F.col("gt_faces"))).alias("recall"), (F.col("matched") / F.greatest(F.lit(1), F.col("pred_faces"))).alias("precision"),
        "gt_faces", "pred_faces", "matched", (F.col("gt_faces") - F.col("matched")).alias("missed"), ms.alias("ms_per_frame"), F.when(ms > 0, F.lit(1000.0) / ms).alias("detect_fps"), "frames",
    )


def recall_by_size(matches: DataFrame) -> DataFrame:
    """Recall for each (config, bucket) and in total (bucket null); a bucket without truth has a null recall."""
    sums = matches.withColumn("bucket", size_bucket(Box.of())).rollup("config", "bucket").agg(F.count(F.lit(1)).alias("gt"), F.count_if("hit").alias("tp"), F.grouping_id().alias("level"))
    names = F.explode(F.array(*map(F.lit, BUCKET_NAMES), F.lit(None).cast("string")))
    shown = matches.select("config").distinct().select("config", names.alias("bucket"))
    found = sums.filter("level < 3").select(F.col("config").alias("c"), F.col("bucket").alias("b"), "gt", "tp")
    rows = shown.join(found, (F.col("config") == F.col("c")) & F.col("bucket").eqNullSafe(F.col("b")), "left").na.fill(0, ["gt", "tp"])
    return rows.select("config", "bucket", "gt", "tp", F.when(F.col("gt") > 0, F.col("tp") / F.col("gt")).alias("recall"))


def risk_gate(frames: DataFrame, base: DataFrame, motion_over: float = 18.0, side_under: float = 24.0) -> DataFrame:
    """frames (dark, motion) with `risky`: dark, moving, or with a base box whose shorter side is under side_under."""
    tiny = base.groupBy(*FRAME).agg(F.bool_or(Box.of().min_side < side_under).alias("tiny"))
    risky = F.col("dark") | F.coalesce(F.col("motion") > motion_over, F.lit(False)) | F.coalesce("tiny", F.lit(False))
    return frames.join(tiny, FRAME, "left").select(*FRAME, risky.alias("risky"))


def risk_rates(gated: DataFrame) -> DataFrame:
    return gated.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("risky").alias("risk_frames"), F.avg(F.col("risky").cast("double")).alias("risk_rate"))


def pr_counts(matches: DataFrame, pred: DataFrame, thresholds: Sequence[float] = tuple(THRESHOLDS)) -> DataFrame:
    """For each (config, threshold): predictions and matches at or above it, and the shared truth total.

    Predictions are matched by descending score, so those above a threshold are a prefix, on which greedy matching takes
    the same pairs as alone: one matching serves all thresholds. Each side is summed before it meets the thresholds.
    """

    def above(df: DataFrame, score: str, name: str) -> DataFrame:
        sums = [F.count_if(F.col(score) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)]
        wide = df.groupBy("config").agg(*sums)
        rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias(name)) for i, t in enumerate(thresholds))))
        return wide.select("config", rows.alias("r")).select("config", "r.*")

    gt = matches.groupBy("config").agg(F.count(F.lit(1)).alias("gt"))
    return above(pred, "score", "npred").join(above(matches.filter("hit"), "pred_score", "tp"), ["config", "threshold"], "left").join(gt, "config", "left").na.fill(0, ["tp", "gt"])


def pr_points(counts: DataFrame) -> DataFrame:
    """counts with recall and precision (1 without predictions)."""
    return counts.withColumns({"recall": F.col("tp") / F.greatest(F.lit(1), F.col("gt")), "precision": F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(1.0))})


def average_precision(counts: DataFrame) -> DataFrame:
    """Area under the precision envelope of each config: trapezoids over ascending recall, ties by ascending threshold."""
    order = Window.partitionBy("config").orderBy("recall", "threshold")
    points = pr_points(counts).withColumn("envelope", F.max("precision").over(order.rowsBetween(0, Window.unboundedFollowing)))
    area = (F.col("recall") - F.lag("recall").over(order)) * (F.col("envelope") + F.lag("envelope").over(order)) / 2
    return points.withColumn("area", area).groupBy("config").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("ap"))


def operating_points(counts: DataFrame) -> DataFrame:
    """Best recall at given precisions and best precision at given recalls; null where none reaches them."""
    points = pr_points(counts)

    def best(what: str, at: str, least: float) -> Column:
        return F.max(F.when(F.col(at) >= least, F.col(what)))

    at_p = [best("recall", "precision", p).alias(f"recall_at_p{int(p * 100)}") for p in (0.5, 0.6, 0.7)]
    at_r = [best("precision", "recall", r).alias(f"precision_at_r{int(r * 100)}") for r in (0.95, 0.97)]
    return points.groupBy("config").agg(F.max("recall").alias("max_recall"), *at_p, *at_r)


def privacy_eval(truth: DataFrame, visible: DataFrame, frames: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Per video: frames, truth boxes, visible boxes, truth that no visible box overlaps by threshold, and their rates.

    frames are those sampled. Several truth boxes may share a visible box: an anti join within the frame.
    """
    gt = truth.join(frames, FRAME, "left_semi").select(*FRAME, "det_idx", "x1", "y1", "x2", "y2")
    left = visible.join(frames, FRAME, "left_semi").select(*FRAME, F.struct("x1", "y1", "x2", "y2").alias("v"))
    same = (F.col("g.video_id") == F.col("o.video_id")) & (F.col("g.frame_idx") == F.col("o.frame_idx"))
    g = Box(*(F.col(f"g.{c}") for c in Box._fields))
    clear = gt.alias("g").join(left.alias("o"), same & (iou(g, Box.of(F.col("o.v"))) >= threshold), "left_anti")
    counts = [frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"))]
    counts += [df.groupBy("video_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((gt, "gt_faces"), (left, "visible_faces"), (clear, "covered"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, "video_id", "left")
    out = out.na.fill(0)
    per = F.greatest(F.lit(1), F.col("gt_faces"))
    return out.withColumns({"residual_rate": F.col("visible_faces") / per, "coverage_rate": F.col("covered") / per})


def latency_summary(timings: DataFrame, warm_up: int = 8) -> DataFrame:
    """Mean milliseconds and calls per second of each model (model, seq, ms) without its first warm_up rows."""
    rank = F.row_number().over(Window.partitionBy("model").orderBy("seq"))
    ms = timings.withColumn("rank", rank).filter(F.col("rank") > warm_up).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.avg("ms").alias("mean_ms"))
    return ms.withColumn("fps", F.when(F.col("mean_ms") > 0, F.lit(1000.0) / F.col("mean_ms")))


def merge_report(old: DataFrame, new: DataFrame, variants: DataFrame) -> DataFrame:
    """A report's rows (tracker, ...), those of re-run variants (tracker) replaced by new ones."""
    names = variants.select("tracker").distinct()
    return old.join(names, "tracker", "left_anti").unionByName(new.join(names, "tracker", "left_semi"))
