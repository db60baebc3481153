"""Registered queries of tracking, uploads and jobs, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import detections as det, evaluation as ev, tracking
from veilframe.operators.sampling import normalize_videos
from veilframe.sources.derived import DETECTIONS, JOBS, UPLOADS, derived
from veilframe.sources.store import kept

from . import uploads as up
from .box_queries import BOXES, boxes, d, fold, sane
from .score_queries import truth


#: Two stages, skipping after as many empty frames as the reference's default.
ADAPTIVE = tracking.Rules(high=0.28, low=0.18, skip_after=36)


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_videos(derived(spark, sf_dir, "videos").withColumnRenamed("raw_fps", "fps"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plausible detections after suppression."""
    return det.nms(det.sane_boxes(boxes(spark, sf_dir)).select("video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "score"))


def track_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track(detections(spark, sf_dir), _videos(spark, sf_dir))


def track_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track(detections(spark, sf_dir).filter("score >= 0.28"), _videos(spark, sf_dir), tracking.Rules())


def track_adaptive_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    motion = derived(spark, sf_dir, "detections").filter("line = 7").select("video_id", "frame_idx").distinct()
    return tracking.track(detections(spark, sf_dir), _videos(spark, sf_dir), ADAPTIVE, motion=motion)


def segment_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = derived(spark, sf_dir, "detections").filter("score >= 0.9")
    return tracking.segment_video(dets.select("video_id", "frame_idx", "det_idx")).select("video_id", "frame_idx", "det_idx", "segment")


def segment_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the detections that track_two_stage uses."""
    dets = detections(spark, sf_dir).filter(F.col("score") >= tracking.TWO_STAGE.low)
    return tracking.segment_video(dets.select("video_id", "frame_idx", "det_idx")).select("video_id", "frame_idx", "det_idx", "segment")


def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track_summary(track_two_stage(spark, sf_dir))


def track_loss_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track_loss_frames(track_two_stage(spark, sf_dir))


def compare_trackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision on every 15th frame of raw boxes and of both trackers, which see all frames."""
    columns = ["config", "video_id", "frame_idx", "det_idx", "score", "x1", "y1", "x2", "y2"]
    found, videos = kept(detections(spark, sf_dir)), _videos(spark, sf_dir)
    good = found.filter("score >= 0.28")
    parts = good.withColumn("config", F.lit("raw")).select(*columns)
    for name, df in (("iou", tracking.track(good, videos, tracking.Rules())), ("two_stage", tracking.track(found, videos))):
        parts = parts.unionByName(df.withColumn("det_idx", F.col("track_id").cast("int")).withColumn("config", F.lit(name)).select(*columns))
    pred = kept(ev.sample_every(parts))
    none = pred.select("config").distinct().withColumn("seconds", F.lit(0.0))
    return ev.score_configs(ev.greedy_match(truth(spark, sf_dir), pred), pred, none).drop("ms_per_frame", "detect_fps", "frames")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "jobs")


def resolve_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.resolve_uploads(derived(spark, sf_dir, "uploads"), _jobs(spark, sf_dir))


def latest_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.latest_by_fingerprint(_jobs(spark, sf_dir)).select("job_id", "content_fp", "config_hash", "status")


def new_job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived(spark, sf_dir, "uploads").withColumn("input_path", F.concat(F.lit("in/"), "event_seq")).withColumn("upload_id", F.when(F.col("event_seq") % 3 > 0, F.col("upload_id")))
    made = events.select("event_seq", F.lit("create").alias("action"), F.concat(F.lit("n-"), "event_seq").alias("job_id"))
    rows = up.new_job_rows(events, made, F.timestamp_seconds(F.lit(0)))
    return rows.select("job_id", "upload_id", "content_fp", "config_hash", "input_path", "output_path", "status")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates from events: the status, the error or its removal, by turns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    turn = F.col("event_id") % 4
    return e.select(
        F.concat(F.lit("job-"), "user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(turn == 0, F.col("event_type")).alias("status"), F.when(turn == 1, F.lit("pass")).alias("qc_status"),
        F.when(turn == 2, F.concat(F.lit("e"), "event_id")).alias("error"), F.lit(None).cast("string").alias("metrics_json"), (turn == 3).alias("clear_error"),
    )


def apply_status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit(None).cast("string")
    jobs = _jobs(spark, sf_dir).withColumns({"qc_status": text, "error": F.when(F.col("status") == "failed", "old"), "metrics_json": text, "updated_at": F.timestamp_seconds(F.lit(0))})
    out = up.apply_status_updates(jobs, _updates(spark, sf_dir), F.timestamp_seconds(F.lit(60)))
    return out.select("job_id", "status", "qc_status", "error", (F.col("updated_at") > F.timestamp_seconds(F.lit(0))).alias("touched"))


def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.claim_batch(_jobs(spark, sf_dir), 25).select("job_id", "status")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("job_id", 5, 20).cast("long")
    json = F.to_json(F.struct((n % 90).cast("double").alias("throughput"), F.struct(F.when(n % 3 == 0, "needs_review").otherwise("pass").alias("status"), (n % 3 == 0).cast("long").alias("leak_count")).alias("qc")))
    return _jobs(spark, sf_dir).withColumns({"metrics_json": json, "error": F.when(n % 7 == 0, "lost"), "qc_status": F.lit(None).cast("string")})


def finish_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.finish_jobs(_metrics(spark, sf_dir)).select("job_id", "status", "qc_status")


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("job-"), "user_id").alias("job_id"))
    return up.job_status(_metrics(spark, sf_dir), ids)


def job_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.job_backlog(_jobs(spark, sf_dir))


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("content"))
    return docs.select("doc_id", up.content_fingerprint(docs, chunk=64).alias("fp"))


def content_fingerprint_1mib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints with the operator's own chunk: texts of up to 2 MiB differ wherever their first MiB or size does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("content"))
    return docs.select("doc_id", up.content_fingerprint(docs).alias("fp"))


_N = "cast(substring(job_id, 5) as bigint)"

QUERIES = {
    "track_two_stage": track_two_stage, "track_iou": track_iou, "track_adaptive_skip": track_adaptive_skip, "segment_video": segment_video, "segment_tracked": segment_tracked,
    "track_summary": track_summary, "track_loss_frames": track_loss_frames, "compare_trackers": compare_trackers,
    "resolve_uploads": resolve_uploads, "latest_by_fingerprint": latest_by_fingerprint, "new_job_rows": new_job_rows,
    "apply_status_updates": apply_status_updates, "claim_batch": claim_batch, "finish_jobs": finish_jobs, "job_status": job_status,
    "job_backlog": job_backlog, "content_fingerprint": content_fingerprint,
    "content_fingerprint_1mib": content_fingerprint_1mib,
}

ORACLES = {
    "segment_video": f"""select d.video_id, d.frame_idx, det_idx, segment from ({DETECTIONS}) d join (
        select video_id, frame_idx, sum(cut) over (partition by video_id order by frame_idx)::bigint as segment from (
          select video_id, frame_idx, coalesce((frame_idx - lag(frame_idx) over (partition by video_id order by frame_idx) >= 16)::int, 0) as cut
          from (select distinct video_id, frame_idx from ({DETECTIONS}) where score >= 0.9))) s on d.video_id = s.video_id and d.frame_idx = s.frame_idx where score >= 0.9""",
    "latest_by_fingerprint": f"select job_id, content_fp, config_hash, status from ({JOBS}) where status <> 'failed' qualify row_number() over (partition by content_fp, config_hash order by created_at desc, job_id) = 1",
    "new_job_rows": f"""select concat('n-', event_seq) as job_id, case when event_seq % 3 > 0 then upload_id else 'upload-' || substring(content_fp, 1, 16) end as upload_id, content_fp, config_hash,
        concat('in/', event_seq) as input_path, concat('outputs/n-', event_seq, '/redacted.mp4') as output_path, 'queued' as status from ({UPLOADS})""",
    "apply_status_updates": f"""select j.job_id, coalesce(s, j.status) as status, q as qc_status, case when e_seq is null then case when j.status = 'failed' then 'old' end else e end as error, u.job_id is not null as touched
      from ({JOBS}) j left join (select concat('job-', user_id) as job_id, arg_max(event_type, event_id) filter (where event_id % 4 = 0) as s, case when count(*) filter (where event_id % 4 = 1) > 0 then 'pass' end as q,
          max(event_id) filter (where event_id % 4 >= 2) as e_seq, case when max(event_id) filter (where event_id % 4 >= 2) % 4 = 2 then concat('e', max(event_id) filter (where event_id % 4 >= 2)) end as e
        from events group by 1) u on j.job_id = u.job_id""",
    "claim_batch": f"select job_id, 'processing' as status from (select * from ({JOBS}) where status = 'queued' order by created_at, job_id limit 25)",
    "finish_jobs": f"select job_id, case when {_N} % 7 = 0 then 'failed' when {_N} % 3 = 0 then 'needs_review' else 'completed' end as status, case when {_N} % 7 > 0 then case when {_N} % 3 = 0 then 'needs_review' else 'pass' end end as qc_status from ({JOBS})",
    "job_status": f"""select i.job_id, j.status is not null as known, j.status, case when j.status is not null then ({_N.replace('job_id', 'j.job_id')} % 3 = 0)::bigint end as leak_count,
        cast({_N.replace('job_id', 'j.job_id')} % 90 as double) as throughput from (select distinct concat('job-', user_id) as job_id from events) i left join ({JOBS}) j on i.job_id = j.job_id""",
    "job_backlog": f"select status, config_hash, count(*) as jobs from ({JOBS}) group by cube (status, config_hash)",
    "content_fingerprint": """select doc_id, sha256(case when n > 128 then encode(n::varchar) || b[1:64] || b[n // 2 + 1:n // 2 + 64] || b[greatest(0, n - 64) + 1:greatest(0, n - 64) + 64]
        else encode(n::varchar) || b[1:64] end) as fp from (select doc_id, encode(text) as b, octet_length(encode(text)) as n from documents)""",
    "content_fingerprint_1mib": """select doc_id, sha256(case when n > 2097152 then encode(n::varchar) || b[1:1048576] || b[n // 2 + 1:n // 2 + 1048576] || b[greatest(0, n - 1048576) + 1:greatest(0, n - 1048576) + 1048576]
        else encode(n::varchar) || b[1:1048576] end) as fp from (select doc_id, encode(text) as b, octet_length(encode(text)) as n from documents)""",
    "segment_tracked": f"""with found as materialized (select video_id, frame_idx, det_idx from ({fold(f"select * from ({BOXES}) where {sane()}", "det_idx")}) where score >= {d(0.18)})
      select f.video_id, f.frame_idx, det_idx, segment from found f join (
        select video_id, frame_idx, sum(cut) over (partition by video_id order by frame_idx)::bigint as segment from (
          select video_id, frame_idx, coalesce((frame_idx - lag(frame_idx) over (partition by video_id order by frame_idx) >= 16)::int, 0) as cut
          from (select distinct video_id, frame_idx from found))) s on f.video_id = s.video_id and f.frame_idx = s.frame_idx""",
}
