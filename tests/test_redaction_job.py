"""The whole job with stand-in detectors, reading and writing, upserts and work on jobs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.jobs import uploads as up
from veilframe.jobs.redaction import Schedule, Settings, redact_and_audit, retry_schedule
from veilframe.operators import audit, evaluation as ev, frames as fr
from veilframe.sources import store
from veilframe.sources.derived import FACE

VIDEOS = "video_id string, fps double, width int, height int, nframes long"


def images(spark, found):
    rows = [(v, f, {"origin": "", "height": a.shape[0], "width": a.shape[1], "nChannels": 3, "mode": 16, "data": a.tobytes()}) for v, f, a in found]
    return spark.createDataFrame(rows, fr.FRAME_SCHEMA)


def bright(level):
    def factory():
        def detect(f):
            ys, xs = np.nonzero(f[..., 0] > 200)
            return np.array([[xs.min(), ys.min(), xs.max() + 1, ys.max() + 1, level]]) if len(ys) else np.zeros((0, 5))

        return detect

    return factory


def face(at, seed):
    """A dark frame with a noisy bright square."""
    f = np.full((120, 160, 3), 20, np.uint8)
    f[40:90, at : at + 50] = np.random.default_rng(seed).integers(60, 256, (50, 50, 3))
    f[40, at], f[89, at + 49] = 255, 255
    return f


def test_no_faces(spark):
    frames = images(spark, [("v", i, np.full((240, 320, 3), (30, 40, 20), np.uint8)) for i in range(25)])
    videos = spark.createDataFrame([("v", 10.0, 320, 240, 25)], VIDEOS)
    out = redact_and_audit(frames, videos, bright(0.9), bright(0.9))
    assert out.frames.count() == 25 and out.painted.count() == 0
    r, m = out.report.first(), out.metrics.first()
    assert (r.status, r.leak_count, r.retried) == ("pass", 0, False) and (m.frames, m.faces_painted) == (25, 0)


def test_faces_are_painted_and_a_miss_is_painted_again(spark):
    """Of video w the first pass's threshold misses all; the audit sees that, and the retry paints them."""
    frames = images(spark, [(v, i, face(20 + 3 * i, i)) for v in "vw" for i in range(8)])
    videos = spark.createDataFrame([("v", 5.0, 160, 120, 8), ("w", 5.0, 160, 120, 8)], VIDEOS)

    plain = bright(1.0)

    def detector():
        inner = plain()

        def detect(f):
            rows = inner(f)
            rows[:, 4] = 0.9 if f[0, 0, 0] == 20 else 0.34
            marks = [[b[0] + u * (b[2] - b[0]) if k == 0 else b[1] + v * (b[3] - b[1]) for u, v in FACE for k in (0, 1)] for b in rows]
            return np.hstack([rows, np.array(marks).reshape(len(rows), 10)])

        return detect

    dim = frames.filter("video_id = 'w'").collect()
    marked = []
    for r in dim:
        a = fr.pixels(r.image.asDict()).copy()
        a[0, 0] = 21
        marked.append(("w", r.frame_idx, a))
    both = frames.filter("video_id = 'v'").unionByName(images(spark, marked))
    out = redact_and_audit(both, videos, detector, bright(0.9), Settings(Schedule(long_side=0, threshold=0.35, dark_below=0), interval=0.2, retry=retry_schedule(Schedule(dark_below=0), long_side=0)))
    assert out.frames.count() == 16 and out.frames.select("video_id", "frame_idx").distinct().count() == 16
    rows = {r.video_id: r for r in out.report.collect()}
    assert rows["v"].status == "pass" and not rows["v"].retried
    assert rows["w"].status == "pass" and rows["w"].retried and not rows["w"].retry_rejected
    assert {m.video_id: m.frames_with_faces for m in out.metrics.collect()} == {"v": 8, "w": 8}


def test_pixels_stay_where_they_are(spark):
    frames = images(spark, [("v", i, face(30, i)) for i in range(3)])
    boxes = spark.createDataFrame([("v", 1, 0, 30.0, 40.0, 80.0, 90.0, None)], "video_id string, frame_idx long, order int, x1 double, y1 double, x2 double, y2 double, landmarks array<struct<x:double,y:double>>")
    videos = spark.createDataFrame([("v", 5.0, 160, 120, 3)], VIDEOS)
    plan = fr.redact_frames(frames, boxes, videos=videos)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_frames_written_and_read(spark, tmp_path):
    from pyspark.ml.image import ImageSchema  # noqa: F401

    frames = images(spark, [("v", i, face(20, i)) for i in range(3)] + [("w", 0, face(10, 9))])
    fr.write_frames(frames, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert sorted((r.video_id, r.frame_idx, bytes(r.image.data)) for r in back.collect()) == sorted((r.video_id, r.frame_idx, bytes(r.image.data)) for r in frames.collect())


def test_image_files_as_frames(spark, tmp_path):
    import struct
    import zlib

    def png(a):
        raw = b"".join(b"\0" + row.tobytes() for row in a)

        def chunk(kind, data):
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "clip").mkdir()
    for i in (3, 12):
        (tmp_path / "clip" / f"{i}.png").write_bytes(png(np.full((4, 6, 3), (200, 100, i), np.uint8)))
    rows = {r.frame_idx: fr.pixels(r.image.asDict()) for r in fr.read_frames(spark, str(tmp_path)).collect()}
    assert set(rows) == {3, 12} and rows[12].shape == (4, 6, 3) and (rows[12] == (12, 100, 200)).all()


def test_dark_frames_are_stretched_and_others_left(spark):
    rng = np.random.default_rng(1)
    dark, light = (rng.integers(a, a + 20, (64, 64, 3)).astype(np.uint8) for a in (20, 150))
    out = {r.frame_idx: fr.pixels(r.image.asDict()) for r in fr.enhance_dark_frames(images(spark, [("v", 0, dark), ("v", 1, light)])).collect()}
    assert (out[1] == light).all() and out[0].mean() > dark.mean() and out[0].std() > dark.std()


def test_metrics_reports_and_jobs_written(spark, tmp_path):
    audit.write_metrics(spark.createDataFrame([("a", 3), ("b", 4)], "video_id string, frames long"), str(tmp_path / "m"))
    assert sorted((r.video, r.video_id, r.frames) for r in spark.read.json(str(tmp_path / "m")).collect()) == [("a", "a", 3), ("b", "b", 4)]
    for n in (1, 2):
        store.write_reports(spark.createDataFrame([("x", n)], "name string, n long"), str(tmp_path / "r"))
    lines = [json.loads(x) for p in (tmp_path / "r").glob("part-*.json") for x in p.read_text().splitlines()]
    assert lines == [{"name": "x", "n": 2}]
    jobs = job_table(spark, [("j1", "u1", "queued", 1)])
    store.write_jobs(jobs, str(tmp_path / "j"))
    assert store.read_jobs(spark, str(tmp_path / "j")).collect() == jobs.collect()


def job_table(spark, rows):
    made = spark.createDataFrame([(j, u, s, t) for j, u, s, t in rows], "job_id string, upload_id string, status string, t long")
    text = F.lit(None).cast("string")
    return made.select("job_id", "upload_id", F.lit("f").alias("content_fp"), F.lit("c").alias("config_hash"), F.lit("in").alias("input_path"), F.lit("out").alias("output_path"), "status", text.alias("qc_status"), text.alias("error"), F.timestamp_seconds("t").alias("created_at"), F.timestamp_seconds("t").alias("updated_at"), text.alias("metrics_json"))


def test_upsert(spark):
    jobs = job_table(spark, [("j1", "u1", "queued", 1), ("j2", "u2", "failed", 2)])
    rows = job_table(spark, [("j1", "u1", "processing", 3), ("j1", "u1", "completed", 4), ("j3", "u2", "queued", 5), ("j4", "u4", "queued", 6), ("j5", "u4", "queued", 7)])
    got = {r.job_id: r.status for r in up.upsert_jobs(jobs, rows).collect()}
    assert got == {"j1": "completed", "j2": "failed", "j4": "queued"}


def test_jobs_are_claimed_and_finished(spark, tmp_path):
    from veilframe.streaming.uploads import work_stream

    jobs = job_table(spark, [(f"j{i}", f"u{i}", "queued", i) for i in range(4)])
    jobs.write.parquet(str(tmp_path / "jobs" / "batch=0"))
    spark.range(1).write.parquet(str(tmp_path / "ticks"))

    def run(claimed):
        bad = F.col("job_id") == "j1"
        return claimed.filter("job_id <> 'j2'").withColumn("error", F.when(bad, "lost")).withColumn("metrics_json", F.when(~bad, F.lit('{"qc": {"status": "needs_review"}}')))

    work_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "ticks")), str(tmp_path / "jobs"), 3, run, str(tmp_path / "cp")).awaitTermination(120)
    got = {r.job_id: (r.status, r.qc_status) for r in store.read_jobs(spark, str(tmp_path / "jobs" / "batch=1")).collect()}
    assert got == {"j0": ("needs_review", "needs_review"), "j1": ("failed", None), "j2": ("processing", None), "j3": ("queued", None)}


def test_empty_upload_ids_are_named_by_content(spark):
    events = spark.createDataFrame([(0, "", "f1", "c"), (1, None, "f1", "c"), (2, "", "f2", "c")], "event_seq long, upload_id string, content_fp string, config_hash string")
    none = spark.createDataFrame([], "job_id string, upload_id string, content_fp string, config_hash string, status string, created_at long")
    got = {r.event_seq: r.action for r in up.resolve_uploads(events, none).collect()}
    assert got == {0: "create", 1: "reuse_upload", 2: "create"}


def test_common_frames_in_step(spark):
    a = spark.createDataFrame([("v", i) for i in range(10)], "video_id string, frame_idx long")
    videos = spark.createDataFrame([("v", 10)], "video_id string, nframes long")
    b = a.filter("frame_idx <> 6")
    assert sorted(r.frame_idx for r in ev.sample_common(a, b, videos, 5, in_step=True).collect()) == [0, 2, 4]
    assert sorted(r.frame_idx for r in ev.sample_common(a, b, videos, 5).collect()) == [0, 2, 4, 8]


def test_scratch_deletes_what_was_kept_within(spark, tmp_path):
    with store.scratch(spark):
        outer = store.kept(spark.range(3))
        with store.scratch(spark):
            inner, lasting = store.kept(spark.range(4)), store.kept(spark.range(5), lasting=True)
            assert inner.count() == 4
        with pytest.raises(Exception, match="(?i)not.*exist|path"):
            inner.count()
        assert outer.count() == 3 and lasting.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist|path"):
        lasting.count()


def test_only_files_that_may_hold_them_are_opened(spark, tmp_path):
    frames = images(spark, [(v, i, face(20, i)) for v in "ab" for i in range(6)]).repartitionByRange(4, "video_id", "frame_idx")
    fr.write_frames(frames, str(tmp_path / "f"))
    manifest = spark.read.parquet(str(tmp_path / "f/_manifest"))
    assert manifest.agg(F.sum("frames")).first()[0] == 12 and manifest.select("file").distinct().count() == 4
    part = fr.read_written(spark, str(tmp_path / "f"), "b", 4, 9)
    assert sorted((r.video_id, r.frame_idx) for r in part.collect()) == [("b", 4), ("b", 5)] and len(part.inputFiles()) < 4
    assert fr.read_written(spark, str(tmp_path / "f")).count() == 12 and fr.read_written(spark, str(tmp_path / "f"), "none").count() == 0


def test_bucketed_pixels_stay_whatever_the_boxes(spark, monkeypatch):
    """With more boxes than are broadcast, the plan shuffles boxes alone: nothing but the scan lies below the join on the frames' side."""
    frames = images(spark, [("v", i, face(30, i)) for i in range(6)] + [("w", 0, face(10, 9))])
    boxes = spark.createDataFrame([("v", i, 0, 30.0, 40.0, 80.0, 90.0, None) for i in (1, 4)], "video_id string, frame_idx long, order int, x1 double, y1 double, x2 double, y2 double, landmarks array<struct<x:double,y:double>>")
    videos = spark.createDataFrame([("v", 5.0, 160, 120, 6), ("w", 5.0, 160, 120, 1)], VIDEOS)
    want = {(r.video_id, r.frame_idx): bytes(r.image.data) for r in fr.redact_frames(frames, boxes, videos=videos).collect()}
    stored = fr.store_frames(frames, "stored_frames", 3)
    try:
        monkeypatch.setattr(fr.small_side, "__defaults__", (0,))
        out = fr.redact_frames(stored, boxes, videos=videos)
        assert {(r.video_id, r.frame_idx): bytes(r.image.data) for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        frames_side = plan[plan.index("ShuffledHashJoin"):].split("stored_frames")[0]
        assert "Exchange" not in frames_side and "SortMergeJoin" not in plan and "Bucketed: true" in plan
        seen = fr.residual_visibility(stored, boxes.selectExpr("video_id", "frame_idx", "order as det_idx", "30 as cx1", "40 as cy1", "80 as cx2", "90 as cy2"))
        assert seen.count() == 2
    finally:
        spark.sql("drop table if exists stored_frames")
