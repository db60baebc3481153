"""Registered queries over whole inputs: what a narrower query would leave out."""

import hashlib
import random

import numpy as np

from veilframe.jobs import frame_queries, job_queries, uploads as up
from veilframe.operators.tracking import TWO_STAGE, Live, run_frames


def fingerprint(data, chunk):
    n = len(data)
    parts = [data[:chunk]] if n <= 2 * chunk else [data[:chunk], data[n // 2 : n // 2 + chunk], data[max(0, n - chunk) :]]
    return hashlib.sha256(str(n).encode() + b"".join(parts)).hexdigest()


def test_fingerprints_of_whole_texts(spark, tmp_path):
    texts = ["a" * 100 + "b" + "c" * 399, "a" * 100 + "d" + "c" * 399, "x" * 70 + "1", "x" * 70 + "2", "short é", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r.fp for r in job_queries.QUERIES["content_fingerprint_1mib"](spark, str(tmp_path)).collect()}
    assert len(set(rows.values())) == len(texts)
    assert all(rows[i] == hashlib.sha256(str(len(b)).encode() + b).hexdigest() for i, b in enumerate(t.encode() for t in texts))


def test_fingerprint_branches_with_a_small_chunk(spark):
    data = [bytes(range(n)) for n in (0, 3, 4, 7, 8, 9, 20)]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "content binary")
    got = {bytes(r.content): r.fp for r in df.select("content", up.content_fingerprint(df, chunk=4).alias("fp")).collect()}
    assert got == {d: fingerprint(d, 4) for d in data}


def test_every_frame_is_painted_and_looked_at(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, f"l{i % 2}", [rnd.uniform(-0.2, 0.2) for _ in range(64)]) for i in range(7)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    d = str(tmp_path)
    plain = {r.frame_idx: bytes(r.image.data) for r in frame_queries.frames(spark, d).collect()}
    painted = {r.frame_idx: r.sha for r in frame_queries.redact_frames(spark, d).collect()}
    for i, data in plain.items():
        want = np.frombuffer(data, np.uint8).reshape(128, 128, 3).copy()
        want[i : i + 60, i : i + 40] = 0  # the second box begins 8 columns further and ends with the first
        assert painted[i] == hashlib.sha256(want.tobytes()).hexdigest() != hashlib.sha256(data).hexdigest()
    seen = frame_queries.residual_visibility(spark, d).collect()
    assert sorted((r.frame_idx, r.det_idx) for r in seen) == [(i, k) for i in range(7) for k in range(2)]
    hybrid = {r.frame_idx: r.luma for r in frame_queries.redact_hybrid(spark, d).collect()}
    assert set(hybrid) == set(range(7))


def test_skipping_starts_after_the_reference_number_of_empty_frames():
    dets = np.array([[0, 0, 40, 40, 0.9, 0]], float)
    for frame, found in ((13, [13]), (35, [35]), (37, []), (40, [40])):
        assert [f for f, out in run_frames(Live(), np.array([frame]), dets, 0, frame + 1, job_queries.ADAPTIVE) if len(out)] == found


def test_segments_of_what_is_tracked(spark):
    d = "/root/testdata/sf0.001"
    frames, want = {}, {}
    for r in job_queries.detections(spark, d).filter(f"score >= {TWO_STAGE.low}").collect():
        frames.setdefault(r.video_id, {}).setdefault(r.frame_idx, []).append(r.det_idx)
    for video, found in frames.items():
        segment, last = 0, None
        for f in sorted(found):
            segment += last is not None and f - last >= 16
            last = f
            want |= {(video, f, i): segment for i in found[f]}
    got = {(r.video_id, r.frame_idx, r.det_idx): r.segment for r in job_queries.QUERIES["segment_tracked"](spark, d).collect()}
    assert got == want and got


def test_tracking_streams_sorted_batches():
    import random

    import pandas as pd

    from veilframe.operators.tracking import Rules, run_batches

    rnd, rules = random.Random(5), Rules(max_age=3, skip_after=4, skip_every=7)
    rows = [(v, 0, f, i, 9.0 * i, 0.0, 9.0 * i + 40, 40.0, rnd.random(), 0, 60, f % 5 == 0) for v in "ab" for f in sorted(rnd.sample(range(64), 25)) for i in range(rnd.randrange(1, 4))]
    table = pd.DataFrame(rows, columns=["video_id", "segment", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "score", "first", "end", "moving"])
    whole = pd.concat(run_batches(iter([table]), rules), ignore_index=True)
    assert set(whole["video_id"]) == {"a", "b"}
    for n in (1, 2, 7):
        cut = pd.concat(run_batches((table.iloc[i : i + n] for i in range(0, len(table), n)), rules), ignore_index=True)
        pd.testing.assert_frame_equal(cut, whole)


def test_long_chains_of_uploads_take_rounds(spark):
    from veilframe.jobs import uploads

    chain = [(i, f"u{(i + 1) // 2}", f"c{i // 2}", "x") for i in range(26)]
    events = spark.createDataFrame(chain, "event_seq long, upload_id string, content_fp string, config_hash string")
    made = uploads.creators(events)
    assert sorted(r.event_seq for r in made.collect()) == list(range(0, 26, 2))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
