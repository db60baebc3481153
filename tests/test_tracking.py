"""Trackers: identity, coasting, expiry, recovery, and segments against one pass."""

import math
import random

import numpy as np
import pytest

from veilframe.operators.tracking import Live, Rules, run_frames, track, track_summary

DETS = "video_id string, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double"


def table(spark, found):
    return spark.createDataFrame([("v", f, i, float(x), float(y), float(x + 40), float(y + 40), s) for i, (f, x, y, s) in enumerate(found)], DETS)


def videos(spark, n):
    return spark.createDataFrame([("v", n)], "video_id string, nframes long")


def by_frame(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.frame_idx, []).append(r)
    return out


def test_jitter_keeps_the_id(spark):
    rules = Rules(iou_match=0.2, max_age=8, smooth=0.4)
    out = by_frame(track(table(spark, [(0, 100, 80, 0.9), (1, 108, 84, 0.9)]), videos(spark, 2), rules))
    assert [len(out[f]) for f in (0, 1)] == [1, 1] and out[0][0].track_id == out[1][0].track_id


def test_coasting_moves_from_the_second_miss(spark):
    rules = Rules(smooth=0.0, velocity_smooth=0.0)
    out = by_frame(track(table(spark, [(0, 50, 50, 0.9), (1, 60, 50, 0.9)]), videos(spark, 4), rules))
    assert [len(out[f]) for f in (2, 3)] == [1, 1]
    assert out[2][0].x1 == 60 and out[3][0].x1 == 70


def test_expiry(spark):
    out = by_frame(track(table(spark, [(0, 50, 50, 0.9)]), videos(spark, 9), Rules(max_age=5)))
    assert all(len(out[f]) == 1 for f in range(6)) and 6 not in out


def test_low_scores_recover_a_track(spark):
    rules = Rules(high=0.5, low=0.15)
    out = by_frame(track(table(spark, [(0, 100, 80, 0.9), (1, 108, 84, 0.22)]), videos(spark, 2), rules))
    assert out[0][0].track_id == out[1][0].track_id and out[1][0].score == 0.22


@pytest.mark.parametrize("rules", [Rules(max_age=4), Rules(max_age=4, high=0.5, low=0.2)])
def test_segments_equal_one_pass(spark, rules):
    rnd = random.Random(7)
    frames = sorted({f for base in (0, 30, 41, 80) for f in rnd.sample(range(base, base + 8), 6)})
    found = [(f, rnd.uniform(0, 150), rnd.uniform(0, 150), rnd.choice([0.1, 0.3, 0.6, 0.9])) for f in frames for _ in range(rnd.randrange(1, 4))]
    df, v = table(spark, found).repartition(3), videos(spark, 120)
    a, b = (sorted(map(tuple, track(df, v, rules, segmented=s).collect())) for s in (True, False))
    assert a == b and a


def test_empty_stretches_skip_detections():
    rules = Rules(skip_after=3, skip_every=4)
    dets = np.array([[0, 0, 40, 40, 0.9, 0]], float)
    seen = [f for f, out in run_frames(Live(), np.array([5]), dets, 0, 6, rules) if len(out)]
    assert seen == []
    assert [f for f, out in run_frames(Live(), np.array([5]), dets, 0, 6, rules, frozenset([5])) if len(out)] == [5]


def test_summary(spark):
    s = track_summary(track(table(spark, [(0, 0, 0, 0.9), (1, 2, 0, 0.9), (40, 0, 0, 0.9)]), videos(spark, 60))).first()
    assert s.tracks == 2 and s.boxes_painted == s.frames_with_faces


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from veilframe.operators.tracking import TWO_STAGE
    from veilframe.streaming.tracks import track_stream

    rnd = random.Random(3)
    found = [(f, 5 * f + rnd.uniform(0, 6), 20.0, rnd.choice([0.2, 0.5, 0.9])) for f in range(20) if f % 6 != 5]
    dets = table(spark, found)
    cells = F.struct("x1", "y1", "x2", "y2", "score", "det_idx")
    frames = spark.range(20).withColumnRenamed("id", "frame_idx").withColumn("video_id", F.lit("v")).join(dets.groupBy("video_id", "frame_idx").agg(F.collect_list(cells).alias("dets")), ["video_id", "frame_idx"], "left")
    frames = frames.withColumn("dets", F.coalesce("dets", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,score:double,det_idx:int>>")))
    for n, part in enumerate(("frame_idx % 2 = 1", "frame_idx % 2 = 0", "frame_idx = 3")):
        frames.filter(part).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    for n in range(3):
        for f in (tmp_path / f"in{n}").glob("part-*.parquet"):
            (tmp_path / "src").mkdir(exist_ok=True)
            f.rename(tmp_path / "src" / f"{n}.parquet")
            import os

            os.utime(tmp_path / "src" / f"{n}.parquet", (n + 1, n + 1))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    query = track_stream(stream).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.table("tracks")
    columns = ["frame_idx", "track_id", "x1", "score", "hits", "time_since_update"]
    got = sorted(map(tuple, out.filter("not rejected").select(columns).collect()))
    want = sorted(map(tuple, track(dets, videos(spark, 20), TWO_STAGE).filter("frame_idx < 20").select(columns).collect()))
    assert got == want
    assert [r.frame_idx for r in out.filter("rejected").collect()] == [3]


class Plain:
    """A tracker frame by frame, pair by pair, with dicts: the rule in its plainest form."""

    def __init__(self, rules):
        self.rules, self.tracks, self.born = rules, [], 0

    def _pairs(self, tracks, dets):
        out = []
        for t in tracks:
            a = t["box"]
            for d in dets:
                b = d["box"]
                w = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w
                if both > 0 and w / both >= self.rules.iou_match:
                    out.append((w / both, t, d))
                    continue
                diagonal = math.hypot(a[2] - a[0], a[3] - a[1])
                apart = math.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
                if diagonal > 1 and apart <= self.rules.center_frac * max(diagonal, 1):
                    out.append((0.15 + 0.01 * (1 - apart / (diagonal + 1e-6)), t, d))
        return sorted(out, key=lambda p: -p[0])

    def step(self, dets):
        r = self.rules
        for t in self.tracks:
            if t["missed"]:
                t["box"] = [x + v for x, v in zip(t["box"], t["v"] * 2)]
            t["missed"] += 1
        stages = [dets] if r.high is None else [[d for d in dets if d["score"] >= r.high], [d for d in dets if r.low <= d["score"] < r.high]]
        free, new = list(self.tracks), []
        for nth, stage in enumerate(stages):
            open_ = list(stage)
            for _, t, d in self._pairs(free, stage):
                if any(t is x for x in free) and any(d is x for x in open_):
                    free, open_ = [x for x in free if x is not t], [x for x in open_ if x is not d]
                    old = t["box"]
                    t["box"] = [r.smooth * o + (1 - r.smooth) * x for o, x in zip(old, d["box"])]
                    moved = [(t["box"][i] + t["box"][i + 2]) / 2 - (old[i] + old[i + 2]) / 2 for i in (0, 1)]
                    t["v"] = [r.velocity_smooth * v + (1 - r.velocity_smooth) * m for v, m in zip(t["v"], moved)]
                    t.update(hits=t["hits"] + 1, missed=0, score=d["score"])
            new = open_ if nth == 0 else new
        self.tracks = [t for t in self.tracks if not (any(t is x for x in free) and t["missed"] > r.max_age)]
        for d in new:
            self.born += 1
            self.tracks.append({"id": self.born, "box": list(d["box"]), "v": [0.0, 0.0], "hits": 1, "missed": 0, "score": d["score"]})
        return [(t["id"], *(round(x, 6) for x in t["box"]), t["score"], t["hits"], t["missed"]) for t in self.tracks if t["hits"] >= r.min_hits or t["missed"] == 0]


@pytest.mark.parametrize("rules", [Rules(max_age=3), Rules(max_age=4, high=0.5, low=0.2), Rules(max_age=2, min_hits=2, high=0.5, low=0.2), Rules(max_age=3, skip_after=5, skip_every=3, high=0.5, low=0.2)])
def test_against_a_plain_tracker(spark, rules):
    rnd = random.Random(5)
    found, motion, nframes = [], [], {"a": 60, "b": 90, "c": 0}
    for v in nframes:
        for f in range(70):
            if f % 30 < 14 or (rules.skip_after and f % 30 == 23):
                found += [(v, f, i, x := rnd.uniform(0, 200), y := rnd.uniform(0, 150), x + rnd.uniform(10, 60), y + rnd.uniform(10, 60), rnd.choice([0.1, 0.3, 0.6, 0.9])) for i in range(rnd.randrange(0, 5))]
            if rnd.random() < 0.3:
                motion.append((v, f))
    df = spark.createDataFrame(found, DETS).repartition(3)
    listed = spark.createDataFrame([("a", 60), ("b", 90)], "video_id string, nframes long")
    moves = spark.createDataFrame(motion, "video_id string, frame_idx long") if rules.skip_after else None
    columns = ["track_id", "x1", "y1", "x2", "y2", "score", "hits", "time_since_update"]
    got = sorted((r.video_id, r.frame_idx, *(round(x, 6) for x in (r[c] for c in columns))) for r in track(df, listed, rules, motion=moves).collect())
    want = []
    for v, n in nframes.items():
        usable = [r for r in found if r[0] == v and (rules.low is None or r[7] >= rules.low)]
        plain, empty = Plain(rules), 0
        for f in range(n or max(r[1] for r in usable) + 1):
            skipped = rules.skip_after and empty >= rules.skip_after and not plain.tracks and f % rules.skip_every and (v, f) not in motion
            out = plain.step([] if skipped else [{"box": r[3:7], "score": r[7]} for r in usable if r[1] == f])
            empty = 0 if out else empty + 1
            want += [(v, f, *o) for o in out]
    assert got == sorted(want) and len(got) > 100


def long_video(rng, kind, n):
    """Detections of n frames without a gap: faces that come and go, or ones that stay throughout."""
    out, faces = [], {}
    for f in range(n):
        if len(faces) < 3 and rng.random() < 0.1:
            faces[max(faces, default=0) + 1] = [rng.uniform(0, 600), rng.uniform(0, 300), rng.randrange(20, 60) if kind == "short" else 10**9]
        for k, face in list(faces.items()):
            face[2] -= 1
            face[0] += rng.uniform(-3, 3)
            if face[2] < 0:
                del faces[k]
        boxes = [(x, y) for x, y, _ in faces.values() if rng.random() < 0.9] or ([(900.0, 5.0)] if f % 10 == 0 else [])
        out += [(f, x, y, rng.choice([0.2, 0.3, 0.6, 0.9])) for x, y in boxes]
    return out


@pytest.mark.parametrize(("kind", "rules"), [("short", Rules(max_age=4, high=0.28, low=0.18)), ("long", Rules(max_age=4)), ("short", Rules(max_age=3, min_hits=3, skip_after=6, skip_every=3))])
def test_parts_equal_one_pass(spark, kind, rules):
    rng = random.Random(8)
    found = long_video(rng, kind, 1000)
    if rules.skip_after:
        found = [r for r in found if not 300 <= r[0] < 620 or r[0] % 41 == 0]
    df, v = table(spark, found).repartition(3), videos(spark, 1010)
    a, b = (sorted(map(tuple, track(df, v, rules, span=s).collect())) for s in (120, 10_000))
    assert a == b and len(a) > 800


def test_parts_settle_at_once_where_tracks_end(spark):
    """Seams inside of which all tracks were born agree in the first round; none is left to one pass."""
    from pyspark.sql import functions as F

    from veilframe.operators.seams import track_in_parts

    rules = Rules(max_age=4)
    df = table(spark, long_video(random.Random(4), "short", 900)).withColumns({"segment": F.lit(0).cast("long"), "moving": F.lit(False), "first": F.lit(0).cast("long"), "end": F.lit(900).cast("long")})
    tracked, left = track_in_parts(df, rules, span=200, rounds=2)
    assert left.count() == 0 and tracked.count() > 500
    none, rest = track_in_parts(table(spark, [(f, 5.0 + f % 7, 5.0, 0.9) for f in range(700)]).withColumns({"segment": F.lit(0).cast("long"), "moving": F.lit(False), "first": F.lit(0).cast("long"), "end": F.lit(700).cast("long")}), Rules(max_age=4, smooth=0.999), span=200, rounds=0)
    assert rest.count() == 1 and none.count() == 0  # so slow to settle: left to one pass


def test_tracks_are_made_once_and_carry_landmarks(spark):
    from pyspark.sql import functions as F

    dets = table(spark, [(0, 100, 80, 0.9), (1, 104, 80, 0.9), (3, 108, 80, 0.9)])
    dets = dets.withColumn("landmarks", F.array(F.struct((F.col("x1") + 5).alias("x"), F.col("y1").alias("y"))))
    df = track(dets, videos(spark, 6))
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString() and "MapInPandas" not in df._jdf.queryExecution().toString()
    marks = {r.frame_idx: r.landmarks[0].x for r in df.collect()}
    assert marks == {0: 105, 1: 109, 2: 109, 3: 113, 4: 113, 5: 113}


def test_stream_ends(spark, tmp_path):
    """Waiting frames are taken at a video's last one, which removes its state; others wait."""
    from veilframe.streaming.tracks import track_stream

    d = [(100.0, 80.0, 140.0, 120.0, 0.9, 0)]
    rows = [("v", 2, d, False), ("v", 0, d, False), ("w", 5, d, False), ("v", 1, d, False), ("v", 3, [], True)]
    spark.createDataFrame(rows, "video_id string, frame_idx long, dets array<struct<x1:double,y1:double,x2:double,y2:double,score:double,det_idx:int>>, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id string, frame_idx long, dets array<struct<x1:double,y1:double,x2:double,y2:double,score:double,det_idx:int>>, last boolean").parquet(str(tmp_path / "in"))
    query = track_stream(stream).writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.video_id, r.frame_idx, r.hits) for r in spark.table("ends").collect())
    assert got == [("v", 0, 1), ("v", 1, 2), ("v", 2, 3), ("v", 3, 3)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


@pytest.mark.parametrize("rules", [Rules(max_age=3), Rules(max_age=4, high=0.5, low=0.2), Rules(max_age=2, min_hits=2, high=0.5, low=0.2)])
def test_segments_that_go_forward_together(rules):
    """Bit for bit what one segment after another gives, however batches are cut."""
    import pandas as pd

    from veilframe.operators.tracking import run_batches, run_together

    rnd = random.Random(12)
    rows = []
    for v in "abcd":
        for segment, (first, n) in enumerate([(0, 20), (40, 1), (60, 30)]):
            found = [(f, i) for f in range(first, first + n) if rnd.random() < 0.8 for i in range(rnd.randrange(1, 5))] or [(first, 0)]
            end = rnd.choice([found[-1][0] + 1, found[-1][0] + 9, found[-1][0] - 2])
            for f, i in found:
                x, y = rnd.uniform(0, 120), rnd.uniform(0, 90)
                rows.append((v, segment, f, i, x, y, x + rnd.uniform(10, 60), y + rnd.uniform(10, 60), rnd.choice([0.3, 0.6, 0.9]), found[0][0], end, False))
    table = pd.DataFrame(rows, columns=["video_id", "segment", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "score", "first", "end", "moving"])
    keys = ["video_id", "segment", "frame_idx", "track_id"]
    want = pd.concat(run_batches(iter([table]), rules)).sort_values(keys, ignore_index=True)
    for n in (7, 100, 10_000):
        got = pd.concat(run_together((table.iloc[i : i + n] for i in range(0, len(table), n)), rules)).sort_values(keys, ignore_index=True)
        pd.testing.assert_frame_equal(got[list(want.columns)], want)


def test_tracked_rows_shuffle_no_more_after_tracking(spark, monkeypatch):
    from veilframe.operators import tracking

    rows = [(f"v{v}", f, 0, 10.0 + f, 10.0, 50.0 + f, 60.0, 0.9) for v in range(3) for f in (0, 1, 2, 40, 41, 90)]
    dets = spark.createDataFrame(rows, "video_id string, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double")
    videos = spark.createDataFrame([(f"v{v}", 120) for v in range(3)], "video_id string, nframes long")
    out = tracking.track(dets, videos)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    monkeypatch.setattr(tracking, "MAX_SEGMENTS", 0)
    joined = tracking.track(dets, videos)
    assert "strategy=broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, joined.collect()))


@pytest.mark.parametrize("rules", [Rules(max_age=3, high=0.28, low=0.18, skip_after=4, skip_every=3), Rules(max_age=2, min_hits=3, skip_after=0, skip_every=4)])
def test_skipping_goes_forward_together(rules):
    """Bit for bit what one video after another gives, with long empty stretches, late first frames and frames that move."""
    import pandas as pd

    from veilframe.operators.tracking import run_batches, run_together

    rnd, rows = random.Random(31), []
    for v in "abcdef":
        frames = [f for f in range(rnd.randrange(40), 400) if (f // 25) % 3 == ord(v) % 3 or f % 17 == 0]
        end = rnd.choice([frames[-1] + 1, frames[-1] + 30, 300])
        for f in frames:
            moving = rnd.random() < 0.2
            for i in range(rnd.randrange(1, 4)):
                x, y = rnd.uniform(0, 120), rnd.uniform(0, 90)
                rows.append((v, 0, f, i, x, y, x + rnd.uniform(10, 60), y + rnd.uniform(10, 60), rnd.choice([0.2, 0.3, 0.9]), frames[0], end, moving))
    table = pd.DataFrame(rows, columns=["video_id", "segment", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "score", "first", "end", "moving"])
    keys = ["video_id", "segment", "frame_idx", "track_id"]
    want = pd.concat(run_batches(iter([table]), rules)).sort_values(keys, ignore_index=True)
    assert len(want) < len(pd.concat(run_batches(iter([table.assign(moving=True)]), rules)))  # some are skipped
    for n in (7, 10_000):
        got = pd.concat(run_together((table.iloc[i : i + n] for i in range(0, len(table), n)), rules)).sort_values(keys, ignore_index=True)
        pd.testing.assert_frame_equal(got[list(want.columns)], want)


@pytest.mark.parametrize("most", [64, 3])
def test_coasting_is_stored_as_one_row(spark, monkeypatch, most):
    """The largest table that tracking keeps has a row for each hit; the frames in between are made from it."""
    from veilframe.operators import tracking

    stored, kept = [], tracking.kept
    monkeypatch.setattr(tracking, "kept", lambda df, *a, **k: stored.append(out := kept(df, *a, **k)) or out)
    monkeypatch.setattr(tracking, "MOST_COASTING", most)
    rows = [(0, 100, 80, 0.9), (2, 103.7, 80.3, 0.9), (20, 300, 10, 0.9)]
    out = track(table(spark, rows), videos(spark, 60), Rules(max_age=9))
    got = sorted((r.frame_idx, r.track_id, r.x1, r.y1, r.x2, r.y2, r.score, r.det_idx, r.hits, r.time_since_update) for r in out.collect())
    live, want = Live(), []
    dets = np.array([[x, y, x + 40, y + 40, s, i] for i, (_, x, y, s) in enumerate(rows)], float)
    for f, emitted in run_frames(live, np.array([r[0] for r in rows]), dets, 0, 60, Rules(max_age=9)):
        want += [(f, *r[[0, 1, 2, 3, 4]].tolist(), r[9], int(r[10]), int(r[7]), int(r[8])) for r in emitted]
    assert got == sorted(want) and len(got) == 22
    assert max(df.count() for df in stored) == (3 if most == 64 else 22)


def test_compared_trackers_share_their_detections(spark, monkeypatch):
    from veilframe.jobs import job_queries

    calls, detections = [], job_queries.detections
    monkeypatch.setattr(job_queries, "detections", lambda *a: calls.append(a) or detections(*a))
    found = {r.config for r in job_queries.compare_trackers(spark, "/root/testdata/sf0.001").collect()}
    assert len(calls) == 1 and found == {"raw", "iou", "two_stage"}


def test_segments_take_one_shuffle(spark):
    """Windows over the rows as they are give what a join with the distinct frames does."""
    from veilframe.operators.tracking import frame_segments, segment_video

    rnd = random.Random(2)
    found = [(v, f, i) for v in ("a", "b", None) for f in [*rnd.sample(range(400), 40), None] for i in range(rnd.randrange(1, 4))]
    dets = spark.createDataFrame(found, "video_id string, frame_idx long, det_idx int").repartition(3)
    out = segment_video(dets, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, dets.join(frame_segments(dets, 4), ["video_id", "frame_idx"]).select("video_id", "frame_idx", "det_idx", "segment").collect()))


def many_segments(rnd, v, n):
    """Segments of a few frames, and some long ones; gaps are 20 frames at least."""
    at = 0
    for k in range(n):
        for f in range(at, at := at + (60 if k % 5 == 2 else rnd.randrange(1, 7))):
            for i in range(rnd.randrange(1, 4)):
                x, y = rnd.uniform(0, 150), rnd.uniform(0, 150)
                yield (v, f, i, x, y, x + 40, y + 40, rnd.choice([0.1, 0.3, 0.6, 0.9]))
        at += 20


@pytest.mark.parametrize("most", [1, 9, 40_000])
def test_lots_of_segments_are_numbered_on(spark, monkeypatch, most):
    """Short segments before and after long ones, in lots of several sizes, also where a video's length is not known."""
    from veilframe.operators import tracking

    rnd = random.Random(most)
    rows = [r for v in ("v", "w", "x", None) for r in many_segments(rnd, v, 12)] + [("v", None, 0, 1.0, 1.0, 9.0, 9.0, 0.9)]
    df = spark.createDataFrame(rows, DETS).repartition(3)
    v = spark.createDataFrame([("v", 5000), ("w", None), ("y", 7)], "video_id string, nframes long")
    monkeypatch.setattr(tracking, "ROWS_TOGETHER", most)
    rules = Rules(max_age=4, high=0.5, low=0.2)
    a, b = (sorted(map(tuple, track(df, v, rules, segmented=s, span=20 if s else 10_000).collect())) for s in (True, False))
    assert a == b and len({r[2] for r in a if r[0] == "v"}) > 50


def test_lots_in_batches(monkeypatch):
    """A lot that goes on in the next batches is numbered on there."""
    import pandas as pd

    from veilframe.operators import tracking

    rnd = random.Random(5)
    table = pd.DataFrame([r for v in "abc" for r in many_segments(rnd, v, 9)], columns=["video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "score"])
    table["segment"] = (table.groupby("video_id")["frame_idx"].diff() > 20).groupby(table["video_id"]).cumsum()
    key = ["video_id", "segment"]
    table = table.assign(first=table.groupby(key)["frame_idx"].transform("min"), end=table.groupby(key)["frame_idx"].transform("max") + 3, moving=False, lot=table["segment"] // 4)
    whole = pd.concat(tracking.run_together(iter([table]), Rules()), ignore_index=True)
    assert sorted(set(whole["segment"])) == [0, 4, 8] and all(sorted(set(g)) == list(range(1, max(g) + 1)) for _, g in whole.groupby(key)["track_id"])
    for n in (1, 7, 30):
        monkeypatch.setattr(tracking, "ROWS_TOGETHER", n)
        pd.testing.assert_frame_equal(pd.concat(tracking.run_together((table.iloc[i : i + n] for i in range(0, len(table), n)), Rules()), ignore_index=True), whole)


def test_segments_dont_pass_through_the_driver(spark, monkeypatch):
    """What is broadcast holds no row for an ordinary video, however many segments it has; larger tables are merged."""
    from veilframe.operators import tracking

    sent, broadcast = [], tracking.F.broadcast
    monkeypatch.setattr(tracking.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    rnd = random.Random(1)
    df = spark.createDataFrame([r for v in range(20) for r in many_segments(rnd, f"v{v}", 4)], DETS)
    assert track(df, videos(spark, 500)).count() > 1000
    assert sum(sent) == 0
