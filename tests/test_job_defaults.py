"""The redaction job against the loop that goes through each video frame by frame, and what its passes rest on."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_redaction_job import VIDEOS, face, images
from test_tracking import Plain

from veilframe.jobs.redaction import SKIPPING, Schedule, Settings, redact_and_audit, retry_schedule
from veilframe.operators import detecting, frames as fr

FACE = [(0.30, 0.35), (0.70, 0.35), (0.50, 0.55), (0.35, 0.78), (0.65, 0.78)]


def finder(level, points=True):
    """One box for the bright pixels of each half of a frame, scored by their brightness, with slightly turned eyes."""

    def factory():
        def detect(f):
            out = []
            for x0, part in ((0, f[:, : f.shape[1] // 2]), (f.shape[1] // 2, f[:, f.shape[1] // 2 :])):
                ys, xs = np.nonzero(part[..., 1] > level)
                if len(ys) > 3:
                    box = [xs.min() + x0, ys.min(), xs.max() + x0 + 1, ys.max() + 1]
                    marks = [c for u, v in FACE for c in (box[0] + u * (box[2] - box[0]), box[1] + (v + 0.1 * u) * (box[3] - box[1]))]
                    out.append([*box, part[ys, xs, 1].mean() / 255, *(marks if points else [np.nan] * 10)])
            return np.array(out, float).reshape(-1, 15)

        return detect

    return factory


def clip(seed, n=60, h=96, w=128):
    """Frames with up to two bright squares that move, some dark, with a long stretch without any."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        f = rng.integers(0, 40, (h, w, 3)).astype(np.uint8) + (0 if i % 7 == 3 else np.uint8(70))
        for k in range(2):
            if not 14 <= i < 44 and rng.random() < 0.8 or i in (29, 32):
                x, y, s = 10 + 60 * k + i % 20, 15 + 20 * k + i % 11, int(rng.integers(14, 30))
                f[y : y + s, x : x + s] = rng.integers(190, 256, (s, s, 3))
        out.append(f)
    return out


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w
    return w / both if both > 0 else 0.0


def merged(boxes):
    out = []
    for b in sorted(boxes, key=lambda b: -b[4]):
        if all(overlap(b, k) < 0.4 for k in out):
            out.append(b)
    return out


def clipped(b, w, h):
    return [min(max(b[0], 0.0), w - 1), min(max(b[1], 0.0), h - 1), min(max(b[2], 0.0), w - 1), min(max(b[3], 0.0), h - 1), *b[4:]]


def sane(b, w, h, least):
    bw, bh, p = max(0.0, b[2] - b[0]), max(0.0, b[3] - b[1]), np.array(b[5:15]).reshape(5, 2)
    if bw < least or bh < least or not 0.4 <= bw / max(bh, 1e-3) <= 2.2:
        return False
    if not (bw * bh / (w * h) > 0.08 or bw > 0.35 * w or bh > 0.38 * h):
        return True
    slack = 0.3 * max(bw, bh, 1.0)
    good = not np.isnan(p).any() and sum(b[0] - slack <= x <= b[2] + slack and b[1] - slack <= y <= b[3] + slack for x, y in p) >= 4
    good = good and (p[0, 1] + p[1, 1]) / 2 + 1 < p[2, 1] < (p[3, 1] + p[4, 1]) / 2 - 1 and abs(p[0, 1] - p[1, 1]) <= 0.5 * bh and 0.1 * bw <= abs(p[1, 0] - p[0, 0]) <= 0.9 * bw
    return bool(good and b[4] >= 0.32 or b[4] >= 0.75)


def gray(f):
    return float(f[::8, ::8].reshape(-1, 3).mean(axis=0) @ np.array([0.114, 0.587, 0.299]))


def loop(video, first, second, s, rules):
    """What is painted in each frame, and the frames that count as detected, dark and moving."""
    h, w = video[0].shape[:2]
    tracker, empty, dark, moving, calls, painted, before = Plain(rules), 0, [], [], 0, [], None
    for idx, f in enumerate(video):
        tiles = [gray(f[i * (h // 4) : (i + 1) * (h // 4), j * (w // 4) : (j + 1) * (w // 4)]) for i in range(4) for j in range(4)]
        is_dark = gray(f) < s.dark_below or min(tiles) < s.dark_below
        if is_dark and len(dark) < 80:
            dark.append(idx)
        small = f[::16, ::16].astype(int)
        if before is not None and (small - before).std() > 18 and len(moving) < 80:
            moving.append(idx)
        before = small
        every = rules.skip_every if rules.skip_after is not None and empty >= rules.skip_after and not tracker.tracks else 1
        found = []
        if idx % every == 0 or idx in moving:
            calls += 1
            shown = fr.lightened(f, s.clip, s.grid) if is_dark else f
            for side in dict.fromkeys([s.long_side] + [s.extra_long_side] * (s.extra_every > 0 and idx % s.extra_every == 0)):
                part, scale = detecting.resized_frame(shown, side)
                for b in first(part).tolist():
                    if b[4] >= s.threshold:
                        b = clipped([x * (1.0 / scale) if k != 4 else x for k, x in enumerate(b)], w, h)
                        found += [b] if sane(b, w, h, s.min_face) else []
            found = merged(found)
            if s.strong_every > 0 and idx % s.strong_every == 0:
                more = [clipped(b, w, h) for b in second(shown).tolist() if b[4] > s.strong_threshold]
                found = merged(found + [b for b in more if sane(b, w, h, s.min_face)])
        out = tracker.step([{"box": b[:4], "score": b[4]} for b in found])
        empty = 0 if out else empty + 1
        painted.append(out)
    return painted, calls, dark, moving


SCHEDULES = [
    (Schedule(long_side=160, threshold=0.6), replace(SKIPPING, skip_after=6, skip_every=4, max_age=3)),
    (Schedule(long_side=96, extra_long_side=200, extra_every=2, strong_every=5, threshold=0.85, strong_threshold=0.7, min_face=4), replace(SKIPPING, skip_after=None, max_age=4)),
]


@pytest.mark.parametrize(("schedule", "rules"), SCHEDULES)
def test_job_equals_the_loop(spark, schedule, rules):
    clips = {v: clip(i) for i, v in enumerate("ab")}
    frames = images(spark, [(v, i, f) for v, fs in clips.items() for i, f in enumerate(fs)]).repartition(3)
    videos = spark.createDataFrame([(v, 10.0, 128, 96, n) for v, n in (("a", 60), ("b", None))], VIDEOS)
    out = redact_and_audit(frames, videos, finder(150), finder(120, points=False), Settings(schedule, rules, method="blackout", shape="rect", pad=0.0, interval=0.5))
    metrics = {r.video_id: r for r in out.metrics.collect()}
    rows = {}
    for r in out.painted.collect():
        rows.setdefault((r.video_id, r.frame_idx), []).append((r.track_id, *(round(r[c], 6) for c in ("x1", "y1", "x2", "y2")), r.score, r.hits, r.time_since_update))
    shown = {(r.video_id, r.frame_idx): fr.pixels(r.image.asDict()) for r in out.frames.collect()}
    total = 0
    for v, fs in clips.items():
        painted, calls, _, _ = loop(fs, finder(150)(), finder(120, points=False)(), schedule, rules)
        for i, (f, want) in enumerate(zip(fs, painted, strict=True)):
            assert sorted(rows.get((v, i), [])) == [tuple(pytest.approx(x, abs=1e-3) for x in w) for w in sorted(want)]
            black = f.copy()
            for _, x1, y1, x2, y2, *_ in want:
                x1, y1, x2, y2 = (int(c) for c in clipped([x1, y1, x2, y2], 128, 96))
                if x2 - x1 >= 4 and y2 - y1 >= 4:
                    black[y1:y2, x1:x2] = 0
            assert (shown[v, i] == black).all()
            total += len(want)
        m = metrics[v]
        assert (m.frames, m.detect_calls, m.faces_painted, m.frames_with_faces) == (len(fs), calls, sum(map(len, painted)), sum(map(bool, painted)))
        assert m.seconds > 0 and m.throughput > 0 and m.ms_per_call > 0
        if rules.skip_after:
            assert calls < len(fs)
    assert total > 60
    assert {r.video_id: r.frames_checked > 0 for r in out.report.collect()} == {"a": True, "b": True}  # of unknown length, too


def test_landmarks_turn_the_ellipse(spark):
    frames = images(spark, [("v", i, face(30, 1)) for i in range(2)])
    videos = spark.createDataFrame([("v", 5.0, 160, 120, 2)], VIDEOS)
    out = redact_and_audit(frames, videos, finder(100), finder(100), Settings(Schedule(long_side=0)))
    marks = [r.landmarks for r in out.painted.collect()]
    assert marks and all(m is not None and m[1].y > m[0].y for m in marks)
    plain = redact_and_audit(frames, videos, finder(100, points=False), finder(100), Settings(Schedule(long_side=0)))
    a, b = ({r.frame_idx: bytes(r.image.data) for r in x.frames.collect()} for x in (out, plain))
    assert a.keys() == b.keys() and all(a[i] != b[i] for i in a)


def test_no_box_is_counted_in_a_frame_that_is_not_there(spark):
    frames = images(spark, [("v", i, face(30, i)) for i in (0, 1, 5, 9)])
    videos = spark.createDataFrame([("v", 5.0, 160, 120, None)], VIDEOS)
    out = redact_and_audit(frames, videos, finder(100), finder(100), Settings(Schedule(long_side=0)))
    m = out.metrics.first()
    assert m.frames == 4 and m.frames_with_faces == 4 and {r.frame_idx for r in out.painted.collect()} == {0, 1, 5, 9}


def test_retry_uses_its_own_schedule(spark):
    """The first pass misses what is small; the retry looks at larger inputs on each frame and paints it."""

    def large(level):
        plain = finder(level)

        def factory():
            inner = plain()
            return lambda f: inner(f) if f.shape[1] >= 300 else np.zeros((0, 15))

        return factory

    frames = images(spark, [("v", i, face(30, i)) for i in range(6)])
    videos = spark.createDataFrame([("v", 5.0, 160, 120, 6)], VIDEOS)
    s = Settings(Schedule(long_side=160), interval=0.2, retry=retry_schedule(Schedule(), long_side=320))
    out = redact_and_audit(frames, videos, large(100), finder(100), s)
    r = out.report.first()
    assert r.retried and not r.retry_rejected and r.status == "pass" and out.metrics.first().faces_painted >= 6
    rule = retry_schedule(Schedule(extra_every=0, strong_every=3))
    assert (rule.threshold, rule.long_side, rule.extra_long_side, rule.extra_every, rule.strong_every) == (0.22, 960, 960, 1, 0)
    assert Settings().rules.skip_after == 36 and Settings().retry is None and Settings().schedule.extra_every == 0


def test_failing_fast_stops_at_the_first_leak(spark):
    frames = images(spark, [("v", i, face(30, i)) for i in range(6)])
    videos = spark.createDataFrame([("v", 5.0, 160, 120, 6)], VIDEOS)
    blind = lambda: lambda f: np.zeros((0, 15))
    every, fast = (redact_and_audit(frames, videos, blind, finder(100), Settings(interval=0.2, fail_fast=x)).report.first() for x in (False, True))
    assert (every.frames_checked, every.leak_count) == (6, 6) and (fast.frames_checked, fast.leak_count) == (1, 1)


def test_motion_across_ranges(spark):
    rng = np.random.default_rng(2)
    ids = [0, 1, 2, 3, 7, 8, 31, 32, 33]
    found = [("v", i, rng.integers(0, 255, (64 if i < 32 else 80, 64, 3)).astype(np.uint8)) for i in ids]
    stats = fr.frame_stats(images(spark, found))
    a, b = ({r.frame_idx: r.motion for r in fr.frame_motion(stats, span).collect()} for span in (2, 4096))
    assert a == b and a[0] is None and a[32] is None and a[33] is not None and a[7] is not None
    assert "SinglePartition" not in fr.frame_motion(stats, 2)._jdf.queryExecution().executedPlan().toString()


def test_scales_by_weights():
    f = np.arange(12 * 16 * 3, dtype=np.uint8).reshape(12, 16, 3)
    same, one = detecting.resized_frame(f, 16)
    assert same is f and one == 1.0 and detecting.resized_frame(f, 0)[0] is f
    half, scale = detecting.resized_frame(f, 8)
    assert scale == 0.5 and half.shape == (6, 8, 3) and np.abs(half - f.astype(float).reshape(6, 2, 8, 2, 3).mean((1, 3))).max() <= 0.5
    up, scale = detecting.resized_frame(np.full((5, 9, 3), 7, np.uint8), 27)
    assert scale == 3.0 and up.shape == (16, 28, 3) and (up == 7).all()
    row = detecting.resized_frame(np.repeat(np.array([[[0], [100]]], np.uint8), 3, axis=2), 4)[0][0, :, 0]
    assert row.tolist() == [0, 25, 75, 100]


def test_lightness_against_plain_steps(spark):
    rng = np.random.default_rng(4)
    f = np.clip(rng.normal(40, 15, (50, 70, 3)), 0, 255).astype(np.uint8)
    assert np.abs(fr.from_lab(fr.to_lab(f)).astype(int) - f).max() <= 1
    assert fr.to_lab(np.array([[[255, 255, 255]]], np.uint8)).round(1).tolist() == [[[255.0, 0.0, 0.0]]]
    plane, clip_, grid = np.rint(fr.to_lab(f)[..., 0]).astype(np.uint8), 2.0, 4
    h, w = plane.shape
    th, tw = -(-h // grid), -(-w // grid)
    full = np.pad(plane, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect")
    maps = {}
    for i in range(grid):
        for j in range(grid):
            counts = [int((full[i * th : (i + 1) * th, j * tw : (j + 1) * tw] == v).sum()) for v in range(256)]
            limit = max(1, int(clip_ * th * tw / 256))
            over = sum(max(0, c - limit) for c in counts)
            counts = [min(c, limit) + over // 256 for c in counts]
            rest = over % 256
            if rest:
                for v in list(range(0, 256, max(1, 256 // rest)))[:rest]:
                    counts[v] += 1
            maps[i, j] = [min(255, round(sum(counts[: v + 1]) * 255 / (th * tw))) for v in range(256)]
    got = fr.equalized(plane, clip_, grid)
    for y in range(0, h, 7):
        for x in range(0, w, 5):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y0, x0 = int(np.floor(fy)), int(np.floor(fx))
            at = lambda i, j: maps[min(max(i, 0), grid - 1), min(max(j, 0), grid - 1)][plane[y, x]]  # noqa: E731, B023
            top = at(y0, x0) * (1 - (fx - x0)) + at(y0, x0 + 1) * (fx - x0)
            low = at(y0 + 1, x0) * (1 - (fx - x0)) + at(y0 + 1, x0 + 1) * (fx - x0)
            assert abs(got[y, x] - (top * (1 - (fy - y0)) + low * (fy - y0))) <= 1
    light = np.full((40, 40, 3), 200, np.uint8)
    out = {r.frame_idx: fr.pixels(r.image.asDict()) for r in fr.enhance_dark_frames(images(spark, [("v", 0, f), ("v", 1, light)])).collect()}
    assert (out[1] == light).all() and (out[0] == fr.lightened(f)).all() and out[0].std() > f.std()
