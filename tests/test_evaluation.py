"""Matching and curves against plain loops; sampling of audit frames."""

import random

from veilframe.operators import evaluation as ev
from veilframe.operators.sampling import select_qc_frames

BOX = "video_id string, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


def first_fit(gts, preds):
    used = set()
    for g in gts:
        for j, p in enumerate(preds):
            if j not in used and iou(g, p) >= 0.2:
                used.add(j)
                break
    return len(used)


def test_one_match_serves_all_thresholds(spark):
    rnd = random.Random(5)

    def box():
        x, y = rnd.uniform(0, 60), rnd.uniform(0, 60)
        return x, y, x + rnd.uniform(10, 30), y + rnd.uniform(10, 30)

    gts = {f: [box() for _ in range(rnd.randrange(0, 5))] for f in range(25)}
    preds = {f: sorted(((rnd.randrange(20) / 20, *box()) for _ in range(rnd.randrange(0, 6))), key=lambda p: -p[0]) for f in range(25)}
    truth = spark.createDataFrame([("v", f, i, *b) for f, bs in gts.items() for i, b in enumerate(bs)], BOX)
    pred = spark.createDataFrame([("v", f, i, *p[1:], p[0], "a") for f, ps in preds.items() for i, p in enumerate(ps)], BOX + ", score double, config string").repartition(3)
    counts = {r.threshold: r for r in ev.pr_counts(ev.greedy_match(truth, pred), pred).collect()}
    for t in ev.THRESHOLDS:
        keep = {f: [p[1:] for p in ps if p[0] >= t] for f, ps in preds.items()}
        assert counts[t].npred == sum(map(len, keep.values()))
        assert counts[t].tp == sum(first_fit(gts[f], keep[f]) for f in gts)
        assert counts[t].gt == sum(map(len, gts.values()))


def qc(spark, nframes, fps, interval, cap, extra=()):
    videos = spark.createDataFrame([("v", fps, nframes)], "video_id string, fps double, nframes long")
    hints = spark.createDataFrame([("v", i) for i in extra], "video_id string, frame_idx long")
    return sorted(r.frame_idx for r in select_qc_frames(videos, hints, interval, cap).collect())


def test_audit_frames(spark):
    assert qc(spark, 90, 30.0, 1.0, 200) == [0, 30, 60]
    got = qc(spark, 10000, 30.0, 1.5, 80, [12, 999999, 500])
    assert len(got) <= 80 and got == sorted(set(got)) and 0 <= got[0] and got[-1] < 10000
    assert qc(spark, 0, 30.0, 1.0, 10) == [] and qc(spark, 90, 30.0, 1.0, 0) == [] and qc(spark, 90, 30.0, 1.0, 1) == [0]
    assert qc(spark, 8, 2.5, 1.0, 9) == [0, 2, 4, 6]


def test_thinning_as_evenly_spaced_ranks(spark):
    import numpy as np

    for n, cap in ((37, 10), (101, 100), (64, 7)):
        want = sorted({int(i) for i in np.rint(np.linspace(0, n - 1, cap))})
        assert qc(spark, n, 1.0, 1.0, cap) == want
