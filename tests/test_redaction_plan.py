"""The plan of redaction against the plain rule, and that its stage is short enough for the JVM to compile."""

import math
import random
import re

from veilframe.operators.redaction import redaction_plan

#: Longer methods (bytes) run interpreted in the JVM.
MOST_COMPILED = 8000
SCHEMA = "i long, x1 double, y1 double, x2 double, y2 double, landmarks array<struct<x:double,y:double>>, width int, height int"


def plain(x1, y1, x2, y2, points, w, h, base, blocks):
    bw, bh = max(0.0, x2 - x1), max(0.0, y2 - y1)
    if w <= 0 or h <= 0:
        pad = base
    elif min(bw, bh) < 24:
        pad = base * 1.35
    else:
        area, side = bw * bh / (w * h), max(bw / w, bh / h)
        pad = next((min(base, most) for a, s, most in ((0.40, 0.75, 0.08), (0.18, 0.50, 0.14), (0.08, 0.35, 0.22)) if area >= a or side >= s), base)
    px, py = bw * pad, bh * pad
    rx1, ry1, rx2, ry2 = (int(min(max(v, 0.0), n - 1.0)) for v, n in ((x1 - px, w), (y1 - py, h), (x2 + px, w), (y2 + py, h)))
    rw, rh = rx2 - rx1, ry2 - ry1
    if rw < 4 or rh < 4:
        return None
    angle = math.degrees(math.atan2(points[1][1] - points[0][1], points[1][0] - points[0][0])) if points else 0.0
    kernel = min(max(15, int(max(rw, rh) * 0.55) | 1), 151)
    return rx1, ry1, rx2, ry2, "rect" if min(bw, bh) < 20 else "ellipse", round(angle, 9), kernel, max(4, min(blocks, min(rw, rh) // 2)), round(pad, 12)


def boxes():
    rnd = random.Random(17)
    for i in range(400):
        w, h = rnd.choice([(480, 360), (1280, 720), (3, 3), (0, 0)] if i % 8 == 0 else [(480, 360), (1280, 720)])
        x, y, side = rnd.uniform(-30, w), rnd.uniform(-30, h), rnd.choice([2, 15, 40, 200, 600])
        bw, bh = rnd.uniform(-1, side), rnd.uniform(0, side)
        points = None if i % 3 == 0 else [(x + rnd.random(), y + rnd.random()) for _ in range(5)]
        yield i, x, y, x + bw, y + bh, points, w, h


def test_plan_against_the_plain_rule(spark):
    rows = list(boxes())
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "-1 as rx1")
    names = ["rx1", "ry1", "rx2", "ry2", "shape", "angle", "kernel", "blocks", "pad"]
    plan = redaction_plan(df, 0.42, 10)
    got = {r.i: (*(r[n] for n in names[:5]), round(r.angle, 9), r.kernel, r.blocks, round(r.pad, 12)) for r in plan.select("i", *names).collect()}
    want = {i: p for i, *box in rows if (p := plain(*box, 0.42, 10))}
    assert got == want and 100 < len(want) < len(rows)


def test_plan_is_compiled(spark, tmp_path, capsys):
    spark.createDataFrame(list(boxes()), SCHEMA).write.parquet(str(tmp_path / "boxes"))
    redaction_plan(spark.read.parquet(str(tmp_path / "boxes")), 0.42, 10).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < MOST_COMPILED
