"""Suppression of many frames at once against the fold over one frame's array, on odd boxes too."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators.detections import FRAME, merge_strong, nms, suppressed

SCHEMA = "video_id string, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, note array<int>"


def odd_boxes(rnd):
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0]
    for v, frames in (("a", 60), ("b", 7), (None, 5)):
        for f in [*range(frames), None]:
            for i in range(rnd.choice([1, 2, 5, 40])):
                x, y = rnd.randrange(60), rnd.randrange(40)
                box = [float(z) for z in (x, y, x + rnd.randrange(-3, 30), y + rnd.randrange(-3, 30))]
                if rnd.random() < 0.15:
                    box[rnd.randrange(4)] = rnd.choice(odd)
                yield (v, f, i, *box, rnd.choice([0.2, 0.5, 0.5, 0.9, None, math.nan, 0.0, -0.0]), [i] if i % 3 else None)


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("batch", [1, 7, 10_000])
@pytest.mark.parametrize("rule", ["ge", "gt"])
def test_as_the_fold_over_a_frame(spark, rule, batch):
    df = spark.createDataFrame(list(odd_boxes(random.Random(batch))), SCHEMA).repartition(3)
    rest = [c for c in df.columns if c not in FRAME]
    folded = df.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), F.col("det_idx").alias("_o"), *rest))).alias("rows"))
    want = rows_of(folded.select(*FRAME, F.inline(suppressed(F.col("rows"), 0.4, rule))).select(*df.columns))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rows_of(nms(df, 0.4, rule))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) > 50


def test_only_what_is_asked_for_shuffles(spark):
    """Landmarks decide which boxes of the second detector count, and don't go through the shuffle by frame."""
    df = spark.createDataFrame(list(odd_boxes(random.Random(3))), SCHEMA).withColumns({"landmarks": F.expr("array(named_struct('x', x1, 'y', y1))"), "width": F.lit(100), "height": F.lit(100)})
    out = merge_strong(df, df, columns=[*FRAME, "det_idx", "score"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    repartition = next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    below = plan.splitlines()[plan.splitlines().index(repartition) + 1]
    assert "collect_list" not in plan and "landmarks" not in below
    assert out.columns == [*FRAME, "det_idx", "score"] and rows_of(out) == rows_of(merge_strong(df, df).select(*out.columns))


def test_a_frame_of_very_many_boxes(spark):
    """Memory and time of one frame stay those of its boxes, not of their pairs."""
    df = spark.range(20_000).selectExpr("'v' as video_id", "cast(0 as long) as frame_idx", "cast(id as int) as det_idx", "cast(id % 10 * 100 as double) as x1", "0D as y1", "cast(id % 10 * 100 + 50 as double) as x2", "50D as y2", "cast(1 / (1 + id) as double) as score")
    assert sorted(r.det_idx for r in nms(df).collect()) == list(range(10))


def test_boxes_of_a_frame_meet_after_joins(spark):
    """Joins have dealt the boxes by frame already, and Spark puts the parts of each side together in its own way."""
    frame, box = ("'v' || id % 40 as video_id", "id % 5 as frame_idx"), ("0D as x1", "0D as y1", "9D as x2", "9D as y2")
    base = spark.range(40).selectExpr(*frame, "0 as det_idx", *box, "0.5D as score")
    tiles = spark.range(40_000).selectExpr(*frame, "cast(1 + id as int) as det_idx", *box, "0.4D as score")
    risky = spark.range(200).selectExpr(*frame).distinct()
    coalesce = "spark.sql.adaptive.coalescePartitions"
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", f"{coalesce}.parallelismFirst": "false", f"{coalesce}.minPartitionSize": "1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = nms(base.unionByName(tiles.join(risky, FRAME, "left_semi")).join(risky, FRAME, "left_semi")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 40 and {r.det_idx for r in got} == {0}
