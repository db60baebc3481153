"""Per-frame work on detections: filters, non-maximum suppression, scales, tiles and decoding of raw outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.boxes import Box, detect_scale, iou, is_sane, resized, shifted_points
from veilframe.sources.store import dealt_by

FRAME = ["video_id", "frame_idx"]
#: Most rows of anchor grids (60 bytes each) that are broadcast.
MAX_PRIORS = 1_000_000
#: Fixed values of the anchor decoder: steps, anchor sizes for each, and variances.
STEPS, SIZES, CENTER_VARIANCE, SIZE_VARIANCE = (8, 16, 32), ((16, 32), (64, 128), (256, 512)), 0.1, 0.2


def suppressed(rows: Column, threshold: float = 0.4, rule: str = "ge") -> Column:
    """An array of boxes, best first, without those that overlap one that stays: see nms."""

    def keep(acc: Column, x: Column) -> Column:
        def hit(k: Column) -> Column:
            value = iou(Box.of(x), Box.of(k))
            return value >= threshold if rule == "ge" else value > threshold

        return F.when(F.exists(acc, hit), acc).otherwise(F.array_append(acc, x))

    return F.aggregate(rows, F.slice(rows, 1, 0), keep)


def _overlapping(box: np.ndarray, there: np.ndarray | None, a: np.ndarray, b: np.ndarray, threshold: float, rule: str) -> np.ndarray:
    """Whether boxes a and b (places in box) overlap as in suppressed, also where corners are null (not there) or no numbers."""
    p, q = box[a], box[b]
    low, high = np.maximum(p[:, :2], q[:, :2]), np.fmin(p[:, 2:], q[:, 2:])
    sizes = [np.maximum(0.0, x[:, 2:] - x[:, :2]) for x in (p, q)]
    if there is None:
        inner = np.maximum(0.0, high - low)
    else:  # as greatest and least do: nulls are passed over, and what is null in all is 0
        u, v = there[a], there[b]
        low = np.where(u[:, :2] & v[:, :2], low, np.where(u[:, :2], p[:, :2], q[:, :2]))
        high = np.where(u[:, 2:] & v[:, 2:], high, np.where(u[:, 2:], p[:, 2:], q[:, 2:]))
        sizes = [np.where(x[:, :2] & x[:, 2:], size, 0.0) for x, size in zip((u, v), sizes, strict=True)]
        inner = np.where((u | v)[:, :2] & (u | v)[:, 2:], np.maximum(0.0, high - low), 0.0)
    both = inner[:, 0] * inner[:, 1]
    union = sizes[0][:, 0] * sizes[0][:, 1] + sizes[1][:, 0] * sizes[1][:, 1] - both
    some = (union > 0) | np.isnan(union)
    value = np.where(some, both / np.where(some, union, 1.0), 0.0)
    return (value >= threshold if rule == "ge" else value > threshold) | np.isnan(value)


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where frames begin in sorted rows."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        new[1:] = False
        for c in (table[k].combine_chunks() for k in keys):
            same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            gone = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= ~(same | (gone[1:] & gone[:-1]))
    return np.flatnonzero(new)


def staying(table: pa.Table, starts: np.ndarray, threshold: float, rule: str) -> np.ndarray:
    """Which rows of whole frames, best first, suppression keeps: the nth rows of all frames at once, against those after them."""
    columns = [table[c].combine_chunks() for c in Box._fields]
    box = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
    there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], axis=1) if any(c.null_count for c in columns) else None
    ends, stay, nth = np.append(starts[1:], len(box)), np.ones(len(box), bool), 0
    with np.errstate(all="ignore"):
        while len(starts):
            some = starts + nth + 1 < ends
            starts, ends = starts[some], ends[some]
            best = stay[starts + nth]
            own, many = starts[best] + nth, ends[best] - starts[best] - nth - 1
            a = np.repeat(own, many)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            a, b = a[stay[b]], b[stay[b]]
            stay[b[_overlapping(box, there, a, b, threshold, rule)]] = False
            nth += 1
    return stay


def _suppress(keys: Sequence[str], threshold: float, rule: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over rows sorted by frame and rank, in batches cut anywhere; it holds a batch and one frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                yield from table.filter(pa.array(staying(table, _starts(table, keys), threshold, rule))).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(_starts(pa.Table.from_batches([batch]), keys)[-1])
            if not last and held and all(batch[k][0].as_py() == held[-1][k][-1].as_py() for k in keys):
                held.append(batch)
                continue
            held.append(batch[:last])
            yield from done()
            held = [batch[last:]]
        yield from done()

    return run


def nms(df: DataFrame, threshold: float = 0.4, rule: str = "ge", keys: Sequence[str] = FRAME, order: Sequence[str] = ("det_idx",), columns: Sequence[str] | None = None, dealt: bool = False) -> DataFrame:
    """Non-maximum suppression within each frame (keys): one shuffle by frame, a sort, and a map over many frames at once.

    Boxes go by descending score, ties in `order`; one is dropped if its IoU with a kept box is at least threshold
    (rule 'ge'), or above it ('gt'). Other columns (all, or `columns`) stay with their box. Rows come in as suppressed takes
    them: null scores first, scores that are no numbers last. dealt: the rows of a frame are in one partition already.
    """
    columns = df.columns if columns is None else columns
    used = list(dict.fromkeys([*keys, *columns, *order, "score", *Box._fields]))
    rows = df.select(*used) if dealt else dealt_by(df.select(*used), *keys)
    rank = [-F.col("score"), *(F.col(c) for c in order)]
    rows = rows.sortWithinPartitions(*keys, *rank, *(c for c in used if c not in keys))
    return rows.mapInArrow(_suppress(keys, threshold, rule), rows.schema).select(*columns)


def min_face_filter(df: DataFrame, least: float) -> DataFrame:
    box = Box.of()
    return df.filter((box.width >= least) & (box.height >= least))


def sane_boxes(df: DataFrame, min_face: float = 6.0) -> DataFrame:
    """Keep plausible detections: columns x1 ... y2, score, landmarks, width, height (of the frame)."""
    return df.filter(is_sane(Box.of(), F.col("score"), F.col("landmarks"), F.col("width"), F.col("height"), min_face))


def _mapped(df: DataFrame, box: Box, points: Column) -> DataFrame:
    """df with its box clipped to the frame and other landmarks, where that is plausible."""
    new = box.clipped(F.col("width"), F.col("height"))
    return df.withColumns({**dict(zip(Box._fields, new, strict=True)), "landmarks": points})


def scale_boxes(df: DataFrame, inv: Column, min_face: float = 6.0) -> DataFrame:
    """Boxes and landmarks times inv; boxes clipped, landmarks not; implausible ones dropped."""
    return sane_boxes(_mapped(df, Box.of().scaled(inv), shifted_points(F.col("landmarks"), F.lit(0.0), F.lit(0.0), inv)), min_face)


def merge_scales(df: DataFrame, min_face: float = 6.0, columns: Sequence[str] | None = None) -> DataFrame:
    """Passes at several long sides (column long_side), each side once, mapped back to the frame and merged by NMS (with `columns`).

    Ties go by pass (column pass), then det_idx. A side that a frame has from more than one pass counts from the first.
    One shuffle, by frame, serves both the choice of passes and the NMS.
    """
    first = F.min("pass").over(Window.partitionBy(*FRAME, "long_side"))
    own = df.repartition(*FRAME).withColumn("_first", first).filter(F.col("pass") == F.col("_first")).drop("_first")
    inv = F.lit(1.0) / detect_scale(F.col("long_side"), F.col("width"), F.col("height"))
    return nms(scale_boxes(own, inv, min_face), order=("pass", "det_idx"), columns=columns, dealt=True)


def merge_strong(boxes: DataFrame, strong: DataFrame, min_face: float = 6.0, columns: Sequence[str] | None = None) -> DataFrame:
    """Boxes of a frame and those of a second detector, clipped and plausible, merged by NMS (with `columns`); the first win ties."""
    extra = sane_boxes(_mapped(strong, Box.of(), F.col("landmarks")), min_face)
    both = boxes.withColumn("_from", F.lit(0)).unionByName(extra.withColumn("_from", F.lit(1)))
    return nms(both, order=("_from", "det_idx"), columns=columns or boxes.columns)


def tiles_plus_base(base: DataFrame, tiles: DataFrame) -> DataFrame:
    """Base boxes and tile boxes merged by NMS; base wins ties."""
    both = base.withColumn("_from", F.lit(0)).unionByName(tiles.withColumn("_from", F.lit(1)))
    return nms(both, order=("_from", "det_idx")).drop("_from")


def tile_starts(size: Column, tile: int, overlap: float) -> Column:
    """Where windows of `tile` start along a side: regular steps, and one that ends at the side's end."""
    step = max(32, int(tile * (1.0 - overlap)))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), size - tile + 1) - 1, F.lit(step))
    return F.when(F.element_at(starts, -1) + tile < size, F.array_append(starts, F.greatest(F.lit(0), size - tile))).otherwise(starts)


def tile_grid(videos: DataFrame, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """Windows over the enlarged frame: video_id, scale, det_w, det_h, tile_x, tile_y, tile_x2, tile_y2 (ends exclusive)."""
    w, h = F.col("width"), F.col("height")
    side = F.greatest(F.lit(2 * tile), w, h)
    scale = detect_scale(side, w, h)
    same = side == F.greatest(w, h)
    sized = videos.select("video_id", scale.alias("scale"), F.when(same, w).otherwise(resized(w, scale)).alias("det_w"), F.when(same, h).otherwise(resized(h, scale)).alias("det_h"))
    rows = sized.withColumn("tile_y", F.explode(tile_starts(F.col("det_h"), tile, overlap))).withColumn("tile_x", F.explode(tile_starts(F.col("det_w"), tile, overlap)))
    return rows.withColumn("tile_x2", F.least("det_w", F.col("tile_x") + tile)).withColumn("tile_y2", F.least("det_h", F.col("tile_y") + tile))


def untile_boxes(df: DataFrame, min_face: float = 6.0) -> DataFrame:
    """Boxes of windows (tile_x, tile_y, scale) in frame coordinates, plausible ones merged by NMS in window order."""
    dx, dy = F.col("tile_x"), F.col("tile_y")
    box = Box(*(c / F.col("scale") for c in Box.of().moved(dx, dy)))
    points = F.transform("landmarks", lambda p: F.struct(((p["x"] + dx) / F.col("scale")).alias("x"), ((p["y"] + dy) / F.col("scale")).alias("y")))
    return nms(sane_boxes(_mapped(df, box, points), min_face), order=("tile_y", "tile_x", "det_idx"))


def prior_boxes(sizes: DataFrame) -> DataFrame:
    """The anchor grid of each (net_h, net_w): anchor_idx, and center and size as shares of the sides."""
    parts = None
    for step, pair in zip(STEPS, SIZES, strict=True):
        cells = [F.ceil(F.col(c) / step).cast("int") for c in ("net_h", "net_w")]
        rows = sizes.withColumn("_rows", cells[0]).withColumn("_cols", cells[1])
        rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)))
        rows = rows.select("*", F.posexplode(F.array(*map(F.lit, pair))).alias("_k", "_size")).withColumn("_step", F.lit(step))
        parts = rows if parts is None else parts.unionByName(rows)
    before = F.lit(0)
    for step in STEPS:
        cells = F.ceil(F.col("net_h") / step) * F.ceil(F.col("net_w") / step) * 2
        before = before + F.when(F.col("_step") > step, cells).otherwise(0)
    index = before + (F.col("_i") * F.col("_cols") + F.col("_j")) * 2 + F.col("_k")
    return parts.select(
        "net_h", "net_w", index.cast("int").alias("anchor_idx"),
        ((F.col("_j") + 0.5) * F.col("_step") / F.col("net_w")).alias("cx"), ((F.col("_i") + 0.5) * F.col("_step") / F.col("net_h")).alias("cy"),
        (F.col("_size") / F.col("net_w")).alias("sx"), (F.col("_size") / F.col("net_h")).alias("sy"),
    )


def decode_anchors(outputs: DataFrame, priors: DataFrame, min_score: float) -> DataFrame:
    """Boxes and landmarks from anchor outputs (anchor_idx, score, loc, lms, net_w, net_h, scale, width, height).

    Outputs are cut by score (above min_score) before they meet the priors, a few ten thousand rows for each network input
    size, which are broadcast while they are MAX_PRIORS at most.
    """
    good = outputs.filter(F.col("score") > min_score).join(F.broadcast(priors) if priors.count() <= MAX_PRIORS else priors, ["net_h", "net_w", "anchor_idx"])

    def point(i: int) -> tuple[Column, Column]:
        x = F.col("cx") + F.get("lms", F.lit(2 * i)) * CENTER_VARIANCE * F.col("sx")
        y = F.col("cy") + F.get("lms", F.lit(2 * i + 1)) * CENTER_VARIANCE * F.col("sy")
        return x * F.col("net_w") / F.col("scale"), y * F.col("net_h") / F.col("scale")

    cx = F.col("cx") + F.get("loc", F.lit(0)) * CENTER_VARIANCE * F.col("sx")
    cy = F.col("cy") + F.get("loc", F.lit(1)) * CENTER_VARIANCE * F.col("sy")
    bw = F.col("sx") * F.exp(F.get("loc", F.lit(2)) * SIZE_VARIANCE)
    bh = F.col("sy") * F.exp(F.get("loc", F.lit(3)) * SIZE_VARIANCE)
    x1, y1 = cx - bw / 2, cy - bh / 2
    to_x, to_y = F.col("net_w") / F.col("scale"), F.col("net_h") / F.col("scale")
    box = Box(x1 * to_x, y1 * to_y, (x1 + bw) * to_x, (y1 + bh) * to_y).clipped(F.col("width"), F.col("height"))
    points = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in map(point, range(5))))
    return good.select(*FRAME, "anchor_idx", "score", *box.columns(), points.alias("landmarks"))


def decode_distances(outputs: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Boxes and landmarks from distances to anchor centers: stride, cell (two per place), cols, score, dist, kps, scale, width, height.

    After NMS (IoU above threshold drops, ties by stride and cell) boxes are clipped to the frame, landmarks are not.
    """
    place = F.floor(F.col("cell") / 2)
    px, py = place % F.col("cols") * F.col("stride"), F.floor(place / F.col("cols")) * F.col("stride")
    d = [F.get("dist", F.lit(i)) * F.col("stride") for i in range(4)]
    s = F.col("scale")
    box = Box((px - d[0]) / s, (py - d[1]) / s, (px + d[2]) / s, (py + d[3]) / s)
    points = F.array(*(F.struct(((px + F.get("kps", F.lit(2 * i)) * F.col("stride")) / s).alias("x"), ((py + F.get("kps", F.lit(2 * i + 1)) * F.col("stride")) / s).alias("y")) for i in range(5)))
    rows = outputs.select(*FRAME, "stride", "cell", "score", "width", "height", *box.columns(), points.alias("landmarks"))
    kept = nms(rows, threshold, "gt", order=("stride", "cell"))
    return kept.withColumns(dict(zip(Box._fields, Box.of().clipped(F.col("width"), F.col("height")), strict=True)))
