"""Detection on frames as one pass over the pixels: all scheduled scales and detectors of a frame in one map.

The map runs the detectors and yields what they said, one row a frame; mapping back, plausibility and suppression are
column expressions on that row's array, so nothing shuffles between pixels and merged boxes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.boxes import Box, is_sane, shifted_points

from .detections import suppressed
from .frames import frame_numbers, is_dark, lightened, map_frames, pixels

#: Makes a detector in a Python worker: pixels -> rows (x1, y1, x2, y2, score), or with five points (x, y) after these.
Factory = Callable[[], Callable[[np.ndarray], np.ndarray]]

POINTS = "array<struct<x:double,y:double>>"
RAW = f"array<struct<inv:double,x1:double,y1:double,x2:double,y2:double,score:double,landmarks:{POINTS}>>"
SCANNED = f"video_id string, frame_idx long, width int, height int, luma double, tiles array<double>, thumb binary, thumb_h int, thumb_w int, seconds double, passes {RAW}, strong {RAW}"


@dataclass(frozen=True)
class Schedule:
    """Which detections a frame gets: long sides in pixels (0: as it is), how often the extra ones come (0: never)."""

    long_side: int = 640
    extra_long_side: int = 960
    extra_every: int = 0
    strong_every: int = 0
    threshold: float = 0.18
    strong_threshold: float = 0.5
    min_face: float = 6.0
    dark_below: float = 72.0
    clip: float = 2.0
    grid: int = 8


def _along(n: int, m: int, smooth: bool) -> np.ndarray:
    """(m, n) weights that bring n pixels to m: between the two nearest centers (smooth), or each by the part it covers."""
    if smooth:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        out = np.zeros((m, n))
        out[np.arange(m), low] += 1 - (at - low)
        out[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
        return out
    cut = np.linspace(0, n, m + 1)
    return np.clip(np.minimum(cut[1:, None], np.arange(1, n + 1)) - np.maximum(cut[:-1, None], np.arange(n)), 0, None) * m / n


def resized_frame(frame: np.ndarray, long_side: int) -> tuple[np.ndarray, float]:
    """The frame with its longer side brought to long_side, sides even, and the scale; itself and 1 if nothing changes."""
    h, w = frame.shape[:2]
    if long_side <= 0 or max(h, w) == long_side:
        return frame, 1.0
    scale = long_side / max(h, w)
    new = [max(2, round(n * scale)) for n in (h, w)]
    nh, nw = (n + n % 2 for n in new)
    rows = np.einsum("ij,jkc->ikc", _along(h, nh, scale > 1), frame.astype(np.float32), optimize=True)
    out = np.einsum("ij,kjc->kic", _along(w, nw, scale > 1), rows, optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8), scale


def _said(rows: np.ndarray, inv: float, good: Callable[[float], bool]) -> list[tuple]:
    out = []
    for r in np.asarray(rows, float) if len(rows) else ():
        if good(r[4]):
            points = [{"x": x, "y": y} for x, y in r[5:15].reshape(-1, 2).tolist()] if len(r) >= 15 and not np.isnan(r[5:15]).any() else None
            out.append((inv, *r[:5].tolist(), points))
    return out


def scan(frames: DataFrame, detector: Factory, strong: Factory | None = None, schedule: Schedule | None = None) -> DataFrame:
    """One row a frame, in SCANNED's columns: statistics of its pixels, seconds taken, and what the detectors said.

    Statistics are of the frame as it is; detectors see it stretched where it is dark. passes holds the boxes of each
    scheduled scale (each once), with the factor that maps them back, `strong` those of the second detector on the frame
    itself. Scores count from the threshold on, the second detector's above its own.
    """
    s = schedule or Schedule()
    columns = [c.split()[0] for c in SCANNED.replace(RAW, "raw").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = detector(), strong() if strong is not None and s.strong_every > 0 else None
        for batch in batches:
            out = []
            for video, idx, image in batch[["video_id", "frame_idx", "image"]].itertuples(index=False):
                f = pixels(image)
                numbers = frame_numbers(f)
                began = time.perf_counter()
                shown = lightened(f, s.clip, s.grid) if is_dark(numbers[0], numbers[1], s.dark_below) else f
                sides = [s.long_side] + [s.extra_long_side] * (s.extra_every > 0 and idx % s.extra_every == 0)
                passes, others = [], []
                for side in dict.fromkeys(sides):
                    small, scale = resized_frame(shown, side)
                    passes += _said(first(small), 1.0 / scale, lambda score: score >= s.threshold)
                if second is not None and idx % s.strong_every == 0:
                    others = _said(second(shown), 1.0, lambda score: score > s.strong_threshold)
                fields = ("inv", "x1", "y1", "x2", "y2", "score", "landmarks")
                boxes = ([dict(zip(fields, b, strict=True)) for b in part] for part in (passes, others))
                out.append((video, idx, f.shape[1], f.shape[0], *numbers, time.perf_counter() - began, *boxes))
            yield pd.DataFrame(out, columns=columns)

    return map_frames(frames, run, SCANNED)


def _ranked(rows: Column) -> Column:
    """Best first, ties as they stand."""
    return F.array_sort(F.transform(rows, lambda r, i: F.struct((-r["score"]).alias("_s"), i.alias("_o"), *(r[c].alias(c) for c in (*Box._fields, "score", "landmarks")))))


def merged_boxes(scanned: DataFrame, min_face: float = 6.0) -> DataFrame:
    """video_id, frame_idx, det_idx, x1 ... y2, score, landmarks: a frame's scales merged, then with the second detector.

    det_idx is the rank by score. Boxes are mapped back and clipped (landmarks are not clipped), implausible ones dropped.
    """
    w, h = F.col("width"), F.col("height")

    def plausible(column: str) -> Column:
        def back(r: Column) -> Column:
            points = shifted_points(r["landmarks"], F.lit(0.0), F.lit(0.0), r["inv"])
            return F.struct(*Box.of(r).scaled(r["inv"]).clipped(w, h).columns(), r["score"].alias("score"), points.alias("landmarks"))

        return F.filter(F.transform(column, back), lambda r: is_sane(Box.of(r), r["score"], r["landmarks"], w, h, min_face))

    both = scanned.select("video_id", "frame_idx", suppressed(_ranked(plausible("passes"))).alias("base"), plausible("strong").alias("strong"))
    plain = F.transform("base", lambda r: F.struct(*(r[c].alias(c) for c in (*Box._fields, "score", "landmarks"))))
    rows = both.select("video_id", "frame_idx", F.when(F.size("strong") > 0, suppressed(_ranked(F.concat(plain, "strong")))).otherwise(F.col("base")).alias("rows"))
    boxes = rows.select("video_id", "frame_idx", F.posexplode("rows").alias("det_idx", "r"))
    return boxes.select("video_id", "frame_idx", "det_idx", *(F.col(f"r.{c}") for c in (*Box._fields, "score", "landmarks")))
