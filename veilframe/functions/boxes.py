"""Box geometry as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the plausibility and padding rules.
MIN_ASPECT, MAX_ASPECT = 0.40, 2.2
LARGE_AREA, LARGE_WIDTH, LARGE_HEIGHT = 0.08, 0.35, 0.38
LANDMARK_SCORE, STRONG_SCORE = 0.32, 0.75
PAD_TINY_SIDE, PAD_TINY_FACTOR = 24, 1.35
PAD_STEPS = [(0.40, 0.75, 0.08), (0.18, 0.50, 0.14), (0.08, 0.35, 0.22)]
BUCKETS = [("tiny", 16), ("small", 32), ("medium", 64)]


class Box(NamedTuple):
    """Corners of a box as columns."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, source: Column | None = None) -> Box:
        """The columns x1, y1, x2, y2, or fields of a struct column."""
        return cls(*(F.col(c) if source is None else source[c] for c in cls._fields))

    @property
    def width(self) -> Column:
        return F.greatest(F.lit(0.0), self.x2 - self.x1)

    @property
    def height(self) -> Column:
        return F.greatest(F.lit(0.0), self.y2 - self.y1)

    @property
    def cx(self) -> Column:
        return F.lit(0.5) * (self.x1 + self.x2)

    @property
    def cy(self) -> Column:
        return F.lit(0.5) * (self.y1 + self.y2)

    @property
    def min_side(self) -> Column:
        return F.least(self.width, self.height)

    def columns(self) -> list[Column]:
        return [c.alias(n) for n, c in zip(self._fields, self, strict=True)]

    def scaled(self, inv: Column) -> Box:
        return Box(*(c * inv for c in self))

    def moved(self, dx: Column, dy: Column) -> Box:
        return Box(self.x1 + dx, self.y1 + dy, self.x2 + dx, self.y2 + dy)

    def clipped(self, w: Column, h: Column) -> Box:
        """Each coordinate within the frame's first and last pixel."""

        def within(c: Column, size: Column) -> Column:
            return F.least(F.greatest(c, F.lit(0.0)), (size - 1).cast("double"))

        return Box(within(self.x1, w), within(self.y1, h), within(self.x2, w), within(self.y2, h))

    def expanded(self, pad: Column, w: Column, h: Column) -> Box:
        """Grown by pad times its width and height on each side, then clipped."""
        px, py = self.width * pad, self.height * pad
        return Box(self.x1 - px, self.y1 - py, self.x2 + px, self.y2 + py).clipped(w, h)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union is empty."""
    iw = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    ih = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    union = a.width * a.height + b.width * b.height - iw * ih
    return F.when(union > 0, iw * ih / union).otherwise(F.lit(0.0))


def adaptive_pad(box: Box, w: Column, h: Column, base: Column) -> Column:
    """The padding share: more for tiny boxes, less as the box fills the frame; base if the frame has no size."""
    area = box.width * box.height / (w * h).cast("double")
    side = F.greatest(box.width / w.cast("double"), box.height / h.cast("double"))
    rule = F.when((w <= 0) | (h <= 0), base).when(box.min_side < PAD_TINY_SIDE, base * PAD_TINY_FACTOR)
    for least_area, least_side, most in PAD_STEPS:
        rule = rule.when((area >= least_area) | (side >= least_side), F.least(base, F.lit(most)))
    return rule.otherwise(base)


def landmarks_plausible(box: Box, points: Column) -> Column:
    """Whether five points (eyes, nose, corners of the mouth) sit like a face in the box; null points don't."""
    slack = F.lit(0.30) * F.greatest(box.width, box.height, F.lit(1.0))
    first = F.slice(points, 1, 5)
    inside = F.size(F.filter(first, lambda p: p["x"].between(box.x1 - slack, box.x2 + slack) & p["y"].between(box.y1 - slack, box.y2 + slack)))
    left, right, nose, lm, rm = (F.get(points, F.lit(i)) for i in range(5))
    eye_y, mouth_y = F.lit(0.5) * (left["y"] + right["y"]), F.lit(0.5) * (lm["y"] + rm["y"])
    apart = F.abs(right["x"] - left["x"])
    good = (
        (F.size(points) >= 5)
        & (inside >= 4)
        & (eye_y + 1.0 < nose["y"])
        & (nose["y"] < mouth_y - 1.0)
        & (F.abs(left["y"] - right["y"]) <= F.lit(0.50) * box.height)
        & (apart >= F.lit(0.10) * box.width)
        & (apart <= F.lit(0.90) * box.width)
    )
    return F.coalesce(good, F.lit(False))


def is_sane(box: Box, score: Column, points: Column, w: Column, h: Column, min_face: float) -> Column:
    """Whether to keep a detection: both sides and the aspect fit, and a large box has landmarks or a strong score."""
    aspect = box.width / F.greatest(box.height, F.lit(1e-3))
    area = box.width * box.height / F.greatest(F.lit(1.0), (w * h).cast("double"))
    large = (area > LARGE_AREA) | (box.width > F.lit(LARGE_WIDTH) * w) | (box.height > F.lit(LARGE_HEIGHT) * h)
    trusted = (landmarks_plausible(box, points) & (score >= LANDMARK_SCORE)) | (score >= STRONG_SCORE)
    return (box.width >= min_face) & (box.height >= min_face) & aspect.between(MIN_ASPECT, MAX_ASPECT) & (~large | trusted)


def size_bucket(box: Box) -> Column:
    """tiny, small, medium or large by the shorter side; half-open intervals."""
    rule = F
    for name, below in BUCKETS:
        rule = rule.when(box.min_side < below, F.lit(name))
    return rule.otherwise(F.lit("large"))


def resized(side: Column, scale: Column) -> Column:
    """A side after resizing: half-even rounding, at least 2, made even."""
    n = F.greatest(F.lit(2), F.rint(side * scale).cast("int"))
    return n + n % 2


def detect_scale(long_side: Column, w: Column, h: Column) -> Column:
    """Scale that brings the longer side to long_side; 1 where that is nothing or nothing changes."""
    longest = F.greatest(w, h)
    return F.when((long_side <= 0) | (long_side == longest), F.lit(1.0)).otherwise(long_side / longest)


def shifted_points(points: Column, dx: Column, dy: Column, inv: Column) -> Column:
    """Landmarks moved, then scaled; null stays null."""
    return F.transform(points, lambda p: F.struct(((p["x"] + dx) * inv).alias("x"), ((p["y"] + dy) * inv).alias("y")))
