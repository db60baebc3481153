"""Redaction: the plan for each box as columns, and the pixels by a vectorized helper over whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.boxes import Box, adaptive_pad

#: Sides below which a region is skipped, and a box painted as a rectangle; blur kernel bounds.
LEAST_REGION, RECT_BELOW, KERNEL_SHARE, LEAST_KERNEL, MOST_KERNEL, LEAST_BLOCKS = 4, 20, 0.55, 15, 151, 4


def redaction_plan(df: DataFrame, base_pad: float = 0.40, pixel_blocks: int = 10) -> DataFrame:
    """df with pad, the region rx1 ... ry2 (whole pixels, ends exclusive), shape, angle, kernel and blocks.

    Boxes whose region is under 4 pixels either way are dropped. The angle is that of the eyes, 0 without landmarks.
    """
    w, h, box = F.col("width"), F.col("height"), Box.of()
    df = df.withColumn("pad", adaptive_pad(box, w, h, F.lit(base_pad)))
    region = {f"r{n}": c.cast("int") for n, c in zip(Box._fields, box.expanded(F.col("pad"), w, h), strict=True)}
    # A generated row: as plain columns, Spark would copy the padding rule into the filter below four times, and such a
    # stage is too long for the JVM to compile.
    df = df.drop(*region).select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in region.items())))))
    rw, rh = F.col("rx2") - F.col("rx1"), F.col("ry2") - F.col("ry1")
    left, right = F.get("landmarks", F.lit(0)), F.get("landmarks", F.lit(1))
    angle = F.coalesce(F.degrees(F.atan2(right["y"] - left["y"], right["x"] - left["x"])), F.lit(0.0))
    odd = (F.greatest(rw, rh) * F.lit(KERNEL_SHARE)).cast("int").bitwiseOR(F.lit(1))
    return df.filter((rw >= LEAST_REGION) & (rh >= LEAST_REGION)).withColumns(
        {
            "shape": F.when(box.min_side < RECT_BELOW, F.lit("rect")).otherwise(F.lit("ellipse")),
            "angle": angle,
            "kernel": F.least(F.greatest(F.lit(LEAST_KERNEL), odd), F.lit(MOST_KERNEL)),
            "blocks": F.greatest(F.lit(LEAST_BLOCKS), F.least(F.lit(pixel_blocks), F.floor(F.least(rw, rh) / 2).cast("int"))),
        }
    )


def crop_region(df: DataFrame, pad: float = 0.05) -> DataFrame:
    """df with cx1 ... cy2: the box grown by pad, clipped, whole pixels."""
    region = Box.of().expanded(F.lit(pad), F.col("width"), F.col("height"))
    return df.withColumns({f"c{n}": c.cast("int") for n, c in zip(Box._fields, region, strict=True)})
