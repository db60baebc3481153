"""Work on pixels: brightness, motion, painting and residual visibility. One vectorized helper for each pass over frames.

Frames carry Spark's image struct; only statistics and 16-to-1 thumbnails are ever shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilframe.operators.redaction import redaction_plan
from veilframe.sources.store import kept

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
FRAME_SCHEMA = f"video_id string, frame_idx long, image {IMAGE}"
#: Luma weights (B, G, R), grid of luma samples and of thumbnails, tiles a side, 8-bit BGR mode.
LUMA, LUMA_STEP, THUMB_STEP, TILES, BGR_MODE = (0.114, 0.587, 0.299), 8, 16, 4, 16
#: Most boxes (about 150 bytes each) that are broadcast to their frames.
MAX_BOXES = 200_000
#: Bytes of pixels that a map over frames holds as Python values at once (a larger frame alone).
STEP_BYTES = 4 << 20
#: Fixed values of the visibility test: rim trimmed, least side, mosaic side, least error and texture.
RIM, LEAST_SIDE, MOSAIC, LEAST_MAE, LEAST_LAPLACIAN = 0.12, 8, 8, 9.0, 22.0


def read_frames(spark: SparkSession, path: str, pattern: str = r"([^/]+)/(\d+)\.[A-Za-z]+$") -> DataFrame:
    """Image files as frames: the pattern's groups in the file's path are video_id and frame_idx."""
    df = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return df.select(F.regexp_extract("image.origin", pattern, 1).alias("video_id"), F.regexp_extract("image.origin", pattern, 2).cast("long").alias("frame_idx"), "image")


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames as Parquet, each task's where they are, and in path/_manifest which file has which frames of which videos.

    No pixels shuffle, and there are as many files as tasks, however many videos. read_written uses the manifest.
    """
    spark = frames.sparkSession
    frames.write.parquet(path)
    where = spark.read.parquet(path).select("video_id", "frame_idx", F.col("_metadata.file_path").alias("file"))
    ranges = where.groupBy("file", "video_id").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.count(F.lit(1)).alias("frames"))
    ranges.write.parquet(f"{path}/_manifest")


def read_written(spark: SparkSession, path: str, video_id: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Frames of write_frames: all, or a video's from first to last, for which only files that may hold some are opened."""
    manifest = spark.read.parquet(f"{path}/_manifest")
    asked = F.lit(True) if video_id is None else F.col("video_id") == video_id
    low, high = (F.lit(True) if first is None else F.col("last") >= first), (F.lit(True) if last is None else F.col("first") <= last)
    whole = spark.read.schema(FRAME_SCHEMA)
    if video_id is None and first is None and last is None:
        return whole.parquet(path)
    files = [r.file for r in manifest.filter(asked & low & high).select("file").distinct().toLocalIterator()]
    rows = whole.parquet(*files) if files else whole.parquet(path).limit(0)
    within = (F.lit(True) if first is None else F.col("frame_idx") >= first) & (F.lit(True) if last is None else F.col("frame_idx") <= last)
    return rows.filter(asked & within)


def store_frames(frames: DataFrame, table: str, buckets: int) -> DataFrame:
    """Frames as a table in buckets by video and frame, and that table: boxes then go to the pixels, however many they are.

    Joins by video and frame (attach_boxes, residual_visibility, qc_frames) read its buckets where they lie and shuffle
    the boxes alone. Take buckets of a few hundred megabytes. Writing moves no pixels either: each task writes its part
    of each bucket.
    """
    frames.write.bucketBy(buckets, "video_id", "frame_idx").mode("overwrite").saveAsTable(table)
    return frames.sparkSession.table(table)


def pixels(image: dict) -> np.ndarray:
    """Height x width x 3 array of an image struct."""
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])


def map_frames(frames: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """frames.mapInPandas(run, schema), with batches that are cut to STEP_BYTES of pixels before they become Python values.

    Spark's batches hold up to 10,000 frames or 64 MB; as values, and again as what run makes of them, they are several
    times as much in each task.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = pc.binary_length(pc.struct_field(batch.column("image"), "data")).fill_null(0).to_pylist()
            first, held = 0, 0
            for i, n in enumerate(sizes):
                if i > first and held + n > STEP_BYTES:
                    yield batch.slice(first, i - first).to_pandas()
                    first, held = i, 0
                held += n
            if first < len(sizes):
                yield batch.slice(first).to_pandas()

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(steps(batches)):
            yield pa.RecordBatch.from_pandas(out, fields, preserve_index=False)
        pa.default_memory_pool().release_unused()

    return frames.mapInArrow(arrow, schema)


def luma(frame: np.ndarray) -> float:
    return float(frame[::LUMA_STEP, ::LUMA_STEP].reshape(-1, 3).mean(axis=0) @ np.array(LUMA))


def frame_numbers(f: np.ndarray) -> tuple[float, list[float], bytes, int, int]:
    """luma, tiles (luma of 4 x 4 tiles), thumb, thumb_h, thumb_w of a frame's pixels."""
    th, tw = max(1, f.shape[0] // TILES), max(1, f.shape[1] // TILES)
    tiles = [f[i * th : (i + 1) * th, j * tw : (j + 1) * tw] for i in range(TILES) for j in range(TILES)]
    thumb = f[::THUMB_STEP, ::THUMB_STEP]
    return luma(f), [luma(t) for t in tiles if t.size], thumb.tobytes(), thumb.shape[0], thumb.shape[1]


def is_dark(mean: float, tiles: list[float], threshold: float) -> bool:
    return mean < threshold or any(t < threshold for t in tiles)


def frame_stats(frames: DataFrame) -> DataFrame:
    """video_id, frame_idx, luma, tiles (luma of 4 x 4 tiles), thumb, thumb_h, thumb_w: one pass over the pixels."""

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [frame_numbers(pixels(image)) for image in batch["image"]]
            yield pd.concat([batch[["video_id", "frame_idx"]].reset_index(drop=True), pd.DataFrame(out, columns=["luma", "tiles", "thumb", "thumb_h", "thumb_w"])], axis=1)

    return map_frames(frames, stats, "video_id string, frame_idx long, luma double, tiles array<double>, thumb binary, thumb_h int, thumb_w int")


def any_tile_dark(tiles: Column, threshold: float = 72.0) -> Column:
    return F.exists(tiles, lambda t: t < threshold)


def frame_motion(stats: DataFrame, span: int = 4096) -> DataFrame:
    """stats with `motion`: the standard deviation of a thumbnail's difference from the previous frame's; null if none of that shape.

    A video's frames are compared in ranges of `span` frame numbers, each a group of its own with the last thumbnail
    before it, so that a long video is many tasks' work.
    """

    @F.pandas_udf("double")
    def deviation(now: pd.Series, before: pd.Series) -> pd.Series:
        def one(a: bytes, b: bytes | None) -> float | None:
            return None if b is None else float((np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).std())

        return pd.Series([one(a, b) for a, b in zip(now, before, strict=True)], dtype="object")

    own = F.struct("thumb", "thumb_h", "thumb_w")
    ranged = stats.withColumn("_range", F.floor(F.col("frame_idx") / span))
    ends = ranged.groupBy("video_id", "_range").agg(F.max_by(own, "frame_idx").alias("_end"))
    halo = ends.select("video_id", "_range", F.lag("_end").over(Window.partitionBy("video_id").orderBy("_range")).alias("_halo"))
    order = Window.partitionBy("video_id", "_range").orderBy("frame_idx")
    last = ranged.join(halo, ["video_id", "_range"]).withColumn("_last", F.coalesce(F.lag(own).over(order), "_halo"))
    same = (F.col("_last.thumb_h") == F.col("thumb_h")) & (F.col("_last.thumb_w") == F.col("thumb_w"))
    return last.withColumn("motion", deviation("thumb", F.when(same, F.col("_last.thumb")))).select(*stats.columns, "motion")


#: Fixed values of the CIE Lab conversion: linear sRGB (R, G, B) to XYZ over its white, and the cube root's linear part.
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]) / np.array([[0.950456], [1.0], [1.088754]])
LAB_EDGE, LAB_SLOPE, LAB_SHIFT = 0.008856, 7.787, 16 / 116


def to_lab(f: np.ndarray) -> np.ndarray:
    """8-bit B, G, R to lightness 0 ... 255, a and b."""
    c = f[..., ::-1].astype(np.float64) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = linear @ TO_XYZ.T
    t = np.where(xyz > LAB_EDGE, np.cbrt(xyz), LAB_SLOPE * xyz + LAB_SHIFT)
    return np.stack([(116 * t[..., 1] - 16) * 2.55, 500 * (t[..., 0] - t[..., 1]), 200 * (t[..., 1] - t[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """to_lab turned round, to whole values."""
    y = (lab[..., 0] / 2.55 + 16) / 116
    t = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    xyz = np.where(t**3 > LAB_EDGE, t**3, (t - LAB_SHIFT) / LAB_SLOPE)
    c = np.clip(xyz @ np.linalg.inv(TO_XYZ).T, 0, 1)
    c = np.where(c <= 0.0031308, 12.92 * c, 1.055 * c ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(c * 255), 0, 255).astype(np.uint8)[..., ::-1]


def equalized(plane: np.ndarray, clip: float, grid: int) -> np.ndarray:
    """Contrast-limited equalization of a whole-valued plane: each tile's mapping, and between tiles' centers their mean.

    Sides are filled up by mirroring to a multiple of the grid; what a tile's histogram has above the limit is spread evenly.
    """
    h, w = plane.shape
    th, tw = -(-h // grid), -(-w // grid)
    full = np.pad(plane, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect" if min(h, w) > max(th * grid - h, tw * grid - w) else "edge")
    tiles = full.reshape(grid, th, grid, tw).swapaxes(1, 2).reshape(grid * grid, th * tw)
    counts = np.bincount((tiles + 256 * np.arange(grid * grid)[:, None]).ravel(), minlength=256 * grid * grid).reshape(grid * grid, 256)
    limit = max(1, int(clip * th * tw / 256))
    over = np.maximum(counts - limit, 0).sum(axis=1)
    counts = np.minimum(counts, limit) + (over // 256)[:, None]
    for row, left in zip(counts, (over % 256).tolist(), strict=True):
        if left:
            row[np.arange(0, 256, max(1, 256 // left))[:left]] += 1
    maps = np.rint(np.cumsum(counts, axis=1) * 255 / (th * tw)).clip(0, 255).reshape(grid, grid, 256)

    def ends(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return low.clip(0, grid - 1), (low + 1).clip(0, grid - 1), at - low

    (top, bottom, v), (left, right, u) = ends(h, th), ends(w, tw)
    rows = [maps[y[:, None], left[None, :], plane] * (1 - u) + maps[y[:, None], right[None, :], plane] * u for y in (top, bottom)]
    return np.rint(rows[0] * (1 - v)[:, None] + rows[1] * v[:, None]).astype(np.uint8)


def lightened(f: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """A frame with its lightness equalized, its colours as they are."""
    lab = to_lab(f)
    lab[..., 0] = equalized(np.rint(lab[..., 0]).clip(0, 255).astype(np.uint8), clip, grid)
    return from_lab(lab)


def enhance_dark_frames(frames: DataFrame, threshold: float = 72.0, clip: float = 2.0, grid: int = 8) -> DataFrame:
    """Frames with the contrast of their lightness stretched where they, or a tile of them, are dark; others as they are."""

    def change(f: np.ndarray, _: object) -> np.ndarray:
        return lightened(f, clip, grid) if is_dark(*frame_numbers(f)[:2], threshold) else f

    return _changed(frames, change)


def _changed(frames: DataFrame, change: Callable[[np.ndarray, object], np.ndarray], timed: bool = False) -> DataFrame:
    """Frames with change(pixels, boxes) as their pixels; boxes is the column of that name, if there; timed: and `seconds`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            boxes = batch["boxes"] if "boxes" in batch else [None] * len(batch)
            images, seconds = [], []
            for image, b in zip(batch["image"], boxes, strict=True):
                began = time.perf_counter()
                images.append(dict(image) | {"data": np.ascontiguousarray(change(pixels(image), b)).tobytes()})
                seconds.append(time.perf_counter() - began)
            out = pd.DataFrame({"video_id": batch["video_id"], "frame_idx": batch["frame_idx"], "image": images})
            yield out.assign(seconds=seconds) if timed else out

    return map_frames(frames, run, FRAME_SCHEMA + ", seconds double" * timed)


def _blurred(roi: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur with the usual width for a kernel of `size`; edges are mirrored."""
    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = roi.astype(np.float32)
    for axis in (0, 1):
        n = out.shape[axis]
        place = np.abs(np.arange(-(size // 2), n + size // 2))
        period = max(1, 2 * (n - 1))
        place = place % period
        place = np.where(place >= n, period - place, place)
        wide = np.take(out, place, axis=axis)
        out = sum(k * np.take(wide, np.arange(i, i + n), axis=axis) for i, k in enumerate(kernel))
    return out


def _mosaic(roi: np.ndarray, blocks: int) -> np.ndarray:
    """roi sampled between pixels at blocks x blocks places, each shown over its part."""
    h, w = roi.shape[:2]
    out = roi.astype(np.float32)
    for axis, n in ((0, h), (1, w)):
        at = np.clip((np.arange(blocks) + 0.5) * n / blocks - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        out = np.take(out, low, axis=axis) * (1 - part) + np.take(out, np.minimum(low + 1, n - 1), axis=axis) * part
    return out[np.arange(h) * blocks // h][:, np.arange(w) * blocks // w]


def _ellipse(h: int, w: int, angle: float) -> np.ndarray:
    """Weights 0 ... 1 of a turned ellipse that fills the region, feathered at its rim."""
    y, x = np.mgrid[:h, :w]
    a, c, s = np.radians(angle), w // 2, h // 2
    dx, dy = x - c, y - s
    u, v = dx * np.cos(a) + dy * np.sin(a), dy * np.cos(a) - dx * np.sin(a)
    inside = (u / max(1, c)) ** 2 + (v / max(1, s)) ** 2 <= 1
    return _blurred(inside.astype(np.float32) * 255, 7) / 255


def paint(frame: np.ndarray, boxes: list[dict], method: str, shape: str) -> np.ndarray:
    """frame with its planned boxes (see redaction_plan) redacted one after another."""
    out = frame.copy()
    for b in boxes:
        at = np.s_[b["ry1"] : b["ry2"], b["rx1"] : b["rx2"]]
        roi = out[at]
        if method == "blackout":
            new = np.zeros(roi.shape, np.float32)
        else:
            new = np.rint(_blurred(roi, b["kernel"])) if method != "pixelate" else roi
            new = new if method == "blur" else np.rint(_mosaic(new, b["blocks"]))
        if shape == "ellipse" and b["shape"] == "ellipse":
            alpha = _ellipse(*roi.shape[:2], b["angle"])[..., None]
            new = alpha * new + (1 - alpha) * roi
        out[at] = new.astype(np.uint8)
    return out


def small_side(lists: DataFrame, column: str, most: int = MAX_BOXES) -> DataFrame:
    """Lists of boxes by frame, stored; to be broadcast if they hold at most so many boxes, so that no pixels shuffle.

    With more, they are hashed to the frames' partitions: pixels stay where they are if these come from store_frames.
    Other frames move then.
    """
    lists = kept(lists)
    return F.broadcast(lists) if (lists.agg(F.sum(F.size(column) + 1)).first()[0] or 0) <= most else lists.hint("shuffle_hash")


def attach_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Frames with their planned boxes in order; frames without any pass through with an empty list."""
    row = F.struct("order", "rx1", "ry1", "rx2", "ry2", "shape", "angle", "kernel", "blocks")
    lists = boxes.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(row)).alias("boxes"))
    joined = frames.join(small_side(lists, "boxes"), ["video_id", "frame_idx"], "left")
    return joined.withColumn("boxes", F.coalesce("boxes", F.slice(F.array(F.struct(*(F.lit(0).cast(t).alias(n) for n, t in (("order", "long"), ("rx1", "int"), ("ry1", "int"), ("rx2", "int"), ("ry2", "int"), ("shape", "string"), ("angle", "double"), ("kernel", "int"), ("blocks", "int"))))), 1, 0)))


def redact_frames(frames: DataFrame, boxes: DataFrame, method: str = "hybrid", shape: str = "ellipse", pad: float = 0.40, pixel_blocks: int = 10, videos: DataFrame | None = None, timed: bool = False) -> DataFrame:
    """Frames with boxes painted over: blackout, blur, pixelate or hybrid (blur, then pixelate); ellipse or rect.

    boxes: video_id, frame_idx, order, x1 ... y2, landmarks. The same frames come out, in number and size. Sizes are
    those that videos (video_id, width, height) states, or else of the frames themselves, which are then read twice.
    timed adds `seconds`, what painting a frame took.
    """
    if videos is None:
        sized = boxes.join(frames.select("video_id", "frame_idx", F.col("image.width").alias("width"), F.col("image.height").alias("height")), ["video_id", "frame_idx"])
    else:
        sized = boxes.join(videos.select("video_id", "width", "height"), "video_id")
    plan = redaction_plan(sized, pad, pixel_blocks).withColumn("order", F.col("order").cast("long"))
    return _changed(attach_boxes(frames, plan), lambda f, b: paint(f, list(b), method, shape), timed)


def visibility(crop: np.ndarray) -> tuple[bool, float, float]:
    """Whether a crop still shows a photographic face: error of an 8 x 8 mosaic of it, and its texture."""
    if min(crop.shape[:2], default=0) < LEAST_SIDE:
        return False, 0.0, 0.0
    ends = [(int(n * RIM), max(int(n * RIM) + LEAST_SIDE, int(n * (1 - RIM)))) for n in crop.shape[:2]]
    roi = crop[ends[0][0] : ends[0][1], ends[1][0] : ends[1][1]].astype(np.float64)
    h, w = roi.shape[:2]
    if min(h, w) < LEAST_SIDE:
        return False, 0.0, 0.0
    gray = np.rint(roi @ np.array(LUMA))
    edge = np.pad(gray, 1, mode="reflect")
    laplacian = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * gray

    def shares(n: int) -> np.ndarray:
        """How much each of n pixels adds to each part of the mosaic."""
        cut = np.linspace(0, n, MOSAIC + 1)
        return np.clip(np.minimum(cut[1:, None], np.arange(1, n + 1)) - np.maximum(cut[:-1, None], np.arange(n)), 0, None) * MOSAIC / n

    tiny = np.rint(np.einsum("ih,hwc,jw->ijc", shares(h), roi, shares(w)))
    back = tiny[np.arange(h) * MOSAIC // h][:, np.arange(w) * MOSAIC // w]
    mae, texture = float(np.abs(roi - back).mean()), float(laplacian.var())
    return mae >= LEAST_MAE and texture >= LEAST_LAPLACIAN, mae, texture


def residual_visibility(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes (video_id, frame_idx, det_idx, cx1 ... cy2) with visible, mae and laplacian of their crops in frames."""
    lists = boxes.groupBy("video_id", "frame_idx").agg(F.collect_list(F.struct("det_idx", "cx1", "cy1", "cx2", "cy2")).alias("crops"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video, frame, image, crops in batch[["video_id", "frame_idx", "image", "crops"]].itertuples(index=False):
                f = pixels(image)
                out += [(video, frame, c["det_idx"], *visibility(f[c["cy1"] : c["cy2"], c["cx1"] : c["cx2"]])) for c in crops]
            yield pd.DataFrame(out, columns=["video_id", "frame_idx", "det_idx", "visible", "mae", "laplacian"])

    return map_frames(frames.join(small_side(lists, "crops"), ["video_id", "frame_idx"]), look, "video_id string, frame_idx long, det_idx int, visible boolean, mae double, laplacian double")


def detect_frames(frames: DataFrame, factory: Callable[[], Callable[[np.ndarray], np.ndarray]], threshold: float, rule: str = "ge", points: bool = False) -> DataFrame:
    """Boxes by a detector that `factory` makes once in each Python worker: pixels -> rows (x1, y1, x2, y2, score).

    Scores count from threshold on (rule 'ge') or above it ('gt'). Rows may go on with five points (x, y): with points,
    they come out as `landmarks`, null where they are missing or not numbers.
    """
    fields = ["video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "score"] + ["landmarks"] * points

    def marks(row: np.ndarray) -> list[dict] | None:
        return [{"x": x, "y": y} for x, y in row[5:15].reshape(5, 2).tolist()] if len(row) >= 15 and not np.isnan(row[5:15]).any() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory()
        for batch in batches:
            out = []
            for video, frame, image in batch[["video_id", "frame_idx", "image"]].itertuples(index=False):
                rows = [r for r in map(np.asarray, detector(pixels(image))) if (r[4] >= threshold if rule == "ge" else r[4] > threshold)]
                out += [(video, frame, i, *map(float, r[:5]), *([marks(r.astype(float))] if points else ())) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=fields)

    return map_frames(frames, run, "video_id string, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double" + ", landmarks array<struct<x:double,y:double>>" * points)
