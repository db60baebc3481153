"""Registered queries on boxes and detections, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.boxes import Box, adaptive_pad, detect_scale, iou, is_sane, landmarks_plausible, resized, size_bucket
from veilframe.operators import detections as det
from veilframe.operators import redaction, sampling
from veilframe.sources.derived import DETECTIONS, VIDEOS, derived, face_points, with_landmarks

KEY = ["video_id", "frame_idx", "det_idx"]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with landmarks and the frame's width and height."""
    return with_landmarks(derived(spark, sf_dir, "detections")).withColumnsRenamed({"fw": "width", "fh": "height"})


#: The same in DuckDB.
BOXES = f"select * replace (1 as no_landmarks) from (select *, fw as width, fh as height, {face_points()} as landmarks from ({DETECTIONS}))"


def w(p: str = "") -> str:
    return f"greatest(cast(0 as double), {p}x2 - {p}x1)"


def h(p: str = "") -> str:
    return f"greatest(cast(0 as double), {p}y2 - {p}y1)"


def side(p: str = "") -> str:
    return f"least({w(p)}, {h(p)})"


def clip(x: str, size: str) -> str:
    return f"least(greatest({x}, cast(0 as double)), cast({size} - 1 as double))"


def clipped(p: str = "") -> str:
    return ", ".join(f"{clip(p + c, s)} as {c}" for c, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height")))


def iou_sql(a: str, b: str) -> str:
    iw = f"greatest(cast(0 as double), least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    ih = f"greatest(cast(0 as double), least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    union = f"({w(a)} * {h(a)} + {w(b)} * {h(b)} - {iw} * {ih})"
    return f"(case when {union} > 0 then {iw} * {ih} / {union} else cast(0 as double) end)"


def d(x: float) -> str:
    return f"cast({x} as double)"


PLAUSIBLE = f"""coalesce(len(landmarks) >= 5 and
    len(list_filter(landmarks[1:5], lambda p: p.x between x1 - {d(0.3)} * greatest({w()}, {h()}, {d(1)}) and x2 + {d(0.3)} * greatest({w()}, {h()}, {d(1)})
        and p.y between y1 - {d(0.3)} * greatest({w()}, {h()}, {d(1)}) and y2 + {d(0.3)} * greatest({w()}, {h()}, {d(1)}))) >= 4
    and {d(0.5)} * (landmarks[1].y + landmarks[2].y) + 1 < landmarks[3].y and landmarks[3].y < {d(0.5)} * (landmarks[4].y + landmarks[5].y) - 1
    and abs(landmarks[1].y - landmarks[2].y) <= {d(0.5)} * {h()}
    and abs(landmarks[2].x - landmarks[1].x) between {d(0.1)} * {w()} and {d(0.9)} * {w()}, false)"""


def sane(min_face: float = 6) -> str:
    large = f"({w()} * {h()} / greatest({d(1)}, cast(width * height as double)) > {d(0.08)} or {w()} > {d(0.35)} * width or {h()} > {d(0.38)} * height)"
    aspect = f"{w()} / greatest({h()}, {d(0.001)})"
    return f"({w()} >= {min_face} and {h()} >= {min_face} and {aspect} between {d(0.4)} and {d(2.2)} and (not {large} or ({PLAUSIBLE} and score >= {d(0.32)}) or score >= {d(0.75)}))"


PAD = "case when width <= 0 or height <= 0 then {b} when {s} < 24 then {b} * cast(1.35 as double)" + "".join(
    f" when {w()} * {h()} / cast(width * height as double) >= {d(a)} or greatest({w()} / cast(width as double), {h()} / cast(height as double)) >= {d(s)} then least({{b}}, {d(m)})"
    for a, s, m in ((0.40, 0.75, 0.08), (0.18, 0.50, 0.14), (0.08, 0.35, 0.22))
) + " else {b} end"


def pad_sql(base: float) -> str:
    return PAD.format(b=d(base), s=side())


BUCKET = f"case when {side()} < 16 then 'tiny' when {side()} < 32 then 'small' when {side()} < 64 then 'medium' else 'large' end"


def box_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    return boxes(spark, sf_dir).select(*KEY, b.width.alias("w"), b.height.alias("h"), b.cx.alias("cx"), b.cy.alias("cy"), size_bucket(b).alias("bucket"))


def clip_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select(*KEY, *Box.of().clipped(F.col("width"), F.col("height")).columns())


def expand_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    pad = adaptive_pad(b, F.col("width"), F.col("height"), F.lit(0.42))
    return boxes(spark, sf_dir).select(*KEY, pad.alias("pad"), *b.expanded(pad, F.col("width"), F.col("height")).columns())


def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a frame's order of detections."""
    df = boxes(spark, sf_dir).select(*KEY, "x1", "y1", "x2", "y2")
    nxt = df.select("video_id", "frame_idx", (F.col("det_idx") - 1).alias("det_idx"), F.struct("x1", "y1", "x2", "y2").alias("n"))
    return df.join(nxt, KEY).select(*KEY, iou(Box.of(), Box.of(F.col("n"))).alias("iou"))


def plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    ok = is_sane(b, F.col("score"), F.col("landmarks"), F.col("width"), F.col("height"), 6.0)
    return boxes(spark, sf_dir).select(*KEY, landmarks_plausible(b, F.col("landmarks")).alias("plausible"), ok.alias("sane"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = det.scale_boxes(boxes(spark, sf_dir), F.lit(0.5))
    return out.select(*KEY, "x1", "y1", "x2", "y2", F.get("landmarks", F.lit(2))["x"].alias("nose_x"))


def detect_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = derived(spark, sf_dir, "videos").withColumn("long_side", F.explode(F.array(F.lit(0), F.lit(640), F.lit(960), F.lit(1280))))
    w_, h_ = F.col("width"), F.col("height")
    s = detect_scale(F.col("long_side"), w_, h_)
    same = (F.col("long_side") <= 0) | (F.col("long_side") == F.greatest(w_, h_))
    return v.select("video_id", "long_side", s.alias("scale"), F.when(same, w_).otherwise(resized(w_, s)).alias("det_w"), F.when(same, h_).otherwise(resized(h_, s)).alias("det_h"))


def letterbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.letterbox_geometry(derived(spark, sf_dir, "videos"), 640)


def min_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.min_face_filter(boxes(spark, sf_dir), 12).select(*KEY)


def redaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redaction.redaction_plan(boxes(spark, sf_dir), 0.42, 10)
    return out.select(*KEY, "rx1", "ry1", "rx2", "ry2", "shape", F.round("angle", 6).alias("angle"), "kernel", "blocks")


def detection_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = boxes(spark, sf_dir).select("video_id", "frame_idx").distinct()
    return sampling.detection_schedule(frames, extra_every=3, strong_every=0)


def qc_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = derived(spark, sf_dir, "videos").select(
        "video_id", F.when(F.col("width") == 480, "cpu").otherwise("cuda").alias("device"), F.lit(1.5).alias("interval"), F.lit(160).alias("max_frames"),
        F.when(F.col("raw_fps") == 24.0, 3.0).alias("cpu_interval"), F.lit(60).alias("cpu_max_frames"),
    )
    return sampling.qc_budget(v)


def frame_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = boxes(spark, sf_dir).select("video_id", "frame_idx").distinct()
    return sampling.frame_time(frames, sampling.normalize_videos(derived(spark, sf_dir, "videos").withColumnRenamed("raw_fps", "fps")))


def normalize_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = derived(spark, sf_dir, "videos").withColumnRenamed("raw_fps", "fps").withColumn("nframes", F.when(F.col("fps") != 24.0, F.col("nframes")))
    return sampling.normalize_videos(v)


def crop_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.crop_region(boxes(spark, sf_dir)).select(*KEY, "cx1", "cy1", "cx2", "cy2")


def _nms(rule: str):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return det.nms(boxes(spark, sf_dir).select(*KEY, "score", "x1", "y1", "x2", "y2"), 0.4, rule)

    return query


def fold(source: str, order: str, rule: str = ">=", threshold: float = 0.4, fields: str = "det_idx, score, x1, y1, x2, y2") -> str:
    """DuckDB: boxes of each frame that non-maximum suppression keeps."""
    row = ", ".join(f"'{f}': {f}" for f in fields.split(", "))
    over = iou_sql("k.", "x[1].") + f" {rule} {d(threshold)}"
    return f"""select video_id, frame_idx, unnest(kept, recursive := true) from (
        select video_id, frame_idx, list_reduce(list_transform(rows, lambda r: [r]),
            lambda acc, x: case when len(list_filter(acc, lambda k: {over})) > 0 then acc else list_concat(acc, x) end, rows[1:0]) as kept
        from (select video_id, frame_idx, list({{{row}}} order by score desc, {order}) as rows from ({source}) group by video_id, frame_idx))"""


def _passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as if from passes at two long sides, one of them twice."""
    side_ = F.when(F.col("pass") == 0, F.greatest("width", "height")).otherwise(F.greatest("width", "height") * 2)
    return boxes(spark, sf_dir).select(*KEY, "score", "x1", "y1", "x2", "y2", "landmarks", "width", "height", "pass", side_.alias("long_side"))


def merge_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.merge_scales(_passes(spark, sf_dir), columns=[*KEY, "score", "x1", "y1", "x2", "y2"])


def merge_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select(*KEY, "score", "x1", "y1", "x2", "y2", "landmarks", "width", "height", "pass")
    return det.merge_strong(rows.filter("pass = 0"), rows.filter("pass > 0"), columns=[*KEY, "score", "x1", "y1", "x2", "y2"])


def tiles_plus_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select(*KEY, "score", "x1", "y1", "x2", "y2", "pass")
    return det.tiles_plus_base(rows.filter("pass = 0"), rows.filter("pass > 0")).select(*KEY, "score", "x1", "y1", "x2", "y2")


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.tile_grid(derived(spark, sf_dir, "videos"))


def untile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select(*KEY, "score", "x1", "y1", "x2", "y2", "landmarks", "width", "height", (F.col("pass") * 128).alias("tile_x"), F.lit(0).alias("tile_y"), F.lit(2.0).alias("scale"))
    return det.untile_boxes(rows).select(*KEY, "score", "x1", "y1", "x2", "y2")


def prior_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = derived(spark, sf_dir, "videos").select(F.col("height").alias("net_h"), F.col("width").alias("net_w")).distinct()
    return det.prior_boxes(sizes)


def anchor_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four anchors from each embedding, as if outputs for a 480 x 360 network input."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    parts = e.select(F.concat(F.lit("v"), F.col("label")).alias("video_id"), F.col("vec_id").alias("frame_idx"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("a"))
    values = [F.get("embedding", F.col("a") * 16 + i).cast("double") for i in range(16)]
    return parts.select(
        "video_id", "frame_idx", ((F.col("frame_idx") * 4 + F.col("a")) % 7000).cast("int").alias("anchor_idx"), (values[4] * 2 + 0.5).alias("score"),
        F.array(*values[:4]).alias("loc"), F.array(*values[6:16]).alias("lms"), F.lit(360).alias("net_h"), F.lit(480).alias("net_w"),
        F.lit(0.75).alias("scale"), F.lit(640).alias("width"), F.lit(480).alias("height"),
    )


def decode_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors = det.prior_boxes(spark.range(1).select(F.lit(360).alias("net_h"), F.lit(480).alias("net_w")))
    out = det.decode_anchors(anchor_outputs(spark, sf_dir), priors, 0.5)
    rounded = [F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")]
    eye, mouth = F.get("landmarks", F.lit(0)), F.get("landmarks", F.lit(4))
    return out.select("video_id", "frame_idx", "anchor_idx", "score", *rounded, F.round(eye["x"], 6).alias("eye_x"), F.round(mouth["y"], 6).alias("mouth_y"))


def decode_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = anchor_outputs(spark, sf_dir)
    rows = a.select(
        "video_id", "frame_idx", F.lit(16).alias("stride"), (F.col("anchor_idx") % 1200).alias("cell"), F.lit(30).alias("cols"), "score",
        F.transform("loc", lambda x: F.abs(x) * 4).alias("dist"), F.col("lms").alias("kps"), "scale", "width", "height",
    )
    out = det.decode_distances(rows.filter("score >= 0.5"))
    return out.select("video_id", "frame_idx", "cell", "score", "x1", "y1", "x2", "y2", F.get("landmarks", F.lit(1))["x"].alias("eye_x"))


ANCHORS = """select *, embedding[a * 16 + 5]::double * 2 + cast(0.5 as double) as score, ((frame_idx * 4 + a) % 7000)::int as anchor_idx
    from (select concat('v', label) as video_id, vec_id as frame_idx, embedding, unnest([0, 1, 2, 3]) as a from embeddings)"""

PRIORS = """select net_h, net_w, step, sz, i, j, k, cols,
        (case when step > 8 then ceil(net_h / 8.0::double) * ceil(net_w / 8.0::double) * 2 else 0 end
         + case when step > 16 then ceil(net_h / 16.0::double) * ceil(net_w / 16.0::double) * 2 else 0 end + (i * cols + j) * 2 + k)::int as anchor_idx,
        (j + 0.5::double) * step / net_w as cx, (i + 0.5::double) * step / net_h as cy, sz / net_w::double as sx, sz / net_h::double as sy
    from (select *, unnest(range(cols)) as j from (select *, unnest(range(ceil(net_h / step::double)::int)) as i, ceil(net_w / step::double)::int as cols
        from ({sizes}), (values (8, 0, 16), (8, 1, 32), (16, 0, 64), (16, 1, 128), (32, 0, 256), (32, 1, 512)) as t(step, k, sz)))"""

_SIZES = f"select distinct height as net_h, width as net_w from ({VIDEOS})"
_GEO = """case when long_side <= 0 or long_side = greatest(width, height) then 1::double else long_side / greatest(width, height)::double end"""


def even(x: str, s: str) -> str:
    n = f"greatest(2, round_even({x} * {s}, 0)::int)"
    return f"case when long_side <= 0 or long_side = greatest(width, height) then {x} else {n} + {n} % 2 end"


def starts(size: str) -> str:
    r = f"range(0, greatest(1, {size} - 639), 512)"
    return f"case when {r}[-1] + 640 < {size} then list_append({r}, greatest(0, {size} - 640)) else {r} end"


def _scaled_rows(inv: str, source: str, more: str = "") -> str:
    """Boxes times inv, clipped, with landmarks times inv; to be filtered by sane()."""
    coords = ", ".join(f"{clip(f'{c} * {inv}', s)} as {c}" for c, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height")))
    return f"select video_id, frame_idx, det_idx, score, width, height{more}, {coords}, list_transform(landmarks, lambda p: {{'x': p.x * {inv}, 'y': p.y * {inv}}}) as landmarks from ({source})"


_TILED = "select video_id, frame_idx, det_idx, score, width, height, tile_x, " + ", ".join(f"{clip(f'({c} + {o}) / {d(2)}', s)} as {c}" for c, o, s in (("x1", "tile_x", "width"), ("y1", "0", "height"), ("x2", "tile_x", "width"), ("y2", "0", "height"))) + f", list_transform(landmarks, lambda p: {{'x': (p.x + tile_x) / {d(2)}, 'y': p.y / {d(2)}}}) as landmarks from (select *, pass * 128 as tile_x from ({BOXES}))"
_STRONG = f"select video_id, frame_idx, det_idx, score, 0 as origin, x1, y1, x2, y2 from ({BOXES}) where pass = 0 union all select video_id, frame_idx, det_idx, score, 1 as origin, x1, y1, x2, y2 from (select * replace ({clipped()}) from ({BOXES}) where pass > 0) where {sane()}"
_BASE = f"select video_id, frame_idx, det_idx, score, case when pass = 0 then 0 else 1 end as origin, x1, y1, x2, y2 from ({BOXES})"
_EXPANDED = f"select *, {pad_sql(0.42)} as pad from ({BOXES})"


def expanded(p: str) -> str:
    return ", ".join(f"{clip(e, s)} as {c}" for c, e, s in (("x1", f"x1 - {w()} * {p}", "width"), ("y1", f"y1 - {h()} * {p}", "height"), ("x2", f"x2 + {w()} * {p}", "width"), ("y2", f"y2 + {h()} * {p}", "height")))


_PLAN = f"""select *, trunc(ex1)::int as rx1, trunc(ey1)::int as ry1, trunc(ex2)::int as rx2, trunc(ey2)::int as ry2 from (
    select *, {expanded('pad').replace(' as x1', ' as ex1').replace(' as y1', ' as ey1').replace(' as x2', ' as ex2').replace(' as y2', ' as ey2')} from ({_EXPANDED}))"""

QUERIES = {
    "box_dims": box_dims, "clip_box": clip_box, "expand_box": expand_box, "box_iou": box_iou, "sane_boxes": plausible, "scale_boxes": scaled,
    "detect_geometry": detect_geometry, "letterbox_geometry": letterbox_geometry, "min_face_filter": min_face, "redaction_plan": redaction_plan,
    "detection_schedule": detection_schedule, "qc_budget": qc_budget, "frame_time": frame_time, "normalize_videos": normalize_videos,
    "crop_region": crop_region, "nms": _nms("ge"), "nms_gt": _nms("gt"), "merge_scales": merge_scales, "merge_strong": merge_strong,
    "tiles_plus_base": tiles_plus_base, "tile_grid": tile_grid, "untile_boxes": untile_boxes, "prior_boxes": prior_boxes,
    "decode_anchors": decode_anchors, "decode_distances": decode_distances,
}

K = "video_id, frame_idx, det_idx"
ORACLES = {
    "box_dims": f"select {K}, {w()} as w, {h()} as h, {d(0.5)} * (x1 + x2) as cx, {d(0.5)} * (y1 + y2) as cy, {BUCKET} as bucket from ({BOXES})",
    "clip_box": f"select {K}, {clipped()} from ({BOXES})",
    "expand_box": f"select {K}, pad, {expanded('pad')} from ({_EXPANDED})",
    "box_iou": f"select a.video_id, a.frame_idx, a.det_idx, {iou_sql('a.', 'b.')} as iou from ({DETECTIONS}) a join ({DETECTIONS}) b on a.video_id = b.video_id and a.frame_idx = b.frame_idx and b.det_idx = a.det_idx + 1",
    "sane_boxes": f"select {K}, {PLAUSIBLE} as plausible, {sane()} as sane from ({BOXES})",
    "scale_boxes": f"select {K}, x1, y1, x2, y2, landmarks[3].x as nose_x from ({_scaled_rows(d(0.5), BOXES)}) where {sane()}",
    "detect_geometry": f"select video_id, long_side, {_GEO} as scale, {even('width', _GEO)} as det_w, {even('height', _GEO)} as det_h from (select *, unnest([0, 640, 960, 1280]) as long_side from ({VIDEOS}))",
    "letterbox_geometry": f"""select *, (ceil(net_w / 32.0::double) * 32)::int as pad_w, (ceil(net_h / 32.0::double) * 32)::int as pad_h from (
        select video_id, s as scale, round_even(width * s, 0)::int as net_w, round_even(height * s, 0)::int as net_h, s2 as square_scale,
            greatest(2, round_even(width * s2, 0)::int) + greatest(2, round_even(width * s2, 0)::int) % 2 as square_w,
            greatest(2, round_even(height * s2, 0)::int) + greatest(2, round_even(height * s2, 0)::int) % 2 as square_h
        from (select *, least(1::double, 640 / greatest(width, height)::double) as s, 640 / greatest(width, height)::double as s2 from ({VIDEOS})))""",
    "min_face_filter": f"select {K} from ({BOXES}) where {w()} >= 12 and {h()} >= 12",
    "redaction_plan": f"""select {K}, rx1, ry1, rx2, ry2, case when {side()} < 20 then 'rect' else 'ellipse' end as shape,
        round(coalesce(degrees(atan2(landmarks[2].y - landmarks[1].y, landmarks[2].x - landmarks[1].x)), 0), 6) as angle,
        least(greatest(15, trunc(greatest(rx2 - rx1, ry2 - ry1) * {d(0.55)})::int | 1), 151) as kernel,
        greatest(4, least(10, least(rx2 - rx1, ry2 - ry1) // 2))::int as blocks from ({_PLAN}) where rx2 - rx1 >= 4 and ry2 - ry1 >= 4""",
    "detection_schedule": f"select distinct video_id, frame_idx, frame_idx % 3 = 0 as extra_scale, false as strong from ({DETECTIONS})",
    "qc_budget": f"select video_id, case when width = 480 and raw_fps = 24 then {d(3)} else {d(1.5)} end as use_interval, case when width = 480 then 60 else 160 end as use_max_frames from ({VIDEOS})",
    "frame_time": f"select distinct d.video_id, frame_idx, frame_idx / case when raw_fps <= {d(0.001)} then {d(25)} else raw_fps end as t_sec from ({DETECTIONS}) d join ({VIDEOS}) v on d.video_id = v.video_id",
    "normalize_videos": f"select video_id, case when raw_fps <= {d(0.001)} then {d(25)} else raw_fps end as fps, width, height, case when raw_fps <> 24 then nframes else 0 end as nframes from ({VIDEOS})",
    "crop_region": f"select {K}, trunc(x1)::int as cx1, trunc(y1)::int as cy1, trunc(x2)::int as cx2, trunc(y2)::int as cy2 from (select {K}, {expanded(d(0.05))} from ({BOXES}))",
    "nms": fold(DETECTIONS, "det_idx"),
    "nms_gt": fold(DETECTIONS, "det_idx", ">"),
    "merge_scales": f"select {K}, score, x1, y1, x2, y2 from ({fold(f'''select * from ({_scaled_rows(f'(case when long_side = greatest(width, height) then {d(1)} else {d(1)} / (long_side / greatest(width, height)::double) end)', f'select *, greatest(width, height) * case when pass = 0 then 1 else 2 end as long_side, min(pass) over (partition by video_id, frame_idx, case when pass = 0 then 1 else 2 end) as first_pass from ({BOXES}) qualify pass = first_pass', ', pass')}) where {sane()}''', 'pass, det_idx')})",
    "merge_strong": fold(_STRONG, "origin, det_idx"),
    "tiles_plus_base": fold(_BASE, "origin, det_idx"),
    "tile_grid": f"""select *, least(det_w, tile_x + 640) as tile_x2, least(det_h, tile_y + 640) as tile_y2 from (
        select video_id, scale, det_w, det_h, tile_y, unnest({starts('det_w')})::int as tile_x from (select *, unnest({starts('det_h')})::int as tile_y from (
        select video_id, {_GEO} as scale, {even('width', _GEO)} as det_w, {even('height', _GEO)} as det_h from (select *, greatest(1280, width, height) as long_side from ({VIDEOS})))))""",
    "untile_boxes": fold(f"select * from ({_TILED}) where {sane()}", "tile_x, det_idx"),
    "prior_boxes": f"select net_h, net_w, anchor_idx, cx, cy, sx, sy from ({PRIORS.format(sizes=_SIZES)})",
    "decode_anchors": f"""select video_id, frame_idx, anchor_idx, score, round({clip('bx * 640', '640')}, 6) as x1, round({clip('byy * 480', '480')}, 6) as y1,
            round({clip('(bx + bw) * 640', '640')}, 6) as x2, round({clip('(byy + bh) * 480', '480')}, 6) as y2,
            round((cx + embedding[a * 16 + 7]::double * {d(0.1)} * sx) * 640, 6) as eye_x, round((cy + embedding[a * 16 + 16]::double * {d(0.1)} * sy) * 480, 6) as mouth_y
        from (select *, cx + embedding[a * 16 + 1]::double * {d(0.1)} * sx - bw / 2 as bx, cy + embedding[a * 16 + 2]::double * {d(0.1)} * sy - bh / 2 as byy
        from (select *, sx * exp(embedding[a * 16 + 3]::double * {d(0.2)}) as bw, sy * exp(embedding[a * 16 + 4]::double * {d(0.2)}) as bh
        from ({ANCHORS}) join ({PRIORS.format(sizes='select 360 as net_h, 480 as net_w')}) using (anchor_idx) where score > {d(0.5)}))""",
    "decode_distances": "select video_id, frame_idx, cell, score, " + ", ".join(f"{clip(c, s)} as {c}" for c, s in (("x1", "640"), ("y1", "480"), ("x2", "640"), ("y2", "480"))) + f", eye_x from ({fold(f'''select video_id, frame_idx, cell, score, (px - abs(embedding[a * 16 + 1]::double) * 4 * 16) / {d(0.75)} as x1, (py - abs(embedding[a * 16 + 2]::double) * 4 * 16) / {d(0.75)} as y1, (px + abs(embedding[a * 16 + 3]::double) * 4 * 16) / {d(0.75)} as x2, (py + abs(embedding[a * 16 + 4]::double) * 4 * 16) / {d(0.75)} as y2, (px + embedding[a * 16 + 9]::double * 16) / {d(0.75)} as eye_x from (select *, anchor_idx % 1200 as cell, (anchor_idx % 1200) // 2 % 30 * 16 as px, (anchor_idx % 1200) // 2 // 30 * 16 as py from ({ANCHORS})) where score >= {d(0.5)}''', 'cell', '>', 0.4, 'cell, score, x1, y1, x2, y2, eye_x')})",
}
