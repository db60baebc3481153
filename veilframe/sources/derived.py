"""Box, video, upload and job tables derived from the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIDEOS = """
    select concat('v', s_suppkey) as video_id,
      cast(case when s_suppkey % 4 = 3 then 0 when s_suppkey % 4 = 2 then 24 else 30 end as double) as raw_fps,
      case when s_suppkey % 2 = 0 then 480 else 1280 end as width,
      case when s_suppkey % 2 = 0 then 360 else 720 end as height, cast(170 as bigint) as nframes
    from supplier
"""

DETECTIONS = """
    with b as (
      select l_suppkey, l_orderkey, l_linenumber, l_partkey, cast(l_quantity as double) as q, l_orderkey % 120 as k,
        case when l_suppkey % 2 = 0 then 480 else 1280 end as fw, case when l_suppkey % 2 = 0 then 360 else 720 end as fh
      from lineitem
    ), g as (
      select *, cast(k + 20 * floor(k / cast(40 as double)) as bigint) as frame_idx,
        case when l_partkey % 50 = 0 then fw * cast(0.5 as double) else q + 4 end as w,
        20 + (l_partkey % 4) * fw * cast(0.1875 as double) + l_linenumber * 3 as x1,
        15 + (cast(floor(l_partkey / cast(4 as double)) as bigint) % 3) * fh * cast(0.25 as double) + l_linenumber * 2 as y1,
        cast((l_partkey * 31 + l_linenumber * 17 + cast(q as bigint) * 7) % 128 as double) / 128 as score,
        cast((l_partkey * 37 + l_linenumber * 17 + cast(q as bigint) * 7) % 128 as double) / 128 as score_b
      from b
    )
    select concat('v', l_suppkey) as video_id, frame_idx,
      cast(row_number() over (partition by l_suppkey, frame_idx order by l_orderkey, l_linenumber, l_partkey, q) - 1 as int) as det_idx,
      cast(x1 as double) as x1, cast(y1 as double) as y1, cast(x1 + w as double) as x2, cast(y1 + w * cast(1.25 as double) as double) as y2,
      cast(score as double) as score, cast(score_b as double) as score_b, l_partkey % 5 = 0 as no_landmarks, fw, fh,
      l_linenumber as line, cast(l_partkey % 3 as int) as pass
    from g
"""

UPLOADS = """
    select event_id as event_seq, ts, concat('evt-', user_id * 20 + event_id % 20) as upload_id,
      concat('fp-', (event_id * 7919) % 2003) as content_fp, concat('cfg', user_id % 8) as config_hash, event_type, value
    from events
"""

JOBS = """
    select concat('job-', o_orderkey) as job_id, concat('evt-', o_orderkey) as upload_id,
      concat('fp-', (o_orderkey * 104729) % 2003) as content_fp, concat('cfg', o_orderkey % 8) as config_hash,
      case o_orderkey % 5 when 0 then 'queued' when 1 then 'processing' when 2 then 'completed'
        when 3 then 'needs_review' else 'failed' end as status, o_orderdate as created_at
    from orders
"""

TABLES = {"videos": ("supplier", VIDEOS), "detections": ("lineitem", DETECTIONS), "uploads": ("events", UPLOADS), "jobs": ("orders", JOBS)}

#: Landmarks of a box as a list of structs: eyes, nose, corners of the mouth at fixed shares of the box.
FACE = [(0.30, 0.35), (0.70, 0.35), (0.50, 0.55), (0.35, 0.78), (0.65, 0.78)]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """videos, detections, uploads or jobs."""
    source, query = TABLES[name]
    return spark.sql(query.replace(f"from {source}", f"from {{{source}}}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def face_points(box: str = "") -> str:
    """SQL for the five landmarks of columns x1 ... y2, null where no_landmarks; the same in both engines but for the list."""
    p = f"{box}." if box else ""
    points = ", ".join(f"{{'x': {p}x1 + ({p}x2 - {p}x1) * cast({a} as double), 'y': {p}y1 + ({p}y2 - {p}y1) * cast({b} as double)}}" for a, b in FACE)
    return f"case when {p}no_landmarks then null else [{points}] end"


def with_landmarks(df: DataFrame) -> DataFrame:
    """Detections with `landmarks`, array<struct<x, y>> or null."""
    points = ", ".join(f"named_struct('x', x1 + (x2 - x1) * cast({a} as double), 'y', y1 + (y2 - y1) * cast({b} as double))" for a, b in FACE)
    return df.selectExpr("*", f"case when no_landmarks then null else array({points}) end as landmarks")
