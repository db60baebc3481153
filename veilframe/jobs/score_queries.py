"""Registered queries of evaluation and audit, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import audit, evaluation as ev, sampling
from veilframe.operators.detections import FRAME, nms
from veilframe.sources.derived import DETECTIONS, UPLOADS, VIDEOS, derived
from veilframe.sources.store import kept

from .box_queries import BUCKET, d, fold, iou_sql, side


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of even lines, moved by 2 pixels, in every 15th frame."""
    rows = derived(spark, sf_dir, "detections").filter("line % 2 = 0 and frame_idx % 15 = 0")
    return rows.select(*FRAME, "det_idx", *((F.col(c) + 2).alias(c) for c in ("x1", "y1", "x2", "y2")))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configs' boxes in every 15th frame after suppression."""
    rows = ev.sample_every(derived(spark, sf_dir, "detections"))
    both = [nms(rows.select(*FRAME, "det_idx", F.col(s).alias("score"), "x1", "y1", "x2", "y2")).withColumn("config", F.lit(c)) for c, s in (("a", "score"), ("b", "score_b"))]
    return both[0].unionByName(both[1])


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.greedy_match(truth(spark, sf_dir), preds(spark, sf_dir), configs=["a", "b"])


TRUTH = f"select video_id, frame_idx, det_idx, x1 + 2 as x1, y1 + 2 as y1, x2 + 2 as x2, y2 + 2 as y2 from ({DETECTIONS}) where line % 2 = 0 and frame_idx % 15 = 0"
PREDS = " union all ".join(f"select video_id, frame_idx, '{c}' as config, det_idx, score, x1, y1, x2, y2 from ({fold(f'select * replace ({s} as score) from ({DETECTIONS}) where frame_idx % 15 = 0', 'det_idx')})" for c, s in (("a", "score"), ("b", "score_b")))
_BOX = "{'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
_PBOX = "{'score': score, 'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
#: Truth takes the first free prediction: a fold over lists of prediction numbers, 0 for none.
_TAKE = f"""list_append(acc, coalesce(list_filter(range(1, coalesce(len(preds), 0) + 1), lambda j: not list_contains(acc, j)
    and {iou_sql('gts[n[1]].', 'preds[j].')} >= {d(0.2)})[1], 0))"""
MATCHES = f"""select config, video_id, frame_idx, g.det_idx as gt_idx, g.x1 as x1, g.y1 as y1, g.x2 as x2, g.y2 as y2, j > 0 as hit,
      case when j > 0 then preds[j].det_idx end as pred_idx, case when j > 0 then preds[j].score end as pred_score
    from (select config, video_id, frame_idx, preds, unnest(gts) as g, unnest(taken) as j from (
      select *, list_reduce(list_transform(range(1, len(gts) + 1), lambda n: [n]), lambda acc, n: {_TAKE}, cast([] as bigint[])) as taken from (
        select c.config, g.video_id, g.frame_idx, gts, preds from (select video_id, frame_idx, list({_BOX} order by det_idx) as gts from ({TRUTH}) group by 1, 2) g
        cross join (select distinct config from ({PREDS})) c
        left join (select config, video_id, frame_idx, list({_PBOX} order by score desc, det_idx) as preds from ({PREDS}) group by 1, 2, 3) p
          on p.config = c.config and p.video_id = g.video_id and p.frame_idx = g.frame_idx)))"""


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev_ = derived(spark, sf_dir, "uploads")
    return ev_.filter("value is not null").select(F.when(F.col("event_seq") % 2 == 0, "a").otherwise("b").alias("config"), F.floor(F.col("value")).cast("double").alias("seconds"))


_TIMINGS = f"select case when event_seq % 2 = 0 then 'a' else 'b' end as config, cast(floor(value) as double) as seconds from ({UPLOADS}) where value is not null"


def score_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(preds(spark, sf_dir))
    return ev.score_configs(ev.greedy_match(truth(spark, sf_dir), found), found, timings(spark, sf_dir))


def pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(preds(spark, sf_dir))
    return ev.pr_counts(kept(ev.greedy_match(truth(spark, sf_dir), found)), found)


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "uploads").select(F.col("event_type").alias("model"), F.col("event_seq").alias("seq"), F.floor("value").cast("double").alias("ms"))
    return ev.latency_summary(t)


def frame_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = derived(spark, sf_dir, "detections").select(*FRAME).distinct()
    return frames.select(*FRAME, (F.col("frame_idx") % 11 == 0).alias("dark"), F.when(F.col("frame_idx") > 0, (F.col("frame_idx") * 7 % 23).cast("double")).alias("motion"))


_FLAGS = f"select distinct video_id, frame_idx, frame_idx % 11 = 0 as dark, case when frame_idx > 0 then cast(frame_idx * 7 % 23 as double) end as motion from ({DETECTIONS})"
_GATE = f"select f.video_id, f.frame_idx, f.dark or coalesce(f.motion > 18, false) or coalesce(t.tiny, false) as risky from ({_FLAGS}) f left join (select video_id, frame_idx, bool_or({side()} < 24) as tiny from ({DETECTIONS}) where pass = 0 group by 1, 2) t on f.video_id = t.video_id and f.frame_idx = t.frame_idx"


def risk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by frame: base and tile boxes merged where the frame is risky, base boxes elsewhere."""
    rows = derived(spark, sf_dir, "detections").select(*FRAME, "det_idx", "score", "x1", "y1", "x2", "y2", "pass")
    gate = ev.risk_gate(frame_flags(spark, sf_dir), rows.filter("pass = 0"))
    base, tiles = rows.filter("pass = 0"), rows.filter("pass > 0").join(gate.filter("risky"), FRAME, "left_semi")
    both = base.withColumn("src", F.lit(0)).unionByName(tiles.withColumn("src", F.lit(1)))
    merged = nms(both.join(gate.filter("risky"), FRAME, "left_semi"), order=("src", "det_idx"))
    calm = base.join(gate.filter("risky"), FRAME, "left_anti").withColumn("src", F.lit(0))
    return merged.unionByName(calm).select(*FRAME, "det_idx", "score", "src")


_ALL = f"select video_id, frame_idx, det_idx, score, case when pass = 0 then 0 else 1 end as src, x1, y1, x2, y2 from ({DETECTIONS})"


def risk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.risk_rates(ev.risk_gate(frame_flags(spark, sf_dir), derived(spark, sf_dir, "detections").filter("pass = 0")))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.normalize_videos(derived(spark, sf_dir, "videos").withColumnRenamed("raw_fps", "fps"))


def privacy_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "detections")
    before, after = rows.filter("line % 2 = 0"), rows.filter("score >= 0.5")
    return ev.privacy_eval(before, after, ev.sample_common(before, after, _videos(spark, sf_dir), 40))


_SAMPLED = f"""select video_id, frame_idx from (select distinct video_id, frame_idx from ({DETECTIONS}) where line % 2 = 0 intersect select distinct video_id, frame_idx from ({DETECTIONS}) where score >= 0.5)
    where frame_idx % 4 = 0 qualify row_number() over (partition by video_id order by frame_idx) <= 40"""


def sample_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "detections")
    return ev.sample_common(rows.filter("line % 2 = 0"), rows.filter("score >= 0.5"), _videos(spark, sf_dir), 40)


def qc_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = derived(spark, sf_dir, "detections").filter("line = 7").select("video_id", (F.col("frame_idx") + 3).alias("frame_idx"))
    return sampling.select_qc_frames(_videos(spark, sf_dir), hints, 0.15, 30)


_FPS = f"case when raw_fps <= {d(0.001)} then {d(25)} else raw_fps end"
_QC = f"""with c as (
    select video_id, unnest(range(0, nframes, greatest(1, round_even({d(0.15)} * {_FPS}, 0)::bigint))) as frame_idx from ({VIDEOS})
    union select video_id, frame_idx + 3 from ({DETECTIONS}) where line = 7 and frame_idx + 3 < 170
  ), r as (select *, row_number() over (partition by video_id order by frame_idx) - 1 as rank, count(*) over (partition by video_id) as n from c)
  select video_id, frame_idx from r where n <= 30 or list_contains(list_transform(range(30), lambda i: round_even(i * ((n - 1) / 29::double), 0)::bigint), rank)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of even lines on the redacted output; one in seven is still visible."""
    rows = derived(spark, sf_dir, "detections").filter("line % 2 = 0")
    return rows.select(*FRAME, "det_idx", "score", "x1", "y1", "x2", "y2", ((F.col("frame_idx") + F.col("det_idx")) % 7 == 0).alias("visible"))


_HITS = f"select video_id, frame_idx, det_idx, score, x1, y1, x2, y2, (frame_idx + det_idx) % 7 = 0 as visible from ({DETECTIONS}) where line % 2 = 0"


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sample = qc_sample(spark, sf_dir)
    frames = audit.qc_frames(derived(spark, sf_dir, "detections").select(*FRAME).distinct(), sample)
    hits = audit.find_leaks(_hits(spark, sf_dir).join(sample, FRAME, "left_semi"), _videos(spark, sf_dir))
    return sample, frames, hits


_LARGE = "greatest(cast(0 as double), x2 - x1) >= 12 and greatest(cast(0 as double), y2 - y1) >= 12"
_CHECKED = f"select distinct d.video_id, d.frame_idx from ({DETECTIONS}) d semi join ({_QC}) q on d.video_id = q.video_id and d.frame_idx = q.frame_idx"
_LEAKS = f"select h.*, h.frame_idx / {_FPS} as t_sec, h.visible as leak from ({_HITS}) h semi join ({_QC}) q on h.video_id = q.video_id and h.frame_idx = q.frame_idx join ({VIDEOS}) v on h.video_id = v.video_id where {_LARGE.replace('x2', 'h.x2').replace('x1', 'h.x1').replace('y2', 'h.y2').replace('y1', 'h.y1')}"


def qc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)[1]


def find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)[2].select(*FRAME, "det_idx", "t_sec", "leak")


def _report(spark: SparkSession, sf_dir: str, fast: bool) -> DataFrame:
    sample, frames, hits = _checked(spark, sf_dir)
    if fast:
        frames, hits = audit.until_first_leak(frames, hits), audit.until_first_leak(hits, hits)
    return audit.qc_report(frames, hits, _videos(spark, sf_dir), sample, 0.15, 30)


def qc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _report(spark, sf_dir, False)
    return r.select("video_id", "status", "frames_checked", "hits", "suppressed", "leak_count", "leak_rate", F.get("leaks", F.lit(0))["t_sec"].alias("first_leak"), F.array_join("notes", "; ").alias("notes"))


def qc_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, True).select("video_id", "status", "frames_checked", "hits", "leak_count")


def _report_sql(frames: str, hits: str) -> str:
    return f"""select v.video_id, v.nframes, coalesce(frames_checked, 0) as frames_checked, coalesce(hits, 0) as hits, coalesce(leak_count, 0) as leak_count, first_leak, coalesce(sampled, 0) as sampled
      from ({VIDEOS}) v left join (select video_id, count(*) as frames_checked from ({frames}) group by 1) f on v.video_id = f.video_id
      left join (select video_id, count(*) as hits, count(*) filter (where leak) as leak_count, min(t_sec) filter (where leak) as first_leak from ({hits}) group by 1) h on v.video_id = h.video_id
      left join (select video_id, count(*) as sampled from ({_QC}) group by 1) s on v.video_id = s.video_id"""


_FIRST = f"select video_id, min(frame_idx) as first from ({_LEAKS}) where leak group by 1"


def _until(rows: str) -> str:
    return f"select r.* from ({rows}) r left join ({_FIRST}) x on r.video_id = x.video_id where x.first is null or r.frame_idx <= x.first"


def choose_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _report(spark, sf_dir, False)
    second = first.select("video_id", F.lit("pass").alias("status"), F.when(F.col("leak_count") % 3 > 0, F.col("leak_count") * 2 - 12).alias("leak_count"))
    return audit.choose_retry(first, second)


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "detections")
    times = derived(spark, sf_dir, "videos").select("video_id", (F.col("nframes") / 8).alias("seconds"), F.lit(2.5).alias("detect_seconds"), F.lit(40).cast("long").alias("calls"))
    return audit.run_metrics(rows.select(*FRAME).distinct(), rows.filter("score >= 0.5"), times)


def frame_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = frame_flags(spark, sf_dir)
    stats = flags.select(*FRAME, F.when(F.col("frame_idx") % 5 < 4, 60.0).otherwise(100.0).alias("luma"), F.array(F.when(F.col("dark"), 10.0).otherwise(90.0)).alias("tiles"), "motion")
    lost = derived(spark, sf_dir, "detections").filter("line = 7 and pass = 0")
    return audit.frame_hints(stats, lost)


def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "uploads").groupBy(F.col("config_hash").alias("tracker")).agg(F.count(F.lit(1)).alias("n"))
    new = derived(spark, sf_dir, "jobs").groupBy(F.col("config_hash").alias("tracker")).agg(F.count(F.lit(1)).alias("n"))
    return ev.merge_report(rows, new, new.filter("tracker < 'cfg4'").select("tracker"))


def pr_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pr_points(pr(spark, sf_dir))


_T = "(select unnest(range(1, 20)) / 20::double as threshold)"
_COUNTS = f"""with m as materialized ({MATCHES}), p as materialized ({PREDS})
  select c.config, t.threshold, (select count(*) from p where p.config = c.config and score >= t.threshold) as npred,
    (select count(*) from m where m.config = c.config and pred_score >= t.threshold) as tp, (select count(*) from m where m.config = c.config) as gt
  from (select distinct config from p) c cross join {_T} t"""
_POINTS = f"select *, tp / greatest(1, gt)::double as recall, case when npred > 0 then tp / npred::double else 1 end as precision from ({_COUNTS})"

QUERIES = {
    "sample_eval_frames": sample_common, "greedy_match": matches, "score_configs": score_configs,
    "recall_by_size": lambda s, f: ev.recall_by_size(matches(s, f)), "risk_gate": risk_gate, "risk_rates": risk_rates,
    "pr_counts": pr, "pr_curve": pr_sweep, "average_precision": lambda s, f: ev.average_precision(pr(s, f)),
    "operating_points": lambda s, f: ev.operating_points(pr(s, f)), "privacy_eval": privacy_eval, "latency_summary": latency_summary,
    "select_qc_frames": qc_sample, "qc_frames": qc_frames, "find_leaks": find_leaks, "qc_report": qc_report, "qc_fail_fast": qc_fail_fast,
    "choose_retry": choose_retry, "run_metrics": run_metrics, "frame_hints": frame_hints, "merge_report": merge_report,
}

ORACLES = {
    "sample_eval_frames": _SAMPLED,
    "greedy_match": MATCHES,
    "score_configs": f"""select t.config, matched / greatest(1, gt_faces)::double as recall, matched / greatest(1, pred_faces)::double as precision, gt_faces, pred_faces, matched, gt_faces - matched as missed,
        1000::double * seconds / greatest(1, frames) as ms_per_frame, 1000::double / (1000::double * seconds / greatest(1, frames)) as detect_fps, frames
      from (select config, count(*) as frames, sum(seconds) as seconds from ({_TIMINGS}) group by 1) t
      join (select config, count(*) as gt_faces, count(*) filter (where hit) as matched from ({MATCHES}) group by 1) m on t.config = m.config
      join (select config, count(*) as pred_faces from ({PREDS}) group by 1) p on t.config = p.config""",
    "recall_by_size": f"""with m as materialized ({MATCHES}), b as (select config, {BUCKET} as bucket, hit from m union all select config, null, hit from m)
      select s.config, s.bucket, count(b.hit) as gt, count(*) filter (where b.hit) as tp, case when count(b.hit) > 0 then count(*) filter (where b.hit) / count(b.hit)::double end as recall
      from (select config, unnest(['tiny', 'small', 'medium', 'large', null]) as bucket from (select distinct config from m)) s
      left join b on b.config = s.config and b.bucket is not distinct from s.bucket group by s.config, s.bucket""",
    "risk_gate": f"""with g as materialized (select * from ({_GATE}) where risky)
      select video_id, frame_idx, det_idx, score, src from ({fold(f'select a.* from ({_ALL}) a semi join g on a.video_id = g.video_id and a.frame_idx = g.frame_idx', 'src, det_idx', fields='det_idx, score, src, x1, y1, x2, y2')})
      union all select a.video_id, a.frame_idx, det_idx, score, src from ({_ALL}) a anti join g on a.video_id = g.video_id and a.frame_idx = g.frame_idx where src = 0""",
    "risk_rates": f"select video_id, count(*) as frames, count(*) filter (where risky) as risk_frames, avg(risky::int::double) as risk_rate from ({_GATE}) group by 1",
    "pr_counts": _COUNTS,
    "pr_curve": _POINTS,
    "average_precision": f"""select config, coalesce(sum(area), 0) as ap from (select config, (recall - lag(recall) over w) * (envelope + lag(envelope) over w) / 2 as area from (
        select *, max(precision) over (partition by config order by recall, threshold rows between current row and unbounded following) as envelope from ({_POINTS})) window w as (partition by config order by recall, threshold)) group by 1""",
    "operating_points": f"""select config, max(recall) as max_recall, {', '.join(f'max(recall) filter (where precision >= {d(p)}) as recall_at_p{int(p * 100)}' for p in (0.5, 0.6, 0.7))},
        {', '.join(f'max(precision) filter (where recall >= {d(r)}) as precision_at_r{int(r * 100)}' for r in (0.95, 0.97))} from ({_POINTS}) group by 1""",
    "privacy_eval": f"""with s as materialized ({_SAMPLED}), g as (select t.* from ({DETECTIONS}) t semi join s on t.video_id = s.video_id and t.frame_idx = s.frame_idx where line % 2 = 0),
        v as (select t.* from ({DETECTIONS}) t semi join s on t.video_id = s.video_id and t.frame_idx = s.frame_idx where score >= 0.5),
        c as (select g.* from g where not exists (select 1 from v where v.video_id = g.video_id and v.frame_idx = g.frame_idx and {iou_sql('g.', 'v.')} >= {d(0.2)})),
        n as (select video_id, count(*) as frames from s group by 1)
      select n.video_id, frames, gt_faces, visible_faces, covered, visible_faces / greatest(1, gt_faces)::double as residual_rate, covered / greatest(1, gt_faces)::double as coverage_rate from (
        select n.video_id, frames, (select count(*) from g where g.video_id = n.video_id) as gt_faces, (select count(*) from v where v.video_id = n.video_id) as visible_faces,
          (select count(*) from c where c.video_id = n.video_id) as covered from n) n""",
    "latency_summary": f"""select model, count(*) as calls, avg(ms) as mean_ms, case when avg(ms) > 0 then 1000::double / avg(ms) end as fps from (
        select event_type as model, cast(floor(value) as double) as ms from ({UPLOADS}) qualify row_number() over (partition by event_type order by event_seq) > 8) group by 1""",
    "select_qc_frames": _QC,
    "qc_frames": _CHECKED,
    "find_leaks": f"select video_id, frame_idx, det_idx, t_sec, leak from ({_LEAKS})",
    "qc_report": f"""select video_id, case when leak_count > 0 then 'needs_review' else 'pass' end as status, frames_checked, hits, hits - leak_count as suppressed, leak_count,
        case when frames_checked > 0 then leak_count / frames_checked::double else 0 end as leak_rate, first_leak,
        case when sampled < nframes then concat(sampled, ' of ', nframes, ' frames looked at: one every 0.15 s, 30 at most; ') else '' end
          || concat(hits, ' faces found, ', leak_count, ' still visible, ', hits - leak_count, ' covered') as notes from ({_report_sql(_CHECKED, _LEAKS)})""",
    "qc_fail_fast": f"select video_id, case when leak_count > 0 then 'needs_review' else 'pass' end as status, frames_checked, hits, leak_count from ({_report_sql(_until(_CHECKED), _until(_LEAKS))})",
    "choose_retry": f"""select video_id, case when better then 'pass' when leak_count > 0 then 'needs_review' else 'pass' end as status, case when better then second else leak_count end as leak_count,
        leak_count > 0 as retried, leak_count > 0 and not better as retry_rejected
      from (select *, leak_count > 0 and second <= leak_count as better from (select *, coalesce(case when leak_count % 3 > 0 then leak_count * 2 - 12 end, 1) as second from ({_report_sql(_CHECKED, _LEAKS)})))""",
    "run_metrics": f"""select v.video_id, frames, nframes / 8::double as seconds, frames / (nframes / 8::double) as throughput, coalesce(frames_with_faces, 0) as frames_with_faces, coalesce(faces_painted, 0) as faces_painted,
        40::bigint as detect_calls, 62.5::double as ms_per_call from ({VIDEOS}) v join (select video_id, count(distinct frame_idx) as frames from ({DETECTIONS}) group by 1) f on v.video_id = f.video_id
      left join (select video_id, count(*) as faces_painted, count(distinct frame_idx) as frames_with_faces from ({DETECTIONS}) where score >= 0.5 group by 1) p on v.video_id = p.video_id""",
    "frame_hints": f"""select video_id, frame_idx, hint from (select video_id, frame_idx, 'dark' as hint from ({_FLAGS}) where frame_idx % 5 < 4 or dark union all select video_id, frame_idx, 'motion' from ({_FLAGS}) where motion > 18)
      qualify row_number() over (partition by video_id, hint order by frame_idx) <= 80 union all select distinct video_id, frame_idx, 'track_loss' from ({DETECTIONS}) where line = 7 and pass = 0""",
    "merge_report": "select concat('cfg', user_id % 8) as tracker, count(*) as n from events group by 1 having tracker >= 'cfg4' union all select concat('cfg', o_orderkey % 8) as tracker, count(*) as n from orders group by 1 having tracker < 'cfg4'",
}
