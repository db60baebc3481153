"""Tracking of long stretches in parts: all parts at once from a guess of their first state, and a check at each seam.

What live tracks are at a frame depends in practice on the frames shortly before it. Each part starts from a warm-up
stretch before its first frame; where the state it reaches is, bit for bit, the one that the part before it ends with, it
is what one pass would have given. Parts where it isn't are tracked again from that end, and so on for a few rounds.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.sources.store import kept

from .tracking import HITS, ID, SCHEMA, Live, Rules, emitted, run_frames

#: Frames of a part, and rounds after which a stretch that still has wrong seams is left to one pass.
SPAN, ROUNDS = 4096, 4
STRETCH = ["video_id", "segment"]
PART = [*STRETCH, "part"]
PARTED = SCHEMA + ", segment long, part long, seam boolean, before binary, after binary, state binary, hits_before binary, born long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def packed(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x, allow_pickle=False)
    return out.getvalue()


def unpacked(x: bytes) -> np.ndarray:
    return np.load(io.BytesIO(x), allow_pickle=False)


def warm_up(rules: Rules) -> int:
    """Frames before a part that it looks at: enough for tracks to be born, to settle and to end, and for skipping to begin."""
    return 6 * (rules.max_age + 1) + (rules.skip_after or 0)


def meaning(live: Live, rules: Rules) -> bytes:
    """A state's bytes without what makes no difference to later frames: names of tracks, and counts beyond their limits."""
    rows = live.rows[:, 1:] + 0.0
    rows[:, HITS - 1] = np.minimum(rows[:, HITS - 1], rules.min_hits)
    return rows.tobytes() + int(min(live.empty, rules.skip_after or 0)).to_bytes(4, "little")


def _tracked(rows: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """A part's emitted rows, and one that describes its seams. Tracks that it begins with are named -1, -2 ... in their order."""
    rows = rows.sort_values(["frame_idx", "det_idx"], kind="stable")
    video, begin, start, stop, seed = (rows[c].iloc[0] for c in ("video_id", "begin", "start", "stop", "seed"))
    frames, moving = rows["frame_idx"].to_numpy(), frozenset(rows.loc[rows["moving"].astype(bool), "frame_idx"])
    dets, cut = rows[["x1", "y1", "x2", "y2", "score", "det_idx"]].to_numpy(float), int(np.searchsorted(frames, start))
    if seed is None:
        live = Live()
        for _ in run_frames(live, frames[:cut], dets[:cut], int(begin), int(start), rules, moving):
            pass
    else:
        table = unpacked(seed)
        live = Live(table[1:].copy(), 0, int(table[0, 0]))
    hits, live.born = live.rows[:, HITS].copy(), 0
    live.rows[:, ID] = -1 - np.arange(len(live.rows))
    before = meaning(live, rules)
    out = emitted(video, run_frames(live, frames[cut:], dets[cut:], int(start), int(stop), rules, moving)).assign(seam=False)
    state = np.vstack([np.full((1, live.rows.shape[1]), float(live.empty)), live.rows])
    seam = pd.DataFrame({"video_id": [video], "seam": True, "before": before, "after": meaning(live, rules), "state": packed(state), "hits_before": packed(hits), "born": live.born})
    both = pd.concat([out, seam], ignore_index=True)
    for c in ("frame_idx", "track_id", "det_idx", "hits", "time_since_update", "born"):
        both[c] = both[c].astype("Int64")
    for c in ("before", "after", "state", "hits_before"):
        both[c] = both[c].astype(object).where(both[c].notna(), None)
    return both.assign(segment=rows["segment"].iloc[0], part=rows["part"].iloc[0])[[c.split()[0] for c in PARTED.split(", ")]]


def _names(seams: pd.DataFrame) -> pd.DataFrame:
    """For each part of a stretch: how far its own tracks are numbered on (local 0), and who those are that it begins with."""
    out, born, last, inherited = [], 0, None, []
    for part, state, hits, own in seams.sort_values("part")[["part", "state", "hits_before", "born"]].itertuples(index=False):
        known = []
        for k, h in enumerate(unpacked(hits) if last is not None else ()):
            name, seen = int(last[k, ID]), float(last[k, HITS])
            who, more = (name + shift, 0.0) if name > 0 else inherited[-name - 1]
            known.append((who, seen + more - h))
        out += [(part, 0, born, 0)] + [(part, -1 - k, who, int(more)) for k, (who, more) in enumerate(known)]
        inherited, last, shift = known, unpacked(state)[1:], born
        born += int(own)
    video, segment = seams["video_id"].iloc[0], seams["segment"].iloc[0]
    return pd.DataFrame(out, columns=["part", "local", "name", "more"]).assign(video_id=video, segment=segment)[["video_id", "segment", "part", "local", "name", "more"]]


def track_in_parts(rows: DataFrame, rules: Rules, span: int = SPAN, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(tracked, left): rows as of one pass, with segment, and the stretches (video_id, segment) whose seams did not settle.

    rows: video_id, segment, frame_idx, det_idx, x1 ... y2, score, moving, first and end of the stretch. A group is one
    part: span frames and a warm-up. Seams are a small row each; names of tracks go from part to part by them.
    """
    warm = min(span, warm_up(rules))
    own = rows.withColumn("part", F.floor(F.col("frame_idx") / span))
    order = Window.partitionBy(*STRETCH).orderBy("part")
    head = F.lit(0).cast("long") if rules.skip_after is not None else F.col("first")
    parts = own.groupBy(*PART).agg(F.first("first").alias("first"), F.first("end").alias("end"))
    start = F.when(F.lag("part").over(order).isNull(), head).otherwise(F.col("part") * span)
    parts = parts.select(*PART, start.alias("start"), F.coalesce(F.lead("part").over(order) * span, F.col("end")).alias("stop"), F.lag("part").over(order).isNull().alias("leads"))
    parts = kept(parts.withColumn("begin", F.when(F.col("leads"), F.col("start")).otherwise(F.col("start") - warm)))
    both = F.when(F.col("frame_idx") >= (F.col("part") + 1) * span - warm, F.array("part", F.col("part") + 1)).otherwise(F.array("part"))
    dealt = own.drop("first", "end").withColumn("part", F.explode(both)).join(parts.drop("leads"), PART).filter("frame_idx >= begin and frame_idx < stop")
    dealt = kept(dealt)

    def tracked(df: DataFrame) -> DataFrame:
        return kept(df.groupBy(*PART).applyInPandas(lambda part: _tracked(part, rules), PARTED))

    done = tracked(dealt.withColumn("seed", F.lit(None).cast("binary")))
    for nth in range(rounds + 1):
        seams = kept(done.filter("seam"))
        last = F.lag(F.struct("after", "state")).over(order)
        wrong = kept(seams.withColumn("last", last).filter("last is not null and last.after != before").select(*PART, F.col("last.state").alias("seed")))
        if nth == rounds or wrong.isEmpty():
            break
        done = kept(done.join(wrong, PART, "left_anti").unionByName(tracked(dealt.join(wrong, PART))))
    left = wrong.select(*STRETCH).distinct()
    settled = done.join(left, STRETCH, "left_anti")
    names = kept(seams.join(left, STRETCH, "left_anti").groupBy(*STRETCH).applyInPandas(_names, "video_id string, segment long, part long, local long, name long, more long"))
    found = settled.filter("not seam").withColumn("local", F.when(F.col("track_id") > 0, F.lit(0)).otherwise(F.col("track_id")).cast("long"))
    named = found.join(names, [*PART, "local"])
    track_id = F.when(F.col("local") == 0, F.col("track_id") + F.col("name")).otherwise(F.col("name"))
    return named.withColumns({"track_id": track_id, "hits": (F.col("hits") + F.col("more")).cast("int")}).select(*COLUMNS, "segment"), left
