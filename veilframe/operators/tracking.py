"""Tracks from detections: ordered state per video, in segments that are safe to track apart.

One helper holds the transition of a video's live tracks as numpy arrays; the batch operator runs it per segment in
grouped pandas, the streaming one per video with stored state. It moves boxes only, never frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.sources.store import dealt_by, kept

#: Rows of SCHEMA in which a track is hit, with its velocity and the number of frames in which it then coasts.
RUNS = "video_id string, frame_idx long, track_id long, x1 double, y1 double, x2 double, y2 double, score double, det_idx int, hits int, segment long, vx double, vy double, more int"
SCHEMA = "video_id string, frame_idx long, track_id long, x1 double, y1 double, x2 double, y2 double, score double, det_idx int, hits int, time_since_update int"


@dataclass(frozen=True)
class Rules:
    """Parameters of association and coasting; high and low are None for the one-stage tracker."""

    iou_match: float = 0.22
    center_frac: float = 0.35
    max_age: int = 14
    min_hits: int = 1
    smooth: float = 0.55
    velocity_smooth: float = 0.6
    high: float | None = None
    low: float | None = None
    #: Frames without tracks after which detections count only every `skip_every`-th frame; None: never.
    skip_after: int | None = None
    skip_every: int = 4


#: Lots (about 100 bytes each) whose numbers are broadcast to the rows if they are fewer; others are joined by a shuffle.
MAX_SEGMENTS = 100_000
#: Detections of whole segments that go forward together, unless one segment has more: about 100 MB of a worker. A lot has as many.
ROWS_TOGETHER = 40_000
#: Longest coasting that is written as a run and made into rows by the JVM; with more, rows are written.
MOST_COASTING = 64
TWO_STAGE = Rules(high=0.28, low=0.18)
COLUMNS = ["id", "x1", "y1", "x2", "y2", "vx", "vy", "hits", "tsu", "score", "det"]
ID, BOX, VEL, HITS, TSU, SCORE, DET = 0, slice(1, 5), slice(5, 7), 7, 8, 9, 10


def _weights(a: np.ndarray, b: np.ndarray, rules: Rules) -> np.ndarray:
    """How well tracks' boxes and detections' go together; 0: not at all. Overlap counts above nearness of centers."""
    size = [np.maximum(0.0, x[..., 2:] - x[..., :2]) for x in (a, b)]
    inner = np.maximum(0.0, np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2])).prod(-1)
    union = size[0].prod(-1) + size[1].prod(-1) - inner
    overlap = np.where(union > 0, inner / np.where(union > 0, union, 1.0), 0.0)
    diagonal = np.sqrt((size[0] ** 2).sum(-1))
    apart = np.sqrt(((0.5 * (a[..., :2] + a[..., 2:]) - 0.5 * (b[..., :2] + b[..., 2:])) ** 2).sum(-1))
    near = (diagonal > 1) & (apart <= rules.center_frac * np.maximum(diagonal, 1.0))
    return np.where(overlap >= rules.iou_match, overlap, np.where(near, 0.15 + 0.01 * (1.0 - apart / (diagonal + 1e-6)), 0.0))


@dataclass
class Live:
    """The live tracks of one video, one row of COLUMNS each, and what the frames so far leave behind."""

    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, len(COLUMNS))))
    born: int = 0
    empty: int = 0

    def step(self, dets: np.ndarray, rules: Rules) -> np.ndarray:
        """Advance by one frame with detections (x1, y1, x2, y2, score, det); returns the rows to emit."""
        rows = self.rows
        coasting = rows[:, TSU] >= 1
        rows[coasting, 1:5] += np.tile(rows[coasting, VEL], 2)
        rows[:, TSU] += 1
        free = np.ones(len(rows), bool)
        if rules.high is None:
            stages = [np.arange(len(dets))]
        else:
            stages = [np.flatnonzero(dets[:, 4] >= rules.high), np.flatnonzero((dets[:, 4] >= rules.low) & (dets[:, 4] < rules.high))]
        births: list[int] = []
        for nth, stage in enumerate(stages):
            left = self._associate(dets, stage, free, rules)
            if nth == 0:
                births = left
        new = np.zeros((len(births), len(COLUMNS)))
        if births:
            new[:, ID] = self.born + 1 + np.arange(len(births))
            new[:, BOX], new[:, SCORE], new[:, DET], new[:, HITS] = dets[births, :4], dets[births, 4], dets[births, 5], 1
            self.born += len(births)
        self.rows = np.concatenate([rows[~(free & (rows[:, TSU] > rules.max_age))], new])
        out = self.rows[(self.rows[:, HITS] >= rules.min_hits) | (self.rows[:, TSU] == 0)]
        self.empty = 0 if len(out) else self.empty + 1
        return out.copy()

    def _associate(self, dets: np.ndarray, stage: np.ndarray, free: np.ndarray, rules: Rules) -> list[int]:
        """Pair free tracks with the stage's detections, best weight first, ties to the later track, then detection."""
        open_ = np.ones(len(stage), bool)
        at = np.flatnonzero(free)
        if len(at) and len(stage):
            weights = _weights(self.rows[at][:, None, BOX], dets[stage][None, :, :4], rules)
            t, d = np.nonzero(weights)
            for k in np.lexsort((d, t, weights[t, d]))[::-1]:
                if free[at[t[k]]] and open_[d[k]]:
                    free[at[t[k]]], open_[d[k]] = False, False
                    self._take(self.rows[at[t[k]]], dets[stage[d[k]]], rules)
        return stage[open_].tolist()

    @staticmethod
    def _take(row: np.ndarray, det: np.ndarray, rules: Rules) -> None:
        old = row[BOX].copy()
        row[BOX] = rules.smooth * old + (1 - rules.smooth) * det[:4]
        moved = 0.5 * (row[BOX][:2] + row[BOX][2:]) - 0.5 * (old[:2] + old[2:])
        row[VEL] = rules.velocity_smooth * row[VEL] + (1 - rules.velocity_smooth) * moved
        row[HITS], row[TSU], row[SCORE], row[DET] = row[HITS] + 1, 0, det[4], det[5]

    def skips(self, frame: int, moving: bool, rules: Rules) -> bool:
        """Whether a frame's detections are left out: a long empty stretch without live tracks."""
        return rules.skip_after is not None and self.empty >= rules.skip_after and not len(self.rows) and frame % rules.skip_every != 0 and not moving


def run_frames(live: Live, frames: np.ndarray, dets: np.ndarray, start: int, end: int, rules: Rules, moving: frozenset[int] = frozenset()) -> Iterator[tuple[int, np.ndarray]]:
    """Emitted rows of frames start ... end - 1; frames holds each detection's frame, ascending."""
    none, at = np.zeros((0, 6)), start
    cuts = np.flatnonzero(np.append(True, frames[1:] != frames[:-1])) if len(frames) else np.zeros(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(frames))[: len(cuts)], strict=True):
        while at < frames[a] and at < end:
            if not len(live.rows):
                live.empty += int(min(frames[a], end)) - at
                at = int(min(frames[a], end))
                break
            yield at, live.step(none, rules)
            at += 1
        if at >= end:
            return
        skipped = live.skips(at, at in moving, rules)
        yield at, live.step(none if skipped else dets[a:b], rules)
        at += 1
    while at < end and len(live.rows):
        yield at, live.step(none, rules)
        at += 1
    live.empty += max(0, end - at)


def emitted(video: str, found: Iterator[tuple[int, np.ndarray]]) -> pd.DataFrame:
    frames, rows = [], []
    for frame, out in found:
        if len(out):
            frames.append(np.full(len(out), frame, np.int64))
            rows.append(out)
    table = np.concatenate(rows) if rows else np.zeros((0, len(COLUMNS)))
    flat = np.concatenate(frames) if frames else np.zeros(0, np.int64)
    return _shown(video, flat, table)


def _shown(video: str | np.ndarray, flat: np.ndarray, table: np.ndarray) -> pd.DataFrame:
    """Rows of COLUMNS in SCHEMA's."""
    return pd.DataFrame({"video_id": video, "frame_idx": flat, "track_id": table[:, ID].astype(np.int64), "x1": table[:, 1], "y1": table[:, 2], "x2": table[:, 3], "y2": table[:, 4], "score": table[:, SCORE], "det_idx": table[:, DET].astype(np.int32), "hits": table[:, HITS].astype(np.int32), "time_since_update": table[:, TSU].astype(np.int32)})


def run_batches(batches: Iterator[pd.DataFrame], rules: Rules) -> Iterator[pd.DataFrame]:
    """Emitted rows, with segment, of rows sorted by video_id, segment, frame_idx and det_idx, in batches cut anywhere."""
    key, live, at, end, held = None, Live(), 0, 0, None

    def advance(part: pd.DataFrame, stop: int) -> pd.DataFrame:
        frames, moving = part["frame_idx"].to_numpy(), frozenset(part.loc[part["moving"].astype(bool), "frame_idx"])
        dets = part[["x1", "y1", "x2", "y2", "score", "det_idx"]].to_numpy(float)
        return emitted(key[0], run_frames(live, frames, dets, at, stop, rules, moving)).assign(segment=key[1])

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        video, segment, frame = (rows[c].to_numpy() for c in ("video_id", "segment", "frame_idx"))
        cuts = np.flatnonzero(np.append(True, (video[1:] != video[:-1]) | (segment[1:] != segment[:-1])))
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
            if (video[a], segment[a]) != key:
                key, live, end = (video[a], segment[a]), Live(), int(rows["end"].iloc[a])
                at = 0 if rules.skip_after is not None else int(rows["first"].iloc[a])
            if b < len(rows):
                out.append(advance(rows.iloc[a:b], end))
                continue
            # the last frame may go on in the next batch
            last = a + int(np.searchsorted(frame[a:b], frame[b - 1]))
            if last > a:
                stop = min(int(frame[last - 1]) + 1, end)
                out.append(advance(rows.iloc[a:last], stop))
                at = stop
            held = rows.iloc[last:b]
        if out:
            yield pd.concat(out, ignore_index=True)
    if held is not None:
        yield advance(held, end)


class Frontier:
    """The live tracks of many segments, which go forward together, a frame of each at a time: Live.step for all at once.

    rows holds COLUMNS, by segment and within it by birth; seg the segment of each.
    """

    def __init__(self, segments: int, rules: Rules) -> None:
        self.rules, self.rows, self.seg = rules, np.zeros((0, len(COLUMNS))), np.zeros(0, np.int64)
        self.born, self.empty = np.zeros(segments, np.int64), np.zeros(segments, np.int64)

    def step(self, dets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Advance by one frame with detections (x1, y1, x2, y2, score, det) of segments `of`, ascending; rows to emit, and whose."""
        rules, rows = self.rules, self.rows
        coasting = rows[:, TSU] >= 1
        rows[coasting, 1:3] += rows[coasting, VEL]
        rows[coasting, 3:5] += rows[coasting, VEL]
        rows[:, TSU] += 1
        free = np.ones(len(rows), bool)
        score = dets[:, 4]
        stages = [np.arange(len(dets))] if rules.high is None else [np.flatnonzero(score >= rules.high), np.flatnonzero((score >= rules.low) & (score < rules.high))]
        births = np.zeros(0, np.int64)
        for nth, stage in enumerate(stages):
            left = self._associate(dets, of, stage, free)
            births = left if nth == 0 else births
        own = of[births]
        new = np.zeros((len(births), len(COLUMNS)))
        if len(births):
            new[:, ID] = self.born[own] + 1 + np.arange(len(own)) - np.searchsorted(own, own)
            new[:, BOX], new[:, SCORE], new[:, DET], new[:, HITS] = dets[births, :4], dets[births, 4], dets[births, 5], 1
            self.born += np.bincount(own, minlength=len(self.born))
        stay = ~(free & (rows[:, TSU] > rules.max_age))
        seg = np.concatenate([self.seg[stay], own])
        order = np.argsort(seg, kind="stable")
        self.rows, self.seg = np.concatenate([rows[stay], new])[order], seg[order]
        out = (self.rows[:, HITS] >= rules.min_hits) | (self.rows[:, TSU] == 0)
        if rules.skip_after is not None:
            self.empty += 1
            self.empty[self.seg[out]] = 0
        return self.rows[out], self.seg[out]

    def counts(self, frames: np.ndarray, of: np.ndarray, moving: np.ndarray) -> np.ndarray:
        """Which detections count, by their frame, segment and whether it moves: as Live.skips."""
        long_ = self.empty[of] >= self.rules.skip_after
        if not long_.any():
            return ~long_
        live = np.zeros(len(self.empty), bool)
        live[self.seg] = True
        return ~(long_ & ~live[of] & (frames % self.rules.skip_every != 0) & ~moving)

    def _associate(self, dets: np.ndarray, of: np.ndarray, stage: np.ndarray, free: np.ndarray) -> np.ndarray:
        """As Live's; which of the stage's detections are left."""
        at, open_ = np.flatnonzero(free), np.ones(len(stage), bool)
        if not len(at) or not len(stage):
            return stage
        low, high = (np.searchsorted(of[stage], self.seg[at], side) for side in ("left", "right"))
        many = high - low
        t = np.repeat(np.arange(len(at)), many)
        d = np.arange(len(t)) - np.repeat(np.cumsum(many) - many - low, many)
        weights = _weights(self.rows[at[t], BOX], dets[stage[d], :4], self.rules)
        some = np.flatnonzero(weights)
        t, d, weights = t[some], d[some], weights[some]
        order = np.lexsort((d, t, weights))[::-1]
        tracks, found, pairs = [True] * len(at), [True] * len(stage), []
        for i, j in zip(t[order].tolist(), d[order].tolist(), strict=True):
            if tracks[i] and found[j]:
                tracks[i] = found[j] = False
                pairs.append((i, j))
        if pairs:
            i, j = np.array(pairs).T
            self._take(at[i], dets[stage[j]])
            free[at[i]], open_[j] = False, False
        return stage[open_]

    def _take(self, at: np.ndarray, dets: np.ndarray) -> None:
        rules, rows = self.rules, self.rows
        old = rows[at, BOX]
        new = rules.smooth * old + (1 - rules.smooth) * dets[:, :4]
        moved = 0.5 * (new[:, :2] + new[:, 2:]) - 0.5 * (old[:, :2] + old[:, 2:])
        rows[at, BOX] = new
        rows[at, VEL] = rules.velocity_smooth * rows[at, VEL] + (1 - rules.velocity_smooth) * moved
        rows[at, HITS] += 1
        rows[at, TSU], rows[at, SCORE], rows[at, DET] = 0, dets[:, 4], dets[:, 5]


@dataclass
class Numbering:
    """Numbers tracks on from segment to segment of a lot, whose rows then go by its first segment; segments come in order."""

    lot: tuple[str, int] | None = None
    segment: int = 0
    born: int = 0

    def on(self, video: np.ndarray, lot: np.ndarray, segment: np.ndarray, born: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment, with the tracks that were born in it: the first one of its lot, and the tracks of those before it."""
        starts = np.flatnonzero(np.append(True, (video[1:] != video[:-1]) | (lot[1:] != lot[:-1])))
        sizes = np.diff(np.append(starts, len(lot)))
        before = np.cumsum(born) - born
        before -= np.repeat(before[starts], sizes)
        first = np.repeat(segment[starts], sizes)
        if (video[0], lot[0]) == self.lot:
            first[: sizes[0]], before[: sizes[0]] = self.segment, before[: sizes[0]] + self.born
        self.lot, self.segment, self.born = (video[-1], lot[-1]), int(first[-1]), int(before[-1] + born[-1])
        return first, before


def advance_together(rows: pd.DataFrame, rules: Rules, runs: bool = False, numbering: Numbering | None = None) -> pd.DataFrame:
    """Emitted rows, with segment, of whole segments; rows sorted by video_id, segment, frame_idx and det_idx.

    They come by segment, track and frame, so that a coasting track's rows follow each other. With runs, one row of RUNS
    stands for a hit and the coasting after it. With numbering, rows have `lot`, and tracks are numbered on within it.
    """
    video, segment = rows["video_id"].to_numpy(), rows["segment"].to_numpy()
    starts = np.flatnonzero(np.append(True, (video[1:] != video[:-1]) | (segment[1:] != segment[:-1])))
    sizes = np.diff(np.append(starts, len(rows)))
    of, first = np.repeat(np.arange(len(starts)), sizes), rows["first"].to_numpy()[starts]
    frame = rows["frame_idx"].to_numpy()
    # nothing is live max_age frames after the last detection
    stop = np.maximum(0, np.minimum(rows["end"].to_numpy()[starts], frame[starts + sizes - 1] + rules.max_age + 1) - first)
    at = frame - first[of]
    order = np.lexsort((of, at))
    order = order[at[order] < stop[of[order]]]
    dets, of, at = rows[["x1", "y1", "x2", "y2", "score", "det_idx"]].to_numpy(float)[order], of[order], at[order]
    frame, moving = frame[order], rows["moving"].to_numpy(bool)[order]
    steps = int(stop.max(initial=0))
    cuts, live, out, whose, when = np.searchsorted(at, np.arange(steps + 1)), Frontier(len(starts), rules), [], [], []
    if rules.skip_after is not None:  # with skipping, a segment is a video, and its frames before the first detection are empty
        live.empty += first
    ends, k = np.bincount(stop, minlength=steps + 1), 0
    while k < steps:
        if ends[k]:
            going = stop[live.seg] > k
            live.rows, live.seg = live.rows[going], live.seg[going]
        a, b = cuts[k], cuts[k + 1]
        if a == b and not len(live.rows):  # no one has anything before the next detection
            nxt = int(at[a]) if a < len(at) else steps
            live.empty += nxt - k
            k = nxt
            continue
        some = slice(a, b)
        if rules.skip_after is not None and a < b:
            some = a + np.flatnonzero(live.counts(frame[a:b], of[a:b], moving[a:b]))
        found, own = live.step(dets[some], of[some])
        out.append(found.copy())
        whose.append(own)
        when.append(first[own] + k)
        k += 1
    table = np.concatenate(out) if out else np.zeros((0, len(COLUMNS)))
    own, frames = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (whose, when))
    order = np.lexsort((frames, table[:, ID], own))
    if runs:
        hit = np.flatnonzero(table[order, TSU] == 0)
        more = np.diff(np.append(hit, len(order))) - 1
        order = order[hit]
    table, own, frames = table[order], own[order], frames[order]
    named = segment[starts]
    if numbering is not None:
        named, before = numbering.on(video[starts], rows["lot"].to_numpy()[starts], named, live.born)
        table[:, ID] += before[own]
    shown = _shown(video[starts[own]], frames, table).assign(segment=named[own])
    return shown.drop(columns="time_since_update").assign(vx=table[:, 5], vy=table[:, 6], more=more.astype(np.int32)) if runs else shown


def run_together(batches: Iterator[pd.DataFrame], rules: Rules, runs: bool = False) -> Iterator[pd.DataFrame]:
    """As run_batches, whole segments at once; a task holds ROWS_TOGETHER detections and a batch, or one segment."""
    held, many, numbering = [], 0, None
    for batch in batches:
        numbering = numbering or (Numbering() if "lot" in batch.columns else None)
        held, many = [*held, batch], many + len(batch)
        if many < ROWS_TOGETHER:
            continue
        rows = pd.concat(held, ignore_index=True)
        video, segment = rows["video_id"].to_numpy(), rows["segment"].to_numpy()
        last = int(np.argmax((video == video[-1]) & (segment == segment[-1])))
        if last:
            yield advance_together(rows.iloc[:last], rules, runs, numbering)
        held, many = [rows.iloc[last:]], len(rows) - last
    if many:
        yield advance_together(pd.concat(held, ignore_index=True), rules, runs, numbering)


def coasted(runs: DataFrame, max_age: int) -> DataFrame:
    """Rows of SCHEMA, with segment, from RUNS. A box moves from its second miss on, by one addition a frame as in Live.step."""
    box, names = ("x1", "y1", "x2", "y2"), [c.split()[0] for c in SCHEMA.split(", ")]
    rows, at = runs, [box, box]
    for k in range(2, max_age + 1):
        at.append(tuple(f"{c}_{k}" for c in box))
        rows = rows.withColumns({new: F.col(old) + F.col(f"v{old[0]}") for new, old in zip(at[k], at[k - 1], strict=True)})
    places = F.array(*(F.struct(F.lit(k).alias("time_since_update"), *(F.col(c).alias(b) for b, c in zip(box, cs, strict=True))) for k, cs in enumerate(at[: max_age + 1])))
    rest = [c for c in runs.columns if c not in (*box, "vx", "vy", "more")]
    shown = rows.select(*rest, F.inline(F.slice(places, F.lit(1), F.col("more") + 1)))
    return shown.withColumn("frame_idx", F.col("frame_idx") + F.col("time_since_update")).select(*names, "segment")


def frame_segments(dets: DataFrame, max_age: int = 14) -> DataFrame:
    """(video_id, frame_idx, segment) of the frames with detections: see segment_video."""
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    cut = F.coalesce((F.col("frame_idx") - F.lag("frame_idx").over(order) >= max_age + 2).cast("int"), F.lit(0))
    cuts = dets.select("video_id", "frame_idx").distinct().withColumn("cut", cut)
    return cuts.select("video_id", "frame_idx", F.sum("cut").over(order).alias("segment"))


def frame_lots(dets: DataFrame, videos: DataFrame, max_age: int | None, longest: int) -> DataFrame:
    """(video_id, frame_idx, segment, first, end, lot) of the frames with detections, by windows over a video's frames.

    A segment has the frames from first to before end: see track; with max_age None, a video is one. Its lot, of consecutive
    segments, begins anew after ROWS_TOGETHER detections; a segment of over longest frames is a lot of its own.
    """
    order, back = (Window.partitionBy("video_id").orderBy(c) for c in (F.col("frame_idx"), F.desc("frame_idx")))
    so_far, earlier, later = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag("frame_idx").over(order)
    starts = last.isNull() if max_age is None else last.isNull() | (F.col("frame_idx") - last >= max_age + 2)
    frames = dets.filter("video_id is not null and frame_idx is not null").groupBy("video_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"))
    frames = frames.withColumns({"starts": starts, "before": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    frames = frames.withColumns({"segment": F.sum(F.col("starts").cast("int")).over(so_far) - 1, "first": F.max(F.when(F.col("starts"), F.col("frame_idx"))).over(so_far), "before": F.max(F.when(F.col("starts"), F.col("before"))).over(so_far)})
    known = videos.select("video_id", F.when(F.col("nframes") > 0, F.col("nframes")).alias("known"))
    frames = frames.join(known.hint("merge"), "video_id", "left")
    nxt = F.min(F.when(F.col("starts"), F.col("frame_idx"))).over(later)
    final = F.max("frame_idx").over(back.rowsBetween(Window.unboundedPreceding, 0))
    frames = frames.withColumn("end", F.coalesce(nxt, "known", final + 1))
    frames = frames.withColumn("long", (F.col("end") - F.col("first") > longest).cast("int"))
    # of the long segments after it, and of itself if it is long: falls at both ends of a long one
    rest = 2 * F.coalesce(F.sum(F.when(F.col("starts"), F.col("long"))).over(later), F.lit(0)) + F.col("long")
    return frames.select("video_id", "frame_idx", "segment", "first", "end", (F.floor(F.col("before") / ROWS_TOGETHER) - rest).alias("lot"))


def segment_video(dets: DataFrame, max_age: int = 14) -> DataFrame:
    """dets with `segment`: a new one where no track can survive the gap, of max_age + 2 frames or more.

    One shuffle and sort by video; of a frame's rows the first alone is after a gap, and all have the same sum.
    """
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    cut = F.coalesce((F.col("frame_idx") - F.lag("frame_idx").over(order) >= max_age + 2).cast("int"), F.lit(0))
    rows = dets.filter("video_id is not null and frame_idx is not null").withColumn("_cut", cut)
    return rows.select(*dets.columns, F.sum("_cut").over(order).alias("segment"))


def track(dets: DataFrame, videos: DataFrame, rules: Rules = TWO_STAGE, segmented: bool = True, motion: DataFrame | None = None, span: int | None = None) -> DataFrame:
    """Tracks of each video in SCHEMA's columns, also in frames where a track coasts, up to nframes.

    dets: video_id, frame_idx, det_idx, x1 ... y2, score; in a frame det_idx gives the order. A long video is cut into
    segments, each a group of its own, and track ids are numbered on by the births of earlier segments: the result is
    that of one pass. With skipping (rules.skip_after), whose state crosses gaps, a video is one segment; motion then has
    frames (video_id, frame_idx) whose detections always count. Segments of over two spans (seams.SPAN frames) are
    tracked in parts at once, which are checked at their seams (track_in_parts). Others go forward together, a frame of
    each segment of a batch at a time (Frontier), also where frames may be skipped. Where parts don't settle, rows stream
    through the live tracks of one segment in order, so that a task holds one batch at a time. The boxes are read once.

    Of a video that is not listed, or whose nframes is null or 0 (not known), the last frame is that of its last
    detection. If dets has landmarks, each row has those of its track's last hit.
    """
    usable = dets if rules.low is None else dets.filter(F.col("score") >= rules.low)
    columns = ["video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "score"]
    usable = kept(usable.select(*columns, *(c for c in ("landmarks",) if c in dets.columns)))
    from .seams import SPAN, track_in_parts

    longest, key = 2 * (span or SPAN), ["video_id", "segment"]
    # merged, as Spark would broadcast millions of frames by the few bytes that they take as a file
    cuts = kept(frame_lots(usable, videos, rules.max_age if segmented and rules.skip_after is None else None, longest))
    rows = usable.select(*columns).join(cuts.hint("merge"), ["video_id", "frame_idx"])
    if motion is not None:
        hints = motion.select("video_id", "frame_idx").distinct().withColumn("moving", F.lit(True))
        rows = rows.join(hints, ["video_id", "frame_idx"], "left")
    rows = rows.withColumn("moving", F.coalesce("moving", F.lit(False)) if motion is not None else F.lit(False))

    short_runs = rules.max_age <= MOST_COASTING

    def tracked(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        # tracking costs far more than its few bytes suggest: keep the number of tasks, which AQE would coalesce
        dealt = dealt_by(rows, "video_id", "lot", parts=int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = dealt.sortWithinPartitions("video_id", "segment", "frame_idx", "det_idx")
        return dealt.mapInPandas(run, schema)

    def together(rows: DataFrame) -> DataFrame:
        """Kept rows of RUNS, or of SCHEMA and segment."""
        return kept(tracked(rows, lambda batches: run_together(batches, rules, short_runs), RUNS if short_runs else SCHEMA + ", segment long"))

    long_ = F.col("end") - F.col("first") > longest
    if cuts.filter(long_).isEmpty():
        parts = [together(rows)]
    else:
        long_rows = rows.filter(long_)
        parted, left = track_in_parts(long_rows.drop("lot"), rules, longest // 2)
        whole = tracked(long_rows.join(left, key, "left_semi"), lambda batches: run_batches(batches, rules), SCHEMA + ", segment long")
        parts = [together(rows.filter(~long_)), kept(whole.unionByName(parted))]
    births = reduce(DataFrame.unionByName, [p.select("video_id", "segment", "track_id") for p in parts]).groupBy("video_id", "segment").agg(F.max("track_id").alias("born"))
    before = F.sum("born").over(Window.partitionBy("video_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    shift = kept(births.select("video_id", "segment", before.alias("before")).filter("before > 0"))
    shift = F.broadcast(shift) if shift.count() < MAX_SEGMENTS else shift.hint("merge")
    parts = [p.join(shift, key, "left").withColumn("track_id", F.col("track_id") + F.coalesce("before", F.lit(0))).drop("before") for p in parts]
    parts[0] = coasted(parts[0], rules.max_age) if short_runs else parts[0]
    out = reduce(DataFrame.unionByName, parts).drop("segment")
    if "landmarks" not in dets.columns:
        return out
    hits = usable.select("video_id", F.col("frame_idx").alias("hit_frame"), "det_idx", "landmarks")
    return out.withColumn("hit_frame", F.col("frame_idx") - F.col("time_since_update")).join(hits, ["video_id", "hit_frame", "det_idx"], "left").select(*out.columns, "landmarks")


def track_loss_frames(tracks: DataFrame, max_age: int = 14) -> DataFrame:
    """Frames in which some track has been missing for max_age frames."""
    return tracks.filter(F.col("time_since_update") == max_age).select("video_id", "frame_idx").distinct()


def track_summary(tracks: DataFrame) -> DataFrame:
    """Per video: tracks, boxes painted, frames with faces, and the longest track in frames."""
    each = tracks.groupBy("video_id", "track_id").agg(F.count(F.lit(1)).alias("boxes"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))
    longest = each.groupBy("video_id").agg(F.count(F.lit(1)).alias("tracks"), F.max(F.col("last") - F.col("first") + 1).alias("longest"))
    frames = tracks.groupBy("video_id").agg(F.count(F.lit(1)).alias("boxes_painted"), F.countDistinct("frame_idx").alias("frames_with_faces"))
    return longest.join(frames, "video_id")
