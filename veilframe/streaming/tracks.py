"""Tracking of frames that arrive as a stream, with the batch operator's transition and stored state per video."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilframe.operators.tracking import SCHEMA, TWO_STAGE, Live, Rules, emitted

STATE = "next_frame long, last_frame long, born long, empty long, live binary, waiting binary"
COLUMNS = ["x1", "y1", "x2", "y2", "score", "det_idx"]


def _packed(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x, allow_pickle=False)
    return out.getvalue()


def _unpacked(x: bytes) -> np.ndarray:
    return np.load(io.BytesIO(x), allow_pickle=False)


def track_stream(frames: DataFrame, rules: Rules = TWO_STAGE, max_ahead: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Rows as from track, and `rejected` (true: a frame that came after its place was passed).

    frames: video_id, frame_idx, dets (array of x1, y1, x2, y2, score, det_idx), one row for each frame, in any order,
    and if there `last`, true with a video's last frame. A video's frames are taken in order of their index: one that is
    early waits until those before it are there, the video has ended (all up to its last frame have come, or idle_ms
    milliseconds of processing time went by without a frame), or, if max_ahead is given, more than that many lie between.
    Then a missing frame counts as one without detections. At a video's end its waiting frames are taken and its state
    is removed; frames that come afterwards begin a new video of that name. The state is the live tracks and the waiting
    detections.
    """
    marked = frames if "last" in frames.columns else frames.withColumn("last", F.lit(False))

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            at, end, born, empty, live_, waiting_ = state.get
            live, table = Live(_unpacked(live_), born, empty), _unpacked(waiting_)
        else:
            at, end, live, table = 0, -1, Live(), np.zeros((0, 1 + len(COLUMNS)))
        waiting: dict[int, list] = {}
        for row in table:
            waiting.setdefault(int(row[0]), []).append(row[1:])
        late, found, done = [], [], state.hasTimedOut
        for batch in () if done else batches:
            for frame, dets, last in zip(batch["frame_idx"], batch["dets"], batch["last"], strict=True):
                if last:
                    end = int(frame)
                if frame < at:
                    late.append(frame)
                else:  # a frame without detections waits as one that is no number
                    waiting[int(frame)] = [[d[c] for c in COLUMNS] for d in dets] or [[np.nan] * len(COLUMNS)]
        while waiting and (at in waiting or done or (max_ahead is not None and max(waiting) - at > max_ahead)):
            rows = np.array(waiting.pop(at, []), float).reshape(-1, len(COLUMNS))
            rows = rows[~np.isnan(rows[:, 0])]
            if rules.low is not None:
                rows = rows[rows[:, 4] >= rules.low]
            found.append((at, live.step(rows[np.argsort(rows[:, 5], kind="stable")], rules)))
            at += 1
        if done or 0 <= end < at:
            if state.exists:
                state.remove()
        else:
            left = [[f, *r] for f, rows in sorted(waiting.items()) for r in rows]
            state.update((at, end, live.born, live.empty, _packed(live.rows), _packed(np.array(left, float).reshape(-1, 1 + len(COLUMNS)))))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield emitted(key[0], iter(found)).assign(rejected=False)
        if late:
            none = emitted(key[0], iter(()))
            yield none.reindex(range(len(late))).assign(video_id=key[0], frame_idx=late, track_id=-1, det_idx=-1, hits=0, time_since_update=0, rejected=True)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return marked.groupBy("video_id").applyInPandasWithState(advance, SCHEMA + ", rejected boolean", STATE, "append", timeout)
