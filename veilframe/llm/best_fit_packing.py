"""Best-fit packing of documents into sequences, planned on the histogram of piece lengths."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import binaries, by_bytes, give_back, kept, own_names, text_of, texts
from .tokenization import word_bpe

#: Bytes of text that are encoded together (a longer one alone).
STEP_BYTES = 512 << 10


def plan_slots(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first_rank, first_sequence, per_sequence, offset).

    From its first_rank up to the next row's of the same length, pieces of a length fill per_sequence slots in each of
    consecutive sequences from first_sequence, the slots one after another from offset. Sequences that hold the same
    lengths are planned together, so the plan has at most about three groups of sequences for each length, whatever
    the counts: its size is bounded by `size` and not by the data.
    """
    open_: dict[int, list[list[int]]] = {}  # room left: [first sequence, sequences]
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(first: int, many: int, room: int) -> None:
            """Put what is left into sequences from `first` on; those that get fewer keep their room apart."""
            nonlocal left, rank
            each = room // length
            full = min(many, left // each)
            rest = min(left - full * each, each) if full < many else 0
            for at, n, k in ((first, full, each), (first + full, 1 if rest else 0, rest)):
                if n:
                    rows.append((length, rank, at, k, size - room))
                    rank, left = rank + n * k, left - n * k
                    if room - k * length:
                        open_.setdefault(room - k * length, []).append([at, n])
            if many > (used := full + (1 if rest else 0)):
                open_.setdefault(room, []).append([first + used, many - used])

        for room in [r for r in sorted(open_) if r >= length]:
            groups = open_.pop(room)
            for i, (first, many) in enumerate(groups):
                if not left:
                    open_.setdefault(room, []).extend(groups[i:])
                    break
                fill(first, many, room)
            if not left:
                break
        if left:
            new = -(-left // (size // length))
            sequences += new
            fill(sequences - new, new, size)
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of at most size ids: doc_id, piece, start, length, ids, block (the task that cut it), local (its rank among the block's of its length)."""
    rows = docs.select("doc_id", text_of())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, model, end, ranks = TaskContext.get().partitionId(), word_bpe(tokenizer), struct.pack("<I", end_id), [0] * (size + 1)
        for batch in batches:
            for part in by_bytes(batch, 1, STEP_BYTES):
                out: list[tuple] = []
                for doc, ids in zip(part.column(0), model.encode(texts(part.column(1))), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[start : start + 4 * size]
                        n = len(own) // 4
                        out.append((doc, piece, start // 4, n, own, block, ranks[n]))
                        ranks[n] += 1
                doc_ids = pa.array([x[0].as_py() for x in out], part.column(0).type)
                yield pa.record_batch(
                    [doc_ids, *(pa.array([x[i] for x in out], t) for i, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()))), binaries([x[4] for x in out]), pa.array([x[5] for x in out], pa.int64()), pa.array([x[6] for x in out], pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids", "block", "local"],
                )
        give_back()

    doc_type = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {doc_type}, piece int, start long, length long, ids binary, block long, local long")


@own_names
def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Pack all documents into sequences of at most size ids; one row per piece.

    Returns doc_id, piece (from 0), start (its document's ids before it), length, ids (u32 little-endian), sequence_id,
    offset (gapless from 0 in each sequence). A document is its text's ids (null: empty) and end_id, so none is empty;
    only longer ones are cut, every size ids. Rows with a null or repeated doc_id are documents of their own; other
    columns are ignored; an empty table gives an empty result.

    The pieces are stored once, in no order, with their task and their rank among the task's pieces of the same length.
    Their counts by length (at most `size` rows on the driver) give the plan. A piece's rank within its length is the
    count in earlier tasks, from a window over counts alone, and its own; the planned slot follows from the rank. So no
    length, however common, is gathered or sorted in one task, and ids don't shuffle.
    """
    pieces = kept(cut_pieces(docs, tokenizer, end_id, size))
    counts = kept(pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(plan_slots(histogram, size), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("block", "length", F.coalesce(before, F.lit(0)).alias("base"))
    if bases.count() <= MAX_BROADCAST:
        bases = F.broadcast(bases)
    ranked = pieces.join(bases, ["block", "length"]).withColumn("rank", F.col("base") + F.col("local"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = shared.value
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows, wide = rows[order], np.int64(1) << 40
        at = np.searchsorted(rows[:, 0] * wide + rows[:, 1], length.to_numpy() * wide + rank.to_numpy(), "right") - 1
        _, first_rank, first, each, offset = rows[at].T
        nth = rank.to_numpy() - first_rank
        return pd.DataFrame({"sequence_id": first + nth // each, "offset": offset + nth % each * length.to_numpy()})

    placed = ranked.withColumn("slot", slot("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids", F.col("slot.sequence_id").alias("sequence_id"), F.col("slot.offset").alias("offset"))


#: Most rows (task, length, base) that are broadcast, about 100 bytes each; beyond that they are joined by a shuffle.
MAX_BROADCAST = 1_000_000
