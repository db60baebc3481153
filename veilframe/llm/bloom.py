"""A pair of Bloom filters over a distributed column of hashes: seen once, seen at least twice.

Each task fills its own pair. A pair travels as the bit positions it has set, segment by segment, so that what is
shuffled follows the rows of a task and not the size of the filter. Per segment, a bit of the twice-filter is one
that some task had there already, or that two tasks have in their once-filters; a value present twice always has all
its bits there. A filter has at most MAX_BITS, so the broadcast is bounded; more values than it is good for are cut into
slices of the hash space (by_slice), each with a filter of its own, so that the share of suspects doesn't grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binaries, kept, mix64

#: Bits per expected value, bits set per value, bits in a segment, and the most bits of a filter (32 MB).
BITS_PER_VALUE, PROBES, SEGMENT, MAX_BITS = 16, 4, 1 << 16, 1 << 28


def filter_bits(values: int) -> int:
    """Bits for so many values: a power of two, one segment at least, MAX_BITS at most."""
    return min(MAX_BITS, max(SEGMENT, 1 << max(0, int(values * BITS_PER_VALUE - 1).bit_length())))


def by_slice(df: DataFrame, name: str, values: int, max_bits: int = MAX_BITS) -> list[DataFrame]:
    """df in parts by the hash of its bigint column `name`, each of as many values as a filter of max_bits is good for.

    The parts are stored once, a folder for each, so that all of them together are read once more, however many they
    are; df itself if one filter will do.
    """
    parts = max(1, -(-values * BITS_PER_VALUE // max_bits))
    if parts == 1:
        return [df]
    stored = kept(df.withColumn("_slice", F.pmod(F.xxhash64(name, F.lit(23)), F.lit(parts)).cast("int")), by="_slice")
    return [stored.filter(F.col("_slice") == i).drop("_slice") for i in range(parts)]


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n) bit positions of each hash."""
    low, step = mix64(hashes), mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    if not len(hashes):
        return np.zeros(0, bool)
    at = positions(hashes, len(bitmap) * 8)
    return np.logical_and.reduce((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def put(bitmap: np.ndarray, hashes: np.ndarray) -> None:
    at = np.unique(positions(hashes, len(bitmap) * 8))
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def set_bits(bitmap: np.ndarray) -> np.ndarray:
    """Positions of a bitmap's bits, ascending; cheap where most bytes are zero."""
    at = np.flatnonzero(bitmap)
    return ((at * 8)[:, None] + np.arange(8))[np.unpackbits(bitmap[at], bitorder="little").reshape(-1, 8).astype(bool)] if len(at) else at


def _fill(batches: Iterator[pa.RecordBatch], hashes_of: Callable, bits: int) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for batch in batches:
        values, counts = np.unique(hashes_of(batch), return_counts=True)
        if len(values):
            put(twice, values[(counts > 1) | holds(once, values)])
            put(once, values)
    a, b = set_bits(once), set_bits(twice)
    del once, twice
    for segment in np.unique(a // SEGMENT):
        parts = [x[np.searchsorted(x, segment * SEGMENT) : np.searchsorted(x, (segment + 1) * SEGMENT)] % SEGMENT for x in (a, b)]
        yield pa.record_batch([pa.array([segment], pa.int32()), *(binaries([x.astype("<u2").tobytes()]) for x in parts)], ["segment", "once", "twice"])


def _merge(rows: pa.Table) -> pa.Table:
    counts = np.zeros(SEGMENT, np.int64)
    for once, twice in zip(rows["once"].to_pylist(), rows["twice"].to_pylist(), strict=True):
        counts[np.frombuffer(once, "<u2")] += 1
        counts[np.frombuffer(twice, "<u2")] += 1
    bitmap = np.packbits(counts > 1, bitorder="little")
    return pa.table({"segment": rows["segment"][:1], "bits": binaries([bitmap.tobytes()])})


def once_filter(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], values: int) -> np.ndarray:
    """A plain Bloom filter over the hashes of all of df's Arrow batches, as a bitmap of at most MAX_BITS bits."""
    bits = filter_bits(values)

    def unite(rows: pa.Table) -> pa.Table:
        found = np.zeros(SEGMENT, bool)
        for once in rows["once"].to_pylist():
            found[np.frombuffer(once, "<u2")] = True
        return pa.table({"segment": rows["segment"][:1], "bits": binaries([np.packbits(found, bitorder="little").tobytes()])})

    rows = df.mapInArrow(lambda batches: _fill(batches, hashes_of, bits), "segment int, once binary, twice binary")
    return _assembled(rows.groupBy("segment").applyInArrow(unite, "segment int, bits binary"), bits)


def _assembled(segments: DataFrame, bits: int) -> np.ndarray:
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in segments.toLocalIterator():
        bitmap[row["segment"] * SEGMENT // 8 : (row["segment"] + 1) * SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def twice_filter(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], values: int) -> np.ndarray:
    """The twice-filter over hashes_of(batch) of all of df's Arrow batches, as a bitmap of at most MAX_BITS bits.

    hashes_of returns unsigned 64-bit hashes; values is how many to expect (a count, for the size alone).
    """
    bits = filter_bits(values)
    rows = df.mapInArrow(lambda batches: _fill(batches, hashes_of, bits), "segment int, once binary, twice binary")
    return _assembled(rows.groupBy("segment").applyInArrow(_merge, "segment int, bits binary"), bits)
