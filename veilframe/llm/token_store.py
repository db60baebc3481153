"""Token ids of documents as binary shards: one id array with Elias-Fano coded document boundaries.

A shard is little-endian throughout:

    magic "VFEF", u8 version 2, u8 bytes per id (2 or 4), u8 low bits L of boundaries, u8 low bits K of keys
    u64 documents n, u64 ids m, u64 upper bits U of boundaries
    u64 documents without key (which come first), i64 least key, u64 upper bits V of keys
    boundaries: the n + 1 ascending positions 0 ... m, each as L low bits, packed, padded to 8 bytes, and as
        one bit of an upper bit vector of U bits (padded to 64): position (x >> L) + i for the i-th
        u32 samples: place of every 64th set bit of the upper vector
    keys: the documents' ascending doc_ids less the least one, in the same way
    ids: m unsigned integers

Boundaries take about 2 + log2(m / n) bits each instead of 64, keys 2 + log2(range / n).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import binaries, by_bytes, kept_folder, mix64, own_names, text_of, texts
from .tokenization import word_bpe

MAGIC, HEAD, SAMPLE, NULL_KEY = b"VFEF", struct.Struct("<4sBBBBQQQQqQ"), 64, -(2**63)
#: Ids after which a shard is closed (a longer document still is one shard's), bytes of text encoded together, and documents per Arrow batch read back.
SHARD_IDS, ENCODE_BYTES, READ_BATCH = 1 << 20, 512 << 10, 4096
#: Bytes of text that a bucket of consecutive documents has about, and the most buckets.
BUCKET_BYTES, MAX_BUCKETS = 256 << 20, 50_000
#: Most shards whose first positions are broadcast (20 bytes each).
MAX_BROADCAST = 1_000_000


class EliasFano:
    """n ascending integers in near-minimal space, with random access by select."""

    def __init__(self, low_bits: int, lows: np.ndarray, upper: np.ndarray, samples: np.ndarray, n: int) -> None:
        self.low_bits, self.lows, self.upper, self.samples, self.n = low_bits, lows, upper, samples, n

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values, n = np.asarray(values, np.uint64), len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(-(-((top >> low_bits) + n + 1) // 64) * 64, np.uint8)
        upper[places] = 1
        return cls(low_bits, _padded(np.packbits(bits, bitorder="little")), np.packbits(upper, bitorder="little"), places[::SAMPLE].astype("<u4"), n)

    def data(self) -> bytes:
        return self.lows.tobytes() + self.upper.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int, low_bits: int, upper_bits: int, n: int) -> tuple[EliasFano, int]:
        """The sequence of n integers whose data() starts at `at`, in place, and where it ends."""
        lows = np.frombuffer(data, np.uint8, -(-n * low_bits // 64) * 8, at)
        upper = np.frombuffer(data, np.uint8, upper_bits // 8, at + len(lows))
        at += len(lows) + len(upper)
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at)
        return cls(low_bits, lows, upper, samples, n), at + 4 * len(samples)

    def select(self, i: int) -> int:
        """The i-th integer: from the nearest sampled bit, set bits are counted byte by byte."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.upper[byte]) & (0xFF << (at & 7)) & 0xFF
        while (here := word.bit_count()) <= left:
            left, byte = left - here, byte + 1
            word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + ((word & -word).bit_length() - 1)
        return ((place - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = int.from_bytes(self.lows[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
        return (part >> (first & 7)) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every integer, by one pass over the upper bits."""
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        low = np.unpackbits(self.lows, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return ((places - np.arange(self.n)) << self.low_bits) + low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def _padded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros(-len(x) % 8, np.uint8)])


def write_shard(keys: list[int | None], ids: list[np.ndarray], id_bytes: int) -> bytes:
    """A shard of documents in ascending order of their keys, those without one first."""
    ends = np.cumsum([0, *map(len, ids)])
    known = [k for k in keys if k is not None]
    least = known[0] if known else 0
    bounds, own = EliasFano.of(ends), EliasFano.of(np.array([k - least for k in known], np.uint64))
    head = HEAD.pack(MAGIC, 2, id_bytes, bounds.low_bits, own.low_bits, len(keys), int(ends[-1]), len(bounds.upper) * 8, len(keys) - len(known), least, len(own.upper) * 8)
    flat = np.concatenate(ids) if ids else np.zeros(0)
    return b"".join([head, bounds.data(), own.data(), flat.astype(f"<u{id_bytes}").tobytes()])


class Shard:
    """A shard's bytes, read in place."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.id_bytes, low_bits, key_bits, self.n, self.m, upper_bits, self.nulls, self.least, key_upper = HEAD.unpack_from(data)
        if magic != MAGIC or version != 2:
            raise ValueError("not a token shard")
        self.ends, at = EliasFano.read(data, HEAD.size, low_bits, upper_bits, self.n + 1)
        self.keys, at = EliasFano.read(data, at, key_bits, key_upper, self.n - self.nulls)
        self.ids = np.frombuffer(data, f"<u{self.id_bytes}", self.m, at)

    def document(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """Key, start within the shard, and ids of the i-th document."""
        start, end = self.ends.select(i), self.ends.select(i + 1)
        return None if i < self.nulls else self.least + self.keys.select(i - self.nulls), start, self.ids[start:end]


@own_names
def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs and write them as shards in ascending doc_id order below path.

    Each document's ids are those of its whole text (null: empty) and end_id, so none is empty. Null doc_ids come
    first; documents that repeat a doc_id follow each other in the order of their ids' bytes. Shards are the binary
    column of a Parquet table (bucket, part, n_ids, shard): the store's own committer publishes each task's shards once.

    doc_id quantiles, four for each shuffle partition or as many as the bytes of the texts ask for, deal documents to
    ordered buckets, so every task writes consecutive documents of like number however hot a source is. A doc_id that
    is several quantiles, or null so often, has as many buckets of its own, dealt by place in the input; its documents
    then follow each other in any order. The texts are encoded once, where they are read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    many = max(4 * n, min(MAX_BUCKETS, -(-size // BUCKET_BYTES)))
    places = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")).approxQuantile("key", [i / many for i in range(1, many)], 1 / (4 * many))
    bounds, times = np.unique(np.array(places).astype(np.int64), return_counts=True)
    hot = np.append(np.where(times > 1, times, 0), 0)
    begins = np.cumsum(np.append(0, 1 + hot))  # of each bound: its bucket, that of smaller keys, and the hot key's own

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, end, seen = word_bpe(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in by_bytes(batch, 1, ENCODE_BYTES):
                keys = part.column(0).to_pylist()
                ids = [np.frombuffer(x + end, "<u4").astype("<u2" if small else "<u4").tobytes() for x in model.encode(texts(part.column(1)))]
                numbers = np.array([NULL_KEY if k is None else k for k in keys], np.int64)
                at = np.searchsorted(bounds, numbers, "left")
                own = (at < len(bounds)) & (np.append(bounds, 0)[at] == numbers) & (hot[at] > 0)
                spread = mix64(np.arange(seen, seen + len(keys)).astype(np.uint64)) >> np.uint64(33)
                at, seen = begins[at] + np.where(own, 1 + spread.astype(np.int64) * hot[at] // (1 << 31), 0), seen + len(keys)
                yield pa.record_batch([pa.array(at, pa.int32()), part.column(0), binaries(ids)], ["bucket", "key", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, part, keys, ids, size = None, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), binaries([write_shard(keys, ids, 2 if small else 4)])], ["bucket", "part", "n_ids", "shard"])

        for batch in batches:
            for b, key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and (b != bucket or size >= shard_ids):
                    yield closed()
                    part, keys, ids, size = part + 1 if b == bucket else 0, [], [], 0
                bucket = b
                keys.append(key)
                ids.append(np.frombuffer(data, "<u2" if small else "<u4"))
                size += len(ids[-1])
        if keys:
            yield closed()

    small = max(word_bpe(tokenizer).library.get_vocab_size() - 1, end_id) < 1 << 16
    rows = docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(encode, "bucket int, key long, ids binary")
    ordered = rows.repartition(max(n, many // 4), "bucket").sortWithinPartitions("bucket", F.col("key").asc_nulls_first(), "ids")
    ordered.mapInArrow(pack, "bucket int, part int, n_ids long, shard binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of shards below path: doc_id, start (ids of all documents before it), ids (u32 little-endian).

    A shard's first position comes from the shards' sizes, one row each; places within it from select.
    """
    shards = spark.read.schema("bucket int, part int, n_ids long, shard binary").parquet(path)
    sizes = shards.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("bucket_first"))
    within = F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = shards.select("bucket", "part", "n_ids", F.coalesce(within, F.lit(0)).alias("part_first"))
    table = parts.join(firsts, "bucket").select("bucket", "part", (F.col("bucket_first") + F.col("part_first")).alias("first"))
    table = F.broadcast(table) if shards.select("n_ids").count() <= MAX_BROADCAST else table

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(data)
                for at in range(0, shard.n, READ_BATCH):
                    found = [shard.document(i) for i in range(at, min(shard.n, at + READ_BATCH))]
                    yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([first + x[1] for x in found], pa.int64()), binaries([x[2].astype("<u4").tobytes() for x in found])], ["doc_id", "start", "ids"])

    return shards.join(table, ["bucket", "part"]).select("first", "shard").mapInArrow(documents, "doc_id long, start long, ids binary")


@own_names
def tokens_of(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to a new folder of the shared store and read them back (see write_tokens and read_tokens)."""
    path = kept_folder(docs.sparkSession)
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
