"""Line dedup: Bloom filters of lines seen once and twice; only suspected repeats shuffle, to be counted exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import STEP_BYTES, binaries, by_bytes, kept, own_names, text_of, u64

BLANKS = b" \t\n\x0b\x0c\r"
#: Most keys whose digests are broadcast, about 200 bytes each as a table in each worker; with more, drops reach their texts by a join.
MAX_BROADCAST = 200_000


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The text's lines and their keys: blanks (space, \\t, \\n, \\v, \\f, \\r) stripped at both ends, A-Z lower-cased."""
    return (lines := text.split(b"\n")), list(map(bytes.strip, text.lower().split(b"\n"), repeat(BLANKS)))


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_points: int) -> bool:
    return len(key) >= min_points and (min_points <= 1 or len(key.decode()) >= min_points)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each document's distinct keys: once per document."""
    for batch in batches:
        for part in by_bytes(batch, 0, 16 << 20):
            out: list[int] = []
            for text in part.column(0).to_pylist():
                out.extend(map(xxhash.xxh3_64_intdigest, {k for k in line_keys(text)[1] if k}))
            yield pa.record_batch([pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())], ["h"])


def frequent_hashes(hashes: DataFrame, least: int, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """The values of the stored table hashes (h) that occur at least so often, two at the least.

    For each slice of the values a pair of filters, of those seen once and twice, tells which may repeat; these alone
    shuffle, after each task has counted its own.
    """
    n = hashes.count()
    parts = bloom.by_slice(hashes, "h", n, max_bits)
    found = []
    for part in parts:
        bitmap = part.sparkSession.sparkContext.broadcast(bloom.twice_filter(part, lambda batch: u64(batch.column(0)), -(-n // len(parts))).tobytes())

        def suspected(batches: Iterator[pa.RecordBatch], bitmap: Broadcast = bitmap) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(bitmap.value, np.uint8)
            for batch in batches:
                yield batch.filter(pa.array(bloom.holds(bits, u64(batch.column(0)))))

        found.append(part.mapInArrow(suspected, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, least)).select("h"))
    return reduce(DataFrame.unionByName, found)


def _suspects(keys: list[bytes], bitmap: np.ndarray, min_points: int) -> list[bytes]:
    """The distinct keys that count and may occur in several documents."""
    keys = [k for k in dict.fromkeys(keys) if k and _long_enough(k, min_points)]
    may = bloom.holds(bitmap, np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
    return [k for k, x in zip(keys, may.tolist(), strict=True) if x]


@own_names
def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1, keep_first: bool = False, max_broadcast: int = MAX_BROADCAST, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per document: doc_id, text (what is left), n_lines (before), n_dropped.

    Texts are split at \\n; null or empty text is one empty line. A line whose key (see line_keys) has at least
    min_points code points and occurs in at least min_docs documents is dropped from every document, or with
    keep_first from all but the one with the smallest doc_id, where its first line stays (documents that tie there
    each keep it). The other lines stay in order, joined by \\n. Each row is a document, also where doc_id is null
    (which sorts first) or repeats. An empty table gives an empty result; other columns are ignored.

    Three passes over the texts. The first stores the lines' hashes, of which filters tell the suspected repeats (see
    frequent_hashes); the second counts the lines of each task whose hash is frequent and shuffles these counts alone,
    keyed by a 128-bit digest, to exact totals; the third drops. The frequent keys are broadcast after counting them if
    they are at most max_broadcast; else each distinct text's drops come by joins. With min_docs below 2 every key is
    frequent, and all are counted.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", text_of().cast("binary").alias("body"))
    hashes = kept(source.select("body").mapInArrow(_hashes, "h long"))
    candidates = kept(frequent_hashes(hashes, min_docs, max_bits) if min_docs > 1 else hashes.distinct())
    bitmap = bloom.once_filter(candidates, lambda batch: u64(batch.column(0)), candidates.count())
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    del bitmap

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, found = np.frombuffer(shared.value, np.uint8), {}
        for batch in (p for b in batches for p in by_bytes(b, 1, STEP_BYTES)):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc = -(2**63) if doc is None else doc
                for key in _suspects(line_keys(text)[1], bits, min_points):
                    n, first = found.get(d := digest(key), (0, doc))
                    found[d] = n + 1, min(first, doc)
            if len(found) > 200_000:
                yield totals(found)
                found = {}
        yield totals(found)

    def totals(found: dict) -> pa.RecordBatch:
        return pa.record_batch([binaries(list(found)), *(pa.array([x[i] for x in found.values()], pa.int64()) for i in (0, 1))], ["key", "n", "first_doc"])

    counts = source.mapInArrow(count, "key binary, n long, first_doc long")
    frequent = kept(counts.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc")).filter(F.col("n") >= min_docs).select("key", "first_doc"))
    schema = "doc_id long, text string, n_lines long, n_dropped long"

    def cleaned(doc: int | None, text: bytes, drops: dict[bytes, int]) -> tuple:
        lines, keys = line_keys(text)
        out, seen, doc_ = [], set(), -(2**63) if doc is None else doc
        for line, key in zip(lines, keys, strict=True):
            first = drops.get(key)
            if first is None or keep_first and first == doc_ and key not in seen:
                out.append(line)
            seen.add(key)
        return doc, b"\n".join(out).decode(), len(lines), len(lines) - len(out)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "text", "n_lines", "n_dropped"])

    if frequent.count() <= max_broadcast:
        known = spark.sparkContext.broadcast({bytes(r.key): r.first_doc for r in frequent.toLocalIterator()})

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, table = np.frombuffer(shared.value, np.uint8), known.value
            for batch in (p for b in batches for p in by_bytes(b, 1, STEP_BYTES)):
                found = []
                for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    drops = {k: table[d] for k in _suspects(line_keys(text)[1], bits, min_points) if (d := digest(k)) in table}
                    found.append(cleaned(doc, text, drops))
                yield rows(found)

        return source.mapInArrow(drop, schema)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in (p for b in batches for p in by_bytes(b, 1, STEP_BYTES)):
            pairs = {(hashlib.sha256(text).digest(), digest(k)) for text in set(batch.column(1).to_pylist()) for k in _suspects(line_keys(text)[1], bits, min_points)}
            yield pa.record_batch([binaries([p[0] for p in pairs]), binaries([p[1] for p in pairs])], ["sha", "key"])

    def drop_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in by_bytes(b, 1, STEP_BYTES)):
            found = []
            for doc, text, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = {x["key"]: x["first_doc"] for x in listed or ()}
                found.append(cleaned(doc, text, {k: table[d] for k in set(line_keys(text)[1]) if (d := digest(k)) in table}))
            yield rows(found)

    listed = source.mapInArrow(occurrences, "sha binary, key binary").distinct().join(frequent, "key").groupBy("sha").agg(F.collect_list(F.struct("key", "first_doc")).alias("listed"))
    keyed = source.withColumn("sha", F.unhex(F.sha2("body", 256)))
    return keyed.join(kept(listed), "sha", "left").select("doc_id", "body", "listed").mapInArrow(drop_listed, schema)
