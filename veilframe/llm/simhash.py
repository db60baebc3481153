"""SimHash near-duplicates: fingerprints of shingles, met through nearby codewords of the binary Golay code.

Two fingerprints link when they differ in few bits. A fingerprint has three segments; with two differing bits at most,
one segment is equal and each other one differs in two bits at most. Words of 23 bits at distance two have a neighbour
in common, and each word belongs to one codeword of the perfect Golay code, so the sets of codewords that the words and
their neighbours decode to meet (Berkovich's fuzzy hashing: 1 or 6 codewords each). A key is one segment as it is and one
such codeword of the next; every link shares a key, and unlike fingerprints share one by chance in 2^33.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.components import components

from .shared import by_bytes, give_back, kept, own_names, text_of

#: The Golay code's generator polynomial, bits of a word and of a codeword's index.
GENERATOR, WORD, INDEX = 0b110001110101, 23, 12
#: Segments of a fingerprint (lowest bit, bits), and for each the segment whose codewords go with it in a key.
SEGMENTS, PARTNER = ((42, 22), (21, 21), (0, 21)), (1, 2, 0)
#: Bits by which linked fingerprints differ at most: what the keys are made for.
DISTANCE = 2
#: Words of a shingle, the hash's seed, shingles hashed at once, bytes of text held as Python values at once.
SHINGLE, SEED, STEP, STEP_BYTES = 3, 42, 1 << 15, 8 << 20
#: Fingerprints of one key that are compared with each other; keys with more meet in midpoints.
MOST = 32


def _remainders(words: np.ndarray) -> np.ndarray:
    """Words of 23 bits modulo the generator."""
    out = words.copy()
    for bit in range(WORD - 1, WORD - INDEX - 1, -1):
        out ^= np.where((out >> bit) & 1, GENERATOR << (bit - (WORD - INDEX)), 0)
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each remainder the error of three bits at most that leaves it; for each word the index of its codeword."""
    one = 1 << np.arange(WORD)
    two = (one[:, None] | one[None, :]).ravel()
    errors = np.unique(np.concatenate([[0], two, (two[:, None] | one[None, :]).ravel()]))
    error = np.zeros(1 << (WORD - INDEX), np.int32)
    error[_remainders(errors)] = errors
    words = np.arange(1 << WORD, dtype=np.int32)
    return error, ((words ^ error[_remainders(words)]) >> (WORD - INDEX)).astype(np.int16)


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, index) of each distinct codeword that a word of 23 bits, or one with a flipped bit, decodes to."""
    nearest = _tables()[1]
    near = np.concatenate([[0], 1 << np.arange(WORD)])
    found = np.sort(nearest[words[:, None] ^ near], axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    place, column = np.nonzero(new)
    return place, found[place, column].astype(np.int64)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) for fingerprints as unsigned 64-bit numbers: two that differ in two bits at most share a key."""
    parts = [((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    places, keys = [], []
    for kind, own in enumerate(parts):
        place, index = codewords(parts[PARTNER[kind]])
        places.append(place)
        keys.append((np.int64(kind) << 40) | (own[place] << INDEX) | index)
    return np.concatenate(places), np.concatenate(keys)


def fingerprint(text: bytes) -> int:
    """The SimHash of a text in UTF-8, as an unsigned number; 0 without words.

    A-Z count as a-z, words are runs between blanks (U+0020, U+0009 to U+000D), shingles three words joined by spaces,
    repeats included (fewer words: all of them as one). A bit is set if more than half of the hashes have it.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts, ends = (ends - sizes + 1)[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        hashes = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[i : i + STEP], ends[i : i + STEP], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row: the whole text's fingerprint as a signed 64-bit number, null texts as empty ones."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, STEP_BYTES):
                found = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.record_batch([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])
        give_back()

    rows = docs.select("doc_id", text_of().cast("binary").alias("text"))
    return rows.mapInArrow(hashed, f"doc_id {rows.schema[0].dataType.simpleString()}, print long")


def _keys(prints: DataFrame) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64)
            place, key = keys_of(own.view(np.uint64))
            yield pa.record_batch([pa.array(key), pa.array(own[place])], ["key", "print"])

    return prints.select("print").mapInArrow(keyed, "key long, print long")


def _midpoints(prints: DataFrame) -> DataFrame:
    """(a, b) for fingerprints that are equal to, or one bit off, a common word: links of their least one to each other.

    Any two of a group of 65 at most are two bits apart at most, and two that are have such a word in common.
    """

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64)
            words = (own.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
            yield pa.record_batch([pa.array(words), pa.array(np.repeat(own, 65))], ["word", "print"])

    groups = prints.select("print").mapInArrow(around, "word long, print long").groupBy("word").agg(F.collect_set("print").alias("own"))
    return groups.filter("size(own) > 1").select(F.array_min("own").alias("a"), F.explode("own").alias("b")).filter("a != b")


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links between distinct fingerprints (print) that connect whatever differs by two bits at most.

    Keys of one fingerprint are dropped after a count that each task begins. Up to `most` fingerprints of a key are
    compared with each other; those of larger keys go to their midpoints, 65 rows each however large the key, so that
    no group makes all its pairs or meets in one task.
    """
    keys = kept(_keys(prints))
    sizes = kept(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    small = keys.join(sizes.filter(F.col("n") <= most).select("key"), "key").groupBy("key").agg(F.collect_list("print").alias("own"))
    near = F.expr(f"filter(own, x -> x > a and bit_count(a ^ x) <= {DISTANCE})")
    pairs = small.select("own", F.explode("own").alias("a")).select("a", F.explode(near).alias("b"))
    large = kept(keys.join(sizes.filter(F.col("n") > most).select("key"), "key").select("print").distinct())
    return pairs.unionByName(_midpoints(large))


@own_names
def near_components(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Documents link when their fingerprints differ in two bits at most; component_id is the least doc_id that links reach,
    the own one included (null where all of them are null). Texts without words, null ones too, have fingerprint zero and
    link like any other. Rows that repeat a doc_id are documents of their own. An empty table gives an empty result;
    other columns are ignored.

    Fingerprints are stored; each distinct one is looked at once, so copies cost no pairs. The join back is between two
    stored tables, so that a hot fingerprint's rows can be split between tasks.
    """
    rows = kept(fingerprints(docs))
    prints = kept(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    tied = components(links(prints, most))
    roots = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    of_root = prints.join(roots, F.col("print") == F.col("node")).select("root", "least").groupBy("root").agg(F.min("least").alias("least"))
    linked = roots.join(of_root, "root").select(F.col("node").alias("print"), F.col("least").alias("reached"))
    final = kept(prints.join(linked, "print", "left").select("print", F.coalesce("reached", "least").alias("component_id")))
    return rows.join(final, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
