"""Language ID by rank-order profiles: out-of-place distance between n-gram rankings (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import STEP_BYTES, by_bytes, give_back, own_names, text_of, texts

#: n-grams in a profile, and about how many labelled rows of a language its profile is learned from.
PROFILE, MAX_FIT_ROWS = 300, 5_000
#: Texts farther than this from every profile are not taken for any language: clean texts stay below 0.65, most texts of
#: a language without profile and long random letters lie above.
MAX_DISTANCE = 0.7
SPACE, STAND_IN, STAND_INS = 0x20, 0xE000, 0x1900


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point below 0x10000: its lower-case letter, or a space for all else."""
    table = np.full(1 << 16, SPACE, np.int64)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _high(c: int) -> int:
    """A letter beyond 0xFFFF by a code in the private use area, which holds no letters itself."""
    return STAND_IN + c % STAND_INS if unicodedata.category(chr(c))[0] == "L" else SPACE


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of the whole text, one space between words and at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    high = codes > 0xFFFF
    out = _letters()[np.where(high, SPACE, codes)]
    if high.any():
        out[high] = [_high(c) for c in codes[high].tolist()]
    out = np.concatenate([[SPACE], out, [SPACE]])
    return out[np.append(True, (out[1:] != SPACE) | (out[:-1] != SPACE))]


def grams_of(text: str) -> np.ndarray:
    """Codes of the text's letters, and of its 2-grams and 3-grams, which don't cross from word to word."""
    c = letters_of(text)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    pairs, middle = (c[:-1] << 16) | c[1:], c[1:-1]
    threes = (pairs[:-1] << 16) | c[2:]
    return np.concatenate([c[c != SPACE], pairs, threes[middle != SPACE]])


def ranking(text: str, size: int) -> np.ndarray:
    """The text's most frequent n-grams, the most frequent first, ties in the order of their codes."""
    grams = np.sort(grams_of(text))
    if not len(grams):
        return grams
    starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    counts = np.diff(np.append(starts, len(grams)))
    if len(counts) > size:  # those above the size-th count, and as many at it as fit, the smallest codes first
        least = np.partition(counts, -size)[-size]
        sure, at = np.flatnonzero(counts > least), np.flatnonzero(counts == least)
        keep = np.sort(np.concatenate([sure, at[: size - len(sure)]]))
        starts, counts = starts[keep], counts[keep]
    return grams[starts[np.argsort(-counts, kind="stable")]]


def unit_hash(col: Column, seed: int) -> Column:
    """A hash of the column, spread evenly over 0 ... 1 with 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(col, F.lit(seed)), 11) / float(1 << 53)


def fit_profiles(labelled: DataFrame, size: int = PROFILE, max_rows: int = MAX_FIT_ROWS) -> dict[str, list[int]]:
    """Each language's most frequent n-grams in rank order, from rows (doc_id, text, lang).

    Rows with a null lang or a text without letters teach nothing. Of a language with more than max_rows rows about that
    many are used, those with the least hashes of doc_id: the one bounded sample here, in which each language has its
    share and each copy of a text counts as a row. Counts are summed by Spark; size rows a language come to the driver.
    """
    rows = labelled.filter("lang is not null").select(text_of().alias("body"), "lang", unit_hash(F.coalesce(F.col("doc_id").cast("string"), text_of()), 7).alias("at"))
    many = rows.groupBy("lang").count().filter(F.col("count") > max_rows).collect()
    if many:
        share = F.create_map(*(x for r in many for x in (F.lit(r["lang"]), F.lit(max_rows / r["count"]))))
        rows = rows.filter(F.col("at") < F.coalesce(share[F.col("lang")], F.lit(1.0)))
    rows = rows.select("body", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, 0, STEP_BYTES)):
            by: dict[str, list] = {}
            for text, lang in zip(texts(part.column(0)), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams_of(text))
            for lang, found in by.items():
                grams, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])
        give_back()

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Nearest:
    """The nearest of some profiles to a text: language, score and distance as in identify."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.langs, self.size = sorted(profiles), size
        self.known = np.unique(np.array([g for x in profiles.values() for g in x], np.int64))
        self.places = np.full((len(self.known) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.places[np.searchsorted(self.known, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def __call__(self, text: str) -> tuple[str, float, float]:
        grams = ranking(text, self.size)
        if not len(grams) or not len(self.known):
            return "und", 0.0, 1.0
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        there = self.places[np.where(self.known[at] == grams, at, len(self.known))]
        apart = np.where(there < 0, self.size, np.abs(there - np.arange(len(grams))[:, None])).sum(axis=0) / (self.size * len(grams))
        best = int(np.argmin(apart))
        second = float(np.partition(apart, 1)[1]) if len(self.langs) > 1 else 1.0
        return self.langs[best], 1 - 0.5 * float(apart[best]) / second if second else 0.5, float(apart[best])


@own_names
def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, distance.

    A document's size most frequent n-grams are ranked over its whole text; each adds to a language's distance by how
    far its rank is out of place, or by size if the profile lacks it. The nearest language wins, ties in alphabetical
    order. distance is the mean per n-gram as a share of size; score is 1 - distance / (that of the second nearest),
    stretched to 0.5 ... 1. A text that is null or has no letter gets `und`, 0 and distance 1, as does any text if
    nothing was learned. Rows with a null or repeated doc_id are documents like any other; other columns are ignored;
    an empty table gives an empty result.
    """
    nearest = Nearest(profiles, size)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, 1, STEP_BYTES)):
            out = [nearest(text) for text in texts(part.column(1))]
            yield pa.record_batch([part.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64())))], ["doc_id", "lang_pred", "score", "distance"])

    rows = docs.select("doc_id", text_of())
    return rows.mapInArrow(predict, f"doc_id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, distance double")


def id_remainder(col: str, mod: int) -> Column:
    """crc32 of the id as text (null: empty text) modulo mod: the held-out folds."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


@own_names
def keep_identified(docs: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """docs, all columns as they came, without the rows whose text has no letter or is far from every language.

    Profiles are learned from docs itself as in predict_languages; a text goes if its distance is above max_distance:
    nearly none of its n-grams then is among a language's common ones. Where nothing can be learned, as without lang
    values, only texts without letters go. Only the text crosses to Python, and nothing shuffles.
    """
    nearest = Nearest(fit_profiles(docs.filter(id_remainder("doc_id", 4) != 2)), PROFILE)

    def stays(text: str) -> bool:
        lang, _, distance = nearest(text)
        return lang != "und" and distance <= max_distance if nearest.langs else len(grams_of(text)) > 0

    @F.arrow_udf("boolean")
    def identified(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in column:
            parts = by_bytes(pa.record_batch([values], ["text"]), 0, STEP_BYTES)
            yield pa.array([stays(t) for part in parts for t in texts(part.column(0))], pa.bool_())
        give_back()

    return docs.filter(identified(text_of()))


@own_names
def predict_languages(docs: DataFrame) -> DataFrame:
    """Profiles learned from docs with a lang outside the held-out fold (remainder 2 of 4), applied to all docs: see identify."""
    return identify(docs, fit_profiles(docs.filter(id_remainder("doc_id", 4) != 2)))
