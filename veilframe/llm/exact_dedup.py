"""Exact duplicates: a two-pass Bloom filter finds the hashes that may repeat; only their rows shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import kept, own_names, text_of, u64


def _suspect(df: DataFrame, name: str, values: int) -> Column:
    """Whether the row's 64-bit hash, in df's column `name`, may occur twice there; values: how many to expect."""
    bitmap = bloom.twice_filter(df.select(name), lambda batch: u64(batch.column(0)), values)
    shared = df.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    @F.pandas_udf("boolean")
    def may_repeat(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        bits = np.frombuffer(shared.value, np.uint8)
        for part in parts:
            yield pd.Series(bloom.holds(bits, part.to_numpy().astype(np.int64).view(np.uint64)))

    return may_repeat(F.col(name))


def _marked(df: DataFrame, name: str, max_bits: int) -> DataFrame:
    """df with `suspect`, a filter for each slice of the hashes."""
    n = df.count()
    parts = bloom.by_slice(df, name, n, max_bits)
    return reduce(DataFrame.unionByName, [p.withColumn("suspect", _suspect(p, name, -(-n // len(parts)))) for p in parts])


@own_names
def exact_duplicates(docs: DataFrame, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the largest doc_id stays (a null doc_id only
    if the group has no other). Rows that repeat both doc_id and text share one decision, and each counts in
    group_size. An empty table gives an empty result; other columns are ignored, whatever their names.

    One scan of the texts leaves a table of hashes; the filters are built and probed on its 64-bit hashes. Rows whose
    hash cannot repeat pass straight through. The rest meet on SHA-256, with partial sums before the shuffle; the join
    back is between two stored tables, so that a hot group's rows can be split between tasks.
    """
    hashes = kept(docs.select(F.col("doc_id"), F.xxhash64(text_of()).alias("h"), F.unhex(F.sha2(text_of(), 256)).alias("sha")))
    marked = kept(_marked(hashes, "h", max_bits).select("doc_id", "sha", "suspect"))
    groups = kept(marked.filter("suspect").groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    single = marked.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    several = marked.filter("suspect").join(groups, "sha").select("doc_id", "keep_id", "group_size", "sha")
    return single.unionByName(several).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


@own_names
def drop_exact_duplicates(docs: DataFrame, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """docs with one row for each distinct text, all columns as they came.

    The row with the largest doc_id stays (one without doc_id only if there is no other); of rows that repeat doc_id and
    text, the one whose other columns have the largest hash. A null text counts as empty, and the row that stays keeps
    what it had. An empty table stays empty. Only rows whose text may repeat shuffle, keyed by the text's SHA-256 after
    each task has chosen among its own. Filters are built from a stored table of hashes; where one is not enough, rows
    are stored by slice of the hashes first.
    """
    hashed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text_of()).alias("h"))
    hashes = kept(docs.select(F.xxhash64(text_of()).alias("h")))
    n = hashes.count()
    rows, keys = bloom.by_slice(hashed, "h", n, max_bits), bloom.by_slice(hashes, "h", n, max_bits)
    marked = reduce(DataFrame.unionByName, [r.select("row", _suspect(k, "h", -(-n // len(rows))).alias("suspect")) for r, k in zip(rows, keys, strict=True)])
    others = F.xxhash64(F.to_json(F.struct(*(F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"))))
    chosen = (
        marked.filter("suspect")
        .groupBy(F.sha2(F.coalesce(F.col("row.text").cast("string"), F.lit("")), 256))
        .agg(F.max_by("row", F.struct(F.coalesce(F.col("row.doc_id"), F.lit(-(2**63))), others)).alias("row"))
    )
    return marked.filter("not suspect").select("row").unionByName(chosen.select("row")).select("row.*")
