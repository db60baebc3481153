"""What the corpus operators share: reading documents, tables kept between steps, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.store import kept, kept_folder, scratch

__all__ = ["STEP_BYTES", "binaries", "by_bytes", "give_back", "kept", "kept_folder", "mix64", "own_names", "read_documents", "scratch", "text_of", "texts", "u64"]


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of text that a task holds as Python values at once, unless an operator sets its own (a longer text alone).
STEP_BYTES = 2 << 20
#: Columns that operators refer to by name.
USED = ("doc_id", "text", "lang", "n_chars", "vec_id", "embedding")


def own_names(operator: Callable) -> Callable:
    """The operator, on a first table whose other columns can't be mistaken for those it uses, such as `TEXT` beside `text`.

    Columns that it hands on get their names back.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args: object, **kwargs: object) -> object:
        names = docs.columns
        safe = [n if n in USED and names.index(n) == i else f"_other{i}" for i, n in enumerate(names)]
        out = operator(docs.toDF(*safe), *args, **kwargs)
        return out.toDF(*names) if isinstance(out, DataFrame) and out.columns == safe else out

    return run


def text_of(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def u64(column: pa.Array) -> np.ndarray:
    """A non-null bigint column as unsigned 64-bit numbers."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def give_back() -> None:
    """Return freed memory to the system: an idle worker otherwise holds what its largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose values in a text or binary column have at most so many bytes, or that are one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers, so that any of their bits can serve as a hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
