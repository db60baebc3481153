"""SentencePiece ids and decoded texts, each distinct marked word of a worker segmented once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import by_bytes, own_names, text_of, texts
from .tokenization import pieces

#: Bytes of text that are encoded together (a longer one alone): bounds what a worker holds beside its table of chunks.
STEP_BYTES = 512 << 10


@own_names
def piece_ids(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, ids (array of int), decoded.

    ids are those that the sentencepiece library gives for the whole text (null: empty, which has none) without begin
    or end ids; decoded is what its decode makes of them. No shuffle: a text's words are looked up in the worker's table
    of distinct chunks, missing ones are segmented by the library, and ids are joined by position. Rows with a null or
    repeated doc_id are documents like any other; other columns are ignored; an empty table gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            for part in by_bytes(batch, 1, STEP_BYTES):
                ids = table.encode(texts(part.column(1)))
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(table.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", text_of())
    return rows.mapInArrow(encode, f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>, decoded string")
