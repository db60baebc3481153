"""Alignment of two tokenizers on the same texts: groups of tokens that end together, and links of overlapping tokens.

Each task turns the distinct chunks of its Arrow batches into tables of token intervals on one line of byte offsets, and
DuckDB joins them there: an ASOF join finds the B token under each A token's first byte, another one with a range the B
tokens that begin within an A token, window sums over common ends number the groups. Documents are put together from their chunks.
How many documents hold a pair of ids is counted by each task in DuckDB and summed up by Spark.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binaries, by_bytes, give_back, kept, own_names, text_of, texts

#: Fixed value: the pre-tokens of byte-level vocabularies of this kind.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text aligned at once; chunks that a worker remembers (about 400 bytes each): so many and those before them.
STEP_BYTES, MAX_CHUNKS = 1 << 20, 150_000
#: Counted pairs that a task gathers before it sums up.
MAX_COUNTED = 4_000_000
#: Pairs whose counts are broadcast at most (17 bytes each); the rarer ones beyond meet their counts in a shuffle.
MOST_PAIRS = 4_000_000

LINKS = """
    select a.chunk, a.id as a_id, b.id as b_id from a asof join b on a.first >= b.first
    union all
    select a.chunk, a.id, b.id from (from b where first not in (select first from a)) b asof join a on b.first > a.first where b.first < a.past
    order by chunk
"""
#: Tokens in the order of groups, A's before B's; part: how many common ends lie before the token's own.
GROUPS = """
    with marked as (
        select chunk, 0 as side, id, first, past, past in (select past from b) as common from a
        union all
        select chunk, 1, id, first, past, past in (select past from a) from b
    )
    select chunk, side, id, coalesce(sum(common::int) over (partition by side order by past rows between unbounded preceding and 1 preceding), 0)::bigint as part
    from marked order by part, side, first
"""


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """A worker's tokenizers, and what it knows of distinct chunks.

    A text is cut before spaces that follow a letter, digit or mark, and before line ends between two of these. A never has
    a token across such a place, as its pre-tokens hold white space at their start alone; neither has B, if no piece has a
    marker after another character, and none has a line end.
    """

    safe = "!-~À-ÖØ-öø-ÿ"
    unsafe = re.compile(f"[^{safe}] ")
    plain = re.compile(f"[ \n]?[{safe}]+")
    cut = re.compile(f"(?<=[{safe}])(?= |\n[{safe}])")

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        symbols = byte_symbols()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(self.b.id_to_piece, ids), strict=True)]
        self.quick = self._quick()
        self.a_lengths, self.b_lengths = (np.fromiter(map(len, known), np.int64, len(known)) for known in (self.a_bytes, self.b_bytes))
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in map(self.b.id_to_piece, ids)) and self.b.encode("\nx", num_threads=1)[:2] == [self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")]
        x, blank = self.b.encode(["x", "x "], num_threads=1)
        self.blank = blank[len(x) :]
        self.size = len(self.b_bytes)
        numbers = list(map(str, range(max(len(self.a_bytes), self.size))))
        self.written = [[n + mark for n in numbers] for mark in (",", "|", ";", "")]
        self.width = np.dtype("<u4" if len(self.a_bytes) * self.size < 1 << 32 else "<u8")
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.sql = duckdb.connect(config={"threads": 1})

    def _quick(self) -> object | None:
        """A's ids for plain chunks by a faster library, where A is what that takes: single bytes, then merges in the order of ids."""
        import tiktoken

        model = json.loads(self.a.to_str())
        added = {t["id"] for t in model["added_tokens"]}
        ranks = {token: i for i, token in enumerate(self.a_bytes) if i not in added and token}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        order = [model["model"]["vocab"][x + y] for x, y in merged]
        pre = model["pre_tokenizer"] or {}
        plain = model["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or order != list(range(256, 256 + len(order))) or len(ranks) != 256 + len(order):
            return None
        return tiktoken.Encoding("plain", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, new: list[str]) -> list[list[int]]:
        """A's ids of chunks: those of plain letters, digits and marks by the faster library, others by its own."""
        plain = self.plain.fullmatch
        ids = [self.quick.encode_ordinary(c) if plain(c) else None for c in new] if self.quick else [None] * len(new)
        other = [i for i, x in enumerate(ids) if x is None]
        for i, found in zip(other, self.a.encode_batch_fast([new[i] for i in other], add_special_tokens=False) if other else (), strict=True):
            ids[i] = found.ids
        return ids

    def chunks(self, line: str) -> list[str]:
        """The line, which begins with the added space, in parts; whole where it holds what B takes for a marker."""
        if not self.apart or "▁" in line or "\x00" in line:
            return [line]
        if "\n" in line or self.unsafe.search(line):
            return self.cut.split(line)
        return [" " + w for w in line[1:].split(" ")]

    def _pieces(self, new: list[str]) -> list[list[int]]:
        """B's ids of chunks; one that begins with a line end is encoded after the space that B adds, and loses it."""
        ids = self.b.encode([c if c[0] == "\n" else c[1:] for c in new], num_threads=1)
        for i, c in enumerate(new):
            if c[0] == "\n":
                ids[i] = ids[i][1:]
            elif c == " ":
                ids[i] = self.blank
        return ids

    def _intervals(self, ids: list[list[int]], lengths: np.ndarray) -> pa.Table:
        """The tokens of chunks that follow each other without a gap."""
        own = np.fromiter(chain.from_iterable(ids), np.int64)
        past = np.cumsum(lengths[own])
        chunk = np.repeat(np.arange(len(ids)), np.fromiter(map(len, ids), np.int64, len(ids)))
        return pa.table({"chunk": chunk, "id": own, "first": past - lengths[own], "past": past})

    def _same(self, ids: list[list[int]], known: list[bytes], data: list[bytes]) -> list[bool]:
        """Whether each chunk's tokens are its bytes."""
        return [b"".join([known[k] for k in x]) == d for x, d in zip(ids, data, strict=True)]

    def learn(self, new: list[str]) -> None:
        """Align chunks: (tokens of A, of B, groups, links, their text, pairs) each; None where bytes differ."""
        a = self._ids(new)
        b = self._pieces(new)
        data = [c.encode() for c in new]
        good = [x and y for x, y in zip(self._same(a, self.a_bytes, data), self._same(b, self.b_bytes, data), strict=True)]
        if not all(good):
            self.known.update((c, None) for c, ok in zip(new, good, strict=True) if not ok)
            a, b, new = ([x for x, ok in zip(xs, good, strict=True) if ok] for xs in (a, b, new))
        own = new
        if not own:
            return
        for name, table in (("a", self._intervals(a, self.a_lengths)), ("b", self._intervals(b, self.b_lengths))):
            self.sql.register(f"{name}_arrow", table)
            self.sql.execute(f"create or replace temp table {name} as from {name}_arrow")
            self.sql.unregister(f"{name}_arrow")
        links = self.sql.sql(LINKS).to_arrow_table()
        values = (links["a_id"].to_numpy() * self.size + links["b_id"].to_numpy()).astype(self.width).tobytes()
        step = self.width.itemsize
        at = (np.searchsorted(links["chunk"].to_numpy(), np.arange(len(own) + 1)) * step).tolist()
        tokens = self.sql.sql(GROUPS).to_arrow_table()
        chunk, side, ids, part = (tokens[c].to_numpy() for c in ("chunk", "side", "id", "part"))
        ends = np.append(np.flatnonzero(np.diff(chunk)), len(chunk) - 1)
        mark = np.where(np.append(np.diff(part) == 0, False), np.where(np.append(np.diff(side) == 0, False), 0, 1), 2)
        mark[ends] = 3
        words = [self.written[m][i] for m, i in zip(mark.tolist(), ids.tolist(), strict=True)]
        counts = np.diff(part[ends], prepend=-1).tolist()
        first = 0
        for k, (name, x, y, n, last) in enumerate(zip(own, a, b, counts, (ends + 1).tolist(), strict=True)):
            self.known[name] = (len(x), len(y), n, (at[k + 1] - at[k]) // step, "".join(words[first:last]), values[at[k] : at[k + 1]])
            first = last

    def documents(self, rows: list[str]) -> list[tuple]:
        """(tokens of A, of B, groups, links, digest of the groups, distinct pairs, how often each) of each text."""
        if len(self.known) > MAX_CHUNKS:
            self.known, self.older = {}, self.known
        split = [self.chunks(" " + t) if t else [] for t in rows]
        fresh: set[str] = set()
        for chunks in split:
            fresh.update(chunks)
        fresh.difference_update(self.known)
        again = fresh.intersection(self.older)
        self.known.update((c, self.older[c]) for c in again)
        new = list(fresh - again)
        if new:
            self.learn(new)
        out = []
        for chunks in split:
            found = list(map(self.known.__getitem__, chunks))
            if not found or None in found:
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            a, b, groups, links, parts, pairs = zip(*found, strict=True)
            values, times = np.unique(np.frombuffer(b"".join(pairs), self.width), return_counts=True)
            times = times.astype("u1" if times.max() < 256 else "<u4").tobytes()
            out.append((sum(a), sum(b), sum(groups), sum(links), hashlib.sha256(";".join(parts).encode()).hexdigest(), values.tobytes(), times))
        return out


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each row's doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs of ids with how often each is linked.

    pairs are little-endian numbers, a id * size of B's vocabulary + b id, ascending; times are as many of one or four bytes.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for part in by_bytes(batch, 1, STEP_BYTES):
                gc.disable()  # many small tuples and no cycles: collections would only walk through them
                *counts, digests, pairs, times = zip(*own.documents(texts(part.column(1))), strict=True)
                gc.enable()
                yield pa.record_batch([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), binaries(pairs), binaries(times)], names)
        give_back()

    rows = docs.select("doc_id", text_of().alias("text"))
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    names = [f.split()[0] for f in schema.split(", ")]
    return rows.mapInArrow(align, schema)


def _flat(column: pa.Array, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's end."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), width), np.cumsum(np.fromiter(map(len, values), np.int64, len(values))) // width.itemsize


def pair_counts(rows: DataFrame, size: int, width: np.dtype) -> DataFrame:
    """(pair, n, best): in how many rows each pair stands, and whether no pair with the same A id stands in more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sql = duckdb.connect(config={"threads": 1})
        sql.execute("create table counted (pair bigint, n bigint)")
        held = 0
        for batch in batches:
            for part in by_bytes(batch, 0, STEP_BYTES):
                sql.register("part", pa.table({"pair": _flat(part.column(0), width)[0].astype(np.int64)}))
                held += sql.execute("insert into counted select pair, count(*) from part group by pair").fetchone()[0]
            if held > MAX_COUNTED:
                sql.execute("create or replace table counted as select pair, sum(n)::bigint as n from counted group by pair")
                held = MAX_COUNTED // 2
        yield from sql.sql("select pair, sum(n)::bigint as n from counted group by pair").to_arrow_reader(1 << 16)

    counts = kept(rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    most = counts.groupBy(F.expr(f"pair div {size}").alias("a_id")).agg(F.max("n").alias("most"))
    return counts.join(most, F.expr(f"pair div {size}") == F.col("a_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


@own_names
def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level file of the tokenizers library and sees the text after a space, B is a sentencepiece file, which
    adds the space itself; special tokens' strings are plain text for both. Tokens are taken as the bytes they stand for.
    Texts that are null, empty, or whose bytes either tokenizer changes have no tokens: zeros and an empty digest. Groups
    end where both have a token's end; a link is a pair of overlapping tokens. A pair of ids counts the documents (rows)
    that hold it linked; count_sum adds up the counts of a document's links, n_best counts those links whose count is the
    highest of their A id. Null and repeated doc_ids are rows like any other, other columns are ignored, an empty table
    gives an empty result.

    Texts are tokenized once, and rows stored with their distinct pairs; only partial counts of pairs shuffle. Counts go
    back by a broadcast of the most_pairs most frequent pairs, and beyond these by a join, in which no pair is hot.
    """
    spark = docs.sparkSession
    with_own = aligner(a_path, b_path)
    size, width = with_own.size, with_own.width
    rows = kept(aligned(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    pairs = kept(pair_counts(rows, size, width))
    total = pairs.count()
    least = pairs.select(F.percentile_approx("n", 1 - most_pairs / total, 10_000)).first()[0] if total > most_pairs else 0
    table = pairs.filter(F.col("n") > least).toArrow()
    order = np.argsort(table["pair"].to_numpy())
    shared = spark.sparkContext.broadcast([table[c].to_numpy()[order] for c in ("pair", "n", "best")])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            for part in by_bytes(batch, 1, STEP_BYTES):
                own, ends = _flat(part.column(1), width)
                times = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(t, "u1" if len(t) * width.itemsize == len(p) else "<u4") for p, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))]).astype(np.int64)
                at = np.searchsorted(known, own.astype(known.dtype))
                there = known[np.minimum(at, len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
                at = at[there]
                counts, bests = np.zeros(len(own) + 1, np.int64), np.zeros(len(own) + 1, np.int64)
                counts[1:][there], bests[1:][there] = n[at] * times[there], best[at] * times[there]
                counts, bests = np.cumsum(counts), np.cumsum(bests)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                rest, outs = np.flatnonzero(~there), np.searchsorted(np.flatnonzero(~there), np.concatenate([[0], ends]))
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(counts[ends] - counts[starts]),
                        pa.array(bests[ends] - bests[starts]),
                        pa.ListArray.from_arrays(pa.array(outs, pa.int32()), pa.array(own[rest].astype(np.int64))),
                        pa.ListArray.from_arrays(pa.array(outs, pa.int32()), pa.array(times[rest])),
                    ],
                    ["row", "count_sum", "n_best", "rare", "rare_times"],
                )

    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not least:
        whole = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pa.Table.from_batches(weigh(iter([batch.select(["row", "pairs", "times"])])))
                columns = {c: batch.column(c) for c in whole} | ({c: found[c].combine_chunks() for c in ("n_best", "count_sum")} if batch.num_rows else {})
                if batch.num_rows:
                    yield pa.record_batch([columns[c] for c in shown], shown)

        types = dict(rows.dtypes) | {"n_best": "long", "count_sum": "long"}
        return rows.select("row", "pairs", "times", *whole).mapInArrow(told, ", ".join(f"{c} {types[c]}" for c in shown))
    weighed = kept(rows.select("row", "pairs", "times").mapInArrow(weigh, "row long, count_sum long, n_best long, rare array<long>, rare_times array<long>"))
    rare = weighed.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    added = rare.join(pairs, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    sums = weighed.select("row", "count_sum", "n_best").join(added, "row", "left")
    sums = sums.select("row", (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"))
    return rows.join(sums, "row").select(*shown)
