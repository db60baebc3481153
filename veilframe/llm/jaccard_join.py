"""N-gram Jaccard join by T-occurrence search (DivideSkip; Li, Lu and Lu, 2008) over distributed inverted lists.

The steps, all exact:

1. Each text becomes the sorted set of hashes of its distinct word shingles; documents with equal sets are one class.
2. A set can only be linked if at most a fifth of its shingles occurs in no other set. Inverted lists over 32-bit
   fingerprints, dealt by the shingle's hash, tell which do; a shingle that several sets of a batch share is counted
   there and travels once. Of sets beyond SMALL one shingle in SAMPLE is looked at: where more of these stand alone
   than all of the set's shingles may, it links with none. The others go on (equal fingerprints and the shingles not
   looked at let some through in vain and lose none).
3. Sets meet in cells of sets with an equal shingle: first those of each set's few least hashes, where most links are
   found; then, for what the links found so far leave apart, those of its whole prefix, in which two linked sets must
   share a shingle. In a cell, a T-occurrence search finds who reaches the overlap.
4. Links become components by alternating stars.

Large cells are cut into chunks. In the second round chunks of the largest component face chunks of all other sets, and
these face each other, so that each pair of sets that is still apart meets, and pairs already connected don't.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.components import components

from . import bloom
from .shared import binaries, by_bytes, give_back, kept, mix64, own_names, scratch, text_of, u64

#: Words in a shingle, and the least Jaccard similarity as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Least hashes of a set that give its cells in the first round; sets in a chunk of a cell.
CELLS, CHUNK = 2, 1000
#: Shingles that a group of inverted lists, and a group of cells, holds on average.
LIST_SHINGLES, CELL_SHINGLES = 2_000_000, 1_000_000
#: Bytes of text to a shingle, about, for the number of groups alone; and bytes of text whose postings, and whose sets, a task holds at a time (a longer text alone).
BYTES_A_SHINGLE, POST_BYTES, SET_BYTES = 6, 4 << 20, 1 << 20
#: Sets of at most SMALL shingles are tried on all of them, larger ones on those whose fingerprint SAMPLE divides.
SMALL, SAMPLE = 64, 3
#: Least and most counters of the frequency sketch, one byte each, and how many of them a shingle counts in.
MIN_COUNTERS, MAX_COUNTERS, ROWS = 1 << 20, 1 << 25, 2
#: Weighs probing against merging in the number of long lists, as the paper proposes.
MU = 0.01

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles of WORDS words; of fewer words, the whole sequence's hash.

    A-Z are lower-cased; words are what is between bytes 9 to 13 and 32.
    """
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), np.uint64)
    n = len(words)
    if not n:
        return words
    size = min(WORDS, n)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = out * _STEP + words[j : n - size + 1 + j]
    return np.unique(mix64(out))


def needed(a: int, b: int) -> int:
    """The least number of common shingles with which sets of a and b link."""
    return -(-NUMERATOR * (a + b) // (DENOMINATOR + NUMERATOR))


def least_shared(n: int) -> int:
    """Shingles that a set of n has in common with any set it links with, at least."""
    return -(-NUMERATOR * n // DENOMINATOR)


class Index:
    """Inverted lists of some sets: for each shingle, the positions of the sets that hold it, ascending."""

    def __init__(self, sets: list[np.ndarray], at: list[int]) -> None:
        self.at = at
        flat = np.concatenate([sets[i] for i in at]) if at else np.zeros(0, np.uint64)
        owner = np.repeat(np.array(at, np.int64), [len(sets[i]) for i in at])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        self.keys, self.ends = flat[self.starts], np.append(self.starts[1:], len(flat))

    def lists(self, query: np.ndarray) -> list[list[int]]:
        if not len(self.keys):
            return []
        place = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        place = place[self.keys[place] == query]
        return [self.owner[a:b].tolist() for a, b in zip(self.starts[place].tolist(), self.ends[place].tolist(), strict=True)]

    def search(self, query: np.ndarray, sets: list[np.ndarray], wanted: set[int]) -> list[int]:
        """Positions in `wanted` of sets that link with the query: DivideSkip.

        The longest lists are set aside. A heap merges the short ones in order of position; a set that occurs there
        often enough to reach the threshold with the long lists is looked up in these by binary search, until it has
        reached the overlap needed or can't any more.
        """
        n = len(query)
        least = least_shared(n)
        lists = sorted(self.lists(query), key=len)
        if len(lists) < least:
            return []
        aside = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)))
        short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
        found, i, count = [], -1, 0

        def done() -> None:
            if count < least - aside or i not in wanted:
                return
            need, total, left = needed(n, len(sets[i])), count, len(long_)
            for row in long_:
                if total >= need or total + left < need:
                    break
                k = bisect_left(row, i)
                total, left = total + (k < len(row) and row[k] == i), left - 1
            if total >= need:
                found.append(i)

        for x in heapq.merge(*short) if len(short) > 1 else short[0]:
            if x == i:
                count += 1
            else:
                done()
                i, count = x, 1
        done()
        return found


def links_within(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all linked sets: each set found is searched from once, among those not found yet."""
    links: list[tuple[int, int]] = []
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    index, waiting = Index(sets, order := sorted(order)), set(order)
    while waiting:
        queue = [waiting.pop()]
        while queue and waiting:
            q = queue.pop()
            for i in index.search(sets[q], sets, waiting):
                links.append((q, i))
                waiting.discard(i)
                queue.append(i)
            if len(waiting) < len(index.at) // 2:
                index = Index(sets, sorted(waiting))
    return links


def links_between(sets: list[np.ndarray], groups: list[int], queries: list[int]) -> list[tuple[int, int]]:
    """Links from the query sets to sets of other groups, one at least for any two groups that become connected."""
    root = {g: g for g in groups}

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    links, index, apart = [], Index(sets, list(range(len(sets)))), len(root)
    for q in queries:
        if apart == 1:
            break
        wanted = {i for i, g in enumerate(groups) if find(g) != find(groups[q])}
        for i in index.search(sets[q], sets, wanted):
            if (a := find(groups[q])) != (b := find(groups[i])):
                root[a], apart = b, apart - 1
                links.append((q, i))
    return links


def set_id_of(data: bytes) -> bytes:
    """A set's name: a 128-bit hash of its shingles' bytes."""
    return xxhash.xxh3_128_digest(data)


def _short(ids: list[bytes | None]) -> np.ndarray:
    """The first 64 bits of names, which the search for suspects does with; 0 for none."""
    return np.array([int.from_bytes(i[:8], "little") if i else 0 for i in ids], np.uint64)


def _posted(prints: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Which fingerprints count for their owner: all of small sets, one in SAMPLE of others."""
    return small | (prints % np.uint64(SAMPLE) == 0)


def shingle_sets(docs: DataFrame, suspected: np.ndarray) -> DataFrame:
    """doc_id, key (a hash of the text), n (shingles), set_id (null if empty), short (its first 64 bits), shingles (their hashes, sorted, u64 little-endian).

    shingles is null but for sets whose short the Bloom filter `suspected` may hold, and there but for a task's first such row.
    """
    rows = docs.select("doc_id", text_of().cast("binary").alias("body"), F.xxhash64(text_of()).alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(suspected.tobytes())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            for part in by_bytes(batch, 1, SET_BYTES):
                data = [shingles(x).tobytes() for x in part.column(1).to_pylist()]
                ids = [set_id_of(x) if x else None for x in data]
                short = _short(ids)
                live = bloom.holds(bits, short).tolist()
                sent = [x if x and k and i not in seen and not seen.add(i) else None for x, i, k in zip(data, ids, live, strict=True)]
                found = pa.record_batch([part.column(0), part.column(2), pa.array([len(x) // 8 for x in data], pa.int64()), binaries(ids), pa.array(short.view(np.int64)), binaries(sent)], ["doc_id", "key", "n", "set_id", "short", "shingles"])
                yield found
        give_back()

    return rows.mapInArrow(build, f"doc_id {rows.schema[0].dataType.simpleString()}, key long, n long, set_id binary, short long, shingles binary")


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal keys of a sorted array."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
    for a, b in zip(starts, np.append(starts[1:], len(keys)) if len(keys) else [], strict=True):
        yield int(keys[a]), slice(a, b)


def _share_counts(owners: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings (owner, fingerprint): which are of a fingerprint with several owners; order; whether a posting repeats."""
    order = np.lexsort((owners, prints))
    o, f = owners[order], prints[order]
    new_f = np.append(True, f[1:] != f[:-1])
    repeated = ~(new_f | np.append(True, o[1:] != o[:-1]))
    which = np.cumsum(new_f) - 1
    return np.bincount(which[~repeated], minlength=which[-1] + 1)[which] > 1, order, repeated


def suspects(docs: DataFrame) -> DataFrame:
    """short of the sets that may share the threshold's part of their shingles with others.

    Postings travel as (names' first bits, `sizes`: twice the shared shingles that a set needs and 1 if it is small,
    counts, fingerprints). Two names with equal first bits need the smaller number of both.
    """
    source = docs.select(text_of().cast("binary").alias("body"))
    total = (source.agg(F.sum(F.length("body"))).first()[0] or 0) // BYTES_A_SHINGLE
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // LIST_SHINGLES))
    names, kinds = ["part", "ids", "sizes", "counts", "prints"], "part int, ids binary, sizes binary, counts binary, prints binary"

    def rows(part: int, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, prints: np.ndarray | None) -> pa.RecordBatch:
        data = [ids.astype("<u8"), sizes.astype("<u4"), counts.astype("<u4"), np.zeros(0, "<u4") if prints is None else prints.astype("<u4")]
        return pa.record_batch([pa.array([part], pa.int32()), *(binaries([x.tobytes()]) for x in data)], names)

    def tallies(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, base: int) -> Iterator[pa.RecordBatch]:
        """Counts go to parts from `base` on, dealt by the set's id."""
        deal = (ids % np.uint64(parts)).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        for part, at in _grouped(deal[order]):
            yield rows(base + part, ids[order[at]], sizes[order[at]], counts[order[at]], None)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (part for b in batches for part in by_bytes(b, 0, POST_BYTES)):
            every = [shingles(x) for x in batch.column(0).to_pylist()]
            names_ = [set_id_of(x.tobytes()) if len(x) else None for x in every]
            own = [i for i, x in enumerate(names_) if x is not None and x not in seen and not seen.add(x)]
            if not own:
                continue
            sets_ = [every[i] for i in own]
            ids, n = _short([names_[i] for i in own]), np.array([len(x) for x in sets_])
            flat, owner = np.concatenate(sets_), np.repeat(np.arange(len(own)), n)
            prints, small = flat & np.uint64(0xFFFFFFFF), n <= SMALL
            # what a small set links with is at most a quarter larger and must be there in full, too
            there = _posted(prints, (n * NUMERATOR <= SMALL * DENOMINATOR)[owner])
            tried = np.bincount(owner[_posted(prints, small[owner])], minlength=len(own))
            need = np.maximum(0, tried - (n - (-(-NUMERATOR * n // DENOMINATOR))))
            sizes = need * 2 + small
            yield from tallies(ids[need == 0], sizes[need == 0], need[need == 0], parts)
            flat, owner = flat[there], owner[there]
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            first = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
            here = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > 1
            counts = np.bincount(owner[here & _posted(flat & np.uint64(0xFFFFFFFF), small[owner])], minlength=len(own))
            yield from tallies(ids[counts > 0], sizes[counts > 0], counts[counts > 0], parts)
            # a shingle of several sets goes on once, as that of nobody (0), since its sets are counted
            flat, owner, here = flat[first], owner[first], here[first]
            deal = ((flat >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            who = np.where(here, -1, owner)
            order = np.lexsort((who, deal))
            for part, at in _grouped(deal[order]):
                w, f = who[order[at]], flat[order[at]] & np.uint64(0xFFFFFFFF)
                starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                k = w[starts]
                yield rows(part, np.where(k < 0, np.uint64(0), ids[k]), np.where(k < 0, 0, sizes[k]), np.diff(np.append(starts, len(w))), f)
        give_back()

    def count(group: pa.Table) -> pa.Table:
        columns = [np.concatenate([np.frombuffer(x, t) for x in group[n].to_pylist()]) for n, t in zip(names[1:], ("<u8", "<u4", "<u4", "<u4"), strict=True)]
        ids, sizes, counts, prints = columns
        if group["part"][0].as_py() >= parts:
            out = list(tallies(ids, sizes, counts, parts))
        else:
            # nobody's postings stand for two sets: with their own number each, they make any other owner's shared
            number = np.cumsum(ids == 0).astype(np.uint64)
            owners = np.repeat(np.where(ids == 0, number, ids), counts)
            shared, order, repeated = _share_counts(owners, prints)
            tried = _posted(prints.astype(np.uint64), np.repeat(sizes % 2 == 1, counts))[order]
            row = np.repeat(np.arange(len(ids)), counts)[order][shared & ~repeated & tried]
            n = np.bincount(row, minlength=len(ids))
            good = (n > 0) & (ids != 0)
            out = list(tallies(ids[good], sizes[good], n[good], parts))
            del columns, prints, owners, shared, order, repeated, tried, row
            give_back()
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], t) for t in (pa.int32(), *[pa.binary()] * 4)], names=names)

    def choose(group: pa.Table) -> pa.Table:
        ids, sizes, counts = (np.concatenate([np.frombuffer(x, t) for x in group[n].to_pylist()]) for n, t in zip(names[1:4], ("<u8", "<u4", "<u4"), strict=True))
        unique, which = np.unique(ids, return_inverse=True)
        n, need = np.bincount(which, weights=counts), np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(need, which, sizes.astype(np.int64) // 2)
        return pa.table({"short": pa.array(unique[n >= need].view(np.int64), pa.int64())})

    posted = source.mapInArrow(post, kinds)
    return posted.groupBy("part").applyInArrow(count, kinds).groupBy("part").applyInArrow(choose, "short long")


def _searched(cells: DataFrame, total: int, between: bool) -> DataFrame:
    """Links (a, b) of set ids within each cell: cells (cell, set_id, comp, asks, shingles)."""
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // CELL_SHINGLES))

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cell", "ascending"), ("set_id", "ascending")])
        ids, comps, asks, data = (group[n].to_pylist() for n in ("set_id", "comp", "asks", "shingles"))
        cell = np.array(group["cell"].to_pylist(), np.int64)
        a, b = [], []
        for _, at in _grouped(cell):
            sets = [np.frombuffer(x, "<u8") for x in data[at]]
            found = links_between(sets, comps[at], [i for i, x in enumerate(asks[at]) if x]) if between else links_within(sets)
            a += [ids[at.start + i] for i, _ in found]
            b += [ids[at.start + j] for _, j in found]
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy(F.pmod("cell", F.lit(parts)).alias("deal")).applyInArrow(lambda _, g: search(g), "a long, b long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, set_id) of all documents, and (set_id, n, shingles, node) of the sets that may link, each with a stored number.

    The first outlives the two scopes around, the second one ends with the inner of them.
    """
    chosen = kept(suspects(docs))
    suspected = bloom.once_filter(chosen, lambda batch: u64(batch.column(0)), chosen.count())
    with scratch(docs.sparkSession):  # the only table of all documents with shingles
        sets = kept(shingle_sets(docs, suspected), "none")
        small = kept(sets.select("doc_id", "key", "n", "set_id"), lasting=3)
        # besides suspects this has what the filter takes for one, at most a few in a hundred of the others: they find no partner
        live = sets.filter("shingles is not null").groupBy("set_id").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles"))
        # names are long: from here on a stored number stands for each
        return small, kept(live.withColumn("node", F.monotonically_increasing_id()), "none", lasting=1)


@own_names
def link_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (xxhash64 of the text), n_shingles, component_id.

    Two documents link when 100 * (common shingles) >= 80 * (shingles of either); component_id is the smallest doc_id
    reachable by links, its own included. A text that is null, empty or without words has no shingles and its own doc_id.
    Null doc_ids count in a component, and give its id only if it has no other; rows that repeat a doc_id are documents
    of their own. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    with scratch(spark):  # all but the documents' names and their components
        with scratch(spark):  # shingles without components
            small, numbered = _numbered(docs)
            live = numbered.select(F.col("node").alias("set_id"), "n", "shingles")
            alive = live.agg(F.sum("n")).first()[0] or 0
            heads = live.mapInArrow(_heads(lambda x: x[:CELLS]), "shingle long, set_id long")
            links = kept(_searched(_cells(heads, live), alive * CELLS, between=False), lasting=1)
            roots = kept(components(links), lasting=1)
            names = kept(numbered.select("set_id", "node"), lasting=1)
            comp = kept(live.join(roots, live.set_id == roots.node, "left").select("set_id", "n", F.coalesce("root", "set_id").alias("comp"), "shingles"), "none", lasting=1)
        apart = _apart(comp, alive)
        if not apart.isEmpty():
            cells = apart.join(comp, "set_id").select("cell", "set_id", "comp", "asks", "shingles")
            later = kept(_searched(cells, apart.join(comp, "set_id").agg(F.sum("n")).first()[0], between=True))
            if not later.isEmpty():
                roots = kept(components(links.unionByName(later)))
        classes = small.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
        named_roots = names.join(roots, "node", "left").select("set_id", F.coalesce("root", "node").alias("root"))
        tops = kept(classes.join(named_roots, "set_id", "left"))
        least = kept(tops.filter("root is not null").groupBy("root").agg(F.min("rep").alias("component_id")))
        # a set without a number links with none
        of_set = kept(tops.join(least, "root", "left").select("set_id", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id")), lasting=1)
    linked = small.filter("set_id is not null").join(of_set, "set_id").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id")
    alone = small.filter("set_id is null").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


@own_names
def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs, all columns as they came, with the document of the smallest doc_id of each component (see link_components).

    Rows that share that doc_id all stay, as do components without any doc_id. Only rows that a Bloom filter of the
    dropped texts may hold shuffle, to meet the list of what goes; the others pass straight through.
    """
    with scratch(docs.sparkSession):  # the list of what goes is all that the rest needs
        out = link_components(docs).filter("not (doc_id <=> component_id)")
        gone = kept(out.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), lasting=True)
    bitmap = docs.sparkSession.sparkContext.broadcast(bloom.once_filter(gone.select("gone_key"), lambda batch: u64(batch.column(0)), gone.count()).tobytes())

    @F.pandas_udf("boolean")
    def may_go(keys: pd.Series) -> pd.Series:
        return pd.Series(bloom.holds(np.frombuffer(bitmap.value, np.uint8), keys.to_numpy().astype(np.int64).view(np.uint64)))

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text_of()).alias("key"))
    rows = rows.select("row", "key", may_go("key").alias("suspect"))
    match = (F.col("key") == F.col("gone_key")) & F.col("row.doc_id").eqNullSafe(F.col("gone_id"))
    stay = rows.filter("suspect").join(gone, match, "left_anti")
    return rows.filter("not suspect").select("row").unionByName(stay.select("row")).select("row.*")


def _heads(choose: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """A mapper from (set_id, shingles) to one row for each shingle that `choose` takes of the set's."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            flat = [choose(np.frombuffer(x, "<u8")).view("<i8") for x in batch.column(names.index("shingles")).to_pylist()]
            own = np.repeat(np.arange(batch.num_rows), [len(x) for x in flat])
            yield pa.record_batch([pa.array(np.concatenate(flat) if flat else [], pa.int64()), batch.column(names.index("set_id")).take(pa.array(own))], ["shingle", "set_id"])

    return heads


def _counters(flat: np.ndarray, counters: int) -> np.ndarray:
    """(ROWS, n) counters of each shingle, of so many."""
    return np.stack([(mix64(flat ^ np.uint64(i + 1)) & np.uint64(counters - 1)).astype(np.int64) for i in range(ROWS)])


def _level(sums: np.ndarray) -> np.ndarray:
    """Counts in eighths of a power of two, in one byte: 0 for 0, 1 for 1, up to 2 ** 31."""
    return np.where(sums > 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(sums, 1)))), 0).astype(np.uint8)


def frequencies(live: DataFrame, total: int) -> np.ndarray:
    """A count-min sketch of how many sets hold each shingle, as levels (see _level).

    It has about as many counters as live shingles in all (`total`), MAX_COUNTERS at most. Beyond that many, counts
    stand out only above what falls on each counter by chance, ROWS * total / MAX_COUNTERS: passages that more sets
    hold still come last, and rarer shingles follow each other by their hash.
    """
    counters = min(MAX_COUNTERS, max(MIN_COUNTERS, 1 << int(total).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(counters, np.uint32)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                np.add.at(sums, _counters(np.frombuffer(data, "<u8"), counters).ravel(), 1)
        at = np.flatnonzero(sums)
        for block in np.unique(at >> 16):
            own = at[np.searchsorted(at, block << 16) : np.searchsorted(at, (block + 1) << 16)]
            yield pa.record_batch([pa.array([block], pa.int32()), binaries([(own & 0xFFFF).astype("<u2").tobytes()]), binaries([np.minimum(sums[own], 0xFFFF).astype("<u2").tobytes()])], ["block", "at", "n"])

    def add(rows: pa.Table) -> pa.Table:
        sums = np.zeros(1 << 16, np.int64)
        for at, n in zip(rows["at"].to_pylist(), rows["n"].to_pylist(), strict=True):
            sums[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u2")
        return pa.table({"block": rows["block"][:1], "n": binaries([_level(sums).tobytes()])})

    out = np.zeros(counters, np.uint8)
    for row in live.select("shingles").mapInArrow(count, "block int, at binary, n binary").groupBy("block").applyInArrow(add, "block int, n binary").toLocalIterator():
        out[row["block"] << 16 : (row["block"] + 1) << 16] = np.frombuffer(row["n"], np.uint8)
    return out


def _cells(heads: DataFrame, live: DataFrame) -> DataFrame:
    """First round: cells of sets with an equal head; large ones in chunks that another head deals otherwise."""
    lists = kept(heads.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = kept(heads).join(lists, "shingle").withColumn("chunk", F.pmod(F.xxhash64("set_id", "shingle"), F.ceil(F.col("size") / CHUNK)))
    cells = kept(members.select(F.xxhash64("shingle", "chunk").alias("cell"), "set_id"))
    return cells.join(live, "set_id").select("cell", "set_id", F.lit(0).cast("long").alias("comp"), F.lit(True).alias("asks"), "shingles")


def _apart(comp: DataFrame, total: int) -> DataFrame:
    """Second round: cells (cell, set_id, asks) of sets that share a prefix shingle and are not connected yet.

    Two linked sets of a and b shingles have more in common than either has beyond its prefix of n - ceil(0.8 n) + 1
    first ones, in any order that all sets follow; so they share a shingle of both prefixes. The order here is by
    frequency, in powers of two of the sketch's counts, then by hash: passages that many sets hold come last, and few
    sets of different components meet. A shingle that only one set can hold needs no list. Lists are cut into bands of
    sizes, each with the next smaller one, since linked sets differ by a quarter in size at most. The first shingle that
    two linked sets share must be early in the smaller one, as what follows it there has to hold their overlap; lists
    without such a set go. Lists with the same least set_id are searched together, as one cell: that a set holds many
    shingles in common with the same others then doesn't repeat it.
    """
    sketch = comp.sparkSession.sparkContext.broadcast(frequencies(comp, total).tobytes())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for row, data in enumerate(batch.column(2).to_pylist()):
                own = np.frombuffer(data, "<u8")
                n = len(own)
                level = sums[_counters(own, len(sums))].min(axis=0)
                head = np.lexsort((own, (level - 1) // 8))[: n - least_shared(n) + 1]
                place = np.flatnonzero(level[head] > 1)
                band = int(math.log(n) / math.log(DENOMINATOR / NUMERATOR))
                for b in (band, band + 1):
                    parts = (own[head[place]].view("<i8"), np.full(len(place), b), np.full(len(place), row), place <= n - needed(n, n))
                    for column, part in zip(columns, parts, strict=True):
                        column.append(part)
            shingle, bands, row, early = (pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.bool_()), strict=True))
            yield pa.record_batch([shingle, bands, batch.column(0).take(row), batch.column(1).take(row), early], ["shingle", "band", "set_id", "comp", "early"])

    posts = comp.select("set_id", "comp", "shingles").mapInArrow(prefixes, "shingle long, band int, set_id long, comp long, early boolean")
    posts = kept(posts.withColumn("list", F.xxhash64("shingle", "band")).select("list", "set_id", "comp", "early"))
    lists = posts.groupBy("list").agg(F.min("set_id").alias("first"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("early").alias("early"))
    mixed = kept(lists.filter("lo != hi and early").select("list", "first"))
    members = kept(posts.join(mixed, "list").select("first", "set_id", "comp").distinct())
    shares = kept(members.groupBy("first", "comp").agg(F.count(F.lit(1)).alias("k")))
    largest = kept(shares.groupBy("first").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("size")))
    rows = members.join(largest, "first").withColumn("in_main", F.col("comp") == F.col("main"))
    mains, others = F.ceil(F.col("k") / CHUNK).cast("int"), F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("k")) / CHUNK)).cast("int")
    own = F.pmod(F.xxhash64("set_id", "first"), F.when(F.col("in_main"), mains).otherwise(others)).cast("int")

    def pairs(kind: str, i: Column, j: Column) -> Column:
        return F.xxhash64("first", F.lit(kind), i.cast("int"), j.cast("int"))

    facing = F.when(
        F.col("in_main"), F.transform(F.sequence(F.lit(0), others - 1), lambda j: pairs("main", own, j))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), mains - 1), lambda i: pairs("main", i, own)),
            F.transform(F.sequence(F.lit(0), others - 1), lambda j: pairs("other", F.least(own, j), F.greatest(own, j))),
        )
    )
    cells = kept(rows.select(F.explode(facing).alias("cell"), "set_id", (~F.col("in_main")).alias("asks")))
    spread = kept(cells.join(comp.select("set_id", "comp"), "set_id").groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("cell"))
    return kept(cells.join(spread, "cell"))
