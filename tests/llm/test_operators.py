"""The operators beyond their queries: other ways through them, damaged data, and the stages of the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import bloom, jaccard_join, line_dedup, ogg, pii
from veilframe.llm.best_fit_packing import plan_slots
from veilframe.llm.exact_dedup import drop_exact_duplicates
from veilframe.operators.components import components
from veilframe.llm.token_store import EliasFano, Shard, write_shard


@pytest.mark.parametrize("seed", range(4))
def test_elias_fano(seed):
    rnd = np.random.default_rng(seed)
    values = np.concatenate([[0], np.sort(rnd.integers(0, 10 ** (2 * seed + 1), 500))])
    ef = EliasFano.of(values)
    assert ef.all().tolist() == values.tolist() == [ef.select(i) for i in range(len(values))]


def test_shard():
    ids = [np.arange(n, dtype=np.uint32) for n in (3, 1, 70000, 2)]
    shard = Shard(write_shard([None, 4, 5, 5], ids, 4))
    assert [shard.document(i)[0] for i in range(4)] == [None, 4, 5, 5]
    assert all((shard.document(i)[2] == x).all() for i, x in enumerate(ids))


def test_filters_hold_what_they_saw(spark):
    from veilframe.llm.shared import u64

    df = spark.range(3000).select((F.col("id") % 2500).alias("v")).repartition(5)
    twice = bloom.twice_filter(df, lambda b: u64(b.column(0)), 3000)
    once = bloom.once_filter(df, lambda b: u64(b.column(0)), 3000)
    values = np.arange(2500).astype(np.uint64)
    assert bloom.holds(twice, values[:500]).all() and bloom.holds(twice, values[500:]).mean() < 0.05
    assert bloom.holds(once, values).all() and bloom.holds(once, values + np.uint64(10**6)).mean() < 0.05


def test_plan_fills_each_slot_once():
    rnd = random.Random(1)
    for size in (8, 64):
        counts = {n: rnd.randrange(1, 40) for n in rnd.sample(range(1, size + 1), size // 2)}
        plan = sorted(plan_slots(counts, size))
        used = {}
        for i, (length, rank, first, each, offset) in enumerate(plan):
            last = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else counts[length]
            for r in range(rank, last):
                nth = r - rank
                used.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
        assert sum(map(len, used.values())) == sum(counts.values())
        for slots in used.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= size
        total = sum(n * c for n, c in counts.items())
        assert -(-total // size) <= len(used) <= 1.25 * total / size + 1


def test_lines_by_join_and_first_occurrence(spark, docs):
    def rows(**more):
        return sorted(map(repr, line_dedup.drop_repeated_lines(docs, **more).collect()))

    assert rows(max_broadcast=0) == rows()
    assert rows(max_broadcast=0, keep_first=True) == rows(keep_first=True)
    first = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs, keep_first=True).filter("doc_id between 80 and 94").collect()}
    assert first[80].n_dropped == 1 and first[81].n_dropped == 2


def test_larger_sets_are_tried_on_a_sample(spark):
    """Links between sets on both sides of the least size that is sampled, near the threshold, against all pairs."""
    rnd = random.Random(9)
    sets = []
    for i in range(60):
        words = [f"v{i}_{k}" for k in range(rnd.choice([50, 60, 66, 70, 84, 90, 200]))]
        sets.append(words)
        cut = rnd.randrange(len(words) // 4)
        sets.append(words[cut:] + [f"e{i}_{k}" for k in range(rnd.randrange(6))])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(sets)], "doc_id long, text string").repartition(5)
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in sets]
    want = {(i, i - 1 if i % 2 and 100 * len(grams[i] & grams[i - 1]) >= 80 * len(grams[i] | grams[i - 1]) else i) for i in range(len(sets))}
    got = {(r.doc_id, r.component_id) for r in jaccard_join.link_components(df).collect()}
    assert got == want and 20 < sum(a != b for a, b in want) < 58


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == find(n) for n in root)


def test_search_finds_all_links_and_no_others():
    rnd = random.Random(3)
    base = [rnd.sample(range(10**6), 60) for _ in range(4)]
    sets = []
    for _ in range(60):
        own = set(rnd.choice(base))
        for _ in range(rnd.randrange(0, 9)):
            own.discard(rnd.choice(sorted(own)))
            own.add(rnd.randrange(10**6))
        sets.append(np.array(sorted(own), np.uint64))
    linked = [(i, j) for i in range(60) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)]
    index = jaccard_join.Index(sets, list(range(60)))
    for q in range(60):
        assert sorted(index.search(sets[q], sets, set(range(60)) - {q})) == sorted([j for i, j in linked if i == q] + [i for i, j in linked if j == q])

    def classes(pairs):
        root = list(range(60))
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    assert classes(jaccard_join.links_within(sets)) == classes(linked)
    assert classes(jaccard_join.links_between(sets, list(range(60)), list(range(60)))) == classes(linked)


def test_small_cells_and_chunks_lose_no_link(spark, docs, monkeypatch):
    def rows():
        return sorted(map(repr, jaccard_join.link_components(docs).collect()))

    want = rows()
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    monkeypatch.setattr(jaccard_join, "CELLS", 1)
    assert rows() == want


def test_damaged_media():
    text = bytes(range(1, 256)) * 700
    data = ogg.write_ogg(text)
    assert ogg.open_media(data).payload == ogg.padded(text)
    times = ogg.open_media(data).times
    assert times == sorted(times) and times[-1] == len(ogg.padded(text)) / ogg.RATE
    broken = bytearray(data)
    broken[len(data) // 2] ^= 255
    media = ogg.open_media(bytes(broken))
    assert media.bad_pages == 1 and media.payload is None and media.n_bytes == len(text)
    assert ogg.open_media(b"").streams == 0 and ogg.open_media(data[:-5]).payload is None


def test_contexts_discover_and_masks(spark):
    texts = [f"reach me phone: +1 (555) 555-{1000 + i} thanks" for i in range(12)] + [f"so phone: 555-867-{i:04d} ok" for i in range(5)] + ["the 555-000-1111 thing", "say 555-867-0001 again", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.mask_personal_data(df).collect()}
    assert out[0] == "reach me phone: <PHONE> thanks" and out[12] == "so phone: <PHONE> ok"
    assert out[17] == texts[17] and out[18] == "say <PHONE> again" and out[19] is None


def test_stages_keep_columns_and_clean_documents(spark, docs, corpus):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "personal_data", "packing"]
    kept = stages["language_id"](spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= set(range(52)) and not {70, 71, 72, 73} & {r.doc_id for r in kept.collect()}
    once = stages["exact_dedup"](spark, docs, "")
    assert once.columns == docs.columns and once.count() == len({t or "" for _, t, _ in corpus})
    assert {61} <= {r.doc_id for r in once.collect()} and not {3, 60} & {r.doc_id for r in once.collect()}
    near = stages["near_dedup"](spark, docs, "")
    ids = {r.doc_id for r in near.collect()}
    linked = jaccard_join.link_components(docs).collect()
    assert near.columns == docs.columns and ids == {r.doc_id for r in linked if r.doc_id == r.component_id}
    assert 40 in ids and len(set(range(40, 52)) - ids) > 5 and set(range(3)) <= ids
    masked = {r.doc_id: r for r in stages["personal_data"](spark, docs, "").filter("doc_id >= 110").collect()}
    assert masked[110].text == "mail me at <EMAIL>, or <IP> and 300.1.1.1" and masked[110].n_chars == len(masked[110].text)


def test_empty_stages(spark, docs):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), "").count() == 0, name


def test_repeated_rows_share_a_decision(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    assert sorted(map(repr, drop_exact_duplicates(df).collect())) == ["Row(doc_id=2, text='a')", "Row(doc_id=None, text='b')"]
