"""Whitening, SimHash and tokenizer alignment against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import alignment, queries, simhash, whitening

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + more)


def test_whitening_against_a_dense_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)) @ np.diag(np.linspace(2, 0.1, 12)) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, x[0].tolist()), (None, x[1].tolist()), (901, None), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11)]
    out = whitening.whiten(vectors(spark, [(*r, 1, "x") for r in rows], ", component int, VEC_ID string"), block=5).toPandas()
    whole = np.floor(256 * x)
    n, sums = len(np.unique(whole, axis=0)), np.unique(whole, axis=0).sum(axis=0)
    cov = np.cov(np.unique(whole, axis=0).T, bias=True)
    values, vecs = np.linalg.eigh(cov)
    assert len(out) == 4 * 302 and set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-10
    for c in range(1, 5):
        own = out[(out.component == c) & (out.vec_id < 300)].sort_values("vec_id")
        want = (whole - sums / n) @ vecs[:, -c] / np.sqrt(values[-c])
        assert min(np.abs(own.whitened - s * want).max() for s in (1, -1)) < 1e-9
        assert own.explained.iloc[0] == pytest.approx(values[-c] / np.trace(cov), rel=1e-9)
        assert [int(d) for d in own.deviation] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for v in whole]
        again = out[(out.component == c) & (out.vec_id == 900)]
        assert again.whitened.iloc[0] == own.whitened.iloc[0]
    assert set(out[out.vec_id.isna()].component) == {1, 2, 3, 4}


def test_whitening_of_awkward_vectors(spark):
    empty = whitening.whiten(vectors(spark, []))
    assert empty.count() == 0 and whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # one distinct vector has no direction
    two = whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [0.0]), (3, [0.0, 0.0, 0.0])])).toPandas()  # shorter ones end in zeros
    assert len(two) == 3 and set(two.component) == {1} and set(two.n) == {2} and sorted(two.whitened.round(9)) == [-1.0, -1.0, 1.0]
    big = whitening.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 3.0]), (3, [2.0**60, 1.0])])).toPandas()
    assert np.isfinite(big.whitened).all() and len(big) == 3 and big.deviation.isna().all()  # beyond 38 digits


def test_subspace_iteration_restarts_and_close_values():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(60, 60)))
    e = np.concatenate([[10, 9.99, 9.98, 9.97], np.linspace(9.9, 0, 56)])
    matrix = (q * e) @ q.T
    values, vecs = whitening.leading_components(lambda b: matrix @ b, 60, 4, block=6, most=30)
    assert np.allclose(values, e[:4], atol=1e-10) and np.abs(matrix @ vecs - vecs * values).max() < 1e-9


def plain_print(text):
    words = text.translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """[(doc_id, print)] -> least doc_id that links of two bits at most reach, for each row."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return [(d, f"{p:016x}", least.get(find(p))) for d, p in prints]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("most", [32, 2])
def test_simhash_against_all_pairs(spark, docs, corpus, most):
    want = plain_components([(d, plain_print(t or "")) for d, t, _ in corpus])
    got = simhash.near_components(docs, most=most).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash.near_components(docs.filter("false")).count() == 0


def test_golay_keys_lose_no_link():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 2000)
    for flips in ((0, 0), (3, 3), (1, 20), (7, 22)):
        other = words ^ (1 << flips[0]) ^ (1 << flips[1])
        found = [set(zip(*map(np.ndarray.tolist, simhash.codewords(w)), strict=True)) for w in (words, other)]
        assert {p for p, _ in found[0] & found[1]} == set(range(len(words)))
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for a in range(0, 64, 7):
        for b in range(0, 64, 9):
            other = prints ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))
            found = [set(zip(*map(np.ndarray.tolist, simhash.keys_of(p)), strict=True)) for p in (prints, other)]
            assert {p for p, _ in found[0] & found[1]} == set(range(len(prints)))


def test_dense_groups_meet_in_midpoints(spark):
    """A ball of fingerprints around one: far more of a key than are compared, all in one component; others stay apart."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    ball = {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)} - {base}
    far = {rng.getrandbits(64) for _ in range(500)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(ball | far)]
    prints = spark.createDataFrame(signed, "print long")
    pairs = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(prints).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    parent = {p: p for p in ball | far}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    assert len({find(p) for p in ball}) == 1 and len({find(p) for p in far}) == len(far)


def plain_alignment(own, text):
    if not text:
        return 0, 0, 0, 0, "", Counter()
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    spans = []
    for ids, known in ((a, own.a_bytes), (b, own.b_bytes)):
        parts = [known[i] for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return 0, 0, 0, 0, "", Counter()
        ends = np.cumsum([len(p) for p in parts]).tolist()
        spans.append(list(zip([0, *ends], ends)))
    links = Counter((i, k) for i, (s, e) in zip(a, spans[0]) for k, (t, f) in zip(b, spans[1]) if s < f and t < e)
    groups, x, y = [], 0, 0
    for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        na, nb = sum(e <= end for _, e in spans[0]), sum(e <= end for _, e in spans[1])
        groups.append(",".join(map(str, a[x:na])) + "|" + ",".join(map(str, b[y:nb])))
        x, y = na, nb
    return len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def odd_texts():
    rnd = random.Random(2)
    letters = "abcdeABC  \n\t.,!é ñ日本👍🏽  \x00\x1c▁'s<|endoftext|>0123 ß\r"
    odd = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 40))) for _ in range(300)]
    return [*odd, None, "", "  ", "\n", " a", " a ", "a  b", "<|endoftext|> x", "<s> x </s>", "x " * 300, "é é é", "　 x", "same words here", "same words here"]


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 20])
def test_alignment_against_a_plain_one(spark, most_pairs):
    texts = odd_texts()
    df = spark.createDataFrame([(i if i % 7 else None, t, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, TEXT string, n_a int").repartition(3)
    own = alignment.Aligner(A_PATH, B_PATH)
    plain = [plain_alignment(own, t) for t in texts]
    counts, best = Counter(), {}
    for p in plain:
        counts.update(set(p[5]))
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    want = []
    for i, p in enumerate(plain):
        n_best = sum(k for (a, b), k in p[5].items() if counts[a, b] == best[a])
        want.append((i if i % 7 else None, *p[:4], n_best, sum(k * counts[x] for x, k in p[5].items()), p[4]))
    got = alignment.align_tokenizers(df, A_PATH, B_PATH, most_pairs=most_pairs)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert alignment.align_tokenizers(df.filter("false"), A_PATH, B_PATH).count() == 0


def test_alignment_forgets_and_learns_again():
    own, texts = alignment.Aligner(A_PATH, B_PATH), [t or "" for t in odd_texts()]
    first = own.documents(texts)
    own.known, own.older = {}, own.known
    assert own.documents(texts) == first
    own.known, own.older = {}, {}
    assert [own.documents([t])[0] for t in texts] == first


def test_names_that_differ_by_case(spark, docs):
    """A column like `TEXT` beside `text` is another one, and keeps its place where columns are handed on."""
    from veilframe.llm.best_fit_packing import pack_best_fit
    from veilframe.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
    from veilframe.llm.jaccard_join import link_components
    from veilframe.llm.language_id import keep_identified, predict_languages
    from veilframe.llm.line_dedup import drop_repeated_lines
    from veilframe.llm.pii import mask_personal_data

    few = docs.filter("doc_id between 36 and 46")
    clash = few.select(F.lit("q").alias("TEXT"), *few.columns, F.lit(1).alias("Doc_Id"), F.lit("a").alias("a.b"))
    for run in (exact_duplicates, link_components, predict_languages, drop_repeated_lines, lambda d: pack_best_fit(d, public_tokenizers.path("word_bpe_49k.json"))):
        assert sorted(map(repr, run(clash).collect())) == sorted(map(repr, run(few).collect()))
    for run in (drop_exact_duplicates, keep_identified, mask_personal_data):
        out = run(clash)
        assert out.columns == clash.columns and out.count() == run(few).count() > 0


def test_registered_queries_of_vectors_and_alignment(spark, sf_dir, empty_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.op11_whitening(spark, sf_dir).count() == 60 and queries.op11_whitening(spark, empty_dir).count() == 0
    for query in (queries.op12_simhash, queries.op13_alignment):
        assert query(spark, sf_dir).count() == n and query(spark, empty_dir).count() == 0
