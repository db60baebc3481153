"""Each registered query on the awkward table against a plain version, and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from veilframe.llm.queries import LLM_ORACLES, LLM_QUERIES

NAMES = sorted(LLM_QUERIES, key=lambda n: int(n[2:].split("_")[0]))


def run(spark, n, sf_dir):
    name = next(x for x in NAMES if x.startswith(f"op{n}_"))
    return LLM_QUERIES[name](spark, sf_dir).collect()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def fold(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def key(r):
    return repr(tuple(r))


def test_thirteen_queries():
    assert [int(n[2:].split("_")[0]) for n in NAMES] == list(range(1, 14))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    assert LLM_QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_duckdb_says_the_same(spark, sf_dir, name, corpus):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet/*.parquet'")
    df = LLM_QUERIES[name](spark, sf_dir)
    columns = ", ".join(df.columns)
    assert sorted(map(key, df.collect())) == sorted(map(key, con.sql(f"select {columns} from ({LLM_ORACLES[name]})").fetchall()))


def test_toxicity(spark, sf_dir, corpus):
    rows = run(spark, 1, sf_dir)
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in corpus)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)


def test_language(spark, sf_dir, corpus):
    rows = run(spark, 2, sf_dir)
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in corpus)
    langs = {d: (t, lang) for d, t, lang in corpus if d is not None}
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 4) == 2)
        if r.doc_id is not None:
            t, lang = langs[r.doc_id]
            if not any(c.isalpha() for c in t or ""):
                assert r.lang_pred == "und"
            elif r.doc_id < 40:
                assert r.lang_pred == lang


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, sf_dir, corpus):
    want = sorted((str(d), *(sum(s.startswith(k) for s in base_spans(t or "")) for k in BASE), sha(",".join(base_spans(t or "")))) for d, t, _ in corpus)
    rows = run(spark, 3, sf_dir)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    texts = {d: t for d, t, _ in corpus}
    assert all(set(base_spans(texts[r.doc_id] or "")) <= set(r.spans.split(",")) | {""} for r in rows if r.doc_id is not None)


def word_ids(corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in corpus]


def test_token_store(spark, sf_dir, corpus):
    found = sorted(((d is not None, d or 0), np.array([*ids, 2], "<u4").tobytes()) for (d, _, _), ids in zip(corpus, word_ids(corpus), strict=True))
    rows = sorted(run(spark, 4, sf_dir), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(len(b) // 4 for _, b in found[:-1])]).tolist()
    assert [r.doc_id for r in rows] == [d if known else None for (known, d), _ in found]
    by_id = defaultdict(list)
    for k, b in found:
        by_id[k].append((len(b) // 4, zlib.crc32(b)))
    got = defaultdict(list)
    for r in rows:
        got[(r.doc_id is not None, r.doc_id or 0)].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by_id.items()}


def shingles(t):
    words = (t or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_jaccard_join(spark, sf_dir, corpus):
    sets = [shingles(t) for _, t, _ in corpus]
    root = list(range(len(corpus)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(corpus):
        if d is not None:
            least[find(i)].append(d)
    want = sorted(repr((d, len(sets[i]), (min(least[find(i)]) if least[find(i)] and sets[i] else d))) for i, (d, _, _) in enumerate(corpus))
    assert sorted(key(r) for r in run(spark, 5, sf_dir)) == want


def test_media(spark, sf_dir, corpus):
    want = []
    for d, t, _ in corpus:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append((str(d), len(b), len(p), sha(p), zlib.crc32(p[-64:])))
    rows = run(spark, 6, sf_dir)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)


def test_pieces(spark, sf_dir, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t, _ in corpus:
        ids = sp.encode(t or "")
        want.append((str(d), len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, 7, sf_dir)) == sorted(want)


def test_lines(spark, sf_dir, corpus):
    def line_key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    counts = Counter(k for _, t, _ in corpus for k in {line_key(x) for x in (t or "").split("\n")})
    want = []
    for d, t, _ in corpus:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (line_key(x) and counts[line_key(x)] >= 10)]
        want.append((str(d), len(lines), len(lines) - len(left), sha("\n".join(left))))
    rows = run(spark, 8, sf_dir)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in rows) == sorted(want)
    assert sum(r.n_dropped for r in rows) > 20


def test_packing(spark, sf_dir, corpus):
    rows = run(spark, 10, sf_dir)
    want = []
    for (d, _, _), ids in zip(corpus, word_ids(corpus), strict=True):
        ids = [*ids, 0]
        want += [(str(d), n, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 2
