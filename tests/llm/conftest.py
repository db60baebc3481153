"""A small table of documents with the awkward cases, and plain versions of what the operators compute."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, sha string, suspect boolean, kept boolean, row string, body string"

EN = "the and that with from this thing reading other water under being these which their would could should about".split()
FR = "le les des une avec pour dans sur est qui que leur nous vous cette être même après entre toujours".split()


def text(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def corpus():
    """[(doc_id, text, lang)]: null and repeated ids, null and empty texts, copies, near copies, long and odd texts."""
    rnd = random.Random(11)
    rows = []
    for i in range(40):
        fr = i % 3 == 0
        rows.append([i, text(rnd, FR if fr else EN, rnd.randrange(4, 90)), "fr" if fr else "en"])
    base = text(rnd, [f"w{k}" for k in range(400)], 120)
    words = base.split()
    for i in range(40, 52):  # near copies: one or two words changed
        own = list(words)
        for _ in range(2 if i % 4 == 3 else 1):
            own[rnd.randrange(len(own))] = f"x{i}"
        rows.append([i, " ".join(own), "en"])
    rows += [[60, rows[3][1], "fr"], [61, rows[3][1], "fr"], [62, rows[5][1].upper(), "en"], [5, rows[5][1], "en"], [5, rows[5][1], "en"]]
    rows += [[70, None, None], [71, "", "en"], [72, "  \n\t ", None], [73, "12345 !!!", None], [74, "a", "en"], [None, "no id here at all today", "en"], [None, rows[7][1], "en"]]
    rows += [[80, "Same line here\nOther " + str(k) + "\n  SAME LINE HERE \n\nend", "en"] for k in range(1)]
    rows += [[81 + k, f"same line here\nown line {k}\r\nsame LINE here\t", "en"] for k in range(14)]
    rows += [[100, "word " * 30000, "en"], [101, "日本語 テスト 👍🏽 é ﬁ Å\x00\x01 <|endoftext|> ▁ x", "en"], [102, "x" * 50000, "en"]]
    rows += [[110, "mail me at jo.doe+x@mail.example.com, or 10.0.0.255 and 300.1.1.1", "en"], [111, "card 4111 1111 1111 1111 or 4111-1111-1111-1112; call +1 (555) 555-0100 now 👍 +1 (555) 555-0101", "en"]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with the operators' own."""
    data = [(d, t, l, "s", None if t is None else len(t), 1, "sha", True, None, "row", "body") for d, t, l in corpus]
    return spark.createDataFrame(data, DOCS).repartition(3)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    rows = [(i, [float(i % 5), float(i % 3), 1.5]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    labels = [(d, 1, d % 2) for d in range(52)] + [(3, 1, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    docs.filter("false").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
