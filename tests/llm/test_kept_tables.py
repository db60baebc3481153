"""What the Jaccard join leaves behind for its result."""

import os
import random


def test_no_shingles_are_left(spark, tmp_path, monkeypatch):
    """When the components are known, only tables without shingles remain: one of the documents, and one of the sets."""
    import pyarrow.parquet as pq

    from veilframe.llm.jaccard_join import link_components
    from veilframe.sources import store

    folders, kept_folder = [], store.kept_folder
    monkeypatch.setattr(store, "kept_folder", lambda *a: folders.append(path := kept_folder(*a)) or path)
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join([*words[: 50 - i % 3], str(i % 5)])) for i in range(40)] + [(100 + i, " ".join(str(rnd.random()) for _ in range(20))) for i in range(20)] + [(200, None), (201, "")]
    out = link_components(spark.createDataFrame(rows, "doc_id long, text string"))
    left = [f for f in (p.removeprefix("file:") for p in folders) if os.path.isdir(f)]
    columns = sorted(sorted(pq.ParquetDataset(f).schema.names) for f in left)
    assert columns == [["component_id", "set_id"], ["doc_id", "key", "n", "set_id"]]
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert len(got) == 62 and {got[i] for i in range(40)} == {0} and all(got[i] == i for i in (*range(100, 120), 200, 201))
