"""The lists that two classes share are found without sorting on disk, and whole sets are made for verified pairs only."""

from collections import defaultdict

import numpy as np

from scatterlake.llm import jaccard
from scatterlake.llm.jaccard import JaccardConfig, jaccard_groups, shared


def test_rows_of_shared_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(k)) for s, k in zip(rng.integers(-400, 400, 900), rng.integers(-5, 5, 900), strict=True)]
    rows += [(7, k) for k in range(600)] + [(9, 1)] * 50  # a long list, and one class over and over
    lists = spark.createDataFrame(rows, "sig long, k1 long").repartition(4)
    classes = defaultdict(set)
    for s, k in rows:
        classes[s].add(k)
    want = sorted((s, k) for s, ks in classes.items() if len(ks) > 1 for k in ks)
    for held in (1, 100, 1 << 19):
        monkeypatch.setattr(jaccard, "LIST_ROWS", held)
        for tasks in (1, 5):
            assert sorted(map(tuple, shared(lists, tasks).collect())) == want


def test_no_sort_of_all_lists_and_no_table_of_all_sets(spark, monkeypatch):
    """Every document shares a passage with another one, but only two of them are near copies."""
    body = [" ".join(f"w{d}x{i}" for i in range(200)) for d in range(12)]
    texts = [f"{t} " + " ".join(f"p{d // 2}y{i}" for i in range(60)) for d, t in enumerate(body)]
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, plans, write = {}, [], jaccard.materialize

    def noted(df, tag):
        plans.append(df._jdf.queryExecution().toString())
        out = write(df, tag)
        rows[tag] = max(rows.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", noted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(docs, JaccardConfig(words=5, num=4, den=5)).collect()}
    assert got == {d: 0 if d == 12 else d for d in range(13)}
    assert rows["jaccard-sketches"] > 4 and rows["jaccard-sets"] == 2
    assert not any("Window" in p for p in plans)
