import random
import re

import corpus_pipeline
import pytest
from scatterlake.llm.jaccard import JaccardConfig, heavy_rows, jaccard_groups, signatures

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, c):
    """Component of each id: all pairs of documents that share a shingle, or of equal sets."""
    sets = {i: shingles(t, c.words) for i, t in rows}
    parent, by_item = {i: i for i in sets}, {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        for j in {j for item in sets[i] for j in by_item.get(item, [])}:
            a, b = sets[i], sets[j]
            if c.den * len(a & b) >= c.num * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
        for item in sets[i]:
            by_item.setdefault(item, []).append(i)
    return {i: root(i) for i in sets}


def families():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two")]
    for k in range(260):
        n = rng.choice([3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 33, 47, 70, 120, 300]) + 4
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                where = rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])
                if rng.random() < 0.5:
                    copy[where] = rng.choice(vocabulary)
                else:
                    del copy[where]
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    rows = families()
    groups = brute(rows, JaccardConfig(words=5, num=4, den=5))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == set(groups.values())
    assert len(set(groups.values())) < len(set(brute(rows, JaccardConfig()).values()))


@pytest.mark.parametrize("num, den", [(4, 5), (1, 2), (2, 3), (9, 10)])
def test_groups_at_other_thresholds(spark, num, den):
    rows, config = families(), JaccardConfig(words=5, num=num, den=den)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()}
    assert got == brute(rows, config)


def test_linked_sets_share_a_list_without_most_empty_blocks():
    import numpy as np

    rng, c, short = np.random.default_rng(3), JaccardConfig(words=5, num=4, den=5), 0
    for _ in range(4000):
        n = int(rng.integers(4, 130))
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone = int(rng.integers(0, c.difference(2 * n) + 1))
        a, b = np.unique(both[gone // 2 :]), np.unique(both[: n - (gone - gone // 2)])
        same = len(np.intersect1d(a, b))
        if c.den * same >= c.num * (len(a) + len(b) - same) and not (a.shape == b.shape and (a == b).all()):
            x, y = signatures(a, 0, c), signatures(b, 0, c)
            assert len(np.intersect1d(x, y))
            short += len(x) < sum(k for _, k in heavy_rows(len(a), c))
    assert short


def test_sketches_of_large_sets_rule_out_others_but_no_linked_pair():
    import numpy as np
    from scatterlake.llm.jaccard import may_link, parity_sketch, possible_pairs

    rng, c = np.random.default_rng(5), JaccardConfig(words=5, num=4, den=5)
    for n in (30, 1500, 2040, 9000):
        base = np.unique(rng.integers(0, 2**63, n + n // 9, dtype=np.uint64))
        sets = [rng.permutation(base)[:n] for _ in range(3)] + [rng.permutation(base)[: n + n // 9], rng.integers(0, 2**63, n, dtype=np.uint64)]
        sketches, size = [parity_sketch(s) for s in sets], np.array([len(s) for s in sets])
        found = set(zip(*(x.tolist() for x in possible_pairs(sketches, size, np.arange(5), c)), strict=True))
        for i in range(5):
            for j in range(i + 1, 5):
                same = len(np.intersect1d(sets[i], sets[j]))
                linked = c.den * same >= c.num * (size[i] + size[j] - same)
                assert not linked or (i, j) in found and may_link(sketches[i], sketches[j], int(size[i]), int(size[j]), c)
                assert j < 4 or (i, j) not in found
