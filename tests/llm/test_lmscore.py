import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scatterlake.llm.eliasfano import STEPS, BigramTrie, EliasFano, probability, quantise
from scatterlake.llm.lmscore import LMConfig, dealt, lm_scores

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, prior=20.0):
    docs = []
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        docs.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [*WORD.findall(low), 0]))
    uni, bi, ctx = Counter(), Counter(), Counter()
    for _, held, toks in docs:
        if not held:
            uni.update(toks)
            for h, w in zip([1, *toks], toks):
                bi[h, w] += 1
                ctx[h] += 1
    n, v = sum(uni.values()), len(uni)
    once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = once / (once + 2 * twice) if once else 0.5
    out = []
    for i, held, toks in docs:
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in toks)
        score = 0.0
        for h, w in zip([1, *toks], toks):
            one = (uni[w] - d) / n if uni[w] else d * v / n
            a = bi[h, w] / (ctx[h] + prior)
            a = 10 ** (-round(-math.log10(a) * STEPS) / STEPS) if a else 0.0
            score += math.log10(min(1.0, a + prior / (ctx[h] + prior) * one))
        out.append((i, held, len(toks), sum(uni[w] > 0 for w in toks), n, base, score))
    return out


def compare(spark, rows, config):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in lm_scores(df, config).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-3, abs=0.02)


def test_equal_to_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, " \n"), (-4, "THE the tHe"), (-4, "THE the tHe"), (None, "the of")]
    compare(spark, rows, LMConfig())
    compare(spark, rows[:80] + rows[-6:], LMConfig(block_tokens=3000, shard_entries=2000, split=50))


def test_more_shards_than_entries(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "b c a", None, "A b", "d", "a b a b c", "e f g a", ""])]
    compare(spark, rows, LMConfig(block_tokens=5, shard_entries=1, split=1))


def test_entries_are_dealt_to_the_shards_that_occur():
    assert dealt(np.zeros(0, np.int64)) == []
    place = np.random.default_rng(3).integers(0, 10**6, 500) // 5000 * 7
    got = dealt(place)
    assert [i for i, _ in got] == sorted(set(place.tolist()))
    for i, at in got:
        assert at.tolist() == np.flatnonzero(place == i).tolist()


def test_held_out_text_is_likelier_than_under_the_base(spark):
    rows = lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string, block int")).count() == 0


def test_elias_fano_successor_search():
    rng = np.random.default_rng(1)
    for values in (np.array([0]), np.array([5, 5, 5]), np.sort(rng.integers(0, 10**12, 3000)), np.arange(100), np.sort(rng.integers(0, 50, 400))):
        ef = EliasFano.of(values)
        assert ef.get(np.arange(len(values))).tolist() == values.tolist()
        asked = np.concatenate([values, values + 1, np.maximum(values, 1) - 1, [0, 10**13]])
        at, equal = ef.successor(asked)
        assert at.tolist() == np.searchsorted(values, asked).tolist()
        assert equal.tolist() == np.isin(asked, values).tolist()


def test_trie_answers_from_a_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 900), rng.integers(0, 500, 900))})
    p = rng.uniform(1e-6, 1, len(pairs))
    context, successor = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    path = tmp_path / "levels.trie"
    path.write_bytes(BigramTrie.layout_of(context, successor, p))
    trie = BigramTrie.mapped(str(path))
    assert trie.codes_of(context, successor).tolist() == quantise(p).tolist()
    grid = np.array([(a, b) for a in range(62) for b in range(502)])
    codes = trie.codes_of(grid[:, 0], grid[:, 1])
    assert {tuple(x) for x in grid[codes > 0]} == set(pairs)
    assert np.abs(np.log10(probability(quantise(p))) - np.log10(p)).max() < 1 / STEPS
    for c in (0, 7, 61):
        assert trie.successors_of(c).tolist() == [b for a, b in pairs if a == c]
