import hashlib
import random
from collections import Counter

import numpy as np

from scatterlake.llm.bwt import Shard, merge, positions, transform
from scatterlake.llm.substrings import RepeatConfig, dealt_further, digests, remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        stay = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(stay).hexdigest()))
    return out


def compare(spark, texts, config):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in digests(df, config).collect()}
    want = brute(texts, config.length)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i] and texts[i][:80], got[i], w)


def corpus(rng, length):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(200)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [prose(rng.randint(length // 6, length)) for _ in range(6)]
    texts = [None, "", "x", "a" * (length - 1), "a" * length, "a" * (length + 1), "ab" * length, "Und " * length, prose(2000)]
    texts += [passages[0]] * 5 + [passages[1] + "!", "?" + passages[1]]
    for _ in range(60):
        text = prose(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            text += rng.choice(["", " "]) + p[a : len(p) - rng.randint(0, len(p) // 3)] + prose(rng.randint(0, 30))
        texts.append(text)
    texts.append(texts[-1][3:] + "zz" + texts[-2][:-5])
    return texts


def test_equal_to_brute_force(spark):
    rng = random.Random(1)
    for length in (64, 100):
        compare(spark, corpus(rng, length), RepeatConfig(length=length, phrase=8, shard_bytes=4000, bucket_bytes=20_000))
    compare(spark, corpus(rng, 400), RepeatConfig(shard_bytes=50_000))


def test_crowded_grams_are_dealt_further(spark):
    compare(spark, corpus(random.Random(2), 64), RepeatConfig(length=64, crowd=2))
    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh") for _ in range(50))
    texts = ["".join(rng.choice("xyz ") for _ in range(rng.randint(20, 40))) + common + "".join(rng.choice("uvw") for _ in range(rng.randint(20, 40))) for _ in range(80)]
    texts += [texts[3][:85], texts[4][10:], texts[5], "q" + texts[5]]
    config = RepeatConfig(length=64, crowd=5, bucket_bytes=2000)
    compare(spark, texts, config)


def test_ranges_of_offsets_hold_every_window_once():
    config = RepeatConfig(length=64)
    segment = bytes(random.Random(3).choices(range(97, 123), k=64 + 25))
    for lead in (25, 31, 32):
        for width in config.widths():
            seen = []
            for _, first, length, at in dealt_further(5, segment, lead, width, config):
                assert at + first == lead and 0 <= first and first + length <= len(segment)
                seen += range(first, first + length - 64 + 1)
            assert seen and sorted(seen) == list(range(26))


def test_whole_table(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    compare(spark, texts, RepeatConfig())


def test_merge_equals_sorting_all_rotations():
    rng = np.random.default_rng(3)
    strings = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)]
    depth = 12
    shards = []
    for part in (strings[:13], strings[13:20], strings[20:]):
        starts = np.concatenate([[0], np.cumsum([len(s) for s in part])])
        shards.append(Shard(np.concatenate(part).astype(np.int32), starts, depth))
    rotations = [tuple(np.resize(np.roll(s, -i), depth)) for s in strings for i in range(len(s))]
    before = [s[i - 1] for s in strings for i in range(len(s))]
    for k, (source, block) in enumerate(merge(shards, depth), start=1):
        at = positions(shards, source)
        keys = [rotations[i][:k] for i in at]
        assert keys == sorted(keys)
        assert [a == b for a, b in zip(keys, keys[1:])] == (np.diff(block) == 0).tolist()
    assert transform(shards, source).tolist() == [before[i] for i in at]


def test_texts_without_repeats_and_clashing_names(spark):
    rows = [("a" * 30, 1, 2, 3), (None, 4, 5, 6)]
    df = spark.createDataFrame(rows, "text string, key_0 int, ranges_0 int, _ranges int")
    assert sorted(map(tuple, remove_repeats(df, RepeatConfig(length=40)).collect()), key=str) == sorted(rows, key=str)


def test_texts_without_repeats_and_other_columns(spark):
    passage = "".join(random.Random(5).choice("abcdefgh é") for _ in range(500))
    rows = [(1, "x" + passage + "y", "k", 1), (2, "z" + passage, "k", 2), (None, "short", "k", 3), (4, None, "k", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ranges int")
    got = {r["ranges"]: r for r in remove_repeats(df).collect()}
    assert (got[1]["text"], got[2]["text"], got[3]["text"], got[4]["text"]) == ("xy", "z", "short", None)
    assert got[1]["key"] == "k" and digests(df.limit(0)).count() == 0
