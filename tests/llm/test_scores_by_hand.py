"""Scores of classifiers, recomputed row by row in plain Python from the model's weights."""

import math
from collections import Counter
from itertools import groupby

import numpy as np

from scatterlake.llm import langid, toxicity

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def words(text):
    return ["".join(g) for letter, g in groupby((text or "").lower(), str.isalpha) if letter]


def slots(word, sizes, bits):
    marked, out = f" {word} ", []
    for n in sizes:
        for i in range(len(marked) - n + 1):
            gram = marked[i : i + n]
            if gram == " ":
                continue
            h = 0
            for c in gram:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & M
            out.append(mix((h + n) & M) >> (64 - bits))
    return out


TEXTS = [None, "", "12 !", "You vile GROBNIK, you!", "été ÉTÉ straße", "日本 語", "ab a\nab", "x" * 5000 + " " + "word " * 3000]


def test_toxicity_scores(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    some = [r["text"] for r in docs.where("doc_id % 20 = 0").collect()] + TEXTS
    table = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    for i, text in enumerate(some):
        found = [s for w in set(words(text)) for s in slots(w, model.config.sizes, model.config.bits)]
        if not found:
            want = model.base
        else:
            z = sum(float(model.margin[s]) for s in found) / len(found) + model.bias
            want = float(model.probability(np.array([z]))[0])
        assert abs(got[i] - want) < 1e-6, (i, text and text[:50])


def test_language_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    some = [r["text"] for r in docs.where("doc_id % 20 = 0").collect()] + TEXTS
    table = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(table, model).collect()}
    for i, text in enumerate(some):
        times = Counter(s for w in words(text) for s in slots(w, model.config.sizes, model.config.bits))
        if not times:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        x = {s: math.log1p(n) * model.idf[s] for s, n in times.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * model.weight[s][k] for s, v in x.items()) + model.bias[k]) / model.temperature for k in range(len(model.langs))]
        p = [math.exp(v - max(z)) for v in z]
        assert got[i]["lang_pred"] == model.langs[p.index(max(p))] and abs(got[i]["score"] - max(p) / sum(p)) < 1e-6


def test_repeated_ids_stay_within_the_bound(spark):
    rows = [(1, "you idiot", "en")] * 50 + [(i, "a quiet day" if i % 2 else "der Hund", "en" if i % 2 else "de") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.ToxicityConfig(max_toxic=4, max_clean=10))
    assert abs(model.base - 4 / 14) < 1e-9
    assert langid.fit(docs, langid.LangConfig(max_rows=5)).langs == ("de", "en")


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, "you idiot moron" if i % 2 else "a good day", "en", 1.5, 7, "k") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, score double, toxic int, slot string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id int, toxic int")
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and {r["doc_id"] % 2 for r in kept.collect()} == {0}
    assert langid.predict(docs, langid.fit(docs)).count() == 90
