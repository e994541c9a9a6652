"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams are of code points, within words whose boundaries are marked. Document
frequencies are counted over every document of the open folds; the classifier is
trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties on whole texts of a bounded sample per language, and its temperature is
then calibrated on a part of the sample that training did not see. Executors
count the n-grams of the sample and one task trains, so the driver gets the
weights only. Prediction reads whole texts in one pass.

Defined cases: null text, or text without any letter, is ``und`` with score 0;
rows without language or document id are never learned from but are predicted;
repeated rows are predicted each, and rows that share a sampled id are learned
from up to the bound; very long texts are one piece of their own and never cut;
ties go to the first language by name; other columns are ignored; without any
training row everything is ``und``; more than ``max_langs`` languages raise
``ValueError`` (a column that is not a language).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fold, materialize, read_table, small_batches, written
from .subword import words_of

UNDETERMINED = "und"
_TOGETHER = 32  # documents whose histograms are dense at the same time


@dataclass(frozen=True)
class LangConfig:
    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    epochs: int = 3
    #: Most rows of one language that training reads (the documented bound), and most languages.
    max_rows: int = 1500
    max_langs: int = 500
    seed: int = 11


@dataclass(frozen=True)
class Counts:
    """Slots of documents and how often each has them, document by document."""

    docs: int
    doc: np.ndarray
    slot: np.ndarray
    times: np.ndarray


def counts_of(texts: list[str | None], config: LangConfig) -> Iterator[Counts]:
    """Histograms of the n-grams of texts, a few documents at a time."""
    size = 1 << config.bits
    for w in words_of(texts, config.sizes, config.bits):
        pair, slots = w.pair_slots()
        doc, times = w.doc[pair], w.count[pair]
        for lo in range(0, w.docs, _TOGETHER):
            n = min(_TOGETHER, w.docs - lo)
            here = slice(*np.searchsorted(doc, [lo, lo + n]))
            dense = np.bincount((doc[here] - lo) << config.bits | slots[here], times[here], n * size)
            at = np.flatnonzero(dense)
            yield Counts(n, at >> config.bits, at & (size - 1), dense[at].astype(np.int64))


@dataclass(frozen=True)
class LangModel:
    config: LangConfig
    langs: tuple[str, ...]
    idf: np.ndarray
    weight: np.ndarray  # slots x languages, zero where the penalty removed a feature
    bias: np.ndarray
    temperature: float

    def logits(self, c: Counts) -> np.ndarray:
        """Documents x languages: TF-IDF vectors of length one times the weights."""
        x = np.log1p(c.times) * self.idf[c.slot]
        norm = np.sqrt(np.bincount(c.doc, x * x, c.docs))
        x = x / norm[c.doc]
        out = np.zeros((c.docs, len(self.langs)))
        some = np.unique(c.doc)
        if len(some):
            out[some] = np.add.reduceat(x[:, None] * self.weight[c.slot], np.searchsorted(c.doc, some), axis=0)
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The best language of each text (ties: the first by name) and its calibrated probability."""
        names, score = [], []
        for c in counts_of(texts, self.config):
            p = softmax(self.logits(c) / self.temperature)
            some = np.bincount(c.doc, minlength=c.docs) > 0
            names += [self.langs[b] if s else UNDETERMINED for b, s in zip(p.argmax(axis=1), some, strict=True)]
            score.append(np.where(some, p.max(axis=1), 0.0))
        return names, np.concatenate(score) if score else np.zeros(0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, config: LangConfig = LangConfig()) -> tuple[int, np.ndarray]:
    """Number of documents and, per slot, of documents that have it; one row per slot reaches the driver."""
    small_batches(docs.sparkSession)

    def run(batches):
        df, n = np.zeros(1 << config.bits, np.int64), 0
        for batch in batches:
            for c in counts_of(batch.column("text").to_pylist(), config):
                df += np.bincount(c.slot, minlength=len(df))
                n += c.docs
        at = np.flatnonzero(df)
        yield pa.record_batch({"slot": pa.array(np.append(at, -1)), "n": pa.array(np.append(df[at], n))})

    rows = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy()
    df = np.zeros(1 << config.bits, np.int64)
    df[slot[slot >= 0]] = n[slot >= 0]
    return int(n[slot < 0].sum()), df


Bag = tuple[np.ndarray, np.ndarray]  # slots, and how often


def train(bags: list[Bag], langs: list[str], n_docs: int, df: np.ndarray, config: LangConfig = LangConfig()) -> LangModel:
    """FTRL-proximal over the sample, then a temperature from every fifth row of it."""
    names = tuple(sorted(set(langs)))
    size, k = 1 << config.bits, max(1, len(names))
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    if len(names) < 2:
        return LangModel(config, names or (UNDETERMINED,), idf, np.zeros((size, k)), np.zeros(k), 1.0)
    rows = []
    for at, times in bags:
        x = np.log1p(times) * idf[at]
        rows.append((at, x / max(1e-12, np.sqrt((x * x).sum()))))
    y = np.array([names.index(x) for x in langs])
    order = np.random.default_rng(config.seed).permutation(len(y))
    held, used = order[::5], np.setdiff1d(order, order[::5])
    z, n = np.zeros((size, k)), np.zeros((size, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(zz, nn, l1):
        w = -(zz - np.sign(zz) * l1) / ((config.beta + np.sqrt(nn)) / config.alpha + config.l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for epoch in range(config.epochs):
        for i in np.random.default_rng(config.seed + epoch).permutation(used):
            at, x = rows[i]
            w, wb = weights(z[at], n[at], config.l1), weights(zb, nb, 0.0)
            p = softmax(x @ w + wb)
            p[y[i]] -= 1
            g = x[:, None] * p
            sq = g * g
            z[at] += g - (np.sqrt(n[at] + sq) - np.sqrt(n[at])) / config.alpha * w
            n[at] += sq
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / config.alpha * wb
            nb += p * p
    weight, bias = weights(z, n, config.l1), weights(zb, nb, 0.0)
    logits = np.stack([x @ weight[at] + bias for at, x in (rows[i] for i in held)])
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 120))
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    return LangModel(config, names, idf, weight, bias, float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, config: LangConfig = LangConfig()) -> LangModel:
    """Learn from documents of open folds that have a language; the sample is bounded per language."""
    spark = docs.sparkSession
    open_docs = docs.where("doc_id is not null and lang is not null").where(fold("doc_id", 4) != 2)
    open_docs = open_docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    n_docs, df = document_frequencies(open_docs, config)
    langs = [r["lang"] for r in open_docs.groupBy("lang").count().orderBy("lang").limit(config.max_langs + 1).collect()]
    if len(langs) > config.max_langs:
        raise ValueError(f"more than {config.max_langs} languages")
    if not langs:
        return train([], [], 0, df, config)

    def drawn(rows, *order):
        # each task keeps the first rows of a language before they are shuffled
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
        return rows.withColumn("rank", rank).where(F.col("rank") <= config.max_rows).drop("rank")

    before = written()
    ids = drawn(open_docs.select("doc_id", "lang"), F.xxhash64("doc_id"), "doc_id").select("doc_id").distinct()
    texts = materialize(open_docs.join(F.broadcast(ids), "doc_id", "left_semi"), "langid-texts")
    most = texts.groupBy("lang").count().agg(F.max("count")).first()[0]
    if most > config.max_rows:  # ids that several rows share
        texts = materialize(drawn(texts, F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")), "langid-texts")
    small_batches(spark)

    def bags(batches):
        for batch in batches:
            out = []
            for c in counts_of(batch.column("text").to_pylist(), config):
                edge = np.searchsorted(c.doc, np.arange(c.docs + 1))
                out += [(c.slot[a:b].astype(np.int32).tobytes(), c.times[a:b].astype(np.int32).tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "lang": batch.column("lang"),
                "slots": pa.array([s for s, _ in out], pa.binary()), "times": pa.array([t for _, t in out], pa.binary()),
            })

    def learn(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "slots", "times")), strict=True)
        rows.sort()
        m = train([(np.frombuffer(s, np.int32), np.frombuffer(t, np.int32)) for _, _, s, t in rows], [r[0] for r in rows], n_docs, df, config)
        yield pa.record_batch({
            "langs": pa.array([list(m.langs)], pa.list_(pa.string())), "weight": pa.array([m.weight.tobytes()], pa.binary()),
            "bias": pa.array([m.bias.tobytes()], pa.binary()), "temperature": pa.array([m.temperature]),
        })

    packed = texts.mapInArrow(bags, "doc_id long, lang string, slots binary, times binary").repartition(1)
    got = packed.mapInArrow(learn, "langs array<string>, weight binary, bias binary, temperature double").first()
    discard(spark, [x for x in written() if x not in before])
    k, idf = len(got["langs"]), np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    return LangModel(config, tuple(got["langs"]), idf, np.frombuffer(got["weight"]).reshape(-1, k), np.frombuffer(got["bias"]), got["temperature"])


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, score = shared.value.predict(batch.column("text").to_pylist())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def langid_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
