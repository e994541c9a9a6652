"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A document is the average of the embeddings of the hashed character n-grams of
its words (word boundaries marked, rare n-grams weighted up, each distinct word
counted once, so that a long text does not drown a word), classified by a linear
softmax; embeddings and softmax are trained jointly in numpy, so misspellings
share n-gram vectors with the words they come from. Every slot that ``min_docs``
training documents have gets an embedding; the others keep a zero vector.

Training takes a bounded sample of the labelled rows (``max_toxic`` and
``max_clean``, drawn by hash) and whole texts of these. Executors count the
documents of each slot and turn texts into bags; one task trains and returns
only the folded model, so neither texts nor bags reach the driver. Five models
that leave out a fifth of the rows each are averaged (they are linear), and the
logits of what each left out calibrate the scores (isotonic regression). Scoring is one pass over whole texts in which the embeddings are
folded with the softmax weights to one number per n-gram slot.

Defined cases: null or empty text, or one without any letter, scores the
training base rate; a null document id is scored and never trained on; repeated
rows are scored each, and rows that share a sampled id are trained on up to the
bounds; very long texts are one piece of their own and never cut; with no labels
of one class every score is the base rate (0.0 without any label); other columns
are ignored, or kept as they are by :func:`keep_clean`; a score of exactly the
threshold is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, materialize, read_table, small_batches, written
from .subword import words_of


@dataclass(frozen=True)
class ToxicityConfig:
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 19
    dim: int = 8
    #: Texts that training of one model looks at, over all epochs, and the bounds of the number of epochs.
    looks: int = 20_000
    epochs: tuple[int, int] = (3, 200)
    rate: float = 1.0
    #: Averages of thousands of n-grams are short vectors: they are stretched by this.
    stretch: float = 200.0
    batch: int = 64
    #: Squared length of a vector from which on its steps shrink.
    longest: float = 256.0
    min_docs: int = 3
    #: Models that are averaged; each leaves out one part of the rows, on which it is calibrated.
    parts: int = 5
    #: Most labelled rows of a class that training reads (the documented bound).
    max_toxic: int = 3000
    max_clean: int = 6000
    threshold: float = 0.7
    seed: int = 7


Bag = tuple[np.ndarray, np.ndarray]  # distinct slots, and their shares of all n-grams


@dataclass(frozen=True)
class ToxicityModel:
    config: ToxicityConfig
    margin: np.ndarray  # per slot: embedding folded with the softmax weights
    bias: float
    base: float  # share of label 1 in training
    knots: tuple[np.ndarray, np.ndarray] | None = None  # of the calibration curve

    def probability(self, z: np.ndarray) -> np.ndarray:
        """The calibrated probability of logits; a twentieth stays logistic, which keeps their order."""
        plain = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
        return plain if self.knots is None else 0.95 * np.interp(z, *self.knots) + 0.05 * plain

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each text."""
        out = []
        for w in words_of(texts, self.config.sizes, self.config.bits):
            upto = np.zeros(len(w.slots) + 1)
            np.cumsum(self.margin[w.slots], dtype=np.float64, out=upto[1:])
            total = np.bincount(w.doc, np.diff(upto[w.first])[w.word], w.docs)
            n = np.bincount(w.doc, np.diff(w.first)[w.word], w.docs)
            out.append(np.where(n > 0, self.probability(total / np.maximum(n, 1) + self.bias), self.base))
        return np.concatenate(out) if out else np.zeros(0)


def bags_of(texts: list[str | None], config: ToxicityConfig) -> Iterator[Bag]:
    """The bag of each text: an n-gram counts once for each distinct word that has it."""
    for w in words_of(texts, config.sizes, config.bits):
        pair, slots = w.pair_slots()
        key, times = np.unique((w.doc[pair] << config.bits) | slots, return_counts=True)
        edge = np.searchsorted(key, np.arange(w.docs + 1) << config.bits)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            part = times[lo:hi]
            yield (key[lo:hi] & ((1 << config.bits) - 1)).astype(np.int32), (part / max(1, part.sum())).astype(np.float32)


def constant(rate: float, config: ToxicityConfig) -> ToxicityModel:
    """The model of labels of one class, or of none."""
    return ToxicityModel(config, np.zeros(1 << config.bits, np.float32), -60.0 if rate == 0 else 60.0, rate)


def train(texts: list[str | None], labels: list[int], config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Training on texts that are at hand."""
    return train_bags(list(bags_of(texts, config)), np.asarray(labels, dtype=np.int64), config)


def train_bags(bags: list[Bag], y: np.ndarray, config: ToxicityConfig) -> ToxicityModel:
    """The mean of models that leave out one part each, calibrated on what each left out. ``bags`` is overwritten."""
    rate = float(y.mean()) if len(y) else 0.0
    if rate in (0.0, 1.0):
        return constant(rate, config)
    seen = np.bincount(np.concatenate([s for s, _ in bags]), minlength=1 << config.bits)
    kept = np.flatnonzero(seen >= min(config.min_docs, max(1, len(y) // 50)))
    place = np.full(1 << config.bits, -1, np.int32)
    place[kept] = np.arange(len(kept))
    weight = (config.stretch * (np.log(len(y) / seen[kept]) + 0.01)).astype(np.float32)
    for i, (s, x) in enumerate(bags):  # in place: the bags are most of the memory
        at = place[s]
        bags[i] = (at[at >= 0], x[at >= 0] * weight[at[at >= 0]])
    part, all_rows = np.random.default_rng(config.seed).permutation(len(y)) % config.parts, np.arange(len(y))
    knots = None
    if all(min((y[part != k] == 1).sum(), (y[part != k] == 0).sum()) > 4 for k in range(config.parts)):
        apart, models = np.zeros(len(y)), []
        for k in range(config.parts):
            margin, bias = _joint(bags, y, all_rows[part != k], len(kept), config)
            apart[part == k] = [margin[s] @ x + bias for s, x in (bags[i] for i in all_rows[part == k])]
            models.append((margin, bias))
        margin, bias = sum(m for m, _ in models) / len(models), sum(b for _, b in models) / len(models)
        knots = calibration(apart, y)
    else:
        margin, bias = _joint(bags, y, all_rows, len(kept), config)
    folded = np.zeros(1 << config.bits, np.float32)
    folded[kept] = margin * weight
    return ToxicityModel(config, folded, bias, rate, knots)


def _joint(bags: list[Bag], y: np.ndarray, rows: np.ndarray, size: int, config: ToxicityConfig) -> tuple[np.ndarray, float]:
    """Embeddings and softmax by stochastic gradients; returned folded to a margin per slot, and the bias."""
    rng = np.random.default_rng(config.seed)
    emb = np.zeros((size, config.dim), np.float32)
    weight = rng.normal(0, config.dim**-0.5, (config.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    least, most = config.epochs
    batches = [_block(bags, x) for x in np.array_split(rng.permutation(rows), -(-len(rows) // config.batch))]
    epochs = min(most, max(least, config.looks // len(rows)))
    steps, step = epochs * len(batches), 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            chosen, here, cells, values = batches[k]
            x = np.zeros((len(chosen), len(here)), np.float32)
            x.ravel()[cells] = values
            own = emb[here]
            hidden = x @ own
            z = hidden @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            # one step moves a short text, whose vector is long, no further than others
            p *= np.minimum(1, config.longest / np.maximum(1e-9, np.einsum("ij,ij->i", x, x)))[:, None] / len(chosen)
            rate = config.rate * (1 - step / steps)
            step += 1
            emb[here] = own - rate * (x.T @ (p @ weight.T))
            weight -= 0.1 * rate * (hidden.T @ p)
            bias -= 0.1 * rate * p.sum(axis=0)
    return emb @ (weight[:, 1] - weight[:, 0]), float(bias[1] - bias[0])


def _block(bags: list[Bag], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bags of some rows as the cells of a dense matrix over the slots that they have."""
    here, column = np.unique(np.concatenate([bags[i][0] for i in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
    return rows, here, (owner * len(here) + column).astype(np.int32), np.concatenate([bags[i][1] for i in rows])


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (logit, probability) of a rising curve: pooled adjacent violators, each block's rate drawn to the base rate by one row."""
    order = np.argsort(z, kind="stable")
    base, blocks = float(y.mean()), []  # [rows, ones, sum of logits]
    for value, one in zip(z[order], y[order], strict=True):
        blocks.append([1, int(one), float(value)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, ones, total = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + ones, blocks[-1][2] + total]
    n, ones, total = (np.array(x, float) for x in zip(*blocks, strict=True))
    return total / n, np.maximum.accumulate((ones + base) / (n + 1))


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Train on labelled rows whose id fold is open, in one task; only the folded model reaches the driver."""
    spark, size = docs.sparkSession, 1 << config.bits
    clean = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = clean.where(fold("doc_id", 3) != 1)
    most = {1: config.max_toxic, 0: config.max_clean}
    sample = rows.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[1]).unionByName(
        rows.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[0])
    )
    before = written()
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = materialize(found.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text"), "toxicity-texts")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if any(n.get(k, 0) > most[k] for k in most):  # ids that several rows share
        bound = [texts.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(m) for k, m in most.items()]
        texts = materialize(bound[0].unionByName(bound[1]), "toxicity-texts")
    least = min(config.min_docs, max(1, sum(min(n.get(k, 0), m) for k, m in most.items()) // 50))
    small_batches(spark)

    def count(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for slots, _ in bags_of(batch.column("text").to_pylist(), config):
                seen[slots] += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch({"slot": pa.array(at), "n": pa.array(seen[at])})

    often = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    kept = spark.sparkContext.broadcast(np.sort(often.select("slot").toArrow().column("slot").to_numpy()))

    def bags(batches):
        ok = np.zeros(size, bool)
        ok[kept.value] = True
        for batch in batches:
            out = [(s[ok[s]], x[ok[s]]) for s, x in bags_of(batch.column("text").to_pylist(), config)]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"),
                "slots": pa.array([s.tobytes() for s, _ in out], pa.binary()), "shares": pa.array([x.tobytes() for _, x in out], pa.binary()),
            })

    def learn(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "slots", "shares")), strict=True)
        rows.sort()
        y = np.array([r[1] for r in rows], np.int64)
        bags = [(np.frombuffer(s, np.int32), np.frombuffer(x, np.float32)) for _, _, s, x in rows]
        rows.clear()
        model = train_bags(bags, y, config)
        yield pa.record_batch({
            "margin": pa.array([model.margin.tobytes()], pa.binary()), "bias": pa.array([model.bias]), "base": pa.array([model.base]),
            "logit": pa.array([[] if model.knots is None else model.knots[0]], pa.list_(pa.float64())), "rate": pa.array([[] if model.knots is None else model.knots[1]], pa.list_(pa.float64())),
        })

    packed = texts.mapInArrow(bags, "doc_id long, toxic int, slots binary, shares binary").repartition(1)
    got = packed.mapInArrow(learn, "margin binary, bias double, base double, logit array<double>, rate array<double>").first()
    kept.destroy()
    discard(spark, [x for x in written() if x not in before])
    knots = (np.array(got["logit"]), np.array(got["rate"])) if got["logit"] else None
    return ToxicityModel(config, np.frombuffer(got["margin"], np.float32), got["bias"], got["base"], knots)


def _scores(batch, model: ToxicityModel) -> np.ndarray:
    return model.score(batch.column("text").to_pylist())


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(_scores(batch, shared.value), pa.float64())})

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= model.config.threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, shared.value) < model_threshold, pa.bool_()))

    model_threshold = model.config.threshold
    return docs.mapInArrow(run, docs.schema)


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
