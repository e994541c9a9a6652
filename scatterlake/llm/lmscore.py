"""LM scoring with a bigram model in Elias-Fano tries.

P(w | h) = a(h, w) + m / (c(h) + m) * P(w), with a(h, w) = c(h, w) / (c(h) + m)
quantised in the trie. P(w) discounts every known word by d and gives what is
freed to unknown words: (c - d) / N, and d * V / N; d comes from the counts of
counts. Probabilities sum to one over the known words and "unknown".

Nothing is broadcast or collected but four sums: the corpus is turned into
blocks of tokens, written once, bucketed by block. Blocks exchange two kinds of
messages with shards that each own a part of the vocabulary (words: counts and
ids) or of the pairs (a trie, queried with the pairs that blocks ask for). A
message is one row of packed arrays per block and shard; a block deals its entries
by one sort and sends nothing to shards that it has none for, so its work does not
grow with the shards and messages never outnumber entries. Contexts that are
frequent are split over shards by their successor, so no shard grows with a
frequent word. Words are known by 64-bit hashes.

Defined cases: null text is empty and holds the end token only; a null id is not
held out; repeated rows count and are scored each; very long texts are one block
of their own; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, materialize, mix, note_written, pieces, prefix_hash, read_table, shared_dir, small_batches, span_hash, text_buffers, word_spans
from .eliasfano import BigramTrie, probability

START, END = np.uint64(1), np.uint64(2)  # no word hashes to these but by chance


@dataclass(frozen=True)
class LMConfig:
    #: Tokens of a block (a block also ends where a batch does).
    block_tokens: int = 2_000_000
    #: Bytes of input for each bucket of blocks.
    bucket_bytes: int = 16 << 20
    #: Distinct words or pairs that a shard aims at.
    shard_entries: int = 2_000_000
    #: Occurrences of a context that are kept in one shard.
    split: int = 400_000
    #: Weight of the unigram distribution, in occurrences of the context.
    prior: float = 20.0


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, so that leading zero bytes vanish in compression."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _deltas(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def _sums(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def to_blocks(docs: DataFrame, config: LMConfig) -> DataFrame:
    """Blocks of whole documents: word hashes, and per token the word's place among them."""

    def block(number, parts):
        ids, held, sizes, hashed = (np.concatenate(x) for x in zip(*[p[:4] for p in parts], strict=True))
        known = np.concatenate([p[4] for p in parts])
        words, token = np.unique(np.append(hashed, START), return_inverse=True)
        return [number, ids.astype(np.int64).tobytes(), known.tobytes(), held.tobytes(), pack(sizes), words.tobytes(), pack(token)]

    kinds = [pa.int64(), *[pa.binary()] * 6]
    names = ["block", "ids", "known", "held", "sizes", "words", "tokens"]

    def run(batches):
        number, parts, held_tokens = TaskContext.get().partitionId() << 32, [], 0

        def send():
            return pa.record_batch([pa.array([x], k) for x, k in zip(block(number, parts), kinds, strict=True)], names=names)

        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for lo, hi, part, offs in pieces(raw, offsets):
                low = LOWER[part]
                start, end, doc = word_spans(low, offs)
                n = np.bincount(doc, minlength=hi - lo)
                hashed = np.empty(len(start) + hi - lo, np.uint64)
                ends = np.cumsum(n + 1) - 1
                body = np.ones(len(hashed), bool)
                body[ends] = False
                hashed[body], hashed[ends] = span_hash(prefix_hash(low), start, end), END
                parts.append((ids[lo:hi], held[lo:hi], n + 1, hashed, known[lo:hi]))
                held_tokens += len(hashed)
                if held_tokens >= config.block_tokens:
                    yield send()
                    number, parts, held_tokens = number + 1, [], 0
        if parts:
            yield send()

    schema = "block long, ids binary, known binary, held binary, sizes binary, words binary, tokens binary"
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(run, schema)


class Block:
    """A block's arrays, with what the word shards have answered."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.held = np.frombuffer(row["held"], bool)
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        token = unpack(row["tokens"]).astype(np.int64)
        self.start, self.token = token[-1], token[:-1]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes

    def train_counts(self) -> np.ndarray:
        """Occurrences in training documents of each word; of START, these documents."""
        out = np.bincount(self.token[~self.held[self.owner]], minlength=len(self.words))
        out[self.start] = (~self.held).sum()
        return out

    def answered(self, rows: list[dict], shards: int) -> None:
        self.word_id, self.count = np.zeros(len(self.words), np.uint64), np.zeros(len(self.words), np.int64)
        places = dict(dealt(shard_of(self.words, shards)))
        for r in rows:
            at = places[r["shard"]]
            self.word_id[at], self.count[at] = unpack(r["x"]), unpack(r["y"]).astype(np.int64)

    def pairs(self, config: LMConfig, shards: int):
        """(code, inverse, counts, shard) of the distinct pairs, sorted by context and successor id."""
        by_id = np.argsort(self.word_id, kind="stable")
        rank = np.empty(len(by_id), np.int64)
        rank[by_id] = np.arange(len(by_id))
        before = np.empty(len(self.token), np.int64)
        before[1:] = self.token[:-1]
        before[self.first] = self.start
        code, inverse = np.unique(rank[before] * len(by_id) + rank[self.token], return_inverse=True)
        counts = np.bincount(inverse, ~self.held[self.owner], len(code)).astype(np.int64)
        context, successor = by_id[code // len(by_id)], by_id[code % len(by_id)]
        parts = np.maximum(1, -(-self.count[context] // config.split)).astype(np.uint64)
        salt = mix(self.word_id[successor] + np.uint64(77)) % parts
        return context, successor, inverse, counts, shard_of(self.word_id[context] + salt * np.uint64(0x9E3779B97F4A7C15), shards)


def shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    return (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(shards)).astype(np.int64)


def dealt(place: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, its entries in order) for each shard that occurs, by one sort however many shards there are."""
    if not len(place):
        return []
    order = np.argsort(place, kind="stable")
    edge = np.flatnonzero(np.diff(place[order], prepend=-1))
    return list(zip(place[order[edge]].tolist(), np.split(order, edge[1:]), strict=True))


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


MESSAGE = "shard long, block long, kind int, x binary, y binary, z binary, u binary, v binary"
_M_NAMES = ["shard", "block", "kind", "x", "y", "z", "u", "v"]
_M_KINDS = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]


def _messages(rows: list[list]) -> pa.Table:
    cols = list(zip(*[r + [None] * (8 - len(r)) for r in rows], strict=True)) or [[]] * 8
    return pa.table([pa.array(c, k) for c, k in zip(cols, _M_KINDS, strict=True)], names=_M_NAMES)


def word_shard(table: pa.Table, shards: int) -> pa.Table:
    """Counts and ids of a shard's words, answered block by block, and the sums of the shard."""
    rows = sorted(_rows(table), key=lambda r: r["block"])
    asked = [_sums(r["x"]) for r in rows]
    words, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([unpack(r["y"]) for r in rows]), len(words)).astype(np.int64)
    order = np.argsort(-counts, kind="stable")  # frequent words get small ids
    ids = np.empty(len(words), np.uint64)
    ids[order] = np.arange(len(words), dtype=np.uint64) * np.uint64(shards) + np.uint64(rows[0]["shard"])
    real = counts[words != START]
    sums = np.array([real.sum(), (real > 0).sum(), (real == 1).sum(), (real == 2).sum()], np.uint64)
    out, at = [[rows[0]["shard"], None, 2, sums.tobytes()]], 0
    for r, a in zip(rows, asked, strict=True):
        here = inverse[at : at + len(a)]
        out.append([r["shard"], r["block"], 0, pack(ids[here]), pack(counts[here])])
        at += len(a)
    return _messages(out)


def pair_shard(table: pa.Table, config: LMConfig) -> pa.Table:
    """Builds the shard's trie from the blocks' training counts and answers their pairs from it."""
    rows = sorted(_rows(table), key=lambda r: r["block"])
    context, total, successor, counts, sizes = [], [], [], [], []
    for r in rows:
        per = unpack(r["z"]).astype(np.int64)
        context.append(np.repeat(_sums(r["x"]), per))
        total.append(np.repeat(unpack(r["y"]), per))
        successor.append(unpack(r["u"]))
        counts.append(unpack(r["v"]))
        sizes.append(len(successor[-1]))
    context, total, successor, counts = (np.concatenate(x) for x in (context, total, successor, counts))
    contexts, c = np.unique(context, return_inverse=True)
    successors, s = np.unique(successor, return_inverse=True)
    code, inverse = np.unique(c * len(successors) + s, return_inverse=True)
    seen = np.bincount(inverse, counts, len(code))
    whole = np.zeros(len(contexts))
    whole[c] = total
    at = np.flatnonzero(seen > 0)
    c_at = code[at] // len(successors)
    data = BigramTrie.layout_of(c_at, code[at] % len(successors), seen[at] / (whole[c_at] + config.prior))
    handle, path = tempfile.mkstemp(suffix=".trie")  # mapped by this task only, and removed at once
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        trie = BigramTrie.mapped(path)
    finally:
        os.unlink(path)
    out, lo = [], 0
    for r, n in zip(rows, sizes, strict=True):
        out.append([r["shard"], r["block"], 1, pack(trie.codes_of(c[lo : lo + n], s[lo : lo + n]))])
        lo += n
    return _messages(out)


def lm_scores(docs: DataFrame, config: LMConfig = LMConfig()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    name = f"lm_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/scatterlake/{name}"
    # buckets by block, so that blocks are never shuffled; as many as the size of the input asks for
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 50 else 0  # rows that are not from files have no size
    buckets = min(100_000, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // config.bucket_bytes))
    (to_blocks(docs, config).write.format("parquet").bucketBy(buckets, "block").option("path", path).saveAsTable(name))
    blocks = spark.table(name)
    entries = blocks.agg(F.sum(F.octet_length("words") / 8), F.sum(F.octet_length("tokens") / 3)).first()
    if entries[0] is None:
        spark.sql(f"DROP TABLE {name}")
        note_written(path)
        return spark.createDataFrame([], schema)
    word_shards = max(1, int(entries[0] // config.shard_entries) + 1)
    pair_shards = max(1, int(entries[1] // config.shard_entries) + 1)

    def ask_words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                counts, place = b.train_counts(), shard_of(b.words, word_shards)
                out = [[i, b.number, 0, _deltas(b.words[at]), pack(counts[at])] for i, at in dealt(place)]
                yield from _messages(out).to_batches()

    asked = blocks.mapInArrow(ask_words, MESSAGE)
    answers = materialize(asked.groupBy("shard").applyInArrow(lambda t: word_shard(t, word_shards), MESSAGE), "lm-words")
    sums = np.sum([np.frombuffer(r["x"], np.uint64).astype(np.int64) for r in answers.where("kind = 2").select("x").collect()], axis=0)
    tokens, distinct, once, twice = (int(x) for x in sums)
    discount = once / (once + 2 * twice) if once else 0.5
    answers = answers.where("kind = 0")

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in _rows(left):
            b = Block(row)
            b.answered(_rows(right), word_shards)
            context, successor, _, counts, place = b.pairs(config, pair_shards)
            for i, at in dealt(place):
                edge = np.flatnonzero(np.diff(context[at], prepend=-1))
                per = np.diff(np.append(edge, len(at)))
                ctx = context[at][edge]
                out.append([i, b.number, 1, _deltas(b.word_id[ctx]), pack(b.count[ctx]), pack(per), pack(b.word_id[successor[at]]), pack(counts[at])])
        return _messages(out)

    asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask_pairs, MESSAGE)
    replies = asked.groupBy("shard").applyInArrow(lambda t: pair_shard(t, config), MESSAGE)
    both = answers.unionByName(replies)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        messages = _rows(right)
        for row in _rows(left):
            b = Block(row)
            b.answered([m for m in messages if m["kind"] == 0], word_shards)
            context, successor, inverse, _, place = b.pairs(config, pair_shards)
            a, places = np.zeros(len(context)), dict(dealt(place))
            for m in messages:
                if m["kind"] == 1:
                    a[places[m["shard"]]] = probability(unpack(m["x"]))
            c = b.count[successor]
            single = np.where(c > 0, (c - discount) / max(1, tokens), discount * distinct / max(1, tokens))
            single = np.maximum(single, 1e-300)
            p = np.minimum(1.0, a + config.prior / (b.count[context] + config.prior) * single)
            score = np.bincount(b.owner, np.log10(p)[inverse], len(b.sizes))
            mine = b.count[b.token]
            base = np.bincount(b.owner, np.log10((mine + 1.0) / (tokens + 1.0 * (distinct + 1))), len(b.sizes))
            tables.append(pa.table({
                "doc_id": pa.array(b.ids, mask=~b.known),
                "held_out": pa.array(b.held),
                "n_tokens": pa.array(b.sizes),
                "n_known": pa.array(np.bincount(b.owner, mine > 0, len(b.sizes)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(b.sizes), tokens)),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }))
        return pa.concat_tables(tables) if tables else pa.table({k: pa.array([], v) for k, v in [
            ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]})

    out = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, schema)
    spark.sql(f"DROP TABLE {name}")  # the name only: its files stay for the lazy result, as those of materialize do
    note_written(path)
    return out


def lm_query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))
