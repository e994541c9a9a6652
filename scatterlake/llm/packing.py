"""Packing: vector bin packing of examples into fixed-size training sequences.

Every example has a demand in three dimensions (tokens, segments, loss-bearing
tokens) and a sequence has a limit in each. The next example of a sequence is
the one that fits and whose demand has the largest dot product with what the
sequence has left, all in shares of the limits. Where examples may be cut, the
best example that does not fit whole is cut as far as tokens and loss allow.

Packing runs per block of rows in the order they are read, so it needs no
shuffle and its memory is bounded by a block. Where cutting is allowed, a
sequence that a limit closes early is dealt into sequences whose lengths are
powers of two, which need no padding, so small blocks waste nothing.

Defined cases: null text (or prompt) is empty; a document always has at least its
closing id, which bears no loss; repeated rows are packed each; a null id is
carried through; very long texts are cut into full sequences; ties go to the
earlier row; other columns are ignored, whatever their names; an example over a
limit that may not be cut raises ``ValueError``; an empty table gives no pieces.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, small_batches

CACHE_ENTRIES = 800_000  # of a generation of a worker's larger cache (about 130 MB)


#: Examples, and characters, that are packed together.
BLOCK_ROWS = 512
BLOCK_CHARS = 8 << 20


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


@dataclass(frozen=True)
class Piece:
    example: int
    start: int
    length: int
    sequence: int
    offset: int


def pack(tokens: Iterable[int], loss: Iterable[int] | None = None, limits: Limits = Limits(), cut: bool = True, lead: Iterable[int] | None = None) -> list[Piece]:
    """Place examples with ``tokens[i]`` tokens, ``loss[i]`` of them (all, by default) loss-bearing.

    Those are consecutive and begin behind ``lead[i]`` tokens (by default, so that they come last).
    Without ``cut`` examples stay whole. Ties go to the earlier example.
    """
    size = np.array(list(tokens), dtype=np.int64)
    bearing = size.copy() if loss is None else np.array(list(loss), dtype=np.int64)
    first = size - bearing if lead is None else np.array(list(lead), dtype=np.int64)
    if not cut and len(size) and (size.max() > limits.tokens or bearing.max() > limits.loss_tokens):
        raise ValueError("an example exceeds a limit")
    start, left, bears, out, sequence = np.zeros(len(size), np.int64), size.copy(), bearing.copy(), [], 0

    def most(i: int, room: int, budget: int) -> int:
        """How many of an example's next tokens fit into so many tokens and loss-bearing tokens."""
        if bears[i] <= budget:
            return min(room, int(left[i]))
        return min(room, max(0, int(first[i] - start[i])) + budget)

    def use(i: int, take: int) -> int:
        """Take tokens off an example; returns how many of them bear loss."""
        start[i] += take
        left[i] -= take
        now = int(bearing[i] - min(max(start[i] - first[i], 0), bearing[i]))
        used = int(bears[i]) - now
        bears[i] = now
        return used

    if cut:  # whole sequences of long examples
        for i in np.flatnonzero(left >= limits.tokens).tolist():
            while left[i] >= limits.tokens and most(i, limits.tokens, limits.loss_tokens) == limits.tokens:
                out.append(Piece(i, int(start[i]), limits.tokens, sequence, 0))
                use(i, limits.tokens)
                sequence += 1
    open_ = np.flatnonzero(left > 0)
    while len(open_):
        room, seats, budget, chosen = limits.tokens, limits.segments, limits.loss_tokens, []
        while room > 0 and seats > 0 and len(open_):
            need, loss_need = left[open_], bears[open_]
            gain = need * (room / limits.tokens**2) + loss_need * (budget / limits.loss_tokens**2) + seats / limits.segments**2
            fits = (need <= room) & (loss_need <= budget)
            if not fits.any():
                if not cut:
                    break
                fits = (loss_need <= budget) | (first[open_] > start[open_]) | (budget > 0)  # what can be cut here
                if not fits.any():
                    break
            at = int(np.argmax(np.where(fits, gain, -1.0)))
            i = int(open_[at])
            take = most(i, room, budget)
            chosen.append((i, int(start[i]), take))
            room, seats, budget = room - take, seats - 1, budget - use(i, take)
            if left[i] == 0:
                open_ = np.delete(open_, at)
        if cut and room > 0:
            sequence = _powers_of_two(chosen, limits.tokens - room, sequence, out)
        else:
            at = 0
            for i, begin, take in chosen:
                out.append(Piece(i, begin, take, sequence, at))
                at += take
            sequence += 1
    return out


def _powers_of_two(chosen: list[tuple[int, int, int]], total: int, sequence: int, out: list[Piece]) -> int:
    """Deal a rest into sequences as long as the powers of two that sum to it."""
    room, at = 1 << (total.bit_length() - 1), 0
    for i, first, take in chosen:
        while take:
            part = min(take, room - at)
            out.append(Piece(i, first, part, sequence, at))
            first, take, at, total = first + part, take - part, at + part, total - part
            if at == room:
                sequence, at, room = sequence + 1, 0, 1 << max(0, total.bit_length() - 1)
    return sequence


class WordCache(dict):
    """Ids of words, in two generations: when the young one is full it becomes the old one, and what is asked again moves back."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = self.copy()
            self.clear()


def _byte_characters() -> dict[int, int]:
    """The character by which byte-level models write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return dict(zip(shown, shown, strict=True)) | {b: 256 + n for n, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of whole texts by a tokenizer that lower-cases and drops white space, word by word through bounded caches.

    White space never joins or changes a word's ids in such a tokenizer. Texts of
    characters that lower-case one by one are lower-cased first, unless they may hold
    special tokens, which are found before. Latin words go to the tokenizer's
    model directly, where its rules of normalizing and splitting are the ones that
    ``PARTS`` applies; all others go through the whole tokenizer. Texts with a
    separator that Python splits at and the tokenizer does not are encoded whole.
    """

    #: Characters that stay one character when they are composed and lower-cased.
    SIMPLE = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u017f]*")
    #: Words of printable ASCII and Latin letters, and the parts that such a lower-cased word is split into.
    LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
    #: Most of them have one or two.
    PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\[-`{-~]*)")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u017f]+|[0-9]|[!-/:-@\[-`{-~]+")
    RULES = (
        {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    )
    #: What special tokens, which are not lower-cased, begin with.
    SPECIAL = "<|"
    SHOWN = _byte_characters()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = tuple(part and json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = all(t.startswith(self.SPECIAL) for t in added)
        self.direct = self.lowers and rules == self.RULES
        self.known, self.marks = WordCache(self._encode_word, CACHE_ENTRIES), WordCache(self._encode_part, 10_000)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _encode_part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.SHOWN)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _encode_word(self, word: str) -> bytes:
        if self.direct:
            lower = word.lower()
            plain = self.PLAIN.fullmatch(lower)
            if plain:
                core, mark = plain.groups()
                return self._encode_part(core) + self.marks[mark] if mark else self._encode_part(core)
            if self.SPECIAL not in word and self.LATIN.fullmatch(word):
                return b"".join(map(self._encode_part, self.PARTS.findall(lower)))
        return self._encode(word)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        self.known.turn()
        self.marks.turn()
        simple, special, ids_of, out = self.SIMPLE.fullmatch, self.SPECIAL, self.known.__getitem__, []
        for t in texts:
            if self.lowers and special not in t and simple(t):
                out.append(b"".join(map(ids_of, t.lower().split())))
            elif any(c in t for c in "\x1c\x1d\x1e\x1f"):
                out.append(self._encode(t))
            else:
                out.append(b"".join(map(ids_of, t.split())))
        return out


_made: dict[str, WordTokenizer] = {}  # one tokenizer, with its cache, per worker


def pack_documents(docs: DataFrame, tokenizer_path: str, closing_id: int = 2, limits: Limits = Limits(), prompt: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_path`` must exist on every executor (an installed vocabulary). The ids of
    ``text`` bear loss, those of the column ``prompt`` before it and the closing id do not.
    """
    small_batches(docs.sparkSession)
    closing = array("I", [closing_id]).tobytes()

    def blocks(batches):
        """Rows (doc_id, prompt, text) in blocks that do not depend on how rows come in batches."""
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "prompt", "text")), strict=True):
                rows.append(row)
                size += len(row[2] or "") + len(row[1] or "")
                if len(rows) >= BLOCK_ROWS or size >= BLOCK_CHARS:
                    yield rows
                    rows, size = [], 0
        if rows:
            yield rows

    def run(batches):
        if tokenizer_path not in _made:
            _made[tokenizer_path] = WordTokenizer(tokenizer_path)
        coder = _made[tokenizer_path]
        sequences = TaskContext.get().partitionId() << 36
        gc.disable()  # strings and bytes hold no cycles, and there are many of them
        for rows in blocks(batches):
            ids = [x + closing for x in coder.encode_all([r[2] or "" for r in rows])]
            lead = [0] * len(rows)
            if prompt is not None:
                before = coder.encode_all([r[1] or "" for r in rows])
                lead = [len(x) // 4 for x in before]
                ids = [x + y for x, y in zip(before, ids, strict=True)]
            tokens = [len(x) // 4 for x in ids]
            placed = pack(tokens, [n - k - 1 for n, k in zip(tokens, lead, strict=True)], limits, lead=lead)
            who = [p.example for p in placed]
            crc = [zlib.crc32(memoryview(ids[p.example])[4 * p.start : 4 * (p.start + p.length)]) for p in placed]
            yield pa.record_batch({
                "doc_id": pa.array([rows[i][0] for i in who], pa.int64()),
                "start": pa.array([p.start for p in placed], pa.int64()),
                "length": pa.array([p.length for p in placed], pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array([tokens[i] for i in who], pa.int64()),
                "sequence_id": pa.array([sequences + p.sequence for p in placed], pa.int64()),
                "offset": pa.array([p.offset for p in placed], pa.int64()),
            })
            sequences += 1 + max((p.sequence for p in placed), default=-1)
        gc.enable()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    before = F.lit(None).cast("string") if prompt is None else F.col(prompt)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), before.alias("prompt"), F.col("text").alias("text")).mapInArrow(run, schema)


def packing_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
