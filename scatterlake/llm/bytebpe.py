"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every byte prefix of a piece there is exactly one token that can stand last
in its encoding, because a sequence of tokens is an encoding if and only if
each two neighbours would not have been merged across their border. Storing that
token per prefix makes appending exact and re-encoding after an edit local.

Whole texts: a text is cut at single spaces, each chunk is split by the
tokenizer's pattern, and encodings of chunks and pieces are kept in bounded
caches, since words recur. Texts whose white space could join across chunks are
split by the pattern as a whole.

Defined cases: null text is empty (no ids, digests of zero bytes); repeated
rows are encoded each; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, small_batches

#: White space that a split at single spaces could tear apart.
PLAIN_MARKS = frozenset(".,;:!?)")
_JOINED = re.compile(r"\s \s|\s\Z")
CACHE_ENTRIES = 800_000  # of each of a worker's two caches (about 150 MB)


class BytePairVocabulary:
    """Ranks, and when two neighbouring tokens stay apart."""

    def __init__(self, rank_file: bytes):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.split(b"\n"):
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._made: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}
        self._begins: dict[bytes, int] = {}

    def made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token`` out of its own bytes.

        A single byte is made of itself twice; None: merging never makes it.
        """
        if token not in self._made:
            whole = self.tokens[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            last = (token, token) if len(parts) == 1 else None
            while len(parts) > 1:
                pairs = [self.ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
                known = [r for r in pairs if r is not None]
                if not known:
                    last = None
                    break
                i = pairs.index(min(known))
                last = (self.ranks[parts[i]], self.ranks[parts[i + 1]])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._made[token] = last
        return self._made[token]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Undoes the merges beside the border from the latest to the first: a pair
        that met there stays apart only if its own merge ranks after the merge
        that used up one of the two. Equal ranks go to the one further left.
        """
        key = left << 32 | right
        known = self._apart.get(key)
        if known is not None:
            return known
        a, b, tokens, ranks = left, right, self.tokens, self.ranks
        before = None  # the border pair's merge must rank at or after this to stay apart
        result = True
        while True:
            merged = ranks.get(tokens[a] + tokens[b])
            if merged is not None and (before is None or merged < before):
                result = False
                break
            single_a, single_b = len(tokens[a]) == 1, len(tokens[b]) == 1
            if single_a and single_b:
                break
            if single_b or (not single_a and a > b):
                before, a = a, self.made_of(a)[1]
            else:
                before, b = b + 1, self.made_of(b)[0]
        if len(self._apart) > 1_000_000:
            self._apart.clear()
        self._apart[key] = result
        return result


    def last_tokens(self, data: bytes, last: list[int], begin: int) -> None:
        """Fill ``last[begin:]``, -1 so far: the token that stands last in the encoding of each prefix.

        Goes forwards, from each prefix whose last token is known along the tokens
        that begin there; one found for a prefix is the only valid one.
        """
        known, apart, check, n = self.table().get, self._apart.get, self.stay_apart, len(data)
        for start in range(begin - self.longest if begin > self.longest else 0, n):
            before = last[start] << 32
            if before < 0:
                raise ValueError(f"no token for byte {data[start - 1]}")
            for end in range(start + 1, n + 1):
                token = known(data[start:end])
                if token is None:
                    break
                if token >= 0 and last[end] < 0:
                    if start:
                        fits = apart(before | token)
                        if fits is None:
                            fits = check(before >> 32, token)
                        if not fits:
                            continue
                    last[end] = token
        if n >= begin and last[n] < 0:
            raise ValueError(f"no token for byte {data[n - 1]}")

    def table(self) -> dict[bytes, int]:
        """Rank of each token that merging can make, and -1 for what only begins such tokens."""
        if not self._begins:
            made = {t: r for t, r in self.ranks.items() if self.made_of(r)}
            self._begins = dict.fromkeys((t[:k] for t in made for k in range(1, len(t))), -1) | made
        return self._begins

    def walk_back(self, last: list[int]) -> list[int]:
        """The ids of the whole, from its last token to its first, put in order."""
        out, end, tokens = [], len(last) - 1, self.tokens
        while end:
            out.append(last[end])
            end -= len(tokens[last[end]])
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        last = [0] + [-1] * len(data)
        self.last_tokens(data, last, 1)
        return self.walk_back(last)


class PrefixEncoder:
    """The encoding of a growing or edited byte string, by its prefixes' last tokens."""

    def __init__(self, vocabulary: BytePairVocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self.vocabulary.last_tokens(self.data, self.last, start + 1)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of [start, end); returns the prefixes computed again.

        Behind the edit, work ends once as many last tokens as the longest token
        has bytes are as before: all later ones then follow from the same state.
        """
        data = self.data[:start] + new + self.data[end:]
        shift, old = len(new) - (end - start), self.last
        self.last = old[: start + 1] + [-1] * (len(data) - start)
        self.data, same, done = data, 0, 0
        for at in range(start + 1, len(data) + 1):
            self.vocabulary.last_tokens(data[:at], self.last, at)
            done += 1
            same = same + 1 if at - start > len(new) and self.last[at] == old[at - shift] else 0
            if same >= self.vocabulary.longest and at - start > len(new) + self.vocabulary.longest:
                self.last[at + 1 :] = old[at - shift + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        return self.vocabulary.walk_back(self.last)


class _Cache(dict):
    """A dict that makes missing entries and empties itself when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        made = self[key] = self.make(key)
        return made


class ByteBPE:
    """Whole texts to ids and back; ids are kept as little-endian unsigned 32-bit integers."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary = BytePairVocabulary(rank_file)
        self.split = regex.compile(pattern).findall
        self.piece = _Cache(self._encode_piece)
        self.spaced = _Cache(self._encode_spaced)

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        return array("I", [whole] if whole is not None else self.vocabulary.encode(data)).tobytes()

    def _encode_spaced(self, chunk: str) -> bytes:
        """A chunk behind a space; words, and words with one mark behind them, need no pattern."""
        if chunk.isalpha():
            return self.piece[" " + chunk]
        if chunk[-1:] in PLAIN_MARKS and chunk[:-1].isalpha():
            return self.piece[" " + chunk[:-1]] + self.piece[chunk[-1]]
        return b"".join(map(self.piece.__getitem__, self.split(" " + chunk)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _JOINED.search(text):
            return b"".join(map(self.piece.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.piece.__getitem__, self.split(first))) + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, array("I", ids)))


_made: dict[int, ByteBPE] = {}  # one coder, with its caches, per worker


def byte_bpe(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(rank_path, "rb") as file:
        shared = spark.sparkContext.broadcast((file.read(), pattern))

    def run(batches):
        key = hash(shared.value)
        if key not in _made:
            _made[key] = ByteBPE(*shared.value)
        coder = _made[key]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = coder.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(ids_sha, pa.string()),
                "decoded_sha256": pa.array(text_sha, pa.string()),
            })

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def byte_bpe_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
