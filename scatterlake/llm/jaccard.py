"""N-gram Jaccard join: size-aware heavy-light self-join of shingle sets.

Two sets of sizes n <= m with Jaccard similarity t or more share at least
o(n, m) elements and differ in at most d(n, m).

* Light sets (up to a boundary): every subset of size o(n, m) is enumerated for
  every admissible partner size, and partners meet on an equal subset.
* Heavy sets: inverted lists are scanned. The lists are keyed by blocks of
  elements, not by single ones: hashing deals the elements of a set into
  d + 1 blocks, so partners agree on a whole block at least (pigeonhole), and a
  passage that many documents share does not make a list long. Empty blocks are
  listed only for sets with so many of them that partners may share no other.
* The boundary is the one of least cost over the histogram of sizes.

Equal sets collapse to one class first, so groups of copies cost one row.
Candidates are then verified on the whole sets, made again from the texts of those
that sketches leave open, in two rounds:

* Every member of a list is compared with the list's best-connected one. Jaccard
  distance is a metric, so a member at more than twice the threshold's distance
  from the best one links with none of those that link with it.
* What is left of a list (the members that did not link, and those near enough to
  link with ones that did) is compared where it still joins different components:
  block by block, without making pairs of rows. A list that would cost too many
  comparisons is first dealt again by blocks under another hash, as linked sets
  agree on a block under every hash; lists that chance or a shared passage made
  fall apart, and after a few times the rest is compared as it is.

No link between different sets is lost: each linked pair meets in a list, and is
verified, already connected, or ruled out by an exact bound. Sets are compared
by 64-bit element hashes.

Defined cases: null or blank text has an empty set, links with nothing and is
its own component; fewer words than a shingle make the whole sequence one
shingle; rows that share a document id are one node; a null id keeps a null
component unless its set has another member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, components, discard_since, fresh, materialize, mix, pieces, prefix_hash, read_table, small_batches, span_hash, text_buffers, word_spans, written

_SEEN = 200_000  # classes remembered by one task, so that copies are sent once
MAX_LIGHT = 64
SKETCH_BITS = 2048
LIST_ROWS = 1 << 19  # list rows that one task sorts at once
PARTS = 2  # the lists are dealt in parts one after the other, as no other shuffle is as large
BLOCK = 512  # sets of one block of a large list
LEVELS = 5  # how often a list of many comparisons is dealt again
BROADCAST_ROWS = 1_000_000  # most rows (of at most three longs) of a broadcast side
HEAVY_ROW = 16  # cost of a heavy set's row against a light one's


@dataclass(frozen=True)
class JaccardConfig:
    words: int = 3
    #: The threshold as a fraction num / den.
    num: int = 9
    den: int = 10

    def overlap(self, n: int, m: int) -> int:
        """Least intersection of linked sets of these sizes: den * o >= num * (n + m - o)."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def difference(self, total: int) -> int:
        """Most elements in which linked sets of this total size differ."""
        return total * (self.den - self.num) // (self.num + self.den)

    def nearness(self, total: int) -> int:
        """Most elements in which sets of this total size differ that may both link with a third one."""
        return total * (self.den - self.num) // self.num

    def links_only_equal(self, n: int) -> bool:
        """Whether a set of this size links with no other set than an equal one: one more element is too many."""
        return n * (self.den - self.num) < self.num

    def blocks(self, hi: int) -> int:
        """Blocks into which sets of at most this size are dealt: one more than they may differ in.

        Where a block has few elements, some blocks are empty by chance; an eighth
        more of them keeps the sets rare that must be listed by empty blocks.
        """
        most = self.difference(2 * hi)
        few = self.num + self.den < 16 * (self.den - self.num)
        return most + 1 + (-(-most // 8) if few else 0)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    low = LOWER[raw]
    start, end, doc = word_spans(low, offsets)
    hashed = span_hash(prefix_hash(low), start, end)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    n = len(hashed)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):  # order matters within a shingle
        rolled[: max(0, n - k)] = mix(rolled[: max(0, n - k)] + hashed[k:] + np.uint64(k + 1))
    for i in range(len(offsets) - 1):
        lo, hi = first[i], first[i + 1]
        if hi == lo:
            yield np.zeros(0, np.uint64)
        elif hi - lo < words:
            whole = np.uint64(0)
            for k in range(lo, hi):
                whole = mix(np.array([whole]) + hashed[k] + np.uint64(1000 + hi - lo))[0]
            yield np.array([whole])
        else:
            yield np.unique(rolled[lo : hi - words + 1])


def _key(values: np.ndarray, salt: int) -> int:
    return int(mix(values ^ np.uint64(salt)).sum(dtype=np.uint64))


def class_keys(values: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set."""
    return _key(values, 0x5BD1E995), _key(values, 0xC2B2AE3D27D4EB4F)


def size_class(n: int) -> tuple[int, int]:
    """Number of the class of sizes that n is in (widths grow by 7/5) and its largest size."""
    c, hi = 0, 9
    while hi < n:
        c, hi = c + 1, hi * 7 // 5
    return c, hi


def heavy_rows(n: int, config: JaccardConfig) -> list[tuple[int, int]]:
    """(class, blocks) pairs in whose lists a set of this size stands."""
    own, hi = size_class(n)
    top, top_hi = size_class(config.den * n // config.num)
    out = [(own, config.blocks(hi))]
    while own < top:
        own += 1
        hi = hi * 7 // 5
        out.append((own, config.blocks(hi)))
    return out


def light_sizes(n: int, config: JaccardConfig) -> list[int]:
    """Sizes of the subsets that a light set of this size enumerates."""
    return sorted({config.overlap(n, m) for m in config.partners(n) if m != n or config.overlap(n, n) < n})


def heavy_from(light: int, n: int, config: JaccardConfig) -> bool:
    """Whether a set of this size stands in lists of heavy sets."""
    return config.den * n >= config.num * (light + 1)


def expected_rows(histogram: dict[int, int], elements: int, light: int, config: JaccardConfig) -> int:
    """About the list rows of sets: counted for the sizes of the histogram, in proportion to the elements of all larger ones."""
    total = 0
    for n, docs in histogram.items():
        if n <= light:
            total += docs * sum(comb(n, c) for c in light_sizes(n, config))
        if heavy_from(light, n, config):
            total += docs * sum(p for _, p in heavy_rows(n, config))
    return total + int(elements * max(sum(p for _, p in heavy_rows(n, config)) / n for n in range(MAX_LIGHT, 4 * MAX_LIGHT)))


def boundary(histogram: dict[int, int], config: JaccardConfig) -> int:
    """The largest light size: the one of least cost over the histogram of sizes.

    Cost is rows; one of a heavy set counts more, as sets may meet there that are
    not linked and are fetched to be verified, while an equal subset of the
    required size is proof in itself.
    """

    def cost(b: int) -> int:
        total = 0
        for n, docs in histogram.items():
            if n <= b:
                total += docs * sum(comb(n, c) for c in light_sizes(n, config))
            if heavy_from(b, n, config):
                total += HEAVY_ROW * docs * sum(p for _, p in heavy_rows(n, config))
        return total

    return min(range(MAX_LIGHT), key=lambda b: (cost(b), b))


def signatures(values: np.ndarray, light: int, config: JaccardConfig) -> np.ndarray:
    """Keys of the lists in which a set stands."""
    n, out = len(values), []
    if n == 0:
        return np.zeros(0, np.uint64)
    own = mix(values ^ np.uint64(0x27D4EB2F165667C5))
    if n <= light:
        whole = own.sum(dtype=np.uint64)
        for c in light_sizes(n, config):
            gone = np.array([own[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), n - c)], np.uint64)
            out.append(mix(whole - gone + np.uint64(c)))
    if heavy_from(light, n, config):
        high = values >> np.uint64(32)
        for c, blocks in heavy_rows(n, config):
            block = ((high * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
            edge = np.flatnonzero(np.diff(block, prepend=-1))
            sums = np.zeros(blocks, np.uint64)
            sums[block[edge]] = np.add.reduceat(own, edge)
            keys = mix(sums + mix(np.arange(blocks, dtype=np.uint64) + np.uint64((c + 1) << 40)))
            # Partners differ in so many blocks at most. With more blocks that have elements,
            # they agree on one of those, and the long lists of empty blocks are not needed.
            if len(edge) > config.difference(n + config.den * n // config.num):
                keys = keys[block[edge]]
            out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _sets(batch, config):
    raw, offsets = text_buffers(batch.column("text"))
    for lo, hi, part, offs in pieces(raw, offsets):
        yield lo, hi, list(shingle_sets(part, offs, config.words))


def keyed(docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """doc_id, n (size of the set) and the set's digest (k1, k2) per row."""

    def run(batches):
        for batch in batches:
            n, keys = [], []
            for _, _, sets in _sets(batch, config):
                n += [len(s) for s in sets]
                keys += [class_keys(s) for s in sets]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()),
                "k1": _signed([k for k, _ in keys]), "k2": _signed([k for _, k in keys]),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long")


def listed(docs: DataFrame, light: int, config: JaccardConfig, part: int) -> DataFrame:
    """Inverted-list rows (sig, k1) of one of the parts; a task sends a class once for each fill of its memory."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, sets in _sets(batch, config):
                sig, who = [], []
                for s in sets:
                    key = class_keys(s)
                    if config.links_only_equal(len(s)) or key in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(key)
                    keys = signatures(s, light, config)
                    sig.append(keys[keys % np.uint64(PARTS) == part])
                    who.append(key)
                times = [len(x) for x in sig]
                yield pa.record_batch({
                    "sig": _signed(np.concatenate(sig) if sig else []),
                    "k1": _signed(np.repeat(np.array([k for k, _ in who], np.uint64), times)),
                })

    return docs.select("text").mapInArrow(run, "sig long, k1 long")


def shared(lists: DataFrame, tasks: int) -> DataFrame:
    """The rows (sig, k1) of lists in which two classes meet, most of which do not.

    Each task holds one row of a list until a second class meets it, and passes on what
    follows, so that nothing is sorted on disk and a list of any length costs no memory.
    """

    def run(batches):
        none = np.zeros(0, np.int64)
        sig, key, held, met = [none], [none], 0, none

        def settle():
            nonlocal sig, key, held, met
            s, k = np.concatenate(sig), np.concatenate(key)
            order = np.argsort(s, kind="stable")
            s, k = s[order], k[order]
            edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
            if not len(edge):
                return
            low, high = np.minimum.reduceat(k, edge), np.maximum.reduceat(k, edge)
            several = (low < high) | np.isin(s[edge], met)
            met = np.union1d(met, s[edge][several])
            sig, key, held = [s[edge][~several]], [low[~several]], 0
            rows = np.repeat(several, np.diff(edge, append=len(s)))
            s, k = s[rows], k[rows]
            for lo in range(0, len(s), 65536):
                yield pa.record_batch({"sig": pa.array(s[lo : lo + 65536]), "k1": pa.array(k[lo : lo + 65536])})

        for batch in batches:
            sig.append(batch.column("sig").to_numpy())
            key.append(batch.column("k1").to_numpy())
            held += len(batch)
            if held >= LIST_ROWS:
                yield from settle()
        yield from settle()

    return lists.repartition(tasks, "sig").mapInArrow(run, "sig long, k1 long").distinct()


def whole_sets(texts: DataFrame, nodes: DataFrame, config: JaccardConfig) -> DataFrame:
    """node and items (the set's hashes in order) of these nodes."""

    def run(batches):
        for batch in batches:
            found = [s.tobytes() for _, _, sets in _sets(batch, config) for s in sets]
            yield pa.record_batch({"node": batch.column("node"), "items": pa.array(found, pa.binary())})

    return texts.join(_checked(nodes), "node", "left_semi").mapInArrow(run, "node long, items binary")


#: What makes the whole sets (node, items) of given nodes, anew from their texts: as a table they would be longer than these.
Whole = Callable[[DataFrame], DataFrame]


def verify(pairs: DataFrame, whole: Whole, config: JaccardConfig) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold, as a table."""
    before = written()
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = materialize(whole(materialize(nodes.distinct(), "jaccard-chosen")), "jaccard-sets")
    both = sets.select(F.col("node").alias("a"), F.col("items").alias("x")).join(_checked(pairs), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(config.den * same >= config.num * (len(p) + len(q) - same))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok, pa.bool_()))

    out = materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-links")
    discard_since(pairs.sparkSession, before, keep=1)
    return out


def _checked(small: DataFrame) -> DataFrame:
    """A broadcast of a side of few rows of fixed width; a larger one is joined by sorting."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def parity_sketch(values: np.ndarray) -> bytes:
    """Parity of the number of elements in each hash bucket: SKETCH_BITS of them, or doubled until a set has no more elements.

    One element more or less flips one bit, so two sets differ in at least as many
    elements as their sketches in bits: an exact lower bound, whatever collides.
    """
    size = SKETCH_BITS
    while size < len(values):
        size *= 2
    return np.packbits((np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set in ``size`` bytes: buckets that fall together add their parities."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


def may_link(p: bytes, q: bytes, n: int, m: int, config: JaccardConfig) -> bool:
    """Whether sizes and sketches leave open that two sets are linked."""
    if config.den * min(n, m) < config.num * max(n, m):
        return False
    size = min(len(p), len(q))
    return int(np.bitwise_count(folded(p, size) ^ folded(q, size)).sum()) <= config.difference(n + m)


def sketched(pairs: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """Of the pairs (a, b), those that may have a common partner; ``may`` tells whether they may link themselves."""
    both = sets.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x")).join(_checked(pairs), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")

    def run(batches):
        for batch in batches:
            near, may = [], []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True):
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                near.append(apart <= config.nearness(n + m))
                may.append(apart <= config.difference(n + m) and config.den * min(n, m) >= config.num * max(n, m))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "may": pa.array(may, pa.bool_())}).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long, may boolean")


def possible_pairs(sketches: list[bytes], size: np.ndarray, component: np.ndarray, config: JaccardConfig) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of different components that sizes and sketches do not rule out."""
    short = min(map(len, sketches))
    bits = np.unpackbits(np.stack([folded(x, short) for x in sketches]), axis=1).astype(np.float32)
    ones = bits.sum(axis=1)
    found = []
    for lo in range(0, len(bits), BLOCK):
        rows = slice(lo, lo + BLOCK)
        apart = ones[rows, None] + ones[None, :] - 2 * (bits[rows] @ bits.T)
        total = size[rows, None] + size[None, :]
        ok = np.rint(apart).astype(np.int64) * (config.num + config.den) <= total * (config.den - config.num)
        ok &= config.den * np.minimum(size[rows, None], size[None, :]) >= config.num * np.maximum(size[rows, None], size[None, :])
        ok &= component[rows, None] != component[None, :]
        i, j = np.nonzero(ok)
        found.append(np.stack([i + lo, j]))
    i, j = np.concatenate(found, axis=1)
    i, j = i[i < j], j[i < j]
    # pairs of larger sets, by all bits that both of them have
    ok = [min(len(sketches[a]), len(sketches[b])) == short or may_link(sketches[a], sketches[b], int(size[a]), int(size[b]), config) for a, b in zip(i, j, strict=True)]
    ok = np.array(ok, bool)
    return i[ok], j[ok]


def still_open(lists: DataFrame, part: DataFrame) -> DataFrame:
    """Lists (sig, node) that join several components, with own (members of that component), size and cost (pairs across components)."""
    before = written()
    rows = materialize(lists.join(part, "node"), "jaccard-members")
    own = rows.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("own"))
    size = own.groupBy("sig").agg(F.sum("own").alias("size"), F.sum(F.col("own") * F.col("own").cast("double")).alias("inner"), F.count(F.lit(1)).alias("parts"))
    size = materialize(size.where("parts > 1").select("sig", "size", ((F.col("size") * F.col("size").cast("double") - F.col("inner")) / 2).alias("cost")), "jaccard-open")
    some = materialize(own.join(size, "sig"), "jaccard-parts")
    out = materialize(rows.join(some, ["sig", "component"]), "jaccard-lists")
    discard_since(lists.sparkSession, before, keep=1)
    return out


def dealt_again(lists: DataFrame, whole: Whole, level: int, config: JaccardConfig) -> DataFrame:
    """Lists (sig, node) for the members of each list that agree on a block under another hash."""
    salt = mix(np.array([level + 1], np.uint64))

    def run(batches):
        for batch in batches:
            sig, who = [], []
            for node, items, old in zip(*(batch.column(c).to_pylist() for c in ("node", "items", "sigs")), strict=True):
                keys = signatures(np.sort(mix(np.frombuffer(items, np.uint64) ^ salt)), 0, config)
                for one in old:
                    sig.append(mix(keys + mix(np.array([one], np.int64).view(np.uint64))))
                who.append(np.full(len(keys) * len(old), node))
            yield pa.record_batch({"sig": _signed(np.concatenate(sig) if sig else []), "node": pa.array(np.concatenate(who) if who else [], pa.int64())})

    by_node = lists.groupBy("node").agg(F.collect_list("sig").alias("sigs"))
    rows = materialize(whole(lists.select("node").distinct()).join(by_node, "node").mapInArrow(run, "sig long, node long"), "jaccard-dealt")
    several = materialize(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("sig"), "jaccard-several")
    return rows.join(several, "sig")


def across(lists: DataFrame, sets: DataFrame, whole: Whole, config: JaccardConfig) -> DataFrame:
    """Links (a, b) between components of each list (see :func:`still_open`).

    Blocks hold sketches, not sets: only pairs that these cannot rule out are
    verified on the whole sets. Small lists are compared whole; a large one is
    dealt into blocks, and two blocks meet unless both are parts of one component,
    so a component of any size costs only what lies outside it.
    """
    small = lists.where(F.col("size") <= BLOCK).select("node", "sig", "component", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    large = lists.where(F.col("size") > BLOCK)
    alone = F.col("own") > BLOCK
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / BLOCK))
    shelf = F.pmod(F.xxhash64("component"), F.ceil(F.col("size") / BLOCK))
    block = F.when(alone, F.xxhash64("component", salt)).otherwise(shelf)
    large = large.select("node", "sig", "component", block.alias("block"), F.when(alone, F.col("component")).alias("of"))
    blocks = materialize(large.groupBy("sig").agg(F.collect_set(F.struct("block", F.coalesce("of", F.lit(-1)).alias("of"))).alias("blocks")), "jaccard-blocks")
    large = large.join(blocks, "sig").withColumn("other", F.explode("blocks"))
    large = large.where(F.col("of").isNull() | (F.col("of") != F.col("other.of")))
    large = large.select("node", "sig", "component", F.least("block", "other.block").alias("i"), F.greatest("block", "other.block").alias("j"))
    count = max(1, small.count() // (8 * BLOCK))  # units of small lists
    few = F.pmod(F.xxhash64("sig"), F.lit(count))
    units = small.withColumn("unit", few).unionByName(large.withColumn("unit", F.xxhash64("sig", "i", "j")))

    def unit(table: pa.Table) -> pa.Table:
        out = []
        node, part = (table.column(c).to_numpy() for c in ("node", "component"))
        key = np.stack([table.column(c).to_numpy() for c in ("sig", "i", "j")])
        size, sketch = table.column("n").to_numpy(), table.column("sketch")
        _, which = np.unique(key, axis=1, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        edge = np.flatnonzero(np.diff(which.ravel()[order], prepend=-1, append=-1))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            at = order[lo:hi]
            if len(at) > 1:
                i, j = possible_pairs([sketch[int(k)].as_py() for k in at], size[at], part[at], config)
                out.append(np.sort(np.stack([node[at[i]], node[at[j]]]), axis=0))
        a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    found = sets.select("node", "n", "sketch").join(units, "node").groupBy("unit").applyInArrow(unit, "a long, b long")
    return verify(materialize(found.distinct(), "jaccard-pairs"), whole, config)


def second_round(met: DataFrame, best: DataFrame, known: DataFrame, part: DataFrame, sets: DataFrame, whole: Whole, config: JaccardConfig) -> DataFrame:
    """Links between members of lists (sig, node) beside those with a list's best one; known: its (a, b, linked) for near pairs."""
    ranked = met.join(best, "sig").where("node != best").select("sig", "node", "best", F.least("node", "best").alias("a"), F.greatest("node", "best").alias("b"))
    spark, before = met.sparkSession, written()
    rows = ranked.join(known, ["a", "b"], "left").select("sig", "node", "best", F.when(F.col("linked"), 2).when(F.col("linked").isNotNull(), 1).otherwise(0).alias("state"))
    rows = materialize(rows, "jaccard-states")
    near = materialize(rows.where("state = 1").select("sig", "best").distinct(), "jaccard-near")
    beside = F.xxhash64("sig", F.lit("near")).alias("sig")
    lists = rows.where("state < 2").select("sig", "node")
    lists = lists.unionByName(rows.where("state > 0").join(near.select("sig"), "sig").select(beside, "node")).unionByName(near.select(beside, F.col("best").alias("node")))
    ready, cheap = [], 2 * BLOCK * BLOCK
    for level in range(LEVELS + 1):
        rows = still_open(lists, part)
        discard_since(spark, before, keep=1)  # what the lists were made from
        before = written()
        many = rows.where(F.col("cost") > cheap)
        if level == LEVELS or many.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.where(F.col("cost") <= cheap))
        lists = dealt_again(many, whole, level, config)
    out = ready[0]
    for rows in ready[1:]:
        out = out.unionByName(rows)
    return across(out, sets, whole, config)


def jaccard_groups(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id, and class_id (smallest id with the same set) per row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = materialize(keyed(docs, config), "jaccard-rows")
    before = written()
    classes = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"))
    small = rows.where(F.col("n") < MAX_LIGHT + 8).groupBy("n").count().collect()
    light = boundary({r["n"]: r["count"] for r in small if r["n"] > 0}, config)

    # lists in which two classes meet; k1 alone stands for a class until it is joined to its node
    elements = rows.where(F.col("n") >= MAX_LIGHT + 8).agg(F.sum("n")).first()[0] or 0
    expected = expected_rows({r["n"]: r["count"] for r in small if r["n"] > 0}, elements, light, config)
    tasks = max(spark.sparkContext.defaultParallelism, -(-expected // (PARTS * LIST_ROWS)))
    named = classes.where("node is not null").select("k1", "node", "n")
    met = None
    for part in range(PARTS):
        sigs = shared(listed(docs, light, config, part), tasks)
        found = materialize(sigs.join(named, "k1").select("sig", "node", "n"), "jaccard-met")
        met = found if met is None else met.unionByName(found)
    first = written()
    size = materialize(met.groupBy("sig").agg(F.count(F.lit(1)).alias("met")), "jaccard-sizes")

    # the sketches of the classes that met another one
    weight = materialize(met.join(size, "sig").groupBy("node").agg(F.sum("met").alias("weight")), "jaccard-nodes")
    discard_since(spark, first, keep=1)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.groupBy("node").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            found = [s for _, _, sets in _sets(batch, config) for s in sets]
            yield pa.record_batch({
                "node": batch.column("node"), "n": pa.array([len(s) for s in found], pa.int64()),
                "sketch": pa.array([parity_sketch(s) for s in found], pa.binary()),
            })

    made, nodes = "node long, n long, sketch binary", weight.select("node")
    if nodes.count() <= BROADCAST_ROWS:
        sets = texts.join(F.broadcast(nodes), "node", "left_semi").mapInArrow(run, made)
    else:  # sketches are shorter than texts to shuffle
        sets = texts.mapInArrow(run, made).join(nodes, "node", "left_semi")
    sets = materialize(sets, "jaccard-sketches")

    def whole(nodes: DataFrame) -> DataFrame:
        return whole_sets(texts, nodes, config)

    # first round: every member of a list with its best-connected member
    best = met.join(weight, "node").groupBy("sig").agg(F.max(F.struct("weight", "node", "n")).alias("best"))
    best = materialize(best.select("sig", F.col("best.node").alias("best"), F.col("best.n").alias("best_n")), "jaccard-best")
    ranked = met.join(best, "sig").where("node != best")
    fits = config.den * F.least("n", "best_n") >= (2 * config.num - config.den) * F.greatest("n", "best_n")
    pairs = ranked.where(fits).select(F.least("node", "best").alias("a"), F.greatest("node", "best").alias("b")).distinct()
    first = written()
    known = materialize(sketched(materialize(pairs, "jaccard-pairs"), sets, config), "jaccard-pairs")
    discard_since(spark, first, keep=1)
    edges = verify(known.where("may").select("a", "b"), whole, config)
    known = known.select("a", "b").join(edges.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked"))

    # second round: what the first one leaves open
    part = materialize(components(edges, weight.select("node")), "jaccard-components")
    more = second_round(met.select("sig", "node"), best.select("sig", "best"), known, part, sets, whole, config)

    found = materialize(components(edges.unionByName(more), classes.where("node is not null").select("node").distinct()), "jaccard-components")
    discard_since(spark, before, keep=1)
    keyed_class = classes.join(found, "node", "left").select("k1", "k2", F.col("n").alias("size"), "node", "component")
    out = rows.join(keyed_class, (rows["k1"] == keyed_class["k1"]) & (rows["k2"] == keyed_class["k2"]) & (rows["n"] == keyed_class["size"]), "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("node", "doc_id").alias("class_id"),
    )


def keep_first_of_groups(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One document of each group: the one with the smallest id.

    Rows without an id belong to no group and stay; of rows that share the id
    that stays, one is kept. Other columns are kept, whatever their names.
    """
    times, name, rank = (fresh(docs.columns, k) for k in ("times", "id", "rank"))
    groups = jaccard_groups(docs, config).where("doc_id is not null")
    ids = groups.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias(times))
    kept = docs.join(ids.where("doc_id = c").select(F.col("doc_id").alias(name), times), F.col("doc_id").cast("long") == F.col(name))
    once = kept.where(F.col(times) == 1).drop(name, times)
    first = Window.partitionBy(name).orderBy(F.xxhash64("text"), "text")
    again = kept.where(F.col(times) > 1).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(name, times, rank)
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS items FROM w),
n AS (SELECT doc_id, items, CAST(len(items) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, n, unnest(items) AS item FROM n),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.item = b.item AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
walk(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT walk.a, links.b FROM walk JOIN links ON links.a = walk.b),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, part.component_id,
  CASE WHEN n.n > 0 THEN min(n.doc_id) OVER (PARTITION BY items) ELSE n.doc_id END AS class_id
FROM n JOIN part ON n.doc_id = part.doc_id
"""
