"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that occurs twice.

1. Winnowing. Every window of ``length`` bytes is assigned to the least hash of
   its k-byte grams, so equal windows meet under an equal gram. Runs of windows
   under one gram are the unit of work; grams that occur once end here.
2. Runs with a recurring gram become segments (the bytes that their windows
   cover). Equal segments collapse to one with a count.
3. Crowded grams are dealt further. Equal windows hold their gram at an equal
   offset, so the segments of a gram with too many of them are cut into ranges of
   offsets, and the bytes that all windows of a range share (its core) join the
   gram's name. Ranges shrink to an eighth until no name is crowded; a range of one
   offset has one segment per name, so every name has a bounded number.
4. Segments are dealt into buckets by name. A bucket parses its segments into
   content-defined phrases, builds the Burrows-Wheeler transform of the phrase
   strings shard by shard, merges the shards by interleave refinement, and reads
   the repeated intervals of every depth off the merged order. A window is its
   bytes before its first phrase, the interval of its whole phrases, and its
   bytes behind the last; windows that agree in all three are equal.
5. Matched windows go back to the texts, whose covered bytes are removed.

Bytes are compared by 64-bit hashes inside a bucket (with the count of windows of
a bucket, not of the corpus, as the size of the birthday problem).

Defined cases: null text is empty; shorter texts keep every byte; rows are
occurrences, so repeated rows of at least ``length`` bytes are removed whole;
long texts are read in chunks and never cut; a null id is carried through; other
columns are kept as they are by :func:`remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import Shard, merge
from .common import discard, discard_since, fresh, materialize, mix, prefix_hash, read_table, small_batches, span_hash, text_buffers, written

CHUNK = 1 << 19
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class RepeatConfig:
    length: int = 400
    gram: int = 32
    #: A phrase ends behind about one in so many 8-byte contexts.
    phrase: int = 32
    #: Bytes of segments that one bucket and one shard aim at.
    bucket_bytes: int = 2 << 20
    shard_bytes: int = 1 << 20
    #: Different segments from which on the runs of a name are dealt further.
    crowd: int = 2000

    def widths(self) -> list[int]:
        """Offsets in a range, level by level."""
        out = [self.length - self.gram + 1]
        while out[-1] > 1:
            out.append(-(-out[-1] // 8))
        return out[1:]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at each position (as many as there are)."""
    n = len(raw) - 31
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    out = words[:n] * _ODD[0]
    for k in range(1, 4):
        out ^= out >> np.uint64(29)
        out += words[8 * k : 8 * k + n]
        out *= _ODD[k]
    out ^= out >> np.uint64(32)
    out *= _ODD[1]
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` values (van Herk's two running minima)."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(raw: np.ndarray, config: RepeatConfig) -> tuple[np.ndarray, ...]:
    """Name, first window, last window, place of the gram and hash of the segment of each run of one text.

    Windows are named by their start.
    """
    found = []
    width = config.length - config.gram + 1
    for lo in range(0, max(0, len(raw) - config.length + 1), CHUNK):
        part = raw[lo : lo + CHUNK + config.length - 1]
        hashed = gram_hashes(part)
        # ties of the leading bits go to the gram further left, which equal windows agree on
        place = np.arange(len(hashed), dtype=np.uint64)
        least = sliding_least((hashed & ~np.uint64(0xFFFFFF)) | place, width) & np.uint64(0xFFFFFF)
        edge = np.flatnonzero(np.diff(least.astype(np.int64), prepend=-1))
        last = np.append(edge[1:], len(least)) - 1
        at = least[edge].astype(np.int64)
        found.append((hashed[at], edge + lo, last + lo, at + lo, span_hash(prefix_hash(part), edge, last + config.length)))
    if not found:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def dealt_further(name: int, segment: bytes, lead: int, width: int, config: RepeatConfig) -> list[tuple[int, int, int, int]]:
    """A segment with its gram at ``lead``, cut into ranges of ``width`` offsets: (name, first byte, length, lead) of each."""
    out, most, windows = [], config.length - config.gram, len(segment) - config.length + 1
    for k in range(max(0, lead - windows + 1) // width, lead // width + 1):
        low, high = k * width, min(most, (k + 1) * width - 1)
        first, last = max(0, lead - high), min(windows - 1, lead - low)
        core = segment[lead - low : lead - high + config.length]
        out.append((_hash(b"%d %d %d " % (name, width, k) + core), first, last - first + config.length, lead - first))
    return out


def matched_windows(segments: list[bytes], counts: np.ndarray, config: RepeatConfig) -> list[np.ndarray]:
    """For each distinct segment, which of its windows are equal to another window."""
    length = config.length
    sizes = np.array([len(s) for s in segments], np.int64)
    # parse into phrases, chunk by chunk; a border depends on the eight bytes before it
    symbols, strings = [], [0]
    w_hash, w_first, w_depth = [], [], []
    chunks, at = [], 0
    while at < len(segments):
        end = at + 1
        total = sizes[at]
        while end < len(segments) and total + sizes[end] <= CHUNK:
            total += sizes[end]
            end += 1
        chunks.append((at, end))
        at = end
    base = 0
    for lo, hi in chunks:
        raw = np.frombuffer(b"".join(segments[lo:hi]), np.uint8)
        off = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        cut = np.zeros(len(raw) + 1, bool)  # a border lies before this byte
        cut[8:] = ((words * _ODD[2]) >> np.uint64(40)) % np.uint64(config.phrase) == 0
        for k in range(8):
            cut[np.minimum(off[:-1] + k, len(raw))] = False
        cut[off[1:]] = False
        borders = np.flatnonzero(cut)
        upto = np.zeros(len(raw) + 2, np.int32)
        np.cumsum(cut, out=upto[1:])  # borders before a byte
        prefix = prefix_hash(raw)
        first = upto[off]  # number of borders before each segment
        # the phrase from a border to the next; the last of a segment wraps round (symbol 0)
        phrase = np.zeros(len(borders), np.uint64)
        if len(borders) > 1:
            phrase[:-1] = span_hash(prefix, borders[:-1], borders[1:]) | np.uint64(1)
        some = first[1:] > first[:-1]
        phrase[first[1:][some] - 1] = 0
        symbols.append(phrase)
        strings += (first[1:] + base).tolist()
        # windows
        own = np.diff(off) - length + 1
        start = np.arange(own.sum()) + np.repeat(off[:-1] - (np.cumsum(own) - own), own)
        one = upto[start + 8]  # index of the first border at or behind the eighth byte
        two = upto[start + length] - 1  # and of the last one before the end
        inside = two >= one
        lead_end = np.where(inside, borders[np.minimum(one, len(borders) - 1)] if len(borders) else 0, start + length)
        tail_start = np.where(inside, borders[np.minimum(np.maximum(two, 0), len(borders) - 1)] if len(borders) else 0, start + length)
        key = span_hash(prefix, start, lead_end) + np.uint64(3) * span_hash(prefix, tail_start, start + length)
        key += (lead_end - start).astype(np.uint64) * _ODD[1] + (start + length - tail_start).astype(np.uint64) * _ODD[2]
        w_hash.append(mix(key))
        w_first.append(np.where(inside, one + base, 0).astype(np.int32))
        w_depth.append(np.where(inside, two - one, -1).astype(np.int32))
        base += len(borders)
    key, first, depth = (np.concatenate(x) for x in (w_hash, w_first, w_depth))
    symbol = np.unique(np.concatenate([[np.uint64(0)], *symbols]), return_inverse=True)[1][1:].astype(np.int32)
    starts = np.array(strings, np.int64)
    deepest = int(depth.max(initial=0))
    if deepest > 0:
        shards, at, per = [], 0, max(1, int(len(segments) * config.shard_bytes / max(1, sizes.sum())))
        while at < len(segments):
            end = min(len(segments), at + per)
            part = starts[at : end + 1]
            if part[-1] > part[0]:
                shards.append(Shard(symbol[part[0] : part[-1]], part - part[0], deepest))
            at = end
        by_depth = np.argsort(depth, kind="stable")
        ends = np.searchsorted(depth[by_depth], np.arange(1, deepest + 2))
        for k, (places, block) in enumerate(merge(shards, deepest), start=1):
            here = by_depth[ends[k - 1] : ends[k]]
            if len(here):
                interval, base = np.empty(len(symbol), np.int32), 0
                for shard, place in zip(shards, places, strict=True):
                    interval[shard.order + base] = block[place]
                    base += len(shard.order)
                key[here] = mix(key[here] + interval[first[here]].astype(np.uint64) * _ODD[3] + np.uint64(k))
    ranked = np.argsort(key)
    same = key[ranked[1:]] == key[ranked[:-1]]
    match = np.zeros(len(key), bool)
    match[ranked[1:][same]] = True
    match[ranked[:-1][same]] = True
    own = sizes - length + 1
    match |= np.repeat(counts > 1, own)
    return np.split(match, np.cumsum(own)[:-1])


def _ranges(flags: np.ndarray) -> np.ndarray:
    """Alternating first and end of the runs of true flags."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).astype(np.int64)


def removed_spans(ranges: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs (first, end) of bytes covered by the windows that start in [ranges[0], ranges[1]), ..."""
    order = np.argsort(ranges[::2], kind="stable")
    first, end = ranges[::2][order], np.maximum.accumulate(ranges[1::2][order] + length - 1)
    border = np.flatnonzero(first[1:] > end[:-1]) + 1
    return np.stack([first[np.append(0, border)], end[np.append(border - 1, len(end) - 1)]], axis=1)


def _stay(data: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for first, end in spans.tolist():
        out.append(data[at:first])
        at = end
    out.append(data[at:])
    return b"".join(out)


def recurring_runs(texts: DataFrame, config: RepeatConfig) -> DataFrame:
    """Runs (gram, key, first, last, lead) whose gram recurs; texts: key, text. ``lead`` is null where the gram is not crowded."""

    def find(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            got = [runs(raw[a:b], config) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            if not got:
                continue
            gram, first, last, at, segment = (np.concatenate([g[k] for g in got]) for k in range(5))
            yield pa.record_batch({
                "gram": pa.array(gram.astype(np.uint64).view(np.int64)), "key": batch.column("key").take(pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))),
                "first": pa.array(first.astype(np.int64)), "last": pa.array(last.astype(np.int64)), "lead": pa.array((at - first).astype(np.int32)),
                "segment": pa.array(segment.astype(np.uint64).view(np.int64)),
            })

    spark = texts.sparkSession
    before = written()
    rows = materialize(texts.mapInArrow(find, "gram long, key binary, first long, last long, lead int, segment long"), "runs")
    # written, so that the join below can split a frequent gram over tasks
    often = materialize(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    made = [x for x in written() if x not in before]
    found = materialize(rows.join(often, "gram"), "runs-again")
    discard(spark, made)
    many = found.where(F.col("n") > config.crowd)
    kinds = many.groupBy("gram", "segment").agg(F.lit(1)).groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"))
    crowded = materialize(kinds.where(F.col("kinds") > config.crowd).select("gram"), "crowded")
    columns = ["gram", "key", "first", "last"]
    alone = F.lit(None).cast("int").alias("lead")
    if crowded.isEmpty():
        return found.select(*columns, alone)
    return found.where(F.col("n") <= config.crowd).select(*columns, alone).unionByName(
        many.join(crowded, "gram", "left_anti").select(*columns, alone)).unionByName(many.join(crowded, "gram", "left_semi").select(*columns, "lead"))


def dealt_levels(crowded: DataFrame, config: RepeatConfig) -> tuple[list[DataFrame], list[DataFrame]]:
    """Segments of crowded names (gram, digest, lead, n, segment), dealt until no name is crowded.

    Returns tables (gram, digest, n, segment) for the buckets, and per level where its
    segments lie in the ones before (digest, parent, shift).
    """
    ready, lies = [], []
    for width in config.widths():

        def further(batches, width=width):
            for batch in batches:
                out = []
                for gram, digest, lead, n, segment in zip(*(batch.column(c).to_pylist() for c in ("gram", "digest", "lead", "n", "segment")), strict=True):
                    for name, first, length, at in dealt_further(gram, segment, lead, width, config):
                        out.append((name - (1 << 63), _digest(segment[first : first + length], name - (1 << 63), at), at, n, digest, first, length))
                cols = list(zip(*out, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["gram", "digest", "lead", "n", "parent", "shift", "length"])

        schema = "gram long, digest binary, lead int, n long, parent binary, shift int, length int"
        parts = materialize(crowded.mapInArrow(further, schema), "dealt")
        # one row per different segment, from any of its parents
        each = parts.groupBy("gram", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("parent", "shift", "length", "lead")).alias("one"))
        names = materialize(each.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1"), "names")
        source = crowded.select(F.col("digest").alias("parent"), "segment")
        kept = each.join(names, "gram").select("gram", "digest", "n", "kinds", "one.*").join(source, "parent")
        kept = materialize(kept.select("gram", "digest", "lead", "n", "kinds", F.expr("substring(segment, shift + 1, length)").alias("segment")), "dealt-segments")
        full = kept.where((F.col("kinds") > config.crowd) & F.lit(width > 1))
        ready.append(kept.where((F.col("kinds") <= config.crowd) | F.lit(width == 1)).select("gram", "digest", "n", "segment"))
        lies.append(parts.select("digest", "parent", "shift"))
        if full.isEmpty():
            break
        crowded = full.select("gram", "digest", "lead", "n", "segment")
    return ready, lies


def _digest(segment: bytes, name: int, lead: int | None) -> bytes:
    """128 bits of a segment, its name and the place of its gram, where that counts."""
    person = b"" if lead is None else int(lead).to_bytes(4, "little")
    return hashlib.blake2b(segment, digest_size=16, salt=name.to_bytes(8, "little", signed=True), person=person).digest()


def _lifted(matched: DataFrame, lies: DataFrame) -> DataFrame:
    """Matched windows of dealt segments, as windows of the segments that they are parts of."""

    def lift(batches):
        for batch in batches:
            out = [(np.frombuffer(r, np.int64) + s).tobytes() for r, s in zip(batch.column("ranges").to_pylist(), batch.column("shift").to_pylist(), strict=True)]
            yield pa.record_batch({"digest": batch.column("parent"), "ranges": pa.array(out, pa.binary())})

    return lies.join(matched, "digest").select("parent", "shift", "ranges").mapInArrow(lift, "digest binary, ranges binary")


def repeated_bytes(docs: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """Each distinct text's key and the alternating first and end of its matched windows (null: none).

    Columns: key (digest of the text), ranges (int64 values as bytes).
    """
    spark = docs.sparkSession
    small_batches(spark)
    before = written()
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text").where(F.octet_length("text") >= config.length)
    # a text's runs: their number is bounded by the length of the text
    by_text = recurring_runs(texts, config).groupBy("key").agg(F.collect_set(F.struct("first", "last", "gram", "lead")).alias("runs"))

    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
    names = ["gram", "digest", "segment", "key", "first", "lead"]

    def send(out):
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def cut(batches):
        sent: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for key, text, found in zip(batch.column("key"), batch.column("text"), batch.column("runs"), strict=True):
                data, key = text.as_py().encode(), key.as_py()
                for gram, first, last, lead in zip(*(found.values.field(c).to_pylist() for c in ("gram", "first", "last", "lead")), strict=True):
                    segment = data[first : last + config.length]
                    digest = _digest(segment, gram, lead)
                    new = digest not in sent
                    if new:
                        if len(sent) >= 200_000:
                            sent.clear()
                        sent.add(digest)
                    out.append((gram, digest, segment if new else None, key, first, lead))
                    if len(out) >= 4096:
                        yield send(out)
                        out = []
            yield send(out)

    joined = texts.join(by_text, "key").select("key", "text", "runs")
    schema = "gram long, digest binary, segment binary, key binary, first long, lead int"
    parts = materialize(joined.mapInArrow(cut, schema), "segments")
    discard_since(spark, before, keep=1)
    plain, crowded = parts.where("lead is null"), parts.where("lead is not null")
    # copies of a segment are counted before the shuffle; its bytes come once for each task that met it
    tally = plain.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n")).withColumn("segment", F.lit(None).cast("binary"))
    bodies = plain.where("segment is not null").select("gram", "digest", F.lit(0).cast("long").alias("n"), "segment")
    lies: list[DataFrame] = []
    if not crowded.isEmpty():
        one = crowded.groupBy("gram", "digest", "lead").agg(F.count(F.lit(1)).alias("n"), F.max("segment").alias("segment"))
        ready, lies = dealt_levels(materialize(one, "crowded-segments"), config)
        for rows in ready:
            bodies = bodies.unionByName(rows)
    size = bodies.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    dealt = tally.unionByName(bodies)
    buckets = max(1, -(-size // config.bucket_bytes))

    def solve(segments: dict[bytes, bytes], counts: dict[bytes, int]) -> pa.RecordBatch:
        names = list(segments)
        flags = matched_windows([segments[d] for d in names], np.array([counts[d] for d in names]), config) if names else []
        found = [(d, _ranges(f).tobytes()) for d, f in zip(names, flags, strict=True) if f.any()]
        return pa.record_batch({"digest": pa.array([d for d, _ in found], pa.binary()), "ranges": pa.array([r for _, r in found], pa.binary())})

    def bucket(batches):
        now, segments, counts = None, {}, {}
        for batch in batches:
            for b, digest, segment, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "digest", "segment", "n")), strict=True):
                if b != now:
                    if segments:
                        yield solve(segments, counts)
                    now, segments, counts = b, {}, {}
                counts[digest] = counts.get(digest, 0) + n
                if segment is not None:
                    segments[digest] = segment
        if segments:
            yield solve(segments, counts)

    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(int(buckets))))
    # buckets pass one after the other through a task, so it holds one at a time, and each segment once
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "digest", "segment", "n")
    matched = dealt.mapInArrow(bucket, "digest binary, ranges binary")
    if lies:
        matched = materialize(matched, "matched")
        for level in reversed(lies):
            matched = matched.unionByName(_lifted(matched, level))
    hits = parts.select("digest", "key", "first").join(matched, "digest").select("key", F.struct("first", "ranges").alias("hit"))

    def gather(batches):
        for batch in batches:
            out = [np.concatenate([np.frombuffer(h["ranges"], np.int64) + h["first"] for h in hits]).tobytes() for hits in batch.column("hits").to_pylist()]
            yield pa.record_batch({"key": batch.column("key"), "ranges": pa.array(out, pa.binary())})

    out = hits.groupBy("key").agg(F.collect_set("hit").alias("hits")).mapInArrow(gather, "key binary, ranges binary")
    out = materialize(out, "ranges")
    discard_since(spark, before, keep=1)
    return out


def with_removals(docs: DataFrame, ranges: str, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """``docs`` with the matched windows of each row (see :func:`repeated_bytes`) in a new column ``ranges``."""
    key = fresh([*docs.columns, ranges], "key")
    found = repeated_bytes(docs, config).select(F.col("key").alias(key), F.col("ranges").alias(ranges))
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return keyed.join(found, key, "left").drop(key)


def digests(docs: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""

    def run(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                data = (text.as_py() or "").encode()
                spans = removed_spans(np.frombuffer(ranges.as_py(), np.int64), config.length) if ranges.is_valid else np.zeros((0, 2), np.int64)
                out.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_stay(data, spans)).hexdigest()))
            cols = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
                "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string()),
            })

    rows = with_removals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "ranges", config)
    return rows.select("doc_id", "text", "ranges").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; other columns stay as they are.

    A cut inside a character drops that character's remaining bytes, so texts stay valid.
    """
    name = fresh(docs.columns, "ranges")

    def run(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text"), batch.column(name), strict=True):
                if text.is_valid and ranges.is_valid:
                    data = _stay(text.as_py().encode(), removed_spans(np.frombuffer(ranges.as_py(), np.int64), config.length))
                    out.append(data.decode("utf-8", "ignore"))
                else:
                    out.append(text.as_py())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.string())).drop_columns([name])

    return with_removals(docs, name, config).mapInArrow(run, docs.schema)


def substring_query(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
