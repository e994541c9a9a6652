"""Shared pieces: shared-folder tables, vectorised byte hashing and word scanning.

Texts are handled as the raw UTF-8 buffers of Arrow string columns, so counting
and hashing run in numpy over many documents at once and never loop over
characters in Python.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of rows of one Arrow batch handed to Python (bounds worker memory).
ARROW_ROWS = 512
#: And of its bytes; a longer row is a batch of its own.
ARROW_BYTES = 4 << 20
#: Bytes of text worked on at once inside a batch; a longer text is one piece of its own.
PIECE_BYTES = 1 << 20
#: Whether an execution's shuffle files are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_rng = np.random.Generator(np.random.PCG64(20240501))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and
    everything runs in one process (as in tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scatterlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(columns: list[str], stem: str) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken, n = {c.lower() for c in columns}, 0
    while f"{stem}_{n}" in taken:
        n += 1
    return f"{stem}_{n}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, cutting its lineage.

    Its shuffle files go as soon as it is written. Spark alone keeps them until the
    driver collects its garbage, which waits for the driver's memory, not for the disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scatterlake/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that this driver has written in the shared folder and not discarded.
_written: list[str] = []


def note_written(path: str) -> None:
    """Have a table that was written in another way discarded like the others."""
    _written.append(path)


def written() -> list[str]:
    return list(_written)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables; only for callers that know that what is built on them has been written."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)


def discard_since(spark: SparkSession, before: list[str], keep: int = 0) -> None:
    """Delete the tables that were written since ``before``, but for the last ``keep``."""
    made = [x for x in written() if x not in before]
    discard(spark, made[: len(made) - keep])


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes that go to Python at once, for the session.

    A batch is held whole in a worker, and rows may be long. All operators share the
    bounds, so a lazy result does not depend on what was built after it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, divisor: int):
    """crc32 of the decimal text of an integer column, modulo ``divisor`` (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, kind, n + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(raw: np.ndarray, offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``most`` bytes: (first, end, bytes, offsets)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_pow: dict[str, np.ndarray] = {"b": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_pow["b"]) <= n:
        m = 1 << int(n).bit_length()
        for key, base in (("b", _BASE), ("i", _BASE_INV)):
            out = np.full(m + 1, base, np.uint64)
            out[0] = 1
            _pow[key] = np.cumprod(out, dtype=np.uint64)
    return _pow["b"][: n + 1], _pow["i"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """H with H[j] = sum over k < j of code(raw[k]) * base**k, modulo 2**64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * powers(len(raw))[0][: len(raw)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings [start, end), the same wherever they stand."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of documents laid end to end: start, end, document."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    body = ~IS_SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = body.copy()
    start[1:] &= ~body[:-1] | first[1:n]
    stop = body.copy()
    stop[:-1] &= ~body[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def sums_by_document(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's range; starts has n+1 entries."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


LOCAL_EDGES = 1_000_000


def _solve_locally(batches):
    """(node, smallest node of its component) of all edges of one task."""
    ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not ends:
        return
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    for lo in range(0, len(names), 65536):
        yield pa.record_batch({"a": pa.array(names[lo : lo + 65536]), "m": pa.array(names[root[lo : lo + 65536]])})


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node: (node, component), by alternating
    large-star and small-star rounds (Kiveris et al., 2014).

    ``edges`` has long columns ``a`` and ``b``, ``nodes`` has ``node``. Up to
    ``LOCAL_EDGES`` distinct edges (16 MB) are solved in one task. Beyond, every round
    is a shuffle of the edges and is written to the shared folder, so that no link
    is ever collected and no lineage grows. Hubs are handled by grouped minima and
    by joins, never by collecting a neighbourhood in one task.
    """
    cur = edges.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    before = written()
    cur = materialize(cur, "edges")
    count = cur.count()
    if not count:
        return nodes.select("node", F.col("node").alias("component"))
    if count <= LOCAL_EDGES:
        label = cur.repartition(1).mapInArrow(_solve_locally, "a long, m long")
        return nodes.join(label, nodes["node"] == label["a"], "left").select("node", F.coalesce("m", "node").alias("component"))
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = star.where("a != b").distinct()
        down = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        cur = nxt
        discard_since(cur.sparkSession, before, keep=1)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("connected components did not settle")
    label = cur.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(label, nodes["node"] == label["a"], "left").select("node", F.coalesce("m", "node").alias("component"))
