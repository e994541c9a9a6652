"""Connected components of the levels of categorical columns, on the cluster: the driver gets numbers only.

Two levels are tied where a row holds both. The column of most levels is the hub:
rows are dealt by it, and each task reduces the ties among all other levels to a
forest, which is never larger than they are. Forests are merged until one is left;
where there are too many levels for one task, alternating large-star and
small-star rounds (Kiveris et al., 2014) settle the forests' edges instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one task takes in before it reduces them, and about the rows dealt to a task.
TASK_ROWS = 1 << 20
#: Most levels (beside the hub's) whose forest one task holds.
LOCAL_LEVELS = 4_000_000
MERGED = 8
MAX_ROUNDS = 60
EDGE = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes that are not the smallest, for edges (a, b)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = root != np.arange(len(names))
    return names[other], names[root[other]]


def _sent(a: np.ndarray, b: np.ndarray):
    for lo in range(0, len(a), 65536):
        yield pa.record_batch({"a": pa.array(a[lo : lo + 65536]), "b": pa.array(b[lo : lo + 65536])})


def _filled(batches, columns: Sequence[str]):
    """Columns of the batches in runs of ``TASK_ROWS`` or more rows."""
    held, n = [[] for _ in columns], 0
    for batch in batches:
        for one, c in zip(held, columns, strict=True):
            one.append(batch.column(c).to_numpy())
        n += len(batch)
        if n >= TASK_ROWS:
            yield [np.concatenate(x) for x in held]
            held, n = [[] for _ in columns], 0
    if n:
        yield [np.concatenate(x) for x in held]


def _merge(batches):
    a = b = np.zeros(0, np.int64)
    for x, y in _filled(batches, ["a", "b"]):
        a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
    yield from _sent(a, b)


def _ties(count: int):
    """Forests of the columns n0 .. of rows with the same hub; a task remembers one node of each hub level."""

    def run(batches):
        a = b = hubs = first = np.zeros(0, np.int64)
        for hub, *nodes in _filled(batches, ["hub", *[f"n{i}" for i in range(count)]]):
            hub, node = np.concatenate([hubs, hub]), np.concatenate([first, nodes[0]])
            hubs, at, which = np.unique(hub, return_index=True, return_inverse=True)
            first = node[at]
            tied = [(node, first[which]), *[(nodes[0], other) for other in nodes[1:]]]
            a, b = forest(np.concatenate([a, *[x for x, _ in tied]]), np.concatenate([b, *[y for _, y in tied]]))
        yield from _sent(a, b)

    return run


def _settled(edges: DataFrame) -> DataFrame:
    """(node, smallest node of its component) as edges, by star rounds that each are a few shuffles."""
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(down, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = small.unionByName(down.select("a", F.col("m").alias("b"))).distinct().localCheckpoint()
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges
        seen = state
    raise RuntimeError("connected components did not settle")


def _whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def level_components(df: DataFrame, groups: Sequence[str], n: int) -> tuple[int, int]:
    """Number of components, and of levels of all columns together, in n rows; no value is null."""
    sizes = {g: df.select(g).distinct().count() for g in groups}
    levels = sum(sizes.values())
    if len(groups) < 2:
        return levels, levels
    hub = max(groups, key=lambda g: sizes[g])
    others = [g for g in groups if g != hub]
    nodes = levels - sizes[hub]

    def hashed(g, salt):
        return F.xxhash64(F.lit(g), F.lit(salt), F.col(g))

    def codes(salt) -> list[Column]:
        # several columns have one space of numbers, so theirs are always hashed
        plain = len(others) == 1 and _whole(df, others[0])
        rest = [F.col(g).cast("long") if plain else hashed(g, salt) for g in others]
        return [(F.col(hub).cast("long") if _whole(df, hub) else hashed(hub, salt)).alias("hub"), *[c.alias(f"n{i}") for i, c in enumerate(rest)]]

    for salt in range(4):
        rows = df.select(*codes(salt))
        if _whole(df, hub) and len(others) == 1 and _whole(df, others[0]):
            break
        one = rows.select(F.explode(F.array(*[f"n{i}" for i in range(len(others))])).alias("n")).distinct().count()
        if one == nodes and rows.select("hub").distinct().count() == sizes[hub]:
            break
    else:
        raise RuntimeError("hashes of levels collide")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    edges = rows.repartition(tasks, "hub").mapInArrow(_ties(len(others)), EDGE)
    if nodes > LOCAL_LEVELS:
        tied = _settled(edges).select("a").distinct().count()
    else:
        while tasks > 1:
            tasks = -(-tasks // MERGED)
            edges = edges.localCheckpoint().coalesce(tasks).mapInArrow(_merge, EDGE)
        tied = edges.count()
    return nodes - tied, levels
