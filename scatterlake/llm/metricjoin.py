"""Embedding near-duplicates: an exact metric range join over pivot cells.

Cosine of at least t is a Euclidean distance of at most r = sqrt(2 - 2t) between
unit vectors. Pivots split the vectors into cells, each vector at home with its
nearest pivot. By the triangle inequality a vector can only have a partner in
another cell if it is within r of the border half-way between the two pivots and
within r of the radius that the cell's own vectors span, so it is copied to
exactly those cells, and every cell is joined on its own. Large cells are joined
in blocks of bounded size. The number of pivots is the one of least estimated
cost on the bounded sample from which pivots are drawn.

A cell returns no pairs: for each vector at home the number of its links, and a
spanning forest of the links for the components. Equal vectors collapse to one
class with a count first.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, are their own component and are kept; vectors of
different lengths never link; a row without id is not compared (no links, null
component, not kept); rows that share an id are one node.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, read_table, small_batches

SLACK = 1e-9


@dataclass(frozen=True)
class RangeJoinConfig:
    cosine: float = 0.9
    #: Vectors drawn (by hash) as possible pivots and to estimate cost.
    sample: int = 2048
    #: Candidate numbers of pivots; the most that is broadcast is max(pivots) vectors per length.
    pivots: tuple[int, ...] = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
    #: Vectors of one side of a block.
    block: int = 4096


def _unit(emb: np.ndarray) -> np.ndarray:
    wide = emb.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)  # so that no square overflows
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    """Rows of one length; a vector is the letter of its type and its components."""
    values = column.to_pylist()
    kind = {b"f"[0]: np.float32, b"d"[0]: np.float64}[values[0][0]]
    return np.frombuffer(b"".join(v[1:] for v in values), kind).reshape(len(values), -1)


def _length(emb: bytes) -> int:
    return (len(emb) - 1) // (4 if emb[:1] == b"f" else 8)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def reach(dist: np.ndarray, between: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """Which cells each vector must be in: its home and those that may hold a partner."""
    home = dist.argmin(axis=1)
    near = dist[np.arange(len(dist)), home]
    gap = between[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        border = np.where(gap > SLACK, (dist**2 - near[:, None] ** 2) / (2 * gap), 0.0)
    out = (border <= r + SLACK) & (dist <= radius[None, :] + r + SLACK)
    out[np.arange(len(dist)), home] = True
    return out


def spread_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first choice of k distinct rows, beginning with the first."""
    chosen, far = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)):
        at = int(far.argmax())
        if far[at] <= 1e-6:
            break
        chosen.append(at)
        far = np.minimum(far, _distances(x, x[at : at + 1])[:, 0])
    return x[chosen]


def choose_pivots(x: np.ndarray, total: int, config: RangeJoinConfig) -> np.ndarray:
    """The pivots of least estimated cost: distances, copies sent, and comparisons in the cells."""
    r = np.sqrt(2 - 2 * config.cosine)
    every = spread_pivots(x, max(config.pivots))
    best, least = every[:1], np.inf
    for k in config.pivots:
        pivots = every[:k]
        dist = _distances(x, pivots)
        home = dist.argmin(axis=1)
        radius = np.full(len(pivots), -np.inf)
        np.maximum.at(radius, home, dist.min(axis=1))
        member = reach(dist, _distances(pivots, pivots), radius, r).sum(axis=0)
        at_home = np.bincount(home, minlength=len(pivots))
        scale = total / len(x)
        cost = total * len(pivots) + 2000.0 * scale * member.sum() + scale * scale * float((member * at_home).sum())
        if cost < least:
            best, least = pivots, cost
        if len(pivots) < k:
            break
    return best


def classes_of(vectors: DataFrame) -> DataFrame:
    """vec_id and emb of each comparable vector: its components in the precision that the table has."""
    kind = "d" if vectors.schema["embedding"].dataType.elementType.typeName() == "double" else "f"

    def run(batches):
        for batch in batches:
            ids, emb = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or not v or any(c is None for c in v):
                    continue
                with np.errstate(over="ignore"):
                    x = np.asarray(v, kind) + np.zeros(1, kind)  # one zero only
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    emb.append(kind.encode() + x.tobytes())
            yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "emb": pa.array(emb, pa.binary())})

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if kind == "d" else "array<float>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, emb binary")


def join_cells(classes: DataFrame, config: RangeJoinConfig = RangeJoinConfig()) -> tuple[DataFrame, DataFrame]:
    """(node, links) and spanning edges (a, b) of all classes (node, cnt, emb)."""
    spark = classes.sparkSession
    r = float(np.sqrt(2 - 2 * config.cosine))
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(config.sample).select("emb").collect()
    by_dim: dict[int, list[bytes]] = {}
    for row in sample:
        by_dim.setdefault(_length(row["emb"]), []).append(bytes(row["emb"]))
    total = classes.count()
    plan = {}
    for dim, rows in by_dim.items():
        x = _unit(_matrix(pa.array(rows, pa.binary())))
        pivots = choose_pivots(x, max(1, total * len(rows) // max(1, len(sample))), config)
        plan[dim] = (pivots, _distances(pivots, pivots))
    shared = spark.sparkContext.broadcast(plan)

    def by_length(batch):
        size = np.array([_length(e) for e in batch.column("emb").to_pylist()], np.int64)
        for dim in np.unique(size).tolist():
            part = batch.filter(pa.array(size == dim))
            pivots, between = shared.value.get(dim, (np.zeros((0, dim)), None))
            if not len(pivots):  # a length that the sample lacks: one cell
                yield dim, part, np.zeros((part.num_rows, 1)), np.zeros((1, 1))
            else:
                yield dim, part, _distances(_unit(_matrix(part.column("emb"))), pivots), between

    def homes(batches):
        for batch in batches:
            for dim, part, dist, _ in by_length(batch):
                yield pa.record_batch({
                    "dim": pa.array([dim] * part.num_rows, pa.int32()), "cell": pa.array(dist.argmin(axis=1), pa.int32()),
                    "dist": pa.array(dist.min(axis=1)),
                })

    radius: dict[int, np.ndarray] = {dim: np.full(len(p), -np.inf) for dim, (p, _) in plan.items()}
    blocks: dict[tuple[int, int], int] = {}
    at_home = classes.select("emb").mapInArrow(homes, "dim int, cell int, dist double")
    for row in at_home.groupBy("dim", "cell").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        radius.setdefault(row["dim"], np.zeros(1))[row["cell"]] = row["far"]
        blocks[row["dim"], row["cell"]] = -(-row["n"] // config.block)
    sizes = spark.sparkContext.broadcast((radius, blocks))

    def copies(batches):
        radius, blocks = sizes.value
        for batch in batches:
            for dim, part, dist, between in by_length(batch):
                member = reach(dist, between, radius[dim], r)
                who, cell = np.nonzero(member)
                home = dist.argmin(axis=1)[who] == cell
                # blocks of a cell: its rows at home, by hash; a cell's members, by hash, meet each of them
                count = np.array([blocks.get((dim, int(c)), 0) for c in cell], np.int64)
                node = part.column("node").to_numpy(zero_copy_only=False)[who].astype(np.uint64)
                hashed = (node * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = hashed.astype(np.int64) % np.maximum(count, 1)
                times = count
                pick = np.repeat(np.arange(len(who)), times)
                yield pa.record_batch({
                    "dim": pa.array([dim] * len(pick), pa.int32()),
                    "cell": pa.array(cell[pick], pa.int32()),
                    "block": pa.array(np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times), pa.int32()),
                    "own": pa.array(np.where(home, own, -1)[pick], pa.int32()),
                    "slice": pa.array((hashed.astype(np.int64) // 7919 % np.maximum(count, 1))[pick], pa.int32()),
                    "node": part.column("node").take(pa.array(who[pick])),
                    "cnt": part.column("cnt").take(pa.array(who[pick])),
                    "emb": part.column("emb").take(pa.array(who[pick])),
                })

    schema = "dim int, cell int, block int, own int, slice int, node long, cnt long, emb binary"
    dealt = classes.mapInArrow(copies, schema)
    # (cell, block of homes, slice of members): both sides of a join unit are of bounded size
    slices = {key: n for key, n in blocks.items() if n > 1}
    if slices:
        table = F.create_map(*[F.lit(x) for (d, c), n in sorted(slices.items()) for x in (f"{d}:{c}", n)])
        n_slices = F.coalesce(F.try_element_at(table, F.concat_ws(":", "dim", "cell")), F.lit(1))
    else:
        n_slices = F.lit(1)
    is_home = F.col("own") == F.col("block")
    units = F.when(is_home, F.sequence(F.lit(0), n_slices - 1)).otherwise(F.array("slice"))
    dealt = dealt.withColumn("unit", F.explode(units)).withColumn("home", is_home).withColumn("member", F.col("slice") == F.col("unit"))

    def cell_join(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        x = _unit(_matrix(table.column("emb")))
        weight = table.column("cnt").to_numpy().astype(np.float64)
        home = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False))
        member = np.flatnonzero(table.column("member").to_numpy(zero_copy_only=False))
        label, links = np.arange(len(node)), np.zeros(len(home))
        single, others = x.astype(np.float32), x[member].astype(np.float32)
        for lo in range(0, len(home), 512):
            rows = home[lo : lo + 512]
            # single precision errs by far less than the margin; what passes is decided in double precision
            i, j = np.nonzero(single[rows] @ others.T >= np.float32(config.cosine - 1e-4))
            exact = np.empty(len(i))
            for at in range(0, len(i), 50_000):
                some = slice(at, at + 50_000)
                exact[some] = np.einsum("ij,ij->i", x[rows[i[some]]], x[member[j[some]]])
            near = (exact >= config.cosine) & (rows[i] != member[j])
            i, j = i[near], member[j[near]]
            links[lo : lo + 512] = np.bincount(i, weight[j], len(rows))
            edge = np.searchsorted(i, np.arange(len(rows) + 1))
            for k in np.flatnonzero(np.diff(edge)):
                met = label[j[edge[k] : edge[k + 1]]]
                mine = label[rows[k]]
                if (met != mine).any():
                    joined = np.union1d(met, mine)
                    label[np.isin(label, joined)] = joined[0]
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({
            "a": pa.array(np.concatenate([node[home], node[tied]])),
            "b": pa.array(np.concatenate([np.full(len(home), -1), node[label[tied]]]), mask=np.arange(len(home) + len(tied)) < len(home)),
            "links": pa.array(np.concatenate([links, np.zeros(len(tied))]).astype(np.int64)),
        })

    found = dealt.groupBy("dim", "cell", "block", "unit").applyInArrow(cell_join, "a long, b long, links long")
    found = materialize(found, "range-join")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return links, found.where("b is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, config: RangeJoinConfig = RangeJoinConfig()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    small_batches(vectors.sparkSession)
    rows = materialize(classes_of(vectors), "vectors")
    classes = materialize(rows.groupBy("emb").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("cnt")), "classes")
    links, edges = join_cells(classes.select("node", "cnt", "emb"), config)
    part = components(edges, classes.select("node").distinct())
    state = classes.join(links, "node", "left").join(part, "node", "left")
    state = state.select("emb", "component", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"))
    found = rows.join(state, "emb").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def metric_join_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


METRIC_JOIN_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS s FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.s * b.s) >= 0.9),
walk(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
  UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b),
part AS (SELECT a AS vec_id, min(b) AS component_id FROM walk GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, part.component_id, e.vec_id = part.component_id AS kept
FROM embeddings e JOIN part USING (vec_id) LEFT JOIN n USING (vec_id)
"""
