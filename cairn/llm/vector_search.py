"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is coded against the centroid of its cell: the residual, of length 1,
is rotated at random into D' dimensions and only the signs are kept. With x the
code as a unit vector and a = <x, residual>, <x, v> / a estimates the inner
product of the residual with any v, off by about sqrt((1 - a^2) / a^2) |v| /
sqrt(D' - 1) times a normal deviate. The packed bits meet queries of four bits a
dimension by AND and population counts; two scalars, the residual's length and
a, make of that an estimate and its error bound. Whatever could take one of a
query's places by its bound has its inner product worked out from the vectors.

Rows come to queries in levels, each 16 times the one before: a small level
finds good scores, which the larger ones must reach, so what leaves a task
stays small at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import remembered, stored

SAMPLE = 4096  #: vectors, about, that centroids are fitted on; also the first level
CELLS, CELL_ROWS = 256, 2048  #: most cells, which every task holds; rows of a cell, about, below that
BLOCK, QUERIES = 4096, 2048  #: vectors of a cell, and queries, that meet in a task
DEVIATES = 3.0  #: error bound in standard deviations: about one neighbour in 700 lies beyond
SHORT_CODE = 256  #: bits of a code, where four a dimension are fewer than that or the dimensions are
GROWTH = 16  #: each level to the one before
NO_ID = (1 << 63) - 1  #: a null id, which loses ties to any other
FOUND = "array<struct<away: double, id: bigint>>"  #: negative scores, so that it sorts nearest first


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """`id, dim, node, vec` of the rows that take part: `vec` as doubles, `node`
    its hash. Null and zero vectors and those with null or non-finite
    components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, dims, nodes, vecs = [], [], [], []
            for i, v in enumerate(b.column(1)):
                if v.is_valid and len(v) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                        take.append(i), dims.append(len(x)), nodes.append(xxhash.xxh3_128_digest(raw)), vecs.append(raw)
            ids = b.column(0).take(pa.array(take, pa.int64())).fill_null(NO_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())], ["id", "dim", "node", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(run, "id long, dim int, node binary, vec binary")


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """Each vector once, with its `most` smallest ids: more can't be returned
    for any query. A vector may be that of any share of the rows."""
    part = F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")
    place = F.row_number().over(Window.partitionBy("node", "_part").orderBy("id"))
    few = rows.select("node", "id", part.alias("_part")).withColumn("_k", place).filter(F.col("_k") <= most)
    ids = few.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids"))  # of 64 parts
    return rows.groupBy("node").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec")).join(ids, "node")


def _matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Of k-means over the sample; cells that lose all rows are left as they were."""
    c = x[np.arange(k) * len(x) // k].copy()
    for _ in range(rounds if k > 1 else 1):
        own = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        for j in np.unique(own):
            c[j] = x[own == j].mean(axis=0)
    return c


def rotation(dim: int) -> np.ndarray:
    """Orthonormal columns into the code's dimensions, the same in all tasks."""

    def make() -> dict:
        return {}

    held = remembered("rotations", make)
    if dim not in held:
        length = 64 * -(-max(dim, min(4 * dim, SHORT_CODE)) // 64)
        held[dim] = np.linalg.qr(np.random.default_rng(dim).standard_normal((length, dim)))[0]
    return held[dim]


@dataclass
class Index:
    """`rows`: dim, cell, level, node, vec, ids, code (packed signs), `far` (the
    residual's length), `a` (its product with the code), `with_c` (the vector's
    product with the centroid). `centroids` by dimension."""

    rows: DataFrame
    centroids: dict[int, np.ndarray]
    levels: int
    top: int


def build_index(vectors: DataFrame, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    """Codes of every row that takes part. Centroids are fitted on about
    `SAMPLE` vectors, drawn by hash; nothing else is sampled."""
    nodes = stored(distinct_vectors(stored(usable(vectors, id_col, vec_col), "usable"), top + 1), "nodes")
    n = max(1, nodes.count())
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) * (n / 2.0**40)
    levels = 1 + max(0, math.ceil(math.log(n / SAMPLE, GROWTH)))
    level: Column = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        level = F.when(place < SAMPLE * GROWTH**k, k).otherwise(level)
    nodes = nodes.withColumn("level", level)
    drawn: dict[int, list[tuple[bytes, bytes]]] = {}
    for r in nodes.filter("level = 0").select("dim", "node", "vec").collect():  # the sample
        drawn.setdefault(r["dim"], []).append((bytes(r["node"]), bytes(r["vec"])))
    total, cells = sum(map(len, drawn.values())), min(CELLS, math.ceil(n / CELL_ROWS))
    centroids = {}
    for dim, own in drawn.items():
        x = np.frombuffer(b"".join(v for _, v in sorted(own))).reshape(len(own), dim)
        centroids[dim] = fit_centroids(x, max(1, min(len(own), cells * len(own) // total)))
    held = nodes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in np.unique(b.column("dim").to_numpy()).tolist():
                part = b.filter(pa.compute.equal(b.column("dim"), dim))
                x, c = _matrix(part.column("vec")), held.value.get(dim)
                c = np.zeros((1, dim)) if c is None else c  # a dimension that the sample has not met
                cell = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
                r = x - c[cell]
                far = np.sqrt((r * r).sum(axis=1))
                turned = (r / np.maximum(far, 1e-300)[:, None]) @ rotation(dim).T
                a = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
                codes = np.packbits(turned > 0, axis=1, bitorder="little")
                added = [pa.array(cell, pa.int32()), pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(far), pa.array(np.where(far > 0, a, 1.0)), pa.array((x * c[cell]).sum(axis=1))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, "cell", "code", "far", "a", "with_c"])

    schema = "node binary, dim int, vec binary, ids array<bigint>, level int, cell int, code binary, far double, a double, with_c double"
    return Index(stored(nodes.mapInArrow(run, schema), "codes"), centroids, levels, top)


def estimates(q: np.ndarray, c: np.ndarray, code: np.ndarray, far: np.ndarray, a: np.ndarray, with_c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries and coded vectors of a cell, and
    their error bounds."""
    turned = (q - c) @ rotation(q.shape[1]).T
    length = turned.shape[1]
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-300)
    levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    met = np.zeros((len(q), len(code)), np.float32)
    for bit in range(4):
        plane = np.packbits((levels >> bit) & 1, axis=1, bitorder="little").view(np.uint64)
        count = np.zeros(met.shape, np.uint16)
        for w in range(code.shape[1]):
            count += np.bitwise_count(plane[:, w, None] & code[None, :, w])
        met += count * np.float32(1 << bit)
    ones = np.bitwise_count(code).sum(axis=1)
    dot = (2 * (step[:, None] * met + low[:, None] * ones) - turned.sum(axis=1)[:, None]) / math.sqrt(length)
    rest = np.sqrt((turned * turned).sum(axis=1))
    spread = far * np.sqrt(np.maximum(1 - a * a, 0)) / a / math.sqrt(max(1, length - 1))
    error = DEVIATES * (spread * rest[:, None] + (far / a) * (step / math.sqrt(12))[:, None])
    return far / a * dot + with_c + (q @ c - c @ c)[:, None], error + 1e-9 * (1 + far * rest[:, None])


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of q and j of x, component after component."""
    out = np.zeros(len(i))
    for u, v in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(x.T), strict=True):
        out += u[i] * v[j]
    return out


def _meet(centroids, top: int):
    """What a block of queries finds in a block of a cell: for each query with
    any, its nearest, at least as near as what it holds."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.filter(pa.compute.is_valid(group.column("q")))
        rows = group.filter(pa.compute.is_null(group.column("q")))
        out: tuple[list, list] = ([], [])
        if len(asks) and len(rows):
            dim, cell = group.column("dim")[0].as_py(), group.column("cell")[0].as_py()
            c = centroids.value[dim][cell] if dim in centroids.value else np.zeros(dim)
            x, code = _matrix(rows.column("vec")), _matrix(rows.column("code"), np.uint64)
            far, a, with_c = (rows.column(k).to_numpy() for k in ("far", "a", "with_c"))
            ids, nodes = rows.column("ids").to_pylist(), rows.column("node").to_pylist()
            qs, least, keys, own, own_node = _matrix(asks.column("vec")), asks.column("least").to_numpy(), asks.column("q").to_pylist(), asks.column("id").to_pylist(), asks.column("node").to_pylist()
            for s in range(0, len(qs), 128):
                q = qs[s : s + 128]
                guess, error = estimates(q, c, code, far, a, with_c)
                floor = least[s : s + 128].copy()
                if len(rows) > top + 1:  # one of which may be the query's own row
                    sure = np.partition(guess - error, len(rows) - top - 1, axis=1)[:, len(rows) - top - 1]
                    floor = np.maximum(floor, sure)
                i, j = np.nonzero(guess + error >= floor[:, None])
                score = products(q, x, i, j)
                keep = score >= least[s : s + 128][i]
                i, j, score = i[keep], j[keep], score[keep]
                cut = np.searchsorted(i, np.arange(len(q) + 1))
                for k in range(len(q)):
                    mine, sc = j[cut[k] : cut[k + 1]], score[cut[k] : cut[k + 1]]
                    if len(sc) > top + 1:
                        near = sc >= np.partition(sc, len(sc) - top - 1)[len(sc) - top - 1]
                        mine, sc = mine[near], sc[near]
                    found = []
                    for r, y in zip(mine.tolist(), sc.tolist(), strict=True):
                        held = ids[r]
                        if nodes[r] == own_node[s + k] and own[s + k] in held:
                            held = held.copy()
                            held.remove(own[s + k])  # its own row; another of the same id stays
                        found += [(-y, v) for v in held]
                    if found:
                        out[0].append(keys[s + k])
                        out[1].append([{"away": y, "id": v} for y, v in sorted(found)[:top]])
        kind = pa.list_(pa.struct([("away", pa.float64()), ("id", pa.int64())]))
        return pa.table({"q": pa.array(out[0], pa.int64()), "found": pa.array(out[1], kind)})

    return run


def _routed(asks: DataFrame, index: Index, reach: dict[tuple[int, int], float]) -> DataFrame:
    """Each query once for every cell of this level that may hold a vector as
    near as its last place: of o in a cell, <q, o> <= <q, c> + |q| |o - c|."""
    centroids = asks.sparkSession.sparkContext.broadcast(index.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in np.unique(b.column("dim").to_numpy()).tolist():
                cells = sorted(c for d, c in reach if d == dim)
                if not cells:
                    continue
                part = b.filter(pa.compute.equal(b.column("dim"), dim))
                q, least = _matrix(part.column("vec")), part.column("least").to_numpy()
                c = centroids.value.get(dim)
                c = (np.zeros((1, dim)) if c is None else c)[cells]
                bound = q @ c.T + np.sqrt((q * q).sum(axis=1))[:, None] * np.array([reach[dim, k] for k in cells])
                i, j = np.nonzero(bound + 1e-9 * np.abs(bound) >= least[:, None])
                out = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.array(cells, np.int32)[j])], [*out.schema.names, "cell"])

    return asks.mapInArrow(run, "q long, id long, dim int, node binary, vec binary, least double, cell int")


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """`query_id`, `rank` (int, from 1), `vec_id`, `score` (double): of each row
    of `queries` the `index.top` rows of the index with the largest inner
    product, but for its own row; all, if fewer. Equal scores go by ascending
    id, null ids last.

    Null and zero vectors, and those with null or non-finite components, take
    no part on either side; vectors of another dimension are no candidates.
    Rows that repeat an id or a vector are rows of their own. Other columns are
    not read; empty tables give no rows.

    Scores are the vectors' own products, summed component by component. What
    can be missed is a row beyond its error bound (`DEVIATES`). Queries meet
    cells in blocks; cells that a bound rules out are not visited. Equal
    vectors are one row of the index, so copies cost nothing.
    """
    top = index.top
    asks = usable(queries, id_col, vec_col).withColumn("q", F.monotonically_increasing_id())
    asks = stored(asks, "asks")
    n_asks = asks.count()
    state = None
    centroids = asks.sparkSession.sparkContext.broadcast(index.centroids)
    for level in range(index.levels):
        rows = index.rows.filter(F.col("level") == level)
        cells = rows.groupBy("dim", "cell").agg(F.max("far").alias("reach"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        cells = stored(cells, "cells")  # as many as there are centroids
        reach = {(r["dim"], r["cell"]): r["reach"] for r in cells.collect()}
        last = F.lit(-math.inf) if state is None else F.when(F.size("found") >= top, -F.col("found")[top - 1]["away"]).otherwise(F.lit(-math.inf))
        held = asks if state is None else asks.join(state, "q", "left")
        routed = _routed(held.select("q", "id", "dim", "node", "vec", last.alias("least")), index, reach)
        parts = max(1, math.ceil(n_asks / QUERIES))
        own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
        none = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
        ask_side = routed.join(F.broadcast(cells.select("dim", "cell", "blocks")), ["dim", "cell"]).select(
            "dim", "cell", own("q", F.lit(parts)).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "q", "id", "least", "node", "vec",
            *none(("code", "binary"), ("far", "double"), ("a", "double"), ("with_c", "double"), ("ids", "array<bigint>")),
        )
        row_side = rows.join(F.broadcast(cells.select("dim", "cell", "blocks")), ["dim", "cell"]).select(
            "dim", "cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"), own("node", F.col("blocks")).alias("j"),
            *none(("q", "long"), ("id", "long"), ("least", "double")), "node", "vec", "code", "far", "a", "with_c", "ids",
        )
        met = ask_side.unionByName(row_side).groupBy("dim", "cell", "i", "j").applyInArrow(_meet(centroids, top), f"q long, found {FOUND}")
        met = met if state is None else met.unionByName(state)
        state = stored(met.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, top).alias("found")), "nearest")
    out = asks.select("q", F.col("id").alias("query_id")).join(state, "q").select("query_id", F.posexplode("found").alias("k", "f"))
    real = lambda c: F.when(c < NO_ID, c)
    return out.select(real(F.col("query_id")).alias("query_id"), (F.col("k") + 1).cast("int").alias("rank"), real(F.col("f.id")).alias("vec_id"), (-F.col("f.away")).alias("score"))
