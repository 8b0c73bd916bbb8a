"""Embedding near-deduplication as an exact metric range join.

On unit vectors cosine >= c is Euclidean distance <= e = sqrt(2 - 2c). Pivots
partition the vectors, each to its nearest. If x of pivot p and y of pivot q
are within e, the triangle inequality keeps y within e of the hyperplane
halfway between p and q; so y is also sent, as a guest, to each cell of a lower
pivot whose boundary is that near, and cells join on their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import components, spread_join, stored

MOST_PIVOTS = 256  #: what every task holds of pivots: at most so many vectors
BLOCK = 1024  #: vectors of a cell compared with as many at a time
SLACK = 1e-7  #: of boundary distances, above their rounding


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """`id, part, node, unit` of every row: `part` names label and dimension,
    `unit` holds doubles of length 1, `node` hashes both; null where a vector
    can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, nodes, units = [], [], []
            for label, values in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                u = None
                if label is not None and values.is_valid and len(values) and values.values.null_count == 0:
                    x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        u = (x / np.sqrt(x @ x) + 0.0).tobytes()  # no negative zeros
                part = None if u is None else f"{len(u) // 8}:{label}"
                parts.append(part)
                nodes.append(None if u is None else xxhash.xxh3_128_digest(part.encode() + b"\0" + u))
                units.append(u)
            arrays = [b.column(0), pa.array(parts, pa.string()), pa.array(nodes, pa.binary()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "part", "node", "unit"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    return rows.mapInArrow(run, "id long, part string, node binary, unit binary")


def pivots_of(nodes: DataFrame, block: int) -> dict[str, list[bytes]]:
    """Pivots of each part that is worth cutting: by its size, no more than its
    share of `MOST_PIVOTS`. They are drawn by hash, about twice as many as are
    wanted, so neither many parts nor a large one bring more to the driver."""
    counts = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    wanted = F.least(F.ceil(F.col("n") / (2 * block)), F.floor(F.col("n") * MOST_PIVOTS / F.lit(max(1, total)))).cast("long")
    worth = counts.withColumn("wanted", wanted).filter("wanted > 1")  # half of MOST_PIVOTS at most
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("n") < F.col("wanted") * F.lit(2 << 30)
    held: dict[str, list[bytes]] = {}
    for r in nodes.join(F.broadcast(worth), "part").filter(draw).select("part", "wanted", "node", "unit").collect():
        held.setdefault(r.part, []).append((bytes(r.node), bytes(r.unit), r.wanted))
    return {part: [unit for _, unit, _ in sorted(rows)[: rows[0][2]]] for part, rows in held.items()}


def in_cells(nodes: DataFrame, pivots: dict[str, list[bytes]], reach: float) -> DataFrame:
    """`nodes` with `cell` and `guest`: one row at home, one for each cell that
    is visited. A part without pivots is one cell, -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for part, units in pivots.items():
            p = np.frombuffer(b"".join(units)).reshape(len(units), -1)
            held[part] = p, np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
        for b in batches:
            parts, units = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", "unit"))
            take, cells, guest = [], [], []
            for i, (part, raw) in enumerate(zip(parts, units, strict=True)):
                if part not in held:
                    take.append(i), cells.append(-1), guest.append(False)
                    continue
                p, apart = held[part]
                square = 2 - 2 * (p @ np.frombuffer(raw))
                home = int(square.argmin())
                take.append(i), cells.append(home), guest.append(False)
                near = square[:home] - square[home] <= 2 * apart[home, :home] * reach + SLACK
                for q in np.flatnonzero(near):
                    take.append(i), cells.append(int(q)), guest.append(True)
            out = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells, pa.int32()), pa.array(guest, pa.bool_())], [*b.schema.names, "cell", "guest"])

    return nodes.mapInArrow(run, "node binary, part string, unit binary, size long, cell int, guest boolean")


def _compare(least: float):
    """Links between the two sides of one pair of blocks: a row for each vector
    with any, its summed partners and the smallest vector it reaches here."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["left"]], group[~group["left"]]
        own = bool((group["i"] == group["j"]).all())  # a block with itself
        b = a if own else b
        if not len(a) or not len(b):  # a block that the hash left empty
            return pd.DataFrame({"node": [], "links": [], "root": []})
        x, y = (np.frombuffer(b"".join(s["unit"])).reshape(len(s), -1) for s in (a, b))
        hit = x @ y.T >= least
        if own:
            np.fill_diagonal(hit, False)
        names = np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()])
        order = np.argsort(names)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        if own:
            rank[len(a) :] = rank[: len(a)]
        low = rank.copy()
        big = len(names)
        while True:  # smallest name within reach of each
            la, lb = low[: len(a)], low[len(a) :]
            na = np.minimum(la, np.where(hit, lb[None, :], big).min(axis=1, initial=big))
            nb = np.minimum(lb, np.where(hit, na[:, None], big).min(axis=0, initial=big))
            if own:
                na = nb = np.minimum(na, nb)
            new = np.concatenate([na, nb])
            if (new == low).all():
                break
            low = new
        out = [(a["node"], hit @ b["size"].to_numpy(np.int64), hit.any(axis=1), low[: len(a)])]
        if not own:
            out.append((b["node"], hit.T @ a["size"].to_numpy(np.int64), hit.any(axis=0), low[len(a) :]))
        return pd.concat([pd.DataFrame({"node": n[k], "links": c[k], "root": names[order][r[k]]}) for n, c, k, r in out])

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK
) -> DataFrame:
    """One row per row of `vectors`: id, `n_links` (other rows with the same
    label and cosine >= `least` in double precision), `component_id` (smallest
    id reachable over links, itself included), `kept` (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components,
    and vectors without a label or of another dimension, link with nothing.
    Rows that repeat an id are rows of their own in counts. A null id is larger
    than any other. An empty table gives no rows; other columns are not read.

    Equal unit vectors collapse into one node with a count, so a vector that
    fills a third of the table is one row of a cell. Cells are cut into blocks
    and only pairs of blocks meet in a task; from those come a sum and one edge
    for each vector, never its pairs. Each label of two blocks or more has pivots of
    its own, all together `MOST_PIVOTS` at most.
    """
    rows = stored(unit_vectors(vectors, id_col, vec_col, label_col), "units")
    valid = rows.filter("node IS NOT NULL")
    nodes = valid.groupBy("node", "part", "unit").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("rep"))
    nodes = stored(nodes, "nodes")
    pivots = pivots_of(nodes, block)
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    cells = stored(in_cells(nodes.select("node", "part", "unit", "size"), pivots, reach), "cells")

    key = ["part", "cell"]
    counted = cells.groupBy(key).agg(
        F.ceil(F.count_if(~F.col("guest")) / block).cast("int").alias("homes"), F.ceil(F.count_if("guest") / block).cast("int").alias("guests")
    )
    dealt = cells.join(counted, key).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int"))
    home, guest = dealt.filter("NOT guest"), dealt.filter("guest AND homes > 0")
    cols = [*key, "node", "unit", "size"]
    # blocks of a cell are numbered homes first, guests after; pair (i, j), i <= j, has i at home
    later = home.select(*cols, F.lit(True).alias("left"), F.col("own").alias("i"), F.explode(F.expr("sequence(own, homes + guests - 1)")).alias("j"))
    earlier = home.filter("own > 0").select(*cols, F.lit(False).alias("left"), F.explode(F.expr("sequence(0, own - 1)")).alias("i"), F.col("own").alias("j"))
    visits = guest.select(*cols, F.lit(False).alias("left"), F.explode(F.expr("sequence(0, homes - 1)")).alias("i"), (F.col("homes") + F.col("own")).alias("j"))
    met = later.unionByName(earlier).unionByName(visits).groupBy(*key, "i", "j")
    found = stored(met.applyInPandas(_compare(least), "node binary, links long, root binary"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = stored(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "labels")
    named = nodes.select("node", "size", "rep").join(links, "node", "left").join(labels.withColumnsRenamed({"id": "node"}), "node", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "node")), "named")
    smallest = stored(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "smallest")
    named = spread_join(named, smallest, ["component"], "nodes")
    named = stored(named.select("node", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "named")
    linked = spread_join(valid.select("id", "node"), named, ["node"], "size").select("id", "n_links", "component_id")
    alone = rows.filter("node IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
