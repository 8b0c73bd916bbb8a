"""MinHash near-deduplication with odd sketches.

MinHash samples of a text's word shingles are cut into bands; texts that share
a band are candidates. Each text's samples are also folded into a parity
bitmap (odd sketch): the population count of two bitmaps' XOR estimates how
many samples differ, and only candidates that this leaves possible are
confirmed on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import components, keyed, remembered, salted_join, spread_join, stored

_MIX1, _MIX2, _FOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    words: int = 5  #: of a shingle
    percent: int = 75  #: least similarity of a link
    bands: int = 48
    rows: int = 5  #: of a band: a pair at 0.75 shares none of 48 with probability 2e-6
    bits: int = 2048  #: of an odd sketch
    seed: int = 7
    rounds: int = 0  #: of stars around drawn hubs, after the first
    block: int = 256  #: members of a crowded bucket compared at a time

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """XOR population count that a pair at the least similarity passes but
        once in millions: 5 deviations of the number of samples that differ,
        then 5 of the bits that so many set."""
        p, n = 1 - self.percent / 100, self.bits
        differ = 2 * min(self.samples, self.samples * p + 5 * math.sqrt(self.samples * p * (1 - p)))
        mean = n / 2 * (1 - (1 - 2 / n) ** differ)
        spread = n * n / 4 * ((1 - 4 / n) ** differ - (1 - 2 / n) ** (2 * differ)) + n / 4 * (1 - (1 - 4 / n) ** differ)
        return math.ceil(mean + 5 * math.sqrt(max(0.0, spread)))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """64-bit hashes of words, kept while a task meets them again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: str | None, known: dict, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. `bytes.lower` and
    `bytes.split` touch ASCII only: A-Z, and x20 x09-x0D."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    s = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        s = mix64(s) + h[i : len(h) - k + 1 + i]
    s = np.sort(mix64(s + np.uint64(k)))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def _multipliers(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return rng.integers(0, 1 << 32, p.samples, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, p.samples, dtype=np.uint32)


def min_samples(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples of one set: 32-bit multiply-add of mixed hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048]
        np.minimum(out, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of the pairs (index, sample), as 64-bit words."""
    at = mix64(samples.astype(np.uint64) + np.arange(1, len(samples) + 1, dtype=np.uint64) * _FOLD) % np.uint64(bits)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def band_keys(samples: np.ndarray, p: Params) -> np.ndarray:
    out = np.arange(1, p.bands + 1, dtype=np.uint64) * _FOLD
    for column in samples.reshape(p.bands, p.rows).T:
        out = mix64(out + column)
    return out.view(np.int64)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """`id, n, node, bands, sketch` of every row of `docs(id, text)`. `node`
    hashes the set, equal for equal sets, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = remembered("shingles", _Words), _multipliers(p)
        for batch in batches:
            sizes, keys, bands, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, known, p.words)
                sizes.append(len(h))
                if len(h):
                    m = min_samples(h, a, b)
                    keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                    bands.append(band_keys(m, p))
                    sketches.append(odd_sketch(m, p.bits))
                else:
                    keys.append(None)
                    bands.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["id", "n", "node", "bands", "sketch"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, node binary, bands array<long>, sketch array<long>")


def shingle_sets(texts: DataFrame, p: Params) -> DataFrame:
    """`node, shingles` of `texts(text)`; a node is the hash of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered("shingles", _Words)
        for batch in batches:
            sets = [shingle_hashes(t, known, p.words) for t in batch.column(0).to_pylist()]
            keys = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            arrays = pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), arrays], ["node", "shingles"])

    return texts.select("text").mapInArrow(run, "node binary, shingles array<long>")


def _bits_apart(a: Column, b: Column, p: Params) -> Column:
    """XOR population count, written out word by word so that it compiles into
    the join that uses it."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(p.bits // 64)])


class Sets:
    """Full shingle sets of the nodes asked for so far, each made once, from
    one text of the node."""

    def __init__(self, classes: DataFrame, docs: DataFrame, p: Params):
        self.classes, self.docs, self.p, self.rows = classes, docs, p, None

    def add(self, nodes: DataFrame) -> DataFrame:
        wanted = nodes if self.rows is None else nodes.join(self.rows, "node", "left_anti")
        wanted = stored(self.classes.join(wanted, "node", "left_semi").select("node", F.col("rep").alias("_rep")), "wanted")
        if not wanted.isEmpty():
            ids = wanted.select("_rep").distinct()
            made = shingle_sets(self.docs.join(ids, self.docs["id"].eqNullSafe(ids["_rep"]), "left_semi"), self.p)
            # rows that repeat an id, or have none, bring sets of other nodes and some sets twice
            made = stored(made.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min("shingles").alias("shingles")), "sets")
            self.rows = made if self.rows is None else self.rows.unionByName(made)
        return self.rows

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The `pairs(a, b)`, stored, whose full sets are similar enough; `a` may
        be a hub of any number of them."""
        sets = self.add(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        if sets is None:
            return pairs.limit(0)
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        return salted_join(pairs, left, "a", "b").join(right, "b").filter(_linked(F.col("sa"), F.col("sb"), self.p)).select("a", "b")


def _linked(a: Column, b: Column, p: Params) -> Column:
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= p.percent * (F.size(a) + F.size(b) - common)


def block_links(members: DataFrame, p: Params) -> DataFrame:
    """`a, b` for `members(key, node, component, blocks, own, sketch,
    shingles)`: edges that connect whatever links join nodes of different
    components in a bucket. Block i meets block j of a bucket, i <= j, in one
    run of rows; each node gives an edge at most, its pairs are never rows."""
    cols = ["key", "node", "component", "sketch", "shingles"]
    first = members.select(F.lit(True).alias("left"), F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"), *cols)
    second = members.filter("own > 0").select(F.lit(False).alias("left"), F.explode(F.expr("sequence(0, own - 1)")).alias("i"), F.col("own").alias("j"), *cols)
    dealt = first.unionByName(second).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            c = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            keys = list(zip(c["key"].to_pylist(), c["i"].to_pylist(), c["j"].to_pylist(), strict=True))
            rest = zip(c["left"].to_pylist(), c["node"].to_pylist(), c["component"].to_pylist(), c["sketch"], c["shingles"], strict=True)
            for key, (left, node, component, sketch, shingles) in zip(keys, rest, strict=True):
                if key != at and held:
                    yield from _edges(held, p)
                    held = []
                at = key
                held.append((left, node, component, sketch.values.to_numpy(), shingles.values.to_numpy()))
        if held:
            yield from _edges(held, p)

    return dealt.select("key", "i", "j", "left", "node", "component", "sketch", "shingles").mapInArrow(run, "a binary, b binary").distinct()


def _edges(rows: list[tuple], p: Params) -> Iterator[pa.RecordBatch]:
    x, y = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    y = y or x  # a block with itself
    if len(x) + len(y) < 2 or not x:
        return
    names = {c: k for k, c in enumerate({r[2] for r in rows})}
    cx, cy = (np.array([names[r[2]] for r in side]) for side in (x, y))
    sx, sy = (np.stack([r[3] for r in side]) for side in (x, y))
    near = cx[:, None] != cy[None, :]
    for i in range(len(x)):
        near[i] &= np.bitwise_count(sx[i] ^ sy).sum(axis=1) <= p.most_bits
    if not near.any():
        return
    nx, ny = (np.array([len(r[4]) for r in side]) for side in (x, y))
    common = _common([r[4] for r in x], [r[4] for r in y])
    near &= 100 * common >= p.percent * (nx[:, None] + ny[None, :] - common)
    if not near.any():
        return
    # smallest name that each reaches here
    nodes = [r[1] for r in x] + ([r[1] for r in y] if y is not x else [])
    order = {n: k for k, n in enumerate(sorted(nodes))}
    lx, ly = (np.array([order[r[1]] for r in side]) for side in (x, y))
    while True:
        mx = np.minimum(lx, np.where(near, ly[None, :], len(order)).min(axis=1))
        my = np.minimum(ly, np.where(near, mx[:, None], len(order)).min(axis=0))
        if y is x:
            mx = my = np.minimum(mx, my)
        if (mx == lx).all() and (my == ly).all():
            break
        lx, ly = mx, my
    names = sorted(nodes)
    out = [(r[1], names[k]) for side, low in ((x, lx), (y, ly)) for r, k in zip(side, low.tolist(), strict=True) if r[1] != names[k]]
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])


def _common(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the
    elements that occur on both sides, some columns at a time."""
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(x), len(y)))

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(both, flat)
        hit = (col < len(both)) & (both[np.minimum(col, max(0, len(both) - 1))] == flat) if len(both) else np.zeros(len(flat), bool)
        return row[hit], col[hit]

    (rx, kx), (ry, ky) = places(flat_x, x), places(flat_y, y)
    for at in range(0, len(both), width):
        a, b = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        for m, r, k in ((a, rx, kx), (b, ry, ky)):
            here = (k >= at) & (k < at + width)
            m[r[here], k[here] - at] = 1
        out += a @ b.T
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row per row of `docs`: id, `n_shingles`, `component_id` (smallest id
    reachable over links, itself included), `kept` (id = component_id).

    Links join texts with `percent` or more of their shingles in common. Null
    and blank texts have no shingles and no links; texts shorter than a shingle
    are one shingle. Rows that repeat an id each go by their own text. A null
    id is larger than any other: its component is the smallest id there is, or
    null, and then it stays. An empty table gives no rows; other columns of
    `docs` are not read.

    Equal sets collapse first, by hash, into nodes, so copies never meet. In a
    bucket every node is compared with one hub (a star: as many pairs as rows):
    the smallest node first, then, where the members are in different
    components still, drawn ones. Members that remain in different components
    are compared with each other in blocks, so that a crowded bucket is never
    one task's, and of those comparisons only links become rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = stored(signatures(docs, p), "signatures")
    known = sig.filter("node IS NOT NULL")
    # one row of equal sets gives the node its bands: equal sets have equal ones
    classes = stored(known.groupBy("node").agg(F.min("id").alias("rep"), F.min(F.struct("bands", "sketch")).alias("s")).select("node", "rep", "s.*"), "classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    members = stored(banded.join(shared, "key"), "members")
    sketches = stored(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "sketch"), "sketches")

    ska, skb = F.col("ska"), F.col("skb")
    side_a = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("ska"))
    side_b = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("skb"))
    possible = _bits_apart(ska, skb, p) <= p.most_bits
    sets = Sets(classes, docs, p)

    def star_links(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.distinct(), "pairs")
        close = stored(salted_join(pairs, side_a, "a", "b").join(side_b, "b").filter(possible).select("a", "b"), "close")
        return stored(sets.confirmed(close), "links")

    links = star_links(members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    labels = stored(components(links), "labels")

    def divided() -> DataFrame:
        """Members of buckets whose nodes are in different components."""
        placed = members.select("key", "node").join(labels.withColumnsRenamed({"id": "node"}), "node", "left")
        placed = stored(placed.select("key", "node", F.coalesce("component", "node").alias("component")), "placed")
        crowd = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
        return stored(placed.join(crowd.filter("lo < hi").select("key", "size"), "key"), "divided")

    left = divided()
    for turn in range(p.rounds):
        drawn = left.filter("size > 2").groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node", "component")).alias("hub"))
        pairs = left.join(drawn, "key").filter("component <> hub.component")
        more = star_links(pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        labels = stored(components(links), "labels")
        left = divided()

    left = left.filter("size > 2").select("key", "node", "component", F.ceil(F.col("size") / p.block).cast("int").alias("blocks"))
    left = stored(left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "left")
    if not left.isEmpty():
        full = left.join(sketches, "node").join(sets.add(left.select("node").distinct()), "node")
        more = stored(block_links(full, p), "links")
        labels = stored(components(links.unionByName(more)), "labels")

    nodes = classes.select("node", "rep").join(labels.withColumnsRenamed({"id": "node"}), "node", "left")
    nodes = nodes.select("node", "rep", F.coalesce("component", "node").alias("component"))
    nodes = stored(nodes, "placed")
    smallest = stored(nodes.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "smallest")
    nodes = spread_join(nodes, smallest, ["component"], "nodes").select("node", "component_id")
    nodes = stored(known.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).join(nodes, "node"), "nodes")
    found = spread_join(known.select("id", "n", "node"), nodes, ["node"], "rows").select("id", "n", "component_id")
    alone = sig.filter("node IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params(), scanned: bool = False) -> DataFrame:
    """The rows of `docs` that stay, with all columns: one of each component,
    with its smallest id; null ids lose to any other, and of rows equal in both
    any one stays. Rows without words stay. `scanned`: see `keyed`."""
    rows = keyed(docs, id_col, text_col, scanned)
    gone = near_components(rows, "_key", "_text", p).filter("not kept").select(F.col("_key.n").alias("_n"))
    return rows.join(gone, rows["_key.n"] == gone["_n"], "left_anti").select("_row.*")
