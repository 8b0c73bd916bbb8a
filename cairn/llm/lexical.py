"""Ranked lexical search over blocked posting lists.

Documents become vectors of impacts over the terms that a batch of items asks
for, stored once. Segments of them are indexed and searched in place: each
term's posting list is clustered by the similarity of its documents into small
blocks, and a block keeps the largest impact of each coordinate. An item goes
through its lists from the one that can give most. What a block can give at
most is the sum over its summary, of this list's term and the later ones, since
documents of earlier lists were met there; a block is skipped only if that is
below the score of the last place held so far. So nothing is lost, and of
frequent terms few blocks are opened.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import stored

SEGMENT = 4096  #: documents that are indexed together
BLOCK = 32  #: documents of a block, about
SKETCH = 32  #: dimensions in which documents are compared when a list is clustered
BATCH_TERMS = 200_000  #: (item, term) pairs that every task holds at a time, about
SUMMARY_BYTES = 1 << 28  #: of summaries that a segment holds at a time
AT_ONCE = 8  #: blocks opened before the last place is looked at again
NO_ID = (1 << 63) - 1  #: a null id, which loses ties to any other
#: A term is a maximal run of other bytes of UTF-8; A-Z become a-z.
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats; null has none."""
    return text.translate(_TERMS).split() if text else []


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`item` (a key of the row's own), `id` and the distinct `terms` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = [sorted(set(terms(t))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], ["item", "id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item long, id long, terms array<binary>")


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Of each document: id, `n`, its terms with repeats, and of those in
    `vocabulary` numbers `t` and occurrences `tf`."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for b in _slices(batches):
            n, cuts, ts, tfs = [], [0], [], []
            for text in b.column(1).to_pylist():
                words = terms(text)
                n.append(len(words))
                found = Counter(filter(number.__contains__, words))
                ts += [number[w] for w in found]
                tfs += found.values()
                cuts.append(len(ts))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (ts, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "t", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, t array<int>, tf array<int>")


def frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of `size` terms, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["t", "df"])

    out = np.zeros(size, np.int64)
    for r in vectors.select("t").mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():  # a batch's terms
        out[r["t"]] = r["df"]
    return out


@dataclass
class Plan:
    """What every task holds of a batch: each item's key, id and term numbers,
    each term's weight, and the corpus' documents N and terms L."""

    items: list[tuple[int, int | None, np.ndarray]]
    weight: np.ndarray
    n_docs: int
    n_terms: int
    top: int

    def __post_init__(self):
        self.of: dict[int, list[int]] = {}
        for i, (_, _, ts) in enumerate(self.items):
            for t in ts.tolist():
                self.of.setdefault(t, []).append(i)
        self.near: dict[int, np.ndarray] = {}

    def asked_with(self, t: int) -> np.ndarray:
        """Terms of the items that have `t`: the only coordinates that bound them."""
        if t not in self.near:
            if sum(map(len, self.near.values())) > SUMMARY_BYTES // 8:
                self.near.clear()
            self.near[t] = np.unique(np.concatenate([self.items[i][2] for i in self.of[t]]))
        return self.near[t]


def impacts(tf: np.ndarray, n: np.ndarray, sizes: np.ndarray, plan: Plan) -> np.ndarray:
    """Of postings' occurrences `tf`, `sizes` of them in documents of `n` terms."""
    m = np.array([100 - 50 + 50 * x * plan.n_docs // plan.n_terms for x in n.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes))


class Segment:
    """Documents with at least one term: vectors by document, lists by term."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, t: np.ndarray, c: np.ndarray, plan: Plan):
        self.ids, self.t, self.c, self.sizes, self.plan = ids, t, c, sizes, plan
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        v = len(plan.weight)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.listed = doc[np.argsort(t, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=v))])
        self.most = np.zeros(v, np.int64)
        np.maximum.at(self.most, t, c)
        signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (v, SKETCH))
        gain = (c * plan.weight[t]).astype(np.float32)
        x = np.stack([np.bincount(doc, gain * signs[t, k], len(ids)) for k in range(SKETCH)], axis=1)
        self.sketch = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.cache: dict[int, tuple] = {}
        self.held = 0

    def vectors(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' postings, and the first of each document."""
        sizes = self.sizes[docs]
        first = np.cumsum(sizes) - sizes
        return np.repeat(self.start[docs] - first, sizes) + np.arange(sizes.sum()), first

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The list of `t`: its documents, ordered so that similar ones are
        together, where each block begins, the coordinates of its summaries
        (term numbers) and the largest impact of each block in each."""
        if t in self.cache:
            return self.cache[t]
        docs = self.listed[self.at[t] : self.at[t + 1]]
        new = np.zeros(len(docs), bool)
        if len(docs) > BLOCK:
            k = -(-len(docs) // BLOCK)
            x = self.sketch[docs]
            cluster = (x @ x[np.arange(k) * len(docs) // k].T).argmax(axis=1)  # every so manieth document is a centre
            order = np.argsort(cluster, kind="stable")
            docs, cluster = docs[order], cluster[order]
            begins = np.concatenate([[True], cluster[1:] != cluster[:-1]])
            inside = np.arange(len(docs)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            new = begins | (inside % (2 * BLOCK) == 0)
        new[0] = True
        starts, block = np.flatnonzero(new), np.cumsum(new) - 1
        coordinates = self.plan.asked_with(t)
        column = np.full(len(self.plan.weight), -1, np.int32)
        column[coordinates] = np.arange(len(coordinates))
        at, _ = self.vectors(docs)
        col = column[self.t[at]]
        keep = col >= 0
        row = np.repeat(block, self.sizes[docs])[keep]
        summary = np.zeros(len(starts) * len(coordinates), np.int64)
        np.maximum.at(summary, row * len(coordinates) + col[keep], self.c[at[keep]])
        if self.held > SUMMARY_BYTES:
            self.cache.clear()
            self.held = 0
        self.held += summary.nbytes
        self.cache[t] = docs, np.append(starts, len(docs)), coordinates, summary.reshape(len(starts), -1)
        return self.cache[t]

    def search(self, ts: np.ndarray, best: Best) -> None:
        """Offer to `best` every document that could take one of its places."""
        w = self.plan.weight
        gives = w[ts] * self.most[ts]
        order = np.argsort(-gives, kind="stable")
        ts, gives = ts[order][gives[order] > 0], gives[order][gives[order] > 0]
        rest = np.cumsum(gives[::-1])[::-1]
        asked = np.zeros(len(w), np.int64)
        asked[ts] = w[ts]
        seen = np.zeros(len(self.ids), bool)
        for i, t in enumerate(ts.tolist()):
            if rest[i] < best.least:
                return
            docs, starts, coordinates, summary = self.blocks(t)
            later = ts[i:]
            bound = summary[:, np.searchsorted(coordinates, later)] @ w[later]
            opened = np.argsort(-bound, kind="stable")
            for j in range(0, len(opened), AT_ONCE):
                if bound[opened[j]] < best.least:
                    break
                chosen = np.concatenate([docs[starts[b] : starts[b + 1]] for b in opened[j : j + AT_ONCE]])
                chosen = chosen[~seen[chosen]]
                if not len(chosen):
                    continue
                seen[chosen] = True
                at, first = self.vectors(chosen)
                best.offer(np.add.reduceat(self.c[at] * asked[self.t[at]], first), self.ids[chosen])


class Best:
    """The highest scores above 0, equal ones by ascending id."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.least = top, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.least = max(1, int(self.scores[-1]))


def segments(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[Segment]:
    for b in _slices(batches, SEGMENT):
        ids, n, t, tf = b.columns
        sizes = t.value_lengths().to_numpy()
        some = sizes > 0
        if some.any():
            c = impacts(tf.flatten().to_numpy().astype(np.int64), n.to_numpy(), sizes, plan)
            yield Segment(ids.fill_null(NO_ID).to_numpy()[some], sizes[some].astype(np.int64), t.flatten().to_numpy(), c, plan)


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The `top` documents of each row of `items` with a score above 0, all if
    fewer: item id, `rank` (int, from 1), document id, `score` (long). Equal
    scores go by ascending id, null ids last.

    With N documents that have a term, L terms with repeats in all, n in a
    document, df documents with a term and tf occurrences: a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + 50 n N div L, and the score
    sums weight * (10^9 tf div (1000 tf + 20 m)) over the item's distinct terms.

    Null and empty texts have no term: such documents are found by no item,
    such items find none. Rows that repeat an id are rows of their own, as
    documents and as items. Empty tables give no rows; other columns are not
    read.

    Items go in batches of about `BATCH_TERMS` terms; a batch's terms, weights
    and items are what each task holds. The texts are read once a batch; counts
    are of all documents. What leaves a task is at most `top` rows an item.
    """
    asked = stored(item_terms(items, item_col, item_text), "items")
    batches = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / BATCH_TERMS))
    out = None
    for k in range(batches):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(batches)) == k).orderBy("item").collect()  # one batch
        found = _search_batch(docs, [(r["item"], r["id"], [bytes(t) for t in r["terms"]]) for r in rows], top, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    placed = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    part = F.pmod(F.xxhash64("doc"), F.lit(64)).cast("int")
    out = out.withColumn("_part", part).withColumn("rank", placed("item", "_part")).filter(F.col("rank") <= top)
    out = out.withColumn("rank", placed("item")).filter(F.col("rank") <= top)
    return out.select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _search_batch(docs: DataFrame, items: list[tuple[int, int | None, list[bytes]]], top: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for *_, ts in items for t in ts}))}
    vectors = stored(forward(docs, vocabulary, id_col, text_col), "vectors")
    n_docs, n_terms = vectors.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = frequencies(vectors, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    numbers = [(item, id_, np.array(sorted(vocabulary[t] for t in ts), np.int64)) for item, id_, ts in items]
    held = spark.sparkContext.broadcast((numbers, weight, n_docs, n_terms, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(*held.value)
        best = [Best(plan.top) for _ in plan.items]
        for segment in segments(batches, plan):
            for (_, _, ts), own in zip(plan.items, best, strict=True):
                segment.search(ts, own)
        for (item, id_, _), own in zip(plan.items, best, strict=True):
            k = len(own.ids)
            if k:
                ids = pa.array(own.ids, pa.int64(), mask=own.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([item] * k, pa.int64()), pa.array([id_] * k, pa.int64()), ids, pa.array(own.scores)], ["item", "id", "doc", "score"])

    return vectors.select("id", "n", "t", "tf").mapInArrow(run, "item long, id long, doc long, score long")
