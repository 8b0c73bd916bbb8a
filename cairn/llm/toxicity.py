"""Toxicity: a linear classifier on character n-grams of words, its features
scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams that its words have, each once. Over
labelled rows, the log-count ratio r = log (p + 1) / (P + 2) - log (q + 1) / (Q + 2)
compares in how many of P toxic (p) and of Q other texts (q) a feature is; a
ratio within two standard errors of 0, or of a feature in fewer than three
texts, counts as 0. Logistic regression then weighs the features times r. Both
see bounded samples of the labelled rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import linear
from cairn.llm.common import remembered, stored

BUCKETS = 1 << 19  #: of hashed features: also what a model holds at most
GRAMS = (3, 4, 5)
SAMPLE = 2000  #: rows of each label, by hash of the id, that the regression is fitted on at most
WORD = re.compile(r"[^\W_]+")
COUNTED = 10_000  #: rows of each label, by hash of the id, that the ratios are counted over at most
KNOWN_WORDS = 300_000  #: that a worker remembers


class Grams(dict):
    """word -> its features; a bounded memory of words met."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        w = f"<{word}>".encode()
        found = {zlib.crc32(w[i : i + n]) % BUCKETS for n in GRAMS for i in range(max(1, len(w) - n + 1))}
        out = self[word] = np.fromiter(found, np.int32, len(found))
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall((text or "").lower()))
        return np.concatenate([self[w] for w in words]) if words else np.empty(0, np.int32)


class Weighed(dict):
    """word -> those of its features that a model weighs, None without any."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.grams = weights, Grams()

    def __missing__(self, word: str) -> np.ndarray | None:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        ids = self.grams.__missing__(word)
        self.grams.clear()
        ids = ids[self.weights[ids] != 0]
        out = self[word] = ids if len(ids) else None
        return out

    def total(self, text: str | None) -> float:
        """Sum of the weights of a text's features, each once."""
        found = [ids for w in set(WORD.findall((text or "").lower())) if (ids := self[w]) is not None]
        return float(self.weights[linear.distinct(np.concatenate(found))].sum(dtype=np.float64)) if found else 0.0


def _counts(rows: DataFrame) -> DataFrame:
    """`bucket, pos, neg` of `rows(text, toxic)`: summed within a partition's
    batches first, so at most `BUCKETS` rows leave each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, tally = remembered("grams", Grams), np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tally[toxic][linear.distinct(grams.of(text))] += 1
        at = np.flatnonzero(tally.any(axis=0))
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(tally[1][part]), pa.array(tally[0][part])], ["bucket", "pos", "neg"])

    return rows.select("text", "toxic").mapInArrow(run, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _scaled(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """`ids` of the features of `rows(text)` that have a ratio: what the driver
    gets of a sampled text, however long, is at most `BUCKETS` numbers."""
    held = rows.sparkSession.sparkContext.broadcast(ratio != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = remembered("grams", Grams)
        for b in batches:
            found = [linear.distinct(grams.of(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[held.value[x]] for x in found], pa.list_(pa.int32()))], ["ids"])

    return rows.select("text").mapInArrow(run, "ids array<int>")


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by 5."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weight of each bucket, threshold) from `docs(id, text)` and
    `labels(id, toxic)`.

    Rows without an id or label are left out. Ratios are counted over at most
    `COUNTED` rows of each label, the regression sees at most `SAMPLE` of them,
    weighted for all labels: so many ids are broadcast to the scan of the
    texts, which therefore does not shuffle. With one label only, or none,
    every score is that label's share (or 0).
    """
    known = labels.filter("toxic IS NOT NULL AND id IS NOT NULL").select("id", (F.col("toxic") != 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("id")
    drawn = [known.filter(F.col("toxic") == k).orderBy(order, "id").limit(COUNTED) for k in (0, 1)]
    ids = stored(drawn[0].unionByName(drawn[1]), "drawn")
    rows = stored(docs.join(F.broadcast(ids), "id").select("id", "text", "toxic"), "labelled")
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return np.zeros(BUCKETS, np.float32), -30.0 if seen.get(1) else 30.0
    counts = _counts(rows).toArrow()
    at, pos, neg = (counts.column(i).to_numpy() for i in range(3))
    ratio = np.zeros(BUCKETS)
    ratio[at] = np.log((pos + 1) / (seen[1] + 2)) - np.log((neg + 1) / (seen[0] + 2))
    ratio[at[(pos + neg < 3) | (np.abs(ratio[at]) < 2 * np.sqrt(1 / (pos + 1) + 1 / (neg + 1)))]] = 0
    kept, grade, weight = [], [], []
    for k in (0, 1):
        part = _scaled(rows.filter(F.col("toxic") == k).orderBy(order, "id").limit(SAMPLE), ratio).toArrow().column(0)
        for own in part:
            ids_ = own.values.to_numpy()
            kept.append((ids_, ratio[ids_]))
            grade.append(k)
            weight.append(n[k] / len(part))
    w, cut = linear.fit(linear.Rows.of(kept), np.array(grade), np.array(weight), 2, BUCKETS, l2)
    return (w * ratio).astype(np.float32), float(cut[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `score` (0 to 1) and `predicted` (1 from
    0.5). Null and wordless texts have the score of no features. Whole texts
    are read; rows are independent, one narrow pass; other columns are not
    read. The model is an array of `BUCKETS` floats whatever the input."""
    weights, cut = model
    held = docs.sparkSession.sparkContext.broadcast(weights)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered(name, lambda: Weighed(held.value))
        for b in batches:
            sums = np.fromiter(map(words.total, b.column(1).to_pylist()), np.float64, b.num_rows)
            p = linear.sigmoid(sums - cut)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int").withColumnsRenamed({"_id": id_col})
