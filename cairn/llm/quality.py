"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - t_k): one weight vector over hashed text
features, shared by all grades, and ordered thresholds t_1 < t_2 < ... Selection
uses the expected grade or a tail probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import PandasUDFType

from cairn.llm import linear
from cairn.llm.common import remembered, stored

BUCKETS = 1 << 18
SAMPLE = 2500  #: rows of each grade, by hash of the id, that the model is fitted on at most
KNOWN_TOKENS = 200_000  #: that a worker remembers
_KIND = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1{2,}"), r"\1\1\1"))
_LETTER = np.array([chr(i).isalpha() or i >= 128 for i in range(256)])
_SPACE = np.array([chr(i).isspace() and i < 128 for i in range(256)])
RATIOS = ("length", "distinct", "pairs", "lines", "letters", "word", "mean_line", "letters_of_rest")


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


class Tokens(dict):
    """token -> its number; `shape[number]` hashes how it is written (letters
    by case, digits, marks), `grams[number]` its letters' 4-grams."""

    def __init__(self) -> None:
        self.shape, self.grams = np.zeros(1024, np.int64), []

    def forget(self) -> None:
        """Between texts: numbers are per text."""
        if len(self) > KNOWN_TOKENS:
            self.clear()
            self.grams.clear()

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self)
        word, mark = (token, "") if token.isalpha() else (token[:-1], token[-1])
        if word.isalpha():
            shape = ("A" if word.isupper() else "Aa" if word[0].isupper() else "a") + mark
        else:
            shape = token
            for pattern, to in _KIND:
                shape = pattern.sub(to, shape)
            word = "".join(filter(str.isalpha, token))
        if i >= len(self.shape):
            self.shape = np.concatenate([self.shape, np.zeros_like(self.shape)])
        self.shape[i] = zlib.crc32(shape.encode())
        raw = f"<{word.lower()}>".encode()
        grams = {zlib.crc32(raw[k : k + 4], 1) % BUCKETS for k in range(max(1, len(raw) - 3))}
        self.grams.append(np.fromiter(grams, np.int32, len(grams)))
        return i


_RATIO_AT = np.array([_bucket(f"r{k}") for k in RATIOS])
_BIAS = _bucket("bias")


def features(text: str | None, known: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values: how often each token shape and pair of
    shapes comes, which 4-grams there are, and bins of a few ratios."""
    text = text or ""
    known.forget()
    tokens = text.split()
    n = len(tokens)
    number = np.fromiter(map(known.__getitem__, tokens), np.int64, n)
    raw = np.frombuffer(text.encode(), np.uint8)
    lines = [x for x in text.split("\n") if x.strip()]
    shape = known.shape[number]
    alone, alone_n = np.unique(shape, return_counts=True)
    pair, pair_n = np.unique(shape[:-1] * 1_000_003 + shape[1:] + 1, return_counts=True)
    distinct = linear.distinct(number)
    dark = max(1, len(raw) - int(_SPACE[raw].sum()))
    letters = int(_LETTER[raw].sum())
    # whole passages repeat too, so distinct pairs of tokens count besides distinct tokens
    ratios = np.array(
        [
            log2(1 + n) / 16,
            len(distinct) / max(1, n),
            len(linear.distinct(number[:-1] * (1 << 32) + number[1:])) / max(1, n - 1),
            len(set(lines)) / max(1, len(lines)),
            dark / max(1, len(raw)),
            min(1.0, dark / max(1, n) / 20),
            min(1.0, log2(1 + n / max(1, len(lines))) / 12),
            letters / dark,
        ]
    )
    grams = linear.distinct(np.concatenate([known.grams[i] for i in distinct.tolist()])) if n else np.empty(0, np.int64)
    bins = (_RATIO_AT + 7919 * np.minimum(9, (ratios * 10).astype(np.int64))) % BUCKETS
    ids = np.concatenate([alone % BUCKETS, pair % BUCKETS, bins, [_BIAS], grams])
    values = np.concatenate([np.sqrt(alone_n / max(1, n)), np.sqrt(pair_n / max(1, n)), np.ones(len(bins) + 1), np.full(len(grams), 0.2)])
    return ids.astype(np.int64), values.astype(np.float32)


def grade_of(quality, toxic):
    """Grade 0: rated bad; 1: good but toxic; 2: good. Null without a rating."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).otherwise(2))


def sample(ratings: DataFrame, grades: int) -> DataFrame:
    """At most `SAMPLE` ids of each grade in `ratings(id, grade)`, by hash."""
    rated = ratings.filter(F.col("grade").between(0, grades - 1) & F.col("id").isNotNull()).select("id", F.col("grade").cast("int").alias("grade"))
    drawn = [rated.filter(F.col("grade") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for k in range(grades)]
    return stored(reduce(DataFrame.unionByName, drawn), "sample")


def _featured(rows: DataFrame) -> DataFrame:
    """`grade, ids, values` of `rows(grade, text)`, each id once: what the
    driver gets of a sampled text, however long, is at most `BUCKETS` pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered("quality", Tokens)
        for b in batches:
            ids, values = [], []
            for text in b.column(1).to_pylist():
                i, v = features(text, known)
                at, inverse = np.unique(i, return_inverse=True)
                ids.append(at.astype(np.int32))
                values.append(np.bincount(inverse, weights=v).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["grade", "ids", "values"])

    return rows.select("grade", "text").mapInArrow(run, "grade int, ids array<int>, values array<float>")


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from `docs(id, text)` and `ratings(id, grade)`,
    grades from 0. Rows without an id or grade are left out. At most `SAMPLE`
    ids of each grade are fitted, weighted for all of its ratings: so many are
    broadcast to the scan of the texts, which therefore does not shuffle.
    Without rows all texts score alike."""
    n = {r["grade"]: r["count"] for r in ratings.filter(F.col("grade").between(0, grades - 1)).groupBy("grade").count().collect()}
    rows = _featured(docs.join(F.broadcast(sample(ratings, grades)), "id")).toArrow()
    grade = rows.column("grade").to_numpy().astype(int)
    if not len(grade):
        return np.zeros(BUCKETS, np.float32), np.zeros(grades - 1) - 30.0
    kept = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(rows.column("ids"), rows.column("values"), strict=True)]
    weight = np.array([n.get(k, 0) for k in range(grades)]) / np.maximum(1, np.bincount(grade, minlength=grades))
    return linear.fit(linear.Rows.of(kept), grade, weight[grade], grades, BUCKETS, l2)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", least: int = 1, tail: float = 0.5) -> DataFrame:
    """One row per row of `docs`: id, `expected_grade`, `tails` (P(grade >= k),
    k from 1) and `kept`: whether P(grade >= `least`) is at least `tail`. Null
    and empty texts have the features of an empty text. Whole texts are read;
    rows are independent, one narrow pass; other columns are not read."""
    weights, cuts = model
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = remembered("quality", Tokens), held.value
        for b in batches:
            sums = np.zeros(b.num_rows)
            for i, text in enumerate(b.column(1).to_pylist()):
                ids, values = features(text, known)
                sums[i] = (w[ids] * values).sum(dtype=np.float64)
            tails = linear.at_least(sums, cuts)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(tails.ravel()), len(cuts)).cast(pa.list_(pa.float64()))
            arrays = [b.column(0), pa.array(tails.sum(axis=1)), flat, pa.array(tails[:, least - 1] >= tail)]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "expected_grade", "tails", "kept"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, expected_grade double, tails array<double>, kept boolean").withColumnsRenamed({"_id": id_col})


def filter_docs(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", least: int = 1, tail: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, that `score` would keep.
    Only texts go to Python and only flags come back."""
    weights, cuts = model
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def keep(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, w = remembered("quality", Tokens), held.value
        for part in parts:
            sums = np.zeros(len(part))
            for i, text in enumerate(part):
                ids, values = features(text, known)
                sums[i] = (w[ids] * values).sum(dtype=np.float64)
            yield pd.Series(linear.at_least(sums, cuts)[:, least - 1] >= tail)

    return docs.filter(F.pandas_udf(keep, T.BooleanType(), PandasUDFType.SCALAR_ITER)(F.col(text_col).cast("string")))
