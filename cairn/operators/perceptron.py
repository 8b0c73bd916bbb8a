"""Perceptrons of one hidden layer over sparse 0/1 rows.

Spark ML's perceptron sees every row as a dense column of a block: of some six
hundred columns a row has four ones. Here a row costs what it has ones, and
rows of equal columns and label are one with their weight. Loss, starting
weights and steps (L-BFGS) are Spark ML's, so the fit is the same; loss and
gradient of each step are sums made in tasks, and the driver sees a model's
numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.shared import stored


@dataclass(frozen=True)
class Perceptron:
    """One hidden layer of logistic units over 0/1 columns: `into` has a row of
    weights for each column, `margin` what each unit adds to label 1's lead."""

    into: np.ndarray
    shift: np.ndarray
    margin: np.ndarray
    lead: float

    def says(self, z: list[Column]) -> Column:
        """The label for a row whose units get `z`."""
        total = F.lit(float(self.lead))
        for x, m in zip(z, self.margin, strict=True):
            total = total + F.lit(float(m)) / (1 + F.exp(-x))
        return (total > 0).cast("int")


@dataclass(frozen=True)
class Net:
    """What to fit: units, steps at most, and the seed of the starting weights."""

    columns: int
    hidden: int
    steps: int
    seed: int = 7

    def start(self, spark: SparkSession) -> np.ndarray:
        """The weights that Spark ML starts from."""
        two = spark.createDataFrame([(float(k), Vectors.sparse(self.columns, {})) for k in (0, 1)], ["label", "features"])
        return MultilayerPerceptronClassifier(layers=[self.columns, self.hidden, 2], maxIter=0, seed=self.seed).fit(two).weights.toArray()

    def read(self, w: np.ndarray) -> Perceptron:
        into, shift, out, lead = parts(w, self.columns, self.hidden)
        return Perceptron(into, shift, out[:, 1] - out[:, 0], float(lead[1] - lead[0]))


def parts(w: np.ndarray, p: int, hidden: int) -> tuple[np.ndarray, ...]:
    """Weights into the units, their shifts, weights into both labels and their
    shifts: views of `w`."""
    a, b = p * hidden, p * hidden + hidden
    return w[:a].reshape(p, hidden), w[a:b], w[b : b + 2 * hidden].reshape(hidden, 2), w[b + 2 * hidden :]


#: Rows of a block of Spark ML's perceptron; a fit's loss is the mean over the blocks of a frame's partitions.
BLOCK = 128
#: Rows of a file of what a fit reads, about.
FILE_ROWS = 20_000


def taken(rows: DataFrame) -> DataFrame:
    """(columns, y, w) of design rows, stored: equal ones as one with the sum
    of their weights. A row of a block of k rows weighs 1 / k, as in Spark ML."""
    placed = rows.select("columns", "y", F.monotonically_increasing_id().alias("_at")).select("columns", "y", F.shiftright("_at", 33).alias("_task"), (F.col("_at") % (1 << 33)).alias("_k"))
    sizes = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))  # a row for each task
    inside = F.least(F.lit(BLOCK), F.col("_n") - F.floor(F.col("_k") / BLOCK) * BLOCK)
    once = placed.join(F.broadcast(sizes), "_task").groupBy("columns", "y").agg(F.sum(1.0 / inside).alias("w"))
    once = stored(once, "taken")
    return stored(once.repartition(max(1, math.ceil(once.count() / FILE_ROWS))), "taken")


def packed(data: DataFrame) -> DataFrame:
    """`data` of `taken` as a fit reads it again and again, stored: a row for
    each batch, of rows by how many ones they have: `sizes` has these numbers
    and how many rows have each, then come their columns, labels and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, n = _rows_of(batch)
            order = np.argsort(n, kind="stable")
            sizes, many = np.unique(n, return_counts=True)
            start = (np.cumsum(n) - n)[order]
            size = n[order]
            own = ones[np.arange(len(ones)) - np.repeat(np.cumsum(size) - size - start, size)]
            y, w = (batch.column(batch.schema.get_field_index(c)).to_numpy()[order] for c in ("y", "w"))
            parts = np.stack([sizes, many]).astype(np.int64), own.astype(np.int32), y.astype(np.int8), w.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["sizes", "ones", "y", "w"])

    return stored(data.mapInArrow(run, "sizes binary, ones binary, y binary, w binary"), "packed")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(columns, a row of them for each place; labels; weights) of rows with as
    many ones, of each row of `packed`."""
    for r in batch.to_pylist():
        sizes, many = np.frombuffer(r["sizes"], np.int64).reshape(2, -1)
        ones, y, w = np.frombuffer(r["ones"], np.int32), np.frombuffer(r["y"], np.int8), np.frombuffer(r["w"])
        at = row = 0
        for size, k in zip(sizes.tolist(), many.tolist(), strict=True):
            own = ones[at : at + size * k].reshape(k, size).T.astype(np.intp)
            yield own, y[row : row + k].astype(np.intp), w[row : row + k]
            at, row = at + size * k, row + k


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ones of a batch's rows, and how many each row has."""
    lists = batch.column(batch.schema.get_field_index("columns"))
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _units(at: np.ndarray, n: np.ndarray, into: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """What each unit says to each row."""
    z = np.zeros((len(n), len(shift)))
    some = n > 0
    if some.any():
        z[some] = np.add.reduceat(into[at], (np.cumsum(n) - n)[some], axis=0)
    return 1 / (1 + np.exp(-(z + shift)))


def loss_and_gradient(data: DataFrame, p: int, hidden: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The mean cross entropy of `data` of `taken`, and its gradient, at given
    weights. Each task sums its rows; a model's numbers leave it."""
    total, read = data.agg(F.sum("w")).first()[0], packed(data)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            into, shift, out, lead = parts(w, p, hidden)
            loss, g = 0.0, np.zeros(len(w))
            g_into, g_shift, g_out, g_lead = parts(g, p, hidden)
            gain, ahead = out[:, 1] - out[:, 0], lead[1] - lead[0]  # two labels: what one leads by decides
            by_unit = np.zeros((hidden, p))
            with np.errstate(over="ignore"):
                for batch in batches:
                    for columns, y, weight in _unpacked(batch):
                        z = np.tile(shift, (len(y), 1))
                        for c in columns:
                            z += into.take(c, axis=0)
                        a = 1 / (1 + np.exp(-z))
                        o = a @ gain + ahead
                        loss += float(weight @ np.logaddexp(0, np.where(y == 1, -o, o)))
                        d = weight * (1 / (1 + np.exp(-o)) - y)
                        g_out[:, 1] += d @ a
                        g_lead[1] += d.sum()
                        a *= 1 - a
                        a *= d[:, None]
                        a *= gain
                        g_shift += a.sum(axis=0)
                        a = np.ascontiguousarray(a.T)
                        for c in columns:
                            for k in range(hidden):
                                by_unit[k] += np.bincount(c, a[k], p)
            g_into += by_unit.T
            g_out[:, 0], g_lead[0] = -g_out[:, 1], -g_lead[1]
            yield pa.RecordBatch.from_pylist([{"sums": np.append(g, loss).tobytes()}], pa.schema([("sums", pa.binary())]))

        got = [np.frombuffer(r["sums"]) for r in read.mapInArrow(sums, "sums binary").collect()]  # a row for each task
        all_ = np.sum(got, axis=0) / total
        return float(all_[-1]), all_[:-1]

    return at


class _Failed(Exception):
    """A search along a direction that finds no step."""


def _cubic(lo: tuple, hi: tuple) -> float:
    """The least point of the cubic through two ends (step, slope, value), kept from the ends."""
    (a, da, fa), (b, db, fb) = (lo, hi) if lo[0] <= hi[0] else (hi, lo)
    d1 = da + db - 3 * (fa - fb) / (a - b)
    root = d1 * d1 - da * db
    d2 = math.sqrt(root) if root >= 0 else math.nan
    t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return low if t < low else high if t > high else t


def _step(phi: Callable[[float], tuple], t: float, most: int = 10) -> float:
    """A step that meets the strong Wolfe conditions."""
    low = phi(0.0)
    _, slope, value = low
    if slope > 0:
        raise _Failed

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(most):
            c = phi(_cubic(low, high))
            if c[2] > value + 1e-4 * c[0] * slope or c[2] >= low[2]:
                high = c
            else:
                if abs(c[1]) <= 0.9 * abs(slope):
                    return c[0]
                if c[1] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    for i in range(most):
        c = phi(t)
        if not math.isfinite(c[2]):
            t /= 2
            continue
        if c[2] > value + 1e-4 * t * slope or (c[2] >= low[2] and i > 0):
            return zoom(low, c)
        if abs(c[1]) <= 0.9 * abs(slope):
            return t
        if c[1] >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    raise _Failed


def _direction(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Down the gradient, as the `past` steps and changes of gradient, newest
    first, bend it."""
    d, kept, scale = g.copy(), [], 1.0
    if past:
        s, c = past[0]
        scale = (s @ c) / (c @ c)
        if not scale >= 0:
            raise _Failed
    for s, c in past:
        a = (s @ d) / (s @ c)
        if math.isnan(a):
            raise _Failed
        d -= a * c
        kept.append(a)
    d *= scale
    for (s, c), a in zip(reversed(past), reversed(kept), strict=True):
        d += (a - (c @ d) / (s @ c)) * s
    return -d


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, marks: Sequence[int], tolerance: float = 1e-6, memory: int = 10) -> dict[int, np.ndarray]:
    """The weights after so many steps of each of `marks` at most: Spark ML's
    optimiser, whose way does not depend on where it is told to end."""
    steps, at_mark = max(marks), {}
    last: tuple = (x, *f(x))

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal last
        if not np.array_equal(last[0], w):
            last = (w, *f(w))
        return last[1:]

    value, g = last[1:]
    first, past, values, done, failed = value, [], [math.inf], 0, False
    while done < steps:
        at_mark[done] = x
        if len(values) >= 2 and abs(value - max(values)) <= tolerance * first:
            break
        if np.linalg.norm(g) <= max(tolerance * abs(value), 1e-8):
            break
        try:
            d = _direction(g, past)

            def phi(t: float, x=x, d=d) -> tuple:
                v, slope = at(x + d * t)
                return t, float(slope @ d), v

            t = _step(phi, 1.0 / np.linalg.norm(d) if done == 0 else 1.0)
            if t * np.linalg.norm(g) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            past, failed = [], True  # once more, straight down
            continue
        new = x + d * t
        value, new_g = at(new)
        past = [(new - x, new_g - g), *past][:memory]
        x, g, done, failed = new, new_g, done + 1, False
        values = [*values, value][-20:]
    at_mark[done] = x
    return {m: at_mark[min(m, done)] for m in marks}


def fitted(data: DataFrame, nets: Mapping[str, Net], starts: Mapping[str, np.ndarray] | None = None) -> dict[str, Perceptron]:
    """Each of `nets`, fitted on `data` of `taken`. Those that differ by their
    steps alone are one fit."""
    starts = starts or {name: net.start(data.sparkSession) for name, net in nets.items()}
    same: dict[Net, list[str]] = {}
    for name, net in nets.items():
        same.setdefault(replace(net, steps=0), []).append(name)
    out = {}
    for net, names in same.items():
        w = lbfgs(loss_and_gradient(data, net.columns, net.hidden), starts[names[0]], [nets[n].steps for n in names])
        out |= {n: net.read(w[nets[n].steps]) for n in names}
    return {name: out[name] for name in nets}


def scores(rows: DataFrame, nets: Mapping[str, Perceptron]) -> DataFrame:
    """(drug, uid, lineage, y, model, score) of each row by each of `nets`; a
    row's ones are read once."""
    keys = rows.select("drug", "uid", "lineage", "y")

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select([f.name for f in batch.schema if f.name != "columns"])
            ones, n = _rows_of(batch)
            for name, net in nets.items():
                with np.errstate(over="ignore"):
                    score = 1 / (1 + np.exp(-(_units(ones, n, net.into, net.shift) @ net.margin + net.lead)))
                yield own.append_column("model", pa.array([name] * len(n), pa.string())).append_column("score", pa.array(score))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    return rows.select(*keys.columns, "columns").mapInArrow(said, f"{shape}, model string, score double")
