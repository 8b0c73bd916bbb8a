"""Forests and boosted trees over sparse 0/1 rows.

Spark ML's trees keep a number for every column of each row and look at all of
them at each level: of some six hundred columns a row has four ones. Here a row
costs what it has ones, and equal rows are one with their weight and number.
Splits, gains, leaves and boosting are Spark ML's. Each level of all trees is
one job: tasks sum what the columns of each node hold, the driver sees a
model's numbers and chooses."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.perceptron import FILE_ROWS, _rows_of
from cairn.operators.shared import at_once, stored


@dataclass(frozen=True)
class Forest:
    """Trees on bootstrapped rows, each node of which sees the root of the
    columns' number of them, drawn."""

    columns: int
    trees: int = 20
    depth: int = 8
    seed: int = 7


@dataclass(frozen=True)
class Boosted:
    """Trees on what those before leave of the labels: log loss of 0 and 1, or
    with `values` squared errors."""

    columns: int
    rounds: int = 8
    depth: int = 5
    step: float = 0.1
    values: bool = False


@dataclass(frozen=True)
class Grown:
    """Trees as heaps: the column that a node asks for (-1: a leaf), whose rows
    with a 1 go to the second child; what a leaf says; and the gain of a node
    times its weight. The model says the sum of its trees, `scale` each."""

    column: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    scale: np.ndarray
    log_odds: bool = False

    def says(self, x: np.ndarray) -> np.ndarray:
        out = self.value.ravel().take(_down(x, self.column, _depth(self.column))) @ self.scale
        return 1 / (1 + np.exp(-2 * out)) if self.log_odds else out


def _depth(column: np.ndarray) -> int:
    return (column.shape[1] + 1).bit_length() - 2


def _down(x: np.ndarray, column: np.ndarray, steps: int) -> np.ndarray:
    """The nodes of each tree that rows get to (rows x trees), counted through
    all trees. The last column of `x` is 0: what a leaf asks for."""
    trees, size = column.shape
    first, inner = np.arange(trees) * size, column >= 0
    asks = np.where(inner, column, x.shape[1] - 1).ravel().astype(np.int64)
    then = (np.where(inner, 2 * np.arange(size) + 1, np.arange(size)) + first[:, None]).ravel()
    cells, row = x.ravel(), np.arange(len(x))[:, None] * x.shape[1]
    at = np.broadcast_to(first, (len(x), trees))
    for _ in range(steps):
        at = then.take(at) + cells.take(row + asks.take(at))
    return at


#: Cells of the matrix of some rows that a task looks at, about.
CELLS = 600_000


def _blocks(batches: Iterator[tuple], p: int) -> Iterator[tuple]:
    """Some rows at a time of (ones in a row, how many each row has, fields):
    the same of these rows, and their matrix, with a column of 0 more."""
    room = max(1, CELLS // (p + 1))
    x = np.zeros((room, p + 1), np.uint8)
    for ones, n, *fields in batches:
        ends = np.cumsum(n)
        for a in range(0, len(n), room):
            b = min(a + room, len(n))
            own, row = ones[ends[a] - n[a] : ends[b - 1]].astype(np.int64), np.repeat(np.arange(b - a), n[a:b])
            x[row, own] = 1
            yield x[: b - a], own, row, n[a:b], *[f[a:b] for f in fields]
            x[row, own] = 0


#: What a fit reads of rows, and how it is packed; `draws` and `said` have numbers for each tree or fold.
PACKED = {"ones": np.int32, "n": np.int32, "g": np.int32, "y": np.float64, "w": np.float64, "draws": np.int32, "said": np.float64}


def _packed(**fields: np.ndarray) -> pa.RecordBatch:
    """Rows as one row of bytes: a fit reads them again and again."""
    own = [pa.array([fields[k].astype(t).tobytes() if k in fields else None], pa.binary()) for k, t in PACKED.items()]
    return pa.RecordBatch.from_arrays(own, list(PACKED))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: np.frombuffer(v, t) for name, t in PACKED.items() if (v := batch.column(name)[k].as_py()) is not None}


_BYTES = ", ".join(f"{k} binary" for k in PACKED)


def _field(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _own_ones(ones: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ones of each of `rows`, in a row, and whose they are (a place in `rows`)."""
    size, start = n[rows], (np.cumsum(n) - n)[rows]
    whose = np.repeat(np.arange(len(rows)), size)
    return ones[np.arange(len(whose)) - np.repeat(np.cumsum(size) - size - start, size)], whose


def _summed(data: DataFrame, p: int, size: int, read: Callable[[dict], tuple], add: Callable) -> np.ndarray:
    """The sums that `add` makes of all blocks of packed `data`, of whose rows
    it takes what `read` says; what is not 0 leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        with np.errstate(over="ignore"):
            for block in _blocks(((r["ones"], r["n"], *read(r)) for r in _unpacked(batches)), p):
                add(*block, sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pylist([{"at": at.tobytes(), "sums": sums[at].tobytes()}], pa.schema([("at", pa.binary()), ("sums", pa.binary())]))

    out = np.zeros(size)
    for r in data.mapInArrow(run, "at binary, sums binary").collect():  # a row for each task
        out[np.frombuffer(r["at"], np.int64)] += np.frombuffer(r["sums"])
    return out


def _place(group: str, groups: Sequence[str]) -> Column:
    """The place of a row's group in `groups`, -1 for none."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, groups)), F.col(group)) - 1, F.lit(-1)) if groups else F.lit(-1)
    return at.cast("int")


def _dealt(once: DataFrame) -> DataFrame:
    once = stored(once, "taken")
    return stored(once.repartition(max(1, math.ceil(once.count() / FILE_ROWS))), "taken")


def taken(rows: DataFrame, groups: Sequence[str] = (), group: str = "lineage") -> DataFrame:
    """(columns, g, y, w, n) of design rows, stored: those equal in columns,
    label and group (`g`, its place in `groups`) as one with the sum of their
    weights and their number."""
    own = rows.select("columns", _place(group, groups).alias("g"), F.col("y").cast("double").alias("y"), "weight")
    return _dealt(own.groupBy("columns", "g", "y").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")))


def means_taken(rows: DataFrame, groups: Sequence[str], group: str = "lineage") -> DataFrame:
    """The same of rows whose `label` is any number: squared errors of rows with
    equal columns are those of their mean, and what no tree can change."""
    own = rows.select("columns", _place(group, groups).alias("g"), "label").groupBy("columns", "g").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n"))
    return _dealt(own.select("columns", "g", "y", F.col("n").cast("double").alias("w"), "n"))


def _poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers of rows' means at uniform numbers `u` (rows x trees)."""
    out = np.zeros(u.shape, np.int32)
    for m in np.unique(mean).tolist():
        low, high = max(0, int(m - 12 * math.sqrt(m))), int(m + 12 * math.sqrt(m)) + 30
        mass = [math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(low, high)]
        own = mean == m
        out[own] = low + np.searchsorted(np.cumsum(mass), u[own], "right")
    return out


def _uniform(h: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Numbers from 0 to 1 of rows' hashes for each tree, the same wherever a row lies."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64)[:, None] + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def drawn(data: DataFrame, forest: Forest) -> DataFrame:
    """`data` of `taken` packed, stored, with `draws`: how often each tree sees
    a row. Of so many equal rows a bootstrap takes a Poisson number of that mean."""
    trees, seed = forest.trees, forest.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            ones, n = _rows_of(batch)
            many = _field(batch, "n")
            draws = _poisson(_uniform(_field(batch, "_h"), trees, seed), many)
            yield _packed(ones=ones, n=n, g=_field(batch, "g"), y=_field(batch, "y"), w=_field(batch, "w") / many, draws=draws)

    return stored(data.withColumn("_h", F.xxhash64("columns", "g", "y")).mapInArrow(run, _BYTES), "drawn")


#: Gains below this are what sums of doubles leave.
LEAST = 2.0**-52


def _gini(c: np.ndarray) -> np.ndarray:
    total = c.sum(-1)
    return 1 - ((c / np.where(total > 0, total, 1)[..., None]) ** 2).sum(-1)


def forest(data: DataFrame, spec: Forest, fold: int = -2) -> Grown:
    """The forest of `data` of `drawn`, rows of the group `fold` left out."""
    p, trees, size = spec.columns, spec.trees, 2 ** (spec.depth + 1) - 1
    rng, m = np.random.default_rng([spec.seed, fold + 2]), max(1, math.ceil(math.sqrt(p)))
    column, gain, weights = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size, 2))
    open_ = np.array([(t, 0) for t in range(trees)])
    for level in range(spec.depth):
        if not len(open_):
            break
        nodes = len(open_)
        chosen = np.sort(np.stack([rng.choice(p, m, replace=False) for _ in range(nodes)]), axis=1)
        slot = np.full((trees, size), -1, np.int64)
        slot[open_[:, 0], open_[:, 1]] = np.arange(nodes)

        def add(x, ones, _, n, g, y, w, draws, sums, chosen=chosen, slot=slot, column=column.copy(), nodes=nodes, level=level) -> None:
            s = np.where((draws > 0) & (g != fold)[:, None], slot.ravel().take(_down(x, column, level)), -1)
            i, t = np.nonzero(s >= 0)
            k, d, y, w = s[i, t], draws[i, t].astype(float), y.astype(np.int64)[i], w[i]
            whole, each = sums[: 4 * nodes].reshape(2, 2 * nodes), sums[4 * nodes :].reshape(2, 2 * nodes * m)
            whole[0] += np.bincount(2 * k + y, d, 2 * nodes)
            whole[1] += np.bincount(2 * k + y, d * w, 2 * nodes)
            place = np.full((nodes, p), -1, np.int32)
            np.put_along_axis(place, chosen, np.arange(nodes * m, dtype=np.int32).reshape(nodes, m), 1)
            c, whose = _own_ones(ones, n, i)
            q = place.ravel().take(k[whose] * p + c)
            seen = np.flatnonzero(q >= 0)
            whose, q = whose[seen], 2 * q[seen].astype(np.int64)
            each[0] += np.bincount(q + y[whose], d[whose], 2 * nodes * m)
            each[1] += np.bincount(q + y[whose], d[whose] * w[whose], 2 * nodes * m)

        sums = _summed(data, p, 4 * nodes * (m + 1), lambda r: (r["g"], r["y"], r["w"], r["draws"].reshape(-1, trees)), add)
        n, w = sums[: 4 * nodes].reshape(2, nodes, 1, 2)
        n1, w1 = sums[4 * nodes :].reshape(2, nodes, m, 2)
        if level == 0 and not n.any():
            raise ValueError("no rows to fit on")
        n0 = n - n1
        w0 = np.where(n0 > 0, w - w1, 0.0)
        total = np.maximum(w.sum(-1), 1e-300)
        g = _gini(w) - w0.sum(-1) / total * _gini(w0) - w1.sum(-1) / total * _gini(w1)
        g[(n0.sum(-1) < 1) | (n1.sum(-1) < 1)] = -1.0
        best = g.argmax(1)
        k, t, h = np.arange(nodes), open_[:, 0], open_[:, 1]
        weights[t, h] = w[:, 0]
        split = g[k, best] > LEAST
        k, t, h, best = k[split], t[split], h[split], best[split]
        column[t, h], gain[t, h] = chosen[k, best], g[k, best] * total[k, 0]
        deeper = []
        for side, (own_n, own_w) in enumerate(((n0, w0), (n1, w1))):
            weights[t, 2 * h + 1 + side] = own_w[k, best]
            mixed = (own_n[k, best] > 0).all(-1)
            deeper.append(np.stack([t[mixed], 2 * h[mixed] + 1 + side], axis=1))
        open_ = np.concatenate(deeper)
    says = weights[..., 1] > weights[..., 0]
    for h in range((size - 3) // 2, -1, -1):  # children that say the same are one leaf
        same = (column[:, h] >= 0) & (column[:, 2 * h + 1] < 0) & (column[:, 2 * h + 2] < 0) & (says[:, 2 * h + 1] == says[:, 2 * h + 2])
        column[same, h], gain[same, h] = -1, 0.0
    return Grown(column, weights[..., 1] / np.maximum(weights.sum(-1), 1e-300), gain, np.full(trees, 1 / trees))


class _Nothing:
    """What no tree has said yet, of any rows."""

    def __getitem__(self, _) -> None:
        return None


def _started(data: DataFrame) -> DataFrame:
    """`data` of `taken` packed, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            ones, n = _rows_of(batch)
            yield _packed(ones=ones, n=n, **{k: _field(batch, k) for k in ("g", "y", "w")})

    return stored(data.mapInArrow(run, _BYTES), "boosted")


def _said(state: DataFrame, p: int, many: int, column: np.ndarray, value: np.ndarray, scale: float) -> DataFrame:
    """Packed rows with what a tree of each fold adds to what those before say, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _unpacked(batches):
            more = [value.ravel().take(_down(x, column, _depth(column))) for x, *_ in _blocks([(r["ones"], r["n"])], p)]
            said = np.concatenate(more) * scale + (r["said"].reshape(-1, many) if "said" in r else 0.0)
            yield _packed(**(r | {"said": said}))

    return stored(state.mapInArrow(run, _BYTES), "boosted")


def boosted(data: DataFrame, spec: Boosted, folds: Sequence[int] = (-2,)) -> list[Grown]:
    """For each of `folds` the boosted trees of `data` of `taken`, rows of that
    group left out; all grow in the same jobs."""
    p, size, many = spec.columns, 2 ** (spec.depth + 1) - 1, len(folds)
    column, value, gain = np.full((many, spec.rounds, size), -1, np.int32), np.zeros((many, spec.rounds, size)), np.zeros((many, spec.rounds, size))
    scale, held = np.array([1.0] + [spec.step] * (spec.rounds - 1)), np.array(folds)
    state = _started(data)
    for turn in range(spec.rounds):
        if turn:
            state = _said(state, p, many, column[:, turn - 1].copy(), value[:, turn - 1].copy(), scale[turn - 1])
        open_, parents = np.array([(f, 0) for f in range(many)]), []
        for level in range(spec.depth):
            if not len(open_):
                break
            seen = open_[len(open_) // 2 :] if level else open_  # second children; the first have what these leave
            nodes = len(seen)
            slot = np.full((many, size), nodes, np.int64)
            slot[seen[:, 0], seen[:, 1]] = np.arange(nodes)

            def add(x, ones, whose, size_of, g, y, w, said, sums, slot=slot, own=column[:, turn].copy(), nodes=nodes, level=level) -> None:
                s = slot.ravel().take(_down(x, own, level))
                sums = sums.reshape(3, nodes + 1, p + 1)
                for f in range(many):
                    mine = np.flatnonzero((s[:, f] < nodes) & (g != held[f]))
                    if not len(mine):
                        continue
                    k, t, own_w = s[mine, f], y[mine] if spec.values else 2 * y[mine] - 1, w[mine]
                    if said is not None:
                        before = said[mine, f]
                        t = 2 * (t - before) if spec.values else 4 * t / (1 + np.exp(2 * t * before))
                    c, whose_ = (ones, whose) if len(mine) == len(g) else _own_ones(ones, size_of, mine)
                    q = k.take(whose_) * (p + 1) + c
                    for part, v in zip(sums, (None, own_w, own_w * t), strict=True):
                        part += np.bincount(q, v if v is None else v.take(whose_), part.size).reshape(part.shape)
                        part[:, p] += np.bincount(k, v, nodes + 1)

            read = lambda r: (r["g"], r["y"], r["w"], r["said"].reshape(-1, many) if "said" in r else _Nothing())
            n, w, r = _summed(state, p, 3 * (nodes + 1) * (p + 1), read, add).reshape(3, nodes + 1, p + 1)[:, :nodes]
            if turn == level == 0 and not n[:, p].all():
                raise ValueError("no rows to fit on")
            if level:
                n, w, r = (np.concatenate([a - b, b]) for a, b in zip(parents, (n, w, r), strict=True))
            n1, w1, r1 = n[:, :p], w[:, :p], r[:, :p]
            n0, w0, r0 = n[:, p:] - n1, w[:, p:] - w1, r[:, p:] - r1
            can = (n0 > 0) & (n1 > 0)
            mean0, mean1 = r0 / np.where(can, w0, 1), r1 / np.where(can, w1, 1)
            g = np.where(can, (r0 * mean0 + r1 * mean1 - r[:, p:] ** 2 / w[:, p:]) / w[:, p:], -1.0)
            best = g.argmax(1)
            k, f, h = np.arange(len(open_)), open_[:, 0], open_[:, 1]
            value[f, turn, h] = r[:, p] / w[:, p]
            split = g[k, best] > LEAST
            k, f, h, best = k[split], f[split], h[split], best[split]
            column[f, turn, h], gain[f, turn, h] = best, g[k, best] * w[k, p]
            value[f, turn, 2 * h + 1], value[f, turn, 2 * h + 2] = mean0[k, best], mean1[k, best]
            open_, parents = np.concatenate([np.stack([f, 2 * h + 1], axis=1), np.stack([f, 2 * h + 2], axis=1)]), [n[k], w[k], r[k]]
    return [Grown(column[f], value[f], gain[f], scale, not spec.values) for f in range(many)]


def fitted(rows: DataFrame, specs: Mapping[str, Forest | Boosted], groups: Sequence[str], group: str = "lineage") -> dict[str, list[Grown]]:
    """For each of `specs` the models that leave out each of `groups`; rows of
    no group train none."""
    data, folds = taken(rows.filter(F.col(group).isin(list(groups))), groups, group), range(len(groups))
    out = {}
    for name, spec in specs.items():
        if isinstance(spec, Forest):
            own = drawn(data, spec)
            out[name] = at_once(lambda f, own=own, spec=spec: forest(own, spec, f), folds)
        else:
            out[name] = boosted(data, spec, folds)
    return out


def scores(rows: DataFrame, models: Mapping[str, Sequence[Grown]], groups: Sequence[str], group: str = "lineage", keys: Sequence[str] = ("drug", "uid", "lineage", "y")) -> DataFrame:
    """(*keys, fold, model, score) of each row of `groups` by each model that
    left its group, the fold, out; its ones are read once."""
    p = max(1, *(1 + int(g.column.max()) for own in models.values() for g in own))
    own = rows.filter(F.col(group).isin(list(groups))).select(*keys, F.filter("columns", lambda c: c < p).alias("columns"), _place(group, groups).alias("_g"))
    names = np.array(list(map(str, groups)), object)

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = _field(batch, "_g")
            fold = batch.select(list(keys)).append_column("fold", pa.array(names[g], pa.string()))
            score = {name: [np.zeros(0)] for name in models}
            for x, _, _, _, own in _blocks([(*_rows_of(batch), g)], p):
                for name, grown in models.items():
                    score[name].append(np.zeros(len(own)))
                    for k in np.unique(own):
                        mine = own == k
                        score[name][-1][mine] = grown[k].says(x[mine])
            for name, parts in score.items():
                yield fold.append_column("model", pa.array([name] * len(g), pa.string())).append_column("score", pa.array(np.concatenate(parts)))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return own.mapInArrow(said, f"{shape}, fold string, model string, score double")


def importances(grown: Grown, p: int) -> np.ndarray:
    """The share of each column in the gains of each tree, mean over trees."""
    out = np.zeros(p)
    for column, gain in zip(grown.column, grown.gain, strict=True):
        own = np.bincount(column[column >= 0], gain[column >= 0], p)
        out += own / max(own.sum(), 1e-300)
    return out / max(out.sum(), 1e-300)
