"""Features that a forest and a perceptron both rely on: the forest by its own
importances, the perceptron by how much accuracy is lost when a feature's
values change places between rows.

A carried feature is a 1 in few rows, so of all predictions only those of rows
that lose or gain it have to be made again. Places are ranks in a seeded order
within the drug; a feature's values move along it by an offset of their own,
which is a permutation. All features and repeats are rows of one job."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.models import FEATURE, top_features, variable_importance
from cairn.operators.perceptron import Net, Perceptron, fitted, taken
from cairn.operators.ranks import by_hash
from cairn.operators.shared import in_shuffle, stored


def fit_perceptron(rows: DataFrame, n_features: int, hidden: int = 16, steps: int = 60, seed: int = 7) -> Perceptron:
    return fitted(taken(rows), {"net": Net(max(1, n_features), hidden, steps, seed)})["net"]


#: Changes of a row's features that a task looks at, about.
CHANGES = 2_000_000


def moved(ones: DataFrame, repeats: int, seed: int, tasks: int) -> DataFrame:
    """(drug, place, i, turn, change): rows that lose (-1) or gain (1) a feature
    in each of `repeats` permutations, dealt by row. `ones(drug, place, n, i)`
    has a row for each 1, `place` its row's, from 1, of the drug's `n`."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn")
    each = ones.select("drug", "i", "place", "n", turn)
    offset = 1 + F.pmod(F.xxhash64("i", "turn", F.lit(seed)), F.greatest(F.col("n") - 1, F.lit(1)))
    to = F.pmod(F.col("place") - 1 + offset, F.col("n")) + 1
    change = lambda at, c: F.struct(at.cast("long").alias("place"), F.lit(c).alias("change"))
    both = each.select("drug", "i", "turn", F.inline(F.array(change(F.col("place"), -1), change(to, 1)))).repartition(tasks, "drug", "place")
    return both.groupBy("drug", "place", "i", "turn").agg(F.sum("change").cast("int").alias("change")).filter("change <> 0")


def permutation_importance(rows: DataFrame, carried: DataFrame | None, index: DataFrame, net: Perceptron, repeats: int = 3, seed: int = 42) -> DataFrame:
    """(drug, gene, mutation, importance): accuracy on the drug's rows less
    that with the feature's values permuted, mean over `repeats`. A feature
    that no row carries has 0. A row's ones are the design's columns, so long
    `carried` is not read; changes are dealt once, to the row that they are of."""
    units = range(len(net.shift))
    n = rows.groupBy("drug").agg(F.count(F.lit(1)).alias("n"))
    ranked = by_hash(stored(rows.select("drug", "uid", "y", "columns"), "places"), ["drug"], seed, "place").join(F.broadcast(n), "drug")  # a row for each drug
    ranked = stored(ranked.select("drug", "place", "n", "y", "columns"), "ranked")
    weights = F.broadcast(rows.sparkSession.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(net.into)], "i int, w array<double>"))  # a model's
    constant = F.broadcast(index.filter("gene IS NULL").select("drug", F.col("i").alias("c")))  # a row for each drug
    ones = stored(ranked.select("drug", "place", "n", F.explode("columns").alias("i")).join(constant, "drug").filter("i <> c").drop("c"), "ones")
    count = ones.count()
    tasks = max(1, math.ceil(2 * repeats * count / CHANGES))
    sums = ones.repartition(tasks, "drug", "place").join(weights, "i").groupBy("drug", "place").agg(*[F.sum(F.col("w")[k]).alias(f"z{k}") for k in units])
    shift = index.filter("gene IS NULL").join(weights, "i").select("drug", F.col("w").alias("c"))
    state = ranked.select("drug", "place", "y").repartition(tasks, "drug", "place").join(sums, ["drug", "place"], "left").join(F.broadcast(shift), "drug")  # a row for each drug
    z = [F.coalesce(f"z{k}", F.lit(0.0)) + F.col("c")[k] + F.lit(float(net.shift[k])) for k in units]
    state = stored(state.select("drug", "place", "y", F.array(*z).alias("z"), net.says(z).alias("said")), "units")

    changed = in_shuffle(moved(ones, repeats, seed, tasks)).join(state.repartition(tasks, "drug", "place"), ["drug", "place"]).join(weights, "i")
    now = net.says([F.col("z")[k] + F.col("change") * F.col("w")[k] for k in units])
    right = lambda said: (said == F.col("y")).cast("int")
    lost = changed.groupBy("drug", "i").agg(F.sum(right(F.col("said")) - right(now)).alias("lost"))
    out = index.filter("gene IS NOT NULL").join(lost, ["drug", "i"], "left").join(F.broadcast(n), "drug")  # a row for each drug
    return out.select("drug", *FEATURE, (F.coalesce("lost", F.lit(0)) / F.lit(repeats) / F.col("n")).alias("importance"))


def cross_model(rows: DataFrame, carried: DataFrame, index: DataFrame, top: int = 20, mode: str = "intersection", held_out: str | None = None, hidden: int = 16, repeats: int = 3, seed: int = 42) -> DataFrame:
    """Features in the `top` of a forest, of a perceptron, or both: (drug, gene,
    mutation, in_forest, in_perceptron, agreement), of which `mode` (union or
    intersection) stay; `agreement` is the drug's number in both by that in
    either. With `held_out`, rows of that lineage are not seen by either model.
    Raises where no rows are left, a drug has one class, or nothing stays."""
    if mode not in ("intersection", "union"):
        raise ValueError(f"unknown mode {mode}")
    train = rows if held_out is None else stored(rows.filter(F.col("lineage") != held_out), "train")
    classes = train.groupBy("drug").agg(F.count_distinct("y").alias("k")).collect()  # a row for each drug
    if not classes:
        raise ValueError("no rows to fit on")
    if min(r["k"] for r in classes) < 2:
        raise ValueError("a drug has one class only")
    key = ["drug", *FEATURE]
    a = variable_importance(train, index, top).select(*key, F.lit(True).alias("in_forest"))
    net = fit_perceptron(train, index.count(), hidden, seed=seed)
    own = permutation_importance(train, carried, index, net, repeats, seed)
    b = top_features(own, F.desc("importance"), top).select(*key, F.lit(True).alias("in_perceptron"))
    either = a.join(b, key, "full_outer").na.fill(False)
    both = F.col("in_forest") & F.col("in_perceptron")
    w = Window.partitionBy("drug")
    either = either.withColumn("agreement", F.round(F.count_if(both).over(w) / F.count(F.lit(1)).over(w), 6))
    out = stored(either.filter(both) if mode == "intersection" else either, "agreement")
    if out.isEmpty():
        raise ValueError(f"the {mode} is empty")
    return out
