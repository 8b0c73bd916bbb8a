"""Feature-engineering steps: registered transforms of a universe of features.

A step says whether it reads the label. Those that do run only inside a
training fold; the registry and the chain runner hold that line.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.mutations import FAMILIES
from cairn.operators.carriage import top_n, two_by_two
from cairn.operators.stats import chi2, mutual_information

LAYERS = ("label_free", "train_fold")


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[..., DataFrame]
    label_free: bool
    version: int = 1

    @property
    def phase(self) -> str:
        return "label_free" if self.label_free else "train_fold"


REGISTRY: dict[str, Step] = {}


def register_step(name: str, label_free: bool, version: int = 1):
    def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"step {name} exists")
        REGISTRY[name] = Step(name, run, label_free, version)
        return run

    return add


@dataclass
class Chain:
    """Steps in order with their parameters, and what was said of each."""

    steps: Sequence[tuple[str, dict]]
    phase: str
    notes: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.phase not in LAYERS:
            raise ValueError(f"unknown phase {self.phase}")
        for name, _ in self.steps:
            if name not in REGISTRY:
                raise ValueError(f"unknown step {name}")
            if self.phase == "label_free" and not REGISTRY[name].label_free:
                raise ValueError(f"{name} reads the label: not before the folds")

    @property
    def label_safe(self) -> bool:
        return all(REGISTRY[n].label_free for n, _ in self.steps)

    def run(self, features: DataFrame, **context: DataFrame) -> DataFrame:
        """`context` has what label-reading steps ask for (counts, totals)."""
        for name, params in self.steps:
            step = REGISTRY[name]
            features = step.run(features, **params, **({} if step.label_free else context))
            self.notes.append(f"{name} v{step.version} {sorted(params.items())}")
        return features


@register_step("region_filter", label_free=True)
def region_filter(features: DataFrame, families: Sequence[str] = tuple(FAMILIES), flagged: DataFrame | None = None) -> DataFrame:
    """Without the features of the named gene families, nor of `flagged` genes."""
    for f in families:
        features = features.filter(~F.col("gene").rlike(FAMILIES[f]))
    return features if flagged is None else features.join(flagged.select("gene").distinct(), "gene", "left_anti")


@register_step("class_filter", label_free=True)
def class_filter(features: DataFrame, drop: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Mutation classes to keep, or else to drop."""
    if keep:
        return features.filter(F.col("mut_class").isin(list(keep)))
    return features.filter(~F.col("mut_class").isin(list(drop))) if drop else features


def overlapping(spans: DataFrame, others: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """Distinct `key` of `spans(key, start, end)` that overlap any of
    `others(start, end)`, ends included: both sides are dealt to bins of
    `width`, so the join has an equality."""

    def bins(df: DataFrame, *cols: str) -> DataFrame:
        return df.select(*cols, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bin"))

    a, b = bins(spans, key).alias("a"), bins(others).alias("b")
    hit = (F.col("a.bin") == F.col("b.bin")) & (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end"))
    return a.join(b, hit, "left_semi").select(key).distinct()


@register_step("callability_filter", label_free=True)
def callability_filter(features: DataFrame, annotations: DataFrame, spans: DataFrame) -> DataFrame:
    return features.join(overlapping(annotations, spans, "gene"), "gene", "left_anti")


METHODS = {"chi2": chi2, "mi": mutual_information}


@register_step("rank_association", label_free=False)
def rank_association(features: DataFrame | None, method: str = "chi2", n: int | None = 20, *, pairs: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features by association with the label in the counted rows, best `n` of
    each drug (and group of `by`); `features` None ranks all counted."""
    scored = two_by_two(pairs, totals, by).withColumn("score", F.round(METHODS[method](), 6))
    if features is not None:
        scored = scored.join(features.select("gene", "mutation").distinct(), ["gene", "mutation"], "left_semi")
    return top_n(scored, n, F.desc("score"), ("drug", *by))


def leave_one_out(grouped: DataFrame, group: str, values: Sequence[str], keys: Sequence[str], groups: DataFrame) -> DataFrame:
    """Counts without each group in turn, by subtraction from the totals: one
    pass instead of one for each group. `groups` has the
    groups to hold out, few by nature (lineages, countries)."""
    whole = grouped.groupBy(*keys).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    left = grouped.select(*keys, F.col(group).alias("held_out"), *values)
    names = [r[0] for r in groups.select(F.col(group).alias("g")).filter("g IS NOT NULL").distinct().orderBy("g").collect()]
    every = whole.withColumn("held_out", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    out = every.join(left, [*keys, "held_out"], "left")
    return out.select(*keys, "held_out", *[(F.col(f"_{v}") - F.coalesce(v, F.lit(0))).alias(v) for v in values])


def train_rows(rows: DataFrame, held_out: str, group: str = "lineage") -> DataFrame:
    """Rows that may train: not of the held-out group; unknown groups stay."""
    out = rows.filter(F.coalesce(group, F.lit("unknown")) != held_out)
    if out.isEmpty():
        raise ValueError(f"nothing left without {held_out}")
    return out
